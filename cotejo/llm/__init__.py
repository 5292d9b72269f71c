"""Operators for preparing training text: removal of repeats, quality, secrets, archives, mixing, packing.

Nothing outside this package imports it.  ``registry`` lists its queries.  Code that
runs in tasks travels to the workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
