"""Report reconciliation and service-level audit on Spark DataFrames.

* ``functions``  column expressions: text, time, dates inside text, numbers
* ``operators``  DataFrame operators: joins, intervals, scans, rules, findings
* ``sources``    contracted scans, landed documents, sinks
* ``plans``      whole pipelines built from the three above
"""
