"""Session settings the engine relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def build_session(app: str = "cotejo", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the plans assume.

    On a cluster leave ``master`` unset and let the submitter decide.  Dates are
    naive local values, so the session zone is pinned; adaptive execution
    coalesces small shuffles, splits skewed join partitions and picks broadcast
    joins from measured sizes.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Call sites of every column expression are not worth their cost here.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        "spark.ui.enabled": "false",
        **conf,
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def local_session(cores: int | None = None, **conf: str) -> SparkSession:
    """Local session for tests and the bench."""
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return build_session(
        master=f"local[{cores}]",
        **{
            "spark.sql.shuffle.partitions": str(cores),
            "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
            **conf,
        },
    )
