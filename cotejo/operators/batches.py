"""Fixed-size batches of distinct keys, for sources that limit a request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import strip
from cotejo.operators.scans import SLICE_ROWS, number_rows

BATCH_SIZE = 990  # Fixed value: keys per request.


def key_batches(
    df: DataFrame, key: str, order: str, size: int = BATCH_SIZE, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Distinct trimmed keys in order of first appearance, with their batch.

    Columns: the key, ``position`` (0-based), ``batch`` (0-based).
    """
    firsts = df.groupBy(strip(F.col(key).cast("string")).alias(key)).agg(F.min(order).alias("_first"))
    numbered = number_rows(firsts, "_first", "position", slice_rows)
    return numbered.select(key, "position", F.floor(F.col("position") / size).cast("bigint").alias("batch"))


def batch_requests(batches: DataFrame, key: str) -> DataFrame:
    """One row per batch: key count and the newline-separated request text."""
    ordered = F.array_sort(F.collect_list(F.struct("position", key)))
    return (
        batches.groupBy("batch")
        .agg(F.count("*").alias("n_keys"), ordered.alias("_keys"))
        .select("batch", "n_keys", F.array_join(F.transform("_keys", lambda x: x[key]), "\n").alias("request"))
    )
