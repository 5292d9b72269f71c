"""Duplicates: all of them for review, or the first per key.

Both are aggregations with partial results before the shuffle, so a key that
holds a large share of the rows costs one small state per task, not one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.operators.joins import DEALT


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every row whose key occurs more than once; missing values are equal."""
    key = F.struct(*[F.col(k) for k in keys])
    rows = df.withColumn("_key", key)
    often = rows.groupBy("_key").agg(F.count("*").alias("_n")).where("_n > 1").select("_key")
    return rows.join(often.hint(DEALT), "_key", "left_semi").drop("_key")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the lowest ``order`` per key; ``order`` must be total."""
    row = F.struct(*[F.col(c) for c in df.columns])
    turn = F.struct(*[F.col(c) for c in order])
    key = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    return df.groupBy(*key).agg(F.min_by(row, turn).alias("_row")).select("_row.*")


def split_duplicates(
    df: DataFrame, keys: Sequence[str], order: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(first row per key, every row of repeated keys)."""
    return first_per_key(df, keys, order), duplicates(df, keys)
