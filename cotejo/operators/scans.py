"""Running values over ordered groups of any size, and global numbering.

A plain window over a key puts the whole key in one task.  These operators cut
a key into slices of its ordering column, work inside each slice, and pass one
summary row per slice on to the later slices of the same key.  No task holds
more than one slice of one key, or the slice summaries of one key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLICE_ROWS = 1_000_000


def slice_number(order: Column, width: int) -> Column:
    """Number of the slice, never null.

    A nullable join key would get a not-null filter on one side only, and the
    two branches over one exchange could no longer share it.
    """
    return F.coalesce(F.floor(order / width).cast("bigint"), F.lit(0))


def sliced(df: DataFrame, order: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds the slice column ``_slice``, unless an earlier step left it in place.

    Steps that share the column also share the shuffle by (key, slice).
    """
    if "_slice" in df.columns:
        return df
    return df.withColumn("_slice", slice_number(F.col(order), slice_rows))


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: Column,
    out: str,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Adds ``out``: the latest non-null ``value`` at or before each row.

    ``order`` is a whole number, unique inside ``keys``, such as a line number.
    Keys must not be null.
    """
    by = [*keys, "_slice"]
    rows = sliced(df, order, slice_rows).withColumn("_value", value)
    local = rows.withColumn("_local", F.last("_value", ignorenulls=True).over(Window.partitionBy(*by).orderBy(order)))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        rows.groupBy(*by)
        .agg(F.max_by("_value", F.when(F.col("_value").isNotNull(), F.col(order))).alias("_tail"))
        .withColumn("_carry", F.last("_tail", ignorenulls=True).over(before))
        .drop("_tail")
    )
    return (
        local.join(handed, by)
        .withColumn(out, F.coalesce("_local", "_carry"))
        .drop("_slice", "_value", "_local", "_carry")
    )


LEVEL_BITS = 12


def _offsets(counts: DataFrame, bits: int = 64) -> DataFrame:
    """(slice, offset): sum of the counts of all earlier slices; ``counts`` is (slice, n).

    Counts are summed level by level: inside groups of 2 ** LEVEL_BITS slices, and
    over the groups in the same way.  No window holds more than one group.
    """
    group = F.shiftright("slice", min(LEVEL_BITS, bits - 1))
    within = Window.partitionBy("group").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    inside = counts.withColumn("group", group).withColumn("inside", F.coalesce(F.sum("n").over(within), F.lit(0)))
    if bits <= LEVEL_BITS + 1:  # two groups are left, of negative and of other slices
        below = counts.where("slice < 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("outside")).select(F.lit(0).cast("bigint").alias("group"), "outside")
    else:
        below = _offsets(counts.groupBy(group.alias("slice")).agg(F.sum("n").alias("n")), bits - LEVEL_BITS)
        below = below.withColumnsRenamed({"slice": "group", "offset": "outside"})
    return inside.join(below, "group", "left").select("slice", (F.col("inside") + F.coalesce("outside", F.lit(0))).alias("offset"))


def number_rows(df: DataFrame, order: str, out: str, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... in ascending ``order`` over the whole table.

    ``order`` is a whole number, unique in the table.  Rows are numbered inside
    slices of it; a slice's offset is the sum of the earlier slices' counts.
    """
    rows = df.withColumn("_slice", slice_number(F.col(order), slice_rows))
    offsets = _offsets(rows.groupBy(F.col("_slice").alias("slice")).agg(F.count("*").alias("n")))
    offsets = offsets.select(F.col("slice").alias("_slice"), F.col("offset").alias("_offset"))
    inside = Window.partitionBy("_slice").orderBy(order)
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(offsets, "_slice")
        .withColumn(out, F.col("_offset") + F.col("_rank") - 1)
        .drop("_slice", "_rank", "_offset")
    )


def drop_last_rows(df: DataFrame, order: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    """Every row but the ``n`` with the highest ``order`` (report footers).

    Rows of equal ``order`` are taken by the columns ``ties``, highest first.  If rows equal in
    all of these stand at the edge, which of them go is not told, so that raises.
    """
    if n <= 0:
        return df
    by = [order, *ties]
    ends = df.groupBy(*by).agg(F.count("*").alias("_n")).orderBy(*[F.col(c).desc_nulls_last() for c in by]).limit(n)
    high = Window.orderBy(*[F.col(c).desc_nulls_last() for c in by])  # over n rows at most
    ends = ends.withColumn("_upto", F.sum("_n").over(high)).where(F.col("_upto") - F.col("_n") < n)
    split = F.raise_error(F.lit(f"rows equal in {', '.join(by)} stand at the edge of the last {n}"))
    ends = ends.select(F.when(F.col("_upto") > n, split).otherwise(F.col(order)).alias("_0"), *[F.col(c).alias(f"_{i}") for i, c in enumerate(by) if i])
    same = [df[c].eqNullSafe(ends[f"_{i}"]) for i, c in enumerate(by)]
    return df.join(ends, same, "left_anti")


def skip_first_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """Rows after the first ``n`` line numbers (report preambles)."""
    return df.where(F.col(order) > n)
