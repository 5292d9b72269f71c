"""Findings: union, one row per ticket, counts, and a column profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cotejo.functions.text import UNKNOWN

# Output columns and separator.
FINDING = ("nro_incidencia", "mensaje", "objetivo", "TIPO REPORTE")
SEPARATOR = " | "
#: Spellings of a missing key.
MISSING = (UNKNOWN, "nan", "")


def union_all(frames: Sequence[DataFrame], fill: str = "") -> DataFrame:
    """Union by name; a text column that a frame lacks is filled."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    text = [n for n, t in out.dtypes if t == "string" and any(n not in f.columns for f in frames)]
    if not text:
        return out
    return out.fillna(fill, subset=text)


def by_ticket(findings: DataFrame, key: str = FINDING[0], kind: str = FINDING[3]) -> DataFrame:
    """One row per ticket: messages and codes in rule order, first known type.

    The result is by definition one text cell per ticket.  Findings of a ticket
    meet only here; the long form stays available for anything larger.  Rows
    whose ticket is missing are no one ticket's and stay apart, by ``row``.
    """
    kept = findings.where(F.col(key).isNotNull() & (F.col(key) != ""))
    ordered = F.array_sort(
        F.collect_list(
            F.struct("seq", "row", "mensaje", "objetivo", F.col(f"`{kind}`").alias("kind"))
        )
    )
    known = F.filter(F.col("_all"), lambda x: x["kind"].isNotNull())
    return (
        kept.groupBy(key, F.when(F.col(key).isin(*MISSING), F.col("row")).alias("_apart"))
        .agg(ordered.alias("_all"))
        .select(
            key,
            F.array_join(F.transform("_all", lambda x: x["mensaje"]), SEPARATOR).alias("mensaje"),
            F.array_join(F.transform("_all", lambda x: x["objetivo"]), SEPARATOR).alias("objetivo"),
            F.try_element_at(known, F.lit(1))["kind"].alias(kind),
        )
    )


def observation_count(findings: DataFrame) -> DataFrame:
    """One row: ``observaciones`` and ``hay_observaciones``."""
    n = F.count("*")
    return findings.agg(n.alias("observaciones"), (n > 0).alias("hay_observaciones"))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: type, present, missing, missing percent, distinct.

    The table is read once into pairs of column and SHA-256 digest of the value, which are
    counted before the shuffle; so a long value travels as 32 bytes, and distinct counts are exact
    unless two digests collide.  Array and struct values count by their text.
    """
    names = df.columns
    types = dict(df.dtypes)
    text = lambda n: F.unhex(F.sha2(F.col(f"`{n}`").cast("string"), 256))
    pairs = df.select(
        F.explode(
            F.array(
                *[F.struct(F.lit(i).alias("i"), text(n).alias("value")) for i, n in enumerate(names)]
            )
        ).alias("_p")
    ).select("_p.i", "_p.value")
    counted = pairs.groupBy("i", "value").agg(F.count("*").alias("n"))
    present = F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0))
    missing = F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0))
    name = F.array(*[F.lit(n) for n in names])
    kind = F.array(*[F.lit(types[n]) for n in names])
    return (
        counted.groupBy("i")
        .agg(present.alias("non_null"), missing.alias("nulls"), F.count("value").alias("distinct_values"))
        .select(
            F.get(name, F.col("i")).alias("column_name"),
            F.get(kind, F.col("i")).alias("data_type"),
            "non_null",
            "nulls",
            F.round(F.col("nulls") / (F.col("non_null") + F.col("nulls")) * 100, 2).alias("null_percent"),
            "distinct_values",
        )
    )
