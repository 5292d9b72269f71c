"""Operator 8: mixing sources to target weights with hash-threshold histograms.

Every document has a uniform hash of 60 bits.  A source's target is met by
taking all documents whose hash is below a threshold, on top of a whole number
of copies of each.  The threshold comes from histograms: sizes are summed by
source and the first 12 bits, running sums find the bucket in which the budget
ends, and only documents of that bucket go into the next histogram, by the
next 12 bits.  Documents are filtered by the threshold and never sorted; a larger
budget has a higher threshold, so its documents include those of a smaller one.

Rows that are repeated share a hash.  Where such rows stand at a threshold, as many of them are
taken as the rest of the budget covers; which of equal rows is no matter, so they are counted
and dealt out again, and a source misses its target by less than one document however often one is repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BLANKS, documents, let, written

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BITS, LEVELS = 12, 5


def word_count(text: Column) -> Column:
    """Number of words, from the pieces between blanks; 0 for a null."""

    def inner(p: Column) -> Column:
        return F.size(p) - (p[0] == F.lit("")).cast("int") - (F.element_at(p, -1) == F.lit("")).cast("int")

    return F.greatest(F.coalesce(let(F.split(text, BLANKS, -1), inner), F.lit(0)), F.lit(0)).cast("long")


def position() -> Column:
    """Uniform hash of doc_id and text, of BITS * LEVELS bits."""
    told = F.md5(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    return F.conv(F.substring(told, 1, 15), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and hash of every row."""
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), position().alias("u"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target): ``share`` of all sizes, dealt by weight, at most ``most`` times each source's size.

    Sources are in code point order, null last, and take the weights in turn.
    A source stops at its cap c once the level (target by weight) passes c / w;
    in order of c / w the capped ones come first, so the level that the others
    share follows from running sums.  One row per source is all that is ordered.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    s = s.withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (turn + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("at", F.col("cap") / F.col("w"))
    by_cap = Window.orderBy("at", F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # The level if this source and all after it are not capped, and all before it are.
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(rest)
    s = s.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "level"))).over(everything)["level"])
    return s.select("source", "source_size", F.coalesce(F.least(F.col("level") * F.col("w"), F.col("cap")), F.col("cap")).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold, left): the documents with u < threshold have ``left`` words less than ``budget``, and those at it pass it.

    ``budgets``: (source, budget).  Each level sums the sizes of what lies in the
    boundary bucket of the one before; a source whose budget covers all has no
    boundary and the highest threshold.
    """
    top = BITS * LEVELS
    found = written(budgets.select("source", F.lit(0).cast("long").alias("low"), F.col("budget").cast("double").alias("left"), F.lit(True).alias("open")), "thresholds")
    inside = sizes
    for level in range(1, LEVELS + 1):
        width = 1 << (top - BITS * level)  # hashes in a bucket of this level
        hist = inside.groupBy("source", F.shiftright("u", top - BITS * level).alias("bucket")).agg(F.sum("size").alias("words"))
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("upto", run)
        joined = hist.join(found.select(F.col("source").alias("_s"), "left"), F.col("source").eqNullSafe(F.col("_s")))
        edge = joined.filter(F.col("upto") > F.col("left")).groupBy("source").agg(F.min(F.struct("bucket", "upto", "words")).alias("e"))
        edge = edge.select(F.col("source").alias("_s"), "e")
        found = found.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left").select(
            "source",
            F.when(F.col("e").isNotNull(), F.col("e.bucket") * F.lit(width)).otherwise(F.col("low")).alias("low"),
            F.when(F.col("e").isNotNull(), F.col("left") - (F.col("e.upto") - F.col("e.words"))).otherwise(F.col("left")).alias("left"),
            F.col("e").isNotNull().alias("open"),
        )
        found = written(found, "thresholds")
        if level < LEVELS:
            at = found.filter("open").select(F.col("source").alias("_s"), "low")
            here = (F.col("u") >= F.col("low")) & (F.col("u") < F.col("low") + F.lit(width))
            inside = written(inside.join(at, F.col("source").eqNullSafe(F.col("_s"))).filter(here).select("source", "u", "size"), "boundary")
    return found.select("source", F.when(F.col("open"), F.col("low")).otherwise(F.lit(1 << top)).alias("threshold"), "left")


def plan(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(_source, source_size, target, whole, threshold, extra): the copies that every document gets, the hash below
    which it gets one more, and how many rows at that hash do as well."""
    aims = written(targets(sizes, weights, share, most), "targets")
    whole = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
    aims = aims.withColumn("whole", F.least(whole, F.lit(int(most)).cast("long")))
    cuts = thresholds(sizes, aims.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget")))
    edge = sizes.join(cuts.select(F.col("source").alias("_s"), "threshold"), F.col("source").eqNullSafe(F.col("_s")) & (F.col("u") == F.col("threshold")))
    edge = edge.groupBy(F.col("source").alias("_edge")).agg(F.max("size").alias("each"), F.lit(True).alias("_has"))
    cuts = cuts.join(edge, F.col("source").eqNullSafe(F.col("_edge")) & F.col("_has"), "left")
    extra = F.coalesce(F.floor(F.col("left") / F.nullif(F.col("each"), F.lit(0))), F.lit(0)).cast("long")
    aims = aims.join(cuts.select(F.col("source").alias("_source"), "threshold", extra.alias("extra")), F.col("source").eqNullSafe(F.col("_source")))
    return written(aims.drop("source"), "plan")


def _copies(more: Column, most: float) -> Column:
    return F.least(F.col("whole") + more.cast("long"), F.lit(int(most)).cast("long")).alias("copies")


#: Equal rows that one task deals out again.
DEALT = 1 << 16


def _dealt(edge: DataFrame, most: float) -> DataFrame:
    """The rows at a threshold, counted by equal rows and dealt out again with their copies: the first ``extra`` of a source get one more."""
    kept = ["_row", "source_size", "target", "whole", "extra"]
    groups = edge.withColumn("_h", F.xxhash64("_row")).groupBy("_source", "_h").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in kept])
    before = F.sum("n").over(Window.partitionBy("_source").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1))  # different rows of one text
    groups = groups.withColumn("more", F.col("extra") - F.coalesce(before, F.lit(0)))
    parts = groups.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / DEALT)))).repartition("part", "_h")
    first = F.col("part") * DEALT
    rows = parts.withColumn("number", F.explode(F.sequence(first, F.least(first + DEALT, F.col("n")) - 1)))
    return rows.select("_row", "source_size", "target", _copies(F.col("number") < F.col("more"), most))


def _mixed(rows: DataFrame, aims: DataFrame, most: float) -> DataFrame:
    """(_row, source_size, target, copies) for every row of ``rows`` (_row, _own, u)."""
    each = rows.join(aims, F.col("_own").eqNullSafe(F.col("_source")))
    below = F.col("u") < F.col("threshold")
    if aims.filter("extra > 0").isEmpty():
        return each.select("_row", "source_size", "target", _copies(below, most))
    at = (F.col("u") == F.col("threshold")) & (F.col("extra") > 0)
    return each.filter(~at).select("_row", "source_size", "target", _copies(below, most)).unionByName(_dealt(each.filter(at), most))


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (size times copies) of every row.

    Null and empty texts have size 0.  A null source is a source.  Repeated rows have one hash and
    are taken one by one.  A source without words has target 0.  Very long texts are counted whole.
    """
    sizes = written(sized(docs), "sizes")
    rows = sizes.select(F.struct("doc_id", "source", "size").alias("_row"), F.col("source").alias("_own"), "u")
    each = _mixed(rows, plan(sizes, weights, share, most), most)
    return each.select("_row.doc_id", "_row.source", "_row.size", "source_size", "target", "copies", (F.col("_row.size") * F.col("copies")).alias("taken"))


def repeated(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Each row of ``docs`` as many times as the mix takes it; all columns stay."""
    aims = plan(written(sized(docs), "sizes"), weights, share, most)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), F.col("source").alias("_own"), position().alias("u"))
    each = _mixed(rows, aims, most)
    return each.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source,
    CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')) AS BIGINT) AS size,
    CAST('0x' || left(md5(concat_ws(chr(10), coalesce(CAST(doc_id AS VARCHAR), ''), coalesce(text, ''))), 15) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)] AS w
  FROM d GROUP BY source
), c AS (SELECT *, source_size * 2.0::DOUBLE AS cap, source_size * 2.0::DOUBLE / w AS edge FROM s),
l AS (
  SELECT *, ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY edge, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY edge, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM c
), t AS (
  SELECT source, source_size, coalesce(least((SELECT level FROM l WHERE level <= edge ORDER BY edge, level LIMIT 1) * w, cap), cap) AS target FROM c
), b AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target / source_size) AS BIGINT) END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.whole, d.u,
    b.target - b.whole * b.source_size AS budget,
    sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * least(whole + CASE WHEN upto <= budget THEN 1 ELSE 0 END, 2) AS BIGINT) AS taken
FROM r
"""
