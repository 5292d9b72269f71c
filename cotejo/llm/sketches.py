"""Operator 3: document fingerprints as bottom-k sketches of word shingles.

A sketch is the ascending array of the ``SIZE`` smallest hashes of a text's
different shingles of five words (of fewer, the whole sequence).  Sketches of
parts merge into the sketch of their union; two sketches estimate resemblance
and containment, and one estimates the number of different shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, documents, words

SIZE, SHINGLE = 64, 5
#: Documents lie in slices of 2 ** SLICE ids; slices are followed level by level, 2 ** LEVEL at a time.
SLICE, LEVEL = 6, 14


def sketch_of_words(w: Column, size: int = SIZE, n: int = SHINGLE) -> Column:
    """Sketch of an array of words, which must be a column that is computed already."""
    every = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(n))))
    short = F.array(F.xxhash64(F.array_join(w, " "), F.size(w)))
    hashes = F.when(F.size(w) >= n, every).when(F.size(w) > 0, short).otherwise(F.array().cast("array<bigint>"))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def with_sketch(df: DataFrame, text: str, name: str, size: int = SIZE) -> DataFrame:
    return df.withColumn("_w", words(F.col(text))).withColumn(name, sketch_of_words(F.col("_w"), size)).drop("_w")


def merged(a: Column, b: Column, size: int = SIZE) -> Column:
    """Sketch of the union of two parts' shingles."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of common shingles among all of two texts; 1 for two without any."""
    whole = merged(a, b, size)
    common = F.size(F.array_intersect(F.array_intersect(whole, a), b))
    return F.when(F.size(whole) == 0, F.lit(1.0)).otherwise(common / F.size(whole))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of different shingles: exact below ``size``, else from the largest kept hash."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise((size - 1) / share)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has; 1 if a has none."""
    both = resemblance(a, b, size) * distinct_shingles(merged(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, size)))


def printed(a: Column) -> Column:
    """A sketch as text: 16 hex digits a hash."""
    return F.lower(F.array_join(F.transform(a, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def followers(ids: DataFrame, bits: int) -> DataFrame:
    """(x, next) for distinct integers x of so many bits; the last is followed by the first.

    Windows hold 2 ** LEVEL integers at most, apart from the uppermost of 2 ** 16.
    """
    if bits <= 16:
        everything = Window.partitionBy().orderBy("x")
        whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return ids.select("x", F.coalesce(F.lead("x").over(everything), F.first("x").over(whole)).alias("next"))
    group = F.shiftright("x", LEVEL)
    here = ids.select("x", group.alias("g"))
    heads = here.groupBy("g").agg(F.min("x").alias("head"))
    above = followers(heads.select(F.col("g").alias("x")), bits - LEVEL).select(F.col("x").alias("g"), F.col("next").alias("_next"))
    after = above.join(heads.select(F.col("g").alias("_next"), F.col("head").alias("after")), "_next").select("g", "after")
    here = here.withColumn("near", F.lead("x").over(Window.partitionBy("g").orderBy("x")))
    return here.join(after, "g").select("x", F.coalesce("near", "after").alias("next"))


def beside_next(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """Every row (doc_id, text, sketch) with text and sketch of the next one, in ascending order of doc_id.

    The texts are shuffled once, by slice; only the last row of each slice is joined
    with the first of the slice that follows.
    """
    rows = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = with_sketch(rows, "text", "sketch", size).withColumn("_slice", F.shiftright("_id", SLICE))
    order = Window.partitionBy("_slice").orderBy("_id", "text")
    # Both ends of a slice are told by neighbours, not by rank, and all branches use the same columns, so they share one shuffle.
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).withColumn("_before", F.lag("_id").over(order))
    first = rows.filter("_before is null").select(F.col("_slice").alias("_after"), F.col("text").alias("_t"), F.col("sketch").alias("_s"))
    chain = followers(docs.select(F.shiftright(F.coalesce("doc_id", F.lit(NO_ID)), SLICE).alias("x")).distinct(), 64 - SLICE)
    chain = chain.select(F.col("x").alias("_slice"), F.col("next").alias("_after"))
    last = rows.filter("next_text is null").select("_id", "text", "sketch", "_slice").join(chain, "_slice").join(first, "_after")
    last = last.select("_id", "text", "sketch", F.col("_t").alias("next_text"), F.col("_s").alias("next_sketch"))
    both = rows.filter("next_text is not null").select("_id", "text", "sketch", "next_text", "next_sketch").unionAll(last)
    return both.withColumn("doc_id", F.when(F.col("_id") != NO_ID, F.col("_id"))).drop("_id")


def compared(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shingles.

    A row per input row.  The edited text has the last half of the code points replaced by
    the first as many of the next row's.  Null texts are empty and have an empty
    fingerprint; two empty ones have likeness 1.  A missing doc_id comes before all
    others; rows that share a doc_id follow each other in order of their texts.
    """
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - half), F.col("next_text").substr(F.lit(1), half))
    rows = beside_next(docs, size).select("doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch", edited.alias("edited"))
    rows = with_sketch(rows, "edited", "edited_sketch", size)
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        printed(F.col("sketch")).alias("fingerprint"),
        printed(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), size).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), size).alias("near_next"),
        distinct_shingles(F.col("sketch"), size).alias("shingles"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir))
