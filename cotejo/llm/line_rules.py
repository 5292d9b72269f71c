"""Operator 2: quality rules with line frequencies across documents.

Lines are normalised (lower case, runs of anything but letters as one blank), and hashed
with their host to 128 bits.  Each different line of a document counts once;
documents of a host that are equal in text count as one.  A line found in more
than ``LIMIT`` documents of its host, and in more than one in ``ONE_IN`` of all that have lines, is removed, and a
document that loses more than ``DEPLETED`` of the words of its different lines is rejected, as is one that
fails the base rules.  The host of a document is its source.

All of it is column functions and grouped joins; lines travel as hashes, and are split and
normalised once.  A very long text is an array of its words and one of its lines in its own task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, words, written

LIMIT, ONE_IN, DEPLETED = 5, 20, 0.5
WORD = r"[^\x20\x09-\x0D]"
#: Anything in ASCII but letters; other signs stay.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"


def repeat_words(w: Column) -> Column:
    """Of an array of words, how many lie in a triple of consecutive words found twice or more.

    Triples are sorted by hash with their places; neighbours of one hash repeat.
    """

    def covered(places: Column) -> Column:
        gaps = F.zip_with(F.slice(places, 1, F.greatest(F.size(places) - 1, F.lit(0))), F.slice(places, 2, F.greatest(F.size(places) - 1, F.lit(0))), lambda a, b: F.least(b - a, F.lit(3)))
        return F.when(F.size(places) == 0, F.lit(0)).otherwise(F.aggregate(gaps, F.lit(3), lambda n, g: n + g))

    def again(s: Column) -> Column:
        same = F.filter(s, lambda x, j: x["h"].eqNullSafe(F.get(s, j - 1)["h"]) | x["h"].eqNullSafe(F.get(s, j + 1)["h"]))
        return let(F.sort_array(F.transform(same, lambda x: x["i"])), covered)

    triples = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
    return F.when(F.size(w) < 3, F.lit(0)).otherwise(let(F.sort_array(triples), again)).cast("long")


def lines(text: Column) -> Column:
    """Lines that have a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), BETWEEN, " "))


def _host(host: str = "source") -> Column:
    return F.coalesce(F.col(host), F.lit("\n"))


def _text_key(host: str = "source") -> Column:
    """Stands for a text at its host."""
    return F.xxhash64(_host(host), F.coalesce("text", F.lit("")))


def measures(docs: DataFrame) -> DataFrame:
    """Base measures of every row, with the key ``ht`` of its text; nulls are empty texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = docs.select("doc_id", _text_key().alias("ht"), text.alias("text"), words(F.col("text")).alias("w"), lines(F.col("text")).alias("l"))
    n = F.size("w").cast("long")
    return cut.select(
        "doc_id",
        "ht",
        n.alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).alias("n_repeat_words"),
    )


def host_lines(docs: DataFrame, host: str = "source") -> DataFrame:
    """(h1, h2, hh, ht, words): each different normalised line of each different text of a host, hashed with the host; hh is the host."""
    each = F.explode(F.array_distinct(F.transform(lines(F.col("text")), normalised)))
    rows = docs.select(_host(host).alias("_host"), _text_key(host).alias("ht"), each.alias("_line")).filter(F.col("_line") != "")
    hashes = [F.xxhash64("_host", "_line").alias("h1"), F.xxhash64("_line", "_host", F.lit("second")).alias("h2"), F.xxhash64("_host").alias("hh")]
    rows = rows.select(*hashes, "ht", F.size(F.split("_line", " ")).cast("long").alias("words"))
    return rows.groupBy("h1", "h2", "hh", "ht").agg(F.first("words").alias("words"))


def frequent(rows: DataFrame, limit: int = LIMIT, one_in: int = ONE_IN) -> DataFrame:
    """(h1, h2) of the lines found in more than ``limit`` different texts of a host and in more than one in ``one_in`` of them."""
    texts = rows.select("hh", "ht").distinct().groupBy("hh").agg(F.count("*").alias("texts"))
    n = rows.groupBy("h1", "h2", "hh").agg(F.count("*").alias("n")).filter(F.col("n") > limit)
    return n.join(texts, "hh").filter(F.col("n") * one_in > F.col("texts")).select("h1", "h2")


def judged(docs: DataFrame, limit: int = LIMIT, depleted: float = DEPLETED, one_in: int = ONE_IN) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, frequent_words.

    A row per input row; null texts are empty and fail the base rules; rows
    without source are of one host; repeated rows have equal results.
    """
    rows = written(host_lines(docs), "lines")
    often = frequent(rows, limit, one_in).withColumn("_often", F.lit(True))
    lost = F.coalesce(F.sum(F.when(F.col("_often"), F.col("words"))), F.lit(0))
    told = rows.join(often, ["h1", "h2"], "left").groupBy("ht").agg(F.sum("words").alias("line_words"), lost.alias("frequent_words"))
    m = measures(docs).join(told.filter("frequent_words > 0"), "ht", "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    lost_most = F.coalesce(F.col("frequent_words") > depleted * F.col("line_words"), F.lit(False))
    return m.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~lost_most).alias("kept"),
        F.coalesce("frequent_words", F.lit(0)).cast("long").alias("frequent_words"),
    )


def without_frequent_lines(docs: DataFrame, limit: int = LIMIT, one_in: int = ONE_IN) -> DataFrame:
    """``docs`` with the frequent lines of each host removed from ``text``; all columns and rows stay."""
    rows = written(host_lines(docs), "lines")
    hit = rows.join(frequent(rows, limit, one_in), ["h1", "h2"]).groupBy("ht").agg(F.collect_set("h1").alias("_gone"))
    keyed = docs.select(_text_key().alias("ht"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"), _host().alias("_host"))
    kept = F.filter(F.split("_row.text", "\n", -1), lambda x: ~F.array_contains("_gone", F.xxhash64("_host", normalised(x))))
    text = F.when(F.col("_gone").isNull(), F.col("_row.text")).otherwise(F.array_join(kept, "\n"))
    joined = keyed.join(hit, "ht", "left").withColumn("_row", F.col("_row").withField("text", text))
    return joined.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))


SQL = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM t),
g AS (
  SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM g) WHERE n > 1),
rw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
l AS (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line FROM t),
lw AS (SELECT * FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lw GROUP BY doc_id),
nl AS (
  SELECT DISTINCT doc_id, source, text, trim(regexp_replace(lower(line), '[\x00-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')) AS line FROM lw
), nw AS (SELECT *, len(string_split(line, ' ')) AS words FROM nl WHERE line <> ''),
h AS (SELECT source, count(DISTINCT text) AS texts FROM nw WHERE line <> '' GROUP BY source),
n AS (SELECT source, line, count(DISTINCT text) AS n FROM nw GROUP BY source, line),
f AS (SELECT n.source, n.line FROM n JOIN h ON n.source IS NOT DISTINCT FROM h.source WHERE n.n > 5 AND n.n * 20 > h.texts),
x AS (
  SELECT nw.doc_id, sum(words) AS total, sum(CASE WHEN f.line IS NOT NULL THEN words ELSE 0 END) AS lost
  FROM nw LEFT JOIN f ON nw.line = f.line AND nw.source IS NOT DISTINCT FROM f.source GROUP BY nw.doc_id
), m AS (
  SELECT t.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dl.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rw.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(x.lost, 0) AS lost, coalesce(x.total, 0) AS total
  FROM t JOIN w USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN rw USING (doc_id) LEFT JOIN x USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (lost > 0.5 * total) AS kept,
  CAST(lost AS BIGINT) AS frequent_words
FROM m
"""
