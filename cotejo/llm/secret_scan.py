"""Operator 4: secret scans with an incremental ledger of blobs.

Every version of a text is a blob, named by its SHA-256.  The ledger holds which rule, in
which version, has seen which blob, and what it found there.  A scan takes the blobs of the
given rows, leaves out the pairs of blob and rule version that the ledger has, reads one text
for each blob that is left, notes findings and then pairs, and joins the findings of
all blobs back to all rows.  A run that dies between the two notes scans its blobs again; equal
findings count once.

Very long texts and texts of very many secrets cost their length; a text is one row of one task.
Places are code points.  They come from the pieces between matches, whose
lengths add up to the places of the matches; column functions only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, appended, between, chunks, documents, let, new_folder, written


@dataclass(frozen=True)
class Rule:
    """A pattern; matches whose group has fewer than ``least`` characters are dropped afterwards."""

    name: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1


# Fixed patterns.  A run of hex digits (or capitals after AKIA) shorter than the least length
# holds no other match, so the length can be a part of the pattern there.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
BASE = ("assign", "access", "hex")
_SPAN = "struct<start: int, rule: int, end: int>"


def matches(text: Column, rule: Rule, number: int) -> Column:
    """Spans (start, rule number, end) of the leftmost non-overlapping matches of a rule."""
    hits = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    kept = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.least else hits
    gaps = F.split(text, rule.pattern, -1)
    each = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("hit"), kept.alias("value"))
    each = F.transform(each, lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.length(x["hit"]).alias("hit"), F.length(x["value"]).alias("value")))
    none = F.array().cast(f"array<{_SPAN}>")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        a = at + x["gap"]
        span = F.struct(a.alias("start"), F.lit(number).alias("rule"), (a + x["hit"]).alias("end"))
        return a + x["hit"], F.when(x["value"] >= rule.least, F.array(span)).otherwise(none)

    found = let(each, lambda x: appended(x, F.lit(0), _SPAN, step)["out"])
    return F.when(text.rlike(rule.pattern), found).otherwise(none)


class Ledger:
    """Findings and scanned pairs of blob and rule version, as Parquet in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.folder, self.rules = spark, folder, rules
        self.names = [f"{r.name}@{r.version}" for r in rules]

    def _table(self, name: str, schema: str) -> DataFrame:
        """A table of the ledger; empty before the first scan."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _seen(self) -> DataFrame:
        return self._table("scanned", "blob binary, pair string")

    def _found(self) -> DataFrame:
        return self._table("findings", "blob binary, pair string, start int, end int")

    def scan(self, docs: DataFrame) -> DataFrame:
        """(_id, _text, spans) for every row of ``docs`` (doc_id, text), spans sorted, by start and rule; null if there are none.

        Null texts are empty; repeated rows have equal results.
        """
        text = F.coalesce("text", F.lit(""))
        keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text"), text.alias("text"))
        paths = written(keyed.select("_id", "_text", F.unhex(F.sha2("text", 256)).alias("blob")), "paths")
        seen = self._seen().groupBy("blob").agg(F.collect_set("pair").alias("seen"))
        wanted = F.array(*(F.lit(x) for x in self.names))
        fresh = paths.groupBy("blob").agg(F.min(F.struct("_id", "_text")).alias("k")).join(seen, "blob", "left")
        fresh = fresh.withColumn("pairs", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).filter(F.size("pairs") > 0)
        fresh = written(fresh.select("blob", "k._id", "k._text", "pairs"), "fresh")

        texts = keyed.join(fresh, ["_id", "_text"]).groupBy("_id", "_text").agg(*[F.first(c).alias(c) for c in ("blob", "text", "pairs")])  # one of repeated rows
        none = F.array().cast(f"array<{_SPAN}>")
        by_rule = [F.when(F.array_contains("pairs", name), matches(F.col("text"), r, i)).otherwise(none) for i, (name, r) in enumerate(zip(self.names, self.rules))]
        spans = texts.select("blob", F.explode(F.concat(*by_rule)).alias("s"))
        told = spans.select("blob", wanted[F.col("s.rule")].alias("pair"), "s.start", "s.end")
        told.write.mode("append").parquet(f"{self.folder}/findings")
        fresh.select("blob", F.explode("pairs").alias("pair")).write.mode("append").parquet(f"{self.folder}/scanned")

        number = F.create_map(*(F.lit(x) for i, name in enumerate(self.names) for x in (name, i)))
        found = self._found().filter(F.col("pair").isin(self.names)).distinct()
        by_blob = found.groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", number[F.col("pair")].alias("rule"), "end"))).alias("spans"))
        return paths.join(by_blob, "blob", "left").select("_id", "_text", "spans")


def told(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, joined by commas."""
    names = F.array(*(F.lit(r.name) for r in rules))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["rule"]], s["start"], s["end"])), ",")


def scanned(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans, a row per input row."""
    base = [i for i, r in enumerate(ledger.rules) if r.name in BASE]
    spans = F.coalesce("spans", F.array().cast(f"array<{_SPAN}>"))
    rows = ledger.scan(docs).select(F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"), spans.alias("s"))

    def count(number: int) -> Column:
        return F.size(F.filter("s", lambda x: x["rule"] == number)).cast("long").alias(f"n_{ledger.rules[number].name}")

    own = F.filter("s", lambda x: x["rule"].isin(base))
    return rows.select("doc_id", *map(count, base), F.sha2(told(own, ledger.rules), 256).alias("base_sha256"), told(F.col("s"), ledger.rules).alias("spans"))


def redacted(docs: DataFrame, ledger: Ledger) -> DataFrame:
    """``docs`` with each run of overlapping spans in ``text`` replaced by [REDACTED]; all rows and columns stay."""
    spans = ledger.scan(docs).filter(F.col("spans").isNotNull()).groupBy("_id", "_text").agg(F.first("spans").alias("_spans"))
    row = F.struct(*(docs[c] for c in docs.columns))
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text"), row.alias("_row"))
    text = F.col("_row.text")

    def step(end: Column, s: Column) -> tuple[Column, Column]:
        """What is left between two runs of overlapping spans."""
        gap = F.struct(end.alias("a"), s["start"].alias("b"))
        return F.greatest(end, s["end"]), F.when(s["start"] >= end, F.array(gap)).otherwise(F.array().cast("array<struct<a: int, b: int>>"))

    def clean_text(cut: Column, gaps: Column) -> Column:
        kept = F.array_join(F.transform(gaps["out"], lambda g: F.concat(between(cut, g["a"], g["b"]), F.lit("[REDACTED]"))), "")
        return F.concat(kept, between(cut, gaps["at"], F.length(text)))

    clean = let(chunks(text), lambda cut: let(appended(F.col("_spans"), F.lit(0), "struct<a: int, b: int>", step), lambda gaps: clean_text(cut, gaps)))
    joined = keyed.join(spans, ["_id", "_text"], "left")
    joined = joined.withColumn("_row", F.col("_row").withField("text", F.when(F.col("_spans").isNull(), text).otherwise(clean)))
    return joined.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir), Ledger(spark, new_folder(spark, "ledger")))
