"""Operator 13: hard negatives for embeddings, by a secondary-sort shuffle.

Every row is scored against every anchor, in blocks: rows are dealt to blocks of bounded size by a hash, each
anchor goes to every block, and a task keeps one block and streams the anchors past it.

1. Positives: each block gives its best rows of an anchor's label, a window over these the anchor's best.
2. Negatives: an anchor's positives open windows of scores, from half of a positive's score to 95 % of it.  The
   first negatives of a window over all rows are among the first of it in their block, so a block gives these alone.
3. What is left is packed into keys (anchor, descending score, id), big-endian with the sign turned, so that bytes
   sort like numbers, and goes through ``repartitionAndSortWithinPartitions``, dealt by anchor.  An iterator passes
   over the sorted keys: a positive opens its window, a negative is given to every open window that it lies in, a
   window closes when it is full or when scores have fallen below it.  It holds the open windows of one anchor.

Scores are exact integers, also where floats are multiplied: the float type follows from the largest component, and
whole Python numbers are used beyond; results are held at the ends of 64 bits.

Rows with a null id, label or vector, or a null or non-finite component, take no part.  Rows are named by their id: of
rows that share one, the smallest by (label, vector) is taken, so repeated rows count once.  Ties in score go by id.
Vectors of different length are not compared; of empty ones all scores are 0.  An empty table, or one without
anchors, positives or negatives, gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

#: Components of the vectors of a block; blocks are smaller where there would be fewer than LEAST of them.
BLOCK, LEAST, LEAST_ROWS = 1 << 22, 16, 2048
#: Scores of a block that are made at once.
SCORES = 1 << 21
_ENDS = 1 - 2**63, 2**63 - 1
OUT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass(frozen=True)
class Mining:
    """Every ``every``-th id is an anchor; how many positives and negatives for each; the window of scores in percent."""

    every: int = 50
    positives: int = 5
    negatives: int = 3
    low: int = 50
    high: int = 95

    def window(self, score: int) -> tuple[int, int]:
        """Smallest and largest score of a negative: low * score <= 100 * negative <= high * score."""
        return -(-self.low * score // 100), self.high * score // 100


def prepared(embeddings: DataFrame) -> DataFrame:
    """(id, label, vector): the rows that take part, labels moved on where 7 divides the id, components as whole doubles."""
    own = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (own + 1) % 10).otherwise(own)
    odd = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = embeddings.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~odd)
    one = whole.groupBy(F.col("vec_id").cast("long").alias("id")).agg(F.min(F.struct(label.alias("label"), F.col("embedding").alias("vector"))).alias("r"))
    return one.select("id", "r.label", F.col("r.vector").cast("array<double>").alias("vector"))


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each vector length: which rows have it, and their vectors times 256, rounded down."""
    length = np.diff(column.offsets.to_numpy())
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False) * 256.0)
    ends = np.cumsum(length)
    out = []
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        out.append((rows, flat[(ends[rows] - n)[:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers, rows of ``a`` by rows of ``b``."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(a.shape[1], 1)
    for kind, exact in ((np.float32, 2**24), (np.float64, 2**53)):
        if most < exact:
            return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    whole = [[[int(v) for v in row] for row in m] for m in (a, b)]
    score = [[min(max(sum(x * y for x, y in zip(r, s)), _ENDS[0]), _ENDS[1]) for s in whole[1]] for r in whole[0]]
    return np.array(score, np.int64).reshape(len(a), len(b))


def _first(ids: np.ndarray, score: np.ndarray, n: int) -> np.ndarray:
    """The n first places by descending score, then by place; places are in the order of ids."""
    if len(score) > 8 * n:
        least = np.partition(score, len(score) - n)[len(score) - n]
        surely = np.flatnonzero(score > least)
        return np.concatenate((surely[np.argsort(-score[surely], kind="stable")], np.flatnonzero(score == least)[: n - len(surely)]))
    return np.argsort(-score, kind="stable")[:n]


def _scored(cells: DataFrame, mining: Mining) -> DataFrame:
    """(anchor, id, score) of each block's candidates: positives of anchors that have none yet, negatives in the windows of the others.

    ``cells`` has (block, anchor, id, label, vector, positives), the rows of a block first and then anchors.
    """

    def candidates(ids, label, score, anchor, own, known):
        if known is None:
            same = np.flatnonzero((label == own) & (ids != anchor))
            return same[_first(ids[same], score[same], mining.positives)]
        windows = [mining.window(p) for p in set(known)]
        low, high = min(w[0] for w in windows), max(w[1] for w in windows)
        other = np.flatnonzero((label != own) & (score >= low) & (score <= high))
        picked = []
        for lo, hi in windows:
            inside = other[(score[other] >= lo) & (score[other] <= hi)]
            picked.append(inside[_first(ids[inside], score[inside], mining.negatives)])
        return np.unique(np.concatenate(picked))

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, rows = None, [], None
        for batch in it:
            number, is_anchor = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            cut = np.flatnonzero((np.diff(number) != 0) | (np.diff(is_anchor) != 0)) + 1
            for lo, hi in zip([0, *cut], [*cut, len(number)]):
                part = batch.slice(lo, hi - lo)
                if hi == lo:
                    continue
                if number[lo] != block:
                    block, held, rows = number[lo], [], None
                if not is_anchor[lo]:
                    held.append(part)
                    continue
                if rows is None:
                    ids_held, labels_held = (np.concatenate([p.column(c).to_numpy() for p in held] or [np.zeros(0, np.int64)]) for c in (2, 3))
                    vectors = _matrix(pa.concat_arrays([p.column(4) for p in held])) if held else []
                    rows, held = {m.shape[1]: (ids_held[at], labels_held[at], m) for at, m in vectors}, []
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                anchor_ids, own, known = part.column(2).to_numpy(), part.column(3).to_numpy(), part.column(5).to_pylist()
                for at, m in _matrix(part.column(4)):
                    if m.shape[1] not in rows:
                        continue
                    ids, label, matrix = rows[m.shape[1]]
                    step = max(1, SCORES // len(ids))
                    for a in range(0, len(at), step):
                        score = products(m[a : a + step], matrix)
                        for i, k in enumerate(at[a : a + step]):
                            found = candidates(ids, label, score[i], anchor_ids[k], own[k], known[k])
                            out.append((np.full(len(found), anchor_ids[k]), ids[found], score[i][found]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], names=["anchor", "id", "score"])

    return cells.mapInArrow(batches, "anchor long, id long, score long")


def _cells(rows: DataFrame, anchors: DataFrame, blocks: int) -> DataFrame:
    """Rows dealt to blocks, and every anchor in each block behind them, in the order of ids."""
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.select(block.alias("block"), F.lit(False).alias("anchor"), "id", "label", "vector", F.lit(None).cast("array<long>").alias("positives"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    sent = anchors.select(every.alias("block"), F.lit(True).alias("anchor"), "id", "label", "vector", "positives")
    return dealt.unionAll(sent).repartition(blocks, "block").sortWithinPartitions("block", "anchor", "id")


def packed(anchor: int, score: int, number: int) -> bytes:
    """A key whose bytes sort by anchor, descending score and id."""
    return struct.pack(">QQQ", anchor + 2**63, 2**63 - 1 - score, number + 2**63)


def unpacked(key: bytes) -> tuple[int, int, int]:
    anchor, score, number = struct.unpack(">QQQ", key)
    return anchor - 2**63, 2**63 - 1 - score, number - 2**63


def mined(keys: Iterator[tuple[bytes, bool]], mining: Mining) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Hard negatives from sorted (key, is a positive) of whole anchors.

    A positive comes before every negative of its window, as its score is above the window (or equal to it: 0).
    """
    last, waiting, windows = None, [], []
    for key, positive in keys:
        anchor, score, number = unpacked(key)
        if anchor != last:
            last, waiting, windows = anchor, [], []
        if positive:
            low, high = mining.window(score)
            windows.append([low, high, number, score, 0])
            for n, s in waiting:  # negatives with the score of this positive and a smaller id
                if s == score and low <= s <= high and windows[-1][4] < mining.negatives:
                    windows[-1][4] += 1
                    yield anchor, number, windows[-1][4], n, score, s
            continue
        if waiting and waiting[0][1] != score:
            waiting = []
        if len(waiting) < mining.negatives:
            waiting.append((number, score))
        windows = [w for w in windows if w[0] <= score and w[4] < mining.negatives]
        for w in windows:
            if score <= w[1]:
                w[4] += 1
                yield anchor, w[2], w[4], number, w[3], score


def hard_negatives(embeddings: DataFrame, mining: Mining = Mining(), block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``embeddings`` (vec_id, embedding, label)."""
    spark = embeddings.sparkSession
    rows = written(prepared(embeddings), "vectors")
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
    full = max(1, block // max(size["dim"] or 1, 1))
    blocks = max(1, -(-size["n"] // full), min(LEAST, -(-size["n"] // LEAST_ROWS)))
    anchors = rows.filter(F.col("id") % mining.every == 0)

    best = _scored(_cells(rows, anchors.withColumn("positives", F.lit(None).cast("array<long>")), blocks), mining)
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    best = written(best.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= mining.positives).drop("_rank"), "positives")

    known = best.groupBy(F.col("anchor").alias("id")).agg(F.collect_list("score").alias("positives"))
    negative = _scored(_cells(rows, anchors.join(known, "id"), blocks), mining)
    told = best.withColumn("positive", F.lit(True)).unionAll(negative.withColumn("positive", F.lit(False)))

    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = told.rdd.map(lambda r: (packed(r["anchor"], r["score"], r["id"]), r["positive"]))
    dealt = keys.repartitionAndSortWithinPartitions(parts, lambda key: zlib.crc32(key[:8]))
    return spark.createDataFrame(dealt.mapPartitions(lambda it: mined(it, mining)), OUT)


SQL = """
WITH given AS (
  SELECT vec_id AS id, CAST(label AS BIGINT) AS own, embedding FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), moved AS (
  SELECT DISTINCT id, CASE WHEN id % 7 = 0 THEN (own + 1) % 10 ELSE own END AS label,
    list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM given
), scored AS (
  SELECT a.id AS anchor, r.id, a.label = r.label AS same, CAST(list_dot_product(a.v, r.v) AS BIGINT) AS score
  FROM moved a JOIN moved r ON a.id <> r.id AND len(a.v) = len(r.v)
  WHERE a.id % 50 = 0
), positives AS (
  SELECT anchor, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
), met AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id, n.id AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM met WHERE rank <= 3
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
