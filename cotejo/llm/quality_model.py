"""Operator 10: a quality classifier learned from positives and unlabelled text.

Trusted positives are documents labelled 1, unlabelled are documents of any kind, labels
unseen.  A small network minimises the non-negative unbiased risk

    prior * E_positive[l(g)] + max(0, E_unlabelled[l(-g)] - prior * E_positive[l(-g)])

with the sigmoid loss l.  The prior is the share of 1 among the labels.  Both
samples are chosen by a hash of doc_id and bounded (``POSITIVES``,
``UNLABELLED``); rows equal in doc_id and features are learned from once, and rows without
doc_id are not learned from, so repeated rows do not pass the bound.  Only features reach
the driver, and the model that goes back has a few ten thousand numbers.  Every row
is scored.

Features are of the text alone: how often each byte occurs, and shares of
letters, digits, signs, repeated words, repeated word triples and repeated lines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import documents

#: About so many documents are learned from, fewer if there are fewer.
POSITIVES, UNLABELLED = 6000, 12000
HELD_OUT, CUT = 2, 0.7
HIDDEN, STEPS, RATE, SEED = 24, 400, 0.01, 11
N_FEATURES = 268


def features(text: bytes) -> np.ndarray:
    """Features of one text; all zero for an empty one."""
    out = np.zeros(N_FEATURES, np.float32)
    n = len(text)
    if not n:
        return out
    data = np.frombuffer(text, np.uint8)
    count = np.bincount(data, minlength=256)
    out[:256] = np.sqrt(count / n)
    units = anchors.word_units(data, np.array([0, n]))
    words = len(units.hashes)
    letters = count[65:91].sum() + count[97:123].sum() + count[128:].sum()
    signs = count[33:48].sum() + count[58:65].sum() + count[91:97].sum() + count[123:127].sum()
    out[256] = letters / n
    out[257] = count[65:91].sum() / max(letters, 1)
    out[258] = count[48:58].sum() / n
    out[259] = signs / n
    out[260] = np.log1p(words) / 10
    if words:
        width = units.end - units.begin
        out[261] = min(width.mean() / 10, 5)
        out[262] = min(width.std() / 10, 5)
        out[263] = 1 - len(np.unique(units.hashes)) / words
        if words >= 3:
            triples = units.hashes[:-2] * np.uint64(3) + units.hashes[1:-1] * np.uint64(5) + units.hashes[2:] * np.uint64(7)
            out[264] = 1 - len(np.unique(triples)) / len(triples)
        out[265] = (width == 1).mean()
    lines = [x for x in text.split(b"\n") if x.strip()]
    out[266] = 1 - len(set(lines)) / max(len(lines), 1)
    out[267] = np.log1p(words / max(len(lines), 1)) / 5
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """One hidden layer over standardised features; gradients of the risk by hand, steps by Adam."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.weights = [(rng.normal(size=(len(mean), hidden)) / np.sqrt(len(mean))).astype(np.float32), np.zeros(hidden, np.float32), (rng.normal(size=hidden) / np.sqrt(hidden)).astype(np.float32), np.zeros(1, np.float32)]

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def output(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(x @ self.weights[0] + self.weights[1])
        return h, h @ self.weights[2] + self.weights[3][0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(2 * self.output(self.standard(x))[1].astype(np.float64))

    def risk(self, x: np.ndarray, p: int, prior: float) -> tuple[float, float]:
        """Non-negative unbiased risk of standardised rows, the first ``p`` positive and the others unlabelled: the
        part of the positives, and that of the negatives, which counts as 0 below 0.  The loss of a margin is sigmoid(-margin)."""
        s = sigmoid(self.output(x)[1])
        return float(prior * (1 - s[:p]).mean()), float(s[p:].mean() - prior * s[:p].mean())

    def gradients(self, x: np.ndarray, p: int, prior: float) -> list[np.ndarray]:
        """Of the risk by all weights, if its negative part is not below 0; else of minus that part, a step back from it."""
        h, g = self.output(x)
        s = sigmoid(g)
        slope, n = s * (1 - s), len(x) - p
        d = np.empty_like(g)
        if s[p:].mean() - prior * s[:p].mean() >= 0:
            d[:p] = -2 * prior * slope[:p] / p
            d[p:] = slope[p:] / n
        else:
            d[:p] = prior * slope[:p] / p
            d[p:] = -slope[p:] / n
        kind = x.dtype
        back = np.outer(d, self.weights[2]).astype(kind) * (1 - h * h)
        return [x.T @ back, back.sum(0), h.T @ d.astype(kind), np.array([d.sum()], kind)]

    def fit(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = 1e-4) -> Network:
        x = self.standard(np.concatenate((positive, unlabelled))).astype(np.float32)
        moments = [(np.zeros_like(w), np.zeros_like(w)) for w in self.weights]
        for step in range(1, steps + 1):
            for i, (w, grad) in enumerate(zip(self.weights, self.gradients(x, len(positive), prior))):
                grad = grad + decay * w
                m, v = moments[i]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def remainder() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4


def _drawn(rows: int, bound: int) -> Column:
    """About ``bound`` of so many rows, by a hash of doc_id that is the same in every run."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("drawn")), F.lit(1 << 20)) < max(1, min(1 << 20, (bound << 20) // max(rows, 1)))


def _features(docs: DataFrame) -> np.ndarray:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows = [features(t.as_buffer().to_pybytes() if t.is_valid else b"").tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "f"])

    one = docs.groupBy("doc_id").agg(F.min("text").alias("text"))  # an id that has many texts gives one of them
    rows = one.mapInArrow(batches, "doc_id long, f binary")
    rows = rows.toArrow().column("f").to_pylist()
    return np.frombuffer(b"".join(sorted(rows)), np.float32).reshape(-1, N_FEATURES)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Network | None:
    """A model from labels whose crc32 remainder is not HELD_OUT; None without a positive or an unlabelled document.

    Rows of ``labels`` without doc_id or quality are passed over; of several labels
    of a document the largest counts.
    """
    learn = docs.filter(F.col("doc_id").isNotNull() & (remainder() != HELD_OUT))
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder() != HELD_OUT))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n, good = known.agg(F.count("*"), F.coalesce(F.sum((F.col("quality") == 1).cast("long")), F.lit(0))).first()
    if not good:
        return None
    drawn = known.filter((F.col("quality") == 1) & _drawn(good, positives)).select("doc_id").toArrow()
    # About ``positives`` rows by the filter above, so the join needs no shuffle of the texts.
    ids = docs.sparkSession.createDataFrame(pd.DataFrame({"doc_id": sorted(drawn.column(0).to_pylist())}, dtype="int64"), "doc_id long")
    p = _features(learn.join(F.broadcast(ids), "doc_id", "left_semi"))
    u = _features(learn.filter(_drawn(docs.select("doc_id").count(), unlabelled)))
    if not len(p) or not len(u):
        return None
    both = np.concatenate((p, u)).astype(np.float64)
    model = Network(both.mean(0).astype(np.float32), (both.std(0) + 1e-3).astype(np.float32))
    return model.fit(p, u, good / n)


def score(model: Network | None) -> Column:
    """Score of the column ``text``; without a model there is no evidence against a text, so 1."""
    if model is None:
        return F.lit(1.0)

    def scored(texts: pd.Series) -> pd.Series:
        x = np.stack([features((t or "").encode()) for t in texts]) if len(texts) else np.zeros((0, N_FEATURES), np.float32)
        return pd.Series(model.score(x), dtype="float64")

    scored.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(scored, "double")(F.col("text"))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from a score of 0.7 on), a row per input row.

    Null and empty texts are scored like others.  A row without doc_id is not held out.
    """
    model = train(docs, labels)
    rows = docs.select("doc_id", (remainder() == HELD_OUT).alias("held_out"), score(model).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that the classifier rejects; all columns stay."""
    return docs.filter(score(train(docs, labels)) >= CUT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
