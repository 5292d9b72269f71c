"""Operator 5: removal of repeated byte strings with longest-previous-factor arrays.

Segments that may repeat meet by anchor (``repeats``).  Their texts, in corpus order,
get a suffix order by prefix doubling.  In that order the nearest smaller
position on either side is the closest earlier text of a suffix, so the longest
earlier match of a position is with one of the two; where it reaches the
threshold, the string that begins there also starts earlier.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import anchors, repeats
from .common import documents

#: Bytes of a string, and bytes of an anchor.
LENGTH, ANCHOR = 100, 24


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys and each one's rank; equal keys share a rank and keep their order."""
    order = np.argsort(key, kind="stable")
    x = key[order]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(x[1:] != x[:-1])))
    return order, rank


def suffix_order(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ordered by their next ``length`` symbols (fewer at the end), and ranks of those strings.

    Symbols are 0 to 256.  Equal strings are in ascending order of position.
    """
    n = len(data)
    padded = np.concatenate((data.astype(np.int64) + 1, np.zeros(8, np.int64)))
    size = min(7, length)
    key = np.zeros(n, np.int64)
    for j in range(size):
        key = key * 258 + padded[j : j + n]
    order, rank = _ranked(key)
    while size < length:
        step = min(size, length - size)  # overlapping parts cover the length as well
        after = np.zeros(n, np.int64)
        after[: max(n - step, 0)] = rank[step:] + 1
        order, rank = _ranked(rank * (n + 1) + after)
        size += step
    return order, rank


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, -1 if there is none."""
    near = np.arange(-1, len(x) - 1)
    open_ = np.flatnonzero(near >= 0)
    while len(open_):
        at = near[open_]
        open_ = open_[x[at] > x[open_]]
        near[open_] = near[near[open_]]
        open_ = open_[near[open_] >= 0]
    return near


def reaches(data: np.ndarray, length: int) -> np.ndarray:
    """Positions whose longest previous factor has ``length`` symbols or more."""
    order, rank = suffix_order(data, length)
    before = nearest_smaller(order)
    after = len(order) - 1 - nearest_smaller(order[::-1])[::-1]  # len(order) if there is none
    out = np.zeros(len(data), bool)
    for near in (before, after):
        there = (near >= 0) & (near < len(order))
        mine = order[there]
        out[mine] |= rank[mine] == rank[order[near[there]]]
    return out


def matcher(pieces: list[bytes], group: np.ndarray, n: np.ndarray, length: int) -> list[np.ndarray]:
    begin = np.cumsum([0] + [len(p) + 1 for p in pieces])
    data = np.full(begin[-1], 256, np.int16)  # 256 ends a segment, so no string of bytes reaches over an end
    for b, p in zip(begin.tolist(), pieces):
        data[b : b + len(p)] = np.frombuffer(p, np.uint8)
    long = reaches(data, length)
    # Equal strings of bytes are of one group, as they have one anchor.
    return [np.flatnonzero(long[b : b + m]) for b, m in zip(begin[:-1].tolist(), n.tolist())]


def kind(length: int = LENGTH, k: int = ANCHOR) -> repeats.Kind:
    return repeats.Kind(anchors.byte_units, length, k, matcher)


def remove_repeats(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR) -> DataFrame:
    """Documents, as UTF-8 bytes, without those covered by a ``length``-byte string that also starts earlier.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), spans,
    kept (binary) and kept_sha256, a row per input row.  Strings are judged on
    the input.  Null texts are empty; of repeated rows each has the same result;
    other columns of ``docs`` do not matter.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            rows: list[tuple] = []
            for text, notes in zip(batch.column(1), batch.column(2)):
                whole = text.as_buffer().to_pybytes() if text.is_valid else b""
                size, spans = len(whole), []
                if notes.is_valid:
                    gone = np.concatenate(([False], anchors.covered(size, *repeats.ranges(notes.values, length)), [False]))
                    spans = np.flatnonzero(gone[1:] != gone[:-1]).reshape(-1, 2).tolist()
                    whole = np.frombuffer(whole, np.uint8)[~gone[1:-1]].tobytes()
                rows.append((size, size - len(whole), len(spans), [{"start": a, "end": b} for a, b in spans], whole, hashlib.sha256(whole).hexdigest()))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), span, pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, kind) for x, kind in zip(zip(*rows), kinds))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"],
            )

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept binary, kept_sha256 string"
    return repeats.noted(docs, kind(length, k)).mapInArrow(batches, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept", "spans")
