"""Operator 1: removal of repeated word passages with suffix automata of reference shards.

The reference is the corpus itself, cut into shards by anchor (``repeats``).  A shard's
segments are streamed through its automaton in corpus order.  The automaton is
extended on the way, and tells at each word how long the longest match is that
ends there and was seen before: the matching statistics.  Where that reaches
the threshold, the window that ends there also starts earlier.

An automaton of the whole reference cannot be broadcast, as it grows with the
corpus.  A shard and the segments to match meet in one task by their anchor
instead, and the automaton's size is bounded by the shard's (``Kind.hot``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import anchors, repeats
from .common import documents

#: Words of a window, and words of an anchor.
WINDOW, ANCHOR = 20, 5


class Automaton:
    """Suffix automaton of several sequences; state 0 is the empty one."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]

    def stream(self, sequence: list) -> list[int]:
        """Takes a sequence in; for each place the length of the longest match that ends there and began earlier."""
        nxt, link, length = self.next, self.link, self.length
        last, matches = 0, []
        for unit in sequence:
            q = nxt[last].get(unit)
            if q is not None:  # all of the sequence so far was seen before
                last = q if length[q] == length[last] + 1 else self._split(last, unit, q)
                matches.append(length[last])
                continue
            new = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and unit not in nxt[p]:
                nxt[p][unit] = new
                p = link[p]
            if p >= 0:
                q = nxt[p][unit]
                link[new] = q if length[q] == length[p] + 1 else self._split(p, unit, q)
            last = new
            matches.append(length[link[new]])
        return matches

    def _split(self, p: int, unit, q: int) -> int:
        """A state of its own for the shorter strings of q that end with p's strings and ``unit``."""
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = clone
        while p >= 0 and nxt[p].get(unit) == q:
            nxt[p][unit] = clone
            p = link[p]
        return clone


def matcher(pieces: list[bytes], group: np.ndarray, n: np.ndarray, length: int) -> list[np.ndarray]:
    out, automaton, current = [], Automaton(), None
    for piece, g in zip(pieces, group.tolist()):
        if g != current:
            automaton, current = Automaton(), g
        matches = np.array(automaton.stream(piece.split()), np.int64)
        out.append(np.flatnonzero(matches >= length) - (length - 1))
    return out


def plain(text: bytes) -> bytes:
    return b" ".join(text.split())


def kind(length: int = WINDOW, k: int = ANCHOR) -> repeats.Kind:
    return repeats.Kind(anchors.word_units, length, k, matcher, plain=plain)


def remove_repeats(docs: DataFrame, length: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Documents without the words covered by a window of ``length`` words that also starts earlier.

    Returns doc_id, n_words, n_removed, kept (words joined by one blank) and
    kept_sha256, a row per input row.  Windows are judged on the input.  Null and
    empty texts have no words; of repeated rows each has the same result; other
    columns of ``docs`` do not matter.
    """

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            total, removed, kept, digest = [], [], [], []
            for text, notes in zip(batch.column(1), batch.column(2)):
                parts = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                total.append(len(parts))
                if notes.is_valid:
                    gone = anchors.covered(len(parts), *repeats.ranges(notes.values, length))
                    parts = [w for w, x in zip(parts, gone.tolist()) if not x]
                removed.append(total[-1] - len(parts))
                whole = b" ".join(parts)
                kept.append(whole)
                digest.append(hashlib.sha256(whole).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digest, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    schema = "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string"
    return repeats.noted(docs, kind(length, k)).mapInArrow(batches, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir)).drop("kept")
