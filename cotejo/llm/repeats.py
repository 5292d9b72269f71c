"""Units of documents covered by windows that also start earlier, for words or for bytes.

A window is ``length`` consecutive units of one document.  A unit is covered if
a window over it has the same units as a window that starts earlier: in a
document with a smaller doc_id, or in the same one further left.

1. Each document gives its segments (see ``anchors``): two hashes and two
   places each, no text.
2. Anchors found once cannot repeat, unless the segment loops; one count by anchor drops them.
3. Segments that are equal as a whole are settled by the smallest place; all
   but that first one are covered.
4. Anchors with several different segments, or looping ones, are compared on their real texts:
   the first of each kind is cut from its document and sent to the task of its
   anchor, which runs the ``matcher`` over such groups (shards).  Of anchors with more
   than ``hot`` kinds, every window is settled for itself by the 128-bit
   digest of its units, so that no task gets a group that grows with the input.
5. What is covered returns to its document as ranges of units.

Very long texts are cut into chunks and segments; a task holds one text and one group of segments.
Rows without doc_id come before all others.  Rows that share a doc_id but differ
in text are ordered by a hash of the text; rows equal in both are one document
and have equal results.  Null texts are empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import anchors
from .common import NO_ID, written

#: What comes back to a document: segments that repeat, those that are the first of their kind,
#: ranges of windows found by a matcher, segments of hot anchors, and windows of these that are first.
SEGMENT, FIRST_SEGMENT, RANGE, HOT_SEGMENT, FIRST_WINDOW = range(5)


PIECE = pa.schema([("_id", pa.int64()), ("_text", pa.int64()), ("anchor", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("piece", pa.binary())])


@dataclass(frozen=True)
class Kind:
    """Units of a kind, the window length in units, the k of its anchors and the comparison within a shard.

    ``matcher`` gets segment texts, the number of each one's group, and its number of
    windows, in the order (group, place); it returns for each segment the windows
    (numbers from 0) that begin earlier, in a former segment of the group or in the same.
    ``plain`` gives a text's bytes with the same units, so laid out that windows of
    equal units are equal bytes; digests of windows are taken from that.
    """

    units: Callable[[np.ndarray, np.ndarray], anchors.Units]
    length: int
    k: int
    matcher: Callable[[list[bytes], np.ndarray, np.ndarray, int], list[np.ndarray]]
    hot: int = 1000
    plain: Callable[[bytes], bytes] = bytes


def _keys(docs: DataFrame) -> list[Column]:
    """Never null, so that both uses of the texts share one shuffle."""
    return [F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text")]


def _segments(docs: DataFrame, kind: Kind) -> DataFrame:
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, at = anchors.texts_of(batch.column(2))
            for t, u in anchors.pieces(at):
                owner, anchor, content, a, n, loops = anchors.segments(kind.units(data, at[t : u + 1]), kind.length, kind.k)
                offsets = pa.array(np.searchsorted(owner, np.arange(u - t + 1)).astype(np.int32))
                arrays = [batch.column(i).slice(t, u - t) for i in (0, 1)]
                arrays += [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (anchor.view(np.int64), content.view(np.int64), a.astype(np.int32), n.astype(np.int32), loops.astype(bool))]
                yield pa.RecordBatch.from_arrays(arrays, names=["_id", "_text", "anchor", "content", "at", "n", "loops"])

    schema = "_id long, _text long, anchor array<long>, content array<long>, at array<int>, n array<int>, loops array<boolean>"
    return docs.select(*_keys(docs), "text").mapInArrow(batches, schema)


def _cut(kind: Kind, single: bool) -> Callable:
    """Wanted segments of each document with their texts; ``single``: windows with a digest instead."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, at = anchors.texts_of(batch.column(1))
            key, text, wanted = batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4)
            rows: list[tuple] = []
            for i in range(batch.num_rows):
                whole = data[at[i] : at[i + 1]].tobytes()
                whole = kind.plain(whole) if single else whole
                u = kind.units(np.frombuffer(whole, np.uint8), np.array([0, len(whole)]))
                begin, end = u.begin, u.end
                picked = wanted[i].values
                for h, a, n in zip(*(picked.field(f).to_pylist() for f in ("anchor", "at", "n"))):
                    if single:
                        for p in range(a, a + n):
                            piece = whole[begin[p] : end[p + kind.length - 1]]
                            rows.append((key[i], text[i], h, p, 1, hashlib.md5(piece).digest()))
                    else:
                        rows.append((key[i], text[i], h, a, n, whole[begin[a] : end[a + n + kind.length - 2]]))
                if rows and (len(rows) >= 20_000 or i == batch.num_rows - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PIECE.types)], schema=PIECE)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), PIECE.types)], schema=PIECE)

    return batches


def _compared(kind: Kind, most: int = 1 << 19) -> Callable:
    """Runs the matcher over whole groups, of about ``most`` bytes of segments together."""

    def run(batch: pa.Table) -> pa.RecordBatch:
        place = np.stack([batch.column(c).to_numpy() for c in ("anchor", "_id", "_text", "at")])
        batch = batch.filter(pa.array(np.concatenate(([True], (place[:, 1:] != place[:, :-1]).any(0)))))  # repeated rows
        group = batch.column("anchor").to_numpy()
        covered = kind.matcher(batch.column("piece").to_pylist(), group, batch.column("n").to_numpy(), kind.length)
        rows, lo, n = [], [], []
        for i, x in enumerate(covered):
            if len(x):
                cuts = np.flatnonzero(np.diff(x) != 1) + 1
                for run in np.split(x, cuts):
                    rows.append(i)
                    lo.append(int(run[0]))
                    n.append(len(run))
        took = batch.select(["_id", "_text", "at"]).take(pa.array(rows, pa.int64())).combine_chunks()
        at = took.column("at").to_numpy() + np.array(lo, np.int32)
        return pa.RecordBatch.from_arrays(
            [took.column("_id").combine_chunks(), took.column("_text").combine_chunks(), pa.array(at.astype(np.int32)), pa.array(np.array(n, np.int32))],
            names=["_id", "_text", "at", "n"],
        )

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                held.append(part)
                size += part.nbytes
                if size < most:
                    continue
                table = pa.Table.from_batches(held)
                group = table.column("anchor").to_numpy()
                upto = int(np.searchsorted(group, group[-1]))
                if upto:  # the last group may go on
                    yield run(table.slice(0, upto))
                held = table.slice(upto).to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield run(pa.Table.from_batches(held))

    return batches


def ranges(notes: pa.StructArray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past the last unit of each covered range of one document."""
    kind, at, n = (notes.field(f).to_numpy(zero_copy_only=False) for f in ("kind", "at", "n"))
    lo, hi = [at[kind == RANGE]], [(at + n + length - 1)[kind == RANGE]]
    later = (kind == SEGMENT) & ~np.isin(at, at[kind == FIRST_SEGMENT])
    lo.append(at[later])
    hi.append((at + n + length - 1)[later])
    hot = np.flatnonzero(kind == HOT_SEGMENT)
    if len(hot):
        single = np.concatenate([np.arange(at[i], at[i] + n[i]) for i in hot])
        single = single[~np.isin(single, at[kind == FIRST_WINDOW])]
        lo.append(single)
        hi.append(single + length)
    return np.concatenate(lo), np.concatenate(hi)


def noted(docs: DataFrame, kind: Kind) -> DataFrame:
    """(doc_id, text, notes) for every row of ``docs``; notes is null where nothing repeats, see ``ranges``."""
    docs = docs.select("doc_id", "text")
    every = written(_segments(docs, kind), "segments")
    every = every.select("_id", "_text", F.inline(F.arrays_zip("anchor", "content", "at", "n", "loops")))
    again = every.groupBy("anchor").agg(F.count("*").alias("_times"), F.max("loops").alias("_loops")).filter("_times > 1 or _loops").select("anchor")
    repeated = written(every.join(again, "anchor"), "repeated")

    place = F.struct("_id", "_text", "at")
    kinds = repeated.groupBy("anchor", "content").agg(F.min(place).alias("first"), F.max("n").alias("n"), F.max("loops").alias("loops"))
    kinds = written(kinds.select("anchor", "first.*", "n", "loops"), "kinds")
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("_kinds"), F.max("loops").alias("_loops")).filter("_kinds > 1 or _loops").drop("_loops")
    wanted = kinds.join(mixed, "anchor")
    texts = docs.select("doc_id", "text", *_keys(docs))

    def cut(which: DataFrame, single: bool) -> DataFrame:
        lists = which.groupBy("_id", "_text").agg(F.collect_list(F.struct("anchor", "at", "n")).alias("wanted"))
        # All columns of the texts go in, so that the shuffle of the texts is the one below.
        found = texts.join(lists, ["_id", "_text"]).groupBy("_id", "_text").agg(*[F.first(c).alias(c) for c in ("doc_id", "text", "wanted")])
        found = found.select("doc_id", "text", "_id", "_text", "wanted")  # one of repeated rows
        return found.mapInArrow(_cut(kind, single), "_id long, _text long, anchor long, at int, n int, piece binary")

    few, hot = wanted.filter(F.col("_kinds") <= kind.hot), wanted.filter(F.col("_kinds") > kind.hot)
    shards = cut(few, False).repartition("anchor").sortWithinPartitions("anchor", "_id", "_text", "at")
    compared = shards.mapInArrow(_compared(kind), "_id long, _text long, at int, n int")
    single = cut(hot, True).groupBy("piece").agg(F.min(place).alias("first")).select("first.*", F.lit(1).alias("n"))

    def note(df: DataFrame, what: int) -> DataFrame:
        return df.select("_id", "_text", F.lit(what).cast("tinyint").alias("kind"), "at", "n")

    notes = (
        note(repeated, SEGMENT)
        .unionAll(note(kinds, FIRST_SEGMENT))
        .unionAll(note(compared, RANGE))
        .unionAll(note(hot, HOT_SEGMENT))
        .unionAll(note(single, FIRST_WINDOW))
        .groupBy("_id", "_text")
        .agg(F.collect_set(F.struct("kind", "at", "n")).alias("notes"))  # those of repeated rows are equal
    )
    return texts.join(notes, ["_id", "_text"], "left").select("doc_id", "text", "notes")
