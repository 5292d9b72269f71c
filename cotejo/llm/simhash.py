"""Operator 7: near-duplicates by SimHash with bit-sliced comparison.

Fingerprints of 64 bits are cut into ``BLOCKS`` blocks.  Two that differ in at most
``RADIUS`` bits agree in all but RADIUS blocks, so for one choice of the others
they share a bucket.  Only different fingerprints are compared, by buckets.  A task stores its
buckets vertically, once: 64 bit planes, 64 fingerprints to a word.  All pairs of some distance in
their order are compared at once, each plane with itself moved on by that distance;
carry-save adders count the differences, and words in which every pair is
beyond the radius are given up.  Pairs that are linked already are not compared
again and a bucket gives at most one link less than it has members, so even
a bucket of thousands of near copies sends few links on.

A bucket of more than ``HOT`` fingerprints is cut by the bits that its members need not
share, in the same way: two of them that are near agree in all but RADIUS blocks of
those bits as well.  After ``LEVELS`` cuts 15 bits are left, which bounds a bucket at
2 ** 15 fingerprints, whatever the input; no link is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, documents, written
from .components import components

RADIUS, BLOCKS, SHINGLE, SEED = 3, 5, 3, 42
#: Fingerprints of a bucket that is compared without a further cut, and cuts at most.
HOT, LEVELS = 4096, 3
ALL_BITS = 2**64 - 1


def fingerprint(text: bytes | None, n: int = SHINGLE) -> int:
    """SimHash over shingles of n words, repeats included; A-Z count as a-z."""
    parts = (text or b"").lower().split()  # of bytes: ASCII letters, ASCII blanks
    if not parts:
        return 0
    joined, hashed = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts])
    begin = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    n = min(n, len(parts))
    total, set_ = len(parts) - n + 1, np.zeros(64, np.int64)
    for lo in range(0, total, 1 << 14):
        hs = [hashed(joined[a:b], SEED) for a, b in zip(begin[lo : lo + (1 << 14)], ends[lo + n - 1 : lo + n - 1 + (1 << 14)])]
        set_ += np.unpackbits(np.array(hs, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_ > total, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(_id, _text, fp): key of each row and its fingerprint as a signed long."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            fps = [fingerprint(t.as_buffer() and t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["_id", "_text", "fp"])

    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text"), "text")
    return keyed.mapInArrow(batches, "_id long, _text long, fp long")


def masks(radius: int = RADIUS, blocks: int = BLOCKS, within: int = ALL_BITS) -> list[int]:
    """The bits of each choice of blocks - radius of the blocks that the bits ``within`` are cut into."""
    places = [i for i in range(64) if within >> i & 1]
    edge = [len(places) * i // blocks for i in range(blocks + 1)]
    part = [sum(1 << i for i in places[a:b]) for a, b in zip(edge, edge[1:])]
    return [sum(x) for x in combinations(part, blocks - radius)]


_FULL = np.uint64(ALL_BITS)


def vertical(fps: np.ndarray) -> np.ndarray:
    """Bit planes of many fingerprints, 64 of them to a word: row b holds bit b of all.  Two empty words follow."""
    n = len(fps)
    bits = np.zeros(((n + 63) // 64 * 64 + 128, 64), np.uint8)
    bits[:n] = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def _add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three planes: the sums and the carries of all their bits."""
    u = a ^ b
    return u ^ c, a & b | u & c


def within(differences: Callable[[int, np.ndarray], np.ndarray], asked: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the ``asked`` bits of some words stand for pairs with at most ``radius`` differing bits.

    ``differences`` gives eight bit planes of differences from a plane on, for words by number.  Four planes go through
    three carry-save adders into the ones and twos of a vertical counter, which starts so that it overflows when
    the radius is passed.  After each eight planes words in which all that is asked is beyond it are given up.
    """
    size = max(radius.bit_length(), 2)
    start = (1 << size) - 1 - radius
    counter = [np.full(len(asked), _FULL if start >> i & 1 else 0, np.uint64) for i in range(size)]
    far, open_, out = np.zeros(len(asked), np.uint64), np.arange(len(asked)), np.zeros(len(asked), np.uint64)
    for p in range(0, 64, 8):
        x = differences(p, open_)
        for i in (0, 4):
            counter[0], low = _add(counter[0], x[i], x[i + 1])
            counter[0], high = _add(counter[0], x[i + 2], x[i + 3])
            counter[1], carry = _add(counter[1], low, high)
            for j in range(2, size):
                counter[j], carry = counter[j] ^ carry, counter[j] & carry
            far |= carry
        keep = asked[open_] & ~far != 0
        if not keep.all():
            open_, far, counter = open_[keep], far[keep], [c[keep] for c in counter]
            if not len(open_):
                return out
    out[open_] = asked[open_] & ~far
    return out


def near(difference: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of many 64-bit differences have at most ``radius`` bits set."""
    n, planes = len(difference), vertical(difference)
    hit = within(lambda p, words: planes[p : p + 8, words], np.full((n + 63) // 64, _FULL, np.uint64), radius)
    return np.unpackbits(hit.view(np.uint8), bitorder="little")[:n] == 1


def near_ahead(planes: np.ndarray, words: np.ndarray, asked: np.ndarray, shift: int, radius: int = RADIUS) -> np.ndarray:
    """Which of the ``asked`` fingerprints of some words are near the one ``shift`` places on: each plane against itself moved on."""
    q, r = divmod(shift, 64)

    def differences(p: int, open_: np.ndarray) -> np.ndarray:
        here, part = words[open_], planes[p : p + 8]
        on = part[:, here + q]
        if r:
            on = on >> np.uint64(r) | part[:, here + q + 1] << np.uint64(64 - r)
        return part[:, here] ^ on

    return within(differences, asked, radius)


def links(group: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is near within each group of consecutive rows, as row numbers."""
    n = len(fps)
    label, planes = np.arange(n), vertical(fps)
    a: list[int] = []
    b: list[int] = []

    def root(i: int) -> int:
        while label[i] != i:
            label[i] = label[label[i]]
            i = label[i]
        return i

    edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    stop = np.repeat(edge[1:], np.diff(edge))  # where each row's group ends
    rows, shift = np.arange(n), 1
    while True:
        rows = rows[rows + shift < stop[rows]]
        if not len(rows):
            return np.array(a, np.int64), np.array(b, np.int64)
        left = rows[label[rows] != label[rows + shift]]
        if len(left):
            word, bit = left >> 6, np.uint64(1) << (left & 63).astype(np.uint64)
            first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            hit = near_ahead(planes, word[first], np.bitwise_or.reduceat(bit, first), shift, radius)
            found = left[np.repeat(hit, np.diff(np.append(first, len(left)))) & bit != 0]
            for i in found.tolist():
                p, q = root(i), root(i + shift)
                if p != q:
                    label[max(p, q)] = min(p, q)
                    a.append(i)
                    b.append(i + shift)
            if len(found):
                while (label != label[label]).any():
                    label = label[label]
        shift += 1


def _linked(radius: int, most: int = 1 << 16):
    def run(table: pa.Table) -> pa.RecordBatch:
        key = table.column("bucket").to_numpy()
        which = table.column("choice").to_numpy()
        fps = table.column("fp").to_numpy().view(np.uint64)
        group = np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (which[1:] != which[:-1]))))
        a, b = links(group, fps, radius)
        return pa.RecordBatch.from_arrays([pa.array(fps[a].view(np.int64)), pa.array(fps[b].view(np.int64))], names=["a", "b"])

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in it:
            held.append(batch)
            size += batch.num_rows
            if size < most:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            last = table.slice(size - 1)
            same = (table.column("bucket").to_numpy() == last.column("bucket")[0].as_py()) & (table.column("choice").to_numpy() == last.column("choice")[0].as_py())
            upto = int(np.argmax(same))
            if upto:  # the last bucket may go on
                yield run(table.slice(0, upto))
            held = table.slice(upto).to_batches()
            size -= upto
        if held:
            yield run(pa.Table.from_batches(held).combine_chunks())

    return batches


def _buckets(fps: DataFrame, radius: int, blocks: int, hot: int) -> DataFrame:
    """(choice, bucket, fp): buckets in which all near ones of the different ``fp`` meet.

    A choice stands for the bits that a bucket's members share; there are at most
    10 + 100 + 1000 by the defaults, so the table of them is small whatever the input.
    """
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    spark, agreed, out = fps.sparkSession, masks(radius, blocks), []
    choices = F.array(*(F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("bucket")) for i, m in enumerate(agreed)))
    rows, first = fps.select("fp", F.inline(choices)), 0
    for _ in range(LEVELS - 1):
        large = written(rows.groupBy("choice", "bucket").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select("choice", "bucket"), "large")
        if large.isEmpty():
            break
        out.append(rows.join(large, ["choice", "bucket"], "left_anti"))
        finer = [(first + i, m | more) for i, m in enumerate(agreed) for more in masks(radius, blocks, ALL_BITS & ~m)]
        first, agreed = first + len(agreed), [m for _, m in finer]
        table = spark.createDataFrame([(old, first + i, signed(m)) for i, (old, m) in enumerate(finer)], "choice int, finer int, mask long")
        rows = rows.join(large, ["choice", "bucket"], "left_semi").join(F.broadcast(table), "choice")
        rows = rows.select("fp", F.col("finer").alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("bucket"))
    for df in out:
        rows = rows.unionByName(df)
    return rows.select("choice", "bucket", "fp")


def linked(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, hot: int = HOT) -> DataFrame:
    """(a, b): links over which each of the different ``fp`` reaches all that it reaches by ``radius`` differing bits."""
    buckets = _buckets(fps, radius, blocks, hot).repartition("choice", "bucket").sortWithinPartitions("choice", "bucket", "fp")
    return buckets.mapInArrow(_linked(radius), "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(_id, _text, fp, group_id, group_text) for every row.

    group_id and group_text are the smallest key (doc_id, hash of the text)
    that the row's fingerprint reaches over links of ``radius`` differing bits.
    """
    rows = written(fingerprints(docs), "fingerprints")
    first = written(rows.groupBy("fp").agg(F.min(F.struct("_id", "_text")).alias("_first")), "different")
    labels = components(linked(first.select("fp"), radius, blocks))
    labels = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    labels = written(labels, "labels")
    least = labels.groupBy("label").agg(F.min("_first").alias("_first"))
    groups = labels.select("fp", "label").join(least, "label").select("fp", F.col("_first._id").alias("group_id"), F.col("_first._text").alias("group_text"))
    return rows.join(groups, "fp").select("_id", "_text", "fp", "group_id", "group_text")


def component_ids(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, a row per input row.

    Null and empty texts have fingerprint zero and are linked like others.  A
    missing doc_id counts as the smallest, so the component of such a row has a
    null id.  Repeated rows have equal results.
    """

    def given(c: str):
        return F.when(F.col(c) != NO_ID, F.col(c))

    found = near_groups(docs, radius, blocks)
    return found.select(given("_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), given("group_id").alias("component_id"))


def one_of_each(docs: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, that with the smallest doc_id; all columns stay."""
    found = near_groups(docs, radius, blocks)
    keep = found.filter("_id = group_id and _text = group_text").select(F.col("_id"), F.col("_text")).distinct()
    # Of rows equal in doc_id and text the one that is first by a hash of all columns.
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text"), F.struct(*(docs[c] for c in docs.columns)).alias("_row"))
    kept = keyed.join(keep, ["_id", "_text"], "left_semi").groupBy("_id", "_text").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row"))
    return kept.select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_ids(documents(spark, sf_dir))
