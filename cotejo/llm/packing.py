"""Operator 9: best-fit packing of documents into sequences, with conflicts.

Documents are dealt at random into cells of about ``CELL`` documents, and each
cell is packed by itself; rows that are repeated are counted first and dealt
apart, so no cell gets all of them.  In a cell the open bins are ordered by what is left
in them, and carry bitmaps of the duplicate clusters and of the sources that they hold.  A
document, largest first, goes to the tightest bin that is large enough and
has none of its cluster and fewer than ``PER_SOURCE`` of its source; the search
begins at the document's size and goes from one bin to its successor until a bin
is compatible, and a new bin is opened if none is.

Bins hold places in texts, not texts: only sizes, sources and clusters move.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, NO_ID, documents, written
from .mixing import word_count

#: Words of a bin, documents of a cell, documents of one source in a bin.
CAPACITY, CELL, PER_SOURCE = 2048, 4096, 4


def best_fit(items: list[tuple[int, int, int]], capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) for each (size, source, cluster) in turn; sizes are 1 to ``capacity``."""
    left: list[tuple[int, int]] = []  # (what is left, bin), in order
    clusters: list[int] = []
    sources: list[list[int]] = []  # a bitmap for one document of a source, one for two, ...
    out = []
    for size, source, cluster in items:
        source_bit, cluster_bit = 1 << source, 1 << cluster
        i = bisect_left(left, (size, -1))
        while i < len(left) and (clusters[left[i][1]] & cluster_bit or sources[left[i][1]][-1] & source_bit):
            i += 1
        if i < len(left):
            rest, number = left.pop(i)
        else:
            rest, number = capacity, len(clusters)
            clusters.append(0)
            sources.append([0] * per_source)
        clusters[number] |= cluster_bit
        for level, held in enumerate(sources[number]):
            if not held & source_bit:
                sources[number][level] = held | source_bit
                break
        out.append((number, capacity - rest))
        if rest > size:
            insort(left, (rest - size, number))
    return out


def _packed(capacity: int, per_source: int):
    names = ["doc_id", "text_hash", "size", "bin_id", "bin_offset", "piece", "piece_start", "piece_words"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def cell(table: pa.Table) -> pa.Table:
        number = table.column("cell")[0].as_py()
        ids, sizes = table.column("_id").to_pylist(), table.column("size").to_pylist()
        source = table.column("source").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_pylist()
        key = table.column("cluster").combine_chunks().dictionary_encode().indices.to_pylist()
        text = table.column("_text").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (-(sizes[i] % capacity), ids[i], sizes[i], text[i]))
        rows, full = [], 0
        for i in order:
            for piece in range(sizes[i] // capacity):
                rows.append((i, full, 0, piece, piece * capacity, capacity))
                full += 1
        rest = [i for i in order if sizes[i] % capacity]
        for i, (b, at) in zip(rest, best_fit([(sizes[i] % capacity, source[i], key[i]) for i in rest], capacity, per_source)):
            piece = sizes[i] // capacity
            rows.append((i, full + b, at, piece, piece * capacity, sizes[i] % capacity))
        rows += [(i, None, None, None, None, 0) for i in order if not sizes[i]]
        whole = ((None if ids[i] == NO_ID else ids[i], text[i], sizes[i], None if b is None else number << 32 | b, *more) for i, b, *more in rows)
        return pa.Table.from_arrays([pa.array(x, k) for x, k in zip(zip(*whole), kinds)], names=names)

    return cell


def pack(docs: DataFrame, capacity: int = CAPACITY, cell: int = CELL, per_source: int = PER_SOURCE) -> DataFrame:
    """doc_id, text_hash, size, bin_id, bin_offset, piece, piece_start and piece_words, a row per piece of a document.

    Texts that share a doc_id are told apart by ``text_hash`` (xxhash64).  Sizes are words.  A document beyond ``capacity`` fills bins of its own and its
    last piece is packed like a document; one without words (or a null text) has
    one row without a bin; a very long one is counted, never held.  A cluster is the set of documents with the same
    words, letter case apart; at most ``per_source`` documents of one
    source (null is one) share a bin.  Repeated rows are of one cluster, so they
    never share a bin.
    """
    text = F.coalesce("text", F.lit(""))
    cluster = F.xxhash64(F.lower(F.trim(F.regexp_replace(text, BLANKS, " "))))
    items = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_id"), F.xxhash64("text").alias("_text"), "source", word_count(F.col("text")).alias("size"), cluster.alias("cluster"))
    items = written(items.groupBy(*items.columns).agg(F.count("*").alias("_n")), "items")
    cells = -(-max(items.agg(F.sum("_n")).first()[0] or 0, 1) // cell)
    # Copies are numbered in parts, so that no row holds as many numbers as it has copies.
    parts = items.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / cell))))
    first = F.col("_part") * cell + 1
    dealt = parts.withColumn("_copy", F.explode(F.sequence(first, F.least(first + cell - 1, F.col("_n"))))).drop("_n", "_part")
    dealt = dealt.withColumn("cell", F.pmod(F.xxhash64("_id", "_text", "_copy"), F.lit(cells))).drop("_copy")
    schema = "doc_id long, text_hash long, size long, bin_id long, bin_offset long, piece long, piece_start long, piece_words long"
    return dealt.groupBy("cell").applyInArrow(_packed(capacity, per_source), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
