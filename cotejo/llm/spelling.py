"""Operator 12: spelling variants by reduced-alphabet generation.

Two words are near if they differ by exactly one inserted, deleted or replaced letter.  Letters
are hashed to a few symbols; words that are near have reduced words that are equal or near.  So every
word generates the full one-edit neighbourhood of its reduced word (itself, deletions,
replacements, insertions: about 2 x symbols for each letter, not 2 x alphabet), these meet the reduced
words of the vocabulary in one equi join, and pairs that meet are verified on the words themselves.
A reduced word of n letters takes the n-th root of ROOM x vocabulary symbols, so short
words do not crowd and long ones have small neighbourhoods; what is generated by an edit is reduced for its own length.

Reduced words travel as 64-bit hashes, which are computed for a whole neighbourhood from sums over
the word's beginnings and ends; a collision makes a pair to verify and no more.

A reduced word that more than ``most`` words share would pair all of these with each of its
neighbours.  Its words are left out of the join and meet, in the next round, those words that
generated it, reduced to a larger alphabet.  The last alphabet is that of all letters, where a
reduced word is one word.  Every round is exact for the words that it handles, so nothing is lost.

Joins of neighbourhoods, and of tables as long as the vocabulary, are sort-merge joins: an explode has hundreds of
rows for what is estimated as one, and words take more room in memory than in their file, so a broadcast would
fill the driver.  Only the crowded reduced words, at most one in ``most`` words, may be broadcast.

Words are counted from all texts by column functions, with map-side partial counts.
Nulls: a null text has no words; in a document without doc_id no letter is deleted, as it has no hash.  Repeated
rows count as often as they occur.  An empty table has no words.  A very long word generates its
neighbourhood in pieces, under a digest of itself, and has the word back for the verification; very long
texts are arrays of their words.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, let, written

LEAST_LETTERS, LEAST_COUNT, TYPO_EVERY, FACTOR = 5, 3, 97, 2
#: Reduced words that there is room for, by words of the vocabulary, in the first round.
ROOM = 4
#: Symbols of the rounds after that; None stands for all letters, one symbol each.
FURTHER = (24, None)
#: Words that may share a reduced word before they go to the next round.
MOST = 256
#: Letters whose neighbourhoods are generated at once; letters of a word that is carried along with each of its neighbours.
CHUNK, CARRIED = 1 << 15, 64
#: The join whose sides are both dealt and sorted, whatever their estimated size.
DEALT = "merge"
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))

#: How many symbols reduced words of a length are made of; None for all letters.
Symbols = Callable[[int], int | None]
_BASE = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_BASE, -1, 2**64))
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@lru_cache
def _symbols(symbols: int | None) -> tuple[np.ndarray, np.ndarray]:
    """The value of each code point below 256, and the values of all symbols; never 0."""
    of = np.arange(256, dtype=np.uint64) if symbols is None else _mixed(np.arange(256, dtype=np.uint64) + np.uint64(7)) % np.uint64(symbols)
    value = _mixed(of + np.uint64(1)) | np.uint64(1)
    return value, np.unique(value[[ord(c) for c in LETTERS]])


def by_length(vocabulary: int) -> Symbols:
    """Symbols for reduced words of a length, so that there is room for ROOM x ``vocabulary`` of them."""

    def symbols(length: int) -> int | None:
        few = max(2, math.ceil(max(ROOM * vocabulary, 1) ** (1 / max(length, 1))))
        return few if few < len(LETTERS) else None

    return symbols


def _groups(words: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, numbers, code points) of the words of each length; ISO 8859-1 has every letter."""
    length = np.array([len(w) for w in words])
    for n in np.unique(length):
        numbers = np.flatnonzero(length == n)
        yield int(n), numbers, np.frombuffer("".join(words[i] for i in numbers).encode("latin-1"), np.uint8).reshape(len(numbers), n)


@dataclass
class _Sums:
    """Per letter of words of one length: its value, its power, the sum of what is before it; per word the sum of all."""

    x: np.ndarray
    power: np.ndarray
    before: np.ndarray
    whole: np.ndarray
    every: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, symbols: int | None) -> _Sums:
        value, every = _symbols(symbols)
        power = np.full(codes.shape[1] + 1, _BASE, np.uint64)
        power[0] = 1
        power = np.cumprod(power, dtype=np.uint64)
        x = value[codes]
        upto = np.cumsum(x * power[:-1], axis=1, dtype=np.uint64)
        return cls(x, power, upto - x * power[:-1], upto[:, -1], every)


def _key(total: np.ndarray, length: int) -> np.ndarray:
    return _mixed(total + np.uint64(length * (_BASE >> 2) % 2**64)).view(np.int64)


def reduced_keys(words: list[str], symbols: Symbols) -> np.ndarray:
    """The hash of each reduced word."""
    out = np.zeros(len(words), np.int64)
    for n, numbers, codes in _groups(words):
        out[numbers] = _key(_Sums.of(codes, symbols(n)).whole, n)
    return out


def neighbourhoods(words: list[str], symbols: Symbols) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the word, hash): the reduced words themselves and their full one-edit neighbourhoods, each reduced word once.

    Each is made in one way only: of a run of equal symbols the first is deleted, a symbol is replaced by
    others, and inserted only before a symbol that differs or at the end.  A piece for each symbol.
    """
    base = np.uint64(_BASE)
    for n, numbers, codes in _groups(words):
        each = np.broadcast_to(numbers[:, None], codes.shape)
        s = _Sums.of(codes, symbols(n - 1))
        power = s.power[:-1]
        first = np.ones(codes.shape, bool)
        first[:, 1:] = s.x[:, 1:] != s.x[:, :-1]
        yield each[first], _key(s.before + (s.whole[:, None] - s.before - s.x * power) * _BACK, n - 1)[first]
        s = _Sums.of(codes, symbols(n))
        yield numbers, _key(s.whole, n)
        for v in s.every:
            other = s.x != v
            yield each[other], _key(s.whole[:, None] + (v - s.x) * power, n)[other]
        s = _Sums.of(codes, symbols(n + 1))
        rest = (s.whole[:, None] - s.before) * base
        for v in s.every:
            other = s.x != v
            yield each[other], _key(s.before + v * power + rest, n + 1)[other]
            yield numbers, _key(s.whole + v * s.power[n:], n + 1)


def counted_words(docs: DataFrame, least: int = LEAST_LETTERS, times: int = LEAST_COUNT, every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): words of at least ``least`` letters that occur ``times`` times or more, after the planted deletions."""
    found = docs.select("doc_id", F.explode(F.regexp_extract_all(F.col("text"), F.lit(f"[A-Za-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    small = F.when(F.col("run").rlike("[A-Z]"), F.translate("run", _CAPITALS, _CAPITALS.lower())).otherwise(F.col("run"))

    def word(run: Column) -> Column:
        h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), run).cast("binary"))
        at = (h % F.length(run)).cast("int")
        return F.when(h % every == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)

    found = found.select("doc_id", small.alias("run")).select(word(F.col("run")).alias("word")).filter(F.length("word") >= least)
    return found.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= times)


def _keyed(words: DataFrame, symbols: Symbols) -> DataFrame:
    """(near, near_n, key) of (word, n)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reduced_keys(batch.column(0).to_pylist(), symbols))], names=["near", "near_n", "key"])

    return words.select("word", "n").mapInArrow(batches, "near string, near_n long, key long")


def _name(word: str) -> str:
    """What stands for a word beside its neighbours: itself, or a digest if it is long; no word has a number sign."""
    return word if len(word) <= CARRIED else "#" + hashlib.md5(word.encode()).hexdigest()


def _generated(words: DataFrame, symbols: Symbols) -> DataFrame:
    """(name, key) for the whole neighbourhood of every word."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            all_words = batch.column(0).to_pylist()
            part = np.cumsum([len(w) for w in all_words]) // CHUNK
            for group in np.split(np.arange(len(all_words)), np.flatnonzero(np.diff(part)) + 1):
                words = all_words[group[0] : group[-1] + 1] if len(group) else []
                names = pa.array([_name(w) for w in words], pa.string())
                pieces = neighbourhoods(words, symbols) if words else []
                if sum(map(len, words)) < 4 * CHUNK and words:
                    pieces = [[np.concatenate(x) for x in zip(*pieces)]]
                for number, key in pieces:
                    order = np.argsort(number, kind="stable")
                    at = np.searchsorted(number[order], np.arange(len(words) + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([names, pa.ListArray.from_arrays(pa.array(at), pa.array(key[order]))], names=["name", "keys"])

    return words.select("word").mapInArrow(batches, "name string, keys array<long>").select("name", F.explode("keys").alias("key"))


def _one_edit(word: str) -> Column:
    return (F.levenshtein(word, "near", 1) == 1) & (F.col(word) != F.col("near"))


def near_pairs(words: DataFrame, levels: tuple[int | None, ...] | None = None, most: int = MOST) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of near words of ``words`` (word, n), each pair once.

    ``levels``: symbols of the rounds, one number for all lengths; the last must be None.
    """
    rounds = [lambda n, s=s: s for s in (levels or FURTHER)]
    if levels is None:
        rounds = [by_length(words.count()), *rounds]
    name = F.when(F.length("word") <= CARRIED, F.col("word")).otherwise(F.concat(F.lit("#"), F.md5("word")))
    long_words = written(words.filter(F.length("word") > CARRIED).select(name.alias("name"), "word"), "long")
    found, targets, probes = [], words, words
    for i, symbols in enumerate(rounds):
        keyed, generated = _keyed(targets, symbols), _generated(probes, symbols)
        crowded = False
        if i < len(rounds) - 1:
            keyed = written(keyed, "reduced")
            hot = written(keyed.groupBy("key").agg(F.count("*").alias("_n")).filter(F.col("_n") > most).select("key"), "hot")
            crowded = not hot.isEmpty()
        if crowded:
            targets = written(keyed.join(hot, "key", "left_semi").select(F.col("near").alias("word"), F.col("near_n").alias("n")), "targets")
            names = generated.join(hot, "key", "left_semi").select("name").distinct()
            probes = written(words.join(names.hint(DEALT), name == names["name"], "left_semi"), "probes")
            keyed = keyed.join(hot, "key", "left_anti")
        # Verified before the long words are looked up by their digests, so only these and true pairs are dealt once more.
        met = generated.join(keyed.hint(DEALT), "key").filter(F.startswith("name", F.lit("#")) | _one_edit("name"))
        met = met.join(long_words.hint(DEALT), "name", "left").withColumn("word", F.coalesce("word", "name")).filter(_one_edit("word"))
        found.append(met.select("word", "near", "near_n"))
        if not crowded:
            break
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    # By word, so that the grouping by word that follows needs no shuffle of its own.
    return pairs.repartition("word").groupBy("word", "near").agg(F.first("near_n").alias("near_n"))


def variants(words: DataFrame, factor: int = FACTOR, levels: tuple[int | None, ...] | None = None, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of ``words`` (word, n): each word's most frequent near word, if it
    occurs ``factor`` times as often or more, and where the chain of these ends."""
    words = written(words, "words")
    pairs = near_pairs(words, levels, most)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    near = pairs.groupBy("word").agg(F.count("*").alias("n_near"), best)
    told = words.join(near.hint(DEALT), "word", "left")
    takes = let(F.col("best"), lambda b: F.when(-b["less"] >= factor * F.col("n"), b))
    told = told.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), takes.alias("form"))
    told = written(told.select("word", "n", "n_near", F.col("form.near").alias("form"), (-F.col("form.less")).alias("form_n")), "forms")
    return told.join(_roots(told).hint(DEALT), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(told: DataFrame) -> DataFrame:
    """(word, root) of all words with a form: chains are followed by doubling; n at least doubles along them, so they are short."""
    hops = written(told.filter("form is not null").select("word", F.col("form").alias("root")), "hops")
    while True:
        on = hops.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = written(hops.join(on.hint(DEALT), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "hops")
        hops = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return hops


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(counted_words(documents(spark, sf_dir)))
