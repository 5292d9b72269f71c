"""Operator 12 against brute force over all pairs."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cotejo.llm import spelling
from tests.llm.conftest import ODD


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode()) if doc_id is not None else 1
            if h % 97 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts):
    near = {w: [v for v in counts if abs(len(v) - len(w)) < 2 and one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def told(df):
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("symbols", [lambda n: 2, lambda n: 5, lambda n: None, spelling.by_length(3000)])
def test_neighbourhoods_are_complete_and_each_once(symbols):
    words = ["aaaaa", "abcab", "éàééb", "thing", "nicht", "a" * 40]
    parts = [np.concatenate(x) for x in zip(*spelling.neighbourhoods(words, symbols))]

    def reduced(w, letters={}):
        value, _ = spelling._symbols(symbols(len(w)))
        made = letters.setdefault(symbols(len(w)), {})  # a letter for each symbol
        for c in spelling.LETTERS:
            made.setdefault(int(value[ord(c)]), c)
        return "".join(made[int(value[ord(c)])] for c in w)

    for i, w in enumerate(words):
        want = {reduced(w)} | {reduced(w[:j] + w[j + 1 :]) for j in range(len(w))}
        for c in spelling.LETTERS:
            want |= {reduced(w[:j] + c + w[j + 1 :]) for j in range(len(w))} | {reduced(w[:j] + c + w[j:]) for j in range(len(w) + 1)}
        mine = parts[1][parts[0] == i]
        assert len(mine) == len(set(mine.tolist())) == len(want)
        assert set(mine.tolist()) == set(spelling.reduced_keys(sorted(want), symbols).tolist())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(5)
    seeds = ["".join(draw.choice("abcdé") for _ in range(draw.randint(4, 9))) for _ in range(60)]
    out = []
    for i in range(120):
        words = []
        for _ in range(60):
            w = list(draw.choice(seeds))
            if draw.random() < 0.5:
                j = draw.randrange(len(w))
                w[j : j + draw.choice((0, 1))] = draw.choice(["", "a", "Z", "ÿ"])
            words.append("".join(w).capitalize() if draw.random() < 0.2 else "".join(w))
        out.append((i, draw.choice((" ", ", ", "1", "\n")).join(words)))
    return out + [(None, "abcde " * 4)] + out[:5] + [x for x in ODD if len(x) == 2]


@pytest.mark.parametrize("levels, most", [(None, 256), (None, 1), ((2, 5, None), 3), ((None,), 1), ((2, None), 1)])
def test_variants_equal_brute_force(spark, docs, rows, levels, most):
    counts = words_of(rows)
    got = spelling.counted_words(docs(rows))
    assert dict(map(tuple, got.collect())) == counts
    assert told(spelling.variants(got, levels=levels, most=most)) == brute(counts)


def test_query_equals_brute_force_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    counts = words_of([tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()])
    assert told(spelling.query(spark, sf)) == brute(counts)


def test_odd_tables_and_long_words(spark, docs):
    assert told(spelling.variants(spelling.counted_words(docs([]).limit(0)))) == []
    assert told(spelling.variants(spelling.counted_words(docs([(1, None), (2, "")])))) == []
    long = "ab" * 20_000
    words = {long: 9, long[:-1]: 4, long + "b": 3, "x" * 64: 8, "x" * 65: 4, "x" * 66: 3, "x" * 70: 3}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    want = [
        (long, None, long, 9, 2, None),
        (long[:-1], long, long, 4, 1, 9),
        (long + "b", long, long, 3, 1, 9),
        ("x" * 64, None, "x" * 64, 8, 1, None),
        ("x" * 65, "x" * 64, "x" * 64, 4, 2, 8),
        ("x" * 66, None, "x" * 66, 3, 1, None),
        ("x" * 70, None, "x" * 70, 3, 0, None),
    ]
    assert told(spelling.variants(df)) == sorted(want, key=repr)


def test_chains_of_forms_end_at_one_root(spark):
    words = {"abcde": 3, "abcdf": 6, "abcgf": 12, "abhgf": 24, "aihgf": 48, "jihgf": 96}
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")).collect()}
    assert {w: (r["form"], r["root"]) for w, r in got.items()} == {
        "abcde": ("abcdf", "jihgf"),
        "abcdf": ("abcgf", "jihgf"),
        "abcgf": ("abhgf", "jihgf"),
        "abhgf": ("aihgf", "jihgf"),
        "aihgf": ("jihgf", "jihgf"),
        "jihgf": (None, "jihgf"),
    }


def test_only_crowded_reduced_words_are_broadcast(spark, monkeypatch):
    plans = []

    def kept(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, name)

    written = spelling.written
    monkeypatch.setattr(spelling, "written", kept)
    long_word = "abcdefgh" * 9
    counts = {"house": 9, "hause": 3, "haus": 1, "houses": 2, "mouse": 4, long_word: 8, long_word[:-1]: 3, "x" + long_word: 2}
    out = spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long"), levels=(2, None), most=1)
    got = told(out)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    joins = [line for plan in plans for line in plan.splitlines() if "Broadcast" in line and "Join" in line]
    assert all(re.search(r"BroadcastHashJoin \[key#\d+L?\], \[key#\d+L?\], Left(Semi|Anti)", line) for line in joins), joins
    assert len([plan for plan in plans if "SortMergeJoin" in plan]) >= 4
    assert got == brute(counts)
