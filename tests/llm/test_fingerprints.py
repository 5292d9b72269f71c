"""Operators 3, 7."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from cotejo.llm import simhash, sketches
from cotejo.llm.common import NO_ID
from cotejo.llm.components import components

from .conftest import ODD


def shingles(text):
    w = text.encode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_sketches_equal_brute_force(docs):
    rng = random.Random(1)
    vocabulary = [f"w{i}é" for i in range(300)]
    rows = ODD + [(rng.randrange(-(2**40), 2**62), " ".join(rng.choices(vocabulary, k=rng.choice([0, 3, 30, 60])))) for _ in range(60)] + [(64 * i, f"dense {i} a b c d e f") for i in range(2, 40)]
    got = sketches.compared(docs(rows)).collect()
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (NO_ID if r[0] is None else r[0], (r[1] or "").encode()))
    left = [tuple(r) for r in got]
    names = got[0].__fields__
    for j, (i, t) in enumerate(ordered):
        t, u = t or "", ordered[(j + 1) % len(ordered)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        digest = hashlib.sha256(edited.encode()).hexdigest()
        mine = [r for r in left if r[0] == i and r[1] == len(t) and r[2] == digest]
        assert mine, (i, t, u)
        r = dict(zip(names, mine[0]))
        left.remove(mine[0])
        a, b, c = shingles(t), shingles(edited), shingles(u)
        if max(map(len, (a | b, a | c))) <= sketches.SIZE:  # exact up to the size of a sketch
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1)
            assert r["near_next"] == pytest.approx(len(a & c) / len(a | c) if a | c else 1)
            assert r["shingles"] == len(a)
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (a == b)
    assert not left


def test_sketches_estimate_and_merge(spark):
    rng = random.Random(7)
    w = [f"v{rng.randrange(10**6)}" for _ in range(3000)]
    a, b = " ".join(w[:2000]), " ".join(w[1000:])
    df = spark.createDataFrame([(a, b, " ".join(w))], "a string, b string, whole string")
    for c in ("a", "b", "whole"):
        df = sketches.with_sketch(df, c, f"s_{c}", 512)
    r = df.select(
        sketches.resemblance(F.col("s_a"), F.col("s_b"), 512).alias("like"),
        sketches.containment(F.col("s_a"), F.col("s_whole"), 512).alias("inside"),
        sketches.distinct_shingles(F.col("s_a"), 512).alias("n"),
    ).first()
    assert r["like"] == pytest.approx(1 / 3, abs=0.07) and r["inside"] > 0.85 and r["n"] == pytest.approx(1996, rel=0.15)
    halves = spark.createDataFrame([(" ".join(w[:1504]), " ".join(w[1500:]))], "x string, y string")
    halves = sketches.with_sketch(sketches.with_sketch(halves, "x", "s_x", 512), "y", "s_y", 512)
    merged = halves.select(sketches.merged(F.col("s_x"), F.col("s_y"), 512)).first()[0]
    assert merged == df.select("s_whole").first()[0]


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    n = min(3, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(keys, fps, radius=3):
    label = list(range(len(keys)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(keys))]


def test_simhash_equals_brute_force(docs):
    rng = random.Random(3)
    rows = list(ODD)
    for g in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.choice([4, 200, 400]))]
        for c in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = "X"
            rows.append((100 + 10 * g + c, (" " if c % 2 else "\n").join(copy)))
    got = simhash.component_ids(docs(rows)).collect()
    keys = sorted({(NO_ID if i is None else i, t) for i, t in rows}, key=lambda k: k[0])
    fps = [fingerprint(t) for _, t in keys]
    root = groups(keys, fps)
    want = {}
    for (i, _), f, r in zip(keys, fps, root):
        want.setdefault(None if i == NO_ID else i, set()).add((f"{f:016x}", None if keys[r][0] == NO_ID else keys[r][0]))
    assert len(got) == len(rows)
    assert all((r["fingerprint"], r["component_id"]) in want[r["doc_id"]] for r in got)
    kept = simhash.one_of_each(docs(rows))
    assert kept.columns == docs(rows).columns
    assert kept.count() == len({r for r in root})


def test_bit_planes_count_differences():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    x[::3] = np.uint64(1) << rng.integers(0, 64, len(x[::3]), dtype=np.uint64)
    x[::7] &= x[::7] >> np.uint64(3) & x[::7] >> np.uint64(11) & x[::7] >> np.uint64(17)
    for radius in (0, 1, 2, 3, 4, 7):
        assert (simhash.near(x, radius) == (np.bitwise_count(x) <= radius)).all()
    assert len(simhash.near(x[:0])) == 0


def test_links_in_a_large_bucket():
    rng = np.random.default_rng(2)
    fps = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))
    a, b = simhash.links(np.zeros(len(fps), int), fps)
    root = groups(fps.tolist(), [int(f) for f in fps])
    assert len(a) == len(fps) - len(set(root))


def test_large_buckets_are_cut_without_losing_links(spark):
    rng = random.Random(5)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    fps = {0, 2**64 - 1}
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(60):
            f = flip(f, rng.choice([1, 3, 4]))
            fps.add(f)
    fps |= {rng.getrandbits(20) for _ in range(300)}  # all of these share their upper bits
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2**64 if f >= 2**63 else f,) for f in fps], "fp long")
    want = groups(fps, fps)
    for hot in (4096, 20, 2):
        labels = {r["node"] % 2**64: r["label"] for r in components(simhash.linked(df, hot=hot)).collect()}
        classes = {}
        for f, r in zip(fps, want):
            classes.setdefault(r, set()).add(labels.get(f, f"alone {f}"))
        assert all(len(c) == 1 for c in classes.values()) and len({x for c in classes.values() for x in c}) == len(classes)
    free = simhash.ALL_BITS  # bits that members of a bucket need not share, at most
    for _ in range(simhash.LEVELS):
        free &= ~min(simhash.masks(within=free), key=int.bit_count)
    assert free.bit_count() == 15


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(100, 200)] + [(500, 500)]
    star = [(1000 + i, 1000) for i in range(300)] + [(5000, 4000), (4000, 4500)]
    df = spark.createDataFrame(path + star, "a long, b long")
    got = {r["node"]: r["label"] for r in components(df).collect()}
    assert all(got[i] == 100 for i in range(100, 201)) and all(got[1000 + i] == 1000 for i in range(300))
    assert got[5000] == got[4500] == 4000 and 500 not in got


def test_empty_tables(docs):
    none = docs([]).filter("false")
    assert sketches.compared(none).count() == 0
    assert simhash.component_ids(none).count() == 0
    assert sketches.compared(docs([(5, "a b c")])).first()["near_next"] == 1.0
