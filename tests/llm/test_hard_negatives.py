"""Operator 13 against its SQL and a brute-force version."""

import math
import random

import numpy as np
import pytest

from cotejo.llm import hard_negatives
from cotejo.llm.hard_negatives import Mining, mined, packed, products, unpacked
from tests.llm.sql import same

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = ((label + 1) % 10 if i % 7 == 0 else label, tuple(v))
        kept[i] = min(kept.get(i, row), row)
    whole = {i: (label, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, (label, v) in kept.items()}
    out = []
    for a, (label, v) in whole.items():
        if a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other == label) for i, (other, w) in whole.items() if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2]][:5]:
            inside = [(i, -t) for t, i, alike in scored if not alike and 50 * -s <= 100 * -t <= 95 * -s]
            out += [(a, p, k, i, -s, t) for k, (i, t) in enumerate(inside[:3], 1)]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1L AS id", "'x' AS block", "2 AS anchor", "3 AS score").repartition(3)


def told(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(map(tuple, df.collect()))


def vectors(n, dim, labels, seed=1):
    draw = random.Random(seed)
    return [(i, [draw.gauss(0.02, 0.1) for _ in range(dim)], draw.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("block", [1 << 22, 300])
def test_equals_brute_force(spark, block):
    rows = vectors(400, 6, 3)
    assert told(hard_negatives.hard_negatives(table(spark, rows), block=block)) == brute(rows) != []


def test_ties_common_vectors_and_zero_scores(spark):
    draw = random.Random(3)
    rows = [(i, [draw.choice((0.0, 0.5, 1.0, -0.5)) for _ in range(3)], draw.randrange(3)) for i in range(350)]
    rows += [(i, [0.5, 0.5, 0.5], 1) for i in range(350, 600)]
    rows[100] = (100, [0.0, 0.0, 0.0], 2)
    want = brute(rows)
    assert any(r[4] == 0 for r in want)
    assert told(hard_negatives.hard_negatives(table(spark, rows), block=150)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(120, 4, 2)
    rows += rows[:10] + [(None, [1.0] * 4, 1), (200, None, 1), (250, [1.0] * 4, None), (300, [1.0, None, 1.0, 1.0], 1)]
    rows += [(350, [nan] * 4, 1), (400, [inf, 1.0, 1.0, 1.0], 0), (450, [], 1), (451, [], 1), (452, [], 0), (500, [1.0, 2.0], 1), (501, [1.0, 3.0], 1), (502, [1.0, 1.0], 0)]
    rows += [(550, [3.0] * 4, 1), (550, [2.0] * 4, 1), (-50, [0.2] * 4, 1)]
    assert told(hard_negatives.hard_negatives(table(spark, rows), block=200)) == brute(rows)
    assert told(hard_negatives.hard_negatives(table(spark, rows).limit(0))) == []
    assert told(hard_negatives.hard_negatives(table(spark, [(50, [1.0], 1)]))) == []


def test_query_equals_its_sql(spark):
    same(spark, hard_negatives.query, hard_negatives.SQL, "/root/testdata/sf0.01")


def test_products_are_exact():
    draw = np.random.default_rng(2)
    for size in (10, 1 << 14, 1 << 25, 1 << 40):
        a, b = draw.integers(-size, size, (7, 5)).astype(float), draw.integers(-size, size, (6, 5)).astype(float)
        want = [[max(min(sum(int(x) * int(y) for x, y in zip(r, s)), 2**63 - 1), 1 - 2**63) for s in b] for r in a]
        assert products(a, b).tolist() == want


def test_keys_sort_like_their_parts():
    draw = random.Random(4)
    parts = [(draw.choice((-50, 0, 50, 10**12)), draw.choice((-(10**15), -1, 0, 1, 10**15)), draw.randrange(-5, 5)) for _ in range(300)]
    assert [unpacked(k) for k in sorted(packed(*p) for p in parts)] == sorted(parts, key=lambda p: (p[0], -p[1], p[2]))


def test_iterator_holds_open_windows_only():
    seen = []

    def keys():
        for a in range(2):
            yield packed(a, 10**6, 1), True
            for i in range(50_000):
                seen.append(i)
                yield packed(a, 900_000 - i, i), False

    out = mined(keys(), Mining())
    assert next(out) == (0, 1, 1, 0, 10**6, 900_000) and len(seen) == 1  # given as soon as it is reached
    assert len(list(out)) == 5
