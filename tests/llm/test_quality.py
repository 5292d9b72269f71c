"""Operators 2, 10."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from cotejo.llm import line_rules, quality_model
from cotejo.llm.common import documents

from .conftest import ODD
from .sql import same

SF = "/root/testdata/sf0.001"


def measures(text):
    text = text or ""
    w = text.encode().split()
    count = Counter(zip(w, w[1:], w[2:]))
    repeat = {p for i, t in enumerate(zip(w, w[1:], w[2:])) if count[t] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if x.encode().split()]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat)


def test_line_rules_equal_sql(spark):
    same(spark, line_rules.query, line_rules.SQL, SF)


def test_line_rules_odd_rows_and_frequent_lines(docs):
    body = " ".join(f"w{i}" for i in range(60))
    rows = ODD + [(100 + i, f"Common line {i}\n" * 2 + ("only this\n" * 3 if i % 2 else body + f" {i}"), None if i < 3 else "h") for i in range(12)]
    rows += [(200, "a b a b a b a b a b|" * 6), (201, "a b a b a b a b a b|" * 6)]
    got = line_rules.judged(docs(rows), limit=4).collect()
    assert len(got) == len(rows)
    found = defaultdict(list)
    for r in got:
        found[r["doc_id"]].append(r)
    for row in rows:
        want = measures(row[1])
        mine = [r for r in found[row[0]] if (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want]
        assert mine, (row, want, found[row[0]])
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert all(r["base_failed"] == failed for r in mine)
        if failed:
            assert not any(r["kept"] for r in mine)
    # "common line" is in more than 4 documents of h; long documents keep most of their words.
    assert all(r["kept"] for i in range(4, 12, 2) for r in found[100 + i])
    assert all(r["frequent_words"] > 0 for i in range(4, 12) for r in found[100 + i])
    clean = {r["doc_id"]: r["text"] for r in line_rules.without_frequent_lines(docs(rows), limit=4).collect()}
    assert clean[104] == body + " 4\n".rstrip("\n") and clean[4] == "one" and clean[1] is None


def test_depleted_documents_are_rejected(docs):
    same_lines = "\n".join(" ".join(f"{a}{chr(97 + j)}" for j in range(20)) for a in ("p", "q", "r"))
    got = line_rules.judged(docs([(i, same_lines + f"\n tail {'x' * i} end", "h") for i in range(8)]), limit=5).collect()
    assert not any(r["kept"] or r["base_failed"] for r in got)


def test_repeated_texts_count_once(docs):
    same_lines = "\n".join(" ".join(f"{a}{chr(97 + j)}" for j in range(20)) for a in ("p", "q", "r"))
    got = line_rules.judged(docs([(i, same_lines, "h") for i in range(8)]), limit=5).collect()
    assert all(r["kept"] for r in got)


def test_no_documents(docs, spark):
    assert line_rules.judged(docs([]).filter("false")).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality_model.scores(docs([]).filter("false"), labels).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    got = quality_model.query(spark, sf).join(labels, "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 500 and got.score.between(0, 1).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert held[held.quality == 1].predicted.mean() > 0.97


def test_learns_from_the_other_folds_only(spark):
    d, labels = documents(spark, SF), spark.read.parquet(f"{SF}/labels.parquet")
    told = labels.withColumn("held", quality_model.remainder() == quality_model.HELD_OUT)
    other = told.selectExpr("doc_id", "CASE WHEN held THEN 1 - quality ELSE quality END AS quality")
    a, b = (quality_model.scores(d, x).orderBy("doc_id").toPandas() for x in (labels, other))
    assert np.allclose(a.score, b.score)


def test_scores_of_odd_rows(docs, spark):
    rows = ODD + [(100 + i, f"A calm text number {i} about words. " * (3 + i % 4)) for i in range(40)] + [(300 + i, "LOUD!! " * 30) for i in range(20)]
    labels = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(300 + i, 0) for i in range(10)] + [(None, 1), (101, None), (102, 0)], "doc_id long, quality int")
    got = quality_model.scores(docs(rows), labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    kept = quality_model.accepted(docs(rows), labels)
    assert kept.columns == docs(rows).columns
    none = quality_model.scores(docs(rows), labels.filter("quality = 0")).collect()
    assert all(r["score"] == 1.0 and r["predicted"] == 1 for r in none)


def test_repeated_rows_are_learned_from_once(docs, spark):
    rows = [(100 + i, f"A calm text number {i} about words. " * (3 + i % 4)) for i in range(40)] + [(300 + i, "LOUD!! " * 30) for i in range(20)]
    labels = spark.createDataFrame([(100 + i, 1) for i in range(30)] + [(300 + i, 0) for i in range(10)], "doc_id long, quality int")
    more = rows + rows[:3] * 50 + [(None, "no id")] * 50
    a, b = (quality_model.train(docs(x), labels) for x in (rows, more))
    assert all(np.array_equal(x, y) for x, y in zip(a.weights, b.weights))


@pytest.mark.parametrize("text", [b"", b" ", b"\n", "é".encode(), b"a" * 100_000])
def test_features_of_any_text(text):
    assert np.isfinite(quality_model.features(text)).all()


@pytest.mark.parametrize("prior", [0.3, 0.95])
def test_gradients_equal_differences_of_the_risk(prior):
    """Both branches: the risk as it is, and the step back from a negative part below 0."""
    rng = np.random.default_rng(4)
    model = quality_model.Network(np.zeros(6, np.float32), np.ones(6, np.float32), hidden=5, seed=1)
    model.weights = [w.astype(np.float64) for w in model.weights]
    x, p = rng.normal(size=(60, 6)), 20
    x = x[np.argsort(-model.output(x)[1])]  # positives have the highest outputs

    def value():
        positive, negative = model.risk(x, p, prior)
        return positive + negative if below is False else -negative

    below = model.risk(x, p, prior)[1] < 0
    assert below == (prior == 0.95)
    for w, grad in zip(model.weights, model.gradients(x, p, prior)):
        flat, want = w.reshape(-1), np.asarray(grad).reshape(-1)
        for i in range(0, len(flat), 3):
            kept, step = flat[i], 1e-6
            flat[i] = kept + step
            up = value()
            flat[i] = kept - step
            down = value()
            flat[i] = kept
            assert (up - down) / (2 * step) == pytest.approx(want[i], abs=1e-7)


def test_risk_is_that_of_its_definition():
    model = quality_model.Network(np.zeros(3, np.float32), np.ones(3, np.float32), hidden=4, seed=2)
    x = np.random.default_rng(5).normal(size=(30, 3))
    margin = [float(model.output(r[None])[1][0]) for r in x]
    loss = lambda m: 1 / (1 + np.exp(m))
    positive = 0.4 * sum(loss(m) for m in margin[:10]) / 10
    negative = sum(loss(-m) for m in margin[10:]) / 20 - 0.4 * sum(loss(-m) for m in margin[:10]) / 10
    assert model.risk(x, 10, 0.4) == pytest.approx((positive, negative))


def test_an_id_with_many_texts_gives_one(docs):
    df = docs([(1, f"text {i}") for i in range(50)] + [(2, "other"), (None, None)])
    assert len(quality_model._features(df)) == 3
