"""Operators 8, 9 and the pipeline."""

import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cotejo.llm import mixing, packing, quality_model
from cotejo.llm.common import documents

from .conftest import ODD
from .sql import same
from .test_archives_and_secrets import PATTERNS
from .test_fingerprints import fingerprint, groups

SF = "/root/testdata/sf0.001"


def test_mixing_equals_sql(spark):
    same(spark, mixing.query, mixing.SQL, SF)


def shares(sizes, weights=mixing.WEIGHTS, share=mixing.SHARE, most=mixing.MOST):
    """Targets by resharing until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = share * sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        level = left / sum(w[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * w[s] > most * sizes[s] + 1e-9}
        if not above:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in order}
        capped |= above


def test_mixing_targets_and_odd_rows(docs):
    rows = ODD + [(1000 + i, "word " * (i % 7 + 1), [None, "b", "a", "ä", "z"][min(i % 9, 4)]) for i in range(600)] + [(5, "one", "empty"), (None, "", "nothing")]
    got = mixing.mix(docs(rows)).collect()
    assert len(got) == len(rows)
    size, taken = Counter(), Counter()
    target = {}
    for r in got:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert r["taken"] == r["copies"] * r["size"] and r["copies"] <= 2
    want = shares(dict(size))
    assert target == pytest.approx(want)
    assert all(0 <= target[s] - taken[s] <= 7 * 2 for s in target)
    again = mixing.mix(docs(rows)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, again), key=repr)
    df = docs(rows)
    out = mixing.repeated(df)
    assert out.columns == df.columns and out.count() == sum(r["copies"] for r in got)
    assert mixing.mix(df.filter("false")).count() == 0


def test_repeated_rows_come_near_their_target(spark, docs, tmp_path):
    """Copies of one row make up most of a source; a third differ in another column."""
    rows = [(7, "one two three four five " * 50, "big")] * 200 + [(100 + i, "word " * (i % 9 + 1), "big") for i in range(30)] + [(900 + i, "x y " * 40, "other") for i in range(150)]
    df = docs(rows)
    df = df.withColumn("lang", F.when((F.col("doc_id") == 7) & (F.rand(3) < 0.3), "de").otherwise(F.col("lang"))).cache()
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    for source, longest in (("big", 250), ("other", 80)):
        own = [r for r in got if r["source"] == source]
        assert 0 <= own[0]["target"] - sum(r["taken"] for r in own) <= longest
    out = mixing.repeated(df)
    assert sorted((r["doc_id"], r["source"]) for r in out.collect()) == sorted((r["doc_id"], r["source"]) for r in got for _ in range(r["copies"]))
    df.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("pages", "labels", "embeddings"):
        os.symlink(f"{SF}/{t}.parquet", f"{tmp_path}/{t}.parquet")
    same(spark, mixing.query, mixing.SQL, str(tmp_path))


def test_larger_budgets_take_the_documents_of_smaller_ones(docs):
    df = docs([(i, "word " * (i % 5 + 1), "ab"[i % 3 == 0]) for i in range(300)])
    less, more = ({r["doc_id"]: r["copies"] for r in mixing.mix(df, share=s).collect()} for s in (0.4, 0.7))
    assert all(more[i] >= less[i] for i in less) and sum(more.values()) > sum(less.values())


def naive(items, capacity, per_source):
    bins, out = [], []
    for size, source, cluster in items:
        fits = [(b["left"], i) for i, b in enumerate(bins) if b["left"] >= size and b["left"] and cluster not in b["clusters"] and b["sources"][source] < per_source]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"left": capacity, "clusters": set(), "sources": Counter()})
        out.append((i, capacity - bins[i]["left"]))
        bins[i]["left"] -= size
        bins[i]["clusters"].add(cluster)
        bins[i]["sources"][source] += 1
    return out


def test_best_fit_equals_brute_force():
    import random

    rng = random.Random(5)
    for _ in range(30):
        items = sorted(((rng.randint(1, 40), rng.randrange(3), rng.randrange(12)) for _ in range(80)), reverse=True)
        assert packing.best_fit(items, 40, 2) == naive(items, 40, 2)


def test_packing_keeps_every_word(docs):
    rows = ODD + [(100 + i, f"w{i} " * (i % 23 + 1), f"s{i % 3}") for i in range(200)] + [(400, "long " * 95), (401, "LONG " * 95)]
    got = packing.pack(docs(rows), capacity=20, cell=50).collect()
    words = Counter()
    for i, t, *_ in rows:
        words[i] += len((t or "").split())
    packed, bins, source = Counter(), defaultdict(list), {i: (s[0] if s else "s") for i, _, *s in rows}
    for r in got:
        packed[r["doc_id"]] += r["piece_words"]
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    assert packed == words and set(packed) == {i for i, *_ in rows}
    for held in bins.values():
        held.sort(key=lambda r: r["bin_offset"])
        assert sum(r["piece_words"] for r in held) <= 20
        assert all(a["bin_offset"] + a["piece_words"] == b["bin_offset"] for a, b in zip(held, held[1:])) and held[0]["bin_offset"] == 0
        assert max(Counter(source[r["doc_id"]] for r in held).values()) <= packing.PER_SOURCE
        assert not {400, 401} <= {r["doc_id"] for r in held} and sum(r["doc_id"] in (4, 5) for r in held) <= 1
    assert packing.pack(docs(rows).filter("false")).count() == 0


def test_repeated_rows_are_dealt_over_cells(docs):
    got = packing.pack(docs([(7, "the same words")] * 900 + [(100 + i, f"other {i}") for i in range(100)]), capacity=8, cell=50).collect()
    cells = Counter(r["bin_id"] >> 32 for r in got if r["doc_id"] == 7)
    assert sum(cells.values()) == 900 and max(cells.values()) < 200
    assert len({r["bin_id"] for r in got if r["doc_id"] == 7}) == 900  # never two in a bin


def test_copies_with_outer_blanks_never_share_a_bin(docs):
    texts = ["the same words", "the same words\n", " the same words", "\t The  same words \r\n"]
    got = packing.pack(docs([(i, t, f"s{i}") for i, t in enumerate(texts)]), capacity=20).collect()
    assert len(got) == 4 and {r["size"] for r in got} == {3}
    assert len({r["bin_id"] for r in got}) == 4


def clean(text):
    spans = sorted((m.start(), m.end()) for _, p, g, least in PATTERNS for m in p.finditer(text) if len(m.group(g)) >= least)
    out, end = "", 0
    for a, b in spans:
        if a >= end:
            out += text[end:a] + "[REDACTED]"
        end = max(end, b)
    return out + text[end:]


def test_stages_equal_brute_force(spark):
    d = documents(spark, SF)
    stages = dict(corpus_pipeline.STAGES)
    accepted = stages["quality classifier"](spark, d, SF)
    good = {r["doc_id"] for r in quality_model.query(spark, SF).filter("predicted = 1").collect()}
    rows = {r["doc_id"]: r for r in accepted.collect()}
    assert set(rows) == good and accepted.columns == d.columns

    single = stages["simhash near-dedup"](spark, accepted, SF)
    keys = sorted(rows)
    root = groups(keys, [fingerprint(rows[i]["text"]) for i in keys])
    kept = {keys[r] for r in root}
    assert {r["doc_id"] for r in single.collect()} == kept and single.columns == d.columns

    safe = stages["secret scans"](spark, single, SF)
    texts = {r["doc_id"]: r["text"] for r in safe.collect()}
    assert texts == {i: clean(rows[i]["text"]) for i in kept} and safe.columns == d.columns
    assert all(r["n_chars"] == len(r["text"]) for r in safe.collect())

    mixed = stages["mixing to target weights"](spark, safe, SF)
    copies = Counter(r["doc_id"] for r in mixed.collect())
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(safe).collect() if r["copies"]}
    assert copies == want and mixed.columns == d.columns

    last = stages["best-fit packing"](spark, mixed, SF).collect()
    packed = Counter()
    for r in last:
        packed[r["doc_id"]] += r["piece_words"]
    assert packed == {i: n * len(texts[i].encode().split()) for i, n in copies.items()}


def test_pipeline_equals_its_stages(spark):
    docs = documents(spark, SF)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_stages_take_odd_rows_and_empty_tables(spark, docs):
    good = documents(spark, SF).limit(3).collect()
    rows = [*ODD, (None, "word " * 60, None), (70, "very long text " * 20_000), (71, "password: 'abcdefghijklmnop' " * 3, None)]
    rows += [(100 + i, r["text"]) for i, r in enumerate(good)] + [(100, good[0]["text"])] * 3
    for df in (docs(rows), docs(rows).filter("false")):
        at = df
        for name, stage in corpus_pipeline.STAGES[:-1]:
            own = stage(spark, df, SF)
            assert own.columns == df.columns, name
            n = own.count()
            assert n <= 2 * df.count()
            if name == "secret scans":
                assert n == df.count() and own.filter("text like '%abcdefghijklmnop%'").isEmpty()
            if name == "simhash near-dedup":
                assert own.select("doc_id", "text").distinct().count() == n
            at = stage(spark, at, SF)
        packed = corpus_pipeline.STAGES[-1][1](spark, df, SF)
        words = sum(len((t or "").split()) for _, t, *_ in rows)
        assert (packed.agg(F.sum("piece_words")).first()[0] or 0) == (words if df.count() else 0)
        assert corpus_pipeline.STAGES[-1][1](spark, at, SF).count() >= 0
