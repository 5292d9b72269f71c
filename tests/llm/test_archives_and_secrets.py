"""Operators 4, 6."""

import hashlib
import re

import zstandard

from cotejo.llm import bundles, secret_scan
from cotejo.llm.common import new_folder

from .conftest import ODD
from .sql import same

SF = "/root/testdata/sf0.001"
PATTERNS = [
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]
SECRETS = ODD + [
    (10, "Password: 'abcdefghijkl' and token: secret: abcdefghijklmnop"),
    (11, "AKIAAKIAABCDEFGHIJ AKIA12 xAKIAABCDEFGHIJKLMN"),
    (12, "日本 api_key=0123456789abcdef0123 \U0001f600 0123456789abcde 0123456789abcdef0"),
    (13, "TOKEN = short passwd=\"x\" secret:AAAAAAAAAAAAAAAA-----BEGIN RSA PRIVATE KEY-----"),
    (14, "0123456789abcdef " * 400),
    (15, "Password: 'abcdefghijkl' and token: secret: abcdefghijklmnop"),
]


def base(text):
    spans, count = [], []
    for k, (_, p, g, least) in enumerate(PATTERNS):
        found = [(m.start(), k, m.end()) for m in p.finditer(text or "") if len(m.group(g)) >= least]
        count.append(len(found))
        spans += found
    told = ",".join(f"{PATTERNS[k][0]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*count, hashlib.sha256(told.encode()).hexdigest())


def test_spans_equal_brute_force(docs, spark):
    got = secret_scan.scanned(docs(SECRETS), secret_scan.Ledger(spark, new_folder(spark, "ledger"))).collect()
    assert len(got) == len(SECRETS)
    want = {}
    for i, t in SECRETS:
        want.setdefault(i, set()).add(base(t))
    assert all((r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) in want[r["doc_id"]] for r in got)
    assert any("private_key" in r["spans"] for r in got)


def test_ledger_scans_unseen_pairs_only(docs, spark):
    folder = new_folder(spark, "ledger")
    first = secret_scan.Ledger(spark, folder)
    a = sorted(map(tuple, secret_scan.scanned(docs(SECRETS[:14]), first).collect()), key=repr)
    pairs = first._seen().count()
    blobs = len({t or "" for _, t in SECRETS[:14]})
    assert pairs == blobs * len(secret_scan.RULES)
    both = sorted(map(tuple, secret_scan.scanned(docs(SECRETS[:14]), first).collect()), key=repr)
    assert both == a and first._seen().count() == pairs  # nothing is scanned again
    newer = secret_scan.Ledger(spark, folder, (secret_scan.RULES[0], secret_scan.Rule("hex", r"[0-9a-f]{16,}", version=2)))
    secret_scan.scanned(docs(SECRETS), newer)
    more = {t or "" for _, t in SECRETS[14:]} - {t or "" for _, t in SECRETS[:14]}
    assert newer._seen().count() == pairs + blobs + 2 * len(more)


def test_redacted(docs, spark):
    df = docs(SECRETS)
    got = secret_scan.redacted(df, secret_scan.Ledger(spark, new_folder(spark, "ledger")))
    assert got.columns == df.columns and got.count() == len(SECRETS)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[10] == "[REDACTED]' and token: secret: abcdefghijklmnop" and texts[4] == "one" and texts[1] is None
    assert texts[14] == "[REDACTED] " * 400 and "0123456789abcdef" not in texts[12]
    empty = secret_scan.scanned(df.filter("false"), secret_scan.Ledger(spark, new_folder(spark, "ledger")))
    assert empty.count() == 0


def test_very_many_secrets_in_long_texts(docs, spark):
    import time

    took = {}
    for n in (10_000, 100_000):
        text = "é 0123456789abcdef1 xyz AKIAABCDEFGHIJKLMN token: 'abcdefghijkl'\n" * (n // 3)
        df = docs([(1, text), (2, "x" * 5000 + " 0123456789abcdef0 " + "y" * 9000 + " tail")])
        t0 = time.perf_counter()
        ledger = secret_scan.Ledger(spark, new_folder(spark, "ledger"))
        got = {r["doc_id"]: r["text"] for r in secret_scan.redacted(df, ledger).collect()}
        took[n] = time.perf_counter() - t0
        assert got[1] == "é [REDACTED] xyz [REDACTED] [REDACTED]'\n" * (n // 3)
        assert got[2] == "x" * 5000 + " [REDACTED] " + "y" * 9000 + " tail"
        r = secret_scan.scanned(df.filter("doc_id = 1"), ledger).first()
        assert (r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) == base(text)
    assert took[100_000] < 20 * took[10_000] + 5


PAGES = [(1, "http://a b\r\nX: y", "<p>one</p>"), (2, None, "<p>one</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n" * 50), (5, "u", "twice"), (5, "u", "twice"), (None, "n", "<p>one</p>"), (9, "n", "x" * 5000)]


def test_archive_round_trip(spark):
    folder = new_folder(spark, "archives")
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").selectExpr("*", "'s' AS sha", "1 AS first")
    made = bundles.write_bundles(df, folder, frame=200, bundle=600)
    got = bundles.read_bundles(made).collect()
    assert len(got) == len(PAGES)
    payload = {1: b"<p>one</p>", 3: b"", 9: b"x" * 5000}
    for r in got:
        if r["page_id"] in payload:
            assert r["payload"] == payload[r["page_id"]] and r["payload_bytes"] == len(payload[r["page_id"]]) and r["payload_digest"] == bundles.digest(r["payload"])
    kind = {(r["page_id"], r["payload_digest"]): (r["record_type"], r["refers_to"]) for r in got}
    one, nothing = bundles.digest(b"<p>one</p>"), bundles.digest(b"")
    assert kind[1, one] == ("response", None) and kind[2, one] == ("revisit", 1) and kind[None, one] == ("revisit", 1)
    assert kind[3, nothing] == ("response", None) and kind[4, nothing] == ("revisit", 3)
    every = bundles.read_bundles(bundles.write_bundles(df, new_folder(spark, "archives"), least=10**6)).collect()
    assert all(r["record_type"] == "response" for r in every)
    assert bundles.read_bundles(bundles.write_bundles(df.filter("false"), new_folder(spark, "archives"))).count() == 0


def test_one_record_by_identifier(tmp_path):
    writer = bundles.Writer(str(tmp_path), frame=300)
    for i in range(20):
        writer.add(bundles.record_id(i), bundles.record(i, f"http://x/{i}", b"page %d" % i * 9, None, False))
    writer.close()
    (path, size, frames, records) = writer.done[0]
    raw = (tmp_path / path.rsplit("/", 1)[1]).read_bytes()
    assert len(raw) == size and frames > 3 and records == 20
    bundle = bundles.Bundle(path)
    head, http, payload = bundle.record(bundles.record_id(13))
    assert payload == b"page 13" * 9 and head["warc-target-uri"] == "http://x/13" and http["content-type"].startswith("text/html")
    whole = b"".join(bundle.contents())
    assert zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read() == whole  # any reader skips index and seek table
    bundle.close()


def test_repeated_identifiers_and_reading_tasks(spark, tmp_path):
    writer = bundles.Writer(str(tmp_path), frame=300)
    for i in (7, 8, 7, 9, 7):
        writer.add(bundles.record_id(i), bundles.record(i, f"http://x/{i}", b"page %d" % i * 30, None, False))
    writer.close()
    bundle = bundles.Bundle(writer.done[0][0])
    assert len(bundle.records(bundles.record_id(7))) == 3 and len(bundle.records(bundles.record_id(8))) == 1 and bundle.records("none") == []
    assert [len(x) for x in bundle.index().values()] == [3, 1, 1]
    bundle.close()
    many = spark.createDataFrame([(i, "u", "x" * 2000 + str(i)) for i in range(300)], "page_id long, url string, html string").repartition(3)
    made = bundles.write_bundles(many, new_folder(spark, "archives"), frame=2000, bundle=2000)
    read = bundles.read_bundles(made)
    assert made.count() > 20 and read.rdd.getNumPartitions() == made.count()
    assert read.selectExpr("page_id").distinct().count() == 300


def test_archives_equal_sql(spark):
    same(spark, bundles.query, bundles.SQL, SF)
