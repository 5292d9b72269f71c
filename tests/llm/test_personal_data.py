"""Operator 11 against plain regular expressions, planted disguises and odd rows."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cotejo.llm import personal_data
from cotejo.llm.personal_data import KINDS, luhn, spans
from tests.llm.conftest import ODD

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_pattern(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m.group())
            holds = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }
            if holds[kind]:
                out.append((kind, *m.span()))
    return out


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1279.@+- ()%é\n", max_size=60))
def test_base_spans_equal_the_plain_patterns(text):
    assert [s[:3] for s in spans(text) if not s[3]] == by_pattern(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["one", "dot", "at", " ", "[", "]", "(at)", "(dot)", "@", "a", ".", "com", "+", "7", "о", "\u200b", "４", "plus"]), max_size=25))
def test_disguises_never_remove_base_spans(parts):
    text = "".join(parts)
    found = spans(text)
    assert [s[:3] for s in found if not s[3]] == by_pattern(text)
    assert all(0 <= a < b <= len(text) for _, a, b, _ in found)
    assert found == sorted(found, key=lambda s: (KINDS.index(s[0]), *s[1:]))


@pytest.mark.parametrize(
    "kind, disguise",
    [
        ("email", "jоhn.smith@example.com"),  # a Cyrillic letter
        ("email", "john.smith (at) example [dot] com"),
        ("email", "john dot smith at example dot co dot uk"),
        ("email", "john@example dot org"),
        ("email", "j\u200bohn@exa\u200bmple.com"),
        ("email", "user<at>host.example.org"),
        ("email", "ｊｏｈｎ＠ｅｘａｍｐｌｅ．ｃｏｍ"),
        ("ip", "192[.]168[.]1[.]1"),
        ("ip", "192 dot 168 dot one dot 1"),
        ("ip", "１９２．１６８．０．１"),
        ("card", "four one one one - one one one one one one one one one one one one"),
        ("card", "٤١١١ ١١١١ ١١١١ ١١١١"),
        ("card", "4111 eins eins eins eins 1111 1111"),
        ("phone", "plus one five five five 123 four five six seven"),
        ("phone", "＋１（５５５）１２３－４５６７"),
        ("phone", "+34 seis zwei trois 123 456"),
    ],
)
def test_disguised_spans_are_found_at_their_place(kind, disguise):
    text = f"Él dijo: ß {disguise}, y 日本 nada"
    assert (kind, 11, 11 + len(disguise), True) in spans(text)


def test_plain_prose_has_no_spans():
    for text in ("Look at the dot on it.", "She is at home, one of two dot matrix printers.", "il y a plus 5 personnes et un chat", "1 2 3 un dos tres", "point com at dot", "meet at five, six or seven"):
        assert spans(text) == []


def test_times_follow_the_length():
    took = {}
    for n in (40_000, 160_000):
        for unit in ("a@", "1.", "+1 ", "one ", "a dot ", "(at)", "one dot ", "a at b dot ", "a", "1", "＋１"):
            t0 = time.perf_counter()
            spans(unit * n)
            took[unit, n] = time.perf_counter() - t0
    for unit in {u for u, _ in took}:
        assert took[unit, 160_000] < 12 * took[unit, 40_000] + 0.5


def test_query_columns_over_odd_rows(spark, docs):
    rows = [*ODD, (8, "a.b@c.de or x (at) y.org; 10.0.0.1, 4111-1111-1111-1111 and +1 (555) 123-4567"), (8, "a.b@c.de"), (9, "+1 555 123 4567 " * 3000)]
    got = personal_data.digests(personal_data.find(docs(rows))).collect()
    assert len(got) == len(rows)
    want = []
    for doc_id, text in rows:
        base = by_pattern(text or "")
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans(text or ""))
        want.append((doc_id, *(sum(k == s[0] for s in base) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest(), every, sum(s[3] for s in spans(text or ""))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert got[0].asDict().keys() == {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"}


def test_query_equals_plain_patterns_on_a_table(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = personal_data.query(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in by_pattern(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_redaction_keeps_rows_and_columns(spark, docs):
    df = docs([*ODD, (8, "mail a.b@c.de or x (at) y.org!")])
    out = personal_data.redacted(df)
    assert out.columns == df.columns and out.count() == df.count()
    assert out.filter("doc_id = 8").first().text == "mail [EMAIL] or [EMAIL]!"
    assert personal_data.find(docs([]).limit(0)).collect() == []
