"""Operators 1 and 5 against brute force."""

import dataclasses
import hashlib
import random

import numpy as np
import pytest

from cotejo.llm import anchors, substring_dedup, suffix_dedup

from .conftest import ODD


def brute(rows, length, units, join):
    """Per distinct (doc_id, text): units, covered units, digest of the rest."""
    seen, out = set(), {}
    for key in sorted({(i, t) for i, t in rows}, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = units(key[1] or "")
        gone = [False] * len(w)
        for a in range(len(w) - length + 1):
            window = tuple(w[a : a + length])
            if window in seen:
                gone[a : a + length] = [True] * length
            seen.add(window)
        kept = join([x for x, g in zip(w, gone) if not g])
        spans = sum(g and not p for p, g in zip([False, *gone], gone))
        out[key] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), spans)
    return out


CASES = [(substring_dedup, lambda t: t.encode().split(), b" ".join, "n_words"), (suffix_dedup, lambda t: list(t.encode()), bytes, "n_bytes")]


def texts():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        words = [rng.choice("abc" if rng.random() < 0.5 else "abcdefgh") for _ in range(rng.choice([0, 1, 7, 40]))]
        if rng.random() < 0.3:
            words = rng.sample("abcde", rng.choice([1, 2, 3])) * rng.choice([3, 20, 60])
        rows.append((10 + i, (" é\n" if rng.random() < 0.1 else "") + " ".join(words)))
    return rows


@pytest.mark.parametrize("hot", [1000, 2])
@pytest.mark.parametrize("module, units, join, total", CASES)
def test_equals_brute_force(docs, monkeypatch, module, units, join, total, hot):
    length, k = (6, 2) if module is substring_dedup else (11, 4)
    # Null ids come first and are versions of one document, so only one of them has units here.
    rows = texts() + [r for r in ODD if r[0] is not None] + [(None, "a b c a b c a b c a b c")]
    whole = module.kind
    monkeypatch.setattr(module, "kind", lambda a=length, b=k: dataclasses.replace(whole(a, b), hot=hot))
    got = module.remove_repeats(docs(rows), length, k).collect()
    want = brute(rows, length, units, join)
    assert len(got) == len(rows)
    by_id = {}
    for (i, _), v in want.items():
        by_id.setdefault(i, []).append(v)
    for r in got:
        assert (r[total], r["n_removed"], r["kept_sha256"]) in [v[:3] for v in by_id[r["doc_id"]]]
        if module is suffix_dedup:
            assert (r["n_removed"], r["n_spans"]) in [(v[1], v[3]) for v in by_id[r["doc_id"]]]


@pytest.mark.parametrize("hot", [1000, 2])
def test_copies_with_other_blanks_equal_brute_force(docs, monkeypatch, hot):
    """Line-wrapped, tabbed and double-blank copies: the words are the same, the bytes between them are not."""
    rng = random.Random(6)
    rows = texts()
    for i in range(60):
        words = rng.choice(rows[:120])[1].split()
        a = rng.randrange(len(words) + 1)
        rows.append((1000 + i, "".join(w + rng.choice([" ", "  ", "\n", "\r\n", "\t"]) for w in words[a:] + [f"x{i}"] + words[:a])))
    whole = substring_dedup.kind
    monkeypatch.setattr(substring_dedup, "kind", lambda a=6, b=2: dataclasses.replace(whole(a, b), hot=hot))
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs(rows), 6, 2).collect()}
    want = brute(rows, 6, lambda t: t.encode().split(), b" ".join)
    assert got == {i: v[:3] for (i, _), v in want.items()}


@pytest.mark.parametrize("module", [substring_dedup, suffix_dedup])
def test_empty_table(docs, module):
    assert module.remove_repeats(docs([]).filter("false")).count() == 0


def test_long_text_in_chunks(monkeypatch):
    """Segments of a text cut into chunks hold every window once."""
    monkeypatch.setattr(anchors, "CHUNK", 50)
    monkeypatch.setattr(anchors, "RUN", 8)
    rng = random.Random(1)
    parts = [bytes(rng.choices(b"ab", k=n)) for n in (0, 3, 400, 49, 50, 51, 0, 120)]
    data = np.frombuffer(b"".join(parts), np.uint8)
    at = np.cumsum([0] + [len(p) for p in parts])
    owner, _, _, a, n, _ = anchors.segments(anchors.byte_units(data, at), 10, 4)
    found = sorted((t, w) for t, b, m in zip(owner.tolist(), a.tolist(), n.tolist()) for w in range(b, b + m))
    assert found == [(t, w) for t, p in enumerate(parts) for w in range(len(p) - 9)]


def test_words_end_with_their_text():
    data = np.frombuffer(b"ab cdef\x0bgh \xc2\xa0i", np.uint8)
    units = anchors.word_units(data, np.array([0, 5, 5, len(data)]))
    assert [data[b:e].tobytes() for b, e in zip(units.begin, units.end)] == [b"ab", b"cd", b"ef", b"gh", b"\xc2\xa0i"]
    assert units.first.tolist() == [0, 2, 2, 5]


def test_longest_previous_factor():
    rng = random.Random(2)
    for _ in range(30):
        data = np.array(rng.choices([97, 98], k=60) + [256] + rng.choices([97, 98], k=30), np.int16)
        text = tuple(data.tolist())
        length = rng.choice([1, 3, 7, 12])
        want = [any(text[j : j + length] == text[i : i + length] for j in range(i)) and i + length <= len(text) for i in range(len(text))]
        got = suffix_dedup.reaches(data, length)[: len(text) - length + 1].tolist()
        assert got == want[: len(text) - length + 1]


def test_matching_statistics():
    rng = random.Random(4)
    automaton, before = substring_dedup.Automaton(), []
    for _ in range(20):
        s = rng.choices("ab", k=rng.choice([1, 5, 30]))
        want = []
        for i in range(len(s)):
            best = 0
            for n in range(1, i + 2):
                part = s[i + 1 - n : i + 1]
                own = any(s[j : j + n] == part for j in range(i + 1 - n))
                if own or any(t[j : j + n] == part for t in before for j in range(len(t) - n + 1)):
                    best = n
            want.append(best)
        assert automaton.stream(s) == want
        before.append(s)


@pytest.mark.parametrize("order", [10, 11])
def test_words_that_collide_modulo_powers_of_two_differ(docs, order):
    """The Thue-Morse word and its complement have one polynomial hash modulo 2 ** 64, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(2**order)]
    one, other = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    words = [f"w{i}" for i in range(25)]
    rows = [(1, " ".join(words[:12] + [one] + words[12:])), (2, " ".join(words[:12] + [other] + words[12:])), (3, " ".join(words[:12] + [one] + words[12:]))]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.remove_repeats(docs(rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 26}
    data = np.frombuffer(f"{one} {other}".encode(), np.uint8)
    assert len(set(anchors.word_units(data, np.array([0, len(data)])).hashes.tolist())) == 2


@pytest.mark.parametrize("module, units, join, total", CASES)
def test_many_repeated_rows(spark, docs, module, units, join, total):
    """2000 copies of one row and 1000 of another: notes and segments follow the rows, not their square."""
    one = "the quick brown fox jumps over the lazy dog and runs away from all the others that are here " * 3
    other = "x " + one + " y"
    rows = [(1, one)] * 2000 + [(2, other)] * 1000 + [(3, "other words here")]
    want = {i: v for (i, _), v in brute(rows, *((20,) if module is substring_dedup else (100,)), units, join).items()}
    got = module.remove_repeats(docs(rows)).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r[total], r["n_removed"], r["kept_sha256"]) for r in got} == {(i, *v[:3]) for i, v in want.items()}
    noted = module.repeats.noted(docs(rows), module.kind())
    size = {r["doc_id"]: r["n"] for r in noted.selectExpr("doc_id", "coalesce(size(notes), 0) AS n").distinct().collect()}
    assert max(size.values()) < 1000
