"""Anchors of equal windows, as numpy kernels over the UTF-8 buffer of many texts.

A window is ``length`` consecutive units (words or bytes) of one text.  Its
anchor is the k-gram of units with the smallest hash in it, the leftmost of
equals, so equal windows have equal anchors.  Consecutive windows with equal
anchors, up to ``RUN`` of them, make a segment with all the units that they touch;
every window lies in exactly one.  A segment ``loops`` if it has such an anchor at
more than one place, as in text that repeats itself: only then can two of its
own windows be equal.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
#: A word is hashed as a polynomial modulo two primes: modulo a power of two, long words built by a
#: simple rule collide whatever the base.  Prime, base and a value for each byte.
_PRIMES = [(p, b, np.random.default_rng(b).integers(1, p, 256, dtype=np.uint64)) for p, b in ((2**31 - 1, 1_103_515_245), (2**31 - 19, 48_271_977))]
#: Units that are hashed together; longer texts are cut into overlapping chunks.
CHUNK = 1 << 18
#: Windows of a segment at most.
RUN = 256


def _powers(odd: int, n: int) -> np.ndarray:
    base = np.full(n, odd, np.uint64)
    base[0] = 1
    return np.cumprod(base, dtype=np.uint64)


_TABLES: dict[int, np.ndarray] = {}


def _power(odd: int = _ODD, n: int = 2 * CHUNK) -> np.ndarray:
    """Powers of ``odd``, made once in each task."""
    if len(_TABLES.get(odd, ())) < n:
        _TABLES[odd] = _powers(odd, max(n, 2 * CHUNK))
    return _TABLES[odd]


def _prime_powers(prime: int, base: int, n: int) -> np.ndarray:
    """Powers of ``base`` modulo ``prime``, by doubling, made once in each task."""
    have = _TABLES.get(prime, np.ones(1, np.uint64))
    while len(have) < n:
        have = np.concatenate((have, have * np.uint64(pow(base, len(have), prime)) % np.uint64(prime)))
    _TABLES[prime] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def texts_of(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and where each text begins; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):  # no chunk at all
        column = pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2] if len(column) else None
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), at


@dataclass
class Units:
    """Units of consecutive texts: hash, place of the first and past the last byte, first unit of each text."""

    hashes: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    first: np.ndarray


def byte_units(data: np.ndarray, at: np.ndarray) -> Units:
    span = np.arange(at[0], at[-1], dtype=np.int64)
    return Units(_BYTE[data[at[0] : at[-1]]], span, span + 1, at - at[0])


def word_units(data: np.ndarray, at: np.ndarray) -> Units:
    part = data[at[0] : at[-1]]
    n = len(part)
    if n == 0:
        none = np.zeros(0, np.int64)
        return Units(np.zeros(0, np.uint64), none, none, np.zeros(len(at), np.int64))
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[at - at[0]] = True
    in_word = ~_SEPARATOR[part]
    opens = in_word.copy()
    opens[1:] &= ~in_word[:-1] | edge[1:n]
    closes = in_word.copy()
    closes[:-1] &= ~in_word[1:] | edge[1:n]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if len(begin):
        longest = int((end - begin).max())
        inside = np.arange(n) - begin[np.maximum(np.cumsum(opens) - 1, 0)]
        inside[~in_word] = 0
        inside, both = np.maximum(inside, 0), []
        for prime, base, table in _PRIMES:
            value = np.where(in_word, table[part], np.uint64(0))
            value *= _prime_powers(prime, base, longest)[inside]
            value %= np.uint64(prime)
            both.append(np.add.reduceat(value, begin) % np.uint64(prime))
        hashes = mix((both[0] << np.uint64(32) | both[1]) + (end - begin).astype(np.uint64) * np.uint64(_ODD))
    else:
        hashes = np.zeros(0, np.uint64)
    return Units(hashes, begin + at[0], end + at[0], np.searchsorted(begin, at - at[0]))


def grams(u: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive units, from hashes of 1, 2, 4, ... units."""
    n, table = len(u) - k + 1, _power()
    total, done, power, size = np.zeros(n, np.uint64), 0, u, 1
    while True:
        if k & size:
            total += power[done : done + n] * table[done]
            done += size
        if 2 * size > k:
            return mix(total)
        power = power[:-size] + power[size:] * table[size]
        size *= 2


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    size, m = 1, x
    while 2 * size <= w:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    return np.minimum(m[: len(x) - w + 1], m[w - size : w - size + len(x) - w + 1]) if size < w else m


def _segments(u: np.ndarray, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Segments of up to 2 * CHUNK units: anchor hash, content hash, first window, windows, loops."""
    n = len(u) - length + 1
    none = np.zeros(0, np.int64)
    nothing = none.view(np.uint64), none.view(np.uint64), none, none, none.astype(bool)
    if n <= 0:
        return nothing
    gram = grams(u, k)
    key = (gram & _HIGH) | np.arange(len(gram), dtype=np.uint64)
    place = (window_minimum(key, length - k + 1) & _LOW).astype(np.int64)
    whole = np.ones(n, bool)  # windows that do not reach into the next text
    for f in first[1:]:
        whole[max(f - length + 1, 0) : f] = False
    starts = np.flatnonzero(whole)
    if not len(starts):
        return nothing
    place = place[starts]
    apart = np.concatenate(([True], starts[1:] != starts[:-1] + 1))
    moves = np.concatenate(([True], place[1:] != place[:-1]))
    moves[1:] |= apart[1:]
    other = apart.copy()
    other[1:] |= gram[place[1:]] != gram[place[:-1]]
    run = np.flatnonzero(other)
    windows = np.diff(np.append(run, len(starts)))
    loops = np.add.reduceat(moves.astype(np.int64), run) > 1
    parts = -(-windows // RUN)  # a longer run is cut after every RUN windows
    of = np.repeat(np.arange(len(run)), parts)
    skipped = (np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)) * RUN
    head = run[of] + skipped
    count = np.minimum(windows[of] - skipped, RUN)
    a = starts[head]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(u) * _power()[: len(u)], dtype=np.uint64)))
    content = mix((total[a + count + length - 1] - total[a]) * _power(pow(_ODD, -1, 2**64))[a] + count.astype(np.uint64))
    return gram[place[head]], content, a, count, loops[of]


def segments(units: Units, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Segments of consecutive texts: text number, anchor hash, content hash, first window in its text, windows, loops.

    Texts are taken together up to CHUNK units; a longer one is cut into chunks
    that overlap by a window less one unit, so every window is in one chunk.
    """
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    first, t, n_texts = units.first, 0, len(units.first) - 1
    while t < n_texts:
        last = max(t + 1, int(np.searchsorted(first, first[t] + CHUNK, "right")) - 1)
        lo, hi = int(first[t]), int(first[last])
        for at in range(lo, max(hi, lo + 1), CHUNK):
            upto = min(hi, at + CHUNK + length - 1)
            edges = first[t : last + 1] - at if last > t + 1 else np.array([0, upto - at])
            anchor, content, a, count, loops = _segments(units.hashes[at:upto], edges, length, k)
            owner = np.searchsorted(first[t + 1 : last + 1], a + at, "right") + t
            for x, y in zip(out, (owner, anchor, content, a + at - first[owner], count, loops)):
                x.append(y)
        t = last
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def pieces(at: np.ndarray, most: int = 1 << 21) -> list[tuple[int, int]]:
    """Ranges of texts of up to ``most`` bytes together, or one longer text."""
    out, t, n = [], 0, len(at) - 1
    while t < n:
        last = min(n, max(t + 1, int(np.searchsorted(at, at[t] + most, "right")) - 1))
        out.append((t, last))
        t = last
    return out


def covered(n_units: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Which units lie in one of the ranges [lo, hi)."""
    step = np.zeros(n_units + 1, np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    return np.cumsum(step[:-1]) > 0
