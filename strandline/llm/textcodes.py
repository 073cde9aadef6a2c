"""Texts of an Arrow batch as one array of code points, handled with whole-array operations."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

#: Code points above this are looked up as "no letter"; every script with words lies below it.
LIMIT = 0x30000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)
_BASE = 0x100000001B3


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs on every machine."""
    x = x.astype(np.uint64, copy=True)
    x += _MUL
    x ^= x >> np.uint64(30)
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form, and whether it is a letter or digit."""
    lower, word = np.arange(LIMIT, dtype=np.uint32), np.zeros(LIMIT, dtype=bool)
    for i in range(LIMIT):
        if 0xD800 <= i < 0xE000:
            continue
        c = chr(i)
        if c.isalnum():
            word[i] = True
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
    return lower, word


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, a zero after each text, and where each text begins."""
    sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    points = np.frombuffer(("\0".join(texts) + "\0").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum(sizes)))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased run of letters and digits, in order, and the offsets of each text's words."""
    if not texts:
        return np.empty(0, np.uint64), np.zeros(1, np.int64)
    lower, word = tables()
    points, starts = codes(texts)
    points = np.minimum(points, LIMIT - 1)
    at = np.flatnonzero(word[points])
    if not len(at):
        return np.empty(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.not_equal(at[1:], at[:-1] + 1, out=first[1:])
    begin = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    powers = np.empty(int(place.max()) + 1, np.uint64)
    powers[0] = 1
    with np.errstate(over="ignore"):
        np.multiply.accumulate(np.full(len(powers) - 1, _BASE, np.uint64), out=powers[1:])
        values = (lower[points[at]].astype(np.uint64) + np.uint64(7)) * powers[place]
        hashes = mix(np.add.reduceat(values, begin))
    return hashes, np.searchsorted(at[begin], starts)


def runs(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of n consecutive words (44 bits) and the text it is of."""
    sizes = np.diff(offsets)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    if len(hashes) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    m = len(hashes) - n + 1
    with np.errstate(over="ignore"):
        total = np.zeros(m, np.uint64)
        for k in range(n):
            total = total * _MIX1 + hashes[k : k + m]
        total = mix(total) >> np.uint64(20)
    inside = owner[:m] == owner[n - 1 :]
    return total[inside], owner[:m][inside]


def distinct_runs(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct runs of each text, how often each occurs, and the offsets of each text's runs."""
    return counted_runs(*word_hashes(texts), n)


def counted_runs(hashes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same of texts given as word hashes."""
    value, owner = runs(hashes, offsets, n)
    keys = np.sort(owner.astype(np.uint64) << np.uint64(44) | value)
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    offsets = np.searchsorted(keys, np.arange(len(offsets), dtype=np.uint64) << np.uint64(44))
    return keys & np.uint64((1 << 44) - 1), times, offsets


def first_runs(hashes: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """For each word 1 if the run of n words from it on is inside its text and the first of its kind there, else 0."""
    out = np.zeros(len(hashes), np.int64)
    value, owner = runs(hashes, offsets, n)
    sizes = np.diff(offsets)
    place = np.arange(len(hashes)) - np.repeat(offsets[:-1], sizes)
    begins = np.flatnonzero(place + n <= np.repeat(sizes, sizes))
    out[begins[np.unique(owner.astype(np.uint64) << np.uint64(44) | value, return_index=True)[1]]] = 1
    return out


def chunks(texts: list[str], most: int = 1_500_000):
    """Slices of the list of about so many characters; a longer text is a slice of its own and stays whole."""
    start = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, i
            start, size = i, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def category_table(test) -> np.ndarray:
    """A flag for each code point below LIMIT."""
    out = np.zeros(LIMIT, bool)
    for i in range(LIMIT):
        if not 0xD800 <= i < 0xE000 and test(chr(i), unicodedata.category(chr(i))):
            out[i] = True
    return out
