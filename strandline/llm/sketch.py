"""Improved consistent weighted sampling over TF-IDF shingles, and the counts behind its weights."""

from __future__ import annotations

import numpy as np

from strandline.llm.textcodes import mix

#: Cells of the document-frequency table: its size is fixed, whatever the number of texts.
CELLS = 1 << 20


def cell(shingles: np.ndarray) -> np.ndarray:
    return (mix(shingles ^ np.uint64(0xD1F)) & np.uint64(CELLS - 1)).astype(np.int64)


def idf(frequency: np.ndarray, texts: int) -> np.ndarray:
    """ln((1 + N) / (1 + df)) + 0.05, so that a shingle of every text still counts a little."""
    return np.log((1.0 + texts) / (1.0 + np.minimum(frequency, texts))) + 0.05


#: Samples drawn at once, and shingles looked up at once.
_BLOCK, _SLICE = 8, 100_000
_HALF = np.uint64(0xFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """32-bit numbers as floats inside (0, 1)."""
    return x.astype(np.float64) * 2.0**-32 + 2.0**-33


def samples(shingles: np.ndarray, weights: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """k consistent weighted samples of each text, as 32-bit numbers; texts without shingles get zeros.

    The sample of two texts agrees with a probability that is their weighted Jaccard similarity. What
    identifies a sample, the shingle and its quantised weight, is the least value itself: it is a
    function of both. Variates are drawn once for each distinct (shingle, weight) of the batch.
    """
    n = len(offsets) - 1
    out = np.zeros((n, k), np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    order = np.argsort(shingles, kind="stable")
    s, w = shingles[order], weights[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (w[1:] != w[:-1])
    index = np.empty(len(s), np.int64)
    index[order] = np.cumsum(new) - 1
    s, logw = s[new], np.log(w[new])
    ends = offsets[1:][full]
    begin = offsets[:-1][full]
    cuts = [0, *np.unique(np.searchsorted(ends, np.arange(_SLICE, ends[-1] + _SLICE, _SLICE), side="right")), len(full)]
    for j0 in range(0, k, _BLOCK):
        js = range(j0, min(k, j0 + _BLOCK))
        least = np.empty((len(s), len(js)), np.float32)
        for j in js:
            x = mix(s ^ np.uint64((j + 1) * 0x5851F42D4C957F2D & (2**64 - 1)))
            y = x * np.uint64(0xD6E8FEB86659FD93)
            y ^= y >> np.uint64(32)
            y *= np.uint64(0xD6E8FEB86659FD93)
            y ^= y >> np.uint64(32)
            r = -np.log(_unit(x >> np.uint64(32)) * _unit(x & _HALF))
            c = -np.log(_unit(y >> np.uint64(32)) * _unit(y & _HALF))
            beta = _unit((x ^ y * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32))
            least[:, j - j0] = np.log(c) - r * (np.floor(logw / r + beta) - beta) - r
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                part = np.take(least, index[begin[a] : ends[b - 1]], axis=0)
                out[full[a:b], j0 : j0 + len(js)] = np.minimum.reduceat(part, begin[a:b] - begin[a], axis=0).view(np.uint32)
    return out


def equal_samples(shingles: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """k consistent samples of each text with all weights equal: with one weight, the least hash is the sample.

    The sample of two texts agrees with a probability that is their plain Jaccard similarity. Texts without
    shingles get zeros.
    """
    out = np.zeros((len(offsets) - 1, k), np.uint32)
    full = np.flatnonzero(np.diff(offsets) > 0)
    if not len(full):
        return out
    # shingles are hashes, so that an odd multiple's upper half is a hash again
    begin = offsets[:-1][full]
    with np.errstate(over="ignore"):
        for j in range(k):
            odd = mix(np.uint64([j + 0x2545F491]))[0] | np.uint64(1)
            out[full, j] = np.minimum.reduceat((shingles * odd >> np.uint64(32)).astype(np.uint32), begin)
    return out


def band_keys(samples_: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key for each band of so many samples."""
    with np.errstate(over="ignore"):
        keys = np.empty((len(samples_), bands), np.uint64)
        for b in range(bands):
            x = np.full(len(samples_), b + 1, np.uint64)
            for r in range(rows):
                x = mix(x * np.uint64(31) ^ samples_[:, b * rows + r].astype(np.uint64))
            keys[:, b] = x
    return keys
