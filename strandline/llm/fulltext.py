"""A full-text index over words: backward search in the Burrows-Wheeler transform of some texts."""

from __future__ import annotations

import numpy as np

from strandline.llm.textcodes import first_runs

#: Occurrences that are looked up at once.
_HELD = 1_000_000


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffixes in order, by doubling the length that is compared."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.full(n, 0, np.int64)
        after[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(fresh) - 1
        if fresh.all() or step >= n:
            return order
        step *= 2


class Planes:
    """A sequence of small numbers as bit planes, 64 places to a word, with the ones before each word sampled.

    Each plane holds one bit of every number, the numbers being sorted, stably, by the bits before it: ranks,
    ranges and numbers are read plane by plane. It takes 1.5 bits for each bit of the largest number.
    """

    def __init__(self, x: np.ndarray, top: int):
        self.n, self.bits = len(x), [max(1, int(top).bit_length()) - 1 - k for k in range(max(1, int(top).bit_length()))]
        self.planes, self.sampled, self.zeros = [], [], []
        x = x.astype(np.uint32)
        for k in self.bits:
            bit = (x >> np.uint32(k) & np.uint32(1)).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.concatenate((packed, np.zeros(-len(packed) % 8 + 8, np.uint8))).view("<u8")
            self.planes.append(words)
            self.sampled.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.uint32)))[:-1].astype(np.uint32))
            self.zeros.append(self.n - int(bit.sum()))
            x = np.concatenate((x[~bit], x[bit]))

    def ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """The ones of a plane before each place."""
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        below = self.planes[k][word] & ((np.uint64(1) << inside) - np.uint64(1))
        return self.sampled[k][word].astype(np.int64) + np.bitwise_count(below)

    def follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where each place comes to lie when its prefix is sorted down to the symbol."""
        for k, bit in enumerate(self.bits):
            ones = self.ones(k, at)
            at = np.where(symbol >> bit & 1, self.zeros[k] + ones, at - ones)
        return at

    def values(self, at: np.ndarray) -> np.ndarray:
        """The numbers at the places."""
        out = np.zeros(len(at), np.int64)
        for k, bit in enumerate(self.bits):
            on = (self.planes[k][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            ones = self.ones(k, at)
            out |= on << bit
            at = np.where(on, self.zeros[k] + ones, at - ones)
        return out


class WordIndex:
    """FM-index of texts given as word hashes. The Burrows-Wheeler transform and the text of each suffix are kept
    as bit planes with sampled ranks; what is not kept are the texts, the suffix array and any list of occurrences."""

    def __init__(self, hashes: np.ndarray, offsets: np.ndarray):
        self.words, ids = np.unique(hashes, return_inverse=True)
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        # symbol 0 ends each text
        x = np.zeros(len(hashes) + len(sizes), np.int64)
        x[np.arange(len(hashes)) + owner] = ids + 1
        self.n, self.texts = len(x), len(sizes)
        order = suffix_array(x)
        self.before = Planes(x[order - 1], len(self.words))
        # where each symbol's suffixes begin, and where its places begin in the sorted planes
        self.begins = np.concatenate(([0], np.cumsum(np.bincount(x, minlength=len(self.words) + 1))))
        self.lowest = self.before.follow(np.arange(len(self.words) + 1), np.zeros(len(self.words) + 1, np.int64))
        text_of = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.owners = Planes(text_of[order], max(1, len(sizes) - 1))
        # which suffixes begin with a run of three words that is the first of its kind in its text
        fresh = np.zeros(self.n, bool)
        fresh[np.arange(len(hashes)) + owner] = first_runs(hashes, offsets, 3) > 0
        self.fresh = np.packbits(fresh[order], bitorder="little")

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        """The index's number of each word; -1 for a word it does not hold."""
        if not len(self.words):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at + 1, -1)

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the matches with one more word before them."""
        shift = self.begins[symbol] - self.lowest[symbol]
        return self.before.follow(symbol, low) + shift, self.before.follow(symbol, high) + shift

    def within(self, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many suffixes of an interval are of the given text."""
        return self.owners.follow(text, high) - self.owners.follow(text, low)

    def shared_runs(self, words: np.ndarray, offsets: np.ndarray, first: np.ndarray) -> np.ndarray:
        """A table of queries by texts of the index: how many different three-word runs they share.

        Every run (where first is set) is searched backwards; each text in its interval counts it once.
        """
        out = np.zeros((len(offsets) - 1, self.texts), np.int32)
        at = np.flatnonzero(first)
        query = np.searchsorted(offsets, at, side="right") - 1
        ok, low, high = self.occurs(self.symbols(words), at, np.full(len(at), 3), None)
        query, low, size = query[ok], low[ok], (high - low)[ok]
        cuts = np.searchsorted(np.cumsum(size), np.arange(0, int(size.sum()) + _HELD, _HELD), side="left")
        for a, b in zip(cuts, np.append(cuts[1:], len(size))):
            if a < b:
                n = size[a:b]
                place = np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
                once = (self.fresh[place >> 3] >> (place & 7).astype(np.uint8) & 1).astype(bool)
                np.add.at(out, (np.repeat(query[a:b], n)[once], self.owners.values(place[once])), 1)
        return out

    def occurs(self, symbol: np.ndarray, at: np.ndarray, size: np.ndarray, text: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the words from at on, so many, stand in the text (any text for None), and their intervals."""
        low, high, ok = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64), np.ones(len(at), bool)
        for k in range(int(size.max(initial=0))):
            live = np.flatnonzero(ok & (size > k))
            c = symbol[at[live] + size[live] - 1 - k]
            low[live], high[live] = self.extend(np.maximum(c, 0), low[live], high[live])
            ok[live] = (c > 0) & (low[live] < high[live])
        if text is not None:
            ok[ok] = self.within(text[ok], low[ok], high[ok]) > 0
        return ok, low, high

    def maximal(self, words: np.ndarray, offsets: np.ndarray, query: np.ndarray, text: np.ndarray | None, counts: np.ndarray) -> dict[str, np.ndarray]:
        """All maximal matches of each query with its text (with any text of the index for None); all pairs move in step.

        Each query is read backwards. Where a match cannot take the word before it, it is closed and shortened
        from its right end until it can. Matches of three or more words count; those that overlap are one
        span. Returns for each pair the longest match, the words in spans, the number of spans and, as
        inside, the sum of counts (a number for each word) over the words that begin a three-word run of a match.
        """
        symbol = self.symbols(words)
        before = np.concatenate(([0], np.cumsum(counts)))
        m = len(query)
        # the match is [at + 1, end); words from edge on are in spans, runs from begun on are counted
        at, stop, end = offsets[1:][query] - 1, offsets[:-1][query], offsets[1:][query].copy()
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        edge, begun = end + 1, end.copy()
        covered, longest, spans, inside = (np.zeros(m, np.int64) for _ in range(4))

        def close(i: np.ndarray) -> None:
            i = i[end[i] - at[i] - 1 >= 3]
            first, after = at[i] + 1, end[i]
            longest[i] = np.maximum(longest[i], after - first)
            covered[i] += np.minimum(after, edge[i]) - first
            spans[i] += after <= edge[i]
            inside[i] += before[np.minimum(after - 2, begun[i])] - before[first]
            edge[i] = begun[i] = first

        live = np.flatnonzero(at >= stop)
        while len(live):
            c = symbol[at[live]]
            a, b = self.extend(np.maximum(c, 0), low[live], high[live])
            ok = (c > 0) & (a < b)
            if text is not None:
                ok[ok] = self.within(text[live[ok]], a[ok], b[ok]) > 0
            go, over = live[ok], live[~ok]
            low[go], high[go] = a[ok], b[ok]
            if len(over):
                close(over)
                self._shorten(symbol, at, end, low, high, over, text)
            at[live] -= 1
            done = at[live] < stop[live]
            close(live[done])
            live = live[~done]
        return {"covered": covered, "longest": longest, "spans": spans, "inside": inside}

    def _shorten(self, symbol, at, end, low, high, i, text) -> None:
        """Sets the end and the interval of the longest matches that begin at the words at[i], of no more words
        than the matches behind them: doubled until they fail, then halved."""
        fits, fails = np.zeros(len(i), np.int64), end[i] - at[i]
        failed = np.zeros(len(i), bool)
        low[i], high[i] = 0, self.n
        while len(open_ := np.flatnonzero(fails - fits > 1)):
            f, g = fits[open_], fails[open_]
            size = np.where(failed[open_], (f + g) // 2, np.minimum(np.maximum(1, 2 * f), g - 1))
            ok, a, b = self.occurs(symbol, at[i[open_]], size, None if text is None else text[i[open_]])
            good, bad = open_[ok], open_[~ok]
            fits[good], fails[bad], failed[bad] = size[ok], size[~ok], True
            low[i[good]], high[i[good]] = a[ok], b[ok]
        end[i] = at[i] + fits
