"""The plain form of a text: no invisible characters, ordinary blanks, ordinary characters for
compatibility forms, composed accents, and in each word the letters of the word's own script.

Look-alike letters are found by a Viterbi search: each word is a lattice of the letters that each of
its characters could stand for; a path is scored by what it changes, by whether it keeps to one script,
and by character bigrams counted over all texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from functools import lru_cache

import numpy as np

from strandline.llm import textcodes

# Letters that look alike, each group one shape; the first is the Latin or Arabic letter.
LOOKALIKES = (
    "aаɑα", "cс", "dԁ", "eе", "gɡ", "hһ", "iіι", "jј", "kκк", "lӏ", "nո", "oоοօ", "pрρ", "qԛ", "sѕ", "uυս", "vνѵ", "wԝ", "xхχ", "yуγ",
    "AАΑ", "BВΒ", "CС", "EЕΕ", "HНΗ", "IІΙӀ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟՕ", "PРΡ", "SЅՏ", "TТΤ", "UՍ", "VѴ", "WԜ", "XХΧ", "YΥҮ", "ZΖ",
    "كک", "يی", "هہ",
)
# Compatibility characters and marks that are already plain.
PLAIN = "…“”‘’„‚‹›«»–—―ـ"
#: Letters that no language of the corpus writes; a word never keeps them, even if all its letters are such,
#: unless it is a word of a language that writes them.
FOREIGN = "ɑɡօոսՕՏՍکیہ"
# Letters of Arabic script that Arabic does not write and that look like none of its own.
PERSIAN = "پچژگٹڈڑںےۓ"
#: Costs of a path: a changed letter, a change of script inside a word.
CHANGED, SWITCHED = 1.0, 6.0


def script(c: str) -> int:
    """0 for what is no letter; 1 Latin, 2 Greek, 3 Cyrillic, 4 Arabic, 5 Armenian, 6 any other."""
    o = ord(c)
    if not c.isalpha():
        return 0
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or o in (0x251, 0x261):
        return 1
    if 0x370 <= o < 0x400 or 0x1F00 <= o < 0x2000:
        return 2
    if 0x400 <= o < 0x530:
        return 3
    if 0x600 <= o < 0x780 or 0x8A0 <= o < 0x900:
        return 4
    if 0x530 <= o < 0x590:
        return 5
    return 6


@lru_cache(maxsize=1)
def _choices() -> dict[str, str]:
    out: dict[str, str] = {}
    for group in LOOKALIKES:
        for c in group:
            out[c] = "".join(dict.fromkeys(out.get(c, c) + group))
    return out


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code points that are never plain or need a closer look, and the script of each letter."""
    keep = set(PLAIN)

    def odd(c: str, kind: str) -> bool:
        if c in keep or c in "\t\n\r ":
            return False
        if c in FOREIGN or kind in ("Cf", "Zs", "Zl", "Zp") or _ignorable(c):
            return True
        if kind == "Mn" and not 0x64B <= ord(c) <= 0x652 and ord(c) != 0x670:
            return True
        return unicodedata.normalize("NFKC", c) != c

    scripts = np.zeros(textcodes.LIMIT, np.uint8)
    for i in range(0x41, textcodes.LIMIT):
        if not 0xD800 <= i < 0xE000 and chr(i).isalpha():
            scripts[i] = script(chr(i))
    return textcodes.category_table(odd), scripts


def _ignorable(c: str) -> bool:
    o = ord(c)
    return o in (0xAD, 0x34F, 0x61C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0) or 0x180B <= o <= 0x180F or 0x200B <= o <= 0x200F or 0x202A <= o <= 0x202E or 0x2060 <= o <= 0x206F or o == 0xFEFF or 0xFE00 <= o <= 0xFE0F


def suspicious(texts: list[str]) -> np.ndarray:
    """Whether a text may not be plain: it has an odd code point, or neighbouring letters of two scripts."""
    out = np.zeros(len(texts), bool)
    odd, scripts = _tables()
    for a, b in textcodes.chunks(texts):
        points, starts = textcodes.codes(texts[a:b])
        points = np.minimum(points, textcodes.LIMIT - 1)
        s = scripts[points]
        bad = odd[points]
        bad[1:] |= (s[1:] != s[:-1]) & (s[1:] > 0) & (s[:-1] > 0)
        out[a:b] = np.add.reduceat(bad, starts[:-1], dtype=np.int64) > 0
    return out


class _Ordinary(dict):
    """What each character becomes before accents are composed: nothing if it is ignorable, a blank for
    any blank, its compatibility form otherwise; worked out once for each character that is met."""

    def __missing__(self, o: int) -> str:
        c = chr(o)
        if c in PLAIN or o < 0x7F:
            out = c
        elif _ignorable(c) or unicodedata.category(c) == "Cf":
            out = ""
        elif unicodedata.category(c) in ("Zs", "Zl", "Zp"):
            out = " "
        else:
            # isolated forms of vowel marks have a blank before them, which is no part of the text
            n = unicodedata.normalize("NFKC", c)
            out = n.lstrip(" ") if len(n) > 1 and n[0] == " " else n
        self[o] = out
        return out


_ORDINARY = _Ordinary()


def _compatible(text: str) -> str:
    """Deletes what is ignorable, makes blanks ordinary, expands compatibility forms and composes accents.
    Marks in another order than the canonical one are left as they are."""
    return _CLUSTER.sub(_composed, text.translate(_ORDINARY))


_CLUSTER = re.compile(r"[^\W\d_][̀-ًͯ-ٰٟ]+")
_WORD = re.compile(r"[^\W\d_](?:[^\W\d_]|[̀-ًͯ-ٰٟ])*")


def _composed(m: re.Match) -> str:
    done = unicodedata.normalize("NFC", m[0])
    return m[0] if sorted(done) == sorted(m[0]) else done


@lru_cache(maxsize=1)
def _flat() -> dict[tuple[str, str], float]:
    return {}


def respell(word: str, bigrams: dict[tuple[str, str], float] | None = None) -> str:
    """The word in the letters of one script where its characters allow that.

    A word wholly in one script stays as it is, as does a single letter. bigrams: log-likelihoods of
    letter pairs ("^" and "$" are the word's edges); without them only script and number of changes count.
    """
    letters = [c for c in word if script(c)]
    kinds = {script(c) for c in letters}
    if len(kinds) == 1 and not any(c in FOREIGN for c in letters):
        return word
    if len(letters) == 1 and letters[0] not in FOREIGN:
        return word
    # words of Armenian, and of Persian or Urdu, are words wholly in another script
    if len(letters) > 1 and kinds == {5} or kinds == {4} and any(c in PERSIAN for c in letters):
        return word
    options, scores = _choices(), bigrams if bigrams is not None else _flat()
    floor = min(scores.values(), default=0.0) - 1 if scores else 0.0
    # state: (letter, script of the path so far); value: (cost, path)
    states: dict[tuple[str, int], tuple[float, str]] = {("^", 0): (0.0, "")}
    for c in word:
        nxt: dict[tuple[str, int], tuple[float, str]] = {}
        for x in options.get(c, c):
            kind = script(x)
            cost = 0.0 if x == c else CHANGED
            if x in FOREIGN:
                cost += 2 * SWITCHED
            for (last, now), (value, path) in states.items():
                total = value + cost
                if kind and now and kind != now:
                    total += SWITCHED
                if scores:
                    total -= 0.1 * scores.get((last.lower(), x.lower()), floor)
                key = (x, kind or now)
                if key not in nxt or (total, path + x) < nxt[key]:
                    nxt[key] = (total, path + x)
        states = nxt
    if scores:
        return min((v - 0.1 * scores.get((k[0].lower(), "$"), floor), p) for k, (v, p) in states.items())[1]
    return min(states.values())[1]


def plain(text: str, bigrams: dict[tuple[str, str], float] | None = None, known: dict[str, str] | None = None) -> str:
    """The plain form of one text. known keeps the words that were respelled, for the texts after it."""
    known = {} if known is None else known

    def word(m: re.Match) -> str:
        w = m[0]
        if w.isascii():
            return w
        if w not in known:
            known[w] = respell(w, bigrams)
        return known[w]

    return _WORD.sub(word, _compatible(text))


def plain_all(texts: list[str], bigrams: dict[tuple[str, str], float] | None = None) -> list[str]:
    """The plain forms; texts that a look at their code points shows to be plain are not touched."""
    out, known = list(texts), {}
    for i in np.flatnonzero(suspicious(texts)):
        out[i] = plain(texts[i], bigrams, known)
    return out


def letter_pairs(texts: list[str]) -> dict[tuple[int, int], int]:
    """How often each pair of neighbouring letters of one script occurs; 94 and 36 are the edges of words."""
    _, scripts = _tables()
    lower, _ = textcodes.tables()
    total: dict[tuple[int, int], int] = {}
    for a, b in textcodes.chunks(texts):
        points, _ = textcodes.codes(texts[a:b])
        points = np.minimum(points, textcodes.LIMIT - 1)
        points = np.concatenate(([0], points))
        s = scripts[points]
        low = lower[points].astype(np.int64)
        one = (s > 0) & (s < 6)
        left, right = one[:-1], one[1:]
        same = left & right & (s[:-1] == s[1:])
        opens, closes = ~left & right, left & ~right
        keys = np.concatenate((low[:-1][same] << 20 | low[1:][same], 94 << 20 | low[1:][opens], low[:-1][closes] << 20 | 36))
        for k, n in zip(*np.unique(keys, return_counts=True)):
            pair = (int(k) >> 20, int(k) & 0xFFFFF)
            total[pair] = total.get(pair, 0) + int(n)
    return total


def log_scores(counts: list[tuple[int, int, int]]) -> dict[tuple[str, str], float]:
    """Counts of letter pairs as logarithms of the second letter's share after the first."""
    base: dict[int, int] = {}
    for a, _, n in counts:
        base[a] = base.get(a, 0) + n
    return {(chr(a), chr(b)): math.log(n / base[a]) for a, b, n in counts}
