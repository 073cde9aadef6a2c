import re
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandline.llm import sketch, textcodes
from strandline.llm.fulltext import Planes, WordIndex, suffix_array
from strandline.llm.plain import plain, plain_all, suspicious

WORDS = re.compile(r"[^\W_]+")


@pytest.mark.parametrize("dirty, clean", [
    ("Deѕаlinatiоn Unit", "Desalination Unit"), ("Αldοria", "Aldoria"), ("Oкрим Завод", "Окрим Завод"), ("Halvane Bօrder", "Halvane Border"),
    ("sepɑrɑte ɡate", "separate gate"), ("ｆｕｌｌ　ｗｉｄｔｈ", "full width"), ("oﬀicial ﬁeld", "official field"), ("café", "café"), ("zero​width⁠ joiner﻿", "zerowidth joiner"),
    ("no break thin", "no break thin"), ("soft­hyphen", "softhyphen"), ("حکومة تخطیط", "حكومة تخطيط"), ("ﻻﻷ", "لالأ"), ("أحمد", "أحمد"),
])
def test_plain_forms(dirty, clean):
    assert plain(dirty) == clean
    assert suspicious([dirty])[0]
    assert plain(clean) == clean


@pytest.mark.parametrize("text", ["Бюро Верея", "α-band receiver", "“quoted” — it’s…", "مُقدَّم الــميناء", "Véloria Łuskania Möwe", "⌀ 5", "a\r\nb\tc", ""])
def test_already_plain(text):
    assert plain(text) == text and plain_all([text]) == [text]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(blacklist_categories=("Cs",), max_codepoint=0x2FFF), max_size=30))
def test_plain_is_idempotent_and_untouched_texts_are_plain(text):
    once = plain(text)
    assert plain(once) == once
    if not suspicious([text])[0]:
        assert once == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab é,._١م", max_size=25), max_size=6))
def test_runs_equal_those_of_a_regex(texts):
    found, times, offsets = textcodes.distinct_runs(texts, 3)
    for i, t in enumerate(texts):
        w = WORDS.findall(t.lower())
        grams = [tuple(w[j : j + 3]) for j in range(len(w) - 2)]
        assert offsets[i + 1] - offsets[i] == len(set(grams))
        assert times[offsets[i] : offsets[i + 1]].sum() == len(grams)
    # equal texts have equal runs, whatever stands beside them
    again, _, o = textcodes.distinct_runs([*texts, *texts], 3)
    n = len(texts)
    for i in range(n):
        assert (again[o[i] : o[i + 1]] == again[o[n + i] : o[n + i + 1]]).all()


def test_chunks_keep_texts_whole():
    texts = ["a" * 5, "", "b" * 100, "c"]
    got = [texts[a:b] for a, b in textcodes.chunks(texts, 8)]
    assert [t for g in got for t in g] == texts and ["b" * 100] in got


def test_samples_agree_as_often_as_weighted_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**44, 400).astype(np.uint64))
    b = np.sort(np.concatenate((a[:300], np.unique(rng.integers(0, 2**44, 100).astype(np.uint64)))))
    weight = lambda s: 1.0 + (s % np.uint64(7)).astype(float)
    k = 2000
    s = sketch.samples(np.concatenate((a, b)), np.concatenate((weight(a), weight(b))), np.array([0, len(a), len(a) + len(b), len(a) + len(b)]), k)
    both = np.intersect1d(a, b)
    want = weight(both).sum() / (weight(a).sum() + weight(b).sum() - weight(both).sum())
    assert abs((s[0] == s[1]).mean() - want) < 0.04
    assert not s[2].any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40))
def test_suffix_array(x):
    x = np.array(x)
    assert suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 9), max_size=150), st.integers(0, 9))
def test_planes_rank_and_read(x, symbol):
    planes = Planes(np.array(x, np.int64), 9)
    at = np.arange(len(x) + 1)
    got = planes.follow(np.full(len(at), symbol), at) - planes.follow(np.array([symbol]), np.array([0]))
    assert got.tolist() == [x[:i].count(symbol) for i in at]
    assert planes.values(at[:-1]).tolist() == x


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcd"), max_size=12), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("abcde"), max_size=14), min_size=1, max_size=3))
def test_shared_runs_against_brute_force(texts, queries):
    runs = lambda t: {tuple(t[i : i + 3]) for i in range(len(t) - 2)}
    index = WordIndex(*textcodes.word_hashes([" ".join(t) for t in texts]))
    words, offsets = textcodes.word_hashes([" ".join(q) for q in queries])
    got = index.shared_runs(words, offsets, textcodes.first_runs(words, offsets, 3))
    assert got.tolist() == [[len(runs(q) & runs(t)) for t in texts] for q in queries]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=14), min_size=1, max_size=4), st.lists(st.sampled_from("abcdef"), max_size=16))
def test_maximal_matches_against_brute_force(texts, query):
    index = WordIndex(*textcodes.word_hashes([" ".join(t) for t in texts]))
    words, offsets = textcodes.word_hashes([" ".join(query)])
    runs = [tuple(query[i : i + 3]) for i in range(len(query) - 2)]
    first = np.array([i < len(runs) and runs[i] not in runs[:i] for i in range(len(query))], np.int64)
    got = index.maximal(words, offsets, np.zeros(len(texts), np.int64), np.arange(len(texts)), first)
    for k, t in enumerate(texts):
        held = {tuple(t[i:j]) for i in range(len(t)) for j in range(i + 3, len(t) + 1)}
        found = [(i, j) for i in range(len(query)) for j in range(i + 3, len(query) + 1) if tuple(query[i:j]) in held]
        most = [(i, j) for i, j in found if not any(x <= i and j <= y and (x, y) != (i, j) for x, y in found)]
        spans = sum(not any(x < i < y for x, y in most) for i, _ in most)
        want = (len({p for i, j in most for p in range(i, j)}), max((j - i for i, j in most), default=0), spans, len({r for r in runs if r in held}))
        assert tuple(got[n][k] for n in ("covered", "longest", "spans", "inside")) == want


def test_maximal_matches_may_overlap():
    index = WordIndex(*textcodes.word_hashes(["c d e x a b c d"]))
    words, offsets = textcodes.word_hashes(["a b c d e"])
    got = index.maximal(words, offsets, np.zeros(1, np.int64), np.zeros(1, np.int64), np.ones(5, np.int64))
    assert {k: int(v[0]) for k, v in got.items()} == {"covered": 5, "longest": 4, "spans": 1, "inside": 3}


def test_lookalikes_cover_only_letters():
    from strandline.llm.plain import LOOKALIKES

    assert all(unicodedata.category(c)[0] == "L" for g in LOOKALIKES for c in g)


def test_words_of_other_languages_stay():
    from strandline.llm.plain import plain

    assert plain("Սոսո") == "Սոսո" and plain("پک") == "پک" and plain("گیاہ") == "گیاہ"
    assert plain("کتاب") == "كتاب" and plain("pօrt") == "port"


def test_letter_pairs_tell_two_scripts_apart():
    """One letter of each script: either reading changes one letter, and only the pairs' scores differ."""
    from strandline.llm.plain import letter_pairs, log_scores, respell

    word = "рo"  # a Cyrillic letter, then a Latin one
    for corpus, want in ((["po pot pod"] * 50 + ["ра на"], "po"), (["ро род рот"] * 50 + ["pa na"], "ро")):
        assert respell(word, log_scores([(a, b, n) for (a, b), n in sorted(letter_pairs(corpus).items())])) == want
