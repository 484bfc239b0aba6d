"""Phrase collocations against counts in plain Python, and the quicksort against sorting."""

import re
from collections import Counter

import numpy as np
import pytest
from cases import EXTRA, collect, docs, rows

from calyx.llm import phrases

COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def brute(given, least, top):
    f, n = Counter(), Counter()
    for _, text, lang, *_ in given:
        lang = "und" if lang is None else lang
        for piece in re.split(rb"[.,;:!?\x0A-\x0D]", (text or "").encode().lower()):
            words = re.findall(rb"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, 5) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                longer[lang, p[i:i + k]] = max(longer[lang, p[i:i + k]], a)
    out = []
    for lang in n:
        each = []
        for (of, p), a in found.items():
            if of == lang and 100 * longer[of, p] < 80 * a:
                score, _, l, r = min((2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
                each.append((-score, -a, b" ".join(p), l, r))
        out += [(lang, i, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(each)[:top], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("least", "top"), [(2, 2000), (3, 25), (30, 2000)])
def test_collocations(spark, least, top):
    assert collect(phrases.collocations(docs(spark), least, top), *COLUMNS) == brute(rows(), least, top)


def test_hot_pairs_and_small_groups(spark, monkeypatch):
    """With pairs routed by all their words, and tasks that hold few entries, counts are the same."""
    given = [(i, f"big deal {'alpha beta'[i % 3:]} x{i % 7}, big deal. new york city hall " * 3, ("en", None)[i % 2], "s", 0, *EXTRA) for i in range(90)] + rows()
    for name, value in (("HOT", 50), ("HELD", 40), ("SMALL", 4), ("GROUP", 64), ("SLICE", 500)):
        monkeypatch.setattr(phrases, name, value)
    assert collect(phrases.collocations(docs(spark, given), 5, 2000), *COLUMNS) == brute(given, 5, 2000)


def test_empty(spark):
    assert phrases.collocations(docs(spark, [])).count() == 0
    assert phrases.collocations(docs(spark, [(1, None, None, None, 0, *EXTRA), (2, "", "en", None, 0, *EXTRA), (None, " . ,", "en", None, 0, *EXTRA)])).count() == 0


@pytest.mark.parametrize("small", [1, 64])
def test_three_way(monkeypatch, small):
    monkeypatch.setattr(phrases, "SMALL", small)
    rng = np.random.default_rng(5)
    words = rng.choice([1, 2, 3, 5, 1 << 63], (2000, 4), p=[0.5, 0.2, 0.15, 0.1, 0.05]).astype(np.uint64)
    size = rng.integers(2, 5, 2000)
    words[np.arange(4) >= size[:, None]] = 0
    count = rng.integers(1, 5, 2000)
    want = Counter()
    for row, n, s in zip(words.tolist(), count.tolist(), size.tolist(), strict=True):
        for k in range(2, s + 1):
            want[tuple(row[:k])] += n
    at, found, a = phrases.three_way(words, count, 30, 30)
    assert {tuple(words[i, :k].tolist()): n for i, k, n in zip(at, found.tolist(), a.tolist(), strict=True)} == {p: n for p, n in want.items() if n >= 30}
    at, found, a = phrases.three_way(words, count, 30, 1)
    assert {tuple(words[i, :k].tolist()): n for i, k, n in zip(at, found.tolist(), a.tolist(), strict=True)} == {p: n for p, n in want.items() if n >= 30 or len(p) < 4}


def test_words_are_told_apart():
    p = phrases.Pieces([b"Ab cd", b"ab. CD\tx\x0by", b""])
    h = p.hashes(0)
    assert p.spelled(np.arange(len(h))).to_pylist() == ["ab", "cd", "ab", "cd", "x", "y"]
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 4
    assert p.piece.tolist()[0] == p.piece.tolist()[1] and len(set(p.piece.tolist())) == 4 and p.text.tolist() == [0, 0, 1, 1, 1, 1]
    assert not set(h.tolist()) & set(p.hashes(1).tolist())
