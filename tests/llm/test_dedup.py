"""Jaccard join, line dedup, substring dedup against brute force."""

import hashlib

import numpy as np
import pytest
from cases import EXTRA, SF, collect, docs, rows, words

from calyx.llm import jaccard_join, line_dedup, queries, substring_dedup
from calyx.llm.components import components
from calyx.llm.words import Words


def brute_groups(given, n, percent):
    """(doc_id, set size, smallest reachable id) by comparing all pairs."""
    sets = []
    for doc_id, text in given:
        w = words(text, lower=True)
        sets.append(set() if doc_id is None else {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    group = list(range(len(given)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(given)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                group[top(i)] = top(j)
    least = {}
    for i, (doc_id, _) in enumerate(given):
        if sets[i]:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    size = [len({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else ()) for w in (words(t, lower=True) for _, t in given)]
    return sorted(((d, size[i], least[top(i)] if sets[i] else d) for i, (d, _) in enumerate(given)), key=repr)


def table_rows(spark, sf=SF):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("n,percent", [(4, 85), (1, 50), (5, 80)])
def test_groups(spark, n, percent):
    got = jaccard_join.jaccard_groups(docs(spark), n, percent)
    assert collect(got, "doc_id", "n_shingles", "component_id") == brute_groups([(r[0], r[1]) for r in rows()], n, percent)


def test_groups_query(spark):
    got = queries.op2_jaccard_join(spark, SF)
    assert collect(got, "doc_id", "n_shingles", "component_id") == brute_groups(table_rows(spark), 4, 85)


def chains():
    """Documents that drift word by word, so that a group's ends don't link and leaders alone would miss links."""
    rng, out = np.random.default_rng(3), []
    for c in range(6):
        w = [f"w{x}" for x in rng.integers(0, 5000, 60)]
        for step in range(25):
            out.append((len(out), " ".join(w)))
            w = w[int(rng.integers(1, 3)):] + [f"n{c}_{step}_{i}" for i in range(int(rng.integers(1, 3)))]
    return [(i, t, "en", "s", 0, *EXTRA) for i, t in out]


@pytest.mark.parametrize("every", [1, 16])
def test_groups_of_chains(spark, monkeypatch, every):
    monkeypatch.setattr(jaccard_join, "SAMPLE_EVERY", every)
    given = chains()
    got = jaccard_join.jaccard_groups(docs(spark, given), 2, 85)
    assert collect(got, "doc_id", "n_shingles", "component_id") == brute_groups([r[:2] for r in given], 2, 85)


def test_groups_empty(spark):
    assert jaccard_join.jaccard_groups(docs(spark, []), 4, 85).count() == 0


def test_one_of_each_group(spark):
    kept = sorted((r["doc_id"] for r in jaccard_join.one_of_each_group(docs(spark), 5, 80).collect()), key=repr)
    want = {c for _, _, c in brute_groups([(r[0], r[1]) for r in rows()], 5, 80)}
    assert kept == sorted(want, key=repr)


def test_signature_never_understates_overlap():
    rng = np.random.default_rng(5)
    for size in (1, 50, 700, 3000):
        a = rng.integers(0, 1 << 63, size, np.uint64)
        b = np.r_[a[size // 3:], rng.integers(0, 1 << 63, size // 2, np.uint64)]
        apart = jaccard_join.differing_bits(jaccard_join.bitmap(a), jaccard_join.bitmap(b))
        assert apart <= len(np.setxor1d(a, b))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201), (201, 200), (5, 5)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 200: 200, 201: 200}


def test_words_match_split():
    texts = [b"", b" a  b\x0bc ", b"A b", "é日 x".encode(), b"\n", b"same same"]
    got = Words(texts)
    assert got.count.tolist() == [len(t.split()) for t in texts]
    flat = [w for t in texts for w in t.split()]
    assert len(set(got.hash.tolist())) == len(set(flat))
    low = Words(texts, lower=True)
    assert low.hash[low.first[2]] == got.hash[got.first[1]]


def brute_lines(given, min_lines=line_dedup.MIN_LINES, long_line=line_dedup.LONG_LINE):
    """(doc_id, lines, removed, kept digest) by looking up every run of lines."""
    places, out = [], []
    distinct = {(d, t) for d, t in given if t is not None}
    order = sorted(distinct, key=lambda x: (x[0] is not None, x[0] or 0))
    seen_one, seen_run, gone = {}, {}, {}
    for key in order:
        lines = key[1].split("\n")
        seq = [i for i, x in enumerate(lines) if words(x)]
        for p in range(len(seq)):
            one = lines[seq[p]]
            if one in seen_one and len(words(one)) >= long_line:
                gone.setdefault(key, set()).add(seq[p])
            seen_one.setdefault(one, 1)
        for p in range(len(seq) - min_lines + 1):
            run = tuple(lines[i] for i in seq[p:p + min_lines])
            if run in seen_run:
                gone.setdefault(key, set()).update(seq[p:p + min_lines])
            seen_run.setdefault(run, 1)
        places.append(key)
    for d, t in given:
        lines = [] if t is None else t.split("\n")
        cut = gone.get((d, t), set())
        kept = None if t is None else hashlib.sha256("\n".join(x for i, x in enumerate(lines) if i not in cut).encode()).hexdigest()
        out.append((d, len(lines), len(cut), kept))
    return sorted(out, key=repr)


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_lines(spark, min_lines):
    got = line_dedup.removed_lines(docs(spark), min_lines=min_lines).groupBy("doc_id").count()
    want = sorted(((d, n) for d, _, n, _ in set(brute_lines([(r[0], r[1]) for r in rows()], min_lines)) if n), key=repr)
    assert collect(got, "doc_id", "count") == want


def test_line_digests(spark):
    got = line_dedup.line_digests(docs(spark))
    assert collect(got, *got.columns) == brute_lines([(r[0], r[1]) for r in rows()])
    assert line_dedup.line_digests(docs(spark, [])).count() == 0


def test_line_query(spark):
    got = queries.op3_line_dedup(spark, SF)
    assert collect(got, *got.columns) == brute_lines(table_rows(spark))


def test_line_columns_stay(spark):
    given = docs(spark)
    out = line_dedup.dedup_lines(given)
    assert out.columns == [*[c for c in given.columns if c not in ("line_total", "line_removed")], "line_total", "line_removed"] and out.count() == given.count()


def test_repeated_runs(spark):
    runs = collect(line_dedup.repeated_runs(docs(spark)), "doc_id", "first_line", "n_lines")
    assert (24, 1, 2) in runs and (25, 0, 2) in runs


def brute_windows(given, n=substring_dedup.WINDOW):
    first = {}
    for d, t in given:
        w = words(t)
        if d is not None:
            for i in range(len(w) - n + 1):
                k = tuple(w[i:i + n])
                first[k] = min(d, first.get(k, d))
    out = []
    for d, t in given:
        w = words(t)
        off = set()
        for i in range(len(w) - n + 1):
            if d is not None and first[tuple(w[i:i + n])] < d:
                off.update(range(i, i + n))
        out.append((d, len(w), len(off), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in off)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("hot,most", [(500, 1 << 27), (2, 1 << 27), (2, 1), (500, 1)])
def test_windows(spark, monkeypatch, hot, most):
    """With bitmaps and with joins, with and without hot seeds."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    if most == 1:
        monkeypatch.setattr(substring_dedup, "bitmap_bits", lambda n: substring_dedup.BITS_MOST + 1)
    got = substring_dedup.dedup_substrings(docs(spark), digests=True)
    assert collect(got, *got.columns) == brute_windows([(r[0], r[1]) for r in rows()])


def test_windows_query(spark):
    got = queries.op7_substring_dedup(spark, SF)
    assert collect(got, *got.columns) == brute_windows(table_rows(spark))


def test_passages_travel_compressed_and_whole(spark, monkeypatch):
    """Passages beyond the bitmap's size too: their words go to the shards once, in far less than eight bytes a word."""
    vocab = [f"w{i}" for i in range(300)]
    rng = np.random.default_rng(3)
    text = lambda n: " ".join(vocab[i] for i in rng.integers(0, 300, n))
    shared = [text(40) for _ in range(20)]
    given = [(i, f"{text(30)} {shared[i % 20]} {text(30)}", "en", "s", 0, *EXTRA) for i in range(400)]
    monkeypatch.setattr(substring_dedup, "bitmap_bits", lambda n: substring_dedup.BITS_MOST + 1)
    sent, emit = [], substring_dedup.emit_passages
    monkeypatch.setattr(substring_dedup, "emit_passages", lambda *a: sent.append(emit(*a)) or sent[-1])
    got = substring_dedup.dedup_substrings(docs(spark, given), digests=True)
    assert collect(got, *got.columns) == brute_windows([(r[0], r[1]) for r in given])
    assert len(sent) == 1  # the passages are emitted once
    messages = sent[0].collect()
    n = [int.from_bytes(r["word"][:8], "little") for r in messages]
    assert sum(n) >= 40 * 400 and sum(len(r["word"]) + len(r["dictionary"]) for r in messages) < 4 * sum(n)


def test_windows_empty(spark):
    assert substring_dedup.dedup_substrings(docs(spark, [])).count() == 0


def test_wavelet_rank():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 37, 1000)
    w = substring_dedup.WaveletMatrix(s, 6)
    c, at = rng.integers(0, 37, 300), rng.integers(0, 1001, 300)
    assert w.rank(c, at).tolist() == [int((s[:a] == x).sum()) for x, a in zip(c, at, strict=True)]


def test_lines_of_rows_without_id(spark):
    """Rows without an id are cleaned of repeated runs like others, and the first of them is the earliest copy."""
    given = [(None, "a b\nc d\nown one"), (None, "a b\nc d\nown two"), (0, "a b\nc d\nown three")]
    frame = docs(spark, [(i, t, "en", "s", 0, *EXTRA) for i, t in given])
    got = sorted(r["text"] for r in line_dedup.dedup_lines(frame).collect())
    assert sum(t.startswith("a b\nc d\n") for t in got) == 1 and "own three" in got
    assert {r["doc_id"] for r in line_dedup.removed_lines(frame).collect()} == {None, 0}
    assert collect(line_dedup.repeated_runs(frame), "doc_id", "first_line", "n_lines") == [(0, 0, 2), (None, 0, 2)]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_untouched_documents_have_no_line_removed(spark, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        frame = docs(spark, [(i, t, "en", "s", 0, *EXTRA) for i, t in enumerate([None, "", " \n ", "one"])])
        assert collect(line_dedup.dedup_lines(frame), "doc_id", "line_total", "line_removed") == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 1, 0)]
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
