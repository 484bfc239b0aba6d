"""Ranked search: all documents scored in plain Python, and bounds that never fall short."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from cases import EXTRA, SF, collect, docs, rows

from calyx.llm import lexical_search as ls
from calyx.llm import queries

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = "item_id long, text string, score long, item string, a string"


def terms(text):
    return TERM.findall((text or "").encode().lower())


def item_rows():
    given = [t for _, t, *_ in rows()]
    return [(0, given[7], 0, "z", "z"), (1, "one two", 0, "z", "z"), (2, None, 0, "z", "z"), (3, "", 0, "z", "z"), (4, "never-seen-anywhere", 0, "z", "z"),
            (5, "ONE one three it's 日本", 0, "z", "z"), (5, "ONE one three it's 日本", 0, "z", "z"), (6, given[15], 0, "z", "z"), (None, "word", 0, "z", "z"),
            (1, "three", 0, "z", "z")]


def brute(docs_, items, k=20):
    each = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs_]
    n_docs, total = sum(n > 0 for *_, n in each), sum(n for *_, n in each)
    df = Counter(t for _, c, _ in each for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for i, c, n in each:
            if n:
                m = 75 + 25 * n * n_docs // total
                score = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 12 * m))
                            for t, q in Counter(terms(text)).items() if c[t])
                if score > 0:
                    found.append((-score, i is None, i or 0))
        out += [(item, r, None if null else i, -s) for r, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("k", "limit"), [(20, ls.QUERY_TERMS), (3, 40), (200, 40)])
def test_search(spark, k, limit):
    out = ls.search(docs(spark), spark.createDataFrame(item_rows(), ITEMS), k=k, query_limit=limit)
    assert collect(out, "item_id", "rank", "doc_id", "score") == brute([(r[0], r[1]) for r in rows()], [(r[0], r[1]) for r in item_rows()], k)


def test_empty_tables(spark):
    items, none = spark.createDataFrame(item_rows(), ITEMS), spark.createDataFrame([], ITEMS)
    assert ls.search(docs(spark, []), items).count() == 0 == ls.search(docs(spark), none).count()
    assert ls.search(docs(spark, [(1, None, None, None, 0, *EXTRA)]), items).count() == 0


def test_query(spark):
    got = collect(queries.op11_lexical_search(spark, SF), "item_id", "rank", "doc_id", "score")
    table = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got == brute(table, items)


def test_bounds_hold_and_exclude():
    """No document's bound is below its score; most documents are left out without scoring."""
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(4000)]
    texts = [" ".join(rng.choice(vocab[:400] if i % 3 else vocab, int(rng.integers(40, 80)))).encode() for i in range(3000)]
    texts += [(b"w1 " * 700) + b"w2", b"w3 " * 30]
    c = ls.Counted(ls.Terms(texts))
    q = ls.Counted(ls.Terms([b" ".join(t.split()[:25]) for t in texts[::101]]))
    both = np.unique(np.rec.fromarrays([q.a, q.b], names="a,b"))
    words = ls.Vocabulary(both["a"].copy(), both["b"].copy())
    found, term = words.find(c.a, c.b), words.find(q.a, q.b)
    size, m = c.size, 75 + 25 * c.size * len(texts) // c.size.sum()
    upper = ls.upper_parts(ls.Signature(c.text, c.a, c.tf, len(texts)).present(words.a), size, m)
    exact = np.zeros(upper.shape, np.int64)
    at = np.flatnonzero(found >= 0)
    exact[found[at], c.text[at]] = ls.part_score(c.tf[at], m[c.text[at]])
    assert (upper >= exact).all() and (upper > exact).any()
    df = np.bincount(found[at], minlength=len(words.a))
    weight = np.floor(1000 * np.log((2 * len(texts) + 2) / (2 * df + 1))).astype(np.int64)
    asked = ls.Queries(q.text, term, q.tf * weight[term], len(q.size))
    lists = ls.Lists(asked.n_items, 20)
    ids = np.arange(len(texts))
    scored = ls.search_block(c.text, c.a, found, c.tf, size, m, ids, np.zeros(len(ids), bool), words, asked, lists)
    print(f"scored {scored} of {asked.n_items * len(texts)}")
    assert scored < 0.2 * asked.n_items * len(texts)
    for i in range(asked.n_items):
        t, w = asked.of(i)
        whole = w @ exact[t]
        best = np.lexsort((ids, -whole))[:20]
        assert lists.score[i].tolist() == whole[best].tolist() and lists.doc[i].tolist() == best.tolist()
