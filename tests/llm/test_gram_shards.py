"""Costs by byte 5-grams from sharded counts, against the models in dictionaries."""

import math
from collections import Counter

import numpy as np
import pytest
from cases import EXTRA, docs, rows
from pyspark import RDD
from pyspark.sql import functions as F

from calyx.llm import gram_shards, perplexity

LABELS = "doc_id long, quality int, toxic int"


def brute_model(texts, top=5):
    """p of the last byte of a gram under interpolated modified Kneser-Ney of order `top`; None without bytes."""
    counts = Counter()
    for t in texts:
        b = b"\0" * (top - 1) + t
        counts.update(b[i - top + 1:i + 1] for i in range(top - 1, len(b)))
    if not counts:
        return None
    levels = [counts]
    for _ in range(top - 1):
        levels.append(Counter(g[1:] for g in levels[-1]))

    def order(held, under):
        c = Counter(held.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] + c[2] else 0.5
        d = [0.0]
        for k in (1, 2, 3):
            usual = k - (k + 1) * y * c[k + 1] / c[k] if c[k] else 0.0
            d.append(usual if 0.05 <= usual <= k - 0.05 else k / 2)
        total, back = Counter(), Counter()
        for g, n in held.items():
            total[g[:-1]] += n
            back[g[:-1]] += d[min(n, 3)]

        def p(g):
            below = under(g[1:])
            if g[:-1] not in total:
                return below
            n = held.get(g, 0)
            return (n - d[min(n, 3)] + back[g[:-1]] * below) / total[g[:-1]]
        return p

    p = lambda g: 1 / 256
    for held in levels[::-1]:
        p = order(held, p)
    return p


def brute_costs(models, lang, text):
    """-ln p of each byte; models: by language."""
    b = b"\0" * 4 + text
    own, pooled = models.get(lang), models["*"]
    return [-math.log(pooled(g) if own is None or lang == "*" else 0.5 * own(g) + 0.5 * pooled(g)) for g in (b[i - 4:i + 1] for i in range(4, len(b)))]


def brute_models(texts):
    """By language, from (language, text); None without text."""
    out = {lang: brute_model([t for x, t in texts if x == lang]) for lang in {x for x, _ in texts} if lang != "*"} | {"*": brute_model([t for _, t in texts])}
    return out if out["*"] else None


def worst(ratio):
    return max(sum(ratio[max(0, i - 15):i + 1]) for i in range(len(ratio)))


def given():
    out = [(r[0], r[1][:200] if r[1] else r[1], *r[2:]) for r in rows()]
    return out + [(100 + i, f"some words of text {i * 7 % 5}, 日本 and grumblewort {i}", ("en", "de", None)[i % 3], "s", 0, *EXTRA) for i in range(8)]


def labelled():
    """Trusted and toxic ids, one with two labels of which one is bad, and a label without id."""
    return [(i, 1, 0) for i in range(0, 56, 2)] + [(4, 0, 0), (6, 1, 0)] + [(i, 1, 1) for i in (100, 102, 103, 106, 9)] + [(None, 1, 0), (None, 1, 1)]


def check(spark, frame, held):
    labels = spark.createDataFrame(labelled(), LABELS)
    out = sorted(perplexity.quality_scores(frame, labels).collect(), key=repr)
    bad = {i for i, _, t in labelled() if t == 1 and i is not None}
    good = {i for i, *_ in labelled() if i is not None} - bad - {4}
    name = lambda lang: "*" if lang is None else f"l:{lang}"
    folds = {r["text"]: r["fold"] for r in frame.select("text", perplexity.fold(F.col("text")).alias("fold")).collect()}
    train = [(name(r[2]), (r[1] or "").encode(), folds[r[1]]) for r in held if r[0] in good and r[1] is not None]
    toxic = brute_models([(name(r[2]), (r[1] or "").encode()) for r in held if r[0] in bad])
    whole = brute_models([x[:2] for x in train])
    limits = {}
    for f in range(perplexity.FOLDS):
        model = brute_models([x[:2] for x in train if x[2] != f])
        for lang, text, part in train:
            if part == f and model:
                c, t = (np.array(brute_costs(m, lang, text)) for m in (model, toxic))
                for key in {lang, "*"}:
                    scores = limits.setdefault(key, ([], []))
                    scores[0].append(sum(c) / (len(text) + 100))
                    if text:
                        scores[1].append(worst(list(c - t)))
    want = []
    for r in held:
        lang, text = name(r[2]), (r[1] or "").encode()
        c, t = (np.array(brute_costs(m, lang, text)) for m in (whole, toxic))
        limit = limits[lang if lang in whole else "*"]
        want.append((r[0], len(text), sum(c) / (len(text) + 100), worst(list(c - t)) if text else None, max(limit[0]), max(limit[1])))
    want.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2]))
    out.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_bytes"], r["score"]))
    assert len(out) == len(want)
    for r, (doc_id, size, score, toxic_score, limit, toxic_limit) in zip(out, want, strict=True):
        assert (r["doc_id"], r["n_bytes"]) == (doc_id, size)
        assert r["score"] == pytest.approx(score, rel=1e-6) and r["limit"] == pytest.approx(limit, rel=1e-6)
        assert (r["toxic_score"] is None) == (toxic_score is None) and r["toxic_limit"] == pytest.approx(toxic_limit, rel=1e-5)
        assert toxic_score is None or r["toxic_score"] == pytest.approx(toxic_score, rel=1e-5, abs=1e-5)
        assert r["keep"] == (r["score"] <= r["limit"]) and r["toxic_keep"] == (r["toxic_score"] is None or r["toxic_score"] <= r["toxic_limit"])


def test_scores_match_brute_force_of_order_five(spark):
    held = given()
    check(spark, docs(spark, held), held)


def test_scores_by_many_shards_and_more_partitions_than_splits(spark, monkeypatch):
    """One row a block, many shards, merged counts, and a shuffle of more partitions than were asked for."""
    for name, value in (("SHARD", 200), ("BLOCK", 3), ("SLICE", 50), ("PENDING", 10)):
        monkeypatch.setattr(gram_shards, name, value)
    plain = RDD.partitionBy
    monkeypatch.setattr(RDD, "partitionBy", lambda self, n, *a, **b: plain(self, max(n or 0, 9), *a, **b))
    held = given()
    check(spark, docs(spark, held).repartition(3), held)


def test_probabilities_of_a_context_sum_to_one():
    """Over all 256 bytes, for a context that was seen, one seen in part, and one never seen."""
    texts = [b"the cat sat on the mat", b"a cat ran", b"the cat ran"]
    code = np.sort(np.concatenate([int.from_bytes(c, "big") * 256 + np.arange(256) for c in (b"e ca", b"xxca", b"zqzq")]))
    key, n = np.unique(gram_shards.codes(texts)[0], return_counts=True)
    code, n = gram_shards._summed(np.r_[key, code], np.r_[n, np.zeros(len(code), np.int64)][:, None])
    kinds, here, held = [], key, n[n[:, 0] > 0]
    for order in (5, 4, 3):
        kinds.append(gram_shards._of_counts(held))
        here, held = gram_shards._lower(here, held, order - 1)
    p = gram_shards.chances(code, n, (np.array(kinds[::-1]), here, held))[:, 0]
    brute = brute_model(texts)
    assert p == pytest.approx([brute(int(c).to_bytes(5, "big")) for c in code], rel=1e-9)
    for context in (b"e ca", b"xxca", b"zqzq"):
        assert p[code >> 8 == int.from_bytes(context, "big")].sum() == pytest.approx(1)

