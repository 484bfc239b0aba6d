"""Toxicity: the models in dictionaries, held-out accuracy, awkward rows."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from cases import EXTRA, docs, rows

from calyx.llm import toxicity

LABELS = "doc_id long, quality int, toxic int, score string, text string"
TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def label_rows(given):
    return [(i, 1, t, "z", "z") for i, t in given]


def brute_chunks(text):
    out = []
    for w in TERM.findall((text or "").encode().lower()):
        whole = b" " + w + b" "
        out += [whole[i:i + 8] for i in range(0, len(whole), 8)]
    return out


def brute_shared(total):
    tables = [dict(total)]
    for symbols in toxicity.ORDERS[1:]:
        tables.append(Counter(c[-symbols:] for c in tables[-1]))
    lower, low_symbols = None, 0
    for symbols, counts in reversed(list(zip(toxicity.ORDERS, tables, strict=True))):
        kinds = Counter(counts.values())
        y = kinds[1] / (kinds[1] + 2 * kinds[2]) if kinds[1] + kinds[2] else 0.5
        cut = {}
        for k in (1, 2, 3):
            usual = k - (k + 1) * y * kinds[k + 1] / kinds[k] if kinds[k] else -1
            cut[k] = usual if 0.05 <= usual <= k - 0.05 else k / 2
        sums, spare = Counter(), defaultdict(float)
        for c, n in counts.items():
            sums[c[:-1]] += n
            spare[c[:-1]] += cut[min(n, 3)]
        p = {c: (n - cut[min(n, 3)] + spare[c[:-1]] * (lower[c[-low_symbols:]] if lower else 1 / 256)) / sums[c[:-1]] for c, n in counts.items()}
        lower, low_symbols = p, symbols
    return lower


def brute_evidence(train, texts):
    """train: (text, toxic)."""
    n = {0: Counter(), 1: Counter()}
    for text, bad in train:
        for c in brute_chunks(text):
            n[bad].update(c[:i] for i in range(1, len(c) + 1))
    p = brute_shared(n[0] + n[1])
    total, types = {0: Counter(), 1: Counter()}, {0: Counter(), 1: Counter()}
    for bad, counts in n.items():
        for c, k in counts.items():
            total[bad][c[:-1]] += k
            types[bad][c[:-1]] += 1

    def chance(bad, c, under):
        ctx = c[:-1]
        return (max(n[bad][c] - toxicity.DISCOUNT, 0) + (toxicity.DISCOUNT * types[bad][ctx] + toxicity.SHARED) * under) / (total[bad][ctx] + toxicity.SHARED)

    def ratio(chunk):
        out = 0.0
        for i in range(1, len(chunk) + 1):
            c = chunk[:i]
            if not total[1][c[:-1]]:
                break
            seen = c in p
            under = p[c] if seen else 1.0  # an unseen symbol's shared probability is the same in both classes
            step = math.log(chance(1, c, under)) - math.log(chance(0, c, under))
            out += step if n[1][c] else min(step, 0)
            if not seen:
                break
        return out

    found = []
    for text in texts:
        each = brute_chunks(text)
        found.append(sum(max(ratio(c) - toxicity.MARGIN, 0) for c in each) / math.sqrt(len(each) + toxicity.LENGTH))
    return found


def brute_ratio(train, texts):
    """The mean log ratio of all chunks: excess over a margin that no chunk falls below, with the margin taken off again."""
    low, margin = -1000, toxicity.MARGIN
    try:
        toxicity.MARGIN = low
        sums = [e * math.sqrt(len(brute_chunks(t)) + toxicity.LENGTH) for e, t in zip(brute_evidence(train, texts), texts, strict=True)]
    finally:
        toxicity.MARGIN = margin
    return [(s + low * len(brute_chunks(t))) / (len(brute_chunks(t)) + toxicity.LENGTH) for s, t in zip(sums, texts, strict=True)]


def part(i):
    return zlib.crc32(str(i).encode()) % 5


def planted():
    base = ["the cat sat on the mat and ran home", "a dog ran to the mat and sat there", "Ünder the house a cat slept, and dogs ran"]
    out = [(i, f"{base[i % 3]} {base[i * 7 % 3]} n{i}") for i in range(200)]
    return out + [(200 + i, f"{base[i % 3]}. You GRUMBLEWORTish {base[i % 2]} grumblewort!") for i in range(60)]


def frame(spark, given):
    return docs(spark, [(i, t, "en", "s", 0, *EXTRA) for i, t in given])


def test_evidence_matches_brute_force(spark):
    given = planted()
    texts = [(t, i) for i, t in given] + [("grumblewort " * 30, 900), (None, 901), ("", 902), ("x" * 5000 + " grumble", 903), ("GRUMBLEWORT", 904)]
    train = [(t, int(i >= 200)) for i, t in given]
    learned = spark.createDataFrame([(t, 2 * bad) for t, bad in train], "text string, kind int")
    words = toxicity.lexicon(toxicity.node_counts(learned)).where("model = 1").drop("model")
    got = {r["doc_id"]: r["tox_evidence"] for r in toxicity.evidence(frame(spark, [(i, t) for t, i in texts]).select("doc_id", "text"), words).collect()}
    want = brute_evidence(train, [t for t, _ in texts])
    assert len(got) == len(texts) and max(want) > 0.5
    for (_, i), w in zip(texts, want, strict=True):
        assert got[i] == pytest.approx(w, abs=1e-4)


def test_every_chunk_counts_in_the_log_ratio(spark, monkeypatch):
    given = planted()
    train = [(t, int(i >= 200)) for i, t in given]
    texts = [(t, i) for i, t in given[::20]] + [("the cat sat", 900), (None, 901), ("", 902), ("z" * 300 + " grumble 日本", 903), ("x the", 904), ("a", 905), (" . ", 906)]
    learned = spark.createDataFrame([(t, 2 * bad) for t, bad in train], "text string, kind int")
    words = toxicity.lexicon(toxicity.node_counts(learned)).where("model = 1").drop("model")
    want = brute_ratio(train, [t for t, _ in texts])
    assert min(want) < -0.05 and max(want) > 0.5 and all(w for w, (t, _) in zip(want, texts, strict=True) if brute_chunks(t))
    for split in (toxicity.SPLIT, 1):  # one split a task, and one a piece
        monkeypatch.setattr(toxicity, "SPLIT", split)
        rows = frame(spark, [(i, t) for t, i in texts]).select("doc_id", "text").repartition(3)
        got = {r["doc_id"]: r["tox_ratio"] for r in toxicity.evidence(rows, words).collect()}
        assert len(got) == len(texts)
        for (_, i), w in zip(texts, want, strict=True):
            assert got[i] == pytest.approx(w, abs=1e-4)


def test_chunks_below_the_margin_move_the_score(spark):
    given = planted()
    labels = spark.createDataFrame(label_rows([(i, int(i >= 200)) for i, _ in given]), LABELS)
    extra = [(5000, "the cat sat on the mat"), (5001, "a dog ran home")]
    out = {r["doc_id"]: r for r in toxicity.toxicity(frame(spark, given + extra), labels).collect() if r["doc_id"] >= 5000}
    assert out[5000]["evidence"] == out[5001]["evidence"] == 0 and out[5000]["predicted"] == out[5001]["predicted"] == 0
    assert out[5000]["log_ratio"] != out[5001]["log_ratio"] and out[5000]["score"] != out[5001]["score"]


def test_chunks_spell_every_word_whole():
    texts = [b"Idiot, you!", b"", "ça naïvement".encode(), b"a" * 100, b"\x00\x01 x"]
    code, text = toxicity.chunks(toxicity.Terms(texts))
    got = [(int(t), int(c).to_bytes(8, "big").lstrip(b"\0")) for c, t in zip(code, text, strict=True)]
    assert got == [(i, c) for i, t in enumerate(texts) for c in brute_chunks(t.decode())]


def test_planted_words_and_awkward_rows(spark):
    given = planted()
    labels = spark.createDataFrame(label_rows([(i, int(i >= 200)) for i, _ in given] + [(None, 1), (3, None), (777_777, 1)]), LABELS)
    extra = [(5000, "nothing of the kind, a cat ran home"), (5001, "what a grumblewort"), (5002, None), (5003, ""), (None, "grumblewort"), (5001, "the cat sat")]
    out = toxicity.toxicity(frame(spark, given + extra), labels).collect()
    assert len(out) == len(given) + len(extra)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and part(r["doc_id"]) == 0) and 0 <= r["score"] <= 1
        assert r["predicted"] == int(r["score"] >= 0.5)
        if r["doc_id"] is not None and r["doc_id"] < 5000:
            assert r["predicted"] == int(r["doc_id"] >= 200)
    by = {(r["doc_id"], round(r["evidence"], 3)): r["predicted"] for r in out if r["doc_id"] is None or r["doc_id"] >= 5000}
    assert by[5000, 0.0] == by[5002, 0.0] == by[5003, 0.0] == by[5001, 0.0] == 0
    assert sorted(p for (i, _), p in by.items() if i == 5001) == [0, 1] and [p for (i, _), p in by.items() if i is None] == [1]


def test_labels_are_no_inputs_of_a_score(spark):
    given = planted()
    one = spark.createDataFrame(label_rows([(i, int(i >= 200)) for i, _ in given]), LABELS)
    other = spark.createDataFrame(label_rows([(i, int(i >= 200) if part(i) else 1 - int(i >= 200)) for i, _ in given]), LABELS)
    got = [sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity(frame(spark, given), labels).collect()) for labels in (one, other)]
    assert got[0] == got[1]


def test_missing_classes_and_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(docs(spark), none).collect()} == {(0.0, 0)}
    assert toxicity.toxicity(docs(spark, []), none).count() == 0
    everything = spark.createDataFrame(label_rows([(r[0], 1) for r in rows() if r[0] is not None]), LABELS)
    assert {(r["score"], r["predicted"]) for r in toxicity.toxicity(docs(spark), everything).collect()} == {(1.0, 1)}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.toxicity(table, labels).join(labels, "doc_id").where("held_out").toPandas()
    caught, wrong = out.predicted[out.toxic == 1].mean(), out.predicted[out.toxic == 0].mean()
    print(f"toxic caught {caught:.3f} of {(out.toxic == 1).sum()}, others marked {wrong:.4f}")
    assert caught >= 0.8 and wrong <= 0.01
    assert np.mean(out.predicted == out.toxic) >= 0.97
