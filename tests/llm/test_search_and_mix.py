"""Vector searches, mixing, perplexity and the pipeline."""

import math

import numpy as np
import pytest
from cases import EXTRA, SF, collect, docs, rows, words
from pyspark.sql import functions as F

from calyx.llm import exact_topk, mixing, perplexity, queries, vectors, vp_tree

VECTORS = "vec_id long, embedding array<float>, label int, rank string, score string"


def vector_rows():
    rng = np.random.default_rng(4)
    out = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(260)]
    out += [(300 + i, [0.5] * 8) for i in range(40)]  # many copies of one vector
    out += [(400, None), (401, []), (402, [0.0] * 8), (403, [1.0, None, *[0.0] * 6]), (404, [float("nan")] * 8), (405, [float("inf")] * 8),
            (None, [1.0] * 8), (406, [1.0] * 5), (500, [2.0] * 5), (7, out[7][1])]
    return [(*r, 0, "z", "z") for r in out]


def usable(given, nonzero):
    seen = {}
    for i, v, *_ in given:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and (any(v) or not nonzero):
            seen[i] = v
    return seen


def brute_nearest(given, k=10, every=100):
    have, out = usable(given, True), []
    for q, v in have.items():
        if q % every == 0:
            ranked = sorted((math.dist(v, w), i) for i, w in have.items() if i != q and len(w) == len(v))
            out += [(q, r, i, round(d, 9)) for r, (d, i) in enumerate(ranked[:k], 1)]
    return sorted(out, key=repr)


def brute_top(given, k=10, every=100):
    have = {i: [math.floor(1024 * x) for x in v] for i, v in usable(given, False).items()}
    out = []
    for q, v in have.items():
        if q % every == 0:
            ranked = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in have.items() if i != q and len(w) == len(v))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(ranked[:k], 1)]
    return sorted(out, key=repr)


def small(monkeypatch):
    monkeypatch.setattr(vectors, "SHARD_ROWS", 50)
    monkeypatch.setattr(vectors, "BLOCK_ROWS", 2)


@pytest.mark.parametrize("k", [10, 400])
def test_nearest(spark, monkeypatch, k):
    small(monkeypatch)
    given = vector_rows()
    got = vp_tree.nearest(spark.createDataFrame(given, VECTORS), F.col("vec_id") % 100 == 0, k=k, relax=1.0)
    assert collect(got.withColumn("score", F.round("score", 9)), "query_id", "rank", "vec_id", "score") == brute_nearest(given, k)


def test_relaxed_search_keeps_recall(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(4000, 6))
    tree = vp_tree.Tree.build(np.arange(4000), points)
    asked = np.arange(0, 4000, 40)
    exact, _ = tree.search(asked, points[asked], 10, 1.0)
    full = tree.measured
    loose, _ = tree.search(asked, points[asked], 10, 1.3)
    assert full < 4000 * len(asked) * 0.8 and tree.measured < full
    assert np.mean([len(set(a) & set(b)) / 10 for a, b in zip(exact.tolist(), loose.tolist(), strict=True)]) >= 0.9


def embeddings(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()]


def test_nearest_query(spark):
    got = sorted(tuple(r) for r in queries.op5_vp_tree(spark, SF).select("query_id", "rank", "vec_id", "score").collect())
    want = sorted(brute_nearest(embeddings(spark)))
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert [r[3] for r in got] == pytest.approx([r[3] for r in want], abs=1e-8)  # brute force rounds


def test_distances_beyond_the_range_still_rank(spark):
    given = spark.createDataFrame([(0, [1e200, 1.0]), (1, [-1e200, 2.0]), (2, [3.0, 4.0]), (100, [5.0, 6.0])], "vec_id long, embedding array<double>")
    got = collect(vp_tree.nearest(given, F.col("vec_id") % 100 == 0), "query_id", "rank", "vec_id")
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 100), (100, 1, 2), (100, 2, 0), (100, 3, 1)]


def test_components_out_of_range_are_an_error(spark):
    given = spark.createDataFrame([(0, [1e9]), (1, [2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64-bit"):
        exact_topk.top_products(given, F.col("vec_id") == 0).collect()


@pytest.mark.parametrize("k", [10, 400])
def test_top_products(spark, monkeypatch, k):
    small(monkeypatch)
    given = vector_rows()
    got = exact_topk.top_products(spark.createDataFrame(given, VECTORS), F.col("vec_id") % 100 == 0, k=k)
    assert collect(got, "query_id", "rank", "vec_id", "score") == brute_top(given, k)


def test_top_products_query(spark):
    assert collect(queries.op8_exact_topk(spark, SF), "query_id", "rank", "vec_id", "score") == brute_top(embeddings(spark))


def test_large_components_stay_exact():
    a = np.array([[2 ** 30, 3], [1, 2]], np.int64)
    assert exact_topk.products(a, a).tolist() == (a.astype(object) @ a.T.astype(object)).tolist()


def test_searches_of_nothing(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert vp_tree.nearest(empty, F.col("vec_id") % 100 == 0).count() == 0
    assert exact_topk.top_products(empty, F.col("vec_id") % 100 == 0).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    """Share out by weight, cut off at the cap, share the excess out anew until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not above:
            for s in open_:
                target[s] = left * weight[s] / total
            break
        for s in above:
            target[s] = cap * sizes[s]
            left -= target[s]
        open_ -= above
    return target


def check_mix(got, given):
    sizes = {}
    for _, text, source in given:
        sizes[source] = sizes.get(source, 0) + len(words(text))
    target = brute_targets(sizes)
    assert len(got) == len(given)
    taken, largest = dict.fromkeys(sizes, 0), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6


@pytest.mark.parametrize("bin_rows", [10_000, 1])
def test_mix(spark, monkeypatch, bin_rows):
    monkeypatch.setattr(mixing, "BIN_ROWS", bin_rows)
    got = mixing.mix(docs(spark)).collect()
    check_mix(got, [(r[0], r[1], r[3]) for r in rows()])
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(docs(spark).repartition(5)).collect()))


def test_mix_query(spark):
    given = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").collect()]
    check_mix(queries.op9_mixing(spark, SF).collect(), given)


def test_mix_takes_lowest_keys_first(spark):
    got = mixing.mix(docs(spark)).join(mixing.sized(docs(spark)).select("row_hash", "sort_key").distinct(), "row_hash")
    by_source = {}
    for r in got.where("size > 0").collect():
        by_source.setdefault(r["source"], []).append((r["sort_key"], r["copies"]))
    for keys in by_source.values():
        copies = [c for _, c in sorted(keys)]
        assert copies == sorted(copies, reverse=True) and max(copies) - min(copies) <= 1


def test_mixed_documents(spark):
    given = docs(spark)
    out = mixing.mixed_documents(given)
    assert out.columns == given.columns
    want = {r["row_hash"]: 0 for r in mixing.mix(given).collect()}
    assert out.count() == sum(r["copies"] for r in mixing.mix(given).collect()) and want
    assert mixing.mix(docs(spark, [])).count() == 0 and mixing.mixed_documents(docs(spark, [])).count() == 0


LABELS = "doc_id long, quality int, toxic int"


def brute_model(texts):
    """Interpolated modified Kneser-Ney over byte trigrams, in dictionaries."""
    from collections import Counter
    three = Counter()
    for t in texts:
        b = b"\0\0" + t.encode()
        three.update(b[i - 2:i + 1] for i in range(2, len(b)))
    two = Counter(k[1:] for k in three)
    one = Counter(k[1:] for k in two)

    def order(counts, lower):
        c = Counter(counts.values())
        y = c[1] / (c[1] + 2 * c[2]) if c[1] else 0.5
        d = {}
        for k in (1, 2, 3):
            usual = k - (k + 1) * y * c[k + 1] / c[k] if c[k] else 0
            d[k] = usual if c[k] and 0.05 <= usual <= k - 0.05 else k / 2
        total, back = Counter(), Counter()
        for g, n in counts.items():
            total[g[:-1]] += n
            back[g[:-1]] += d[min(n, 3)]

        def p(g):
            under = lower(g[1:])
            if g[:-1] not in total:
                return under
            n = counts.get(g, 0)
            return (n - d[min(n, 3)] if n else 0) / total[g[:-1]] + back[g[:-1]] / total[g[:-1]] * under
        return p

    return order(three, order(two, order(one, lambda g: 1 / 256)))


def cost(p, text):
    b = b"\0\0" + (text or "").encode()
    return -sum(math.log(p(b[i - 2:i + 1])) for i in range(2, len(b)))


def mixed(own, pooled):
    return lambda g: perplexity.OWN * own(g) + (1 - perplexity.OWN) * pooled(g)


def test_costs_match_brute_force_on_both_paths(spark):
    given = [r for r in rows() if r[0] is not None and r[0] != 7 and r[0] != 15]
    train = [(("l:" + r[2]) if r[2] else "*", r[1]) for r in given if r[0] >= 8 and r[1] and r[2] != "fr"]
    model = perplexity.train(spark.createDataFrame(train, "lang string, text string"))
    ours, pooled = brute_model([t for g, t in train if g == "l:en"]), brute_model([t for _, t in train])
    frame = docs(spark, given)
    want = {r[0]: cost(mixed(ours, pooled) if r[2] == "en" else pooled, r[1]) for r in given}
    dense = {r["doc_id"]: r["lm_cost"] for r in perplexity.with_cost(frame, model).collect()}
    joined = {r["doc_id"]: r["lm_cost"] for r in perplexity.cost_by_joins(frame, model).collect()}
    for k, v in want.items():
        assert dense[k] == pytest.approx(v, rel=1e-4, abs=1e-3)
        assert joined[k] == pytest.approx(v, rel=1e-9, abs=1e-9)


def test_probabilities_sum_to_one():
    p = brute_model(["the cat sat", "a cat ran"])
    assert sum(p(bytes([*b"ca", x])) for x in range(256)) == pytest.approx(1) == sum(p(bytes([*b"zq", x])) for x in range(256))


def test_no_trusted_text_rejects_nothing(spark):
    empty = spark.createDataFrame([], LABELS)
    out = perplexity.good_documents(docs(spark), empty)
    assert out.count() == len(rows()) and out.columns == docs(spark).columns
    assert perplexity.quality_scores(docs(spark, []), empty).count() == 0


def test_held_out_accuracy(spark):
    """Trained on half of the labels, judged on the other half."""
    sf = "/root/testdata/sf0.01"
    labels, table = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    out = perplexity.quality_scores(table, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean = [r["keep"] for r in out if r["quality"] == 1]
    junk = [r["keep"] for r in out if r["quality"] == 0]
    assert np.mean(clean) >= 0.995 and np.mean(junk) <= 0.1


def held_out(spark, sf):
    labels, table = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    return perplexity.quality_scores(table, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()


def test_held_out_junk_on_the_larger_table(spark):
    """The limit is a 0.99 quantile without slack: it may cost a hundredth of the clean texts, and junk near it goes."""
    out = held_out(spark, "/root/testdata/sf0.1")
    clean = [r["keep"] for r in out if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["keep"] for r in out if r["quality"] == 0]
    print(f"clean kept {sum(clean)} of {len(clean)}, junk kept {sum(junk)} of {len(junk)}, "
          f"toxic kept {sum(r['keep'] for r in out if r['quality'] == r['toxic'] == 1)}")
    assert np.mean(clean) >= 0.98 and np.mean(junk) <= 0.1
    for lang in ("en", "de", "fr", "es"):
        toxic = [r["keep"] and r["toxic_keep"] for r in out if r["toxic"] == 1 and r["lang"] == lang]
        print(f"{lang}: toxic kept {sum(toxic)} of {len(toxic)}")
        assert lang != "en" or np.mean(toxic) <= 0.1
    both = [r["keep"] and r["toxic_keep"] for r in out if r["quality"] == 1 and r["toxic"] == 0]
    print(f"clean kept by both {sum(both)} of {len(both)}")
    assert np.mean(both) >= 0.97


def test_toxic_documents_are_caught(spark, monkeypatch):
    """A few words make a clean text toxic; models over the bound are taken language by language with the same result."""
    base = ["the cat sat on the mat and ran", "a dog ran to the mat and sat", "the dog and the cat ran on", "a cat and a dog sat on a mat"]
    given = [(i, f"{base[i % 4]} {base[i * 7 % 4]} {i}", ("en", "fr", None)[i % 3], None, 0, *EXTRA) for i in range(60)]
    given += [(100 + i, f"{base[i % 4]} you grumblewort {base[i % 3]}", ("en", "fr", None)[i % 3], None, 0, *EXTRA) for i in range(12)]
    given += [(200, None, "en", None, 0, *EXTRA), (201, "", "en", None, 0, *EXTRA)]
    frame = docs(spark, given)
    labels = spark.createDataFrame([(i, 1, int(i >= 100)) for i in [*range(60), *range(100, 106)]], LABELS)
    kept = {r["doc_id"] for r in perplexity.good_documents(frame, labels).collect()}
    assert not kept & set(range(100, 112)) and len(kept & set(range(60))) >= 57 and {200, 201} <= kept
    models, toxic = perplexity.train_folds(*perplexity.labelled_text(frame, labels))
    at_once, by_language = [], []
    for out in (at_once, by_language):
        out += sorted((r["doc_id"], r["lm_worst"]) for r in perplexity.with_worst(frame, models[-1], toxic).collect())
        monkeypatch.setattr(perplexity, "TABLE_ROWS", 0)
    assert len(at_once) == len(given) and [(i, x and pytest.approx(x)) for i, x in at_once] == by_language


def test_limit_is_of_unseen_texts(spark):
    """Copies of a text share a fold, so a lone trusted text sets no limit, and two of different folds do."""
    frame = docs(spark, [(1, "one lone text", "en", None, 0, *EXTRA), (2, "one lone text", "en", None, 0, *EXTRA),
                         (3, "#" * 500, "en", None, 0, *EXTRA), (4, "and quite another", "en", None, 0, *EXTRA)])
    folds = {r[0]: r[1] for r in frame.select("doc_id", perplexity.fold(F.col("text"))).collect()}
    for ids in ([1, 2], [1, 2, 4]):
        labels = spark.createDataFrame([(i, 1, 0) for i in ids], LABELS)
        limits = [r["limit"] for r in perplexity.quality_scores(frame, labels).collect()]
        assert len(limits) == 4 and all((x is None) == (len({folds[i] for i in ids}) == 1) for x in limits)


def test_pipeline_stages(spark):
    import corpus_pipeline
    table = spark.read.parquet(f"{SF}/documents.parquet")
    frame, seen = table, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, SF)
        assert frame.columns == table.columns and frame.schema.simpleString() == table.schema.simpleString()
        frame = frame.persist()
        seen.append(frame.count())
    assert seen[0] <= table.count() and seen[1] <= seen[0] and seen[2] < seen[1]
    assert corpus_pipeline.run(spark, SF).count() == seen[3]


def test_scores_in_one_pass_are_those_of_two(spark):
    """Cost and worst window of a text come from one worker with one copy of each model, not from two in a row."""
    given = [r for r in rows() if r[0] is not None]
    good = [(("l:" + r[2]) if r[2] else "*", r[1]) for r in given if r[0] >= 8 and r[1] and r[2] != "fr"]
    model = perplexity.train(spark.createDataFrame(good, "lang string, text string"))
    toxic = perplexity.train(spark.createDataFrame([("l:en", "you grumblewort"), ("*", "grumble worts")], "lang string, text string"))
    frame = docs(spark, given)
    for bad in (toxic, toxic.limit(0)):
        two = perplexity.with_worst(perplexity.with_cost(frame, model), model, bad)
        one = perplexity.with_scores(frame, model, bad)
        assert one.columns == two.columns and one._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
        close = [[(r["doc_id"], r["lm_lang"], r["lm_bytes"], *(x and pytest.approx(x, rel=1e-9, abs=1e-9) for x in (r["lm_cost"], r["lm_worst"])))
                  for r in sorted(out.collect(), key=lambda r: (r["doc_id"], r["lm_bytes"], r["lm_lang"]))] for out in (one, two)]
        assert close[0] == [tuple(v.expected if hasattr(v, "expected") else v for v in r) for r in close[1]]
