"""Deterministic stratified splits, folds, prefix subsets and capped samples.

Row order inside a class comes from the portable hash u(seed|id), so the
assignment is the same on any partitioning, after any task retry, and in the
DuckDB oracle.  Class sizes come from one small aggregate collected to the
driver (one row per class); the per-class allocation follows the largest-
remainder rule of stratified splitters, with ties going to the lower label.

No row is shuffled or ranked for that.  A histogram of the order's slices tells
which slice holds the row of a wanted rank, only that slice's keys are looked
at, and every row is then decided by comparing its key with the cut.  Ids are
unique.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from calyx.functions.hashing import uniform, uniform_int
from calyx.operators.ranking import choose_buckets, rank_by_value


def class_sizes(df: DataFrame, label: str = "label") -> dict:
    return {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}


#: Rows a task of an iterative fit should have: each iteration is a job, and smaller tasks cost more than their work.
FIT_ROWS = 1 << 15
#: As FIT_ROWS, for logistic fits on some 30 values a row (a task takes some 20 ms beside 9 ms for 32,768 such rows) and deep trees.
NARROW_FIT_ROWS = 1 << 17


def for_fits(df: DataFrame, rows: int, id_col: str = "id", fit_rows: int = FIT_ROWS) -> DataFrame:
    """`df`, of some `rows` rows, dealt by id over as many partitions as its size needs, whatever those it comes in.

    Partitions left by a shuffle are some hundred for a small table, one job of that many tasks for each iteration of a fit,
    and a large table in few bytes has too few of them.
    """
    return df.repartition(max(1, -(-rows // fit_rows)), id_col).sortWithinPartitions(id_col)


def approximate_mode(counts: dict, n_draws: int) -> dict:
    """Largest-remainder allocation of n_draws over classes in proportion to counts."""
    total = sum(counts.values())
    keys = sorted(counts)
    cont = {k: counts[k] * n_draws / total for k in keys}
    floored = {k: math.floor(cont[k]) for k in keys}
    need = n_draws - sum(floored.values())
    for k in sorted(keys, key=lambda k: (-(cont[k] - floored[k]), k))[:need]:
        floored[k] += 1
    return floored


def split_sizes(counts: dict, test_size: float) -> tuple[dict, dict]:
    """(train per class, test per class); n_test = ceil(test_size * n), train allocated first."""
    n = sum(counts.values())
    n_test = math.ceil(test_size * n)
    train = approximate_mode(counts, n - n_test)
    return train, {k: counts[k] - train[k] for k in counts}


def _case(label: str, mapping: dict) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(F.col(label) == k, F.lit(v)) if expr is None else expr.when(F.col(label) == k, F.lit(v))
    return expr


#: Slices of a histogram, and keys of one slice that the driver sorts.
SLICES, FEW = 4096, 20_000


def histogram(df: DataFrame, group: str, key: Column, low: int, high: int) -> dict:
    """{group: {slice: rows}} over SLICES even slices of low..high."""
    width = max(1, -(-(high - low + 1) // SLICES))
    rows = df.groupBy(F.col(group).alias("_g"), F.floor((key.cast("long") - F.lit(low)) / F.lit(width)).alias("_s")).count().collect()
    out: dict = {}
    for r in rows:  # at most SLICES a group
        out.setdefault(r["_g"], {})[r["_s"]] = r["count"]
    return out


def totals(counts: dict) -> dict:
    return {g: sum(of.values()) for g, of in counts.items()}


def cut_keys(df: DataFrame, group: str, key: Column, counts: dict, ranks: dict, low: int, high: int, id_col: str | None = None) -> dict:
    """(key, id) of the row of each wanted 1-based rank, by (key, id), within each group: {group: {rank: (key, id)}}.

    key: a whole number from low to high; counts: its `histogram`.  ranks: {group: ranks, from 1 to the group's size}.
    """
    keyed = df.select(F.col(group).alias("_g"), key.cast("long").alias("_k"), (F.col(id_col) if id_col else F.lit(None)).alias("_i"))
    wanted = [(g, r, low, high, r) for g, rs in ranks.items() for r in rs]  # group, rank, span, rank within the span
    found = {(g, low, high): of for g, of in counts.items()}
    last = []
    while wanted:
        again = []
        for g, rank, lo, hi, within in wanted:
            step = max(1, -(-(hi - lo + 1) // SLICES))
            for number, n in sorted(found[g, lo, hi].items()):
                if within <= n:
                    span = (g, rank, lo + number * step, min(hi, lo + (number + 1) * step - 1), within)
                    (again if n > FEW and step > 1 else last).append(span)
                    break
                within -= n
        wanted, found = again, {}
        for g, lo, hi in {(g, lo, hi) for g, _, lo, hi, _ in wanted}:  # slices of more than FEW rows are cut again
            here = keyed.where((F.col("_g") == F.lit(g)) & F.col("_k").between(lo, hi))
            found[g, lo, hi] = histogram(here, "_g", F.col("_k"), lo, hi)[g]
    out: dict = {g: {} for g in ranks}
    if last:
        spans, width = {(g, lo, hi) for g, _, lo, hi, _ in last}, max(1, -(-(high - low + 1) // SLICES))
        near = F.lit(False)
        for g, lo, hi in sorted(spans, key=repr):
            near = near | ((F.col("_g") == F.lit(g)) & F.col("_k").between(lo, hi))
        # the first test takes the key once a row, the others run on the few rows that pass it
        near = F.floor((F.col("_k") - F.lit(low)) / F.lit(width)).isin(sorted({(lo - low) // width for _, lo, _ in spans})) & near
        keys = sorted(((r["_g"], r["_k"], r["_i"]) for r in keyed.where(near).collect()), key=lambda r: (repr(r[0]), r[1], (r[2] is not None, r[2])))  # FEW a span
        for g, rank, lo, hi, within in last:
            _, k, i = [r for r in keys if r[0] == g and lo <= r[1] <= hi][within - 1]
            out[g][rank] = (k, i)
    return out


def up_to(group: str, key: Column, cuts: dict, sizes: dict, wanted: dict, id_col: str | None = None) -> Column:
    """Whether a row's rank in its group is at most wanted[group], from the cuts of `cut_keys`."""
    out = F.lit(False)
    for g, rank in wanted.items():
        if rank <= 0:
            continue
        here = F.col(group) == F.lit(g)
        if rank < sizes[g]:
            k, i = cuts[g][rank]
            tied = (key == F.lit(k)) & (F.coalesce(F.col(id_col) <= F.lit(i), F.lit(True)) if id_col else F.lit(True))
            here = here & ((key < F.lit(k)) | tied)
        out = out | here
    return F.coalesce(out, F.lit(False))


def _ranks(sizes: dict, *wanted: dict) -> dict:
    """The ranks that need a cut: not those before the first or from the last row on."""
    return {g: sorted({w[g] for w in wanted if 0 < w[g] < sizes[g]}) for g in sizes}


def _by_hash(df: DataFrame, label: str, id_col: str, seed: int, wanted: Callable[[dict], list[dict]], name: str,
             decide: Callable[[list[Column]], Column]) -> DataFrame:
    """`df` with the column `name` = decide(whether a row is among the first so many of its class by hash, for each of
    wanted(class sizes))."""
    key, ends = uniform_int(F.col(id_col), seed=seed), (0, (1 << 32) - 1)
    counts = histogram(df, label, key, *ends)
    sizes = totals(counts)
    rows = wanted(sizes)
    cuts = cut_keys(df, label, key, counts, _ranks(sizes, *rows), *ends, id_col)
    firsts = [up_to(label, F.col("_key"), cuts, sizes, w, id_col) for w in rows]
    return df.withColumn("_key", key).withColumn(name, decide(firsts)).drop("_key")  # the hash is taken once a row


def stratified_split(df: DataFrame, label: str = "label", id_col: str = "id", test_size: float = 0.2,
                     seed: int = 42, sizes: dict | None = None) -> DataFrame:
    """Adds `split` in {'train','test'}: the first n_train_c rows of each class by u are train."""
    return _by_hash(df, label, id_col, seed, lambda n: [split_sizes(sizes or n, test_size)[0]], "split",
                    lambda first: F.when(first[0], "train").otherwise("test"))


def three_way_split(df: DataFrame, label: str = "label", id_col: str = "id", test_size: float = 0.2,
                    val_size: float = 0.25, seed: int = 42, sizes: dict | None = None) -> DataFrame:
    """Adds `split` in {'train','validation','test'}: test first carved off, then
    validation from the rest; one order, two cut points."""
    def wanted(found: dict) -> list[dict]:
        temp, _ = split_sizes(sizes or found, test_size)
        return [split_sizes(temp, val_size)[0], temp]

    return _by_hash(df, label, id_col, seed, wanted, "split",
                    lambda first: F.when(first[0], "train").when(first[1], "validation").otherwise("test"))


def fold_allocation(sizes: dict, k: int) -> dict:
    """Per class, rows per fold as stratified k-fold assigns them: folds take
    every k-th position of the label-sorted sample."""
    out, start = {}, 0
    for c in sorted(sizes):
        end = start + sizes[c]
        cnt = lambda m, i: max(0, (m - i + k - 1) // k)  # noqa: E731 - #{j < m : j = i mod k}
        out[c] = [cnt(end, i) - cnt(start, i) for i in range(k)]
        start = end
    return out


def kfold(df: DataFrame, label: str = "label", id_col: str = "id", k: int = 5, shuffle: bool = False,
          seed: int = 42, sizes: dict | None = None) -> DataFrame:
    """Adds `fold` in 0..k-1: within each class, contiguous blocks of the row
    order (id order, or hash order when shuffled) sized by `fold_allocation`."""
    def bounds(found: dict) -> list[dict]:
        alloc = fold_allocation(sizes or found, k)
        return [{c: sum(a[: i + 1]) for c, a in alloc.items()} for i in range(k - 1)]

    def fold(firsts: list[Column]) -> Column:
        return sum(((~f).cast("int") for f in firsts), F.lit(0))

    if shuffle:
        return _by_hash(df, label, id_col, seed, bounds, "fold", fold)
    if isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        key = F.col(id_col).cast("long")
        ends = [e or 0 for e in df.agg(F.min(id_col), F.max(id_col)).first()]
        counts = histogram(df, label, key, *ends)
        rows = bounds(totals(counts))
        cuts = cut_keys(df, label, key, counts, _ranks(totals(counts), *rows), *ends)
        return df.withColumn("fold", fold([up_to(label, key, cuts, totals(counts), b) for b in rows]))
    # ids that have no slices, like strings, are ranked
    sizes = sizes or class_sizes(df, label)
    r = rank_by_value(df, [label], id_col, n_buckets=choose_buckets(max(sizes.values())))
    return r.withColumn("fold", sum(((F.col("rank") > _case(label, b)).cast("int") for b in bounds(sizes)), F.lit(0))).drop("rank")


# The train ratios of the train-size sweep.
TRAIN_RATIOS = (0.5, 0.6, 0.7, 0.8)


def train_ratio_sweep(df: DataFrame, label: str = "label", id_col: str = "id",
                      ratios: Sequence[float] = TRAIN_RATIOS, seed: int = 42) -> DataFrame:
    """Long table (train_ratio, id, label, split): one order, one cut point per ratio;
    rows fan out through a generator, not a join."""
    def each(firsts: list[Column]) -> Column:
        return F.array(*[F.struct(F.lit(float(tr)).alias("train_ratio"), F.when(first, "train").otherwise("test").alias("split"))
                         for tr, first in zip(ratios, firsts, strict=True)])

    out = _by_hash(df, label, id_col, seed, lambda n: [split_sizes(n, 1 - tr)[0] for tr in ratios], "_c", each)
    out = out.select(id_col, label, F.explode("_c").alias("_c"))
    return out.select(F.col("_c.train_ratio").alias("train_ratio"), id_col, label, F.col("_c.split").alias("split"))


def learning_subsets(folded: DataFrame, k: int = 5, fracs: Sequence[float] = (0.2, 0.4, 0.6, 0.8, 1.0),
                     label: str = "label", id_col: str = "id", seed: int = 42) -> DataFrame:
    """For each CV split s (train = rows with fold != s), nested shuffled prefixes
    of the train part: (cv_split, id, label, size_index, n_train).

    Absolute sizes are floor(frac * n_max) (at least 1), n_max being the train
    size of split 0, as learning curves define them; a row is in subset i when
    its rank in its split's shuffled train part is <= n_i.
    """
    fold_n = {r["fold"]: r["n"] for r in folded.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_max = sum(fold_n.values()) - fold_n.get(0, 0)
    n_abs = [max(1, min(n_max, int(math.floor(f * n_max)))) for f in fracs]
    ex = folded.select(id_col, label, "fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("cv_split")) \
               .where(F.col("fold") != F.col("cv_split"))
    def each(firsts: list[Column]) -> Column:
        return F.filter(F.array(*[F.when(first, F.struct(F.lit(i).alias("size_index"), F.lit(n).cast("bigint").alias("n_train")))
                                  for i, (n, first) in enumerate(zip(n_abs, firsts, strict=True))]), lambda s: s.isNotNull())

    ex = ex.withColumn("_split_id", F.concat_ws("|", F.col("cv_split").cast("string"), F.col(id_col).cast("string")))
    out = _by_hash(ex, "cv_split", "_split_id", seed, lambda n: [{s: min(m, n[s]) for s in n} for m in n_abs], "_s", each)
    out = out.select("cv_split", id_col, label, F.explode("_s").alias("_s"))
    return out.select("cv_split", id_col, label, F.col("_s.size_index").alias("size_index"), F.col("_s.n_train").alias("n_train"))


def capped_class_sample(df: DataFrame, cap: int = 180, label: str = "label", id_col: str = "id",
                        seed: int = 42) -> DataFrame:
    """At most `cap` rows per class, the ones with the smallest u(seed|id).

    `row_number() <= cap` is planned as a WindowGroupLimit: each map task keeps
    only its top `cap` per class before the shuffle, so no class is gathered whole.
    """
    from pyspark.sql import Window
    w = Window.partitionBy(label).orderBy("_u", id_col)
    with_u = df.withColumn("_u", uniform(F.col(id_col), seed=seed))
    return with_u.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= cap).drop("_u", "_rn")
