"""DuckDB twins of the registered queries (same column names, same rounding)."""

from __future__ import annotations

from calyx.plans.catalog import (BOX_FEATURES, CONT_FEATURES, DUP_COLUMNS, HIGH_CORR_FEATURES,
                                 LEVEL_CANDIDATES, VIF3)
from calyx.plans.sql_fixtures import with_ctes
from calyx.sources.fixtures import LOAN_FEATURES, LOAN_NUMERIC

ORACLE: dict[str, str] = {}

LOAN_COLS = ["id", "age", "experience", "income", "zip", "family", "ccavg", "education", "mortgage",
             "securities_account", "cd_account", "online", "creditcard", "segment", "u", "p", "label"]


def q(name: str, ctes: list[str], body: str, extra: str | None = None) -> None:
    ORACLE[name] = with_ctes(ctes, extra, body)


def alloc_cte(name: str, src: str, test_size: str, counts_col: str = "n_c") -> str:
    """Per-class train allocation (largest remainder, ties to the lower label) of
    `src(label, n_c)` for test share `test_size`: columns (label, n_c, n_train)."""
    return f"""
{name}_t AS (SELECT SUM({counts_col}) AS n, CAST(SUM({counts_col}) - CEIL({test_size} * SUM({counts_col})) AS BIGINT) AS n_draw FROM {src}),
{name}_a AS (SELECT label, {counts_col} AS n_c, {counts_col} * n_draw / n AS cont, FLOOR({counts_col} * n_draw / n) AS fl, n_draw
             FROM {src}, {name}_t),
{name} AS (SELECT label, n_c, CAST(fl + CASE WHEN ROW_NUMBER() OVER (ORDER BY cont - fl DESC, label)
                       <= (SELECT MAX(n_draw) - SUM(fl) FROM {name}_a) THEN 1 ELSE 0 END AS BIGINT) AS n_train
           FROM {name}_a)"""


U42 = "CAST('0x' || SUBSTR(MD5('42|' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296e0"

RANKED = f"""
cc AS (SELECT label, COUNT(*) AS n_c FROM loan_base GROUP BY label),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {U42}, id) AS rk FROM loan_base)"""


def r6(x: str) -> str:
    """Round to 6 decimals; adding 0 turns -0.0 into 0.0 in both engines."""
    return f"(ROUND({x}, 6) + 0e0)"


# ---- A ----
q("load_table", [], "SELECT * FROM customer")
q("load_table_csv", [], "SELECT * FROM customer")
q("loan_base", ["loan_base"], "SELECT * FROM loan_base")
q("require_columns", ["loan_base"], f"SELECT {', '.join(LOAN_FEATURES)} FROM loan_base")

# ---- B ----
q("clip_lower", ["loan_base"],
  "SELECT id, experience AS experience_raw, CASE WHEN experience < 0 THEN 0 ELSE experience END AS experience FROM loan_base")
q("drop_columns", ["loan_base"],
  f"SELECT {', '.join(c for c in LOAN_COLS if c not in ('id', 'zip'))} FROM loan_base")
q("ratio_guarded", ["loan_base"],
  "SELECT id, income / CASE WHEN family = 0 THEN 1 ELSE family END AS income_per_family FROM loan_base")
q("interactions", ["loan_base"],
  "SELECT id, income * education AS income_x_education, ccavg * income AS ccavg_x_income FROM loan_base")
q("ratio_smoothed", ["loan_base"], "SELECT id, mortgage / (income + 1.0e0) AS mortgage_to_income FROM loan_base")
q("bin_labels", ["loan_base"], """
SELECT id, age, income,
  CASE WHEN age > 20 AND age <= 30 THEN '20s' WHEN age > 30 AND age <= 40 THEN '30s'
       WHEN age > 40 AND age <= 50 THEN '40s' WHEN age > 50 AND age <= 60 THEN '50s'
       WHEN age > 60 AND age <= 80 THEN '60+' ELSE 'nan' END AS age_bin,
  CASE WHEN income > 0 AND income <= 40 THEN 'low' WHEN income > 40 AND income <= 80 THEN 'lower_mid'
       WHEN income > 80 AND income <= 120 THEN 'upper_mid' WHEN income > 120 AND income <= 170 THEN 'high'
       WHEN income > 170 AND income <= 300 THEN 'very_high' ELSE 'nan' END AS income_bin
FROM loan_base""")

# ---- C ----
q("table_shape", ["loan_base"], f"SELECT COUNT(*) AS n_rows, CAST({len(LOAN_COLS)} AS BIGINT) AS n_cols FROM loan_base")
q("missing_counts", ["loan_nulls"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, CAST(SUM(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM loan_nulls"
    for c in LOAN_COLS))
q("class_counts", ["loan_base"],
  "SELECT label, COUNT(*) AS n, ROUND(COUNT(*) / SUM(COUNT(*)) OVER (), 6) AS share FROM loan_base GROUP BY label")
q("class_weights", ["loan_base"],
  "SELECT label, COUNT(*) AS n, ROUND(SUM(COUNT(*)) OVER () / (COUNT(*) OVER () * COUNT(*)), 6) AS weight "
  "FROM loan_base GROUP BY label")
q("describe_table", ["loan_nulls"], "\nUNION ALL\n".join(
    f"SELECT '{c}' AS column, COUNT({c}) AS count, {r6(f'AVG({c})')} AS mean, {r6(f'STDDEV_SAMP({c})')} AS std, "
    f"{r6(f'CAST(MIN({c}) AS DOUBLE)')} AS min, {r6(f'QUANTILE_CONT({c}, 0.25)')} AS p25, "
    f"{r6(f'QUANTILE_CONT({c}, 0.5)')} AS p50, {r6(f'QUANTILE_CONT({c}, 0.75)')} AS p75, "
    f"{r6(f'CAST(MAX({c}) AS DOUBLE)')} AS max FROM loan_nulls" for c in CONT_FEATURES))
q("duplicate_rows", ["loan_base"],
  f"SELECT CAST(SUM(n - 1) AS BIGINT) AS n_duplicates, COUNT(*) AS n_distinct FROM "
  f"(SELECT {', '.join(DUP_COLUMNS)}, COUNT(*) AS n FROM loan_base GROUP BY ALL)")

_LONG_BOX = "\nUNION ALL\n".join(f"SELECT label, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM loan_base"
                                 for c in BOX_FEATURES)
q("boxplot_stats", ["loan_base"], """
SELECT l.feature, l.label, s.n, ROUND(s.q1, 6) AS q1, ROUND(s.median, 6) AS median, ROUND(s.q3, 6) AS q3,
       ROUND(MIN(CASE WHEN value >= lo AND value <= hi THEN value END), 6) AS whisker_low,
       ROUND(MAX(CASE WHEN value >= lo AND value <= hi THEN value END), 6) AS whisker_high,
       CAST(SUM(CASE WHEN value >= lo AND value <= hi THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM long l JOIN s USING (feature, label)
GROUP BY l.feature, l.label, s.n, s.q1, s.median, s.q3""", extra=f"""
long AS ({_LONG_BOX}),
s0 AS (SELECT feature, label, COUNT(value) AS n, QUANTILE_CONT(value, 0.25) AS q1, QUANTILE_CONT(value, 0.5) AS median,
              QUANTILE_CONT(value, 0.75) AS q3 FROM long GROUP BY feature, label),
s AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s0)""")

_LONG_LEVELS = "\nUNION ALL\n".join(f"SELECT label, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM loan_base"
                                    for c in LEVEL_CANDIDATES)
q("count_by_feature_class", ["loan_base"], """
SELECT feature, value, label, COUNT(*) AS n FROM long
WHERE feature IN (SELECT feature FROM long GROUP BY feature HAVING COUNT(DISTINCT value) <= 5)
GROUP BY feature, value, label""", extra=f"long AS ({_LONG_LEVELS})")

q("kde_by_class", ["loan_base"], """
SELECT label, grid_index, ROUND(lo + grid_index * step, 6) AS x,
       ROUND(SUM(w * EXP(-0.5 * POWER((lo + grid_index * step - income) / h, 2))) / SQRT(2 * PI()) / (n * h), 9) AS density
FROM vals JOIN st USING (label), (SELECT range AS grid_index FROM range(200)) g
GROUP BY label, grid_index, lo, step, n, h""", extra="""
vals AS (SELECT label, income, COUNT(*) AS w FROM loan_base WHERE income IS NOT NULL GROUP BY label, income),
st0 AS (SELECT label, COUNT(*) AS n, STDDEV_SAMP(income) * POWER(CAST(COUNT(*) AS DOUBLE), -0.2) AS h,
               MIN(income) AS mn, MAX(income) AS mx FROM loan_base WHERE income IS NOT NULL GROUP BY label),
st AS (SELECT label, n, h, mn - 3 * h AS lo, (mx + 3 * h - (mn - 3 * h)) / 199 AS step FROM st0)""")


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


q("corr_matrix", ["loan_base"], "\nUNION ALL\n".join(
    [f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, {r6(f'CORR({a}, {b})')} AS corr FROM loan_base"
     for a, b in _pairs(CONT_FEATURES)]
    + [f"SELECT '{b}' AS feature_a, '{a}' AS feature_b, {r6(f'CORR({a}, {b})')} AS corr FROM loan_base"
       for a, b in _pairs(CONT_FEATURES)]
    + [f"SELECT '{c}' AS feature_a, '{c}' AS feature_b, 1.0e0 AS corr" for c in CONT_FEATURES]))

_CT = "\nUNION ALL\n".join(f"SELECT '{c}' AS feature, CORR({c}, label) AS corr FROM loan_base" for c in CONT_FEATURES)
q("corr_with_target", ["loan_base"],
  f"SELECT feature, {r6('corr')} AS corr, {r6('ABS(corr)')} AS abs_corr, "
  "ROW_NUMBER() OVER (ORDER BY corr DESC, feature) AS rank FROM ct", extra=f"ct AS ({_CT})")

q("drop_high_corr_pair", ["loan_base"], """
SELECT ROUND(pc, 6) AS pair_corr, ROUND(ta, 6) AS a_target_corr, ROUND(tb, 6) AS b_target_corr,
       CASE WHEN pc > 0.95 THEN CASE WHEN ta < tb THEN 'age' ELSE 'experience' END END AS dropped
FROM (SELECT ABS(CORR(age, experience)) AS pc, ABS(CORR(age, label)) AS ta, ABS(CORR(experience, label)) AS tb
      FROM loan_base)""")

_HC = "\nUNION ALL\n".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, CORR({a}, {b}) AS corr, ABS(CORR({a}, label)) AS ta, "
    f"ABS(CORR({b}, label)) AS tb FROM loan_base" for a, b in _pairs(HIGH_CORR_FEATURES))
q("high_corr_pairs", ["loan_base"], """
SELECT feature_a, feature_b, ROUND(corr, 6) + 0e0 AS corr, ROUND(ta, 6) AS a_target_corr, ROUND(tb, 6) AS b_target_corr,
       CASE WHEN ta > tb THEN feature_a ELSE feature_b END AS keep,
       CASE WHEN ta > tb THEN feature_b ELSE feature_a END AS "drop"
FROM hc WHERE ABS(corr) >= 0.8""", extra=f"hc AS ({_HC})")

_a, _b, _c = VIF3
q("vif_table", ["loan_base"], f"""
SELECT feature, ROUND(1 / (1 - r2), 6) AS vif FROM (
  SELECT '{_a}' AS feature, (rab*rab + rac*rac - 2*rab*rac*rbc) / (1 - rbc*rbc) AS r2 FROM r
  UNION ALL SELECT '{_b}', (rab*rab + rbc*rbc - 2*rab*rac*rbc) / (1 - rac*rac) FROM r
  UNION ALL SELECT '{_c}', (rac*rac + rbc*rbc - 2*rab*rac*rbc) / (1 - rab*rab) FROM r)""",
  extra=f"r AS (SELECT CORR({_a}, {_b}) AS rab, CORR({_a}, {_c}) AS rac, CORR({_b}, {_c}) AS rbc FROM loan_base)")

# ---- D ----
q("stratified_split", ["loan_base"], """
SELECT id, ranked.label, CASE WHEN rk <= n_train THEN 'train' ELSE 'test' END AS split
FROM ranked JOIN al USING (label)""", extra=RANKED + "," + alloc_cte("al", "cc", "0.2e0"))

q("three_way_split", ["loan_base"], """
SELECT id, ranked.label, CASE WHEN rk <= tr.n_train THEN 'train' WHEN rk <= tmp.n_train THEN 'validation'
                              ELSE 'test' END AS split
FROM ranked JOIN tmp USING (label) JOIN tr USING (label)""",
  extra=RANKED + "," + alloc_cte("tmp", "cc", "0.2e0") + ","
  + "tmpc AS (SELECT label, n_train AS n_c FROM tmp)," + alloc_cte("tr", "tmpc", "0.25e0"))


def _kfold_sql(order: str) -> str:
    cols = []
    for i in range(4):
        cum = " + ".join(f"(GREATEST(0, (e - {j} + 4) // 5) - GREATEST(0, (s - {j} + 4) // 5))" for j in range(i + 1))
        cols.append(f"{cum} AS b{i}")
    return f"""
cc AS (SELECT label, COUNT(*) AS n_c FROM loan_base GROUP BY label),
se AS (SELECT label, SUM(n_c) OVER (ORDER BY label) - n_c AS s, SUM(n_c) OVER (ORDER BY label) AS e FROM cc),
fb AS (SELECT label, {', '.join(cols)} FROM se),
rk AS (SELECT id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {order}) AS rk FROM loan_base)"""


_FOLD = "SELECT id, label, CAST((rk > b0)::INT + (rk > b1)::INT + (rk > b2)::INT + (rk > b3)::INT AS INT) AS fold " \
        "FROM rk JOIN fb USING (label)"
q("kfold_ordered", ["loan_base"], _FOLD, extra=_kfold_sql("id"))
q("kfold_shuffled", ["loan_base"], _FOLD, extra=_kfold_sql(f"{U42}, id"))

_SWEEP = ",\n".join(
    alloc_cte(f"al{i}", "cc", f"(1e0 - {tr}e0)") for i, tr in enumerate((0.5, 0.6, 0.7, 0.8)))
q("train_ratio_sweep", ["loan_base"], "\nUNION ALL\n".join(
    f"SELECT CAST({tr} AS DOUBLE) AS train_ratio, id, ranked.label, CASE WHEN rk <= n_train THEN 'train' ELSE 'test' END AS split "
    f"FROM ranked JOIN al{i} USING (label)" for i, tr in enumerate((0.5, 0.6, 0.7, 0.8))),
  extra=RANKED + ",\n" + _SWEEP)

q("learning_subsets", ["loan_base"], """
SELECT cv_split, id, label, size_index, n_train FROM ex JOIN sizes ON rk <= n_train""",
  extra=_kfold_sql(f"{U42}, id") + """,
folded AS (SELECT id, label, CAST((rk > b0)::INT + (rk > b1)::INT + (rk > b2)::INT + (rk > b3)::INT AS INT) AS fold
           FROM rk JOIN fb USING (label)),
ex0 AS (SELECT f.*, s.range AS cv_split FROM folded f, range(5) s WHERE f.fold <> s.range),
ex AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cv_split ORDER BY
        CAST('0x' || SUBSTR(MD5('42|' || CAST(cv_split AS VARCHAR) || '|' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT), id) AS rk2
       FROM ex0),
nmax AS (SELECT COUNT(*) AS m FROM ex0 WHERE cv_split = 0),
sizes AS (SELECT i AS size_index, CAST(GREATEST(1, LEAST(m, FLOOR(f * m))) AS BIGINT) AS n_train
          FROM nmax, (VALUES (0, 0.2e0), (1, 0.4e0), (2, 0.6e0), (3, 0.8e0), (4, 1.0e0)) v(i, f))""")
ORACLE["learning_subsets"] = ORACLE["learning_subsets"].replace("ON rk <= n_train", "ON rk2 <= n_train")

q("capped_class_sample", ["loan_base"],
  f"SELECT id, label FROM (SELECT id, label, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {U42}, id) AS rn "
  f"FROM loan_base) WHERE rn <= 180")


# ---- H / G on score tables ----
def _metrics_ctes(src: str, g: str) -> str:
    """CTEs conf, sc (score counts), ar (areas), br (brier), mt (metrics table) grouped by g."""
    return f"""
conf AS (SELECT {g},
    CAST(SUM(CASE WHEN score < 0.5e0 AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
    CAST(SUM(CASE WHEN score >= 0.5e0 AND label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
    CAST(SUM(CASE WHEN score < 0.5e0 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
    CAST(SUM(CASE WHEN score >= 0.5e0 AND label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp
  FROM {src} GROUP BY {g}),
hist AS (SELECT {g}, score, CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
                CAST(SUM(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM {src} GROUP BY {g}, score),
sc AS (SELECT *, SUM(pos) OVER (PARTITION BY {g} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS tp,
              SUM(neg) OVER (PARTITION BY {g} ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS fp,
              SUM(pos) OVER (PARTITION BY {g}) AS P, SUM(neg) OVER (PARTITION BY {g}) AS N FROM hist),
sc2 AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS prec,
               CASE WHEN (tp - pos) + (fp - neg) = 0 THEN 1e0 ELSE (tp - pos) / ((tp - pos) + (fp - neg)) END AS prev
        FROM sc),
ar AS (SELECT {g}, SUM(neg * (tp - pos + 0.5e0 * pos)) / (MAX(P) * MAX(N)) AS roc_auc,
              SUM(pos * (prec + prev) / 2e0) / MAX(P) AS pr_auc, SUM(pos * prec) / MAX(P) AS average_precision
       FROM sc2 GROUP BY {g}),
br AS (SELECT {g}, AVG((score - label) * (score - label)) AS brier FROM {src} GROUP BY {g}),
mt AS (SELECT {g}, 0.5e0 AS threshold, (tn + tp) / (tn + fp + fn + tp) AS accuracy,
              CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS precision,
              CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END AS recall,
              CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
              roc_auc, pr_auc, average_precision, brier, tn, fp, fn, tp
       FROM conf JOIN ar USING ({g}) JOIN br USING ({g}))"""


_MT = _metrics_ctes("score_variants", "variant")
_MCOLS = ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "average_precision", "brier"]


def _r(cols):
    return ", ".join(f"{r6(c)} AS {c}" for c in cols)


q("apply_threshold", ["score_variants"],
  "SELECT variant, id, label, score, CAST(score >= 0.5e0 AS INT) AS pred FROM score_variants")
q("confusion_matrix", ["score_variants"], "SELECT variant, tn, fp, fn, tp FROM conf", extra=_MT)
q("basic_metrics", ["score_variants"], f"SELECT variant, {_r(['accuracy', 'precision', 'recall', 'f1'])} FROM mt",
  extra=_MT)
q("classification_report", ["score_variants"], f"""
SELECT variant, row, {_r(['precision', 'recall', 'f1'])}, support FROM (
  SELECT variant, '0' AS row, CASE WHEN tn + fn = 0 THEN 0e0 ELSE tn / (tn + fn) END AS precision,
         CASE WHEN tn + fp = 0 THEN 0e0 ELSE tn / (tn + fp) END AS recall,
         CASE WHEN 2 * tn + fn + fp = 0 THEN 0e0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f1, tn + fp AS support FROM conf
  UNION ALL
  SELECT variant, '1', p1, r1, f1_1, s1 FROM rp
  UNION ALL
  SELECT variant, 'accuracy', NULL, NULL, (tn + tp) / (tn + fp + fn + tp), tn + fp + fn + tp FROM conf
  UNION ALL
  SELECT variant, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f1_0 + f1_1) / 2, n FROM rp
  UNION ALL
  SELECT variant, 'weighted avg', (p0 * s0 + p1 * s1) / n, (r0 * s0 + r1 * s1) / n, (f1_0 * s0 + f1_1 * s1) / n, n FROM rp)""",
  extra=_MT + """,
rp AS (SELECT variant, tn + fp + fn + tp AS n, tn + fp AS s0, tp + fn AS s1,
         CASE WHEN tn + fn = 0 THEN 0e0 ELSE tn / (tn + fn) END AS p0, CASE WHEN tn + fp = 0 THEN 0e0 ELSE tn / (tn + fp) END AS r0,
         CASE WHEN 2 * tn + fn + fp = 0 THEN 0e0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f1_0,
         CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS p1, CASE WHEN tp + fn = 0 THEN 0e0 ELSE tp / (tp + fn) END AS r1,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1_1 FROM conf)""")
q("weighted_f1", ["score_variants"],
  f"SELECT variant, {r6('(f1_0 * s0 + f1_1 * s1) / n')} AS weighted_f1 FROM rp",
  extra=_MT + """,
rp AS (SELECT variant, tn + fp + fn + tp AS n, tn + fp AS s0, tp + fn AS s1,
         CASE WHEN 2 * tn + fn + fp = 0 THEN 0e0 ELSE 2 * tn / (2 * tn + fn + fp) END AS f1_0,
         CASE WHEN 2 * tp + fp + fn = 0 THEN 0e0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1_1 FROM conf)""")
q("roc_curve", ["score_variants"],
  f"SELECT variant, score AS threshold, {r6('fp / N')} AS fpr, {r6('tp / P')} AS tpr FROM sc "
  "UNION ALL SELECT DISTINCT variant, CAST(NULL AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM sc", extra=_MT)
q("roc_auc", ["score_variants"], f"SELECT variant, {r6('roc_auc')} AS roc_auc FROM ar", extra=_MT)
q("pr_curve", ["score_variants"],
  f"SELECT variant, score AS threshold, {r6('prec')} AS precision, {r6('tp / P')} AS recall FROM sc2 "
  "UNION ALL SELECT DISTINCT variant, CAST(NULL AS DOUBLE), CAST(1 AS DOUBLE), CAST(0 AS DOUBLE) FROM sc2", extra=_MT)
q("pr_auc_trapezoid", ["score_variants"], f"SELECT variant, {r6('pr_auc')} AS pr_auc FROM ar", extra=_MT)
q("average_precision", ["score_variants"],
  f"SELECT variant, {r6('average_precision')} AS average_precision FROM ar", extra=_MT)

_SWEEP_CTE = """
sb AS (SELECT variant, score, CAST(SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pos,
              CAST(SUM(CASE WHEN label <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS neg
       FROM score_variants GROUP BY ALL),
tot AS (SELECT variant, SUM(pos) AS P, SUM(neg) AS N FROM sb GROUP BY variant),
grid AS (SELECT variant, P, N, i FROM tot, range(5, 96) r(i)),
sw0 AS (SELECT g.variant, g.i, g.P, g.N, COALESCE(SUM(sb.pos), 0) AS tp, COALESCE(SUM(sb.neg), 0) AS fp
        FROM grid g LEFT JOIN sb ON sb.variant = g.variant AND sb.score >= g.i / 100e0 GROUP BY g.variant, g.i, g.P, g.N),
sw AS (SELECT variant, i / 100e0 AS threshold,
              CASE WHEN tp + fp = 0 THEN 0e0 ELSE tp / (tp + fp) END AS precision,
              CASE WHEN P = 0 THEN 0e0 ELSE tp / P END AS recall,
              CASE WHEN 2 * tp + fp + (P - tp) = 0 THEN 0e0 ELSE 2 * tp / (2 * tp + fp + (P - tp)) END AS f1,
              (CASE WHEN P = 0 THEN 0e0 ELSE tp / P END) - fp / GREATEST(N, 1) AS youden_j FROM sw0)"""
q("threshold_sweep", ["score_variants"],
  f"SELECT variant, {_r(['threshold', 'precision', 'recall', 'f1', 'youden_j'])} FROM sw", extra=_SWEEP_CTE)
q("youden_j", ["score_variants"], f"SELECT variant, {_r(['threshold', 'youden_j'])} FROM sw", extra=_SWEEP_CTE)
q("best_threshold", ["score_variants"], f"""
SELECT a.variant, {r6('a.threshold')} AS best_f1_threshold, {r6('a.f1')} AS best_f1,
       {r6('b.threshold')} AS best_j_threshold, {r6('b.youden_j')} AS best_j
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY variant ORDER BY f1 DESC, recall DESC, threshold) AS r FROM sw) a
JOIN (SELECT *, ROW_NUMBER() OVER (PARTITION BY variant ORDER BY youden_j DESC, threshold) AS r FROM sw) b
  ON a.variant = b.variant AND a.r = 1 AND b.r = 1""", extra=_SWEEP_CTE)
q("calibration_curve", ["score_variants"], f"""
SELECT variant, bin, {r6('AVG(score)')} AS mean_predicted, {r6('AVG(CAST(label AS DOUBLE))')} AS fraction_positive,
       COUNT(*) AS n
FROM (SELECT *, CAST({' + '.join(f"(CASE WHEN score > {i * 0.1!r}e0 THEN 1 ELSE 0 END)" for i in range(1, 10))} AS INT) AS bin
      FROM score_variants) GROUP BY variant, bin""")
q("brier", ["score_variants"], f"SELECT variant, {r6('brier')} AS brier FROM br", extra=_MT)

_SPLIT_SRC = RANKED + "," + alloc_cte("al", "cc", "0.2e0") + """,
splitted AS (SELECT id, ranked.label, p AS score, CASE WHEN rk <= n_train THEN 'train' ELSE 'test' END AS split
             FROM ranked JOIN al USING (label))"""
q("train_test_metrics", ["loan_base"],
  "\nUNION ALL\n".join(f"SELECT split, '{m}' AS metric, {r6(m)} AS value FROM mt" for m in _MCOLS),
  extra=_SPLIT_SRC + "," + _metrics_ctes("splitted", "split"))

_MT_SEL = f"variant, {r6('threshold')} AS threshold, {_r(_MCOLS)}, tn, fp, fn, tp"
q("name_filter", ["score_variants"],
  f"SELECT {_MT_SEL} FROM mt WHERE COALESCE(CONTAINS(LOWER(variant), 'lr'), FALSE)", extra=_MT)
q("unpivot_metrics", ["score_variants"],
  "\nUNION ALL\n".join(f"SELECT variant, '{m}' AS metric, {r6(m)} AS value FROM mt" for m in _MCOLS), extra=_MT)
q("rank_models", ["score_variants"],
  f"SELECT {_MT_SEL}, ROW_NUMBER() OVER (ORDER BY f1 DESC, roc_auc DESC, recall DESC, variant) AS rank FROM mt",
  extra=_MT)
q("sink_roundtrip", ["score_variants"], f"SELECT variant, {r6('f1')} AS f1_csv, {r6('f1')} AS f1_parquet FROM mt", extra=_MT)
q("compare_variants", ["score_variants"], "\nUNION ALL\n".join(
    f"SELECT '{m}' AS metric, {r6(f'CAST(b.{m} AS DOUBLE)')} AS baseline, {r6(f'CAST(i.{m} AS DOUBLE)')} AS improved, "
    f"{r6(f'CAST(i.{m} AS DOUBLE) - CAST(b.{m} AS DOUBLE)')} AS delta "
    f"FROM mt b, mt i WHERE b.variant = 'lr_planted' AND i.variant = 'LR_sqrt'"
    for m in ["accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc", "fn", "fp"]), extra=_MT)

_FOLDED = _kfold_sql(f"{U42}, id") + """,
folded AS (SELECT rk.id, rk.label, l.p AS score,
                  CAST((rk > b0)::INT + (rk > b1)::INT + (rk > b2)::INT + (rk > b3)::INT AS INT) AS fold
           FROM rk JOIN fb USING (label) JOIN loan_base l ON l.id = rk.id)"""
q("cv_summary", ["loan_base"], f"""
SELECT metric, {r6('AVG(value)')} AS mean, {r6('STDDEV_POP(value)')} AS std, COUNT(*) AS n_folds FROM (
  {' UNION ALL '.join(f"SELECT fold, '{m}' AS metric, CAST({m} AS DOUBLE) AS value FROM mt" for m in ['accuracy', 'precision', 'recall', 'f1', 'roc_auc'])})
GROUP BY metric""", extra=_FOLDED + "," + _metrics_ctes("folded", "fold"))


# ---- E: encoders ----
def _train_cte(src: str) -> str:
    return f"""
cc AS (SELECT label, COUNT(*) AS n_c FROM {src} GROUP BY label),
rkd AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY label ORDER BY {U42}, id) AS rk FROM {src}),""" + \
        alloc_cte("al", "cc", "0.2e0") + """,
train AS (SELECT rkd.* FROM rkd JOIN al USING (label) WHERE rk <= n_train)"""


q("impute_median", ["loan_nulls"], f"""
SELECT id, {r6('COALESCE(income, mi)')} AS income, {r6('COALESCE(ccavg, mc)')} AS ccavg
FROM loan_nulls, (SELECT MEDIAN(income) AS mi, MEDIAN(ccavg) AS mc FROM train)""", extra=_train_cte("loan_nulls"))
q("impute_mode", ["loan_nulls"], """
SELECT id, COALESCE(segment, ms) AS segment, COALESCE(family, mf) AS family FROM loan_nulls,
  (SELECT segment AS ms FROM train WHERE segment IS NOT NULL GROUP BY segment ORDER BY COUNT(*) DESC, segment LIMIT 1),
  (SELECT family AS mf FROM train WHERE family IS NOT NULL GROUP BY family ORDER BY COUNT(*) DESC, family LIMIT 1)""",
  extra=_train_cte("loan_nulls"))
_SC = ["age", "experience", "income", "mortgage"]
q("standard_scale", ["loan_base"],
  "SELECT id, " + ", ".join(
      f"{r6(f'({c} - m_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1 ELSE s_{c} END')} AS {c}" for c in _SC)
  + " FROM loan_base, (SELECT " + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in _SC)
  + " FROM train)", extra=_train_cte("loan_base"))
q("onehot_drop_first", ["loan_base"], """
SELECT id, l.segment, CAST(c.pos - 2 AS INT) AS slot, (SELECT CAST(COUNT(*) - 1 AS INT) FROM cats) AS n_slots
FROM loan_base l LEFT JOIN cats c ON l.segment = c.segment AND c.pos > 1""", extra=_train_cte("loan_base") + """,
cats AS (SELECT segment, ROW_NUMBER() OVER (ORDER BY segment) AS pos
         FROM (SELECT DISTINCT segment FROM train WHERE segment <> 'MACHINERY' AND segment IS NOT NULL))""")
q("onehot_full", ["loan_base"], """
SELECT id, l.zip, CAST(c.pos - 1 AS INT) AS slot, (SELECT CAST(COUNT(*) AS INT) FROM cats) AS n_slots
FROM loan_base l LEFT JOIN cats c ON CAST(l.zip AS VARCHAR) = c.z""", extra=_train_cte("loan_base") + """,
cats AS (SELECT z, ROW_NUMBER() OVER (ORDER BY z) AS pos
         FROM (SELECT DISTINCT CAST(zip AS VARCHAR) AS z FROM train WHERE CAST(zip AS VARCHAR) <> '7'))""")


# ---- D7 SMOTE (brute-force neighbours in the oracle) ----
def _u(key: str) -> str:
    return f"(CAST('0x' || SUBSTR(MD5({key}), 1, 8) AS BIGINT) / 4294967296e0)"


q("smote", ["loan_base"], """
SELECT s.syn_id, b.id AS base_id, nn.nn_id, s.lam,
       b.income + s.lam * (x.income - b.income) AS income,
       b.ccavg + s.lam * (x.ccavg - b.ccavg) AS ccavg,
       b.mortgage + s.lam * (x.mortgage - b.mortgage) AS mortgage,
       1 AS label
FROM s2 s JOIN ranked b ON b.r = s.r
JOIN nn ON nn.rep = b.rep AND nn.nn_rank = s.nn_rank
JOIN reps x ON x.rep = nn.nn_id""", extra=f"""
mr AS (SELECT id, CAST(income AS DOUBLE) AS income, CAST(ccavg AS DOUBLE) AS ccavg, CAST(mortgage AS DOUBLE) AS mortgage
       FROM loan_base WHERE label = 1),
reps AS (SELECT income, ccavg, mortgage, MIN(id) AS rep FROM mr GROUP BY income, ccavg, mortgage),
pairs AS (SELECT a.rep, b.rep AS nn_id,
                 (a.income - b.income) * (a.income - b.income) + (a.ccavg - b.ccavg) * (a.ccavg - b.ccavg)
                 + (a.mortgage - b.mortgage) * (a.mortgage - b.mortgage) AS dist2
          FROM reps a, reps b WHERE a.rep <> b.rep),
kk AS (SELECT LEAST(5, COUNT(*) - 1) AS k FROM reps),
nn AS (SELECT * FROM (SELECT rep, nn_id, ROW_NUMBER() OVER (PARTITION BY rep ORDER BY dist2, nn_id) AS nn_rank FROM pairs)
       WHERE nn_rank <= (SELECT k FROM kk)),
ranked AS (SELECT mr.*, reps.rep, ROW_NUMBER() OVER (ORDER BY mr.id) AS r
           FROM mr JOIN reps USING (income, ccavg, mortgage)),
cnt AS (SELECT SUM(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS m, SUM(CASE WHEN label = 0 THEN 1 ELSE 0 END) AS n0 FROM loan_base),
s1 AS (SELECT ROW_NUMBER() OVER () - 1 AS syn_id FROM loan_base),
s2 AS (SELECT syn_id,
              CAST(FLOOR({_u("'42|' || CAST(syn_id AS VARCHAR) || '|base'")} * m) + 1 AS BIGINT) AS r,
              CAST(FLOOR({_u("'42|' || CAST(syn_id AS VARCHAR) || '|nn'")} * (SELECT k FROM kk)) + 1 AS INT) AS nn_rank,
              {_u("'42|' || CAST(syn_id AS VARCHAR) || '|lam'")} AS lam
       FROM s1, cnt WHERE syn_id < n0 - m)""")


# ---- I2 ----
_SCORE_COLS = ["age", "experience", "income", "family", "ccavg", "education", "mortgage",
               "securities_account", "cd_account", "online", "creditcard", "segment"]
_NM = " + ".join(f"CAST({c} IS NULL AS INT)" for c in _SCORE_COLS)
_MISS = ", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in _SCORE_COLS)
q("complete_rows", ["loan_nulls"], f"""
SELECT id, {_NM} AS n_missing, CONCAT_WS(',', {_MISS}) AS missing_columns,
       CASE WHEN {_NM} = 0 THEN 'complete' ELSE 'rejected' END AS status
FROM loan_nulls""")

q("doc_class_counts", ["doc_base"],
  "SELECT toxic, quality, COUNT(*) AS n, ROUND(AVG(chars_per_word), 6) AS mean_chars_per_word "
  "FROM doc_base GROUP BY toxic, quality")


# ---- H18 with an expression scorer ----
_PF = ["income", "experience", "ccavg"]
_RULE = ("CAST(({i} / 20e0 + {e} / 40e0 + CASE WHEN segment = 'BUILDING' THEN 1e0 ELSE 0e0 END - 7e0) >= 0 AS INT)")
_F1 = ("CASE WHEN 2 * SUM(pred * label) + SUM(pred * (1 - label)) + SUM((1 - pred) * label) = 0 THEN 0e0 "
       "ELSE 2 * SUM(pred * label) / (2 * SUM(pred * label) + SUM(pred * (1 - label)) + SUM((1 - pred) * label)) END")
_UP = "CAST('0x' || SUBSTR(MD5('42|' || f || '|' || CAST(r AS VARCHAR) || '|' || CAST(id AS VARCHAR)), 1, 8) AS BIGINT)"
q("permutation_importance_expr", ["loan_base"], f"""
SELECT feature, {r6('AVG(drop)')} AS importance_mean, {r6('STDDEV_POP(drop)')} AS importance_std FROM (
  SELECT f AS feature, r, (SELECT f1 FROM base_f1) - {_F1} AS drop
  FROM (SELECT f, r, label, {_RULE.format(i='p_income', e='p_experience')} AS pred, segment FROM perm)
  GROUP BY f, r)
GROUP BY feature""", extra=f"""
src AS (SELECT id, label, segment, income, experience, ccavg FROM loan_base),
base_f1 AS (SELECT {_F1} AS f1 FROM (SELECT label, {_RULE.format(i='income', e='experience')} AS pred FROM src)),
keys AS (SELECT f, r FROM (VALUES ('income'), ('experience'), ('ccavg')) fs(f), range(10) rr(r)),
ex AS (SELECT s.*, k.f, k.r, ROW_NUMBER() OVER (PARTITION BY k.f, k.r ORDER BY s.id) AS pos FROM src s, keys k),
dn AS (SELECT f, r, income AS d_income, experience AS d_experience, ccavg AS d_ccavg,
              ROW_NUMBER() OVER (PARTITION BY f, r ORDER BY {_UP}, id) AS pos FROM ex),
perm AS (SELECT ex.id, ex.label, ex.segment, ex.f, ex.r,
                CASE WHEN ex.f = 'income' THEN dn.d_income ELSE ex.income END AS p_income,
                CASE WHEN ex.f = 'experience' THEN dn.d_experience ELSE ex.experience END AS p_experience,
                CASE WHEN ex.f = 'ccavg' THEN dn.d_ccavg ELSE ex.ccavg END AS p_ccavg
         FROM ex JOIN dn ON ex.f = dn.f AND ex.r = dn.r AND ex.pos = dn.pos)""")


# ---- F7 isotonic fit: fitted_i = max_{j<=i} min_{k>=i} mean(y[j..k]) over distinct x ----
q("isotonic_fit", ["score_variants"], f"""
SELECT variant, x AS score, {r6('MAX(mn)')} AS fitted FROM low GROUP BY variant, x""", extra="""
d AS (SELECT variant, score AS x, SUM(label) AS sy, COUNT(*) AS w, ROW_NUMBER() OVER (PARTITION BY variant ORDER BY score) AS i
      FROM score_variants GROUP BY variant, score),
c AS (SELECT variant, x, i, sy, w, SUM(sy) OVER (PARTITION BY variant ORDER BY i) AS csy,
             SUM(w) OVER (PARTITION BY variant ORDER BY i) AS cw FROM d),
seg AS (SELECT a.variant, a.i AS j, b.i AS k, b.x, (b.csy - a.csy + a.sy) / (b.cw - a.cw + a.w) AS m
        FROM c a JOIN c b ON a.variant = b.variant AND a.i <= b.i),
low AS (SELECT variant, x, MIN(m) OVER (PARTITION BY variant, j ORDER BY k DESC) AS mn FROM seg)""")


# ---- E6, E7: assembled slots ----
_SLOTS = """,
clipped AS (SELECT * REPLACE (GREATEST(experience, 0) AS experience) FROM loan_base),
st AS (SELECT """ + ", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in LOAN_NUMERIC) + """
       FROM (SELECT * REPLACE (GREATEST(experience, 0) AS experience) FROM train)),
cats AS (SELECT segment, ROW_NUMBER() OVER (ORDER BY segment) AS pos FROM (SELECT DISTINCT segment FROM train))"""
q("assemble_features", ["loan_base"], f"SELECT id, CAST(idx AS INT) AS idx, {r6('value')} AS value FROM (" + " UNION ALL ".join(
    f"SELECT id, {i} AS idx, ({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END AS value FROM clipped, st"
    for i, c in enumerate(LOAN_NUMERIC)) + f"""
  UNION ALL SELECT id, {len(LOAN_NUMERIC)} + pos - 2, CASE WHEN l.segment = c.segment THEN 1e0 ELSE 0e0 END
  FROM clipped l, cats c WHERE pos > 1)""", extra=_train_cte("loan_base") + _SLOTS)
q("feature_names", ["loan_base"], "SELECT CAST(idx AS INT) AS idx, name FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS idx, '{c}' AS name" for i, c in enumerate(LOAN_NUMERIC)) + f"""
  UNION ALL SELECT {len(LOAN_NUMERIC)} + pos - 2, 'segment__' || segment FROM cats WHERE pos > 1)""",
  extra=_train_cte("loan_base") + _SLOTS)

# ---- D7 on the embeddings: the smaller class grows to the size of the larger ----
q("smote_embeddings", [], """
SELECT label, false AS synthetic, n FROM sizes
UNION ALL SELECT a.label, true, b.n - a.n FROM sizes a JOIN sizes b ON a.label <> b.label AND a.n < b.n""", extra="""
sizes AS (SELECT CASE WHEN label = 0 THEN 1 ELSE 0 END AS label, COUNT(*) AS n FROM embeddings GROUP BY 1)""")
