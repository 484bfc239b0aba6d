"""DuckDB text of the study tables, used as CTEs by the oracle SQL.

Each constant is a `name AS (...)` fragment; `with_ctes` stitches the needed
ones (with their dependencies) in front of a query.
"""

from __future__ import annotations

from calyx.functions.hashing import duck_uniform

LOAN_BASE = f"""
loan_o AS (
  SELECT o_custkey, COUNT(*) AS n_orders, SUM(o_totalprice) AS spend, AVG(o_totalprice) AS avg_order,
         SUM(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS n_urgent
  FROM orders GROUP BY o_custkey),
loan_b AS (
  SELECT c_custkey AS id,
         ROUND(25 + c_acctbal / 100e0 + n_urgent, 4) AS age,
         ROUND(c_acctbal / 100e0, 4) AS experience,
         ROUND(spend / 40000e0, 4) AS income,
         c_nationkey AS zip,
         CAST(1 + n_orders % 4 AS INT) AS family,
         ROUND(avg_order / 100000e0, 4) AS ccavg,
         CAST(1 + c_custkey % 3 AS INT) AS education,
         ROUND(GREATEST(spend / 10000e0 - 250, 0), 4) AS mortgage,
         CASE WHEN n_urgent >= 3 THEN 1 ELSE 0 END AS securities_account,
         CASE WHEN n_urgent >= 5 THEN 1 ELSE 0 END AS cd_account,
         CASE WHEN c_custkey % 5 < 3 THEN 1 ELSE 0 END AS online,
         CASE WHEN c_custkey % 10 < 3 THEN 1 ELSE 0 END AS creditcard,
         c_mktsegment AS segment,
         {duck_uniform("'loan|' || CAST(c_custkey AS VARCHAR)")} AS u
  FROM customer JOIN loan_o ON c_custkey = o_custkey),
loan_s AS (
  SELECT *, ROUND(1e0 / (1e0 + EXP(-(income / 20e0 + experience / 40e0
            + CASE WHEN segment = 'BUILDING' THEN 1e0 ELSE 0e0 END - 7e0))), 6) AS p
  FROM loan_b),
loan_base AS (SELECT *, CASE WHEN u < p THEN 1 ELSE 0 END AS label FROM loan_s)"""

LOAN_NULLS = """
loan_nulls AS (
  SELECT * REPLACE (
    CASE WHEN id % 7 = 0 THEN NULL ELSE income END AS income,
    CASE WHEN id % 11 = 0 THEN NULL ELSE segment END AS segment,
    CASE WHEN id % 13 = 0 THEN NULL ELSE ccavg END AS ccavg)
  FROM loan_base)"""

SCORES = """
scores AS (SELECT id, label, p AS score FROM loan_base)"""

SCORE_VARIANTS = """
score_variants AS (
  SELECT 'lr_planted' AS variant, id, label, p AS score FROM loan_base
  UNION ALL SELECT 'LR_sqrt', id, label, ROUND(SQRT(p), 6) FROM loan_base
  UNION ALL SELECT 'tree_tied', id, label, ROUND(p, 1) FROM loan_base)"""

LINE_BASE = f"""
line_b AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus,
         {duck_uniform("'li|' || CAST(l_orderkey AS VARCHAR) || '|' || CAST(l_linenumber AS VARCHAR) || '|' || CAST(l_partkey AS VARCHAR) || '|' || CAST(l_suppkey AS VARCHAR)")} AS u,
         ROUND(1e0 / (1e0 + EXP(-(l_quantity / 12e0 + 20e0 * l_discount - 6e0))), 6) AS p
  FROM lineitem),
line_base AS (SELECT *, CASE WHEN u < p THEN 1 ELSE 0 END AS label FROM line_b)"""

DOC_BASE = """
doc_base AS (
  SELECT doc_id, lang, source, n_chars, quality, toxic,
         CAST(LENGTH(text) - LENGTH(REPLACE(text, ' ', '')) + 1 AS BIGINT) AS n_words,
         ROUND(n_chars / CAST(LENGTH(text) - LENGTH(REPLACE(text, ' ', '')) + 1 AS DOUBLE), 4) AS chars_per_word
  FROM documents JOIN labels USING (doc_id))"""

_CTES = {
    "loan_base": (LOAN_BASE, []),
    "loan_nulls": (LOAN_NULLS, ["loan_base"]),
    "scores": (SCORES, ["loan_base"]),
    "score_variants": (SCORE_VARIANTS, ["loan_base"]),
    "line_base": (LINE_BASE, []),
    "doc_base": (DOC_BASE, []),
}


def with_ctes(names: list[str], extra: str | None, body: str) -> str:
    """`WITH <fixture ctes>[, extra] <body>`; dependencies are added in order."""
    order: list[str] = []

    def add(n: str) -> None:
        for dep in _CTES[n][1]:
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    parts = [_CTES[n][0].strip() for n in order]
    if extra:
        parts.append(extra.strip())
    if not parts:
        return body.strip()
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
