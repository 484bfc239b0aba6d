"""DuckDB twins of the training-data queries, where SQL can express them over whole tables.

op3: runs of lines by their text.  op7: windows of 13 words by their text.
op8: all products of queries and rows.  op9: the same keys, filling and cut as the operator, in one pass.
op11: every document that shares a term, scored.  op12: every run of 1 to 4 words, counted.
Not here: op13 (a language model), op1, op4 and op10 (tokenizers), op5 (its doubles may differ in the last place), op6 (a language model) and
op2 and the pipeline (groups by repeated comparison); tests hold these against brute force.
"""

from __future__ import annotations

from calyx.llm import lexical_search, line_dedup, mixing, phrases, substring_dedup, terms

ORACLE: dict[str, str] = {}

#: Words of a text: white space is \x20 and \x09-\x0D.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLE["op3_line_dedup"] = rf"""
WITH split AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS line
               FROM (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL)),
seq AS (SELECT *, row_number() OVER d AS place, lead(body) OVER d AS next_body, lead(line) OVER d AS next_line,
               len(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS words
        FROM split WHERE regexp_matches(body, '[^\x20\x09-\x0D]') WINDOW d AS (PARTITION BY doc_id, text ORDER BY line)),
marked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, place) > 1 AS seen,
                  row_number() OVER (PARTITION BY body, next_body ORDER BY doc_id, place) > 1 AS pair_seen FROM seq),
gone AS (SELECT doc_id, text, line FROM marked WHERE seen AND words >= {line_dedup.LONG_LINE}
         UNION SELECT doc_id, text, line FROM marked WHERE pair_seen AND next_body IS NOT NULL
         UNION SELECT doc_id, text, next_line FROM marked WHERE pair_seen AND next_body IS NOT NULL),
kept AS (SELECT s.doc_id, s.text, count(*) AS n_lines, count(g.line) AS n_removed,
                coalesce(string_agg(s.body, chr(10) ORDER BY s.line) FILTER (WHERE g.line IS NULL), '') AS body
         FROM split s LEFT JOIN gone g ON g.doc_id = s.doc_id AND g.text = s.text AND g.line = s.line GROUP BY s.doc_id, s.text)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(k.body) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id AND d.text = k.text"""

_N = substring_dedup.WINDOW
ORACLE["op7_substring_dedup"] = f"""
WITH w AS (SELECT doc_id, {_WORDS} AS words FROM documents),
win AS (SELECT doc_id, unnest(range(1, greatest(len(words) - {_N - 2}, 1))) AS pos, words FROM w),
keyed AS (SELECT doc_id, pos, array_to_string(words[pos:pos + {_N - 1}], ' ') AS run FROM win WHERE pos + {_N - 1} <= len(words)),
hits AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY run) AS least FROM keyed) WHERE least < doc_id),
off AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + {_N})) AS i FROM hits),
each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, count(off.i) AS n_removed, coalesce(string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE off.i IS NULL), '') AS body
         FROM each e LEFT JOIN off ON off.doc_id = e.doc_id AND off.i = e.i GROUP BY e.doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.body, '')) AS kept_sha256
FROM w LEFT JOIN kept k ON k.doc_id = w.doc_id"""

ORACLE["op8_exact_topk"] = """
WITH v AS (SELECT vec_id, [floor(1024 * CAST(x AS DOUBLE)) for x in embedding] AS ints FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in embedding])),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.ints, c.ints) AS BIGINT) AS score
           FROM v q JOIN v c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM ranked WHERE rank <= 10"""

ORACLE["op9_mixing"] = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size, length(text) AS chars,
                  (CAST('0x' || substr(md5('{mixing.SEED}|' || doc_id), 1, 13) AS BIGINT) + 0.5) / 4503599627370496e0 AS u FROM documents),
k AS (SELECT *, -ln(u) / CASE WHEN chars BETWEEN {mixing.WORD_LENGTH[0]} * size AND {mixing.WORD_LENGTH[1]} * size THEN 1e0
                              ELSE {mixing.LOW_QUALITY}e0 END AS sort_key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             [3, 1, 2][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM k GROUP BY source),
f AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS weight_left,
             coalesce(sum(source_size) OVER o, 0) * 2e0 AS used, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS place
      FROM s WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (CAST(total AS DOUBLE) * 1.5e0 - used) / weight_left AS step FROM f),
m AS (SELECT arg_min(step, place) AS level FROM l WHERE source_size * 2e0 > step * weight),
t AS (SELECT source, source_size, least(source_size * 2e0, coalesce(level * weight, source_size * 2e0)) AS target FROM l, m),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t),
r AS (SELECT k.doc_id, k.source, k.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
             sum(k.size) OVER (PARTITION BY k.source ORDER BY k.sort_key, k.doc_id ROWS UNBOUNDED PRECEDING) - k.size AS running
      FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, CAST(epochs + CASE WHEN rest > 0 AND running + size / 2e0 <= rest THEN 1 ELSE 0 END AS INT) AS copies FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(copies * size AS BIGINT) AS taken, source, copies FROM c"""

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '{terms.TERM}')"
ORACLE["op11_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS terms FROM documents),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM d) GROUP BY r, term),
size AS (SELECT r, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
whole AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS total FROM size),
q AS (SELECT i, item_id, term, count(*) AS qtf
      FROM (SELECT i, item_id, unnest({_TERMS}) AS term FROM (SELECT row_number() OVER () AS i, * FROM (SELECT DISTINCT item_id, text FROM benchmark)))
      GROUP BY i, item_id, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, whole
      WHERE term IN (SELECT term FROM q) GROUP BY term, n_docs),
m AS (SELECT r, doc_id, 75 + (25 * n * n_docs) // total AS m FROM size, whole),
scored AS (SELECT i, item_id, m.doc_id, m.r, CAST(sum(qtf * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
           FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) GROUP BY i, item_id, m.doc_id, m.r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM ranked WHERE rank <= {lexical_search.K}"""

ORACLE["op12_phrases"] = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, words FROM (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces) WHERE len(words) > 0),
runs AS (SELECT lang, size, unnest([words[i:i + size - 1] FOR i IN range(1, len(words) - size + 2)]) AS p
         FROM w, (SELECT unnest(range(1, {phrases.MOST + 1})) AS size) WHERE len(words) >= size),
f AS (SELECT lang, p, size, count(*) AS f FROM runs GROUP BY lang, p, size),
total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, p, size, f AS a FROM f WHERE size > 1 AND f >= {phrases.LEAST}),
cuts AS (SELECT c.lang, c.p, c.size, c.a, k, f.f AS l, g.f AS r, CAST(CAST(2000000 AS HUGEINT) * c.a // (f.f + g.f) AS BIGINT) AS score
         FROM (SELECT *, unnest(range(1, size)) AS k FROM c) c JOIN f ON f.lang = c.lang AND f.p = c.p[1:k] JOIN f g ON g.lang = c.lang AND g.p = c.p[k + 1:]),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
inside AS (SELECT lang, sub, max(a) AS longer
           FROM (SELECT lang, a, unnest([p[i:i + m - 1] FOR i IN range(1, size - m + 2)]) AS sub FROM (SELECT *, unnest(range(2, size)) AS m FROM c)) GROUP BY lang, sub),
ranked AS (SELECT b.lang, array_to_string(b.p, ' ') AS phrase, b.a, b.l, b.r, b.score
           FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.sub = b.p WHERE longer IS NULL OR 100 * longer < {phrases.INSIDE} * b.a)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) JOIN total USING (lang) WHERE rank <= {phrases.TOP}"""
