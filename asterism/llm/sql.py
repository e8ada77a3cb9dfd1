"""DuckDB SQL with the same rows as the registered queries, where SQL can express them."""

from . import licenses

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, source, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
c AS (SELECT rid, doc_id, source, ws, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines FROM w),
g AS (SELECT rid, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, n_words - 3)) AS i FROM c WHERE n_words >= 5)),
r AS (SELECT rid, i FROM g JOIN (SELECT rid, gram FROM g GROUP BY rid, gram HAVING count(*) > 1) USING (rid, gram)),
n AS (SELECT rid, CAST(sum(least(5, coalesce(i - p, 5))) AS BIGINT) AS n_repeat_words FROM (SELECT rid, i, lag(i) OVER (PARTITION BY rid ORDER BY i) AS p FROM r) GROUP BY rid),
f AS (SELECT c.*, coalesce(n_repeat_words, 0) AS n_repeat_words, n_words < 10 OR 100 * coalesce(n_repeat_words, 0) > 20 * n_words AS base_failed FROM c LEFT JOIN n USING (rid)),
u AS (SELECT *, base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM f),
h AS (SELECT source, count(*) AS k, sum(CASE WHEN rule_failed THEN 1 ELSE 0 END) AS bad FROM u WHERE source IS NOT NULL GROUP BY source),
p AS (SELECT avg(bad / k) AS m, var_pop(bad / k) AS v FROM h),
q AS (SELECT m, least(greatest(CASE WHEN v > 0 THEN m * (1 - m) / v - 1 ELSE 1000 END, 1), 1000) AS wt FROM p),
o AS (SELECT source, (bad + m * wt) / (k + wt) <= 0.5 AS ok FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(ok, TRUE) AS kept
FROM u LEFT JOIN o USING (source)
"""


def op2() -> str:
    """The license scan over the same templates, diagonal by diagonal."""
    rows = [f"({k}, '{label}', {phrase}, '{a}', '{b}', {at}, {len(w) - 1})" for k, label, phrase, w in licenses.templates() for at, (a, b) in enumerate(zip(w, w[1:]))]
    return rf"""
WITH tpl(template, label, phrase, a, b, pl, grams) AS (VALUES {", ".join(rows)}),
d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT rid, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM (SELECT rid, w, unnest(range(1, len(w))) AS i FROM d)),
v AS (SELECT rid, template, label, phrase, grams, pos - pl AS diagonal, pl FROM g JOIN tpl USING (a, b)),
x AS (SELECT rid, template, label, phrase, grams, diagonal, count(*) AS n, min(pl) AS lo, max(pl) AS hi FROM v GROUP BY ALL),
base AS (SELECT rid, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word FROM x WHERE phrase AND n = grams GROUP BY rid),
i0 AS (SELECT *, CASE WHEN grams >= {licenses.SHORT} AND diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) <= {licenses.DRIFT} THEN 0 ELSE 1 END AS fresh FROM x WHERE NOT phrase),
i1 AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal) AS island FROM i0),
i2 AS (SELECT i1.rid, i1.template, i1.label, i1.grams, island, count(DISTINCT v.pl) AS n, min(v.diagonal + v.pl) AS lo, max(v.diagonal + v.pl + 2) AS hi
       FROM i1 JOIN v ON v.rid = i1.rid AND v.template = i1.template AND v.diagonal = i1.diagonal GROUP BY ALL),
s AS (SELECT rid, label, n / grams AS cover FROM i2 WHERE n >= CASE WHEN grams < {licenses.SHORT} THEN 1.0 ELSE {licenses.COVER} END * grams AND hi - lo <= CASE WHEN grams < {licenses.SHORT} THEN 1.0 ELSE {licenses.STRETCH} END * (grams + 1)),
l AS (SELECT rid, label, TRUE AS is_base, 1.0::DOUBLE AS cover FROM x WHERE phrase AND n = grams UNION ALL SELECT rid, label, FALSE, cover FROM s),
b AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (is_base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM l GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN base USING (rid) LEFT JOIN b USING (rid)
"""


OP5 = """
WITH d AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(x, lambda c: floor(64 * c)) AS v FROM d WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, c.r AS cr, CASE WHEN len(q.v) = 0 OR len(c.v) = 0 THEN 0 ELSE CAST(list_inner_product(q.v, c.v) AS BIGINT) END AS score FROM v AS q JOIN v AS c ON q.vec_id % 20 = 0 AND q.r <> c.r)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id, cr) AS k FROM s) WHERE k <= 20
"""


OP7 = """
WITH d AS (SELECT page_id, encode(coalesce(html, '')) AS raw FROM pages),
x AS (SELECT page_id, CAST(octet_length(raw) AS BIGINT) AS payload_bytes, sha1(raw) AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS holder FROM x),
r AS (SELECT *, CASE WHEN payload_bytes >= 1000 AND holder <> page_id THEN holder END AS refers_to FROM m)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""
