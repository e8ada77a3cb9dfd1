"""DuckDB definitions of the derived network, the base of the oracle queries."""

PRELUDE = """
ps AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS n_orders, sum(l_quantity) AS qty, avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS ret, count(DISTINCT l_suppkey) AS n_supp FROM lineitem GROUP BY l_partkey),
facts AS (SELECT 'p' || p_partkey AS model_id, p_partkey, p_name, p_brand, p_type, p_size, split_part(p_name, ' ', 1) AS word1, split_part(p_name, ' ', 2) AS word2,
  coalesce(n_orders, 0)::BIGINT AS likes, coalesce(qty, 0.0)::DOUBLE AS downloads, coalesce(ret, 0.0)::DOUBLE AS ret, coalesce(n_supp, 0)::BIGINT AS n_supp,
  p_size / 10.0::DOUBLE AS params_b, 1.0::DOUBLE - (p_size % 5) / 20.0::DOUBLE AS certification,
  CASE WHEN p_size % 3 <> 0 THEN ((p_partkey * 1) % 21 - 10) / 10.0::DOUBLE END AS vibe_e, CASE WHEN p_size % 3 <> 0 THEN ((p_partkey * 3) % 21 - 10) / 10.0::DOUBLE END AS vibe_p, CASE WHEN p_size % 3 <> 0 THEN ((p_partkey * 7) % 21 - 10) / 10.0::DOUBLE END AS vibe_a
  FROM part LEFT JOIN ps ON p_partkey = l_partkey),
models AS (SELECT model_id, p_brand AS author, p_type AS source, p_name AS display_name FROM facts),
steps AS (SELECT *, (p_size >= 5)::INT + (p_size >= 10)::INT + (p_size >= 20)::INT + (p_size >= 30)::INT + (p_size >= 40)::INT + (p_size >= 45)::INT AS size_step, 2 * ln(1 + likes) + 0.5::DOUBLE * ln(1 + downloads) AS popularity FROM facts),
emitted AS (SELECT model_id, p_brand AS label, 'LINEAGE' AS bank, 'family' AS category, 0.95::DOUBLE AS confidence FROM steps
  UNION ALL SELECT model_id, p_type, 'CAPABILITY', 'skill', 0.85 FROM steps UNION ALL SELECT model_id, word1, 'DOMAIN', 'broad', 0.8 FROM steps UNION ALL SELECT model_id, word2, 'ARCHITECTURE', 'type', 0.8 FROM steps
  UNION ALL SELECT model_id, 'size-' || (size_step + 1), 'EFFICIENCY', 'size', 1.0 FROM steps UNION ALL SELECT model_id, 'high-volume', 'QUALITY', 'popularity', 0.5 FROM steps WHERE downloads > 800
  UNION ALL SELECT model_id, 'multi-supplier', 'COMPATIBILITY', 'supply', 0.5 FROM steps WHERE n_supp >= 24 UNION ALL SELECT model_id, 'return-prone', 'TRAINING', 'returns', 0.5 FROM steps WHERE ret > 0.4),
model_anchors AS (SELECT model_id, bank || ':' || label AS anchor_id, label, bank, category, confidence FROM emitted),
anchors AS (SELECT DISTINCT anchor_id, label, bank, category FROM model_anchors UNION ALL SELECT 'QUALITY:orphan-label', 'orphan-label', 'QUALITY', 'none'),
places AS (SELECT model_id, 'EFFICIENCY' AS bank, size_step - 3 AS v FROM steps WHERE p_size % 7 <> 0
  UNION ALL SELECT model_id, 'QUALITY', (popularity >= 9.5)::INT + (popularity >= 10)::INT + (popularity >= 10.5)::INT + (popularity >= 11)::INT - 2 FROM steps
  UNION ALL SELECT model_id, 'COMPATIBILITY', (n_supp >= 20)::INT + (n_supp >= 26)::INT + (n_supp >= 31)::INT - 1 FROM steps
  UNION ALL SELECT model_id, 'TRAINING', (ret >= 0.25)::INT + (ret >= 0.35)::INT + (ret >= 0.45)::INT - 1 FROM steps
  UNION ALL SELECT model_id, 'DOMAIN', length(word1) % 3 - 1 FROM steps UNION ALL SELECT model_id, 'ARCHITECTURE', length(word2) % 3 - 1 FROM steps UNION ALL SELECT model_id, 'CAPABILITY', length(p_type) % 3 - 1 FROM steps
  UNION ALL SELECT model_id, 'LINEAGE', CAST(substr(p_brand, 7) AS INT) % 3 - 1 FROM steps),
positions AS (SELECT model_id, bank, sign(v)::INT AS path_sign, abs(v)::INT AS path_depth FROM places),
pairs AS (SELECT b.l_partkey AS source, a.l_partkey AS target, count(*) AS weight FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey GROUP BY ALL),
links AS (SELECT 'p' || source AS source_id, 'p' || target AS target_id, CASE WHEN source > target THEN 'fine_tuned_from' ELSE 'same_family' END AS relation, weight FROM pairs),
metadata AS (SELECT model_id, 'likes' AS key, CAST(likes AS VARCHAR) AS value, 'int' AS value_type FROM facts UNION ALL SELECT model_id, 'size', CAST(p_size AS VARCHAR), 'int' FROM facts UNION ALL SELECT model_id, 'vibe_summary', p_name, 'str' FROM facts WHERE p_size % 4 <> 0)
"""


def on_network(query: str, *more: str) -> str:
    """A query whose WITH list starts with the network; ``more`` are further definitions."""
    return "WITH RECURSIVE " + ", ".join([PRELUDE.strip(), *[m.strip() for m in more]]) + "\n" + query
