"""Registered queries around enrichment: cards, tables, prompts, verdicts, mismatches, drift and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocabulary
from ..network import Network
from ..operators import enrich
from .catalogue import plan


@plan("clean_cards", r"""SELECT doc_id, substr(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)^---\n.*?\n---\n', ''), '(?s)```.*?```', ' ', 'g'), '!\[[^\]]*\]\([^)]*\)', ' ', 'g'), '\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '<[^>]+>', ' ', 'g'), '\|[-: |]*\|', ' ', 'g'), '\s+', ' ', 'g')), 1, 2000) AS card FROM documents""", network=False)
def _(table) -> DataFrame:
    return table("documents").select("doc_id", enrich.clean_card(F.col("text")).alias("card"))


_HITS = " + ".join(f"contains(lower(p), '{w}')::INT" for w in enrich.EVALUATIVE)


_SCORED = f"""WITH parts AS (SELECT doc_id, source, unnest(string_split(text, chr(10) || chr(10))) AS raw, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS i FROM documents),
ready AS (SELECT doc_id, i, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(source, '')), '[/\\s-]+'), lambda t: length(t) > 2)) AS terms, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS p FROM parts),
scored AS (SELECT doc_id, i, length(p) AS n, 1250 * len(list_filter(terms, lambda t: contains(lower(p), t))) + 750 * ({_HITS}) + least(length(p), 500) AS score FROM ready WHERE length(p) >= 30)"""


@plan("paragraph_scores", f"{_SCORED} SELECT doc_id, CAST(i - 1 AS INT) AS i, round(score / 2500.0::DOUBLE, 6) AS score FROM scored", network=False)
def _(table) -> DataFrame:
    parts = table("documents").select("doc_id", F.explode(enrich.paragraph_scores(F.col("text"), F.col("source"))).alias("x"))
    return parts.select("doc_id", "x.i", F.round(F.col("x.points") / 2500.0, 6).alias("score"))


@plan("paragraph_budget", f"""{_SCORED},
used AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY score DESC, i ROWS UNBOUNDED PRECEDING) AS used FROM scored)
SELECT d.doc_id, count(n) AS paragraphs, CAST(coalesce(sum(n), 0) AS BIGINT) AS chars FROM documents d LEFT JOIN (SELECT * FROM used WHERE used <= 8000) USING (doc_id) GROUP BY d.doc_id""", network=False)
def _(table) -> DataFrame:
    return table("documents").select("doc_id", enrich.best_paragraphs(F.col("text"), F.col("source")).alias("x")).select("doc_id", "x.*")


def _cards(net: Network) -> DataFrame:
    """Descriptions with a table of benchmarks, a table of something else and rows without a header."""
    size = F.col("p_size").cast("string")
    some = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("| GSM8K | "), size, F.lit(" |\n"))).otherwise(F.lit(""))
    card = F.concat(F.lit("# x\n| Benchmark | shots | value |\n|:--|---|---|\n| MMLU | n/a | "), (F.col("p_size") + 40.5).cast("string"), F.lit("% |\n"), some, F.lit("| Other Thing | 3 |\n| none | n/a |\n\n| task | kind |\n|---|---|\n| arc | 5 |\n\n| mmlu | 99 |"))
    return net.facts.select("model_id", card.alias("card"))


@plan("benchmark_tables", "SELECT model_id, 'mmlu' AS benchmark, CAST(p_size + 40.5::DOUBLE AS VARCHAR) || '%' AS score FROM facts UNION ALL SELECT model_id, 'gsm8k', CAST(p_size AS VARCHAR) FROM facts WHERE p_size % 2 = 0 UNION ALL SELECT model_id, 'other-thing', '3' FROM facts")
def _(net: Network) -> DataFrame:
    return enrich.benchmark_rows(_cards(net), "model_id", "card")


@plan("prompts", "SELECT model_id, 'Describe ' || display_name || ' of ' || author || ' in one sentence. Known: ' || coalesce((SELECT string_agg(label, ', ' ORDER BY label) FROM model_anchors a WHERE a.model_id = m.model_id), '') || '.' AS prompt FROM models m")
def _(net: Network) -> DataFrame:
    return enrich.prompts(net)


def _answers(net: Network) -> DataFrame:
    mark = lambda k: (F.col("p_size") % k).cast("string")
    whole = F.concat(F.lit('{"summary": "'), "p_name", F.lit('", "selected_anchors": ["RED", "nothing", "high-volume", "red"], "specificity": '), mark(4), F.lit(', "coherence": '), mark(3), F.lit(', "artifacts": '), mark(2), F.lit("}"))
    return net.facts.select("model_id", F.when(F.col("p_size") % 7 == 0, "no json").otherwise(whole).alias("response"))


@plan("llm_verdicts", """SELECT model_id, CASE WHEN p_size % 7 <> 0 THEN p_name END AS summary, CASE WHEN p_size % 7 <> 0 THEN 'red,high-volume' ELSE '' END AS labels, CASE WHEN p_size % 7 <> 0 THEN round((p_size % 4 + p_size % 3 + p_size % 2) / 9.0::DOUBLE, 6) END AS quality,
CASE WHEN p_size % 7 = 0 THEN 'invalid' WHEN (p_size % 4 + p_size % 3 + p_size % 2) / 9.0 < 0.5 THEN 'rejected' ELSE 'ok' END AS status FROM facts""")
def _(net: Network) -> DataFrame:
    return enrich.verdicts(_answers(net), net)


@plan("stub_answers", "SELECT model_id, right('Describe ' || display_name || ' of ' || author || ' in one sentence. Known: ' || coalesce((SELECT string_agg(label, ', ' ORDER BY label) FROM model_anchors a WHERE a.model_id = m.model_id), '') || '.', 80) AS response FROM models m")
def _(net: Network) -> DataFrame:
    return enrich.answer(enrich.prompts(net))


@plan("parameter_mismatches", "SELECT model_id, x, y, round(abs(x - y) / greatest(x, y), 6) AS gap FROM (SELECT model_id, params_b AS x, CASE WHEN p_size % 3 = 0 THEN params_b * 3 ELSE params_b END AS y FROM facts) WHERE greatest(x, y) > 0 AND abs(x - y) / greatest(x, y) > 0.5")
def _(net: Network) -> DataFrame:
    other = net.facts.select("model_id", (F.when(F.col("p_size") % 3 == 0, F.col("params_b") * 3).otherwise(F.col("params_b"))).alias("params_b"))
    return enrich.mismatches(net.facts.select("model_id", "params_b"), other, "model_id", "params_b")


@plan("text_drift", "SELECT page_id, CASE WHEN page_id % 10 = 0 THEN 'stale' WHEN page_id % 10 = 1 THEN 'new' ELSE 'ok' END AS status FROM pages UNION ALL SELECT page_id + 1000000, 'orphaned' FROM pages WHERE page_id % 10 = 2", network=False)
def _(table) -> DataFrame:
    pages = table("pages").select("page_id", "html")
    known = pages.where("page_id % 10 <> 1").select("page_id", F.sha2(F.when(F.col("page_id") % 10 == 0, F.concat("html", F.lit("x"))).otherwise(F.col("html")), 256).alias("hash"))
    gone = pages.where("page_id % 10 = 2").select((F.col("page_id") + 1000000).alias("page_id"), F.lit("h").alias("hash"))
    return enrich.drift(known.union(gone), pages, "page_id", "html")


@plan("phase_status", "SELECT o_orderpriority AS source, count(*) AS total, sum((o_orderstatus = 'F')::INT)::BIGINT AS done, sum((o_totalprice > 100000)::INT)::BIGINT AS large FROM orders GROUP BY 1", network=False)
def _(table) -> DataFrame:
    flagged = table("orders").select(F.col("o_orderpriority").alias("source"), (F.col("o_orderstatus") == "F").alias("done"), (F.col("o_totalprice") > 100000).alias("large"))
    return enrich.phase_status(flagged, ["done", "large"])


@plan("thin_reasons", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'empty' WHEN o_orderkey % 4 = 1 THEN 'filler' ELSE 'short' END AS thin FROM orders WHERE o_orderkey % 4 < 3", network=False)
def _(table) -> DataFrame:
    reason = F.when(F.col("o_orderkey") % 4 == 0, " ").when(F.col("o_orderkey") % 4 == 1, "Fix").when(F.col("o_orderkey") % 4 == 2, "abc").otherwise("corrected by the curator")
    return enrich.thin_reasons(table("orders").select("o_orderkey", reason.alias("reason"))).select("o_orderkey", "thin")


@plan("mentioned_labels", "SELECT DISTINCT model_id, CASE w WHEN 'hot' THEN 'warm-goods' WHEN 'red' THEN 'colour' ELSE 'colour' END AS label FROM (SELECT model_id, unnest(regexp_split_to_array(lower(display_name), '[^a-z0-9]+')) AS w FROM models) WHERE w IN ('hot', 'red', 'blue')")
def _(net: Network) -> DataFrame:
    return vocabulary.mentioned(net.models, "display_name", {"hot": "warm-goods", "red": "colour", "blue": "colour"})


@plan("benchmark_labels", "SELECT model_id, 'high-mmlu' AS label FROM facts WHERE p_size + 40.5 >= 70 UNION ALL SELECT model_id, 'strong-gsm8k' FROM facts WHERE p_size % 2 = 0 AND p_size >= 60")
def _(net: Network) -> DataFrame:
    return enrich.benchmark_labels(enrich.benchmark_rows(_cards(net), "model_id", "card"), "model_id")
