"""Registered queries of the ingest phases, with oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..operators import navigate, phases, records
from .catalogue import _FINDINGS, _SUGGESTED, ORACLES, _pagerank_steps, _suggested, plan
from .catalogue_hub import HUB, hub_records
from .prelude import on_network


@plan("seed_passes")
def _(net: Network) -> DataFrame:
    raw = hub_records(net)
    return phases.seed(raw, raw.where("author = 'red'").select("model_id"))


ORACLES["seed_passes"] = on_network("""SELECT model_id, CASE WHEN likes >= 100 THEN 'core' WHEN likes >= 10 AND downloads >= 100 AND (created_at IS NULL OR created_at::DATE >= DATE '2023-01-01') THEN 'expand'
WHEN likes >= 3 AND downloads >= 50 AND (created_at IS NULL OR created_at::DATE >= DATE '2023-06-01') AND pipeline_tag IN ('text-generation', 'text2text-generation', 'image-text-to-text', 'feature-extraction') THEN 'niche' END AS pass FROM hub WHERE author <> 'red' AND pass IS NOT NULL""", HUB)


@plan("runtime_records")
def _(net: Network) -> DataFrame:
    k = F.col("p_size")
    listed = net.facts.select(
        F.col("model_id").alias("name"), F.when(k % 4 == 0, "Llama").when(k % 4 == 1, "command-r").when(k % 4 == 2, "oddity").otherwise("").alias("family"),
        F.when(k % 5 > 0, F.concat(k.cast("string"), F.when(k % 3 == 0, "M").otherwise("B"))).alias("parameter_size"), F.when(k % 2 == 0, "Q4_0").alias("quantization_level"),
    )
    return phases.runtime_records(listed).select("model_id", F.array_join("tags", ",").alias("tags"), "config")


ORACLES["runtime_records"] = on_network("""SELECT model_id, array_to_string(list_filter([CASE p_size % 4 WHEN 0 THEN 'llama' WHEN 1 THEN 'command-r' WHEN 2 THEN 'oddity' END, CASE WHEN p_size % 2 = 0 THEN 'q4_0' END, CASE WHEN p_size % 2 = 0 THEN 'quantized' END, 'GGUF-available', 'llama-cpp-compatible', 'CPU-inference', CASE p_size % 4 WHEN 0 THEN 'Llama-family' WHEN 1 THEN 'Command-family' END,
CASE WHEN b < 1 THEN 'sub-1B' WHEN b < 4 THEN '3B-class' WHEN b < 10 THEN '7B-class' WHEN b < 20 THEN '13B-class' END, CASE WHEN b < 1 THEN 'edge-deployable' WHEN b < 4 THEN 'consumer-GPU-viable' END], lambda x: x IS NOT NULL), ',') AS tags, CASE p_size % 4 WHEN 0 THEN '{"model_type":"Llama"}' WHEN 1 THEN '{"model_type":"command-r"}' WHEN 2 THEN '{"model_type":"oddity"}' END AS config
FROM (SELECT *, CASE WHEN p_size % 5 > 0 THEN CASE WHEN p_size % 3 = 0 THEN p_size / 1000.0 ELSE p_size END END AS b FROM facts)""")


_WEB = ("function-calling", "tool-calling", "base-model", "mixture-of-experts", "reasoning", "sub-1b", "7b-class", "70b-class", "embedding", "long-context")


def _web_items(net: Network) -> DataFrame:
    """Web results: of ten labels those whose bit the part key has, with a size in the record, the name or nowhere."""
    key = F.col("p_partkey")
    anchors = F.filter(F.array(*[F.when(F.floor(key / (1 << k)) % 2 == 1, F.lit(label)) for k, label in enumerate(_WEB)]), lambda x: x.isNotNull())
    name = F.concat(F.when(key % 3 == 0, "x/A-7B-Instruct-").when(key % 3 == 1, "x/a-30B-A3B-").otherwise("x/plain-"), key.cast("string"))
    task = F.when(key % 5 == 0, "text-classification").when(key % 5 == 1, "image-segmentation").otherwise("text-generation")
    return net.facts.select(name.alias("model_id"), task.alias("pipeline_tag"), F.when(key % 7 == 0, "70000000000").when(key % 7 == 1, "0.5").alias("param_count"), anchors.alias("anchors"))


@plan("web_cleaning")
def _(net: Network) -> DataFrame:
    return phases.clean_web(_web_items(net)).select("model_id", F.array_join(F.array_sort("anchors"), ",").alias("anchors"), "changed")


_BITS = "list_filter([" + ", ".join(f"CASE WHEN (p_partkey // {1 << k}) % 2 = 1 THEN '{label}' END" for k, label in enumerate(_WEB)) + "], lambda x: x IS NOT NULL)"
ORACLES["web_cleaning"] = on_network(
    """SELECT model_id, array_to_string(list_sort(kept), ',') AS anchors, list_sort(kept) <> list_sort(a) AS changed FROM (SELECT *, list_filter(a4, lambda x: CASE WHEN x IN ('sub-1b', '7b-class', '70b-class') AND hits > 1 THEN x = keep ELSE TRUE END) AS kept FROM (SELECT *,
CASE WHEN b IS NULL THEN CASE WHEN list_contains(a4, '70b-class') THEN '70b-class' ELSE '7b-class' END WHEN b = 70 THEN CASE WHEN list_contains(a4, '70b-class') THEN '70b-class' ELSE '7b-class' END WHEN b = 0.5 THEN CASE WHEN list_contains(a4, 'sub-1b') THEN 'sub-1b' ELSE '7b-class' END
WHEN b = 7 THEN CASE WHEN list_contains(a4, '7b-class') THEN '7b-class' ELSE 'sub-1b' END ELSE CASE WHEN list_contains(a4, '7b-class') THEN '7b-class' ELSE 'sub-1b' END END AS keep FROM sized))""",
    f"w0 AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN 'x/A-7B-Instruct-' WHEN 1 THEN 'x/a-30B-A3B-' ELSE 'x/plain-' END || p_partkey AS model_id, {_BITS} AS a FROM facts)",
    """w1 AS (SELECT *, list_filter(list_transform(CASE WHEN list_contains(a, 'tool-calling') THEN list_filter(a, lambda x: x <> 'function-calling') ELSE a END, lambda x: CASE WHEN x = 'function-calling' THEN 'tool-calling' ELSE x END), lambda x: NOT (k % 3 = 0 AND x = 'base-model') AND NOT (k % 3 <> 1 AND x = 'mixture-of-experts')
AND NOT (k % 5 = 0 AND x IN ('tool-calling', 'reasoning', 'long-context')) AND NOT (k % 5 = 1 AND x IN ('tool-calling', 'reasoning', 'long-context'))) AS a4 FROM w0)""",
    "sized AS (SELECT *, CASE WHEN k % 7 = 0 THEN 70 WHEN k % 7 = 1 THEN 0.5 WHEN k % 3 = 0 THEN 7 WHEN k % 3 = 1 THEN 30 END AS b, len(list_filter(a4, lambda x: x IN ('sub-1b', '7b-class', '70b-class'))) AS hits FROM w1)",
)


@plan("bleed_suspects", "SELECT model_id, label, evidence FROM (SELECT model_id, CASE WHEN p_size % 6 = 0 THEN 'hybrid' ELSE 'chat' END AS label, CASE p_size % 4 WHEN 0 THEN 'The Family now includes two' WHEN 1 THEN 'dense and sparse' WHEN 2 THEN 'includes a family' ELSE NULL END AS evidence FROM facts) WHERE label = 'hybrid' OR evidence IN ('The Family now includes two', 'dense and sparse')")
def _(net: Network) -> DataFrame:
    k = F.col("p_size")
    evidence = F.when(k % 4 == 0, "The Family now includes two").when(k % 4 == 1, "dense and sparse").when(k % 4 == 2, "includes a family")
    return phases.suspects(net.facts.select("model_id", F.when(k % 6 == 0, "hybrid").otherwise("chat").alias("label"), evidence.alias("evidence")))


@plan("gated_pool")
def _(net: Network) -> DataFrame:
    return phases.gated_pool(net, navigate.profile(net).select("model_id", "pagerank"), 500)


ORACLES["gated_pool"] = on_network("""SELECT model_id FROM (SELECT model_id FROM models LEFT JOIN r20 USING (model_id) ORDER BY CASE WHEN rank >= 1e-8 THEN round(rank, 8) ELSE 0 END DESC NULLS LAST, model_id LIMIT 500) WHERE (model_id NOT IN (SELECT model_id FROM metadata WHERE key = 'vibe_summary') OR model_id IN (SELECT model_id FROM facts WHERE vibe_e IS NULL))
AND model_id IN (SELECT model_id FROM model_anchors GROUP BY model_id HAVING count(DISTINCT bank) < 6)""", *_pagerank_steps(20))


@plan("needs_config", "SELECT model_id FROM facts WHERE p_size % 3 <> 1")
def _(net: Network) -> DataFrame:
    raw = F.when(F.col("p_size") % 3 == 0, '{"config": {}}').when(F.col("p_size") % 3 == 1, '{"config": {"model_type": "x"}}').otherwise("{}")
    return phases.needs_config(net.facts.select("model_id", raw.alias("raw")))


@plan("prefix_counts", "SELECT count(*) AS rows, count(DISTINCT model_id) AS models FROM metadata WHERE key LIKE 'vibe%'")
def _(net: Network) -> DataFrame:
    return phases.prefix_count(net.metadata, "vibe")


@plan("web_status", "SELECT (SELECT count(*) FROM models) AS total, count(DISTINCT model_id) AS done, count(DISTINCT CASE WHEN p_size % 8 = 0 THEN model_id END) AS benchmarked, round(100.0 * count(DISTINCT model_id) / (SELECT count(*) FROM models), 2) AS pct FROM facts WHERE p_size % 4 = 0")
def _(net: Network) -> DataFrame:
    done = net.facts.where("p_size % 4 = 0").select("model_id", F.when(F.col("p_size") % 8 == 0, "benchmark:mmlu").otherwise("web_summary").alias("key"))
    return phases.web_status(net, done)


@plan("training_stats")
def _(net: Network) -> DataFrame:
    corrections = net.facts.where("p_size % 5 = 0").select("model_id", F.when(F.col("p_size") % 2 == 0, "local").otherwise("large").alias("tier"))
    return phases.training_stats(corrections, records.audit_findings(net, _suggested(net)))


ORACLES["training_stats"] = on_network("""SELECT 'tier' AS kind, tier AS item, count(*) AS n FROM co GROUP BY tier UNION ALL SELECT 'models', '', count(DISTINCT model_id) FROM co UNION ALL SELECT 'finding', kind, count(DISTINCT model_id) FROM co JOIN findings USING (model_id) GROUP BY kind""", _SUGGESTED, _FINDINGS, "co AS (SELECT model_id, CASE WHEN p_size % 2 = 0 THEN 'local' ELSE 'large' END AS tier FROM facts WHERE p_size % 5 = 0)")


@plan("worker_claims")
def _(net: Network) -> DataFrame:
    done = net.facts.where("p_size % 2 = 0").select("model_id")
    return phases.claims(net.models, done, 4).groupBy("worker").agg(F.count(F.lit(1)).alias("n")).select(F.lit("left").alias("what"), F.col("n")).groupBy("what").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("workers"))


ORACLES["worker_claims"] = on_network("SELECT 'left' AS what, count(*)::BIGINT AS n, 4::BIGINT AS workers FROM facts WHERE p_size % 2 <> 0")


@plan("weak_page", "SELECT model_id, downloads FROM facts WHERE model_id IN (SELECT model_id FROM model_anchors WHERE confidence = 0.5) ORDER BY downloads DESC, model_id LIMIT 30 OFFSET 10")
def _(net: Network) -> DataFrame:
    weak = net.facts.join(net.model_anchors.where("confidence = 0.5").select("model_id"), "model_id", "left_semi").select("model_id", "downloads")
    return phases.page(weak, [F.desc("downloads"), F.col("model_id")], 10, 30)


@plan("first_emissions", "SELECT model_id, label, CASE WHEN label = 'red' AND p_size % 2 = 0 THEN 'deterministic' ELSE 'pattern' END AS tier FROM facts JOIN model_anchors USING (model_id) WHERE bank = 'DOMAIN'")
def _(net: Network) -> DataFrame:
    found = net.model_anchors.where("bank = 'DOMAIN'").select("model_id", "label", F.lit("pattern").alias("tier"))
    sure = net.facts.where("p_size % 2 = 0").select("model_id").join(found.where("label = 'red'").select("model_id", "label"), "model_id").select("model_id", "label", F.lit("deterministic").alias("tier"))
    return phases.first_wins(found.union(sure), ("deterministic", "pattern"))


@plan("family_members", "SELECT author, (SELECT string_agg(model_id, ',' ORDER BY model_id) FROM (SELECT model_id FROM models m WHERE m.author = g.author ORDER BY model_id LIMIT 5)) AS members, count(*) AS n FROM models g GROUP BY author")
def _(net: Network) -> DataFrame:
    return phases.group_members(net.models, ["author"], "model_id", 5)


@plan("parameter_estimates", "SELECT model_id, (p_size * (4 * 64 * 64 + 3 * 64 * 256) + 2 * 1000 * 64)::BIGINT AS parameters FROM facts")
def _(net: Network) -> DataFrame:
    return net.facts.select("model_id", phases.parameter_estimate(F.col("p_size").cast("bigint"), F.lit(64), F.lit(256), F.lit(1000)).alias("parameters"))


@plan("run_ledger", "SELECT o_orderkey AS run_id, o_orderpriority AS phase, '{}' AS config, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'running' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderstatus END AS summary FROM orders", network=False)
def _(table) -> DataFrame:
    runs = table("orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderpriority").alias("phase"), F.lit("{}").alias("config"))
    return phases.run_ledger(runs, table("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("run_id"), F.lit("done").alias("status"), F.col("o_orderstatus").alias("summary")))


@plan("preference_pairs", "SELECT c_name AS prompt, c_name || ' jr' AS chosen, c_name AS rejected FROM customer WHERE c_custkey % 4 = 0", network=False)
def _(table) -> DataFrame:
    from ..sources import files

    healed = F.when(F.col("c_custkey") % 4 == 0, F.concat("c_name", F.lit(" jr"))).otherwise(F.col("c_name"))
    corrections = table("customer").select(F.col("c_custkey").alias("event_id"), F.col("c_name").alias("prompt"), F.col("c_name").alias("original"), healed.alias("healed"), F.lit("m").alias("model_id"), F.lit("t").alias("tier"), F.lit("r").alias("run_id"))
    return files.preference_pairs(corrections).select("prompt", "chosen", "rejected")
