"""The engine's registered queries over the derived network, each with the oracle SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fuzzy, text
from ..network import Network, from_driver
from ..operators import certify, extract, filters, graph, navigate, records, search, stats
from ..schema import Query
from ..sources import files
from ..streaming import events
from .prelude import on_network

Plan = Callable[[SparkSession, str], DataFrame]
PLANS: dict[str, Plan] = {}
ORACLES: dict[str, str] = {}


def plan(name: str, sql: str | None = None, network: bool = True) -> Callable[[Callable], Callable]:
    """Register a query of a network (or, with ``network`` false, of a reader of tables) and its oracle."""

    def register(f: Callable) -> Callable:
        if network:
            PLANS[name] = lambda spark, sf_dir: f(from_driver(spark, sf_dir))
        else:
            PLANS[name] = lambda spark, sf_dir: f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql is not None:
            ORACLES[name] = on_network(sql) if network else sql
        return f

    return register


FIRST = Query(directions={"EFFICIENCY": -1, "QUALITY": 1}, require=("PROMO",), prefer=("red", "high-volume", "Brand#7"), avoid=("return-prone",), context=("widget", "multi-supplier"), vibe=(0.5, None, -0.2), min_depth={"QUALITY": 1}, mode="auto")


# --- statistics

@plan("network_stats", """SELECT 'models' AS kind, '' AS item, count(*) AS n FROM models UNION ALL SELECT 'anchors', '', count(*) FROM anchors UNION ALL SELECT 'model_anchors', '', count(*) FROM model_anchors UNION ALL SELECT 'links', '', count(*) FROM links
UNION ALL SELECT 'source', source, count(*) FROM models GROUP BY source UNION ALL SELECT 'bank', bank, count(*) FROM positions GROUP BY bank""")
def _(net: Network) -> DataFrame:
    return stats.network_stats(net)


@plan("anchor_popularity", "SELECT a.anchor_id, a.label, a.bank, count(m.model_id) AS n FROM anchors a LEFT JOIN model_anchors m USING (anchor_id) GROUP BY ALL")
def _(net: Network) -> DataFrame:
    return stats.anchor_counts(net)


@plan("anchor_idf", "SELECT label, n, round(idf, 6) AS idf FROM (SELECT a.label, count(m.model_id) AS n, ln((SELECT count(*) FROM models)::DOUBLE / greatest(count(m.model_id), 1)) AS idf FROM anchors a LEFT JOIN model_anchors m USING (anchor_id) GROUP BY a.label)")
def _(net: Network) -> DataFrame:
    return stats.idf(net).withColumn("idf", F.round("idf", 6))


PROMO = "SELECT model_id FROM model_anchors WHERE label = 'PROMO'"


@plan("candidate_pmi", f"""SELECT c.label, n_c, n_g, round(ln((n_c / (SELECT count(*) FROM ({PROMO}))::DOUBLE) / (n_g / (SELECT count(*) FROM models)::DOUBLE)), 6) AS pmi
FROM (SELECT label, count(*) AS n_c FROM model_anchors WHERE model_id IN ({PROMO}) GROUP BY label) c JOIN (SELECT label, count(*) AS n_g FROM model_anchors GROUP BY label) g USING (label)
WHERE ln((n_c / (SELECT count(*) FROM ({PROMO}))::DOUBLE) / (n_g / (SELECT count(*) FROM models)::DOUBLE)) > 0""")
def _(net: Network) -> DataFrame:
    return stats.pmi(net, filters.by_anchor(net, "PROMO")).select("label", "n_c", "n_g", F.round("pmi", 6).alias("pmi"))


@plan("standards_probs", f"SELECT * FROM (SELECT label, count(*) AS n_c, round(count(*) / (SELECT count(*) FROM ({PROMO}))::DOUBLE, 6) AS p FROM model_anchors WHERE model_id IN ({PROMO}) AND label <> 'PROMO' GROUP BY label) WHERE p > 0.4")
def _(net: Network) -> DataFrame:
    return stats.standards(net, filters.by_anchor(net, "PROMO"), ("PROMO",)).select("label", "n_c", F.round("p", 6).alias("p"))


@plan("null_coverage", "SELECT bank, count(DISTINCT p.model_id) AS present, (SELECT count(*) FROM models) - count(DISTINCT p.model_id) AS missing, round(100.0 * ((SELECT count(*) FROM models) - count(DISTINCT p.model_id)) / (SELECT count(*) FROM models)::DOUBLE, 2) AS missing_pct FROM (SELECT unnest(['ARCHITECTURE', 'CAPABILITY', 'EFFICIENCY', 'COMPATIBILITY', 'LINEAGE', 'DOMAIN', 'QUALITY', 'TRAINING']) AS bank) LEFT JOIN positions p USING (bank) GROUP BY bank")
def _(net: Network) -> DataFrame:
    return stats.null_coverage(net)


@plan("bank_correlations", """SELECT * FROM (SELECT a.bank AS bank_a, b.bank AS bank_b, count(*) AS n, round(corr(a.path_sign * a.path_depth, b.path_sign * b.path_depth), 4) AS r FROM positions a JOIN positions b USING (model_id) WHERE a.bank < b.bank
GROUP BY ALL HAVING count(*) >= 3 AND stddev_pop(a.path_sign * a.path_depth) > 0 AND stddev_pop(b.path_sign * b.path_depth) > 0)""")
def _(net: Network) -> DataFrame:
    return stats.bank_correlations(net)


@plan("orphan_anchors", "SELECT label, bank FROM anchors WHERE anchor_id NOT IN (SELECT anchor_id FROM model_anchors)")
def _(net: Network) -> DataFrame:
    return stats.orphan_anchors(net)


@plan("oversaturated_anchors", "SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM models)::DOUBLE * 100, 2) AS share_pct FROM model_anchors GROUP BY label HAVING count(*) > floor((SELECT count(*) FROM models) * 15 / 100)")
def _(net: Network) -> DataFrame:
    return stats.oversaturated(net, 15.0)


@plan("coverage_by_bank", "SELECT m.model_id, bank, count(a.label) AS n, coalesce(max(confidence), 0.0) AS top FROM models m CROSS JOIN (SELECT unnest(['ARCHITECTURE', 'CAPABILITY', 'EFFICIENCY', 'COMPATIBILITY', 'LINEAGE', 'DOMAIN', 'QUALITY', 'TRAINING']) AS bank) LEFT JOIN model_anchors a USING (model_id, bank) GROUP BY ALL")
def _(net: Network) -> DataFrame:
    return stats.bank_coverage(net)


@plan("gating_needs_llm", "SELECT model_id, coalesce(covered, 0) AS covered, coalesce(covered, 0) < 6 OR coalesce(weakest, 1.0) < 0.3 AS needs FROM models LEFT JOIN (SELECT model_id, count(*) AS covered, min(top) AS weakest FROM (SELECT model_id, bank, max(confidence) AS top FROM model_anchors GROUP BY ALL) GROUP BY model_id) USING (model_id)")
def _(net: Network) -> DataFrame:
    return stats.needs_enrichment(net)


# --- filters

@plan("entity_detail", """SELECT model_id, author, source, display_name, (SELECT count(*) FROM positions p WHERE p.model_id = m.model_id) AS n_positions, (SELECT string_agg(label, ',' ORDER BY label) FROM model_anchors a WHERE a.model_id = m.model_id) AS labels,
(SELECT count(*) FROM links WHERE source_id = m.model_id) AS links_out, (SELECT count(*) FROM links WHERE target_id = m.model_id) AS links_in FROM models m WHERE model_id = 'p7'""")
def _(net: Network) -> DataFrame:
    one = filters.entity(net, "p7")
    return one.select("model_id", "author", "source", "display_name", F.size("positions").cast("bigint").alias("n_positions"), F.array_join("labels", ",").alias("labels"), F.coalesce("links_out", F.lit(0)).alias("links_out"), F.coalesce("links_in", F.lit(0)).alias("links_in"))


@plan("find_by_anchor", "SELECT DISTINCT model_id FROM model_anchors WHERE label = 'multi-supplier'")
def _(net: Network) -> DataFrame:
    return filters.by_anchor(net, "multi-supplier")


@plan("bank_range", "SELECT model_id, path_sign * path_depth AS position FROM positions WHERE bank = 'EFFICIENCY' AND path_sign * path_depth BETWEEN -2 AND 1")
def _(net: Network) -> DataFrame:
    return filters.bank_range(net, "EFFICIENCY", -2, 1)


@plan("depth_floor", "SELECT model_id FROM positions WHERE bank = 'EFFICIENCY' AND path_sign = -1 AND path_depth >= 2")
def _(net: Network) -> DataFrame:
    return filters.depth_floor(net, "EFFICIENCY", -1, 2)


@plan("depth_band", "SELECT model_id FROM positions WHERE bank = 'QUALITY' AND path_depth <= 1")
def _(net: Network) -> DataFrame:
    return filters.depth_ceiling(net, "QUALITY", 0, 1)


@plan("require_all", "SELECT model_id FROM model_anchors WHERE label IN ('PROMO', 'high-volume', 'red') GROUP BY model_id HAVING count(DISTINCT label) = 3")
def _(net: Network) -> DataFrame:
    return filters.require_all(net, ("PROMO", "high-volume", "red"))


@plan("require_unknown", "SELECT model_id FROM models WHERE false")
def _(net: Network) -> DataFrame:
    return filters.require_all(net, ("PROMO", "no-such-label"))


@plan("exists_missing_key", "SELECT model_id, likes FROM facts WHERE likes >= 20 AND model_id NOT IN (SELECT model_id FROM metadata WHERE key = 'vibe_summary')")
def _(net: Network) -> DataFrame:
    return filters.missing_key(net, "vibe_summary", 20)


@plan("priority_models", "SELECT * FROM (SELECT model_id, (downloads < 800)::INT AS band, CASE WHEN downloads >= 800 THEN downloads ELSE likes::DOUBLE END AS key FROM facts) ORDER BY band, key DESC, model_id LIMIT 200")
def _(net: Network) -> DataFrame:
    return filters.priority(net, 800, 200)


@plan("alias_resolve", """SELECT mention, coalesce(c.label, f.label, mention) AS label, coalesce(c.label, f.label) IS NOT NULL AS known FROM (VALUES ('promo'), ('HIGH volume'), ('multi_supplier'), ('brand#3'), ('nothing')) v(mention)
LEFT JOIN (SELECT lower(label) AS low, min(label) AS label FROM anchors GROUP BY 1) c ON c.low = lower(mention) LEFT JOIN (SELECT translate(lower(trim(label)), ' -_.', '') AS form, min(label) AS label FROM anchors GROUP BY 1) f ON f.form = translate(lower(trim(mention)), ' -_.', '')""")
def _(net: Network) -> DataFrame:
    spark = net.models.sparkSession
    return filters.resolve_aliases(spark.createDataFrame([(m,) for m in ("promo", "HIGH volume", "multi_supplier", "brand#3", "nothing")], "mention string"), net)


# --- ranking

_SIGNALS = """
cand AS (SELECT model_id FROM models WHERE {where}),
tot AS (SELECT (SELECT count(*) FROM cand)::DOUBLE AS c, (SELECT count(*) FROM models)::DOUBLE AS n),
gl AS (SELECT a.label, any_value(a.bank) AS bank, count(m.model_id) AS n_g, ln((SELECT n FROM tot) / greatest(count(m.model_id), 1)) AS idf FROM anchors a LEFT JOIN model_anchors m USING (anchor_id) GROUP BY a.label),
cl AS (SELECT label, count(*) AS n_c FROM model_anchors WHERE model_id IN (SELECT model_id FROM cand) GROUP BY label),
lw AS (SELECT gl.label, bank, idf, greatest(coalesce(CASE WHEN n_c > 0 AND n_g > 0 THEN ln((n_c / (SELECT c FROM tot)) / (n_g / (SELECT n FROM tot))) END, 0), 0) AS pmi,
  CASE WHEN n_c / (SELECT c FROM tot) > 0.4 AND gl.label NOT IN ({require}) THEN -ln(n_c / (SELECT c FROM tot)) ELSE 0 END AS surprise, gl.label IN ({prefer}) AS is_prefer, gl.label IN ({context}) AS is_context, gl.label IN ({avoid}) AS is_avoid, gl.label IN ({require}) AS is_require FROM gl LEFT JOIN cl USING (label)),
lt AS (SELECT sum(CASE WHEN is_prefer THEN idf ELSE 0 END) AS t_prefer, sum(CASE WHEN is_context THEN idf ELSE 0 END) AS t_context, sum(CASE WHEN is_prefer THEN pmi ELSE 0 END) AS t_pmi, sum(surprise) AS t_abs,
  sum(CASE WHEN is_prefer OR is_require THEN idf ELSE 0 END) AS t_mass, sum(CASE WHEN is_prefer OR is_require THEN idf * CASE WHEN bank IN ('EFFICIENCY', 'COMPATIBILITY', 'LINEAGE') THEN 1.0 WHEN bank = 'ARCHITECTURE' THEN 0.5 ELSE 0.0 END ELSE 0 END) AS t_mech FROM lw),
mech AS (SELECT CASE WHEN {n_banks} + t_mass > 0 THEN ({mech_banks} + t_mech) / ({n_banks} + t_mass) ELSE 0.5 END AS m FROM lt),
mw AS (SELECT {weights} FROM mech),
sums AS (SELECT c.model_id, coalesce(sum(CASE WHEN is_prefer THEN idf END), 0) AS s_prefer, coalesce(sum(CASE WHEN is_context THEN idf END), 0) AS s_context, coalesce(sum(CASE WHEN is_prefer THEN pmi END), 0) AS s_pmi, coalesce(sum(surprise), 0) AS s_known, coalesce(sum(is_avoid::INT), 0) AS n_avoid
  FROM cand c LEFT JOIN model_anchors ma USING (model_id) LEFT JOIN lw USING (label) GROUP BY c.model_id),
pr AS (SELECT c.model_id, coalesce(round(rank, 8), 0) AS pr FROM cand c LEFT JOIN (SELECT model_id, rank FROM r20 WHERE rank >= 1e-8) USING (model_id)),
pf AS (SELECT model_id, CASE WHEN pr > 0 AND (SELECT count(DISTINCT pr) FROM pr WHERE pr > 0) > 1 THEN (dense_rank() OVER (PARTITION BY pr > 0 ORDER BY pr) - 1) / ((SELECT count(DISTINCT pr) FROM pr WHERE pr > 0) - 1)::DOUBLE ELSE 0.0 END AS pr_frac FROM pr),
fac AS (SELECT s.model_id, {bank} AS bank_alignment, (CASE WHEN t_prefer > 0 THEN s_prefer / t_prefer ELSE 1.0 END) * pow(0.5, n_avoid) AS anchor_relevance, certification AS coherence,
  CASE WHEN t_context > 0 THEN 1 + 0.5 * s_context / t_context ELSE 1.0 END AS context_bias, {epa} AS epa_alignment, pr_frac, CASE WHEN t_pmi > 0 THEN s_pmi / t_pmi ELSE 0.0 END AS rare, (t_abs - s_known) / CASE WHEN t_abs = 0 THEN 1.0 ELSE t_abs END AS absence
  FROM sums s JOIN facts USING (model_id) JOIN pf USING (model_id) CROSS JOIN lt),
soft AS (SELECT fac.*, list_reverse_sort([k_pr * pr_frac, k_pmi * rare, k_rare * rare, k_abs * absence, k_super * pr_frac * rare]) AS sg FROM fac CROSS JOIN mw),
ranked AS (SELECT *, 1 + sg[1] + sg[2] * 0.7 + sg[3] * 0.7 * 0.7 + sg[4] * pow(0.7, 3) + sg[5] * pow(0.7, 4) AS soft_combined FROM soft),
final AS (SELECT *, bank_alignment * anchor_relevance * coherence * context_bias * epa_alignment * soft_combined AS score FROM ranked)
"""


def _pos(bank: str) -> str:
    return f"(SELECT path_sign * path_depth FROM positions p WHERE p.model_id = s.model_id AND p.bank = '{bank}')"


def _bank_sql(bank: str, direction: int, exponent: float = 1.0) -> str:
    v = _pos(bank)
    known = f"1.0 / (1.0 + abs({v}))" if direction == 0 else f"CASE WHEN {v} * {direction} > 0 THEN 1.0 WHEN {v} = 0 THEN 0.5 ELSE 0.05 END"
    return f"pow(CASE WHEN {v} IS NULL THEN 0.3 ELSE {known} END, {exponent}::DOUBLE)"


def _pagerank_steps(rounds: int) -> list[str]:
    """Tables r0, r1 and so on: the ranks after each round."""
    parts = ["pe AS MATERIALIZED (SELECT source_id AS src, target_id AS dst, weight / sum(weight) OVER (PARTITION BY source_id) AS share FROM links WHERE relation = 'fine_tuned_from')", "pn AS MATERIALIZED (SELECT DISTINCT m AS model_id, m IN (SELECT src FROM pe) AS sends FROM (SELECT src AS m FROM pe UNION ALL SELECT dst FROM pe))", "pc AS MATERIALIZED (SELECT count(*)::DOUBLE AS n FROM pn)", "r0 AS MATERIALIZED (SELECT model_id, sends, 1 / (SELECT n FROM pc) AS rank FROM pn)"]
    for k in range(1, rounds + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT model_id, sends, 0.15::DOUBLE / (SELECT n FROM pc) + 0.85 * coalesce((SELECT sum(rank) FROM r{k - 1} WHERE NOT sends), 0) / (SELECT n FROM pc) + 0.85 * coalesce(got, 0) AS rank FROM pn LEFT JOIN (SELECT dst AS model_id, sum(rank * share) AS got FROM pe JOIN r{k - 1} ON src = model_id GROUP BY dst) USING (model_id))")
    return parts


def _rank_sql(q: Query, where: str) -> str:
    """The oracle of a ranking query: the same factors, written relation by relation."""
    names = lambda xs: ", ".join(f"'{x}'" for x in xs) or "''"
    exponents = navigate.bank_exponents(q.directions, q.bank_weights)
    bank = " * ".join(_bank_sql(b, d, exponents[b]) for b, d in q.directions.items() if exponents[b] > 0) or "1.0"
    asked = [(c, t) for c, t in zip(("vibe_e", "vibe_p", "vibe_a"), q.vibe) if t is not None]
    epa = "CASE WHEN vibe_e IS NOT NULL AND vibe_p IS NOT NULL AND vibe_a IS NOT NULL THEN " + " * ".join(f"pow(0.5, abs({c} - {t}::DOUBLE) / 0.6::DOUBLE)" for c, t in asked) + " ELSE 1.0 END" if asked else "1.0"
    if q.mode in navigate.MODES:
        w = navigate.MODES[q.mode]
        weights = f"{w[0]} AS k_pmi, {w[1]} AS k_rare, {w[2]} AS k_abs, {w[3]} AS k_super, {w[4]} AS k_pr"
    else:
        weights = "0.2 + 0.2 * (1 - m) AS k_pmi, 0.2 + 0.3 * (1 - m) AS k_rare, 0.15 + 0.25 * (1 - m) AS k_abs, 0.15 + 0.15 * (1 - m) AS k_super, 0.2 + 0.2 * m AS k_pr"
    more = _SIGNALS.format(where=where, require=names(q.require), prefer=names(q.prefer), avoid=names(q.avoid), context=names(q.context), n_banks=float(len(q.directions)), mech_banks=float(sum(navigate.MECHANICAL[b] for b in q.directions)), weights=weights, bank=bank, epa=epa)
    return on_network(f"SELECT model_id, round(bank_alignment, 6) AS bank_alignment, round(anchor_relevance, 6) AS anchor_relevance, round(context_bias, 6) AS context_bias, round(epa_alignment, 6) AS epa_alignment, round(soft_combined, 6) AS soft_combined, round(score, 6) AS score FROM final ORDER BY round(score, 9) DESC, model_id LIMIT {q.limit}", *_pagerank_steps(20), more)


def _ranking(name: str, q: Query, where: str) -> None:
    shown = ["bank_alignment", "anchor_relevance", "context_bias", "epa_alignment", "soft_combined", "score"]
    PLANS[name] = lambda spark, sf_dir: navigate.top(navigate.scored(from_driver(spark, sf_dir), q), q.limit).select("model_id", *[F.round(c, 6).alias(c) for c in shown])
    ORACLES[name] = _rank_sql(q, where)


_HARD = "model_id IN (SELECT model_id FROM model_anchors WHERE label = 'PROMO') AND model_id IN (SELECT model_id FROM positions WHERE bank = 'QUALITY' AND path_sign = 1 AND path_depth >= 1)"
_ranking("navigate_topk", FIRST, _HARD)
for _mode in navigate.MODES:
    _ranking(f"navigate_{_mode}", Query(directions={"EFFICIENCY": 0, "COMPATIBILITY": 1}, prefer=("blue", "Brand#3"), context=("gear",), bank_weights={"EFFICIENCY": 2.0}, mode=_mode, limit=50), "true")
_ranking("navigate_all", Query(directions={"TRAINING": -1}, prefer=("high-volume",), limit=10_000_000), "true")


@plan("navigate")
def _(net: Network) -> DataFrame:
    return navigate.navigate(net, FIRST)


@plan("navigate_similar")
def _(net: Network) -> DataFrame:
    return navigate.navigate(net, Query(similar_to="p7", directions={"QUALITY": 1}, limit=15))


@plan("seed_similarity", """SELECT model_id, round(shared / (seed + mine - shared), 6) AS similarity FROM (SELECT model_id, sum(CASE WHEN label IN (SELECT label FROM model_anchors WHERE model_id = 'p7') THEN idf ELSE 0 END) AS shared, sum(idf) AS mine,
(SELECT sum(idf) FROM (SELECT a.label, ln((SELECT count(*) FROM models)::DOUBLE / greatest(count(m.model_id), 1)) AS idf FROM anchors a LEFT JOIN model_anchors m USING (anchor_id) GROUP BY a.label) WHERE label IN (SELECT label FROM model_anchors WHERE model_id = 'p7')) AS seed
FROM model_anchors JOIN (SELECT a.label, ln((SELECT count(*) FROM models)::DOUBLE / greatest(count(m.model_id), 1)) AS idf FROM anchors a LEFT JOIN model_anchors m USING (anchor_id) GROUP BY a.label) USING (label) GROUP BY model_id)""")
def _(net: Network) -> DataFrame:
    return navigate.scored(net, Query(similar_to="p7")).select("model_id", F.round("seed_similarity", 6).alias("similarity"))


@plan("pagerank_fraction")
def _(net: Network) -> DataFrame:
    return navigate.profile(net).where("pagerank > 0").select("model_id", F.round("pr_frac", 6).alias("pr_frac"))


ORACLES["pagerank_fraction"] = on_network("SELECT model_id, round((dense_rank() OVER (ORDER BY round(rank, 8)) - 1) / ((SELECT count(DISTINCT round(rank, 8)) FROM r20 WHERE rank >= 1e-8) - 1)::DOUBLE, 6) AS pr_frac FROM r20 WHERE rank >= 1e-8", *_pagerank_steps(20))


@plan("stored_pagerank")
def _(net: Network) -> DataFrame:
    return graph.stored_pagerank(net).select("model_id", "key", "value", "value_type")


ORACLES["stored_pagerank"] = on_network("SELECT model_id, 'pagerank' AS key, printf('%.8f', round(rank, 8)) AS value, 'float' AS value_type FROM r20 WHERE rank >= 1e-8", *_pagerank_steps(20))


@plan("tie_clusters", """SELECT pos, model_id, score, CASE WHEN size >= 2 THEN dense_rank() OVER (ORDER BY (size < 2)::INT, start, part)::INT - 1 END AS cluster FROM (SELECT *, count(*) OVER (PARTITION BY start, part) AS size FROM (SELECT *, (pos - start) // 20 AS part FROM (SELECT *, max(CASE WHEN fresh THEN pos END) OVER (ORDER BY pos) AS start FROM (
SELECT *, coalesce(lag(score) OVER (ORDER BY pos) - score >= 0.05, TRUE) AS fresh FROM (SELECT (row_number() OVER (ORDER BY certification DESC, model_id) - 1)::INT AS pos, model_id, certification AS score FROM facts) WHERE pos < 60))))""")
def _(net: Network) -> DataFrame:
    best = net.facts.orderBy(F.desc("certification"), "model_id").limit(60).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("certification"), "model_id")) - 1)
    return navigate.tie_clusters(best.select("pos", "model_id", F.col("certification").alias("score")))


_WINDOW = "(SELECT model_id FROM facts ORDER BY downloads DESC, model_id LIMIT 40)"


def _window(net: Network) -> DataFrame:
    return net.facts.orderBy(F.desc("downloads"), "model_id").limit(40).select("model_id")


@plan("discriminating_axis", """SELECT grp, bank, round(variance, 6) AS variance FROM (SELECT grp, bank, variance, row_number() OVER (PARTITION BY grp ORDER BY round(variance, 9) DESC, bank) AS k FROM (
SELECT author AS grp, b.bank, var_pop(coalesce(path_sign * (1 + path_depth), 0)) AS variance FROM models CROSS JOIN (SELECT unnest(['ARCHITECTURE', 'CAPABILITY', 'EFFICIENCY', 'COMPATIBILITY', 'LINEAGE', 'DOMAIN', 'QUALITY', 'TRAINING']) AS bank) b LEFT JOIN positions p ON p.model_id = models.model_id AND p.bank = b.bank GROUP BY ALL)) WHERE k = 1 AND variance > 0""")
def _(net: Network) -> DataFrame:
    return navigate.discriminating_axis(net, net.models.select(F.col("author").alias("grp"), "model_id"))


@plan("axis_hints", f"""SELECT b.bank, round(var_pop(coalesce(path_sign * (1 + path_depth), 0)), 6) AS variance, min(coalesce(path_sign * (1 + path_depth), 0)) AS low, max(coalesce(path_sign * (1 + path_depth), 0)) AS high, count(DISTINCT coalesce(path_sign * (1 + path_depth), 0)) AS positions
FROM {_WINDOW} w CROSS JOIN (SELECT unnest(['ARCHITECTURE', 'CAPABILITY', 'COMPATIBILITY', 'LINEAGE', 'DOMAIN', 'QUALITY', 'TRAINING']) AS bank) b LEFT JOIN positions p ON p.model_id = w.model_id AND p.bank = b.bank GROUP BY b.bank HAVING var_pop(coalesce(path_sign * (1 + path_depth), 0)) > 0""")
def _(net: Network) -> DataFrame:
    return navigate.axis_hints(net, _window(net), ["EFFICIENCY"])


@plan("anchor_hints", f"""SELECT label, c, round(c * (40 - c) * CASE WHEN idf > 0 THEN idf ELSE 1 END, 6) AS balance FROM (SELECT label, count(*) AS c FROM model_anchors WHERE model_id IN {_WINDOW} GROUP BY label)
JOIN (SELECT a.label, ln((SELECT count(*) FROM models)::DOUBLE / greatest(count(m.model_id), 1)) AS idf FROM anchors a LEFT JOIN model_anchors m USING (anchor_id) GROUP BY a.label) USING (label) WHERE c < 40 ORDER BY balance DESC, label LIMIT 5""")
def _(net: Network) -> DataFrame:
    return navigate.anchor_hints(net, _window(net))


# --- search and comparison

@plan("similar_to", "SELECT model_id, shared, round(shared / ((SELECT count(*) FROM model_anchors WHERE model_id = 'p7') + size - shared)::DOUBLE, 6) AS similarity FROM (SELECT model_id, count(*) AS size, count(*) FILTER (anchor_id IN (SELECT anchor_id FROM model_anchors WHERE model_id = 'p7')) AS shared FROM model_anchors WHERE model_id <> 'p7' GROUP BY model_id) WHERE shared > 0 ORDER BY similarity DESC, model_id LIMIT 10")
def _(net: Network) -> DataFrame:
    return search.similar_to(net, "p7")


@plan("confidence_jaccard", "SELECT model_id, round(sum(CASE WHEN label IN ('red', 'PROMO', 'Brand#7') THEN confidence ELSE 0 END) / (sum(confidence) + 3 - sum((label IN ('red', 'PROMO', 'Brand#7'))::INT)), 6) AS similarity FROM model_anchors GROUP BY model_id")
def _(net: Network) -> DataFrame:
    return search.confidence_jaccard(net, ("red", "PROMO", "Brand#7")).withColumn("similarity", F.round("similarity", 6))


@plan("jaccard_pairs", """SELECT a, b, round(shared / (sa + sb - shared)::DOUBLE, 6) AS jaccard FROM (SELECT x.model_id AS a, y.model_id AS b, (SELECT count(*) FROM model_anchors m JOIN model_anchors n ON m.label = n.label WHERE m.model_id = x.model_id AND n.model_id = y.model_id) AS shared,
(SELECT count(*) FROM model_anchors m WHERE m.model_id = x.model_id) AS sa, (SELECT count(*) FROM model_anchors m WHERE m.model_id = y.model_id) AS sb FROM models x JOIN models y ON x.model_id < y.model_id WHERE x.model_id IN ('p1', 'p2', 'p3', 'p7') AND y.model_id IN ('p1', 'p2', 'p3', 'p7'))""")
def _(net: Network) -> DataFrame:
    return search.jaccard_pairs(net, ("p1", "p2", "p3", "p7"))


@plan("compare_entities", """SELECT 'shared' AS kind, '' AS model_id, label AS item, 0 AS value FROM model_anchors WHERE model_id IN ('p1', 'p2', 'p3') GROUP BY label HAVING count(*) = 3 UNION ALL
SELECT 'unique', model_id, label, 0 FROM model_anchors WHERE model_id IN ('p1', 'p2', 'p3') AND label IN (SELECT label FROM model_anchors WHERE model_id IN ('p1', 'p2', 'p3') GROUP BY label HAVING count(*) < 3) UNION ALL
SELECT 'bank', model_id, bank, path_sign * path_depth FROM positions WHERE model_id IN ('p1', 'p2', 'p3')""")
def _(net: Network) -> DataFrame:
    return search.compare(net, ("p1", "p2", "p3"))


_NEAR = """near AS (SELECT node, other, CASE relation WHEN 'fine_tuned_from' THEN 0.9 ELSE 0.7 END AS step FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY way, k, other) AS r FROM (
SELECT node, other, way, k, relation, row_number() OVER (PARTITION BY node, other ORDER BY way, k) AS once FROM (SELECT *, row_number() OVER (PARTITION BY node, way ORDER BY weight DESC, other, relation) AS k FROM (SELECT source_id AS node, target_id AS other, relation, weight, 0 AS way FROM links UNION ALL SELECT target_id, source_id, relation, weight, 1 FROM links)) WHERE k <= 20) WHERE once = 1) WHERE r <= 20)"""


@plan("search_combined")
def _(net: Network) -> DataFrame:
    near = graph.spread(net, ("p3",), depth=1, labels=False)
    found = search.combined(net, {"EFFICIENCY": (-2, 0, None), "QUALITY": (None, None, 1)}, ("red", "PROMO"), spread=near)
    return found.select("model_id", F.round("bank_score", 6).alias("bank_score"), F.round("anchor_score", 6).alias("anchor_score"), "score")


ORACLES["search_combined"] = on_network("""SELECT model_id, round(bank_score, 6) AS bank_score, round(anchor_score, 6) AS anchor_score, round(0.3 * bank_score + 0.35 * anchor_score + 0.15::DOUBLE * spread_score, 6) AS score FROM (SELECT m.model_id,
(CASE WHEN coalesce(e.v, 0) BETWEEN -2 AND 0 THEN 1.0 ELSE 1.0 / (1.0 + least(abs(coalesce(e.v, 0) + 2), abs(coalesce(e.v, 0)))) END + CASE WHEN coalesce(q.v, 0) > 0 THEN 1.0 ELSE 1.0 / (1.0 + abs(coalesce(q.v, 0) - 1)) END) / 2 AS bank_score, coalesce(c.similarity, 0) AS anchor_score, coalesce(0.8::DOUBLE * near.step, 0) AS spread_score
FROM models m LEFT JOIN near ON near.node = 'p3' AND near.other = m.model_id LEFT JOIN (SELECT model_id, path_sign * path_depth AS v FROM positions WHERE bank = 'EFFICIENCY') e USING (model_id) LEFT JOIN (SELECT model_id, path_sign * path_depth AS v FROM positions WHERE bank = 'QUALITY') q USING (model_id)
LEFT JOIN (SELECT model_id, sum(CASE WHEN label IN ('red', 'PROMO') THEN confidence ELSE 0 END) / (sum(confidence) + 2 - sum((label IN ('red', 'PROMO'))::INT)) AS similarity FROM model_anchors GROUP BY model_id) c USING (model_id)) ORDER BY score DESC, model_id LIMIT 20""", _NEAR)


@plan("fuzzy_scores")
def _(net: Network) -> DataFrame:
    return search.fuzzy_scores(net, "red widgets")


# --- graph

def _pagerank_sql(rounds: int) -> str:
    return on_network(f"SELECT model_id, round(rank, 8) AS rank FROM r{rounds}", *_pagerank_steps(rounds))


@plan("pagerank_5_iters")
def _(net: Network) -> DataFrame:
    return graph.pagerank(net, iterations=5, tolerance=0.0).withColumn("rank", F.round("rank", 8))


ORACLES["pagerank_5_iters"] = _pagerank_sql(5)


@plan("pagerank")
def _(net: Network) -> DataFrame:
    return graph.pagerank(net)


UP = ("e AS (SELECT source_id AS s, target_id AS t, weight::DOUBLE AS w FROM links WHERE relation = 'fine_tuned_from' AND weight >= 2)", "reach AS (SELECT s, t, 1 AS hop, w FROM e UNION ALL SELECT a.s, b.t, 2, a.w * b.w FROM e a JOIN e b ON a.t = b.s UNION ALL SELECT a.s, c.t, 3, a.w * b.w * c.w FROM e a JOIN e b ON a.t = b.s JOIN e c ON b.t = c.s)",
      "nearest AS (SELECT s, t, hop, max(w) AS w FROM reach r WHERE s <> t AND hop = (SELECT min(hop) FROM reach q WHERE q.s = r.s AND q.t = r.t) GROUP BY ALL)",
      "inh AS (SELECT model_id, label, confidence FROM (SELECT d.s AS model_id, label, max(least(1.0, confidence * pow(0.5, hop) * w)) AS confidence FROM nearest d JOIN model_anchors a ON a.model_id = d.t GROUP BY ALL) x WHERE confidence >= 0.05 AND NOT EXISTS (SELECT 1 FROM model_anchors o WHERE o.model_id = x.model_id AND o.label = x.label))")


@plan("inherited_anchors")
def _(net: Network) -> DataFrame:
    return graph.inherited(net).withColumn("confidence", F.round("confidence", 6))


ORACLES["inherited_anchors"] = on_network("SELECT model_id, label, round(confidence, 6) AS confidence FROM inh", *UP)


@plan("descendants")
def _(net: Network) -> DataFrame:
    return graph.descendants(net, "p9", least_weight=1, hops=2)


ORACLES["descendants"] = on_network("SELECT model_id, min(depth)::INT AS depth FROM down WHERE depth > 0 AND model_id <> 'p9' GROUP BY model_id", "e AS (SELECT source_id AS s, target_id AS t FROM links WHERE relation = 'fine_tuned_from')", "down AS (SELECT 'p9' AS model_id, 0 AS depth UNION SELECT e.s, depth + 1 FROM down JOIN e ON e.t = down.model_id WHERE depth < 2)")


@plan("lineage_view", """SELECT kind, other, sum(weight)::BIGINT AS weight FROM (SELECT CASE relation WHEN 'same_family' THEN 'family' ELSE 'derived_from' END AS kind, target_id AS other, weight FROM links WHERE source_id = 'p7'
UNION ALL SELECT CASE relation WHEN 'same_family' THEN 'family' ELSE 'derivatives' END, source_id, weight FROM links WHERE target_id = 'p7') GROUP BY ALL""")
def _(net: Network) -> DataFrame:
    return graph.lineage_view(net, "p7")


@plan("sibling_links", """SELECT DISTINCT a.m AS a, b.m AS b, 'variant_of' AS relation, 0.6::DOUBLE AS weight FROM (SELECT target_id AS g, source_id AS m, row_number() OVER (PARTITION BY target_id ORDER BY source_id) AS k FROM links WHERE relation = 'fine_tuned_from' AND weight >= 2) a
JOIN (SELECT target_id AS g, source_id AS m, row_number() OVER (PARTITION BY target_id ORDER BY source_id) AS k FROM links WHERE relation = 'fine_tuned_from' AND weight >= 2) b ON a.g = b.g AND a.k < b.k AND a.k <= 20 AND b.k <= 20""")
def _(net: Network) -> DataFrame:
    return graph.siblings(net)


@plan("variant_links", """SELECT a.model_id AS a, b.model_id AS b, 'variant_of' AS relation, 0.5::DOUBLE AS weight FROM (SELECT *, substr(lower(display_name), 1, 3) AS p, row_number() OVER (PARTITION BY author, substr(lower(display_name), 1, 3) ORDER BY model_id) AS k FROM models WHERE length(display_name) >= 3) a
JOIN (SELECT *, substr(lower(display_name), 1, 3) AS p, row_number() OVER (PARTITION BY author, substr(lower(display_name), 1, 3) ORDER BY model_id) AS k FROM models WHERE length(display_name) >= 3) b ON a.author = b.author AND a.p = b.p AND a.k < b.k AND b.k <= 50""")
def _(net: Network) -> DataFrame:
    return graph.variants(net)


@plan("fingerprint_links", """SELECT a.model_id AS a, b.model_id AS b, 'same_family' AS relation, 0.5::DOUBLE AS weight FROM (SELECT model_id, substr(sha256(p_size || ':' || p_type || ':' || word2), 1, 16) AS f, row_number() OVER (PARTITION BY substr(sha256(p_size || ':' || p_type || ':' || word2), 1, 16) ORDER BY model_id) AS k FROM facts) a
JOIN (SELECT model_id, substr(sha256(p_size || ':' || p_type || ':' || word2), 1, 16) AS f, row_number() OVER (PARTITION BY substr(sha256(p_size || ':' || p_type || ':' || word2), 1, 16) ORDER BY model_id) AS k FROM facts) b ON a.f = b.f AND a.k < b.k AND b.k <= 50""")
def _(net: Network) -> DataFrame:
    return graph.fingerprint_links(net)


@plan("spread_links")
def _(net: Network) -> DataFrame:
    return graph.spread(net, ("p3", "p9"), depth=2, labels=False)


ORACLES["spread_links"] = on_network("SELECT model_id, round(max(activation), 6) AS score FROM (SELECT * FROM one UNION ALL SELECT other, max(activation * 0.8 * step) FROM one JOIN near ON node = model_id GROUP BY other) WHERE model_id NOT IN ('p3', 'p9') GROUP BY model_id", _NEAR, "one AS (SELECT other AS model_id, max(0.8::DOUBLE * step) AS activation FROM near WHERE node IN ('p3', 'p9') GROUP BY other)")


@plan("anchor_neighbors", "SELECT model_id, count(*) AS shared FROM model_anchors WHERE model_id <> 'p7' AND anchor_id IN (SELECT anchor_id FROM model_anchors WHERE model_id = 'p7') GROUP BY model_id ORDER BY shared DESC, model_id LIMIT 15")
def _(net: Network) -> DataFrame:
    return graph.anchor_neighbours(net, "p7")


# --- text, extraction, certification

def _html_sql() -> str:
    out = "html"
    steps = [*[(rf"(?is)<{t}[^>]*>.*?</{t}>", "' '") for t in ("script", "style", "nav", "header", "footer")], (r"(?i)</?(p|div|br|li|tr|h[1-6]|ul|ol|table|section|article)[^>]*>", "chr(10)"), (r"<[^>]+>", "''")]
    for pattern, by in steps:
        out = f"regexp_replace({out}, '{pattern}', {by}, 'g')"
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        out = f"replace({out}, '{entity}', '{sign}')"
    out = f"regexp_replace({out}, '[ \\t]+', ' ', 'g')"
    return f"SELECT page_id, trim(regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10)) AS text FROM pages"


@plan("html_to_text", _html_sql(), network=False)
def _(table) -> DataFrame:
    return table("pages").select("page_id", text.html_to_text(F.col("html")).alias("text"))


@plan("page_hosts", r"SELECT page_id, host, host = 'example.com' OR host LIKE '%.example.com' AS allowed FROM (SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)), '^www\.', '') AS host FROM pages)", network=False)
def _(table) -> DataFrame:
    return table("pages").select("page_id", text.host(F.col("url")).alias("host"), text.allowed_host(F.col("url"), ("example.com",)).alias("allowed"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@plan("token_counts", f"SELECT doc_id, CAST(len(list_filter(regexp_extract_all(translate(text, '{ascii_uppercase}', '{ascii_lowercase}'), '[a-z0-9_.-]+'), lambda t: length(t) > 1 AND t NOT IN ({_STOP}))) AS INT) AS tokens FROM documents", network=False)
def _(table) -> DataFrame:
    return table("documents").select("doc_id", F.size(text.tokens(F.translate("text", ascii_uppercase, ascii_lowercase))).alias("tokens"))


_SECTIONS = " + ".join(rf"coalesce(regexp_matches(text, '(?i)##?\s*(?:{names})'), false)::INT" for names in text.SECTIONS)


@plan("card_quality", f"SELECT doc_id, round(({_SECTIONS}) / 6.0::DOUBLE, 2) AS quality FROM documents", network=False)
def _(table) -> DataFrame:
    return table("documents").select("doc_id", text.card_quality(F.col("text")).alias("quality"))


_WORDS = ", ".join(f"('{w}', {v[0]}, {v[1]}, {v[2]})" for w, v in text.LEXICON.items())


@plan("epa_scores", f"""WITH lex(w, e, p, a) AS (VALUES {_WORDS}), t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9-]+')) AS w FROM documents),
hit AS (SELECT doc_id, {", ".join(f"greatest(-10, least(10, sum({x}))) / 10.0::DOUBLE AS {x}" for x in "epa")} FROM t JOIN lex USING (w) GROUP BY doc_id)
SELECT d.doc_id, e, p, a FROM documents d LEFT JOIN hit USING (doc_id)""", network=False)
def _(table) -> DataFrame:
    e, p, a = text.epa(F.col("text"))
    return table("documents").select("doc_id", e.alias("e"), p.alias("p"), a.alias("a"))


@plan("size_classes", "SELECT model_id, params_b, CASE WHEN params_b < 0.5 THEN 'sub-1B' WHEN params_b < 1.5 THEN '1B-class' WHEN params_b < 5 THEN '3B-class' WHEN params_b < 10 THEN '7B-class' WHEN params_b < 20 THEN '13B-class' WHEN params_b < 50 THEN '30B-class' WHEN params_b < 100 THEN '70B-class' ELSE 'frontier-class' END AS size_class FROM facts")
def _(net: Network) -> DataFrame:
    named = net.facts.withColumn("text", F.concat(F.col("params_b").cast("string"), F.lit("B")))
    return named.select("model_id", "params_b", extract.bucket(text.size_number(F.col("text")), 4).alias("size_class"))


def _raw(net: Network) -> DataFrame:
    """Raw records made of the facts: sizes as a map, a number, bytes, in the name or in a tag."""
    k = F.col("p_partkey") % 5
    count = (F.col("p_size").cast("bigint") * 100_000_000).cast("string")
    weights = F.when(k == 0, F.concat(F.lit('{"parameters": {"F16": '), count, F.lit("}}"))).when(k == 1, F.concat(F.lit('{"parameters": '), count, F.lit("}"))).when(k == 2, F.concat(F.lit('{"total": '), count, F.lit("}")))
    name = F.when(k == 3, F.concat("model_id", F.lit("-"), F.col("p_size").cast("string"), F.lit("B-q4_k_m"))).otherwise(F.col("model_id"))
    tags = F.array(F.when(k == 4, F.concat(F.col("p_size").cast("string"), F.lit("b"))).otherwise(F.lit("none")), F.lit("en"), F.concat(F.lit("dataset:"), "word1"), F.concat(F.lit("license:"), F.lower("p_type")))
    config = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('{"hidden_size": 64, "num_hidden_layers": '), F.col("p_size").cast("string"), F.lit(', "num_attention_heads": 4, "vocab_size": 100, "max_position_embeddings": '), (F.col("p_size") * 4000).cast("string"), F.lit("}")))
    return net.facts.select(name.alias("model_id"), tags.alias("tags"), F.col("likes"), (F.col("downloads") * 2000).cast("bigint").alias("downloads"), F.lit("2024-01-01").alias("created_at"), F.lit(None).cast("string").alias("license"), weights.alias("safetensors"), config.alias("config"))


@plan("extract_records", """SELECT CASE WHEN p_partkey % 5 = 3 THEN model_id || '-' || p_size || 'B-q4_k_m' ELSE model_id END AS model_id, b AS params_b, CASE WHEN b < 5 THEN -1 WHEN b < 10 THEN 0 ELSE 1 END AS efficiency_sign,
CASE WHEN b < 0.5 THEN 3 WHEN b < 1.5 THEN 2 WHEN b < 5 THEN 1 WHEN b < 10 THEN 0 WHEN b < 20 THEN 1 WHEN b < 50 THEN 2 WHEN b < 100 THEN 3 ELSE 4 END AS efficiency_depth,
CASE WHEN s > 5 THEN CASE WHEN s > 15 THEN 1 ELSE 0 END ELSE -1 END AS quality_sign, CASE WHEN s > 25 THEN 2 WHEN s > 15 THEN 1 WHEN s > 5 THEN 0 WHEN s > 1 THEN 1 ELSE 2 END AS quality_depth,
array_to_string(list_sort(list_filter([CASE WHEN b < 0.5 THEN 'sub-1B' WHEN b < 1.5 THEN '1B-class' WHEN b < 5 THEN '3B-class' WHEN b < 10 THEN '7B-class' WHEN b < 20 THEN '13B-class' WHEN b < 50 THEN '30B-class' WHEN b < 100 THEN '70B-class' ELSE 'frontier-class' END, CASE WHEN b < 4 THEN 'consumer-GPU-viable' END, CASE WHEN b < 1 THEN 'edge-deployable' END,
CASE WHEN p_size % 2 = 0 THEN CASE WHEN p_size * 4000 >= 131072 THEN 'long-context-128k' WHEN p_size * 4000 >= 32768 THEN 'long-context-32k' END END, CASE WHEN d > 1000000 THEN 'high-downloads' END, CASE WHEN likes > 1000 THEN 'community-favorite' END, CASE WHEN p_partkey % 5 = 3 THEN 'quantized' END], lambda x: x IS NOT NULL)), ',') AS labels,
CASE WHEN p_size % 2 = 0 THEN substr(sha256('64:' || p_size || ':4:100'), 1, 16) END AS fingerprint, lower(p_type) AS license, CASE WHEN p_partkey % 5 = 3 THEN 'Q4_K_M' END AS quant_level, word1 AS datasets, 'en' AS languages
FROM (SELECT *, round(CASE p_partkey % 5 WHEN 0 THEN p_size / 10.0 WHEN 1 THEN p_size / 10.0 WHEN 2 THEN p_size / 20.0 ELSE p_size END::DOUBLE, 6) AS b, CAST(downloads * 2000 AS BIGINT) AS d, 2 * ln(1 + likes) + 0.5 * ln(1 + CAST(downloads * 2000 AS BIGINT)) AS s FROM facts)""")
def _(net: Network) -> DataFrame:
    return extract.extract(_raw(net), F.lit("2025-01-01").cast("date"))


@plan("popularity_score", "SELECT model_id, round(2 * ln(1 + likes) + 0.5 * ln(1 + downloads), 6) AS popularity FROM facts")
def _(net: Network) -> DataFrame:
    return net.facts.select("model_id", F.round(text.popularity(F.col("likes"), F.col("downloads")), 6).alias("popularity"))


@plan("sha_sample", "SELECT model_id FROM models ORDER BY sha256('s1:' || model_id), model_id LIMIT 50")
def _(net: Network) -> DataFrame:
    return net.models.orderBy(text.sample_key("s1", F.col("model_id")), "model_id").limit(50).select("model_id")


_FIRED = """SELECT model_id, 'tiny_is_small' AS rule, 1 AS tier, ['size-1'] AS requires, ['size-7', 'size-6'] AS forbids FROM facts WHERE p_size < 5 UNION ALL SELECT model_id, 'returns_doubt_popularity', 2, [], ['high-volume'] FROM facts WHERE ret > 0.4
UNION ALL SELECT model_id, 'few_suppliers', 1, [], ['multi-supplier'] FROM facts WHERE n_supp < 20 UNION ALL SELECT model_id, 'promo_lines', 3, [], ['return-prone'] FROM facts WHERE p_type = 'PROMO' UNION ALL SELECT model_id, 'bulk_sellers', 1, ['high-volume'], [] FROM facts WHERE downloads > 900
UNION ALL SELECT model_id, 'large_many', 2, [], ['multi-supplier'] FROM facts WHERE p_type = 'LARGE' AND n_supp >= 30 UNION ALL SELECT model_id, 'economy_warn', 3, [], ['size-7'] FROM facts WHERE p_type = 'ECONOMY'"""
_VERDICTS = ("fired AS (" + _FIRED + ")", "worst AS (SELECT model_id, label, min(tier) AS tier FROM (SELECT model_id, tier, unnest(forbids) AS label FROM fired) GROUP BY ALL)", """verdicts AS (SELECT model_id, label, CASE tier WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'DEMOTED' WHEN 3 THEN 'WARNING' ELSE 'CERTIFIED' END AS verdict, CASE WHEN tier = 2 THEN confidence * 0.5 ELSE confidence END AS confidence FROM model_anchors LEFT JOIN worst USING (model_id, label)
UNION ALL SELECT DISTINCT model_id, label, 'AUTO_ADDED', 1.0 FROM (SELECT model_id, unnest(requires) AS label FROM fired WHERE tier = 1) w WHERE NOT EXISTS (SELECT 1 FROM model_anchors a WHERE a.model_id = w.model_id AND a.label = w.label))""")


@plan("certify_verdicts")
def _(net: Network) -> DataFrame:
    return certify.certify(net)


@plan("certify_score")
def _(net: Network) -> DataFrame:
    return certify.certification_score(certify.certify(net))


@plan("rule_hits")
def _(net: Network) -> DataFrame:
    return certify.rule_hits(net)


ORACLES["certify_verdicts"] = on_network("SELECT * FROM verdicts", *_VERDICTS)
ORACLES["certify_score"] = on_network("SELECT model_id, count(*) FILTER (verdict = 'REJECTED') AS drops, count(*) FILTER (verdict = 'DEMOTED') AS demotes, round(greatest(0, 1 - (count(*) FILTER (verdict = 'REJECTED') + 0.5 * count(*) FILTER (verdict = 'DEMOTED')) / count(*)::DOUBLE), 6) AS score FROM verdicts WHERE verdict <> 'AUTO_ADDED' GROUP BY model_id", *_VERDICTS)
ORACLES["rule_hits"] = on_network("SELECT rule, tier, count(*) AS hits FROM fired GROUP BY ALL ORDER BY hits DESC, rule LIMIT 15", _VERDICTS[0])


# --- writes, merges and audits

def _suggested(net: Network) -> DataFrame:
    """Labels from a second source, derived from the facts."""
    x = F.array(F.when(F.col("p_size") % 2 == 0, F.struct(F.lit("red").alias("label"), F.lit(0.4).alias("confidence"))), F.when(F.col("p_size") % 5 == 0, F.struct(F.lit("Novel").alias("label"), F.lit(0.4).alias("confidence"))), F.when(F.col("p_size") % 3 == 0, F.struct(F.lit("HIGH-Volume").alias("label"), F.lit(0.4).alias("confidence"))))
    return net.facts.select("model_id", F.explode(x).alias("x")).where("x is not null").select("model_id", "x.*")


_SUGGESTED = "sug AS (SELECT model_id, 'red' AS label, 0.4::DOUBLE AS confidence FROM facts WHERE p_size % 2 = 0 UNION ALL SELECT model_id, 'Novel', 0.4 FROM facts WHERE p_size % 5 = 0 UNION ALL SELECT model_id, 'HIGH-Volume', 0.4 FROM facts WHERE p_size % 3 = 0)"
_FINDINGS = """findings AS (SELECT DISTINCT m.model_id, 'contradiction' AS kind, 'DOMAIN' AS item, 0.7::DOUBLE AS severity FROM sug m JOIN model_anchors a ON a.model_id = m.model_id AND a.bank = 'DOMAIN' WHERE m.label = 'red' AND a.label <> 'red'
UNION ALL SELECT m.model_id, 'gap', bank, 0.5 FROM models m CROSS JOIN (SELECT unnest(['ARCHITECTURE', 'CAPABILITY', 'EFFICIENCY', 'COMPATIBILITY', 'LINEAGE', 'DOMAIN', 'QUALITY', 'TRAINING']) AS bank) b WHERE NOT EXISTS (SELECT 1 FROM model_anchors a WHERE a.model_id = m.model_id AND a.bank = b.bank) AND NOT EXISTS (SELECT 1 FROM sug s JOIN anchors c ON c.label = s.label WHERE s.model_id = m.model_id AND c.bank = b.bank)
UNION ALL SELECT a.model_id, 'conflict', a.label, round(abs(a.confidence - s.confidence), 6) FROM model_anchors a JOIN sug s ON a.model_id = s.model_id AND a.label = s.label WHERE abs(a.confidence - s.confidence) > 0.3
UNION ALL SELECT model_id, 'unsupported', label, 0.6 FROM sug WHERE label NOT IN (SELECT label FROM anchors))"""


@plan("audit_findings")
def _(net: Network) -> DataFrame:
    return records.audit_findings(net, _suggested(net))


@plan("audit_summary")
def _(net: Network) -> DataFrame:
    return records.audit_findings(net, _suggested(net)).groupBy("kind", "item").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("severity"), 6).alias("severity"))


@plan("merge_outcomes")
def _(net: Network) -> DataFrame:
    return records.merge_outcomes(net, _suggested(net)).groupBy("label", "outcome").agg(F.count(F.lit(1)).alias("n"))


@plan("healing_candidates")
def _(net: Network) -> DataFrame:
    return records.healing_candidates(net, records.audit_findings(net, _suggested(net)).where("kind = 'contradiction'"), 20)


ORACLES["audit_findings"] = on_network("SELECT * FROM findings", _SUGGESTED, _FINDINGS)
ORACLES["audit_summary"] = on_network("SELECT kind, item, count(*) AS n, round(avg(severity), 6) AS severity FROM findings GROUP BY ALL", _SUGGESTED, _FINDINGS)
ORACLES["merge_outcomes"] = on_network("SELECT s.label, CASE WHEN c.label IS NULL THEN 'unknown' WHEN a.confidence >= 0.4 THEN 'existing' ELSE 'added' END AS outcome, count(*) AS n FROM sug s LEFT JOIN anchors c ON lower(c.label) = lower(s.label) LEFT JOIN model_anchors a ON a.model_id = s.model_id AND a.label = c.label GROUP BY ALL", _SUGGESTED)
ORACLES["healing_candidates"] = on_network("SELECT model_id, 'popular' AS why FROM pop UNION ALL (SELECT model_id, 'sampled' FROM flagged WHERE model_id NOT IN (SELECT model_id FROM pop) ORDER BY sha256('heal:' || model_id), model_id LIMIT 10)", _SUGGESTED, _FINDINGS, "flagged AS (SELECT model_id, downloads FROM facts WHERE model_id IN (SELECT model_id FROM findings WHERE kind = 'contradiction'))", "pop AS (SELECT model_id FROM flagged ORDER BY downloads DESC, model_id LIMIT 10)")


#: Rules of every kind of condition, as a parsed expansion file gives them; one has a pattern that is none.
EXPANSION = {"expansions": [
    {"label": "showcase", "bank": "DOMAIN", "mode": "auto_link", "match_rules": {"operator": "OR", "min_matches": 2, "conditions": [{"type": "tag_exact", "value": "RED"}, {"type": "pipeline_tag_in", "value": ["promo", "large"]}, {"type": "name_regex", "value": "7$"}]}},
    {"label": "boxed", "bank": "DOMAIN", "confidence": 0.5, "match_rules": {"operator": "AND", "conditions": [{"type": "tag_regex", "value": "^b(lue|ox)"}, {"type": "metadata_equals", "value": {"key": "size", "value": 10}}]}},
    {"label": "broken", "bank": "DOMAIN", "match_rules": {"conditions": [{"type": "tag_regex", "value": "(["}]}},
]}


@plan("expansion_matches", """SELECT model_id, 'showcase' AS label, 'auto_link' AS mode, 0.7::DOUBLE AS confidence FROM facts WHERE (lower(word1) = 'red' OR lower(word2) = 'red')::INT + (p_type IN ('PROMO', 'LARGE'))::INT + regexp_matches(model_id, '7$')::INT >= 2
UNION ALL SELECT model_id, 'boxed', 'create_only', 0.5 FROM facts WHERE p_size = 10 AND (regexp_matches(word1, '(?i)^b(lue|ox)') OR regexp_matches(word2, '(?i)^b(lue|ox)'))""")
def _(net: Network) -> DataFrame:
    rows = net.facts.select("model_id", F.array("word1", "word2").alias("tags"), F.lower("p_type").alias("pipeline_tag"), F.col("p_size").cast("string").alias("size"))
    return files.expand(rows, files.expansion_rules(EXPANSION)).select("model_id", "label", "mode", "confidence")


@plan("order_parameter", "SELECT model_id, round(sqrt(pow(avg(cos((greatest(-4, least(4, path_sign * path_depth)) + 4) / 8.0::DOUBLE * pi())), 2) + pow(avg(sin((greatest(-4, least(4, path_sign * path_depth)) + 4) / 8.0::DOUBLE * pi())), 2)), 6) AS r FROM positions GROUP BY model_id HAVING count(*) >= 2")
def _(net: Network) -> DataFrame:
    return records.order_parameter(net)


_RECONCILE = "SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_name || ' jr' ELSE c_name END AS c_name, CASE WHEN c_custkey % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 10000000, c_name, c_mktsegment FROM customer WHERE c_custkey % 100 = 0"


@plan("reconcile_diff", f"""WITH items AS ({_RECONCILE}), j AS (SELECT i.*, c.c_custkey AS known, c.c_name AS o_name, c.c_mktsegment AS o_seg FROM items i LEFT JOIN customer c ON c.c_custkey = i.k),
d AS (SELECT k, 'c_name' AS field, o_name AS old_value, c_name AS new_value FROM j WHERE known IS NOT NULL AND o_name IS DISTINCT FROM c_name UNION ALL SELECT k, 'c_mktsegment', o_seg, c_mktsegment FROM j WHERE known IS NOT NULL AND o_seg IS DISTINCT FROM c_mktsegment)
SELECT k, 'patch' AS op, field, old_value, new_value FROM d UNION ALL SELECT k, 'insert', NULL, NULL, NULL FROM j WHERE known IS NULL UNION ALL SELECT k, 'unchanged', NULL, NULL, NULL FROM j WHERE known IS NOT NULL AND k NOT IN (SELECT k FROM d)""", network=False)
def _(table) -> DataFrame:
    customer = table("customer").select(F.col("c_custkey").alias("k"), "c_name", "c_mktsegment")
    changed = customer.where("k % 3 = 0").select("k", F.expr("CASE WHEN k % 7 = 0 THEN c_name || ' jr' ELSE c_name END").alias("c_name"), F.expr("CASE WHEN k % 5 = 0 THEN 'MOVED' ELSE c_mktsegment END").alias("c_mktsegment"))
    new = customer.where("k % 100 = 0").withColumn("k", F.col("k") + 10000000)
    return records.reconcile(customer, changed.union(changed).union(new), "k", ["c_name", "c_mktsegment"])


@plan("upsert_latest", "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 10 = 0 THEN 2 WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS version FROM orders", network=False)
def _(table) -> DataFrame:
    now = table("orders").select("o_orderkey", "o_orderstatus", F.lit(0).alias("version"))
    first, second = now.where("o_orderkey % 5 = 0").withColumn("version", F.lit(1)), now.where("o_orderkey % 10 = 0").withColumn("version", F.lit(2))
    return records.latest_wins(now, first.union(second), ["o_orderkey"], "version")


@plan("ground_truth", "SELECT quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS mean_chars FROM labels JOIN documents USING (doc_id) GROUP BY ALL", network=False)
def _(table) -> DataFrame:
    return table("labels").join(table("documents").select("doc_id", "n_chars"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"))


@plan("ground_truth_similarity", network=False)
def _(table) -> DataFrame:
    turns = table("conversations").select("conv_id", "turn", "text")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return turns.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(fuzzy.sequence_ratio("text", "reply"), 6).alias("ratio"))


# --- events

@plan("tumbling_events", "SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", network=False)
def _(table) -> DataFrame:
    return events.tumbling(table("events"))


@plan("session_events", "SELECT user_id, min(us) AS start, count(*) AS n FROM (SELECT user_id, us, sum(fresh) OVER (PARTITION BY user_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= 1800000000 THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s", network=False)
def _(table) -> DataFrame:
    return events.sessions(table("events"))


@plan("dedup_events", "SELECT DISTINCT user_id, event_type FROM events", network=False)
def _(table) -> DataFrame:
    return events.first_seen(table("events"), ["user_id", "event_type"]).select("user_id", "event_type")


@plan("event_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract(props, '$.k') AS BIGINT))::BIGINT AS k FROM events GROUP BY event_type", network=False)
def _(table) -> DataFrame:
    return table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("k"))
