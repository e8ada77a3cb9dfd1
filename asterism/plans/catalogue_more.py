"""Further registered queries: spreading, hierarchies, writes, evaluation and guidance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..operators import evaluate, graph, records, refine, stats
from .catalogue import _FINDINGS, _NEAR, _SUGGESTED, FIRST, ORACLES, UP, _suggested, plan
from .prelude import on_network


@plan("spread_multi_hop")
def _(net: Network) -> DataFrame:
    return graph.spread_mixed(net, ("p3",)).select("model_id", "activation", F.size("path").alias("steps"))


@plan("spread_labels")
def _(net: Network) -> DataFrame:
    return graph.spread(net, ("p3",), depth=1, banks=("DOMAIN", "LINEAGE"))


ORACLES["spread_labels"] = on_network("""SELECT model_id, round(max(a), 6) AS score FROM (SELECT other AS model_id, 0.8::DOUBLE * step AS a FROM near WHERE node = 'p3' UNION ALL SELECT model_id, 0.8::DOUBLE * shared / (SELECT count(*) FROM own) FROM (SELECT model_id, count(*) AS shared FROM model_anchors WHERE model_id <> 'p3' AND anchor_id IN (SELECT anchor_id FROM own) GROUP BY model_id ORDER BY shared DESC, model_id LIMIT 15))
GROUP BY model_id""", _NEAR, "own AS (SELECT anchor_id FROM model_anchors WHERE model_id = 'p3' AND bank IN ('DOMAIN', 'LINEAGE'))")


@plan("bank_activation")
def _(net: Network) -> DataFrame:
    return graph.bank_activation(net, graph.spread_mixed(net, ("p3",)))


@plan("lineage_order", "SELECT other, path_sign * path_depth AS position FROM (SELECT target_id AS other FROM links WHERE source_id = 'p7' UNION SELECT source_id FROM links WHERE target_id = 'p7') LEFT JOIN positions ON model_id = other AND bank = 'LINEAGE'")
def _(net: Network) -> DataFrame:
    return graph.lineage_order(net, "p7")


_CHAIN = "chain(label, parent) AS (VALUES ('size-2', 'size-1'), ('size-3', 'size-2'), ('size-4', 'size-3'), ('size-5', 'size-4'), ('size-6', 'size-5'), ('size-7', 'size-6'), ('loop-a', 'loop-b'), ('loop-b', 'loop-a'))"


@plan("ancestors_depth")
def _(net: Network) -> DataFrame:
    spark = net.models.sparkSession
    chain = [(f"size-{k + 1}", f"size-{k}") for k in range(1, 7)] + [("loop-a", "loop-b"), ("loop-b", "loop-a")]
    return graph.hierarchy(spark.createDataFrame(chain, "label string, parent string"))


ORACLES["ancestors_depth"] = f"WITH RECURSIVE {_CHAIN}, up AS (SELECT label, parent AS ancestor, 1 AS depth FROM chain UNION SELECT up.label, parent, depth + 1 FROM up JOIN chain ON chain.label = up.ancestor WHERE depth < 32) SELECT label, ancestor, min(depth)::INT AS depth FROM up WHERE label <> ancestor GROUP BY ALL"


@plan("propagated_labels")
def _(net: Network) -> DataFrame:
    return graph.propagate(net).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


ORACLES["propagated_labels"] = on_network("SELECT label, count(*) AS n FROM (SELECT model_id, label FROM model_anchors UNION ALL SELECT model_id, label FROM inh) GROUP BY label", *UP)


def _healed(net: Network) -> DataFrame:
    return net.facts.where("p_size % 10 = 0").select("model_id", F.array(F.lit("high-volume"), F.col("word1"), F.lit("red")).alias("labels"))


@plan("healed_changes", """SELECT model_id, array_to_string(list_sort(list_filter(list_distinct(['high-volume', 'red']), lambda x: NOT list_contains(own, x))), ',') AS added, array_to_string(list_sort(list_filter(['multi-supplier', 'return-prone'], lambda x: list_contains(own, x))), ',') AS removed
FROM (SELECT model_id, list(label) AS own FROM model_anchors WHERE model_id IN (SELECT model_id FROM facts WHERE p_size % 10 = 0) GROUP BY model_id) WHERE NOT list_contains(own, 'high-volume') OR NOT list_contains(own, 'red') OR list_contains(own, 'multi-supplier') OR list_contains(own, 'return-prone')""")
def _(net: Network) -> DataFrame:
    return records.anchor_changes(net.model_anchors, records.heal(net, _healed(net)))


@plan("ensured_anchors", "SELECT label, bank FROM anchors UNION ALL SELECT 'Novel', 'DOMAIN'")
def _(net: Network) -> DataFrame:
    wanted = net.models.sparkSession.createDataFrame([("Novel", "DOMAIN"), ("red", "QUALITY"), ("Novel", "QUALITY")], "label string, bank string")
    return records.ensure_anchors(net.anchors, wanted)[0].select("label", "bank")


@plan("select_summaries", "SELECT model_id, CASE WHEN p_size % 2 = 0 THEN 'smol' ELSE 'large' END AS tier, p_name || CASE WHEN p_size % 2 = 0 THEN ' s' ELSE ' l' END AS summary FROM facts WHERE p_size % 3 <> 0")
def _(net: Network) -> DataFrame:
    small = net.facts.where("p_size % 2 = 0").select("model_id", F.lit("smol").alias("tier"), F.concat("p_name", F.lit(" s")).alias("summary"))
    large = net.facts.select("model_id", F.lit("large").alias("tier"), F.concat("p_name", F.lit(" l")).alias("summary"))
    return records.select_summaries(small.union(large), net.facts.where("p_size % 3 = 0").select("model_id"), ("smol", "large"))


@plan("upper_medians", "SELECT p_type, downloads AS median, round(mean, 6) AS mean, n FROM (SELECT p_type, downloads, row_number() OVER (PARTITION BY p_type ORDER BY downloads) AS k, count(*) OVER (PARTITION BY p_type) AS n, avg(downloads) OVER (PARTITION BY p_type) AS mean FROM facts) WHERE k = n // 2 + 1")
def _(net: Network) -> DataFrame:
    return records.median_upper(net.facts, "downloads", ["p_type"])


@plan("finding_scores")
def _(net: Network) -> DataFrame:
    return records.finding_scores(net, records.audit_findings(net, _suggested(net)))


ORACLES["finding_scores"] = on_network("SELECT model_id, count(f.kind) AS findings, greatest(0.0, round(1 - 0.2::DOUBLE * count(f.kind), 6)) AS score FROM models LEFT JOIN findings f USING (model_id) GROUP BY model_id", _SUGGESTED, _FINDINGS)


@plan("efficiency_dissent", "SELECT * FROM (SELECT model_id, round(sqrt(pow(avg(cos((greatest(-4, least(4, path_sign * path_depth)) + 4) / 8.0::DOUBLE * pi())), 2) + pow(avg(sin((greatest(-4, least(4, path_sign * path_depth)) + 4) / 8.0::DOUBLE * pi())), 2)), 6) AS r FROM positions GROUP BY model_id HAVING count(*) >= 2) WHERE r < 0.95 ORDER BY r, model_id LIMIT 200")
def _(net: Network) -> DataFrame:
    return records.efficiency_dissent(net)


_STACKED = """stacked AS (SELECT model_id, CASE WHEN params_b < 0.5 THEN 'sub-1B' WHEN params_b < 1.5 THEN '1B-class' ELSE '3B-class' END AS label FROM facts UNION SELECT model_id, '70B-class' FROM facts WHERE p_size % 4 = 0 UNION SELECT model_id, 'sub-1B' FROM facts WHERE p_size % 6 = 0
UNION SELECT model_id, 'long-context-32k' FROM facts WHERE p_size % 3 = 0 UNION SELECT model_id, 'long-context-128k' FROM facts WHERE p_size % 5 = 0 UNION SELECT model_id, 'long-context-1m' FROM facts WHERE p_size % 7 = 0 UNION SELECT model_id, 'chat' FROM facts),
tier(label, family, k) AS (VALUES ('long-context-32k', 'context', 1), ('long-context-128k', 'context', 2), ('long-context-1m', 'context', 3), ('sub-1B', 'size', 1), ('1B-class', 'size', 2), ('3B-class', 'size', 3), ('7B-class', 'size', 4), ('13B-class', 'size', 5), ('30B-class', 'size', 6), ('70B-class', 'size', 7), ('frontier-class', 'size', 8))"""


@plan("scrub_tiers")
def _(net: Network) -> DataFrame:
    size = F.col("p_size")
    own = F.when(F.col("params_b") < 0.5, "sub-1B").when(F.col("params_b") < 1.5, "1B-class").otherwise("3B-class")
    more = [F.when(size % k == 0, label) for k, label in ((4, "70B-class"), (6, "sub-1B"), (3, "long-context-32k"), (5, "long-context-128k"), (7, "long-context-1m"))]
    labels = net.facts.select("model_id", F.explode(F.array(own, *more, F.lit("chat"))).alias("label")).where("label is not null")
    return records.keep_best_tier(labels, net.facts.select("model_id", F.when(size % 11 != 0, F.col("params_b")).alias("params_b")))


ORACLES["scrub_tiers"] = on_network("""SELECT model_id, label FROM stacked JOIN tier USING (label) JOIN facts USING (model_id) WHERE (family = 'context' AND k < (SELECT max(t.k) FROM stacked s JOIN tier t USING (label) WHERE s.model_id = facts.model_id AND t.family = 'context'))
OR (family = 'size' AND p_size % 11 <> 0 AND label <> CASE WHEN params_b < 0.5 THEN 'sub-1B' WHEN params_b < 1.5 THEN '1B-class' ELSE '3B-class' END) OR (family = 'size' AND p_size % 11 = 0 AND k < (SELECT max(t.k) FROM stacked s JOIN tier t USING (label) WHERE s.model_id = facts.model_id AND t.family = 'size'))""", _STACKED)


@plan("evaluation_checks")
def _(net: Network) -> DataFrame:
    return evaluate.evaluate(net)


@plan("evaluation_score")
def _(net: Network) -> DataFrame:
    return evaluate.score(evaluate.evaluate(net))


@plan("refinement_axes")
def _(net: Network) -> DataFrame:
    window = net.facts.orderBy(F.desc("downloads"), "model_id").limit(20).select("model_id")
    found = refine.guidance(net, FIRST, window)
    return net.models.sparkSession.createDataFrame([(a["bank"], float(a["variance"]), int(a["low"]), int(a["high"])) for a in found["axes"]], "bank string, variance double, low int, high int")


@plan("parsed_query", "SELECT model_id FROM positions WHERE bank = 'EFFICIENCY' AND path_sign * path_depth <= -1 INTERSECT SELECT model_id FROM positions WHERE bank = 'QUALITY' AND path_sign * path_depth >= 1")
def _(net: Network) -> DataFrame:
    from ..operators.filters import bank_range

    _, ranges = refine.parse("small popular parts")
    out = net.models.select("model_id")
    for bank, (low, high, _) in ranges.items():
        out = out.join(bank_range(net, bank, low, high), "model_id", "left_semi")
    return out


@plan("anchor_use_by_bank", "SELECT bank, count(*) AS labels, sum(n)::BIGINT AS uses, max(n) AS top FROM (SELECT a.bank, a.anchor_id, count(m.model_id) AS n FROM anchors a LEFT JOIN model_anchors m USING (anchor_id) GROUP BY ALL) GROUP BY bank")
def _(net: Network) -> DataFrame:
    return stats.anchor_counts(net).groupBy("bank").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("uses"), F.max("n").alias("top"))


@plan("search_text")
def _(net: Network) -> DataFrame:
    from ..atlas import Atlas

    return Atlas(net).search("small popular red widgets like p7")
