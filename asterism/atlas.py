"""One object with the tools of the engine: search, navigate, refine, detail, compare, build, stats, sources, annotate, status, evaluate, audit."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import vocabulary
from .network import Network
from .operators import certify, enrich, evaluate, filters, graph, hub, hub_rules, navigate, phases, records, refine, search, stats
from .schema import Query
from .sources import registry


@dataclass(frozen=True)
class Extraction:
    """What ``build`` makes of raw records: rows to upsert, verdicts on labels, metadata, benchmarks and hardware needs."""

    items: DataFrame
    verdicts: DataFrame
    metadata: DataFrame
    benchmarks: DataFrame
    hardware: DataFrame


def extract(raw: DataFrame, cards: DataFrame | None = None) -> Extraction:
    """Both tiers of extraction over raw records, certified by all rules; ``cards`` are (model_id, card).

    Labels of the deterministic tier are trusted: a rule against them warns. Records without an id are left out.
    """
    raw = raw.where("model_id is not null")
    sure = hub.architectures(raw).select("model_id", F.explode("labels").alias("label")).where("label <> 'unknown'").union(hub.config_labels(raw).select("model_id", "label")).select("model_id", "label", F.lit(1.0).alias("confidence"), F.lit(True).alias("trusted"))
    shown = hub.tier_two(raw).select("model_id", F.explode("labels").alias("x")).select("model_id", "x.label", "x.confidence", F.lit(False).alias("trusted"))
    both = sure.withColumn("tier", F.lit("deterministic")).union(shown.withColumn("tier", F.lit("pattern")))
    emissions = phases.first_wins(both, ("deterministic", "pattern")).drop("tier")
    none = raw.sparkSession.createDataFrame([], "model_id string, card string")
    benchmarks = enrich.benchmark_rows(cards if cards is not None else none, "model_id", "card")
    return Extraction(hub.canonical_items(raw), certify.verdicts_of(hub_rules.fired(raw), emissions), hub.metadata(raw), benchmarks, hub.hardware(raw))


class Atlas:
    """The tools over one network."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self.spark: SparkSession = net.models.sparkSession

    def search(self, text: str, limit: int = 20) -> DataFrame:
        """Models by a weighted sum of coordinates, labels, activation from "like X" and likeness of names to the words."""
        known = {r["label"].lower(): r["label"] for r in self.net.anchors.select("label").collect()}  # the closed vocabulary
        q, ranges = refine.parse(text, known | vocabulary.WORDS)
        spread = graph.spread(self.net, (q.similar_to,)) if q.similar_to else None
        return search.combined(self.net, ranges, q.prefer, search.fuzzy_scores(self.net, text), spread, limit)

    def navigate(self, q: Query) -> DataFrame:
        return navigate.navigate(self.net, q)

    def refine(self, q: Query, **changes: Any) -> tuple[Query, DataFrame, dict[str, Any]]:
        """A changed query, its answer, and what would sharpen it further."""
        changed = refine.refined(q, **changes)
        answer = self.navigate(changed)
        return changed, answer, refine.guidance(self.net, changed, answer.select("model_id"))

    def detail(self, model_id: str) -> DataFrame:
        return filters.entity(self.net, model_id)

    def compare(self, ids: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
        """What models share and differ in, and the mean of their pairs' likeness."""
        pairs = search.jaccard_pairs(self.net, ids)
        return search.compare(self.net, ids), pairs.agg(F.round(F.avg("jaccard"), 4).alias("mean_jaccard"))

    def build(self, raw: DataFrame, cards: DataFrame | None = None) -> Extraction:
        return extract(raw, cards)

    def stats(self) -> DataFrame:
        return stats.network_stats(self.net)

    def sources(self, wanted: list[str] | None = None, limit: int = 20) -> tuple[DataFrame, dict[str, str]]:
        """Records of the named sources, or of all, and the errors of those that failed."""
        return registry.federated(self.spark, registry.names() if wanted is None else wanted, limit)

    def annotate(self, model_id: str, summary: str, labels: tuple[str, ...] = ()) -> tuple[Network, list[str]]:
        """The network with a model's summary and labels (confidence 0.5), and the labels that the vocabulary lacks."""
        if not self.net.models.where(F.col("model_id") == model_id).limit(1).count():
            raise records.ContractError(f"no model {model_id}")
        row = self.spark.createDataFrame([(model_id, "vibe_summary", summary, "str")], "model_id string, key string, value string, value_type string")
        rest = self.net.metadata.where(~((F.col("model_id") == model_id) & (F.col("key") == "vibe_summary")))
        asked = self.spark.createDataFrame([(model_id, label) for label in dict.fromkeys(labels)], "model_id string, label string")
        known = asked.join(self.net.anchors.select("label", "anchor_id", "bank"), "label")
        fresh = known.join(self.net.model_anchors.select("model_id", "label"), ["model_id", "label"], "left_anti")
        added = self.net.model_anchors.select("model_id", "anchor_id", "label", "bank", "confidence").unionByName(fresh.select("model_id", "anchor_id", "label", "bank", F.lit(0.5).alias("confidence")))
        unknown = [r["label"] for r in asked.join(self.net.anchors.select("label"), "label", "left_anti").collect()]
        return Network(self.net.models, self.net.positions, self.net.anchors, added, self.net.links, rest.unionByName(row), self.net.facts), unknown

    def enrichment_status(self) -> DataFrame:
        return phases.web_status(self.net, self.net.metadata.where(F.col("key").startswith("benchmark:") | F.col("key").isin("web_summary", "vibe_summary")))

    def evaluate(self) -> DataFrame:
        return evaluate.score(evaluate.evaluate(self.net))

    def audit(self, suggested: DataFrame) -> dict[str, DataFrame]:
        """Disagreements with a second source of labels, and the shape of the corpus."""
        return {
            "findings": records.audit_findings(self.net, suggested), "null_coverage": stats.null_coverage(self.net), "correlations": stats.bank_correlations(self.net),
            "orphans": stats.orphan_anchors(self.net), "oversaturated": stats.oversaturated(self.net), "dissent": records.efficiency_dissent(self.net),
        }
