"""Certification of labels against declarative rules: trigger, required and forbidden labels, and a tier of severity."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..network import Network


@dataclass(frozen=True)
class Rule:
    """Tier 1 rejects what it forbids, tier 2 demotes it, tier 3 warns; missing required labels are added by tier 1."""

    name: str
    tier: int
    trigger: Callable[[], Column]
    requires: tuple[str, ...] = ()
    forbids: tuple[str, ...] = ()


#: Rules over the derived network's facts.
RULES = (
    Rule("tiny_is_small", 1, lambda: F.col("p_size") < 5, requires=("size-1",), forbids=("size-7", "size-6")),
    Rule("returns_doubt_popularity", 2, lambda: F.col("ret") > 0.4, forbids=("high-volume",)),
    Rule("few_suppliers", 1, lambda: F.col("n_supp") < 20, forbids=("multi-supplier",)),
    Rule("promo_lines", 3, lambda: F.col("p_type") == "PROMO", forbids=("return-prone",)),
    Rule("bulk_sellers", 1, lambda: F.col("downloads") > 900, requires=("high-volume",)),
    Rule("large_many", 2, lambda: (F.col("p_type") == "LARGE") & (F.col("n_supp") >= 30), forbids=("multi-supplier",)),
    Rule("economy_warn", 3, lambda: F.col("p_type") == "ECONOMY", forbids=("size-7",)),
)


def check_rules(rules: tuple[Rule, ...]) -> None:
    """Names differ, and no rule requires what it forbids."""
    if len({r.name for r in rules}) < len(rules) or any(set(r.requires) & set(r.forbids) for r in rules):
        raise ValueError("rules contradict themselves or share a name")


def fired_over(facts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Rows (model_id, rule, tier, requires, forbids) of the rules that rows of facts trigger."""
    check_rules(rules)
    made = F.array(*[F.when(r.trigger(), F.struct(F.lit(r.name).alias("rule"), F.lit(r.tier).alias("tier"), F.array(*map(F.lit, r.requires)).cast("array<string>").alias("requires"), F.array(*map(F.lit, r.forbids)).cast("array<string>").alias("forbids"))) for r in rules])
    return facts.select("model_id", F.explode(made).alias("r")).where("r is not null").select("model_id", "r.*")


def fired(net: Network, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (model_id, rule, tier, requires, forbids) of the rules that a model's facts trigger."""
    return fired_over(net.facts, rules)


def verdicts_of(on: DataFrame, emissions: DataFrame) -> DataFrame:
    """A verdict for each emission (model_id, label, confidence, trusted), and AUTO_ADDED rows for required labels that are missing.

    The most severe rule that forbids a label decides: REJECTED, but WARNING where the emission is trusted; DEMOTED (half
    the confidence); or WARNING. Others are CERTIFIED. A required label is added by rules of any tier, even if another
    rule forbids it.
    """
    worst = on.select("model_id", "tier", F.explode("forbids").alias("label")).groupBy("model_id", "label").agg(F.min("tier").alias("tier"))
    judged = emissions.join(worst, ["model_id", "label"], "left")
    verdict = F.when((F.col("tier") == 1) & ~F.col("trusted"), "REJECTED").when(F.col("tier") == 2, "DEMOTED").when(F.col("tier").isNotNull(), "WARNING").otherwise("CERTIFIED")
    kept = judged.select("model_id", "label", verdict.alias("verdict"), F.when(F.col("tier") == 2, F.col("confidence") * 0.5).otherwise(F.col("confidence")).alias("confidence"))
    wanted = on.select("model_id", F.explode("requires").alias("label")).distinct()
    added = wanted.join(emissions, ["model_id", "label"], "left_anti").select("model_id", "label", F.lit("AUTO_ADDED").alias("verdict"), F.lit(1.0).alias("confidence"))
    return kept.union(added)


def fired_numbers(rules: tuple[Rule, ...]) -> Column:
    """The numbers of the rules that a row of facts triggers."""
    check_rules(rules)
    return F.array_compact(F.array(*[F.when(r.trigger(), F.lit(k)) for k, r in enumerate(rules)]).cast("array<int>"))


def verdicts_by_model(fired: DataFrame, emitted: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The rows of ``verdicts_of``, from a row for each record: ``fired`` (model_id, fired: numbers of rules), ``emitted`` (model_id, labels: array of label, confidence, trusted).

    Records meet once, by model_id, with numbers instead of the rules' labels; nothing is joined, so nothing is broadcast
    on a guess of its size. As in a join, a model without an id meets no rule.
    """
    kind, numbers = "array<struct<label string, confidence double, trusted boolean>>", "array<int>"
    entry = lambda x: F.struct(x["label"].alias("label"), x["confidence"].cast("double").alias("confidence"), x["trusted"].alias("trusted"))
    rows = fired.select("model_id", F.col("fired").cast(numbers).alias("fired"), F.lit(None).cast(kind).alias("labels")).union(emitted.select("model_id", F.lit(None).cast(numbers), F.transform("labels", entry).cast(kind)))
    met = rows.groupBy("model_id").agg(F.array_distinct(F.flatten(F.collect_list("fired"))).alias("fired"), F.flatten(F.collect_list("labels")).alias("labels"))
    banned = {x: [k for k, r in enumerate(rules) if x in r.forbids] for x in sorted({x for r in rules for x in r.forbids})}
    tiers = F.array(*[F.lit(r.tier) for r in rules]).cast(numbers)
    banning = F.create_map(*[c for x, ks in banned.items() for c in (F.lit(x), F.array(*map(F.lit, ks)))]) if banned else F.create_map().cast(f"map<string,{numbers}>")
    requires = F.array(*[F.array(*map(F.lit, r.requires)).cast("array<string>") for r in rules]).cast("array<array<string>>")

    def judged(x: Column) -> Column:
        against = F.array_intersect(F.col("fired"), F.coalesce(F.try_element_at(banning, x["label"]), F.array().cast(numbers)))
        return F.struct(x.alias("x"), F.when(F.col("model_id").isNotNull(), F.array_min(F.transform(against, lambda k: F.get(tiers, k)))).alias("tier"))

    def verdict(j: Column) -> Column:
        tier, x = j["tier"], j["x"]
        name = F.when((tier == 1) & ~x["trusted"], "REJECTED").when(tier == 2, "DEMOTED").when(tier.isNotNull(), "WARNING").otherwise("CERTIFIED")
        return F.struct(x["label"].alias("label"), name.alias("verdict"), F.when(tier == 2, x["confidence"] * 0.5).otherwise(x["confidence"]).alias("confidence"))

    held = F.when(F.col("model_id").isNotNull(), F.transform("labels", lambda x: x["label"])).otherwise(F.array().cast("array<string>"))
    missing = F.array_except(F.flatten(F.transform("fired", lambda k: F.get(requires, k))), held)
    added = F.transform(missing, lambda x: F.struct(x.alias("label"), F.lit("AUTO_ADDED").alias("verdict"), F.lit(1.0).alias("confidence")))
    # outer, since a filter on the size of what is exploded would work it all out twice
    return met.select("model_id", F.explode_outer(F.concat(F.transform(F.transform("labels", judged), verdict), added)).alias("v")).where("v is not null").select("model_id", "v.*")


def certify(net: Network, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The verdicts on a network's labels."""
    return verdicts_of(fired(net, rules), net.model_anchors.select("model_id", "label", "confidence", F.lit(False).alias("trusted")))


def certification_score(verdicts: DataFrame) -> DataFrame:
    """1 less the share of rejected labels and half that of demoted ones, at least 0."""
    emitted = verdicts.where("verdict <> 'AUTO_ADDED'").groupBy("model_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "REJECTED").alias("drops"), F.count_if(F.col("verdict") == "DEMOTED").alias("demotes"))
    return emitted.select("model_id", "drops", "demotes", F.round(F.greatest(F.lit(0.0), 1 - (F.col("drops") + 0.5 * F.col("demotes")) / F.col("n")), 6).alias("score"))


def rule_hits(net: Network, rules: tuple[Rule, ...] = RULES, limit: int = 15) -> DataFrame:
    return fired(net, rules).groupBy("rule", "tier").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "rule").limit(limit)
