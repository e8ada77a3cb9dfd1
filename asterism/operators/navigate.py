"""The flagship: navigational ranking of entities by seven multiplied factors.

A profile of each model holds all that a query scores and is stored with the network. A query filters profiles by its hard
constraints and scores them in one pass, without joins; totals over labels are driver-side constants. The top rows are
taken by score and id, and only that window is re-ranked for diversity and marked with tie clusters.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache, reduce
from operator import mul

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .. import schema as S
from ..network import Network, stored
from ..schema import Query
from . import graph, stats

#: Share of mechanical meaning by bank; the rest is semantic. Fixed values.
MECHANICAL = {"EFFICIENCY": 1.0, "COMPATIBILITY": 1.0, "LINEAGE": 1.0, "ARCHITECTURE": 0.5, "CAPABILITY": 0.0, "DOMAIN": 0.0, "QUALITY": 0.0, "TRAINING": 0.0}

#: Signal weights by mode: PMI, rarity, absence, joint, centrality, and the relevance share of re-ranking. Fixed values.
MODES = {
    "canonical": (0.10, 0.10, 0.10, 0.10, 0.30, 0.9),
    "niche": (0.40, 0.50, 0.40, 0.30, 0.05, 0.5),
    "balanced": (0.25, 0.25, 0.25, 0.20, 0.20, 0.7),
}


@dataclass(frozen=True)
class Weights:
    pmi: float
    rare: float
    absence: float
    joint: float
    centrality: float
    relevance: float


def mode_weights(mode: str, mechanical: float) -> Weights:
    """Weights of a mode; ``auto`` moves linearly with the semantic share of the query."""
    if mode in MODES:
        return Weights(*MODES[mode])
    s = 1.0 - mechanical
    return Weights(0.20 + 0.20 * s, 0.20 + 0.30 * s, 0.15 + 0.25 * s, 0.15 + 0.15 * s, 0.20 + 0.20 * mechanical, 0.85 - 0.35 * s)


def bank_exponents(directions: dict[str, int], weights: dict[str, float] | None) -> dict[str, float]:
    """Exponents by bank: weights scaled so that the active ones sum to their number; all 1 without weights."""
    if not weights or not directions:
        return dict.fromkeys(directions, 1.0)
    raw = {b: max(0.0, float(weights.get(b, 1.0))) for b in directions}
    active = [w for w in raw.values() if w > 0]
    if not active:
        return dict.fromkeys(directions, 1.0)
    return {b: w * len(active) / sum(active) for b, w in raw.items()}


def bank_score(position: Column, direction: int) -> Column:
    """How well a signed position suits a direction; an unknown position gets the missing penalty."""
    if direction == 0:
        known = 1.0 / (1.0 + F.abs(position))
    else:
        along = position * direction
        known = F.when(along > 0, 1.0).when(along == 0, 0.5).otherwise(S.OPPOSED_BANK)
    return F.when(position.isNull(), F.lit(S.MISSING_BANK)).otherwise(known)


def bank_alignment(directions: dict[str, int], weights: dict[str, float] | None = None) -> Column:
    """Product over the asked banks, whose positions are columns named by bank."""
    exponents = bank_exponents(directions, weights)
    parts = [F.pow(bank_score(F.col(b), d), F.lit(exponents[b])) if exponents[b] != 1.0 else bank_score(F.col(b), d) for b, d in directions.items() if exponents[b] > 0]
    return reduce(mul, parts, F.lit(1.0))


def epa_alignment(vibe: tuple[float | None, float | None, float | None]) -> Column:
    """Halves with every 0.6 of distance on an asked axis; neutral without a full reading."""
    parts = [F.pow(F.lit(0.5), F.abs(F.col(c) - t) / S.EPA_HALF_LIFE) for c, t in zip(("vibe_e", "vibe_p", "vibe_a"), vibe) if t is not None]
    if not parts:
        return F.lit(1.0)
    full = F.col("vibe_e").isNotNull() & F.col("vibe_p").isNotNull() & F.col("vibe_a").isNotNull()
    return F.when(full, reduce(mul, parts)).otherwise(1.0)


def submodular(signals: list[Column], decay: float = S.SUBMODULAR_DECAY) -> Column:
    """1 plus the signals in descending order, each worth ``decay`` times the rank before."""
    ordered = F.sort_array(F.array(*signals), asc=False)
    return F.lit(1.0) + sum((F.element_at(ordered, k + 1) * decay**k for k in range(len(signals))), F.lit(0.0))


def centrality(scored: DataFrame, column: str = "pagerank") -> DataFrame:
    """``pr_frac``: dense rank among the different positive values, scaled to 0..1; 0 with fewer than two of them.

    The different values are dealt by ranges and numbered within, so no task sees them all; only a count for each range
    comes to the driver.
    """
    spark = scored.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = scored.where(F.col(column) > 0).select(F.col(column).alias("__v")).distinct().repartitionByRange(ranges, "__v").withColumn("__range", F.spark_partition_id())
    numbered = stored(values.withColumn("__k", F.row_number().over(Window.partitionBy("__range").orderBy("__v")) - 1), "centrality")
    before, shifts = 0, {}
    for r in sorted(numbered.groupBy("__range").agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: r["__range"]):
        shifts[r["__range"]], before = before, before + r["n"]
    if before < 2:
        return scored.withColumn("pr_frac", F.lit(0.0))
    shift = F.create_map(*[F.lit(x) for pair in shifts.items() for x in pair])
    fraction = numbered.select("__v", ((F.col("__k") + F.element_at(shift, F.col("__range"))) / float(before - 1)).alias("pr_frac"))
    return scored.join(fraction, F.col(column) == F.col("__v"), "left").drop("__v").withColumn("pr_frac", F.coalesce("pr_frac", F.lit(0.0)))


@lru_cache(maxsize=16)
def profile(net: Network) -> DataFrame:
    """A row per model with all that a query scores: positions by bank, labels, coherence, affect, PageRank and its percentile.

    Stored once for a network, which doesn't change, so a query is a scan of a few of its columns. A model's labels are of
    the closed vocabulary, so its array is bounded.
    """
    places = net.positions.groupBy("model_id").agg(*[F.max(F.when(F.col("bank") == b, F.col(f"path_{part}"))).alias(f"{b}_{part}") for b in S.BANKS for part in ("sign", "depth")])
    labels = net.model_anchors.groupBy("model_id").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    ranks = graph.stored_pagerank(net).select("model_id", F.col("value").cast("double").alias("pagerank"))
    facts = net.facts.select("model_id", F.coalesce("certification", F.lit(1.0)).alias("coherence"), "vibe_e", "vibe_p", "vibe_a")
    rows = reduce(lambda a, b: a.join(b, "model_id", "left"), (places, labels, facts, ranks), net.models.select("model_id"))
    rows = rows.withColumns({"labels": F.coalesce("labels", F.array().cast("array<string>")), "pagerank": F.coalesce("pagerank", F.lit(0.0)), "coherence": F.coalesce("coherence", F.lit(1.0))})
    return stored(centrality(stored(rows, "profile-rows")), "profile")


@lru_cache(maxsize=16)
def usage(net: Network) -> tuple[int, tuple[tuple[str, str, int], ...]]:
    """How many models there are, and (label, bank, models with it) for each label of the closed vocabulary."""
    total = net.models.count()
    uses = net.model_anchors.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    rows = net.anchors.select("label", "bank").join(uses, "label", "left").na.fill(0, ["n"]).collect()
    return total, tuple((r["label"], r["bank"], r["n"]) for r in rows)


def hard(q: Query) -> Column:
    """The constraints on a profile that leave a model out: required labels, depth floors and ceilings."""
    out = F.lit(True)
    for label in dict.fromkeys(q.require):
        out = out & F.array_contains("labels", label)
    for bank, least in q.min_depth.items():
        if d := q.directions.get(bank):
            out = out & F.coalesce((F.col(f"{bank}_sign") == d) & (F.col(f"{bank}_depth") >= least), F.lit(False))
    for bank, most in q.max_depth.items():
        if bank in q.directions:
            side = F.lit(True) if q.directions[bank] == 0 else F.col(f"{bank}_sign") == q.directions[bank]
            out = out & F.coalesce(side & (F.col(f"{bank}_depth") <= most), F.lit(False))
    return out


def mechanical_fraction(q: Query, idf: dict[str, float], bank_of: dict[str, str]) -> float:
    """The mechanical share of a query: asked banks at weight 1, required and preferred labels at their idf; 0.5 without any."""
    parts = [(MECHANICAL.get(b, 0.5), 1.0) for b in q.directions]
    parts += [(MECHANICAL.get(bank_of.get(a, ""), 0.5), idf.get(a, 0.0)) for a in {*q.require, *q.prefer}]
    mass = sum(w for _, w in parts)
    return sum(m * w for m, w in parts) / mass if mass > 0 else 0.5


def scored(net: Network, q: Query) -> DataFrame:
    """Every candidate with its factors and score, without an order: one pass over the profiles, without a shuffle.

    Constants come from label counts, which the vocabulary bounds; with hard constraints a job counts the candidates'
    labels, and their percentiles are taken among themselves.
    """
    rows, (total_models, uses) = profile(net), usage(net)
    constrained = bool(q.require or q.min_depth or q.max_depth)
    if constrained:
        rows = rows.where(hard(q))
        counted = rows.select("model_id", F.explode(F.concat(F.array(F.lit(None).cast("string")), "labels")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()
        within = {r["label"]: r["n"] for r in counted}
        c = within.pop(None, 0)
        rows = centrality(rows.drop("pr_frac"))
    else:
        within, c = {label: n for label, _, n in uses}, total_models
    idf = {label: math.log(total_models / max(n, 1)) for label, _, n in uses} if total_models else {}
    everywhere = {label: n for label, _, n in uses}
    seed = (profile(net).where(F.col("model_id") == q.similar_to).select("labels").first() or [[]])[0] if q.similar_to else []
    share = {label: n / c for label, n in within.items() if n} if c else {}
    gain = {label: math.log(p / (everywhere[label] / total_models)) for label, p in share.items()}
    positive = {a: gain[a] for a in q.prefer if gain.get(a, 0.0) > 0}
    typical = {a: p for a, p in share.items() if p > S.STANDARD_SHARE and a not in q.require}
    weights = mode_weights(q.mode, mechanical_fraction(q, idf, {label: bank for label, bank, _ in uses}))

    total = lambda labels, of: sum(of.get(a, 0.0) for a in sorted(labels))
    held = lambda labels, of: reduce(lambda acc, a: acc + F.when(F.array_contains("labels", a), F.lit(float(of.get(a, 0.0)))).otherwise(0.0), sorted(labels), F.lit(0.0))
    surprise = {a: -math.log(p) for a, p in typical.items()}
    rows = rows.withColumns({"prefer_idf": held(set(q.prefer), idf), "context_idf": held(set(q.context), idf), "prefer_pmi": held(set(q.prefer), positive), "known": held(set(surprise), surprise), "seed_idf": held(set(seed), idf), "avoided": held(set(q.avoid), dict.fromkeys(q.avoid, 1.0))})
    rows = rows.withColumns({b: F.col(f"{b}_sign") * F.col(f"{b}_depth") for b in q.directions})
    if seed:
        weighed = F.create_map(*[F.lit(x) for pair in idf.items() for x in pair])  # the closed vocabulary
        rows = rows.withColumn("all_idf", F.aggregate("labels", F.lit(0.0), lambda acc, a: acc + F.coalesce(F.element_at(weighed, a), F.lit(0.0))))

    prefer_total, context_total, pmi_total, absent_total, seed_total = total(q.prefer, idf), total(q.context, idf), total(q.prefer, positive), sum(surprise.values()), total(seed, idf)
    relevance = (F.col("prefer_idf") / prefer_total if prefer_total > 0 else F.lit(1.0)) * F.pow(F.lit(S.AVOID_DECAY), F.col("avoided"))
    bias = 1.0 + S.CONTEXT_BOOST * F.col("context_idf") / context_total if context_total > 0 else F.lit(1.0)
    union = F.lit(seed_total) + F.col("all_idf") - F.col("seed_idf") if seed else None
    likeness = F.when(union == 0, 0.0).otherwise(F.col("seed_idf") / union) if seed else F.lit(1.0)
    rare = F.col("prefer_pmi") / pmi_total if pmi_total > 0 else F.lit(0.0)
    absent = (F.lit(absent_total) - F.col("known")) / (absent_total or 1.0)
    rows = rows.withColumns({
        "bank_alignment": bank_alignment(q.directions, q.bank_weights), "anchor_relevance": relevance, "seed_similarity": likeness,
        "context_bias": bias, "epa_alignment": epa_alignment(q.vibe), "rare": rare, "absence": absent,
    })
    soft = submodular([weights.centrality * F.col("pr_frac"), weights.pmi * F.col("rare"), weights.rare * F.col("rare"), weights.absence * F.col("absence"), weights.joint * F.col("pr_frac") * F.col("rare")])
    factors = ["bank_alignment", "anchor_relevance", "seed_similarity", "coherence", "context_bias", "epa_alignment", "soft_combined"]
    rows = rows.withColumn("soft_combined", soft)
    return rows.withColumn("score", reduce(mul, [F.col(f) for f in factors])).select("model_id", *factors, "score", "labels")


def top(rows: DataFrame, limit: int) -> DataFrame:
    """The best rows by the score to 9 places, then id."""
    return rows.withColumn("__s", F.round("score", 9)).orderBy(F.desc("__s"), "model_id").limit(limit).drop("__s")


def rerank(rows: list[tuple[str, float, frozenset[str]]], relevance: float) -> list[int]:
    """Greedy maximal marginal relevance over (id, score, labels) in order of score: the places in their new order."""
    pool, out = list(range(len(rows))), []
    while pool:
        def gain(k: int) -> float:
            score, labels = rows[k][1], rows[k][2]
            alike = max((len(labels & rows[o][2]) / len(labels | rows[o][2]) for o in out if labels and rows[o][2]), default=0.0)
            return relevance * score - (1 - relevance) * alike * score if out else score

        best = max(pool, key=lambda k: (gain(k), -pool.index(k)))
        pool.remove(best)
        out.append(best)
    return out


def tie_clusters(ordered: DataFrame, gap: float = S.TIE_GAP, most: int = S.TIE_LIMIT) -> DataFrame:
    """(pos, score) rows with ``cluster``: runs whose neighbours differ by less than ``gap``, cut after ``most``, of two rows at least; else null.

    The rows are a result window, so one ordered window holds them.
    """
    by = Window.orderBy("pos")
    fresh = F.coalesce((F.lag("score").over(by) - F.col("score") >= gap), F.lit(True))
    runs = ordered.withColumn("start", F.max(F.when(fresh, F.col("pos"))).over(by)).withColumn("part", F.floor((F.col("pos") - F.col("start")) / most))
    size = F.count(F.lit(1)).over(Window.partitionBy("start", "part"))
    kept = runs.withColumn("size", size)
    number = F.dense_rank().over(Window.orderBy((F.col("size") < 2).cast("int"), "start", "part")) - 1
    return kept.withColumn("cluster", F.when(F.col("size") >= 2, number)).drop("start", "part", "size")


def clusters(scores: list[float], gap: float = S.TIE_GAP, most: int = S.TIE_LIMIT) -> list[int | None]:
    """``tie_clusters`` for the scores of a window in its order."""
    out: list[int | None] = [None] * len(scores)
    at = number = 0
    while at < len(scores):
        end = at + 1
        while end < len(scores) and end - at < most and scores[end - 1] - scores[end] < gap:
            end += 1
        if end - at > 1:
            out[at:end] = [number] * (end - at)
            number += 1
        at = end
    return out


def navigate(net: Network, q: Query) -> DataFrame:
    """The ranked answer: top candidates, re-ranked for diversity within the window, with tie clusters.

    The window has at most ``limit`` rows and is re-ranked on the driver.
    """
    window = top(scored(net, q), q.limit).collect()
    _, uses = usage(net)
    n = usage(net)[0]
    idf = {label: math.log(n / max(k, 1)) for label, _, k in uses} if n else {}
    weights = mode_weights(q.mode, mechanical_fraction(q, idf, {label: bank for label, bank, _ in uses}))
    order = [window[k] for k in rerank([(r["model_id"], r["score"], frozenset(r["labels"])) for r in window], weights.relevance)]
    ties = clusters([r["score"] for r in order])
    rows = [(k, r["model_id"], float(r["score"]), float(r["bank_alignment"]), float(r["anchor_relevance"]), list(r["labels"]), tie) for k, (r, tie) in enumerate(zip(order, ties))]
    return net.models.sparkSession.createDataFrame(rows, "pos int, model_id string, score double, bank_alignment double, anchor_relevance double, labels array<string>, cluster int")


def discriminating_axis(net: Network, groups: DataFrame) -> DataFrame:
    """Per group of (grp, model_id) the bank whose coordinates vary most, absent ones as 0; ties to the smaller name."""
    members = groups.withColumn("bank", F.explode(F.array(*[F.lit(b) for b in S.BANKS])))
    v = (F.col("path_sign") * (1 + F.col("path_depth"))).cast("double")
    spread = members.join(net.positions.select("model_id", "bank", v.alias("v")), ["model_id", "bank"], "left").groupBy("grp", "bank").agg(F.var_pop(F.coalesce("v", F.lit(0.0))).alias("variance"))
    best = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc(F.round("variance", 9)), "bank"))
    return spread.withColumn("k", best).where((F.col("k") == 1) & (F.col("variance") > 0)).select("grp", "bank", F.round("variance", 6).alias("variance"))


def axis_hints(net: Network, window: DataFrame, asked: list[str]) -> DataFrame:
    """Banks that the query left open, with their spread over the window: variance, lowest, highest and number of positions."""
    v = F.coalesce(F.col("path_sign") * (1 + F.col("path_depth")), F.lit(0))
    members = window.select("model_id").withColumn("bank", F.explode(F.array(*[F.lit(b) for b in S.BANKS if b not in asked])))
    joined = members.join(net.positions, ["model_id", "bank"], "left").withColumn("v", v)
    return joined.groupBy("bank").agg(F.round(F.var_pop(F.col("v").cast("double")), 6).alias("variance"), F.min("v").alias("low"), F.max("v").alias("high"), F.countDistinct("v").alias("positions")).where("variance > 0")


def anchor_hints(net: Network, window: DataFrame, limit: int = 5) -> DataFrame:
    """Labels that split the window best: carriers times non-carriers times idf, universal ones left out."""
    n = window.count()
    held = net.model_anchors.join(window.select("model_id"), "model_id", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("c"))
    weight = F.when(F.col("idf") > 0, F.col("idf")).otherwise(1.0)
    rated = held.where(F.col("c") < n).join(stats.idf(net).select("label", "idf"), "label").select("label", "c", F.round(F.col("c") * (n - F.col("c")) * weight, 6).alias("balance"))
    return rated.orderBy(F.desc("balance"), "label").limit(limit)
