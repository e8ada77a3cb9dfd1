"""Weighted-sum search, similarity and comparison."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.fuzzy import token_set_ratio
from ..functions.text import STOP_WORDS
from ..network import Network
from .filters import signed

#: Shares of coordinates, labels, activation and names in the combined score. Fixed values.
SHARES = (0.30, 0.35, 0.15, 0.20)


def score_constraint(position: Column, low: int | None = None, high: int | None = None, direction: int | None = None) -> Column:
    """1 inside the range (or on the direction's side), else falling off with the distance; 0.5 without a constraint."""
    if low is not None and high is not None:
        return F.when((position >= low) & (position <= high), 1.0).otherwise(1.0 / (1.0 + F.least(F.abs(position - low), F.abs(position - high))))
    if low is not None:
        return F.when(position >= low, 1.0).otherwise(1.0 / (1.0 + (low - position)))
    if high is not None:
        return F.when(position <= high, 1.0).otherwise(1.0 / (1.0 + (position - high)))
    if direction is not None:
        if direction == 0:
            return 1.0 / (1.0 + F.abs(position))
        return F.when(position * direction > 0, 1.0).otherwise(1.0 / (1.0 + F.abs(position - direction)))
    return F.lit(0.5)


def confidence_jaccard(net: Network, targets: tuple[str, ...]) -> DataFrame:
    """Per model the confidence of shared labels over that of all its labels plus 1 for each wanted one it lacks."""
    wanted = tuple(dict.fromkeys(targets))
    hit = F.col("label").isin(*wanted)
    agg = net.model_anchors.groupBy("model_id").agg(F.sum(F.when(hit, F.col("confidence")).otherwise(0.0)).alias("hit"), F.sum("confidence").alias("all"), F.sum(hit.cast("int")).alias("n"))
    return agg.select("model_id", (F.col("hit") / (F.col("all") + (len(wanted) - F.col("n")))).alias("similarity"))


def combined(net: Network, constraints: dict[str, tuple[int | None, int | None, int | None]], hints: tuple[str, ...], fuzzy: DataFrame | None = None, spread: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Models by a weighted sum of coordinate fit, label fit, activation and name likeness."""
    banks = [*constraints]
    rows = net.models.select("model_id")
    if banks:
        wide = net.positions.where(F.col("bank").isin(*banks)).groupBy("model_id").agg(*[F.max(F.when(F.col("bank") == b, signed())).alias(b) for b in banks])
        parts = [score_constraint(F.coalesce(F.col(b), F.lit(0)), *constraints[b]) for b in banks]
        rows = rows.join(wide, "model_id", "left").select("model_id", (reduce(lambda a, b: a + b, parts) / len(parts)).alias("bank_score"))
    else:
        rows = rows.withColumn("bank_score", F.lit(0.5))
    labels = confidence_jaccard(net, hints) if hints else net.model_anchors.groupBy("model_id").agg(F.least(F.count(F.lit(1)) / 50.0, F.lit(1.0)).alias("similarity"))
    rows = rows.join(labels, "model_id", "left").withColumn("anchor_score", F.coalesce("similarity", F.lit(0.0))).drop("similarity")
    for name, given in (("spread_score", spread), ("fuzzy_score", fuzzy)):
        rows = rows.join(given.select("model_id", F.col("score").alias(name)), "model_id", "left").withColumn(name, F.coalesce(name, F.lit(0.0))) if given is not None else rows.withColumn(name, F.lit(0.0))
    total = reduce(lambda a, b: a + b, [F.col(c) * w for c, w in zip(("bank_score", "anchor_score", "spread_score", "fuzzy_score"), SHARES)])
    return rows.withColumn("score", F.round(total, 6)).orderBy(F.desc("score"), "model_id").limit(limit)


def similar_to(net: Network, model_id: str, limit: int = 10) -> DataFrame:
    """Models by Jaccard likeness of labels to a given one, with the number of shared labels."""
    mine = net.model_anchors.where(F.col("model_id") == model_id).select("anchor_id").distinct()
    n = mine.count()
    sizes = net.model_anchors.groupBy("model_id").agg(F.count(F.lit(1)).alias("size"))
    shared = net.model_anchors.where(F.col("model_id") != model_id).join(F.broadcast(mine), "anchor_id").groupBy("model_id").agg(F.count(F.lit(1)).alias("shared"))  # one model's labels
    scored = shared.join(sizes, "model_id").select("model_id", "shared", F.round(F.col("shared") / (F.lit(n) + F.col("size") - F.col("shared")), 6).alias("similarity"))
    return scored.orderBy(F.desc("similarity"), "model_id").limit(limit)


def jaccard_pairs(net: Network, ids: tuple[str, ...]) -> DataFrame:
    """Jaccard likeness of each pair of the given models."""
    held = net.model_anchors.where(F.col("model_id").isin(*ids)).groupBy("model_id").agg(F.collect_set("label").alias("labels"))
    a, b = held.select(F.lit(1).alias("k"), F.col("model_id").alias("a"), F.col("labels").alias("la")), held.select(F.lit(1).alias("k"), F.col("model_id").alias("b"), F.col("labels").alias("lb"))
    pairs = a.join(b, "k").where("a < b")  # a handful of named models
    return pairs.select("a", "b", F.round(F.size(F.array_intersect("la", "lb")) / F.size(F.array_union("la", "lb")), 6).alias("jaccard"))


def compare(net: Network, ids: tuple[str, ...]) -> DataFrame:
    """What named models share and differ in: labels by kind (shared, unique) and coordinate differences by bank."""
    held = net.model_anchors.where(F.col("model_id").isin(*ids)).groupBy("label").agg(F.collect_set("model_id").alias("m"))
    shared = held.where(F.size("m") == len(ids)).select(F.lit("shared").alias("kind"), F.lit("").alias("model_id"), F.col("label").alias("item"), F.lit(0).alias("value"))
    unique = held.where(F.size("m") < len(ids)).select(F.lit("unique").alias("kind"), F.explode("m").alias("model_id"), F.col("label").alias("item"), F.lit(0).alias("value"))
    at = net.positions.where(F.col("model_id").isin(*ids)).select(F.lit("bank").alias("kind"), "model_id", F.col("bank").alias("item"), signed().alias("value"))
    return shared.union(unique).union(at)


def fuzzy_scores(net: Network, text: str) -> DataFrame:
    """Likeness of models to the words of a text: mean over words of the best field, with a bonus for contained words; each pair of a word and a different field is rated once."""
    tokens = sorted({t for t in re.findall("[a-z0-9_.-]+", text.lower()) if len(t) > 1 and t not in STOP_WORDS})
    if not tokens:
        return net.models.select("model_id", F.lit(0.0).alias("score")).where("false")
    fields = searchable_strings(net)
    each = fields.select("field").distinct().withColumn("token", F.explode(F.array(*map(F.lit, tokens))))
    rated = each.withColumn("score", token_set_ratio(F.array("field"), F.col("token")))
    best = fields.join(rated, "field").groupBy("model_id", "token").agg(F.max("score").alias("score"))
    scored = best.groupBy("model_id").agg((F.sum("score") / len(tokens)).alias("score"))
    return scored.where("score > 0").select("model_id", F.round("score", 6).alias("score"))


def searchable_strings(net: Network) -> DataFrame:
    """(model_id, field): the texts of a model that a search looks at: words of its id, name, author, labels, and its summary's start."""
    parts = lambda c: F.lower(F.array_join(F.regexp_extract_all(c, F.lit("([a-zA-Z0-9]+)"), 1), " "))
    named = net.models.select("model_id", F.explode(F.array(parts(F.col("model_id")), F.lower("display_name"), F.lower("author"))).alias("field"))
    summary = net.metadata.where("key = 'vibe_summary'").select("model_id", F.lower(F.substring("value", 1, 500)).alias("field"))
    return named.union(summary).where("field <> ''").distinct()


def banks_of(net: Network, model_id: str) -> DataFrame:
    return net.positions.where(F.col("model_id") == model_id).select("bank", signed().alias("position")).where(F.col("bank").isin(*S.BANKS))
