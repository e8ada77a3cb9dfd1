"""Corpus statistics over a network."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..schema import BANKS, STANDARD_SHARE


def network_stats(net: Network) -> DataFrame:
    """Counts by kind: tables, models by source, positions by bank."""
    def kind(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("kind"), F.lit("").alias("item"), "n")

    out = kind(net.models, "models").union(kind(net.anchors, "anchors")).union(kind(net.model_anchors, "model_anchors")).union(kind(net.links, "links"))
    by_source = net.models.groupBy("source").agg(F.count(F.lit(1)).alias("n")).select(F.lit("source").alias("kind"), F.col("source").alias("item"), "n")
    by_bank = net.positions.groupBy("bank").agg(F.count(F.lit(1)).alias("n")).select(F.lit("bank").alias("kind"), F.col("bank").alias("item"), "n")
    return out.union(by_source).union(by_bank)


def anchor_counts(net: Network) -> DataFrame:
    """Every label with the number of models that carry it, 0 for unused ones."""
    used = net.model_anchors.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n"))
    return net.anchors.join(used, "anchor_id", "left").select("anchor_id", "label", "bank", F.coalesce("n", F.lit(0)).alias("n"))


def idf(net: Network) -> DataFrame:
    """Inverse document frequency ln(models / max(uses, 1)) of each label."""
    total = net.models.count()
    counts = anchor_counts(net)
    if not total:
        return counts.where("false").select("label", "n", F.lit(0.0).alias("idf"))
    return counts.select("label", "n", F.log(F.lit(float(total)) / F.greatest(F.col("n"), F.lit(1))).alias("idf"))


def counts_over(net: Network, candidates: DataFrame) -> DataFrame:
    """How many candidates carry each label."""
    return net.model_anchors.join(candidates.select("model_id"), "model_id", "left_semi").groupBy("label").agg(F.count(F.lit(1)).alias("n_c"))


def pmi(net: Network, candidates: DataFrame) -> DataFrame:
    """Positive pointwise mutual information between labels and the candidate set."""
    c, total = candidates.count(), net.models.count()
    both = counts_over(net, candidates).join(anchor_counts(net).select("label", F.col("n").alias("n_g")), "label")
    scored = both.withColumn("pmi", F.log((F.col("n_c") / F.lit(float(max(c, 1)))) / (F.col("n_g") / F.lit(float(max(total, 1))))))
    return scored.where("pmi > 0")


def standards(net: Network, candidates: DataFrame, exclude: tuple[str, ...] = (), share: float = STANDARD_SHARE) -> DataFrame:
    """Labels that more than ``share`` of the candidates carry, without the excluded ones."""
    c = candidates.count()
    p = counts_over(net, candidates).withColumn("p", F.col("n_c") / F.lit(float(max(c, 1))))
    return p.where((F.col("p") > share) & ~F.col("label").isin(*exclude) if exclude else F.col("p") > share)


def null_coverage(net: Network) -> DataFrame:
    """Per bank the models with and without a coordinate, and the share without in percent."""
    total = net.models.count()
    banks = net.models.sparkSession.createDataFrame([(b,) for b in BANKS], "bank string")
    have = net.positions.groupBy("bank").agg(F.countDistinct("model_id").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return F.broadcast(banks).join(have, "bank", "left").select("bank", n.alias("present"), (F.lit(total) - n).alias("missing"), F.round(100.0 * (F.lit(total) - n) / F.lit(float(max(total, 1))), 2).alias("missing_pct"))


def bank_correlations(net: Network) -> DataFrame:
    """Pearson's r of signed depths for each pair of banks over models that have both; at least 3 models and some spread."""
    wide = net.positions.groupBy("model_id").agg(*[F.max(F.when(F.col("bank") == b, (F.col("path_sign") * F.col("path_depth")).cast("double"))).alias(b) for b in BANKS])
    rows = F.array(*[F.struct(F.lit(a).alias("bank_a"), F.lit(b).alias("bank_b"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in combinations(sorted(BANKS), 2)])
    pairs = wide.select(F.explode(rows).alias("r")).select("r.*").where("x is not null and y is not null")
    s = pairs.groupBy("bank_a", "bank_b").agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(a) for a, e in (("sx", F.col("x")), ("sy", F.col("y")), ("sxx", F.col("x") * F.col("x")), ("syy", F.col("y") * F.col("y")), ("sxy", F.col("x") * F.col("y")))])
    vx, vy, cov = F.expr("n * sxx - sx * sx"), F.expr("n * syy - sy * sy"), F.expr("n * sxy - sx * sy")
    return s.where((F.col("n") >= 3) & (vx > 0) & (vy > 0)).select("bank_a", "bank_b", "n", F.round(cov / F.sqrt(vx * vy), 4).alias("r"))


def orphan_anchors(net: Network) -> DataFrame:
    return net.anchors.join(net.model_anchors, "anchor_id", "left_anti").select("label", "bank")


def oversaturated(net: Network, pct: float = 30.0) -> DataFrame:
    """Labels that more than floor(models * pct / 100) models carry."""
    total = net.models.count()
    return anchor_counts(net).where(F.col("n") > int(total * pct / 100)).select("label", "n", F.round(F.col("n") / F.lit(float(max(total, 1))) * 100, 2).alias("share_pct"))


def bank_coverage(net: Network) -> DataFrame:
    """Per model and bank the number of labels and the highest confidence, zero for banks without labels."""
    every = net.models.select("model_id", F.explode(F.array(*[F.lit(b) for b in BANKS])).alias("bank"))
    have = net.model_anchors.groupBy("model_id", "bank").agg(F.count(F.lit(1)).alias("n"), F.max("confidence").alias("top"))
    return every.join(have, ["model_id", "bank"], "left").select("model_id", "bank", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("top", F.lit(0.0)).alias("top"))


def needs_enrichment(net: Network, least: int = 6, weak: float = 0.3) -> DataFrame:
    """Models with fewer than ``least`` covered banks, or a covered bank whose best confidence is under ``weak``."""
    per = net.model_anchors.groupBy("model_id", "bank").agg(F.max("confidence").alias("top")).groupBy("model_id").agg(F.count(F.lit(1)).alias("covered"), F.min("top").alias("weakest"))
    joined = net.models.join(per, "model_id", "left").select("model_id", F.coalesce("covered", F.lit(0)).alias("covered"), "weakest")
    return joined.withColumn("needs", (F.col("covered") < least) | (F.coalesce("weakest", F.lit(1.0)) < weak)).select("model_id", "covered", "needs")
