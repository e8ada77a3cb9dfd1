"""Selecting entities: by label, by coordinate, by several constraints at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..schema import Query


def signed() -> Column:
    return F.col("path_sign") * F.col("path_depth")


def entity(net: Network, model_id: str) -> DataFrame:
    """One row: the model with its coordinates, labels, links both ways and metadata."""
    me = net.models.where(F.col("model_id") == model_id)
    places = net.positions.where(F.col("model_id") == model_id).groupBy("model_id").agg(F.sort_array(F.collect_list(F.struct("bank", "path_sign", "path_depth"))).alias("positions"))
    labels = net.model_anchors.where(F.col("model_id") == model_id).groupBy("model_id").agg(F.sort_array(F.collect_list("label")).alias("labels"))
    out = net.links.where(F.col("source_id") == model_id).groupBy(F.col("source_id").alias("model_id")).agg(F.count(F.lit(1)).alias("links_out"))
    into = net.links.where(F.col("target_id") == model_id).groupBy(F.col("target_id").alias("model_id")).agg(F.count(F.lit(1)).alias("links_in"))
    facts = net.metadata.where(F.col("model_id") == model_id).groupBy("model_id").agg(F.sort_array(F.collect_list(F.concat_ws("=", "key", "value"))).alias("metadata"))
    return reduce(lambda a, b: a.join(b, "model_id", "left"), (places, labels, out, into, facts), me)


def by_anchor(net: Network, label: str) -> DataFrame:
    return net.model_anchors.where(F.col("label") == label).select("model_id").distinct()


def bank_range(net: Network, bank: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Models whose signed depth on a bank lies in a range, either end open."""
    v = signed()
    keep = F.col("bank") == bank
    if low is not None:
        keep &= v >= low
    if high is not None:
        keep &= v <= high
    return net.positions.where(keep).select("model_id", v.alias("position"))


def depth_floor(net: Network, bank: str, direction: int, least: int) -> DataFrame:
    """Models at least so deep in the direction."""
    return net.positions.where((F.col("bank") == bank) & (F.col("path_sign") == direction) & (F.col("path_depth") >= least)).select("model_id")


def depth_ceiling(net: Network, bank: str, direction: int, most: int) -> DataFrame:
    """Models at most so deep: on the direction's side, or on both sides and at zero for direction 0."""
    side = F.lit(True) if direction == 0 else F.col("path_sign") == direction
    return net.positions.where((F.col("bank") == bank) & side & (F.col("path_depth") <= most)).select("model_id")


def require_all(net: Network, labels: tuple[str, ...]) -> DataFrame:
    """Models that carry every label; a label that nobody knows leaves none."""
    wanted = tuple(dict.fromkeys(labels))
    held = net.model_anchors.where(F.col("label").isin(*wanted)).groupBy("model_id").agg(F.countDistinct("label").alias("n"))
    return held.where(F.col("n") == len(wanted)).select("model_id")


def candidates(net: Network, q: Query) -> DataFrame:
    """Models that pass the hard constraints: required labels, depth floors and ceilings."""
    out = net.models.select("model_id")
    if q.require:
        out = out.join(require_all(net, q.require), "model_id", "left_semi")
    for bank, least in q.min_depth.items():
        if q.directions.get(bank):
            out = out.join(depth_floor(net, bank, q.directions[bank], least), "model_id", "left_semi")
    for bank, most in q.max_depth.items():
        if bank in q.directions:
            out = out.join(depth_ceiling(net, bank, q.directions[bank], most), "model_id", "left_semi")
    return out


def missing_key(net: Network, key: str, min_likes: int = 0) -> DataFrame:
    """Models without a metadata key, popular enough, most liked first in ``priority``."""
    likes = net.metadata.where(F.col("key") == "likes").select("model_id", F.col("value").try_cast("bigint").alias("likes"))
    have = net.metadata.where(F.col("key") == key).select("model_id")
    return net.models.join(likes, "model_id").where(F.col("likes") >= min_likes).join(have, "model_id", "left_anti").select("model_id", "likes")


def priority(net: Network, min_downloads: float, limit: int) -> DataFrame:
    """A work list: much-downloaded models first by downloads, then the others by likes."""
    band = (F.col("downloads") < min_downloads).cast("int")
    rank = F.when(band == 0, F.col("downloads")).otherwise(F.col("likes").cast("double"))
    return net.facts.select("model_id", band.alias("band"), rank.alias("key")).orderBy("band", F.desc("key"), "model_id").limit(limit)


def alias_form(text: Column) -> Column:
    """The normal form for alias look-up: trimmed, lower case, without blanks, hyphens, underscores and dots."""
    return F.translate(F.lower(F.trim(text)), " -_.", "")


def resolve_aliases(mentions: DataFrame, net: Network) -> DataFrame:
    """Mentions with the label they stand for: same ignoring case, else of the same normal form, else themselves."""
    known = net.anchors.groupBy(F.lower("label").alias("low")).agg(F.min("label").alias("by_case"))
    loose = net.anchors.groupBy(alias_form(F.col("label")).alias("form")).agg(F.min("label").alias("by_form"))
    keyed = mentions.select("mention", F.lower("mention").alias("low"), alias_form(F.col("mention")).alias("form"))
    found = keyed.join(known, "low", "left").join(loose, "form", "left")
    return found.select("mention", F.coalesce("by_case", "by_form", "mention").alias("label"), (F.coalesce("by_case", "by_form").isNotNull()).alias("known"))
