"""Graph operators over typed links and shared labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..network import Network, stored

#: Relation constants of activation. Fixed values.
LINK_WEIGHTS = {"fine_tuned_from": 0.9, "merged_from": 0.85, "quantized_from": 0.85, "variant_of": 0.8, "same_family": 0.7, "predecessor": 0.6, "successor": 0.6}


def pagerank(net: Network, damping: float = 0.85, iterations: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """PageRank over the lineage links until the ranks move by less than ``tolerance`` in sum; dangling mass goes to all nodes.

    Shares of a sender sum to 1, so the dangling mass is what no one receives. Each round is written, which cuts lineage
    and leaves the driver two sums.
    """
    edges = net.links.where(F.col("relation").isin(*S.LINEAGE_RELATIONS)).select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), F.col("weight").cast("double").alias("w"))
    out = edges.groupBy("src").agg(F.sum("w").alias("total"))
    edges = stored(edges.join(out, "src").select("src", "dst", (F.col("w") / F.col("total")).alias("share")), "pr-edges")
    nodes = stored(edges.select(F.col("src").alias("model_id")).union(edges.select("dst")).distinct(), "pr-nodes")
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    ranks = nodes.withColumn("rank", F.lit(1.0 / n))
    for turn in range(1, iterations + 1):
        arriving = edges.join(ranks.select(F.col("model_id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("model_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        got = stored(ranks.join(arriving, "model_id", "left").select("model_id", F.col("rank").alias("last"), F.coalesce("got", F.lit(0.0)).alias("got")), f"pr-{turn}")
        base = (1 - damping) / n + damping * (1.0 - (got.agg(F.sum("got")).first()[0] or 0.0)) / n
        moved = got.select("model_id", "last", (F.lit(base) + damping * F.col("got")).alias("rank"))
        ranks = moved.drop("last")
        if moved.agg(F.sum(F.abs(F.col("rank") - F.col("last")))).first()[0] < tolerance:
            break
    return ranks


def stored_pagerank(net: Network, iterations: int = 20) -> DataFrame:
    """Metadata rows (model_id, key, value, value_type) of PageRank to eight decimals; ranks below that have none."""
    ranks = pagerank(net, iterations=iterations, tolerance=0.0).where(F.col("rank") >= 1e-8)
    return ranks.select("model_id", F.lit("pagerank").alias("key"), F.format_string("%.8f", F.round("rank", 8)).alias("value"), F.lit("float").alias("value_type"))


def inherited(net: Network, least_weight: int = 2, hops: int = 3, decay: float = 0.5, floor: float = 0.05) -> DataFrame:
    """Labels that models inherit from what they derive from: confidence times decay per hop and the weights of the links, unless their own.

    An ancestor counts at its least distance, by the best of equally short paths, and with a confidence of 1 at most;
    ``floor`` leaves out what is weaker.
    """
    edges = net.links.where(F.col("relation").isin(*S.LINEAGE_RELATIONS) & (F.col("weight") >= least_weight)).groupBy(F.col("source_id").alias("model_id"), F.col("target_id").alias("up")).agg(F.max("weight").cast("double").alias("w"))
    reached = edges.select("model_id", "up", F.lit(1).alias("hop"), "w")
    frontier = reached
    for hop in range(2, hops + 1):
        frontier = frontier.join(edges.select(F.col("model_id").alias("up"), F.col("up").alias("next"), F.col("w").alias("v")), "up").groupBy("model_id", F.col("next").alias("up")).agg(F.lit(hop).alias("hop"), F.max(F.col("w") * F.col("v")).alias("w"))
        reached = reached.union(frontier.select("model_id", "up", "hop", "w"))
    nearest = reached.where("model_id <> up").groupBy("model_id", "up").agg(F.min(F.struct("hop", (-F.col("w")).alias("w"))).alias("x")).select("model_id", "up", "x.hop", (-F.col("x.w")).alias("w"))
    got = nearest.join(net.model_anchors.select(F.col("model_id").alias("up"), "label", "confidence"), "up")
    fading = F.least(F.lit(1.0), F.col("confidence") * F.pow(F.lit(decay), F.col("hop")) * F.col("w"))
    best = got.groupBy("model_id", "label").agg(F.max(fading).alias("confidence")).where(F.col("confidence") >= floor)
    return best.join(net.model_anchors.select("model_id", "label"), ["model_id", "label"], "left_anti")


def descendants(net: Network, root: str, least_weight: int = 2, hops: int = 32) -> DataFrame:
    """What derives from a model, with the least number of steps; cycles end because known nodes aren't entered again."""
    spark = net.models.sparkSession
    edges = stored(net.links.where(F.col("relation").isin(*S.LINEAGE_RELATIONS) & (F.col("weight") >= least_weight)).select("source_id", "target_id"), "descent")
    seen = spark.createDataFrame([(root, 0)], "model_id string, depth int")
    frontier = seen
    for depth in range(1, hops + 1):
        step = edges.join(frontier.select(F.col("model_id").alias("target_id")), "target_id").select(F.col("source_id").alias("model_id")).distinct().join(seen, "model_id", "left_anti")
        frontier = stored(step.withColumn("depth", F.lit(depth)), f"descent-{depth}")
        if not frontier.limit(1).count():
            break
        seen = seen.union(frontier)
    return seen.where("depth > 0")


def lineage_view(net: Network, model_id: str) -> DataFrame:
    """Links of a model by kind: what it derives from, what derives from it, its family."""
    out = net.links.where(F.col("source_id") == model_id).select(F.when(F.col("relation") == "same_family", "family").otherwise("derived_from").alias("kind"), F.col("target_id").alias("other"), "weight")
    into = net.links.where(F.col("target_id") == model_id).select(F.when(F.col("relation") == "same_family", "family").otherwise("derivatives").alias("kind"), F.col("source_id").alias("other"), "weight")
    return out.union(into).groupBy("kind", "other").agg(F.sum("weight").alias("weight"))


def within_groups(rows: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Pairs of members of a group: each member with the next ones by id, over the first ``cap`` members of the group."""
    ranked = rows.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("model_id"))).where(F.col("k") <= cap)
    a, b = ranked.select(*keys, F.col("model_id").alias("a"), F.col("k").alias("ka")), ranked.select(*keys, F.col("model_id").alias("b"), F.col("k").alias("kb"))
    return a.join(b, keys).where("ka < kb").select("a", "b")


def siblings(net: Network, least_weight: int = 2, cap: int = 20) -> DataFrame:
    """Models that derive from one base."""
    base = net.links.where(F.col("relation").isin(*S.LINEAGE_RELATIONS) & (F.col("weight") >= least_weight)).select(F.col("target_id").alias("base"), F.col("source_id").alias("model_id"))
    return within_groups(base, ["base"], cap).distinct().select("a", "b", F.lit("variant_of").alias("relation"), F.lit(0.6).alias("weight"))


def variants(net: Network, prefix: int = 3, cap: int = 50) -> DataFrame:
    """Models of one author whose names start alike; shorter names have no variants."""
    named = net.models.where(F.length("display_name") >= prefix).select("author", F.substring(F.lower("display_name"), 1, prefix).alias("start"), "model_id")
    return within_groups(named, ["author", "start"], cap).select("a", "b", F.lit("variant_of").alias("relation"), F.lit(0.5).alias("weight"))


def fingerprints(net: Network) -> DataFrame:
    """A short hash of the attributes that make two entities structurally the same."""
    return net.facts.select("model_id", F.substring(F.sha2(F.concat_ws(":", F.col("p_size").cast("string"), "p_type", "word2"), 256), 1, 16).alias("fingerprint"))


def fingerprint_links(net: Network, cap: int = 50) -> DataFrame:
    return within_groups(fingerprints(net), ["fingerprint"], cap).select("a", "b", F.lit("same_family").alias("relation"), F.lit(0.5).alias("weight"))


def neighbours(net: Network, cap: int = 20, nodes: DataFrame | None = None) -> DataFrame:
    """Per node (of ``nodes``, or all) its strongest links, outgoing before incoming: at most ``cap`` each way and in all, each neighbour once."""
    out = net.links.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), "relation", "weight", F.lit(0).alias("way"))
    both = out.union(net.links.select(F.col("target_id"), F.col("source_id"), "relation", "weight", F.lit(1)))
    both = both if nodes is None else both.join(nodes.select("node"), "node", "left_semi")
    each = both.withColumn("k", F.row_number().over(Window.partitionBy("node", "way").orderBy(F.desc("weight"), "other", "relation"))).where(F.col("k") <= cap)
    once = each.groupBy("node", "other").agg(F.min(F.struct("way", "k", "relation", "weight")).alias("x")).select("node", "other", "x.*")
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("way", "k", "other"))).where(F.col("r") <= cap)
    weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LINK_WEIGHTS.items() for x in kv]), F.col("relation")), F.lit(0.5))
    return ranked.select("node", "other", "relation", weight.alias("step"))


def _held(net: Network, banks: tuple[str, ...] | None) -> DataFrame:
    return (net.model_anchors if banks is None else net.model_anchors.where(F.col("bank").isin(*banks))).where("model_id is not null").select("model_id", "anchor_id")


def label_kinds(net: Network, banks: tuple[str, ...] | None = None, cap: int = 15) -> DataFrame:
    """(labels, ids): each different list of labels (of some banks) with the ``cap`` + 1 smallest ids of the models that hold it."""
    each = _held(net, banks).groupBy("model_id").agg(F.sort_array(F.collect_list("anchor_id")).alias("labels"))
    first = each.withColumn("k", F.row_number().over(Window.partitionBy("labels").orderBy("model_id"))).where(F.col("k") <= cap + 1)
    return stored(first.groupBy("labels").agg(F.sort_array(F.collect_list("model_id")).alias("ids")), "kinds")


def co_labelled(net: Network, nodes: DataFrame, banks: tuple[str, ...] | None = None, cap: int = 15, kinds: DataFrame | None = None) -> DataFrame:
    """Per node of ``nodes`` the models that share most labels (of some banks) with it, at most ``cap``, and the shared part of its labels.

    Models with the same labels share as many with any node, so lists of labels (``kinds``, else made here) are counted
    instead of models. Of lists that come after ``cap`` + 1 others by shared labels and smallest id, no model is among the first.
    """
    kinds = label_kinds(net, banks, cap) if kinds is None else kinds
    mine = _held(net, banks).withColumnRenamed("model_id", "node").join(nodes.select("node"), "node", "left_semi")
    own = stored(mine.groupBy("node").agg(F.sort_array(F.collect_list("anchor_id")).alias("labels"), F.count(F.lit(1)).alias("size")), "own-labels")
    asked = own.groupBy("labels").agg(F.min("node").alias("asked"))
    key = F.get("ids", F.lit(0)).alias("first")
    shared = asked.select("asked", F.explode("labels").alias("anchor_id")).join(kinds.select(key, F.explode("labels").alias("anchor_id")), "anchor_id").groupBy("asked", "first").agg(F.count(F.lit(1)).alias("shared"))

    def best(rows: DataFrame, of: str, other: str, n: int) -> DataFrame:
        return rows.withColumn("k", F.row_number().over(Window.partitionBy(of).orderBy(F.desc("shared"), other))).where(F.col("k") <= n).drop("k")

    models = best(shared, "asked", "first", cap + 1).join(kinds.select(key, "ids"), "first").select("asked", "shared", F.explode("ids").alias("other"))
    met = own.join(asked, "labels").select("node", "size", "asked").join(best(models, "asked", "other", cap + 1), "asked").where("node <> other")
    return best(met, "node", "other", cap).select("node", "other", (F.col("shared") / F.col("size")).alias("step"))


def spread(net: Network, seeds: tuple[str, ...], depth: int = 3, decay: float = 0.8, banks: tuple[str, ...] | None = None, labels: bool = True) -> DataFrame:
    """Activation from seeds along the strongest links and, with ``labels``, shared labels: the best product of decayed steps over paths of at most ``depth``.

    Only what a node is reached from is ranked: each hop expands the nodes that got more than before.
    """
    spark = net.models.sparkSession
    best = frontier = spark.createDataFrame([(s, 1.0) for s in seeds], "node string, activation double")
    kinds = label_kinds(net, banks) if labels else None
    for hop in range(depth):
        step = neighbours(net, nodes=frontier).select("node", "other", "step")
        step = step.union(co_labelled(net, frontier, banks, kinds=kinds)) if labels else step
        got = frontier.join(step, "node").groupBy(F.col("other").alias("node")).agg(F.max(F.col("activation") * decay * F.col("step")).alias("activation"))
        gained = got.join(best.select("node", F.col("activation").alias("had")), "node", "left").where("had is null or activation > had").select("node", "activation")
        frontier = stored(gained, f"spread-{hop}")
        best = best.union(frontier).groupBy("node").agg(F.max("activation").alias("activation"))
    return best.groupBy("node").agg(F.max("activation").alias("activation")).where(~F.col("node").isin(*seeds)).select(F.col("node").alias("model_id"), F.round("activation", 6).alias("score"))


def anchor_neighbours(net: Network, model_id: str, bank: str | None = None, limit: int = 15) -> DataFrame:
    """Models that share most labels with one, optionally of one bank."""
    held = net.model_anchors if bank is None else net.model_anchors.where(F.col("bank") == bank)
    mine = held.where(F.col("model_id") == model_id).select("anchor_id")
    shared = held.where(F.col("model_id") != model_id).join(F.broadcast(mine), "anchor_id").groupBy("model_id").agg(F.count(F.lit(1)).alias("shared"))  # one model's labels
    return shared.orderBy(F.desc("shared"), "model_id").limit(limit)


def spread_mixed(net: Network, seeds: tuple[str, ...], depth: int = 2, decay: float = 0.7, label_decay: float = 0.4, threshold: float = 0.05, cutoff: int = 5000, width: int = 12, limit: int = 50) -> DataFrame:
    """Activation along links and shared labels: the strongest path of at most ``depth`` steps, with the path.

    A link passes activation times decay and its relation's weight; a label times its decay and the other's confidence, to
    the ``width`` most confident carriers, fewer for popular labels and none beyond the cutoff.
    """
    spark = net.models.sparkSession
    relation = F.when(F.col("relation").isin("fine_tuned_from", "quantized_from"), 1.0).when(F.col("relation") == "merged_from", 0.7).otherwise(0.5)
    one = net.links.select(F.col("source_id").alias("node"), F.col("target_id").alias("other"), relation.alias("step"), "relation")
    back = net.links.select(F.col("target_id").alias("node"), F.col("source_id").alias("other"), relation.alias("step"), "relation")
    linked = one.union(back).select("node", "other", (F.col("step") * decay).alias("step"), F.col("relation").alias("via"))
    popular = net.model_anchors.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cutoff)
    reach = F.greatest(F.lit(3), F.floor(width * (0.4 + 0.6 * (1 - F.col("n") / cutoff))))
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("confidence"), "model_id"))
    carriers = stored(net.model_anchors.join(popular, "anchor_id").withColumn("k", rank).where(F.col("k") <= reach).select("anchor_id", "label", F.col("model_id").alias("other"), F.col("confidence").alias("gets")), "carriers")
    reached = spark.createDataFrame([(s, 1.0, [s]) for s in seeds], "node string, activation double, path array<string>")
    best = reached
    for hop in range(depth):
        from_links = reached.join(linked, "node").select("other", (F.col("activation") * F.col("step")).alias("activation"), "path")
        mine = net.model_anchors.select(F.col("model_id").alias("node"), "anchor_id", F.col("confidence").alias("gives"))
        from_labels = reached.join(mine, "node").join(carriers, "anchor_id").where("node <> other").select("other", (F.col("activation") * label_decay * F.col("gives") * F.col("gets")).alias("activation"), "path")
        step = from_links.union(from_labels).where(F.col("activation") >= threshold).select(F.col("other").alias("node"), "activation", F.concat("path", F.array("other")).alias("path"))
        strongest = F.max(F.struct("activation", "path")).alias("x")
        reached = stored(step.groupBy("node").agg(strongest).select("node", "x.activation", "x.path"), f"spread-{hop}")
        best = best.union(reached)
    top = best.groupBy("node").agg(F.max(F.struct("activation", "path")).alias("x")).where(~F.col("node").isin(*seeds))
    return top.select(F.col("node").alias("model_id"), F.round("x.activation", 6).alias("activation"), F.col("x.path").alias("path")).orderBy(F.desc("activation"), "model_id").limit(limit)


def hierarchy(parents: DataFrame, hops: int = 32) -> DataFrame:
    """(label, ancestor, depth) for a table of (label, parent): every ancestor at its least distance; cycles end at ``hops``."""
    reached = frontier = parents.select("label", F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).where("label <> parent")
    for depth in range(2, hops + 1):
        step = frontier.join(parents.select(F.col("label").alias("ancestor"), "parent"), "ancestor").select("label", F.col("parent").alias("ancestor"), F.lit(depth).alias("depth")).where("label <> ancestor").distinct()
        frontier = stored(step.join(reached.select("label", "ancestor"), ["label", "ancestor"], "left_anti"), f"hierarchy-{depth}")
        if not frontier.limit(1).count():
            break
        reached = reached.union(frontier)
    return reached


def propagate(net: Network, least_weight: int = 2) -> DataFrame:
    """The label table with inherited labels added; labels that models have stay as they are."""
    added = inherited(net, least_weight).join(F.broadcast(net.anchors.select("label", "anchor_id", "bank")), "label")  # the closed vocabulary
    return net.model_anchors.unionByName(added.select("model_id", "anchor_id", "label", "bank", "confidence"))


def bank_activation(net: Network, activated: DataFrame) -> DataFrame:
    """Activation of models by the banks of their labels."""
    share = net.model_anchors.join(activated.select("model_id", "activation"), "model_id")
    return share.groupBy("model_id", "bank").agg(F.round(F.sum(F.col("activation") * F.col("confidence")), 6).alias("activation"))


def lineage_order(net: Network, model_id: str) -> DataFrame:
    """Neighbours of a model from its sources to its derivatives, by their signed LINEAGE coordinate."""
    near = lineage_view(net, model_id).select("other").distinct()
    at = net.positions.where("bank = 'LINEAGE'").select(F.col("model_id").alias("other"), (F.col("path_sign") * F.col("path_depth")).alias("position"))
    return near.join(at, "other", "left").orderBy(F.col("position").asc_nulls_last(), "other")
