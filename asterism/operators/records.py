"""Audited writes: reconciling records with a table, upserts, merges of enrichment results, audits of label sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network
from ..schema import BANKS
from .extract import SIZES, bucket


def parse_lines(lines: DataFrame, schema: str, required: str | None) -> DataFrame:
    """JSON lines with a status: empty, error, skip (without the required field) or ok, and the parsed record."""
    rec = F.from_json("value", schema)
    broken = ~F.trim("value").startswith("{") | F.get_json_object("value", "$").isNull()
    parsed = lines.select("value", rec.alias("r"), broken.alias("bad"))
    status = F.when(F.trim("value") == "", "empty").when(F.col("bad") | F.col("r").isNull(), "error")
    status = status.when(F.col(f"r.{required}").isNull(), "skip") if required else status
    return parsed.select("value", status.otherwise("ok").alias("status"), "r")


def latest_wins(current: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The current rows with changes applied: for each key the change with the largest ``order``, else the current row."""
    both = current.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__new"), F.desc(order)))
    return both.withColumn("__k", rank).where("__k = 1").drop("__k", "__new")


def reconcile(current: DataFrame, items: DataFrame, key: str, fields: list[str], order: str | None = None) -> DataFrame:
    """What each incoming item does: insert, patch of a field (old and new value) or unchanged; of a key's items the last counts.

    The last is that with the largest ``order``, a column of the items, or else the largest values.
    """
    last = F.max(F.struct(*([F.col(order).alias("__order")] if order else []), *fields)).alias("x")
    once = items.groupBy(key).agg(last).select(key, *[F.col(f"x.{f}").alias(f) for f in fields])
    old = current.select(key, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("known"))
    joined = once.join(old, key, "left")
    changes = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"old_{f}").cast("string").alias("old_value"), F.col(f).cast("string").alias("new_value")) for f in fields])
    differing = F.filter(changes, lambda c: ~c["old_value"].eqNullSafe(c["new_value"]))
    marked = joined.select(key, F.when(F.col("known").isNull(), F.lit("insert")).when(F.size(differing) > 0, "patch").otherwise("unchanged").alias("op"), differing.alias("d"))
    return marked.select(key, "op", F.explode_outer(F.when(F.col("op") == "patch", F.col("d"))).alias("x")).select(key, "op", "x.field", "x.old_value", "x.new_value")


def audit_findings(net: Network, suggested: DataFrame) -> DataFrame:
    """Where suggested labels (model_id, label, confidence) and a model's own disagree.

    contradiction: two labels of one bank from the two sources with nothing in common; gap: a bank that neither covers;
    conflict: one label with confidences over 0.3 apart; unsupported: a suggestion of a label outside the vocabulary.
    """
    vocabulary = net.anchors.select("label", "bank")
    known = suggested.join(vocabulary, "label")
    mine = net.model_anchors.select("model_id", "bank", "label").groupBy("model_id", "bank").agg(F.collect_set("label").alias("own"))
    theirs = known.groupBy("model_id", "bank").agg(F.collect_set("label").alias("other"))
    clash = mine.join(theirs, ["model_id", "bank"]).where(~F.arrays_overlap("own", "other")).select("model_id", F.lit("contradiction").alias("kind"), F.col("bank").alias("item"), F.lit(0.7).alias("severity"))
    every = net.models.select("model_id", F.explode(F.array(*[F.lit(b) for b in BANKS])).alias("bank"))
    gap = every.join(mine, ["model_id", "bank"], "left_anti").join(theirs, ["model_id", "bank"], "left_anti").select("model_id", F.lit("gap").alias("kind"), F.col("bank").alias("item"), F.lit(0.5).alias("severity"))
    both = net.model_anchors.select("model_id", "label", F.col("confidence").alias("c")).join(suggested, ["model_id", "label"])
    conflict = both.where(F.abs(F.col("c") - F.col("confidence")) > 0.3).select("model_id", F.lit("conflict").alias("kind"), F.col("label").alias("item"), F.round(F.abs(F.col("c") - F.col("confidence")), 6).alias("severity"))
    unsupported = suggested.join(vocabulary, "label", "left_anti").select("model_id", F.lit("unsupported").alias("kind"), F.col("label").alias("item"), F.lit(0.6).alias("severity"))
    return clash.union(gap).union(conflict).union(unsupported)


def merge_outcomes(net: Network, found: DataFrame) -> DataFrame:
    """What happens to web labels (model_id, label): unknown, skipped as existing, or added with confidence 0.4."""
    vocabulary = net.anchors.select(F.lower("label").alias("low"), F.col("label").alias("canonical"))
    named = found.withColumn("low", F.lower("label")).join(F.broadcast(vocabulary), "low", "left")  # the closed vocabulary
    own = net.model_anchors.select("model_id", F.col("label").alias("canonical"), F.col("confidence").alias("held"))
    joined = named.join(own, ["model_id", "canonical"], "left")
    outcome = F.when(F.col("canonical").isNull(), "unknown").when(F.col("held") >= 0.4, "existing").otherwise("added")
    return joined.select("model_id", "label", outcome.alias("outcome"))


#: Families of labels of which a model keeps one, from the smallest tier to the largest. Fixed values.
CONTEXT_TIERS = ("long-context-32k", "long-context-128k", "long-context-1m")
SIZE_TIERS = tuple(size[4] for size in SIZES)


def keep_best_tier(labels: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (model_id, label) to delete so that each model keeps one label of a family.

    ``labels`` has (model_id, label), ``sizes`` (model_id, params_b). Of context tiers the largest stays; of size classes
    that of the known size if the model has it, else the largest. Labels of no family stay.
    """
    tier = F.create_map(*[F.lit(x) for family, names in (("context", CONTEXT_TIERS), ("size", SIZE_TIERS)) for k, name in enumerate(names) for x in (name, f"{family}:{k:02d}")])
    ranked = labels.select("model_id", "label").distinct().withColumn("tier", F.element_at(tier, F.col("label"))).where("tier is not null")
    known = sizes.where("params_b is not null").select("model_id", bucket(F.col("params_b"), 4).alias("best"))
    keyed = ranked.join(known, "model_id", "left").withColumn("family", F.substring_index("tier", ":", 1))
    order = Window.partitionBy("model_id", "family").orderBy(F.desc(F.coalesce((F.col("label") == F.col("best")), F.lit(False))), F.desc("tier"))
    return keyed.withColumn("k", F.row_number().over(order)).where("k > 1").select("model_id", "label")


def healing_candidates(net: Network, findings: DataFrame, budget: int, seed: str = "heal") -> DataFrame:
    """A budget of models to repair: half by downloads among those with findings, the rest by a seeded hash."""
    flagged = net.facts.join(findings.select("model_id").distinct(), "model_id", "left_semi")
    first = flagged.orderBy(F.desc("downloads"), "model_id").limit(budget // 2).select("model_id", F.lit("popular").alias("why"))
    rest = flagged.join(first, "model_id", "left_anti").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("model_id")), 256))
    return first.union(rest.orderBy("h", "model_id").limit(budget - budget // 2).select("model_id", F.lit("sampled").alias("why")))


def order_parameter(net: Network) -> DataFrame:
    """Agreement of a model's coordinates as phases: the length of their mean vector, for models with two or more."""
    v = F.greatest(F.lit(-4), F.least(F.lit(4), F.col("path_sign") * F.col("path_depth")))
    theta = (v + 4) / 8.0 * F.pi()
    agg = net.positions.groupBy("model_id").agg(F.avg(F.cos(theta)).alias("x"), F.avg(F.sin(theta)).alias("y"), F.count(F.lit(1)).alias("n"))
    return agg.where("n >= 2").select("model_id", F.round(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y")), 6).alias("r"))


#: Tables whose writes are audited, with their key columns.
CANONICAL = {"models": ("model_id",), "positions": ("model_id", "bank"), "anchors": ("anchor_id",), "model_anchors": ("model_id", "anchor_id")}


class ContractError(ValueError):
    """A write that the contract of audited tables doesn't allow."""


def patch_field(table: str, current: DataFrame, key: dict[str, object], field: str, value: object, reason: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(table after the patch, audit row): one field of one row; a dry run leaves the table as it is.

    Refused are unknown tables and fields, keys that aren't the table's, fields of the key, empty reasons, and rows that don't exist.
    """
    if table not in CANONICAL:
        raise ContractError(f"{table} isn't audited")
    if tuple(sorted(key)) != tuple(sorted(CANONICAL[table])):
        raise ContractError(f"the key of {table} is {CANONICAL[table]}")
    if field not in current.columns or field in CANONICAL[table]:
        raise ContractError(f"{field} can't be patched")
    if not reason.strip():
        raise ContractError("a patch needs a reason")
    here = F.lit(True)
    for column, wanted in key.items():
        here = here & F.col(column).eqNullSafe(F.lit(wanted))
    old = current.where(here).select(field).limit(2).collect()
    if len(old) != 1:
        raise ContractError("no such row" if not old else "more than one row")
    kind = current.schema[field].dataType
    audit = current.sparkSession.createDataFrame([(table, field, str(key), None if old[0][0] is None else str(old[0][0]), None if value is None else str(value), reason, dry_run)], "table string, field string, key string, old_value string, new_value string, reason string, dry_run boolean")
    after = current if dry_run else current.withColumn(field, F.when(here, F.lit(value).cast(kind)).otherwise(F.col(field)))
    return after, audit


def insert_new(current: DataFrame, rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(table with new rows, rows refused): rows with a null or known key are refused, of repeated ones all but one."""
    whole = F.lit(True)
    for k in keys:
        whole = whole & F.col(k).isNotNull()
    fresh = rows.where(whole).dropDuplicates(keys).join(current.select(keys), keys, "left_anti")
    known = rows.where(whole).join(current.select(keys), keys, "left_semi").withColumn("error", F.lit("exists"))
    refused = rows.where(~whole).withColumn("error", F.lit("null key")).unionByName(known)
    return current.unionByName(fresh), refused


def ensure_anchors(anchors: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(dictionary with the wanted labels, conflicts): new labels get an id of bank and label; a known label keeps its bank, and another bank is a conflict."""
    known = anchors.select("label", F.col("bank").alias("known_bank"))
    joined = wanted.select("label", "bank").distinct().join(known, "label", "left")
    first = joined.where("known_bank is null").groupBy("label").agg(F.min("bank").alias("bank"))
    added = first.select(F.concat_ws(":", "bank", "label").alias("anchor_id"), "label", "bank", F.lit("runtime").alias("category"))
    return anchors.unionByName(added), joined.where("known_bank <> bank").select("label", "bank", "known_bank")


def heal(net: Network, healed: DataFrame) -> DataFrame:
    """The label table after repairs (model_id, labels): weak labels (confidence 0.5) that the repair lacks go, missing ones come with 0.6."""
    wanted = healed.select("model_id", F.explode("labels").alias("label")).distinct()
    touched = healed.select("model_id").distinct()
    weak = net.model_anchors.where("confidence = 0.5").join(touched, "model_id", "left_semi").join(wanted, ["model_id", "label"], "left_anti")
    kept = net.model_anchors.join(weak.select("model_id", "label"), ["model_id", "label"], "left_anti")
    added = wanted.join(net.model_anchors.select("model_id", "label"), ["model_id", "label"], "left_anti").join(F.broadcast(net.anchors.select("label", "anchor_id", "bank")), "label")  # the closed vocabulary
    return kept.select("model_id", "anchor_id", "label", "bank", "confidence").unionByName(added.select("model_id", "anchor_id", "label", "bank", F.lit(0.6).alias("confidence")))


def anchor_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per model the labels added and removed, sorted."""
    old = before.groupBy("model_id").agg(F.collect_set("label").alias("old"))
    new = after.groupBy("model_id").agg(F.collect_set("label").alias("new"))
    both = old.join(new, "model_id", "full").withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("old", "new")})
    out = both.select("model_id", F.array_join(F.array_sort(F.array_except("new", "old")), ",").alias("added"), F.array_join(F.array_sort(F.array_except("old", "new")), ",").alias("removed"))
    return out.where("added <> '' or removed <> ''")


def select_summaries(candidates: DataFrame, existing: DataFrame, precedence: tuple[str, ...]) -> DataFrame:
    """One summary (model_id, tier, summary) for each model without one: of the first tier in the order that has any, the first by text."""
    order = F.array_position(F.array(*map(F.lit, precedence)), F.col("tier"))
    rank = F.row_number().over(Window.partitionBy("model_id").orderBy(order, "summary"))
    todo = candidates.where(F.col("tier").isin(*precedence) & (F.trim("summary") != "")).join(existing.select("model_id"), "model_id", "left_anti")
    return todo.withColumn("k", rank).where("k = 1").select("model_id", "tier", "summary")


def median_upper(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """The upper median of a column by groups, with mean and count."""
    w = Window.partitionBy(*by)
    ranked = df.where(F.col(column).isNotNull()).withColumn("k", F.row_number().over(w.orderBy(column))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("mean", F.avg(column).over(w))
    return ranked.where(F.col("k") == F.floor(F.col("n") / 2) + 1).select(*by, F.col(column).alias("median"), F.round("mean", 6).alias("mean"), "n")


def finding_scores(net: Network, findings: DataFrame) -> DataFrame:
    """Per model 1 less 0.2 for each finding, at least 0; 1 without any."""
    n = findings.groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))
    return net.models.join(n, "model_id", "left").select("model_id", F.coalesce("n", F.lit(0)).alias("findings"), F.greatest(F.lit(0.0), F.round(1 - 0.2 * F.coalesce("n", F.lit(0)), 6)).alias("score"))


def efficiency_dissent(net: Network, limit: int = 200) -> DataFrame:
    """Models whose coordinates agree least: order parameter under 0.95, lowest first."""
    return order_parameter(net).where("r < 0.95").orderBy("r", "model_id").limit(limit)
