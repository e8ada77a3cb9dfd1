"""Files of records: readers with a status per line, sharded exports, audit logs, expansion rules, caches and resume sets."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..network import stored
from ..operators.records import parse_lines

#: Records of hubs and runtimes.
RAW = (
    "model_id string, author string, pipeline_tag string, tags array<string>, library_name string, likes bigint, downloads bigint, created_at string, license string, "
    "safetensors string, config string, source string"
)


def read_lines(spark: SparkSession, path: str, schema: str, required: str | None = None) -> DataFrame:
    """JSON lines with a status each: ok, empty, error, or skip where the required field is missing."""
    return parse_lines(spark.read.text(path), schema, required)


def read_records(spark: SparkSession, path: str, schema: str = RAW) -> DataFrame:
    """A dump of raw records; lines that don't parse are left out, see ``read_lines`` for them."""
    return read_lines(spark, path, schema, "model_id").where("status = 'ok'").select("r.*")


def export_shards(df: DataFrame, path: str, shards: int, key: str) -> None:
    """JSON files in ``shards`` folders shard=k, dealt by a hash of the key, so that a shard is the same in every export."""
    df.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")).repartition(shards, "shard").write.mode("overwrite").partitionBy("shard").json(path)


def append_audit(df: DataFrame, path: str) -> None:
    """Append audit entries as compressed JSON, a folder for each day of ``ts``."""
    df.withColumn("day", F.to_date("ts")).write.mode("append").partitionBy("day").option("compression", "gzip").json(path)


def read_audit(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def expansion_rules(spec: dict[str, Any]) -> list[dict[str, Any]]:
    """The rules of a parsed expansion file, with their defaults; an entry without a label or conditions is an error."""
    out = []
    for e in spec.get("expansions", []):
        rules = e.get("match_rules") or {}
        if not e.get("label") or not rules.get("conditions"):
            raise ValueError(f"an expansion needs a label and conditions: {e}")
        out.append({"label": e["label"], "bank": e.get("bank", ""), "mode": e.get("mode", "create_only"), "operator": rules.get("operator", "OR"), "conditions": rules["conditions"], "min_matches": int(rules.get("min_matches", 1)), "confidence": float(e.get("confidence", 0.7))})
    return out


def read_expansions(path: str) -> list[dict[str, Any]]:
    import yaml

    with open(path) as f:
        return expansion_rules(yaml.safe_load(f) or {})


def _pattern(value: Any) -> bool:
    """Whether a value is a pattern; a broken one never matches."""
    try:
        re.compile(str(value))
    except re.error:
        return False
    return True


def condition(kind: str, value: Any) -> Column:
    """A condition over raw records: tag_exact, tag_regex, pipeline_tag_in, name_regex or metadata_equals; others and broken patterns never hold."""
    if kind.endswith("_regex") and not _pattern(value):
        return F.lit(False)
    if kind == "tag_exact":
        return F.array_contains(F.transform("tags", lambda t: F.lower(t)), str(value).lower())
    if kind == "tag_regex":
        return F.exists("tags", lambda t: t.rlike(f"(?i){value}"))
    if kind == "pipeline_tag_in":
        return F.col("pipeline_tag").isin(*value)
    if kind == "name_regex":
        return F.col("model_id").rlike(f"(?i){value}")
    if kind == "metadata_equals" and isinstance(value, dict):
        return F.col(str(value.get("key"))).cast("string") == str(value.get("value"))
    return F.lit(False)


def matches(rule: dict[str, Any]) -> Column:
    """Whether a record satisfies a rule: all conditions for AND, at least ``min_matches`` for OR."""
    held = sum((F.coalesce(condition(c.get("type", ""), c.get("value")), F.lit(False)).cast("int") for c in rule["conditions"]), F.lit(0))
    return held >= (len(rule["conditions"]) if rule["operator"] == "AND" else rule["min_matches"])


def expand(records: DataFrame, rules: list[dict[str, Any]]) -> DataFrame:
    """Rows (model_id, label, bank, mode, confidence) for every rule that a record satisfies."""
    made = F.array(*[F.when(matches(r), F.struct(F.lit(r["label"]).alias("label"), F.lit(r["bank"]).alias("bank"), F.lit(r["mode"]).alias("mode"), F.lit(r["confidence"]).alias("confidence"))) for r in rules])
    return records.select("model_id", F.explode(made).alias("x")).where("x is not null").select("model_id", "x.*")


def fresh(cached: DataFrame, hours: float, at: str = "cached_at") -> DataFrame:
    """Cached rows younger than some hours."""
    return cached.where(F.col(at) > F.current_timestamp() - F.expr(f"INTERVAL {int(hours * 3600)} SECONDS"))


def remaining(todo: DataFrame, done: DataFrame, key: str = "model_id") -> DataFrame:
    """What a resumed run still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def ingest(existing: DataFrame, listing: DataFrame, min_likes: int) -> DataFrame:
    """New records of a listing that are liked enough, each once."""
    return remaining(listing.where(F.col("likes") >= min_likes).dropDuplicates(["model_id"]), existing)


def preference_pairs(corrections: DataFrame) -> DataFrame:
    """Training pairs of corrections that changed something: prompt, chosen and rejected answer."""
    return corrections.where("original <> healed").orderBy("event_id").select("prompt", F.col("healed").alias("chosen"), F.col("original").alias("rejected"), "model_id", "tier", "run_id")


def versioned(df: DataFrame, tag: str) -> DataFrame:
    """A new version of a table, readable as soon as it is whole."""
    return stored(df, tag)
