"""Steps of the ingest phases: seeding, local runtimes, cleaning of web results, merges' counters, run ledger, work lists."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import size_number
from . import stats
from ..network import Network

# Seeding passes in order: name, least likes, least downloads, earliest date, pipeline tags (empty: all).
PASSES = (
    ("core", 100, 0, None, ""),
    ("expand", 10, 100, date(2023, 1, 1), ""),
    ("niche", 3, 50, date(2023, 6, 1), "text-generation text2text-generation image-text-to-text feature-extraction"),
)
# Families of local runtimes, the first that a family's name has counts.
RUNTIME_FAMILIES = (("llama", "Llama-family"), ("mistral", "Mistral-family"), ("gemma", "Gemma-family"), ("phi", "Phi-family"), ("qwen", "Qwen-family"), ("command-r", "Command-family"))
# Fixed values of cleaning: synonyms, labels that tasks rule out, labels of language models only, tasks that aren't theirs, size classes.
SYNONYMS = {"function-calling": "tool-calling", "gguf-available": "gguf-quantized"}
GATES = {
    "automatic-speech-recognition": "translation code-generation tool-calling function-calling instruction-following reasoning",
    "text-classification": "tool-calling function-calling code-generation instruction-following reasoning",
    "sentence-similarity": "tool-calling function-calling instruction-following reasoning code-generation",
    "fill-mask": "tool-calling function-calling instruction-following reasoning code-generation",
    "token-classification": "tool-calling function-calling code-generation reasoning",
    "image-classification": "code-generation tool-calling function-calling instruction-following",
    "object-detection": "code-generation tool-calling function-calling instruction-following reasoning",
    "feature-extraction": "tool-calling function-calling reasoning",
}
LANGUAGE_ONLY = "high-mmlu strong-humaneval strong-gsm8k tool-calling function-calling instruction-following reasoning code-generation structured-output long-context".split()
NOT_LANGUAGE = "automatic-speech-recognition text-classification sentence-similarity fill-mask token-classification image-classification object-detection feature-extraction image-segmentation audio-classification depth-estimation image-to-image image-feature-extraction".split()
SIZE_CLASSES = (("sub-1b", 0.0, 0.99), ("1b-class", 1.0, 2.99), ("3b-class", 3.0, 6.99), ("7b-class", 7.0, 12.99), ("13b-class", 13.0, 29.99), ("30b-class", 30.0, 69.99), ("70b-class", 70.0, 199.99), ("frontier-class", 200.0, 99999.0))
SUSPECTS = ("multimodal", "hybrid", "vision-transformer", "mixture-of-experts")
BLEED = (r"(?i)\b(series|family|suite)\b.*\b(offering|includes|provides)\b", r"(?i)\b(dense and|and mixture)", r"(?i)\bnative vision-language\b")


def seed(records: DataFrame, existing: DataFrame, passes: tuple = PASSES) -> DataFrame:
    """(model_id, pass): each record that is new, by the first pass that takes it; a record without a date passes any."""
    created = F.to_date(F.col("created_at").try_cast("timestamp"))
    likes, downloads = F.coalesce("likes", F.lit(0)), F.coalesce("downloads", F.lit(0))
    taken = F.lit(None).cast("string")
    for name, least_likes, least_downloads, earliest, tags in reversed(passes):
        good = (likes >= least_likes) & (downloads >= least_downloads)
        if earliest:
            good = good & F.coalesce(created >= F.lit(earliest), F.lit(True))
        if tags:
            good = good & F.col("pipeline_tag").isin(*tags.split())
        taken = F.when(good, name).otherwise(taken)
    return records.select("model_id", taken.alias("pass")).where("pass is not null").dropDuplicates(["model_id"]).join(existing.select("model_id"), "model_id", "left_anti")


def runtime_records(listed: DataFrame) -> DataFrame:
    """Raw records (model_id, tags, config) of a local runtime's listing (name, family, parameter_size, quantization_level)."""
    family, level, size = (F.coalesce(c, F.lit("")) for c in ("family", "quantization_level", "parameter_size"))
    billions = size_number(size)
    known = F.coalesce(*[F.when(F.lower(family).contains(w), F.lit(a)) for w, a in RUNTIME_FAMILIES])
    tags = F.array(
        F.when(family != "", F.lower(family)), F.when(level != "", F.lower(level)), F.when(level != "", F.lit("quantized")), F.lit("GGUF-available"), F.lit("llama-cpp-compatible"), F.lit("CPU-inference"), known,
        F.when(billions < 1, "sub-1B").when(billions < 4, "3B-class").when(billions < 10, "7B-class").when(billions < 20, "13B-class"), F.when(billions < 1, "edge-deployable").when(billions < 4, "consumer-GPU-viable"),
    )
    config = F.when(family != "", F.to_json(F.struct(family.alias("model_type"))))
    return listed.select(F.col("name").alias("model_id"), F.filter(tags, lambda t: t.isNotNull()).alias("tags"), config.alias("config"))


def _without(anchors: Column, labels: list[str]) -> Column:
    return F.array_except(anchors, F.array(*map(F.lit, labels)).cast("array<string>"))


def clean_web(items: DataFrame) -> DataFrame:
    """``items`` (model_id, pipeline_tag, param_count, anchors) with ``anchors`` cleaned and ``changed``, step by step.

    Synonyms merge; names contradict labels; mixtures of experts need a name that says so; tasks rule out labels; of size
    classes that of the known size stays, else the nearest, without a size the largest.
    """
    name = F.col("model_id")
    canonical = F.create_map(*[F.lit(x) for pair in SYNONYMS.items() for x in pair])
    a = F.array_distinct("anchors")
    a = F.filter(a, lambda x: ~(F.map_contains_key(canonical, x) & F.array_contains(F.col("anchors"), F.element_at(canonical, x))))
    a = F.array_distinct(F.transform(a, lambda x: F.coalesce(F.element_at(canonical, x), x)))
    rows = items.withColumn("__a", a)
    a = F.when(name.rlike("(?i)(instruct|chat|-it$|-it-)"), _without(F.col("__a"), ["base-model"])).otherwise(F.col("__a"))
    rows = rows.withColumn("__a", a)
    rows = rows.withColumn("__a", F.when(~name.rlike(r"(?i)(moe|\d+b-a\d+b|a\d+b)"), _without(F.col("__a"), ["mixture-of-experts"])).otherwise(F.col("__a")))
    gated = F.when(F.lit(False), F.col("__a"))
    for tag, labels in GATES.items():
        gated = gated.when(F.col("pipeline_tag") == tag, _without(F.col("__a"), labels.split()))
    rows = rows.withColumn("__a", gated.otherwise(F.col("__a")))
    rows = rows.withColumn("__a", F.when(F.col("pipeline_tag").isin(*NOT_LANGUAGE), _without(F.col("__a"), LANGUAGE_ONLY)).otherwise(F.col("__a")))
    given = F.col("param_count").try_cast("double")
    stated = lambda pattern: F.nullif(F.regexp_extract(name, pattern, 1), F.lit("")).try_cast("double")
    size = F.coalesce(F.when(given > 1e9, given / 1e9).when(given > 0, given), stated(r"(?i)(\d+(?:\.\d+)?)b-a\d+(?:\.\d+)?b"), stated(r"(?i)(?:^|[-_/])(\d+(?:\.\d+)?)\s*b(?:[-_/]|$)"), stated(r"(?i)(\d+)m(?:[-_/]|$)") / 1000.0)
    classes = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(label).alias("label"), F.lit(low).alias("low"), F.lit(high).alias("high")) for k, (label, low, high) in enumerate(SIZE_CLASSES)])
    rows = rows.withColumn("__b", size).withColumn("__hits", F.filter(classes, lambda c: F.array_contains(F.col("__a"), c["label"])))
    inside = F.get(F.filter("__hits", lambda c: (F.col("__b") >= c["low"]) & (F.col("__b") <= c["high"])), F.lit(0))
    nearest = F.array_min(F.transform("__hits", lambda c: F.struct(F.abs(F.col("__b") - (c["low"] + c["high"]) / 2).alias("d"), c["k"].alias("k"), c["label"].alias("label"))))
    keep = F.coalesce(inside["label"], F.when(F.col("__b").isNotNull(), nearest["label"]), F.element_at("__hits", -1)["label"])
    single = F.filter("__a", lambda x: ~F.exists("__hits", lambda c: c["label"] == x) | (x == F.col("__keep")))
    rows = rows.withColumn("__keep", F.when(F.size("__hits") > 1, keep))
    rows = rows.withColumn("__a", F.when(F.col("__keep").isNotNull(), single).otherwise(F.col("__a")))
    changed = F.array_sort("__a") != F.array_sort(F.array_distinct("anchors"))
    return rows.withColumn("changed", changed).withColumn("anchors", F.col("__a")).drop("__a", "__b", "__hits", "__keep")


def suspects(claims: DataFrame) -> DataFrame:
    """Claims (model_id, label, evidence) that a model should look at again: labels that bleed from a series, or evidence about one."""
    bled = F.lit(False)
    for pattern in BLEED:
        bled = bled | F.coalesce(F.col("evidence").rlike(pattern), F.lit(False))
    return claims.where(F.col("label").isin(*SUSPECTS) | bled)


def gated_pool(net: Network, ranks: DataFrame, top: int) -> DataFrame:
    """Models of the ``top`` by ``ranks`` (model_id, pagerank) that lack a summary or affect and need a language model."""
    best = ranks.orderBy(F.desc("pagerank"), "model_id").limit(top).select("model_id")
    summed = net.metadata.where("key = 'vibe_summary'").select("model_id")
    lacking = best.join(summed, "model_id", "left_anti").union(best.join(net.facts.where("vibe_e is null or vibe_p is null or vibe_a is null").select("model_id"), "model_id", "left_semi")).distinct()
    return lacking.join(stats.needs_enrichment(net).where("needs").select("model_id"), "model_id", "left_semi")


def needs_config(raw: DataFrame) -> DataFrame:
    """Records (model_id, raw) whose JSON has no configuration, or an empty one."""
    config = F.get_json_object("raw", "$.config")
    return raw.where(config.isNull() | config.isin("{}", "null")).select("model_id")


def prefix_count(metadata: DataFrame, prefix: str) -> DataFrame:
    """Rows and models with a key that starts so."""
    return metadata.where(F.col("key").startswith(prefix)).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("model_id").alias("models"))


def web_status(net: Network, done: DataFrame) -> DataFrame:
    """Models, models with a web result, with benchmarks, and the covered share in percent."""
    total = net.models.agg(F.count(F.lit(1)).alias("total"))
    held = done.agg(F.countDistinct("model_id").alias("done"), F.countDistinct(F.when(F.col("key").startswith("benchmark:"), F.col("model_id"))).alias("benchmarked"))
    return total.crossJoin(held).select("total", "done", "benchmarked", F.round(100.0 * F.col("done") / F.greatest(F.col("total"), F.lit(1)), 2).alias("pct"))  # one row each


def training_stats(corrections: DataFrame, findings: DataFrame) -> DataFrame:
    """(kind, item, n): corrections by tier, models corrected, and corrected models by kind of finding."""
    tiers = corrections.groupBy(F.col("tier").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("tier").alias("kind"), "item", "n")
    models = corrections.agg(F.countDistinct("model_id").alias("n")).select(F.lit("models").alias("kind"), F.lit("").alias("item"), "n")
    by_kind = corrections.select("model_id").distinct().join(findings, "model_id").groupBy(F.col("kind").alias("item")).agg(F.countDistinct("model_id").alias("n")).select(F.lit("finding").alias("kind"), "item", "n")
    return tiers.union(models).union(by_kind)


def claims(todo: DataFrame, done: DataFrame, workers: int, key: str = "model_id") -> DataFrame:
    """(key, worker): what is left to do, dealt to workers by a hash, so that no two take one."""
    return todo.select(key).distinct().join(done.select(key), key, "left_anti").select(key, F.pmod(F.crc32(F.col(key).cast("binary")), F.lit(workers)).cast("int").alias("worker"))


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


def first_wins(emissions: DataFrame, tiers: tuple[str, ...]) -> DataFrame:
    """Of a model's emissions (model_id, label, tier) of one label that of the first tier."""
    order = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier"))
    return emissions.withColumn("__k", F.row_number().over(Window.partitionBy("model_id", "label").orderBy(order))).where("__k = 1").drop("__k")


def group_members(df: DataFrame, by: list[str], key: str, cap: int = 50) -> DataFrame:
    """Keys of a group in order, joined by commas: the first ``cap`` of them, and how many there are."""
    ranked = df.withColumn("__k", F.row_number().over(Window.partitionBy(*by).orderBy(key)))
    listed = F.array_join(F.array_sort(F.collect_list(F.when(F.col("__k") <= cap, F.col(key)))), ",")
    return ranked.groupBy(*by).agg(listed.alias("members"), F.count(F.lit(1)).alias("n"))


def parameter_estimate(layers: Column, hidden: Column, inner: Column, vocabulary: Column) -> Column:
    """Parameters of a decoder of such a geometry: attention and feed-forward of each layer, and two embeddings."""
    return layers * (4 * hidden * hidden + 3 * hidden * inner) + 2 * vocabulary * hidden


def run_ledger(runs: DataFrame, finished: DataFrame) -> DataFrame:
    """Runs (run_id, phase, config) with their outcome: status and summary of (run_id, status, summary), or running."""
    return runs.join(finished, "run_id", "left").select("run_id", "phase", "config", F.coalesce("status", F.lit("running")).alias("status"), "summary")
