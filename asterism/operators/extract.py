"""Rule-based extraction of coordinates, labels and metadata from raw records (model_id, tags, likes, ..., safetensors and config as JSON)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size classes in billions of parameters: from, below, sign, depth, label. Fixed values.
SIZES = (
    (0.0, 0.5, -1, 3, "sub-1B"), (0.5, 1.5, -1, 2, "1B-class"), (1.5, 5.0, -1, 1, "3B-class"), (5.0, 10.0, 0, 0, "7B-class"),
    (10.0, 20.0, 1, 1, "13B-class"), (20.0, 50.0, 1, 2, "30B-class"), (50.0, 100.0, 1, 3, "70B-class"), (100.0, float("inf"), 1, 4, "frontier-class"),
)
#: Popularity scores above which the QUALITY coordinate is this. Fixed values.
QUALITY = ((25.0, 1, 2), (15.0, 1, 1), (5.0, 0, 0), (1.0, -1, 1))
#: Tightest context tiers. Fixed values.
CONTEXTS = ((1_000_000, "long-context-1m"), (131_072, "long-context-128k"), (32_768, "long-context-32k"))


def number_before_b(text: Column) -> Column:
    """The first number in 0.1..1000 that stands directly before a b or B."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"([0-9]*\.?[0-9]*)[bB]"), 1), lambda x: x.try_cast("double"))
    return F.get(F.filter(found, lambda v: v.isNotNull() & v.between(0.1, 1000)), F.lit(0))


def parameters(row: str = "safetensors") -> Column:
    """Billions of parameters: a map or a number in the weights' header, half its bytes, or a number in the name or a tag."""
    raw = F.try_parse_json(F.col(row))
    as_map = F.from_json(F.get_json_object(row, "$.parameters"), "map<string,bigint>")
    summed = F.when(F.size(as_map) > 0, F.aggregate(F.map_values(as_map), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0))) / 1e9)
    single = F.try_variant_get(raw, "$.parameters", "double") / 1e9
    total = F.try_variant_get(raw, "$.total", "double") / 2 / 1e9
    tagged = F.get(F.filter(F.transform("tags", number_before_b), lambda v: v.isNotNull()), F.lit(0))
    return F.coalesce(single, summed, total, number_before_b(F.col("model_id")), tagged)


def bucket(params: Column, at: int) -> Column:
    """A field of the size class of a parameter count: 2 sign, 3 depth, 4 label; null where it is unknown."""
    out = F.when(F.lit(False), SIZES[0][at])
    for low, high, *_ in SIZES:
        out = out.when((params >= low) & (params < high), F.lit(next(s for s in SIZES if s[0] == low)[at]))
    return out


def popularity(as_of: Column) -> Column:
    """2 ln(1 + likes) + 0.5 ln(1 + downloads), half as much again within 90 days of creation."""
    age = F.datediff(as_of, F.to_date(F.col("created_at").try_cast("timestamp")))
    base = 2 * F.log1p(F.coalesce("likes", F.lit(0)).cast("double")) + 0.5 * F.log1p(F.coalesce("downloads", F.lit(0)).cast("double"))
    return base * F.when(age < 90, 1.5).otherwise(1.0)


def quality(score: Column, at: int) -> Column:
    """Sign (1) or depth (2) of the QUALITY coordinate."""
    out = F.when(F.lit(False), 0)
    for cut in QUALITY:
        out = out.when(score > cut[0], F.lit(cut[at]))
    return out.otherwise(F.lit((0, -1, 2)[at]))


def config_number(*keys: str) -> Column:
    """The first positive whole number among keys of the config."""
    values = [F.try_variant_get(F.try_parse_json(F.col("config")), f"$.{k}", "bigint") for k in keys]
    return F.coalesce(*[F.when(v > 0, v) for v in values])


def fingerprint() -> Column:
    """A hash of the four dimensions of the architecture; null unless all are known."""
    dims = [config_number(k) for k in ("hidden_size", "num_hidden_layers", "num_attention_heads", "vocab_size")]
    known = dims[0].isNotNull() & dims[1].isNotNull() & dims[2].isNotNull() & dims[3].isNotNull()
    return F.when(known, F.substring(F.sha2(F.concat_ws(":", *[d.cast("string") for d in dims]), 256), 1, 16))


def context_label() -> Column:
    length = config_number("max_position_embeddings", "n_positions", "max_sequence_length", "seq_length", "n_ctx")
    out = F.when(F.lit(False), "")
    for least, label in CONTEXTS:
        out = out.when(length >= least, label)
    return out


def license_of() -> Column:
    """The record's license, else that of a license: tag; lower case."""
    tag = F.get(F.filter("tags", lambda t: t.startswith("license:")), F.lit(0))
    return F.lower(F.trim(F.coalesce("license", F.regexp_replace(tag, "^license:", ""))))


def quant_level() -> Column:
    """The quantization level in a name, like Q4_K_M."""
    found = F.upper(F.regexp_extract("model_id", r"(?i)(?:^|[^a-z0-9])(q[2-8](?:_[0-9k](?:_[sml])?)?|int[48]|fp8|awq|gptq)(?:[^a-z0-9_]|$)", 1))
    return F.when(found != "", found)


def tag_values(prefix: str) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.filter("tags", lambda t: t.startswith(prefix)), lambda t: F.substring(t, len(prefix) + 1, 10_000))))


def languages() -> Column:
    return F.array_sort(F.array_distinct(F.filter("tags", lambda t: t.rlike("^[a-z]{2}$"))))


def extract(records: DataFrame, as_of: Column) -> DataFrame:
    """A row per record: coordinates, labels and facts of the deterministic tier; unknown facts are null, never a zero coordinate."""
    params, score = F.col("params_b"), F.col("popularity")
    rows = records.withColumns({"params_b": parameters(), "popularity": popularity(as_of)})
    labels = F.array(
        bucket(params, 4), F.when(params < 4, "consumer-GPU-viable"), F.when(params < 1, "edge-deployable"), context_label(),
        F.when(F.coalesce("downloads", F.lit(0)) > 1_000_000, "high-downloads"), F.when(F.coalesce("likes", F.lit(0)) > 1000, "community-favorite"), F.when(quant_level().isNotNull(), "quantized"),
    )
    return rows.select(
        "model_id", F.round(params, 6).alias("params_b"), bucket(params, 2).alias("efficiency_sign"), bucket(params, 3).alias("efficiency_depth"),
        quality(score, 1).alias("quality_sign"), quality(score, 2).alias("quality_depth"), F.array_join(F.array_sort(F.filter(labels, lambda x: x.isNotNull())), ",").alias("labels"),
        fingerprint().alias("fingerprint"), license_of().alias("license"), quant_level().alias("quant_level"), F.array_join(tag_values("dataset:"), ",").alias("datasets"), F.array_join(languages(), ",").alias("languages"),
    )
