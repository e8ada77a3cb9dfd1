"""Registered queries over raw hub records made of the facts: extraction, the rules, cleaning, seeding and status, with oracles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..operators import hub, hub_rules
from .catalogue import ORACLES, plan
from .prelude import on_network

# Inputs that records are made of, picked by part key: names, tags, pipeline tags, libraries, licenses, weights and configurations.
NAMES = (
    "llama-7B-instruct", "Mixtral-8x7B-chat-GGUF", "qwen2-coder-AWQ", "phi-3-merge", "gemma-2b-lora", "deepseek-math-7b-rlhf", "command-r-long-context-128k", "yi-vision-34B", "bert-embedding", "falcon-aligned", "stablelm-3b-Q4_K_M", "gpt-synthetic-data",
    "nsfw-classifier", "translator-cpp", "mamba-130M", "python-js-assistant", "typescript-js-helper", "js-typescript-helper", "qlora-adapter-sft", "lora-and-qlora", "legal-law-summarizer", "theorem-prover-lean4", "radiology-qa", "orpo-kto-dpo", "franken-30B-A3B", "distilled-72b-Q2_K", "plain-thing",
)
TAGS = ("en|chat_template|base_model:finetune:meta/base-one", "fr|dataset:alpaca|license:mit", "", "gguf|conversational|vllm", "base_model:some/other|mlx", "base_model:quantized:org/q|awq|onnx", "human-feedback|dataset:own set|EN", "base_model:merge:a/x|base_model:adapter:b/y|license:cc-by-nc-4.0", "tool-use|json mode|coreml", "13b|openvino|cpu-inference", "continual-pretrain|multi-stage-alignment")
PIPELINE_TAGS = ("text-generation", "image-text-to-text", "text-to-image", "text2text-generation", "feature-extraction", "sentence-similarity", "text-classification", "token-classification", "image-classification", "automatic-speech-recognition", "fill-mask", "", "unheard-of")
LIBRARIES = ("transformers", "gguf", "mlx", "diffusers", "sentence-transformers", "", "peft")
LICENSES = ("", "Apache-2.0", "llama3", "other", "cc-by-nc-sa-4.0")
WEIGHTS = ("", '{"total":14000000000}', '{"parameters":{"F16":1500000000,"I8":500000000}}')
CONFIGS = (
    "", '{"architectures":["LlamaForCausalLM"],"model_type":"llama","hidden_size":64,"num_hidden_layers":2,"num_attention_heads":8,"num_key_value_heads":2,"vocab_size":100,"max_position_embeddings":4096,"torch_dtype":"bfloat16"}',
    '{"architectures":["Strange"],"model_type":"mixtral","rope_scaling":{"type":"Yarn"},"quantization_config":{"quant_method":"gptq"}}', '{"model_type":"qwen2","n_positions":32768,"num_attention_heads":4}', '{"architectures":["MambaForCausalLM"],"model_type":"mamba"}',
    '{"model_type":"bert","vocab_size":0}', '{"architectures":["T5ForConditionalGeneration"],"model_type":"t5","rope_scaling":{"rope_type":"dynamic"}}', '{"model_type":"falcon"}',
)


def _pick(values: tuple[str, ...], shift: int = 0) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), ((F.col("p_partkey") + shift) % len(values) + 1).cast("int"))


def _pick_sql(values: tuple[str, ...], shift: int = 0) -> str:
    return "([" + ", ".join(f"'{v}'" for v in values) + f"])[(p_partkey + {shift}) % {len(values)} + 1]"


def hub_records(net: Network) -> DataFrame:
    """A hub record for each entity."""
    tags = F.filter(F.split(_pick(TAGS), r"\|"), lambda t: t != "")
    name = F.concat("p_brand", F.lit("/"), _pick(NAMES), F.lit("-p"), F.col("p_partkey").cast("string"))
    none = lambda c: F.when(c != "", c)
    return net.facts.select(
        name.alias("model_id"), F.lower("word1").alias("author"), _pick(PIPELINE_TAGS).alias("pipeline_tag"), F.when(F.col("p_partkey") % 29 != 0, tags).alias("tags"), _pick(LIBRARIES, 3).alias("library_name"), (F.col("likes") * (F.col("p_partkey") % 40)).alias("likes"),
        (F.col("downloads") * (F.col("p_partkey") % 9)).cast("bigint").alias("downloads"), F.when(F.col("p_partkey") % 6 != 0, F.concat(F.lit("20"), (22 + F.col("p_partkey") % 4).cast("string"), F.lit("-05-01"))).alias("created_at"),
        _pick(LICENSES).alias("license"), none(_pick(WEIGHTS)).alias("safetensors"), none(_pick(CONFIGS)).alias("config"),
    )


HUB = f"""hub AS (SELECT p_brand || '/' || {_pick_sql(NAMES)} || '-p' || p_partkey AS model_id, lower(word1) AS author, {_pick_sql(PIPELINE_TAGS)} AS pipeline_tag, CASE WHEN p_partkey % 29 <> 0 THEN list_filter(string_split({_pick_sql(TAGS)}, '|'), lambda t: t <> '') END AS tags, {_pick_sql(LIBRARIES, 3)} AS library_name,
likes * (p_partkey % 40) AS likes, CAST(downloads * (p_partkey % 9) AS BIGINT) AS downloads, CASE WHEN p_partkey % 6 <> 0 THEN '20' || (22 + p_partkey % 4) || '-05-01' END AS created_at, {_pick_sql(LICENSES)} AS license, nullif({_pick_sql(WEIGHTS)}, '') AS safetensors, nullif({_pick_sql(CONFIGS)}, '') AS config FROM facts)"""

#: The conditions that need looking ahead, which the oracle's expressions can't.
_AHEAD = {"JavaScript-code": r"regexp_matches(regexp_replace(s, '.*typescript', 'x'), '\b(?:javascript|js)\b')", "Java-code": r"regexp_matches(s, '\bjava\b')", "lora-adapted": r"regexp_matches(regexp_replace(s, '.*qlora', 'x'), '\blora\b')"}


def _hit(pattern: str, label: str) -> str:
    return _AHEAD[label] if "(?!" in pattern else f"regexp_matches(s, '{pattern}')"


def _list(pairs: list[tuple[str, str]]) -> str:
    return "list_distinct(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{label}' END" for c, label in pairs) + "], lambda x: x IS NOT NULL))"


def _contains(name: str, *words: str) -> str:
    return "(" + " OR ".join(f"contains({name}, '{w}')" for w in words) + ")"


_FAMILY = "CASE " + " ".join(f"WHEN contains(name || ' ' || author, '{w}') THEN '{a}'" for w, a in hub.FAMILIES) + " END"
_KIND = "CASE " + " ".join(f"WHEN starts_with(t, 'base_model:{k}:') THEN '{r}'" for k, r in hub.TAG_RELATIONS) + " END"
_BY_NAME = f"CASE WHEN {_contains('name', 'gguf', 'gptq', 'awq', 'exl2')} THEN 'quantized_from' WHEN {_contains('name', 'merge', 'franken')} THEN 'merged_from' ELSE 'fine_tuned_from' END"
_TWO = (
    HUB, "tx AS (SELECT *, coalesce(tags, []) AS tg, lower(model_id) AS name, lower(concat_ws(' ', model_id, author, pipeline_tag, array_to_string(coalesce(tags, []), ' '))) AS s, lower(library_name) AS lib FROM hub)",
    f"bm AS (SELECT model_id, trim(CASE WHEN {_KIND} IS NOT NULL THEN regexp_replace(substr(t, 12), '^[^:]*:', '') ELSE substr(t, 12) END) AS target, coalesce({_KIND}, {_BY_NAME}) AS relation FROM (SELECT model_id, name, unnest(tg) AS t FROM tx) WHERE starts_with(t, 'base_model:'))",
    f"c0 AS (SELECT *, model_id IN (SELECT model_id FROM bm) AS derived, {_list([(_hit(p, a), a) for p, a in hub.CAPABILITIES])} AS cap, {_list([(_hit(p, a), a) for p, a in hub.COMPATIBILITIES] + [(_contains('lib', w), a) for w, a in hub.LIBRARIES])} AS plain, {_list([(_hit(p, a), a) for p, a, _ in hub.DOMAINS])} AS dom, {_list([(_hit(p, a), a) for p, a, *_ in hub.METHODS])} AS met, {_list([(_hit(p, a), a) for p, a in hub.TRAINING_DATA])} AS dat,"
    f" greatest(0, {', '.join(f'CASE WHEN {_hit(p, a)} THEN {d} ELSE 0 END' for p, a, d in hub.DOMAINS)}) AS dom_depth, {_FAMILY} AS family, greatest({', '.join(f'CASE WHEN {_hit(p, a)} THEN {d} ELSE 0 END' for p, a, _, d in hub.METHODS)}) AS met_depth FROM tx)",
    f"""c1 AS (SELECT *, list_distinct(list_concat(plain, CASE WHEN list_has_any(plain, ['MLX-compatible', 'CoreML']) THEN ['Apple-Silicon-native'] ELSE [] END)) AS compat, list_filter(tg, lambda t: {_contains('lower(t)', 'chat_template', 'chat-template', 'conversational')}) <> [] AS template,
CASE WHEN derived AND {_contains('name', 'gguf', 'gptq', 'awq', 'exl2')} THEN 'quantized' WHEN derived AND {_contains('name', 'merge', 'franken')} THEN 'merge' WHEN derived THEN 'fine-tune' WHEN NOT {_contains('name', 'instruct', 'chat', 'gguf', 'gptq', 'lora')} THEN 'base-model' END AS role FROM c0)""",
    """two AS (SELECT model_id, unnest(cap) AS label, 'CAPABILITY' AS bank, 0.85::DOUBLE AS confidence FROM c1 UNION ALL SELECT model_id, unnest(compat), 'COMPATIBILITY', 0.9 FROM c1 UNION ALL SELECT model_id, 'chat-template-available', 'COMPATIBILITY', 0.9 FROM c1 WHERE template UNION ALL SELECT model_id, unnest(dom), 'DOMAIN', 0.8 FROM c1
UNION ALL SELECT model_id, family, 'LINEAGE', CASE WHEN derived THEN 0.95 ELSE 0.7 END FROM c1 WHERE family IS NOT NULL UNION ALL SELECT model_id, role, 'LINEAGE', CASE WHEN derived THEN 0.95 ELSE 0.7 END FROM c1 WHERE role IS NOT NULL UNION ALL SELECT model_id, unnest(met), 'TRAINING', 0.85 FROM c1 UNION ALL SELECT model_id, unnest(dat), 'TRAINING', 0.75 FROM c1)""",
)


@plan("tier_two_labels")
def _(net: Network) -> DataFrame:
    return hub.tier_two(hub_records(net)).select("model_id", F.explode("labels").alias("x")).select("model_id", "x.*")


ORACLES["tier_two_labels"] = on_network("SELECT * FROM two", *_TWO)


@plan("tier_two_positions")
def _(net: Network) -> DataFrame:
    return hub.tier_two(hub_records(net)).select("model_id", F.explode("positions").alias("x")).select("model_id", "x.*")


_METHOD_SIGN = "CASE " + " ".join(f"WHEN met_depth = {d} AND {_hit(p, a)} THEN {sign}" for p, a, sign, d in hub.METHODS if d) + " ELSE 0 END"
_PLACES = f"""places2 AS (SELECT model_id, 'CAPABILITY' AS bank, CASE WHEN len(cap) = 1 AND cap[1] IN ('embedding', 'classification') THEN -1 WHEN len(cap) > 0 THEN 1 ELSE 0 END AS sign, least(len(cap), 3)::INT AS depth FROM c1
UNION ALL SELECT model_id, 'COMPATIBILITY', (len(compat) > 0 OR template)::INT, CASE WHEN list_has_any(compat, ['MLX-compatible', 'Apple-Silicon-native', 'TensorRT-compatible']) THEN 3 WHEN list_has_any(compat, ['GGUF-available', 'GPTQ-available', 'AWQ-available', 'EXL2-available']) THEN 2 WHEN len(compat) > 0 THEN 1 ELSE 0 END FROM c1
UNION ALL SELECT model_id, 'LINEAGE', CASE WHEN role = 'base-model' THEN 0 ELSE 1 END, CASE WHEN role IN ('quantized', 'merge') THEN 3 WHEN derived AND {_contains('name', 'lora', 'dpo', 'rlhf', 'sft')} THEN 2 WHEN derived AND {_contains('name', 'instruct', 'chat')} THEN 1 WHEN derived THEN 2 WHEN role = 'base-model' THEN 0 ELSE 1 END FROM c1
UNION ALL SELECT model_id, 'DOMAIN', (len(dom) > 0)::INT, dom_depth FROM c1 UNION ALL SELECT model_id, 'TRAINING', {_METHOD_SIGN}, met_depth FROM c1)"""
ORACLES["tier_two_positions"] = on_network("SELECT * FROM places2", *_TWO, _PLACES)


@plan("base_model_links")
def _(net: Network) -> DataFrame:
    return hub.tier_two(hub_records(net)).select(F.col("model_id").alias("source_id"), F.explode("base_models").alias("x")).select("source_id", F.col("x.target").alias("target_id"), "x.relation")


ORACLES["base_model_links"] = on_network("SELECT model_id AS source_id, target AS target_id, relation FROM bm", *_TWO)


def _table_sql(table: tuple, value: str, field: int) -> str:
    quoted = lambda names: ", ".join(f"'{n}'" for n in names.split())
    return "CASE " + " ".join(f"WHEN {value} IN ({quoted(row[3])}) THEN " + (f"'{row[field]}'" if field == 2 else str(row[field])) for row in table) + " END"


def _arch_sql(field: int, last: str) -> str:
    first, kind = "json_extract_string(config, '$.architectures[0]')", "json_extract_string(config, '$.model_type')"
    return f"coalesce({_table_sql(hub.ARCHITECTURES, first, field)}, {_table_sql(hub.MODEL_TYPES, kind, field)}, {_table_sql(hub.PIPELINES, 'pipeline_tag', field)}, {last})"


@plan("architecture_positions")
def _(net: Network) -> DataFrame:
    return hub.architectures(hub_records(net)).select("model_id", "sign", "depth", F.array_join("labels", ",").alias("labels"))


ORACLES["architecture_positions"] = on_network(f"SELECT model_id, {_arch_sql(0, '0')} AS sign, {_arch_sql(1, '0')} AS depth, {_arch_sql(2, chr(39) + 'unknown' + chr(39))} AS labels FROM hub", HUB)


@plan("config_labels")
def _(net: Network) -> DataFrame:
    return hub.config_labels(hub_records(net))


_LICENSE = "CASE " + " ".join("WHEN lower(trim(license)) IN (" + ", ".join(f"'{n}'" for n in names.split()) + f") THEN '{label}'" for label, names in hub.LICENSES) + " END"
ORACLES["config_labels"] = on_network(f"""SELECT model_id, 'grouped-query-attention' AS label, 'ARCHITECTURE' AS bank FROM hub WHERE CAST(json_extract(config, '$.num_key_value_heads') AS INT) < CAST(json_extract(config, '$.num_attention_heads') AS INT)
UNION ALL SELECT model_id, 'rope-' || lower(coalesce(json_extract_string(config, '$.rope_scaling.type'), json_extract_string(config, '$.rope_scaling.rope_type'))), 'ARCHITECTURE' FROM hub WHERE coalesce(json_extract_string(config, '$.rope_scaling.type'), json_extract_string(config, '$.rope_scaling.rope_type')) IS NOT NULL
UNION ALL SELECT model_id, json_extract_string(config, '$.quantization_config.quant_method') || '-quantized', 'EFFICIENCY' FROM hub WHERE json_extract_string(config, '$.quantization_config.quant_method') IS NOT NULL UNION ALL SELECT model_id, {_LICENSE}, 'COMPATIBILITY' FROM hub WHERE {_LICENSE} IS NOT NULL""", HUB)


_BEFORE_B = r"list_filter(list_transform(regexp_extract_all({0}, '([0-9]*\.?[0-9]*)[bB]', 1), lambda x: try_cast(x AS DOUBLE)), lambda v: v IS NOT NULL AND v BETWEEN 0.1 AND 1000)[1]"
_SIZE = f"""sz AS (SELECT model_id, round(CASE WHEN contains(safetensors, 'parameters') THEN (CAST(json_extract(safetensors, '$.parameters.F16') AS BIGINT) + CAST(json_extract(safetensors, '$.parameters.I8') AS BIGINT)) / 1e9::DOUBLE WHEN contains(safetensors, 'total') THEN CAST(json_extract(safetensors, '$.total') AS BIGINT) / 2 / 1e9::DOUBLE
ELSE coalesce({_BEFORE_B.format('model_id')}, list_filter(list_transform(tags, lambda t: {_BEFORE_B.format('t')}), lambda v: v IS NOT NULL)[1]) END, 2) AS b FROM hub)"""
_QUANT = r"nullif(upper(regexp_extract(model_id, '(?i)(?:^|[-_.])(Q[2-8]_[KS0-9]+(?:_[SML])?|Q[2-8]_0|F16|F32|GPTQ|AWQ|EXL2|GGUF)(?:[-_.]|$)', 1)), '')"
_JSON = lambda key: f"json_extract_string(config, '$.{key}')"
_NUMBER = lambda *keys: "CAST(coalesce(" + ", ".join(f"CASE WHEN CAST(json_extract(config, '$.{k}') AS BIGINT) > 0 THEN CAST(json_extract(config, '$.{k}') AS BIGINT) END" for k in keys) + ") AS VARCHAR)"
_KEYS = {
    "parameter_count_b": ("CAST(b AS VARCHAR)", "float"), "license": ("nullif(coalesce(nullif(license, ''), substr(list_filter(tg, lambda t: starts_with(t, 'license:'))[1], 9)), '')", "str"), "created_at": ("created_at", "datetime"),
    "tags": ("CASE WHEN len(tg) > 0 THEN CAST(to_json(list_sort(tg)) AS VARCHAR) END", "json"), "safetensors_total": ("json_extract_string(safetensors, '$.total')", "int"), "architectures": ("CAST(json_extract(config, '$.architectures') AS VARCHAR)", "json"), "quantization_config": ("CAST(json_extract(config, '$.quantization_config') AS VARCHAR)", "json"),
    "likes": ("CAST(nullif(likes, 0) AS VARCHAR)", "int"), "downloads": ("CAST(nullif(downloads, 0) AS VARCHAR)", "int"), "pipeline_tag": ("nullif(pipeline_tag, '')", "str"), "library_name": ("nullif(library_name, '')", "str"),
    "context_length": (_NUMBER("max_position_embeddings", "max_seq_len", "n_positions", "max_sequence_length", "sliding_window"), "int"), "vocab_size": (_NUMBER("vocab_size"), "int"), "hidden_size": (_NUMBER("hidden_size"), "int"), "num_layers": (_NUMBER("num_hidden_layers"), "int"), "num_heads": (_NUMBER("num_attention_heads"), "int"),
    "num_kv_heads": (_NUMBER("num_key_value_heads"), "int"), "intermediate_size": (_NUMBER("intermediate_size"), "int"), "model_type": (_JSON("model_type"), "str"), "torch_dtype": (_JSON("torch_dtype"), "str"), "structural_fingerprint": ("CASE WHEN contains(config, 'hidden_size') THEN substr(sha256('64:2:8:100'), 1, 16) END", "str"), "quantization_level": (_QUANT, "str"),
    "training_datasets": ("CASE WHEN len(ds) > 0 THEN CAST(to_json(list_sort(ds)) AS VARCHAR) END", "json"), "has_chat_template": (f"CASE WHEN list_filter(tg, lambda t: {_contains('lower(t)', 'chat_template', 'chat-template', 'conversational')}) <> [] THEN 'true' END", "bool"),
    "supported_languages": ("CASE WHEN len(list_filter(tg, lambda t: regexp_full_match(lower(t), '[a-z]{2}'))) > 0 THEN CAST(to_json(list_transform(list_filter(tg, lambda t: regexp_full_match(lower(t), '[a-z]{2}')), lambda t: lower(t))) AS VARCHAR) END", "json"),
}


@plan("record_metadata")
def _(net: Network) -> DataFrame:
    return hub.metadata(hub_records(net))


ORACLES["record_metadata"] = on_network(
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT model_id, '{k}' AS key, {v} AS value, '{t}' AS value_type FROM mx" for k, (v, t) in _KEYS.items()) + ") WHERE value IS NOT NULL", *_TWO[:2], _SIZE,
    f"mx AS (SELECT tx.*, b, list_distinct(list_concat(list_transform(list_filter(tg, lambda t: starts_with(t, 'dataset:')), lambda t: trim(substr(t, 9))), {_list([(_contains('s', w), w) for w in hub.DATASETS])})) AS ds FROM tx JOIN sz USING (model_id))",
)


@plan("hardware_requirements")
def _(net: Network) -> DataFrame:
    return hub.hardware(hub_records(net))


ORACLES["hardware_requirements"] = on_network(f"SELECT model_id, CASE WHEN regexp_matches(coalesce({_QUANT}, ''), 'Q[2345]') THEN CASE WHEN b <= 13 THEN 'consumer-GPU' ELSE 'high-end-GPU' END WHEN b <= 3 THEN 'consumer-GPU' WHEN b <= 13 THEN 'mid-range-GPU' WHEN b <= 70 THEN 'high-end-GPU' ELSE 'multi-GPU' END AS hardware FROM sz WHERE b IS NOT NULL", HUB, _SIZE)


@plan("enrichment_context")
def _(net: Network) -> DataFrame:
    found = hub.enrichment_context(hub_records(net))
    return found.select("model_id", "size", "family", *[F.array_join(F.array_sort(c), ",").alias(c) for c in ("capabilities", "methods")])


ORACLES["enrichment_context"] = on_network("SELECT model_id, coalesce(CAST(b AS VARCHAR) || 'B', 'unknown') AS size, coalesce(family, 'unknown') AS family, array_to_string(list_sort(cap), ',') AS capabilities, array_to_string(list_sort(list_concat(met, dat)), ',') AS methods FROM c1 JOIN sz USING (model_id)", *_TWO, _SIZE)


@plan("canonical_items")
def _(net: Network) -> DataFrame:
    return hub.canonical_items(hub_records(net))


_BUCKET = "CASE WHEN b < 0.5 THEN -3 WHEN b < 1.5 THEN -2 WHEN b < 5 THEN -1 WHEN b < 10 THEN 0 WHEN b < 20 THEN 1 WHEN b < 50 THEN 2 WHEN b < 100 THEN 3 ELSE 4 END"
ORACLES["canonical_items"] = on_network(f"""SELECT 'models' AS "table", model_id AS key, 'display_name' AS field, split_part(model_id, '/', 2) AS value FROM hub UNION ALL SELECT 'models', target, 'display_name', list_last(string_split(target, '/')) FROM (SELECT DISTINCT target FROM bm)
UNION ALL SELECT DISTINCT 'model_links', model_id || '|' || target || '|' || relation, 'weight', '1.0' FROM bm UNION ALL SELECT 'model_positions', model_id || '|' || bank, 'position', CAST(sign * depth AS VARCHAR) FROM places2 UNION ALL SELECT 'model_positions', model_id || '|ARCHITECTURE', 'position', CAST({_arch_sql(0, '0')} * {_arch_sql(1, '0')} AS VARCHAR) FROM hub
UNION ALL SELECT 'model_positions', model_id || '|EFFICIENCY', 'position', CAST({_BUCKET} AS VARCHAR) FROM sz WHERE b IS NOT NULL UNION ALL SELECT 'model_positions', model_id || '|QUALITY', 'position', CAST(CASE WHEN q > 25 THEN 2 WHEN q > 15 THEN 1 WHEN q > 5 THEN 0 WHEN q > 1 THEN -1 ELSE -2 END AS VARCHAR) FROM (SELECT model_id, 2 * ln(1 + likes) + 0.5 * ln(1 + downloads) AS q FROM hub)""", *_TWO, _PLACES, _SIZE)


# --- the rules

def _trigger_sql(kind: str, values: str) -> str:
    v = values.split()
    listed = lambda xs: ", ".join(f"'{x}'" for x in xs)
    return {
        "pipeline": f"pipeline_tag IN ({listed(v)})", "pipeline_in": f"pipeline_tag IN ({listed(v)})", "model_type": f"{_JSON('model_type')} IN ({listed(v)})", "library": f"library_name IN ({listed(v)})", "safetensors": "safetensors IS NOT NULL",
        "quantization": f"{_QUANT} IN ({listed(v)})", "tag": f"len(list_filter(tags, lambda t: regexp_matches(t, '(?i){values}'))) > 0",
        "family_absent": f"NOT coalesce(lower({_JSON('model_type')}) IN ({listed(v[1:])}), FALSE) AND NOT contains(lower(split_part(model_id, '/', 2)), '{v[0] if v else ''}')",
    }[kind]


_RULES_SQL = " UNION ALL ".join(f"SELECT model_id, '{name}' AS rule, {tier} AS tier, string_split('{requires}', ' ') AS requires, string_split('{forbids}', ' ') AS forbids FROM hub WHERE {_trigger_sql(kind, values)}" for name, kind, values, requires, forbids, tier in hub_rules.SPECS)
_JUDGED = (
    f"hf AS ({_RULES_SQL})", "hw AS (SELECT model_id, label, min(tier) AS tier FROM (SELECT model_id, tier, unnest(forbids) AS label FROM hf) WHERE label <> '' GROUP BY ALL)",
    """hv AS (SELECT model_id, label, CASE tier WHEN 1 THEN 'REJECTED' WHEN 2 THEN 'DEMOTED' WHEN 3 THEN 'WARNING' ELSE 'CERTIFIED' END AS verdict, CASE WHEN tier = 2 THEN confidence * 0.5 ELSE confidence END AS confidence FROM two LEFT JOIN hw USING (model_id, label)
UNION ALL SELECT DISTINCT model_id, label, 'AUTO_ADDED', 1.0 FROM (SELECT model_id, unnest(requires) AS label FROM hf) r WHERE label <> '' AND NOT EXISTS (SELECT 1 FROM two t WHERE t.model_id = r.model_id AND t.label = r.label))""",
)


@plan("hub_rules_fired")
def _(net: Network) -> DataFrame:
    return hub_rules.fired(hub_records(net)).select("model_id", "rule", "tier")


@plan("hub_verdicts")
def _(net: Network) -> DataFrame:
    return hub_rules.verdicts(hub_records(net))


@plan("flagged_models")
def _(net: Network) -> DataFrame:
    return hub_rules.flagged(hub_rules.verdicts(hub_records(net)))


ORACLES["hub_rules_fired"] = on_network("SELECT model_id, rule, tier FROM hf", HUB, _JUDGED[0])
ORACLES["hub_verdicts"] = on_network("SELECT * FROM hv", *_TWO, *_JUDGED)
ORACLES["flagged_models"] = on_network("SELECT model_id, count(*) AS rejected FROM hv WHERE verdict = 'REJECTED' GROUP BY model_id", *_TWO, *_JUDGED)

_PROPOSED = ("CHAT", "reasoning", "Python-code", "nothing", "Code-Generation")


@plan("label_bridge")
def _(net: Network) -> DataFrame:
    from .. import vocabulary

    records = hub_records(net)
    proposed = records.select("model_id", F.explode(F.array(*map(F.lit, _PROPOSED))).alias("label"))
    return hub_rules.bridge(records, proposed, vocabulary.anchors(net.models.sparkSession), "CAPABILITY")


ORACLES["label_bridge"] = on_network("""SELECT model_id, label, why IN ('unknown', 'certified') AS kept, why FROM (SELECT h.model_id, v.label, CASE WHEN v.canonical IS NULL THEN 'unknown' WHEN v.bank <> 'CAPABILITY' THEN 'bank' WHEN hw.tier = 1 THEN 'rejected' ELSE 'certified' END AS why
FROM hub h CROSS JOIN (VALUES ('CHAT', 'chat', 'CAPABILITY'), ('reasoning', 'reasoning', 'CAPABILITY'), ('Python-code', 'Python-code', 'DOMAIN'), ('nothing', NULL, NULL), ('Code-Generation', 'code-generation', 'CAPABILITY')) v(label, canonical, bank) LEFT JOIN hw ON hw.model_id = h.model_id AND hw.label = v.canonical)""", HUB, *_JUDGED[:2])
