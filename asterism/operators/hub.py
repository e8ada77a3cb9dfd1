"""Raw hub records to positions, labels, links and metadata: the detectors of both extraction tiers as column expressions.

Records have model_id, author, pipeline_tag, tags array<string>, library_name, likes, downloads, created_at, license, and
config and safetensors as JSON strings. Nothing here shuffles: each operator is one projection and an explode.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import extract

# Patterns over the lower-case name, author, pipeline tag and tags, and the labels that they show.
CAPABILITIES = (
    (r"\binstruct", "instruction-following"),
    (r"\bchat\b", "chat"),
    (r"\btool[\s_.-]?(?:call|use)", "tool-calling"),
    (r"\bfunction[\s_.-]?call", "function-calling"),
    (r"\bcode\b", "code-generation"),
    (r"\breason", "reasoning"),
    (r"\bmath\b", "math"),
    (r"\bner\b", "NER"),
    (r"\bembedd?ing", "embedding"),
    (r"\bclassif", "classification"),
    (r"\btranslat", "translation"),
    (r"\bsummar", "summarization"),
    (r"\bqa\b|\bquestion[\s_.-]?answer", "question-answering"),
    (r"\bvision\b|\bimage[\s_.-]?understand|\bvlm\b", "image-understanding"),
    (r"\bmultimodal\b", "multimodal"),
    (r"\blong[\s_.-]?context\b|\b\d+k\b", "long-context"),
    (r"\bstruct\w*?[\s_.-]?output\b|\bjson\b", "structured-output"),
    (r"json[\s_-]?mode|structured[\s_-]?output|json[\s_-]?schema", "schema-following"),
    (r"\boutlines\b|\bguidance\b|\blmql\b|grammar[\s_-]?constrained", "constrained-generation"),
    (r"theorem[\s_-]?prov|formal[\s_-]?math|lean4?|coq|isabelle", "proof-level-math"),
    (r"olympiad|competition[\s_-]?math|imo|aime|putnam", "olympiad-math"),
)
# Fixed values.
COMPATIBILITIES = (
    (r"\bgguf\b", "GGUF-available"),
    (r"\bgptq\b", "GPTQ-available"),
    (r"\bawq\b", "AWQ-available"),
    (r"\bexl2\b", "EXL2-available"),
    (r"\bonnx\b", "ONNX-available"),
    (r"\bsafetensors\b", "safetensors"),
    (r"\bmlx\b", "MLX-compatible"),
    (r"\bllama[._-]?cpp\b", "llama-cpp-compatible"),
    (r"\bvllm\b", "vLLM-compatible"),
    (r"\btensorrt\b", "TensorRT-compatible"),
    (r"\btransformers\b", "transformers-compatible"),
    (r"\bdiffusers\b", "diffusers-compatible"),
    (r"\bopenvino\b", "OpenVINO"),
    (r"\bcoreml\b|\bcore[\s_-]ml\b", "CoreML"),
    (r"\btflite\b|\btensorflow[\s_-]lite\b", "TFLite"),
    (r"\bcpu[\s_-]?(?:inference|optimized|only)\b", "CPU-inference"),
    (r"\bapple[\s_-]?silicon\b", "Apple-Silicon-native"),
    (r"\bmetal[\s_-]?performance[\s_-]?shaders\b", "Apple-Silicon-native"),
    (r"\bmps[\s_-]?(?:backend|inference)\b", "Apple-Silicon-native"),
)
# Library names and what they show; labels that imply Apple silicon; labels by how specific they are.
LIBRARIES = (("gguf", "GGUF-available"), ("mlx", "MLX-compatible"), ("transformers", "transformers-compatible"), ("diffusers", "diffusers-compatible"))
APPLE = ("MLX-compatible", "CoreML")
HARDWARE = ("MLX-compatible", "Apple-Silicon-native", "TensorRT-compatible")
FORMATS = ("GGUF-available", "GPTQ-available", "AWQ-available", "EXL2-available")
# Pattern, label, depth.
DOMAINS = (
    (r"\bcode\b|\bcoder\b", "code-domain", 1),
    (r"\bmedic|\bclinical\b|\bbiomed", "medical-domain", 1),
    (r"\blegal\b|\blaw\b", "legal-domain", 1),
    (r"\bfinanc", "finance-domain", 1),
    (r"\bscien|\bchemist|\bphysic|\bbio\b", "science-domain", 1),
    (r"\bmath\b|\barithm", "math-domain", 1),
    (r"\bmultilingual\b|\btranslat", "multilingual", 1),
    (r"\bcreat(?:iv|ion)|\bstory|\bpoet|\broleplay", "creative-domain", 1),
    (r"\bpython\b|\bpy\b", "Python-code", 2),
    (r"\brust\b", "Rust-code", 2),
    (r"\bc\+\+|\bcpp\b", "C++-code", 2),
    (r"\b(?:javascript|js)\b(?!.*typescript)", "JavaScript-code", 2),
    (r"\btypescript\b", "TypeScript-code", 2),
    (r"\b(?:golang|go-lang)\b", "Go-code", 2),
    (r"\bjava\b(?!script)", "Java-code", 2),
    (r"\bradiol|\bpathol", "medical-domain", 2),
    (r"\bsystems[\s_-]?program", "systems-programming", 2),
    (r"\bweb[\s_-]?dev", "web-development", 2),
    (r"\bproof[\s_-]?assist|\blean4?\b|\bcoq\b|\bisabelle\b", "proof-assistant", 2),
    (r"\bformal[\s_-]?verif", "formal-verification", 2),
)
# Pattern, label, sign, depth.
METHODS = (
    (r"\brlhf\b", "rlhf-trained", 1, 2),
    (r"\bdpo\b", "dpo-trained", 1, 1),
    (r"\bppo\b", "ppo-trained", 1, 2),
    (r"\borpo\b", "orpo-trained", 1, 1),
    (r"\bkto\b", "kto-trained", 1, 1),
    (r"\bsft\b|\bsupervised[\s_-]?fine[\s_-]?tun", "sft-trained", 0, 0),
    (r"\blora\b(?!.*qlora)", "lora-adapted", -1, 1),
    (r"\bqlora\b", "qlora-adapted", -1, 1),
    (r"\badapter\b", "adapter-tuned", -1, 1),
    (r"\bdistill", "distilled", -1, 2),
    (r"\bquantization[\s_-]?aware", "quantization-aware-trained", -1, 2),
    (r"\bmulti[\s_-]?stage[\s_-]?align", "multi-stage-alignment", 1, 3),
    (r"\bcurriculum", "curriculum-trained", 1, 2),
    (r"\bcontinual[\s_-]?pre[\s_-]?train", "continual-pretrained", 0, 1),
    (r"\balign(?:ed|ment)\b", "rlhf-trained", 1, 1),
)
# Fixed values.
TRAINING_DATA = ((r"\bsynthetic[\s_-]?data\b", "trained-on-synthetic-data"), (r"\bhuman[\s_-]?feedback\b", "trained-on-human-feedback"))
DATASETS = "alpaca sharegpt orca dolly oasst openassistant ultrachat wildchat capybara slimorca hermes platypus wizard evol-instruct metamath gsm8k code-feedback magicoder openhermes deita".split()
# The first of these words in name or author names the family.
FAMILIES = (
    ("llama", "Llama-family"), ("mistral", "Mistral-family"), ("mixtral", "Mistral-family"), ("qwen", "Qwen-family"), ("phi", "Phi-family"), ("gemma", "Gemma-family"),
    ("gpt", "GPT-family"), ("falcon", "Falcon-family"), ("stablelm", "StableLM-family"), ("deepseek", "DeepSeek-family"), ("yi", "Yi-family"), ("command", "Command-family"),
)
# Kinds of base-model tags and the relations they stand for.
TAG_RELATIONS = (("finetune", "fine_tuned_from"), ("adapter", "fine_tuned_from"), ("merge", "merged_from"), ("quantized", "quantized_from"))
# Architecture classes by sign, depth and labels.
ARCHITECTURES = (
    (-1, 1, "encoder-only", "BertModel RobertaModel AlbertModel DistilBertModel XLNetModel ElectraModel"),
    (-1, 1, "encoder-decoder", "T5ForConditionalGeneration BartForConditionalGeneration MarianMTModel"),
    (0, 0, "decoder-only", "LlamaForCausalLM MistralForCausalLM GPT2LMHeadModel GPTNeoForCausalLM GPTNeoXForCausalLM GPTJForCausalLM Qwen2ForCausalLM PhiForCausalLM Phi3ForCausalLM GemmaForCausalLM Gemma2ForCausalLM FalconForCausalLM StableLmForCausalLM OPTForCausalLM BloomForCausalLM"),
    (1, 2, "mamba,ssm", "MambaForCausalLM"),
    (1, 2, "rwkv", "RwkvForCausalLM"),
    (1, 1, "mixture-of-experts", "MixtralForCausalLM DbrxForCausalLM"),
    (1, 2, "diffusion", "StableDiffusionPipeline"),
    (1, 1, "vision-transformer", "CLIPModel ViTModel"),
)
# Model types, for classes that aren't known.
MODEL_TYPES = (
    (0, 0, "decoder-only", "llama mistral gpt2 gpt_neo gpt_neox qwen2 phi phi3 gemma gemma2 falcon opt bloom"),
    (-1, 1, "encoder-decoder", "t5 bart"),
    (-1, 1, "encoder-only", "bert roberta"),
    (1, 2, "mamba,ssm", "mamba"),
    (1, 2, "rwkv", "rwkv"),
    (1, 1, "mixture-of-experts", "mixtral"),
    (1, 1, "vision-transformer", "clip vit"),
)
# Pipeline tags, for types that aren't known.
PIPELINES = (
    (0, 0, "decoder-only", "text-generation"),
    (-1, 1, "encoder-decoder", "text2text-generation translation summarization automatic-speech-recognition"),
    (1, 1, "vision-transformer", "object-detection image-classification"),
    (1, 2, "diffusion", "text-to-image"),
    (-1, 1, "encoder-only", "fill-mask token-classification sentence-similarity"),
)
# Licenses and what they allow.
LICENSES = (
    ("commercial-use-allowed", "apache-2.0 mit bsd-2-clause bsd-3-clause openrail openrail++ cc-by-4.0"),
    ("research-only", "cc-by-nc-4.0 cc-by-nc-sa-4.0 cc-by-nc-nd-4.0 cc-by-nc-3.0 cc-by-nc-sa-3.0"),
    ("llama-license", "llama3.1 llama3 llama3.2 llama2"),
)
#: Confidence of labels by where they come from. Fixed values.
CONFIDENCE = {"CAPABILITY": 0.85, "COMPATIBILITY": 0.90, "DOMAIN": 0.80, "TRAINING": 0.85, "TRAINING_DATA": 0.75, "LINEAGE_TAG": 0.95, "LINEAGE_NAME": 0.70}


def searchable() -> Column:
    """What patterns look at: name, author, pipeline tag and tags in lower case."""
    return F.lower(F.concat_ws(" ", F.coalesce("model_id", F.lit("")), F.coalesce("author", F.lit("")), F.coalesce("pipeline_tag", F.lit("")), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " ")))


def _some(pairs: list[tuple[Column, str]]) -> Column:
    """The labels whose conditions hold, each once, in order."""
    made = F.array(*[F.when(c, F.lit(label)) for c, label in pairs]).cast("array<string>")
    return F.array_distinct(F.filter(made, lambda x: x.isNotNull()))


def _any(name: Column, *words: str) -> Column:
    return reduce(lambda a, w: a | name.contains(w), words, F.lit(False))


def _named(value: Column, table: tuple, at: int) -> Column:
    """A field of the row of a (sign, depth, labels, names) table that has the value; null without one."""
    return F.coalesce(*[F.when(value.isin(*row[3].split()), F.lit(row[at])) for row in table])


def architecture() -> list[Column]:
    """Sign, depth and labels: of the first class, else the model type, else the pipeline tag, else the origin and unknown."""
    first, kind = F.get_json_object("config", "$.architectures[0]"), F.get_json_object("config", "$.model_type")
    found = [F.coalesce(_named(first, ARCHITECTURES, at), _named(kind, MODEL_TYPES, at), _named(F.col("pipeline_tag"), PIPELINES, at)) for at in range(3)]
    return [F.coalesce(found[0], F.lit(0)), F.coalesce(found[1], F.lit(0)), F.split(F.coalesce(found[2], F.lit("unknown")), ",")]


def architectures(records: DataFrame) -> DataFrame:
    """(model_id, sign, depth, labels) on the ARCHITECTURE bank."""
    sign, depth, labels = architecture()
    return records.select("model_id", sign.alias("sign"), depth.alias("depth"), labels.alias("labels"))


def config_labels(records: DataFrame) -> DataFrame:
    """(model_id, label, bank) that a configuration or license shows: grouped attention, kind of rotary scaling, quantization, license class."""
    heads, groups = extract.config_number("num_attention_heads"), extract.config_number("num_key_value_heads")
    rope = F.lower(F.coalesce(F.get_json_object("config", "$.rope_scaling.type"), F.get_json_object("config", "$.rope_scaling.rope_type")))
    quantized = F.get_json_object("config", "$.quantization_config.quant_method")
    given = F.lower(F.trim(F.coalesce("license", F.lit(""))))
    allowed = F.coalesce(*[F.when(given.isin(*names.split()), F.lit(label)) for label, names in LICENSES])
    entry = lambda label, bank: F.struct(label.alias("label"), F.lit(bank).alias("bank"))
    made = F.array(
        entry(F.when(groups < heads, F.lit("grouped-query-attention")), "ARCHITECTURE"), entry(F.concat(F.lit("rope-"), rope), "ARCHITECTURE"),
        entry(F.concat(quantized, F.lit("-quantized")), "EFFICIENCY"), entry(allowed, "COMPATIBILITY"),
    )
    return records.select("model_id", F.explode(made).alias("x")).where("x.label is not null").select("model_id", "x.*")


def quant_level() -> Column:
    """The quantization that a name states, in capitals."""
    found = F.upper(F.regexp_extract("model_id", r"(?i)(?:^|[-_.])(Q[2-8]_[KS0-9]+(?:_[SML])?|Q[2-8]_0|F16|F32|GPTQ|AWQ|EXL2|GGUF)(?:[-_.]|$)", 1))
    return F.when(found != "", found)


def base_models() -> Column:
    """Array of (target, relation): every base-model tag, with the relation that it or the name states."""
    name = F.lower("model_id")
    by_name = F.when(_any(name, "gguf", "gptq", "awq", "exl2"), "quantized_from").when(_any(name, "merge", "franken"), "merged_from").otherwise("fine_tuned_from")

    def parsed(tag: Column) -> Column:
        rest = F.substring(tag, len("base_model:") + 1, 1 << 20)
        kind, after = F.substring_index(rest, ":", 1), F.regexp_replace(rest, "^[^:]*:", "")
        known = F.coalesce(*[F.when(rest.contains(":") & (kind == k), F.lit(relation)) for k, relation in TAG_RELATIONS])
        return F.struct(F.trim(F.when(known.isNotNull(), after).otherwise(rest)).alias("target"), F.coalesce(known, by_name).alias("relation"))

    return F.transform(F.filter("tags", lambda t: t.startswith("base_model:")), parsed)


def tier_two(records: DataFrame) -> DataFrame:
    """(model_id, labels, positions, base_models): what names and tags show.

    labels are (label, bank, confidence), positions (bank, sign, depth) of CAPABILITY, COMPATIBILITY, LINEAGE, DOMAIN and
    TRAINING. Null tags count as none.
    """
    rows = records.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumns({"__s": searchable(), "__name": F.lower("model_id"), "__base": base_models()})
    s, name, library = F.col("__s"), F.col("__name"), F.lower(F.coalesce("library_name", F.lit("")))
    compatible = _some([(s.rlike(p), a) for p, a in COMPATIBILITIES] + [(library.contains(w), a) for w, a in LIBRARIES])
    rows = rows.withColumns({
        "__cap": _some([(s.rlike(p), a) for p, a in CAPABILITIES]),
        "__compat": F.array_distinct(F.concat(compatible, F.when(F.arrays_overlap(compatible, F.array(*map(F.lit, APPLE))), F.array(F.lit("Apple-Silicon-native"))).otherwise(F.array().cast("array<string>")))),
        "__domain": _some([(s.rlike(p), a) for p, a, _ in DOMAINS]), "__domain_depth": F.greatest(F.lit(0), *[F.when(s.rlike(p), d) for p, _, d in DOMAINS]),
        "__method": _some([(s.rlike(p), a) for p, a, *_ in METHODS]), "__data": _some([(s.rlike(p), a) for p, a in TRAINING_DATA]),
        # the first of the deepest methods gives the sign
        "__training": F.coalesce(F.array_min(F.filter(F.array(*[F.when(s.rlike(p) & (d > 0), F.struct(F.lit(-d).alias("d"), F.lit(k).alias("k"), F.lit(sign).alias("sign"))) for k, (p, _, sign, d) in enumerate(METHODS) if d]), lambda x: x.isNotNull())), F.struct(F.lit(0).alias("d"), F.lit(0).alias("k"), F.lit(0).alias("sign"))),
        "__family": F.coalesce(*[F.when(F.concat_ws(" ", name, F.lower(F.coalesce("author", F.lit("")))).contains(w), F.lit(a)) for w, a in FAMILIES]),
    })
    derived, size = F.size("__base") > 0, F.size("__cap")
    role = (
        F.when(derived & _any(name, "gguf", "gptq", "awq", "exl2"), "quantized").when(derived & _any(name, "merge", "franken"), "merge").when(derived, "fine-tune")
        .when(~_any(name, "instruct", "chat", "gguf", "gptq", "lora"), "base-model")
    )
    depth = F.when(role.isin("quantized", "merge"), 3).when(derived & _any(name, "lora", "dpo", "rlhf", "sft"), 2).when(derived & _any(name, "instruct", "chat"), 1).when(derived, 2).when(role == "base-model", 0).otherwise(1)
    template = F.exists("tags", lambda t: _any(F.lower(t), "chat_template", "chat-template", "conversational"))
    entries = lambda labels, bank, confidence: F.transform(labels, lambda x: F.struct(x.alias("label"), F.lit(bank).alias("bank"), confidence.alias("confidence")))
    compat = F.concat("__compat", F.when(template, F.array(F.lit("chat-template-available"))).otherwise(F.array().cast("array<string>")))
    lineage = F.filter(F.array(F.col("__family"), role), lambda x: x.isNotNull())
    labels = F.concat(
        entries(F.col("__cap"), "CAPABILITY", F.lit(CONFIDENCE["CAPABILITY"])), entries(compat, "COMPATIBILITY", F.lit(CONFIDENCE["COMPATIBILITY"])), entries(F.col("__domain"), "DOMAIN", F.lit(CONFIDENCE["DOMAIN"])),
        entries(lineage, "LINEAGE", F.when(derived, CONFIDENCE["LINEAGE_TAG"]).otherwise(CONFIDENCE["LINEAGE_NAME"])), entries(F.col("__method"), "TRAINING", F.lit(CONFIDENCE["TRAINING"])), entries(F.col("__data"), "TRAINING", F.lit(CONFIDENCE["TRAINING_DATA"])),
    )
    narrow = (size == 1) & F.get("__cap", F.lit(0)).isin("embedding", "classification")
    specific = F.when(F.arrays_overlap("__compat", F.array(*map(F.lit, HARDWARE))), 3).when(F.arrays_overlap("__compat", F.array(*map(F.lit, FORMATS))), 2).when(F.size("__compat") > 0, 1).otherwise(0)
    place = lambda bank, sign, depth: F.struct(F.lit(bank).alias("bank"), sign.cast("int").alias("sign"), depth.cast("int").alias("depth"))
    positions = F.array(
        place("CAPABILITY", F.when(narrow, -1).when(size > 0, 1).otherwise(0), F.least(size, F.lit(3))), place("COMPATIBILITY", (F.size(compat) > 0).cast("int"), specific),
        place("LINEAGE", F.when(role == "base-model", 0).otherwise(1), depth), place("DOMAIN", (F.size("__domain") > 0).cast("int"), F.col("__domain_depth")), place("TRAINING", F.col("__training.sign"), -F.col("__training.d")),
    )
    return rows.select("model_id", labels.alias("labels"), positions.alias("positions"), F.col("__base").alias("base_models"))


def metadata(records: DataFrame) -> DataFrame:
    """(model_id, key, value, value_type): facts of a record that are there; zero counts and empty texts aren't."""
    rows = records.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>"))).withColumn("__s", searchable())
    text = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    count = lambda c: F.when(c.cast("bigint") != 0, c.cast("bigint").cast("string"))
    number = lambda *keys: extract.config_number(*keys).cast("string")
    listed = lambda c: F.when(F.size(c) > 0, F.to_json(c))
    tag = F.get(F.filter("tags", lambda t: t.startswith("license:")), F.lit(0))
    datasets = F.array_union(F.transform(F.filter("tags", lambda t: t.startswith("dataset:")), lambda t: F.trim(F.substring(t, 9, 1 << 20))), _some([(F.col("__s").contains(w), w) for w in DATASETS]))
    languages = F.transform(F.filter("tags", lambda t: F.lower(t).rlike("^[a-z]{2}$")), lambda t: F.lower(t))
    template = F.exists("tags", lambda t: _any(F.lower(t), "chat_template", "chat-template", "conversational"))
    facts = [
        ("parameter_count_b", F.round(extract.parameters(), 2).cast("string"), "float"), ("license", text(F.coalesce(text(F.col("license")), F.regexp_replace(tag, "^license:", ""))), "str"), ("created_at", text(F.col("created_at")), "datetime"),
        ("tags", listed(F.array_sort("tags")), "json"), ("safetensors_total", count(F.get_json_object("safetensors", "$.total").try_cast("bigint")), "int"), ("architectures", F.get_json_object("config", "$.architectures"), "json"), ("quantization_config", F.get_json_object("config", "$.quantization_config"), "json"),
        ("likes", count(F.col("likes")), "int"), ("downloads", count(F.col("downloads")), "int"), ("pipeline_tag", text(F.col("pipeline_tag")), "str"), ("library_name", text(F.col("library_name")), "str"),
        ("context_length", number("max_position_embeddings", "max_seq_len", "n_positions", "max_sequence_length", "sliding_window"), "int"), ("vocab_size", number("vocab_size"), "int"), ("hidden_size", number("hidden_size"), "int"), ("num_layers", number("num_hidden_layers"), "int"),
        ("num_heads", number("num_attention_heads"), "int"), ("num_kv_heads", number("num_key_value_heads"), "int"), ("intermediate_size", number("intermediate_size"), "int"), ("model_type", text(F.get_json_object("config", "$.model_type")), "str"),
        ("torch_dtype", text(F.get_json_object("config", "$.torch_dtype")), "str"), ("structural_fingerprint", extract.fingerprint(), "str"), ("quantization_level", quant_level(), "str"),
        ("training_datasets", listed(F.array_sort(datasets)), "json"), ("has_chat_template", F.when(template, "true"), "bool"), ("supported_languages", listed(languages), "json"),
    ]
    made = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value"), F.lit(t).alias("value_type")) for k, v, t in facts])
    return rows.select("model_id", F.explode(made).alias("x")).where("x.value is not null").select("model_id", "x.*")


def hardware(records: DataFrame) -> DataFrame:
    """(model_id, hardware): what a model needs to run, from its size and quantization; records of unknown size have none."""
    size, few = F.round(extract.parameters(), 2), F.coalesce(quant_level().rlike("Q[2345]"), F.lit(False))
    need = F.when(few, F.when(size <= 13, "consumer-GPU").otherwise("high-end-GPU")).when(size <= 3, "consumer-GPU").when(size <= 13, "mid-range-GPU").when(size <= 70, "high-end-GPU").otherwise("multi-GPU")
    return records.where(size.isNotNull()).select("model_id", need.alias("hardware"))


def enrichment_context(records: DataFrame) -> DataFrame:
    """(model_id, size, family, capabilities, methods): what a prompt is told of a model; the last family counts."""
    of = lambda bank: F.transform(F.filter("labels", lambda x: x["bank"] == bank), lambda x: x["label"])
    family = F.get(F.reverse(F.filter(of("LINEAGE"), lambda x: x.endswith("-family"))), F.lit(0))
    sizes = records.select("model_id", F.round(extract.parameters(), 2).alias("__b"))
    rows = tier_two(records).join(sizes, "model_id")
    return rows.select("model_id", F.coalesce(F.concat(F.col("__b").cast("string"), F.lit("B")), F.lit("unknown")).alias("size"), F.coalesce(family, F.lit("unknown")).alias("family"), of("CAPABILITY").alias("capabilities"), of("TRAINING").alias("methods"))


def canonical_items(records: DataFrame) -> DataFrame:
    """(table, key, field, value): the rows that extraction wants to exist, as upserts: models, positions, stubs of base models, links."""
    two = tier_two(records)
    models = records.select(F.lit("models").alias("table"), F.col("model_id").alias("key"), F.lit("display_name").alias("field"), F.substring_index("model_id", "/", -1).alias("value"))
    arch_sign, arch_depth, _ = architecture()
    bank = lambda name, sign, depth: F.struct(F.lit(name).alias("bank"), sign.cast("int").alias("sign"), depth.cast("int").alias("depth"))
    params, score = extract.parameters(), 2 * F.log1p(F.coalesce("likes", F.lit(0)).cast("double")) + 0.5 * F.log1p(F.coalesce("downloads", F.lit(0)).cast("double"))
    first = records.select("model_id", F.explode(F.array(bank("ARCHITECTURE", arch_sign, arch_depth), F.when(params.isNotNull(), bank("EFFICIENCY", extract.bucket(params, 2), extract.bucket(params, 3))), bank("QUALITY", extract.quality(score, 1), extract.quality(score, 2)))).alias("p")).where("p is not null")
    places = first.union(two.select("model_id", F.explode("positions").alias("p")))
    positions = places.select(F.lit("model_positions").alias("table"), F.concat_ws("|", "model_id", "p.bank").alias("key"), F.lit("position").alias("field"), (F.col("p.sign") * F.col("p.depth")).cast("string").alias("value"))
    bases = two.select("model_id", F.explode("base_models").alias("b"))
    stubs = bases.select("b.target").distinct().join(records.select(F.col("model_id").alias("target")), "target", "left_anti").select(F.lit("models").alias("table"), F.col("target").alias("key"), F.lit("display_name").alias("field"), F.substring_index("target", "/", -1).alias("value"))
    links = bases.select(F.lit("model_links").alias("table"), F.concat_ws("|", "model_id", "b.target", "b.relation").alias("key"), F.lit("weight").alias("field"), F.lit("1.0").alias("value")).distinct()
    return models.union(positions).union(stubs).union(links)
