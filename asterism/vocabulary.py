"""The closed vocabulary that a new network starts with, and its zero states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Labels by bank and category.
VOCABULARY = {
    "ARCHITECTURE": {
        "type": "transformer encoder-only encoder-decoder decoder-only mixture-of-experts mamba rwkv ssm hybrid diffusion vision-transformer",
        "attention": "grouped-query-attention",
        "positional-encoding": "rope-linear rope-dynamic rope-yarn rope-longrope",
    },
    "CAPABILITY": {
        "training": "instruction-following chat",
        "skill": "tool-calling function-calling code-generation code-completion creative-writing reasoning math NER orchestration structured-output embedding classification translation summarization question-answering image-generation image-understanding multimodal time-series schema-following constrained-generation proof-level-math olympiad-math",
        "feature": "long-context",
    },
    "EFFICIENCY": {
        "size": "sub-1B 1B-class 3B-class 7B-class 13B-class 30B-class 70B-class frontier-class",
        "hardware": "consumer-GPU-viable edge-deployable",
        "optimization": "quantized",
        "quantization": "gptq-quantized awq-quantized bnb-quantized",
        "context": "long-context-32k long-context-128k long-context-1m",
    },
    "COMPATIBILITY": {
        "format": "GGUF-available GPTQ-available AWQ-available EXL2-available safetensors ONNX-available",
        "hardware": "Apple-Silicon-native CPU-inference",
        "framework": "OpenVINO CoreML TFLite MLX-compatible llama-cpp-compatible vLLM-compatible TensorRT-compatible transformers-compatible diffusers-compatible",
        "feature": "chat-template-available",
        "license": "commercial-use-allowed research-only llama-license",
    },
    "LINEAGE": {
        "family": "Llama-family Mistral-family Qwen-family Phi-family Gemma-family GPT-family Falcon-family StableLM-family DeepSeek-family Yi-family Command-family",
        "role": "base-model fine-tune merge distillation",
    },
    "DOMAIN": {
        "broad": "code-domain science-domain medical-domain legal-domain finance-domain multilingual creative-domain math-domain",
        "language": "Python-code Rust-code C++-code JavaScript-code TypeScript-code Go-code Java-code",
        "specialization": "systems-programming web-development proof-assistant formal-verification",
    },
    "QUALITY": {
        "signal": "trending high-downloads community-favorite official-release experimental deprecated",
        "benchmark": "high-mmlu strong-humaneval strong-gsm8k safety-tested red-teamed",
    },
    "TRAINING": {
        "method": "sft-trained rlhf-trained dpo-trained ppo-trained orpo-trained kto-trained lora-adapted qlora-adapted adapter-tuned distilled quantization-aware-trained",
        "data": "trained-on-synthetic-data trained-on-human-feedback",
        "process": "multi-stage-alignment curriculum-trained continual-pretrained",
    },
}

# What the origin of each bank means.
ZERO_STATES = {
    "ARCHITECTURE": "standard transformer decoder",
    "CAPABILITY": "general language model",
    "EFFICIENCY": "~7B mainstream",
    "COMPATIBILITY": "standard transformers + PyTorch",
    "LINEAGE": "base/foundational model",
    "DOMAIN": "general knowledge",
    "QUALITY": "established, mainstream adoption",
    "TRAINING": "standard supervised fine-tuning",
}

# Words of a search and the labels they ask for.
WORDS = {
    "instruct": "instruction-following", "instruction": "instruction-following", "chat": "chat", "code": "code-generation", "coder": "code-generation", "tool": "tool-calling", "function": "function-calling", "reason": "reasoning",
    "math": "math", "vision": "image-understanding", "multimodal": "multimodal", "embed": "embedding", "gguf": "GGUF-available", "mlx": "MLX-compatible", "apple": "Apple-Silicon-native", "llama": "Llama-family", "mistral": "Mistral-family",
    "qwen": "Qwen-family", "phi": "Phi-family", "gemma": "Gemma-family", "deepseek": "DeepSeek-family", "medical": "medical-domain", "legal": "legal-domain", "finance": "finance-domain", "science": "science-domain", "rlhf": "rlhf-trained",
    "dpo": "dpo-trained", "lora": "lora-adapted", "sft": "sft-trained", "distill": "distilled",
}


def entries() -> list[tuple[str, str, str, str]]:
    """(id, label, bank, category), the id made of bank and label."""
    return [(f"{bank}:{label}", label, bank, category) for bank, by in VOCABULARY.items() for category, labels in by.items() for label in labels.split()]


def anchors(spark: SparkSession, existing: DataFrame | None = None) -> DataFrame:
    """The starting dictionary; with ``existing``, that one with the labels it lacks."""
    start = spark.createDataFrame(entries(), "anchor_id string, label string, bank string, category string")
    return start if existing is None else existing.unionByName(start.join(existing.select("label"), "label", "left_anti").select(existing.columns))


def migrated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A table with the columns it lacks added as nulls of the given types."""
    return df.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in df.columns})


def mentioned(records: DataFrame, text: str, words: dict[str, str] | None = None) -> DataFrame:
    """(model_id, label) for records whose text holds a word that asks for a label, each pair once."""
    table = words or WORDS
    pairs = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(label).alias("label")) for w, label in table.items()])
    tokens = F.split(F.lower(text), "[^a-z0-9]+")
    return records.select("model_id", F.explode(F.filter(pairs, lambda p: F.array_contains(tokens, p["w"]))).alias("p")).select("model_id", F.col("p.label").alias("label")).distinct()
