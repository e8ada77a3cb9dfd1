"""The certification rules over hub records: eight kinds of triggers, forty-three rules, the filter bridge, flagged models."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import certify
from .hub import quant_level, tier_two


@dataclass(frozen=True)
class Trigger:
    """A kind of condition over a record's facts and its values: pipeline, pipeline_in, model_type, library, tag, safetensors, quantization or family_absent (the family's word, then its model types)."""

    kind: str
    values: tuple[str, ...] = ()

    def holds(self) -> Column:
        v = self.values
        if self.kind in ("pipeline", "pipeline_in"):
            out = F.col("pipeline_tag").isin(*v)
        elif self.kind == "model_type":
            out = F.col("model_type").isin(*v)
        elif self.kind == "library":
            out = F.col("library_name") == v[0]
        elif self.kind == "tag":
            out = F.exists("tags", lambda t: t.rlike(f"(?i){v[0]}"))
        elif self.kind == "safetensors":
            out = F.col("has_safetensors")
        elif self.kind == "quantization":
            out = F.upper("quantization_level") == v[0].upper()
        elif self.kind == "family_absent":
            repository = F.lower(F.regexp_replace("model_id", "^[^/]*/", ""))  # the author says nothing about the family
            out = ~F.coalesce(F.lower("model_type").isin(*v[1:]), F.lit(False)) & ~repository.contains(v[0])
        else:
            raise ValueError(f"unknown kind of trigger: {self.kind}")
        return F.coalesce(out, F.lit(False))


def _rule(name: str, kind: str, values: str, requires: str = "", forbids: str = "", tier: int = 1) -> certify.Rule:
    return certify.Rule(name, tier, Trigger(kind, tuple(values.split())).holds, tuple(requires.split()), tuple(forbids.split()))


#: Labels of programming languages that tasks which don't generate never earn, and those tasks. Fixed values.
CODE_LABELS = "Python-code Rust-code C++-code Java-code JavaScript-code TypeScript-code Go-code SQL-code Ruby-code PHP-code C-code C#-code Kotlin-code Swift-code Scala-code Haskell-code Shell-code"
NOT_GENERATIVE = "sentence-similarity feature-extraction image-classification text-classification token-classification automatic-speech-recognition image-to-text audio-classification zero-shot-classification zero-shot-image-classification object-detection image-segmentation depth-estimation"

# Name, kind of trigger, its values, required labels, forbidden labels, tier.
SPECS = (
    ("pipeline_image_text_to_text", "pipeline", "image-text-to-text", "multimodal image-understanding", "image-generation", 1),
    ("pipeline_text_to_image", "pipeline", "text-to-image", "image-generation", "image-understanding", 1),
    ("pipeline_text_generation_forbids_encoder_only", "pipeline", "text-generation", "", "encoder-only", 1),
    ("pipeline_text2text_requires_encoder_decoder", "pipeline", "text2text-generation", "encoder-decoder", "decoder-only encoder-only", 1),
    ("pipeline_feature_extraction_requires_embedding", "pipeline", "feature-extraction", "embedding", "", 1),
    ("pipeline_sentence_similarity_requires_embedding", "pipeline", "sentence-similarity", "embedding", "", 1),
    ("pipeline_text_classification_requires_classification", "pipeline", "text-classification", "classification", "code-generation creative-writing chat", 1),
    ("pipeline_token_classification_requires_classification", "pipeline", "token-classification", "classification", "chat creative-writing", 1),
    ("pipeline_image_classification_forbids_generative_llm", "pipeline", "image-classification", "", "chat reasoning code-generation creative-writing tool-calling function-calling", 1),
    ("pipeline_automatic_speech_recognition_forbids_generative_llm", "pipeline", "automatic-speech-recognition", "", "chat reasoning code-generation creative-writing", 1),
    ("model_type_qwen2", "model_type", "qwen2 qwen2_moe qwen3 qwen3_moe", "decoder-only grouped-query-attention", "encoder-only encoder-decoder mamba rwkv", 1),
    ("model_type_qwen2_moe", "model_type", "qwen2_moe qwen3_moe", "mixture-of-experts", "", 1),
    ("model_type_llama", "model_type", "llama", "decoder-only", "encoder-only encoder-decoder mamba rwkv mixture-of-experts", 1),
    ("model_type_mistral", "model_type", "mistral", "decoder-only", "encoder-only encoder-decoder mixture-of-experts", 1),
    ("model_type_mixtral", "model_type", "mixtral", "mixture-of-experts decoder-only", "encoder-only encoder-decoder", 1),
    ("model_type_mamba", "model_type", "mamba mamba2", "mamba ssm", "decoder-only encoder-only encoder-decoder", 1),
    ("model_type_rwkv", "model_type", "rwkv rwkv5 rwkv6", "rwkv", "decoder-only encoder-only encoder-decoder mamba", 1),
    ("model_type_encoder_only_bert_family", "model_type", "bert roberta deberta electra albert distilbert", "encoder-only", "decoder-only encoder-decoder chat reasoning code-generation", 1),
    ("model_type_encoder_decoder_t5_family", "model_type", "t5 mt5 byt5 flan_t5 bart mbart marian", "encoder-decoder", "decoder-only encoder-only", 1),
    ("library_gguf", "library", "gguf", "GGUF-available llama-cpp-compatible", "", 1),
    ("library_mlx", "library", "mlx", "Apple-Silicon-native", "", 1),
    ("library_diffusers", "library", "diffusers", "diffusion", "", 1),
    ("library_sentence_transformers", "library", "sentence-transformers", "embedding", "", 1),
    ("safetensors_present", "safetensors", "", "safetensors", "", 1),
    ("quantization_gguf", "quantization", "GGUF", "GGUF-available quantized", "", 1),
    ("quantization_gptq", "quantization", "GPTQ", "GPTQ-available gptq-quantized quantized", "", 1),
    ("quantization_awq", "quantization", "AWQ", "AWQ-available awq-quantized quantized", "", 1),
    ("tag_gguf_variant", "tag", r"(?:^|-|:)gguf(?:$|-|:)", "GGUF-available", "", 2),
    ("tag_gptq_variant", "tag", r"(?:^|-|:)gptq(?:$|-|:)", "GPTQ-available", "", 2),
    ("tag_awq_variant", "tag", r"(?:^|-|:)awq(?:$|-|:)", "AWQ-available", "", 2),
    ("tag_conversational", "tag", r"^conversational$", "chat", "", 2),
    ("lineage_falcon_family_requires_evidence", "family_absent", "falcon falcon falcon_mamba", "", "Falcon-family", 1),
    ("lineage_llama_family_requires_evidence", "family_absent", "llama llama", "", "Llama-family", 1),
    ("lineage_qwen_family_requires_evidence", "family_absent", "qwen qwen2 qwen2_moe qwen3 qwen3_moe", "", "Qwen-family", 1),
    ("lineage_mistral_family_requires_evidence", "family_absent", "mistral mistral mixtral", "", "Mistral-family", 1),
    ("lineage_gemma_family_requires_evidence", "family_absent", "gemma gemma gemma2 gemma3", "", "Gemma-family", 1),
    ("lineage_phi_family_requires_evidence", "family_absent", "phi phi phi3 phi_moe", "", "Phi-family", 1),
    ("lineage_gpt_family_requires_evidence", "family_absent", "gpt gpt2 gpt_neox gpt_bigcode gptj", "", "GPT-family", 1),
    ("lineage_deepseek_family_requires_evidence", "family_absent", "deepseek deepseek deepseek_v2 deepseek_v3 deepseek_vl_v2", "", "DeepSeek-family", 1),
    ("lineage_yi_family_requires_evidence", "family_absent", "yi yi", "", "Yi-family", 1),
    ("lineage_stablelm_family_requires_evidence", "family_absent", "stablelm stablelm stablelm_epoch", "", "StableLM-family", 1),
    ("lineage_command_family_requires_evidence", "family_absent", "command cohere", "", "Command-family", 1),
    ("domain_language_requires_generative_task", "pipeline_in", NOT_GENERATIVE, "", CODE_LABELS, 1),
)
RULES = tuple(_rule(*spec) for spec in SPECS)


def facts(records: DataFrame) -> DataFrame:
    """What the rules look at, whole: model_id, pipeline_tag, library_name, tags, model_type, quantization_level, has_safetensors."""
    tags = F.coalesce("tags", F.array().cast("array<string>"))
    stored = F.coalesce(F.get_json_object("safetensors", "$.total").isNotNull() | F.get_json_object("safetensors", "$.parameters").isNotNull(), F.lit(False))
    return records.select("model_id", "pipeline_tag", "library_name", tags.alias("tags"), F.get_json_object("config", "$.model_type").alias("model_type"), quant_level().alias("quantization_level"), stored.alias("has_safetensors"))


def fired(records: DataFrame, rules: tuple[certify.Rule, ...] = RULES) -> DataFrame:
    return certify.fired_over(facts(records), rules)


def verdicts(records: DataFrame, rules: tuple[certify.Rule, ...] = RULES) -> DataFrame:
    """The verdicts on the labels that the pattern tier gives records, and on what the rules add."""
    untrusted = F.transform("labels", lambda x: F.struct(x["label"].alias("label"), x["confidence"].alias("confidence"), F.lit(False).alias("trusted")))
    return certify.verdicts_by_model(facts(records).select("model_id", certify.fired_numbers(rules).alias("fired")), tier_two(records).select("model_id", untrusted.alias("labels")), rules)


def bridge(records: DataFrame, proposed: DataFrame, vocabulary: DataFrame, bank: str) -> DataFrame:
    """(model_id, label, kept, why) of labels (model_id, label) that an extractor proposes for one bank.

    unknown: in no vocabulary, passed on to be counted as invalid; bank: of another bank, vetoed; rejected: by the rules;
    else certified. Labels are found whatever their case.
    """
    known = F.broadcast(vocabulary.groupBy(F.lower("label").alias("low")).agg(F.min("label").alias("canonical"), F.min("bank").alias("bank")))  # the closed vocabulary
    named = proposed.withColumn("low", F.lower("label")).join(known, "low", "left")
    judged = certify.verdicts_of(fired(records), named.where(F.col("bank") == bank).select("model_id", F.col("canonical").alias("label"), F.lit(0.5).alias("confidence"), F.lit(False).alias("trusted")).distinct()).where("verdict <> 'AUTO_ADDED'")
    verdict = judged.select("model_id", F.col("label").alias("canonical"), "verdict")
    out = named.join(verdict, ["model_id", "canonical"], "left")
    why = F.when(F.col("canonical").isNull(), "unknown").when(F.col("bank") != bank, "bank").when(F.col("verdict") == "REJECTED", "rejected").otherwise("certified")
    return out.select("model_id", "label", why.isin("unknown", "certified").alias("kept"), why.alias("why"))


def flagged(verdicts: DataFrame) -> DataFrame:
    """Models with a rejected label, and how many."""
    return verdicts.where("verdict = 'REJECTED'").groupBy("model_id").agg(F.count(F.lit(1)).alias("rejected"))

