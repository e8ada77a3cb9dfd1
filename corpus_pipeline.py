"""A training-data pipeline over ``documents``: quality, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. ``run`` writes each stage's rows to the
shared folder and reads them again for the next, so a lost executor costs no earlier stage. A stage begins by deleting what
earlier ones left in the scratch folder and nothing can read any more.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterism.llm import packing, pii, quality, simhash, suffix_dedup
from asterism.llm.common import materialize, sweep


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the document rules, of hosts that pass theirs."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of texts that share 0.8 or more of their 5-word shingles."""
    return simhash.keep_first(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document with a smaller id has, and with n_chars anew."""
    sweep(spark)
    cut = suffix_dedup.remove_repeats(docs, keep=docs.columns, with_text=True)
    return _recounted(cut).select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and with n_chars anew."""
    sweep(spark)
    return _recounted(pii.mask_documents(docs)).select(docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences that the documents pack into."""
    sweep(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def _recounted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packed", packed),
]

#: Fingerprints, suffix arrays, the model and the tokenizer can't be expressed in SQL; tests hold ``run`` against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
