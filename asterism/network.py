"""The semantic network as named DataFrames, and its derivation from the driver's star schema.

Tables that several plans share are written once for each input folder to the warehouse-independent scratch folder and
read back, so every plan starts from pruned Parquet scans with statistics instead of recomputing joins.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Network:
    models: DataFrame
    positions: DataFrame
    anchors: DataFrame
    model_anchors: DataFrame
    links: DataFrame
    metadata: DataFrame
    facts: DataFrame

    def save(self, path: str) -> None:
        for name in self.__dataclass_fields__:
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Network:
        return cls(*(spark.read.parquet(f"{path}/{name}") for name in cls.__dataclass_fields__))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and the executors share; a temporary one only in local mode without spark.checkpoint.dir."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="asterism-")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once to the shared folder and read back; removed when the driver's Python ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/asterism-{uuid.uuid4().hex}-{tag}"
    df.write.parquet(path)

    def clean() -> None:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the JVM may have gone before this hook runs
            pass
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)

    atexit.register(clean)
    return spark.read.schema(df.schema).parquet(path)


def steps(value: Column, cuts: list[float], lowest: int) -> Column:
    """``lowest`` plus the number of cuts that the value has reached."""
    return reduce(lambda acc, c: acc + (value >= c).cast("int"), cuts, F.lit(lowest))


def part_stats(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_partkey").agg(
        F.countDistinct("l_orderkey").alias("n_orders"),
        F.sum("l_quantity").alias("qty"),
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("ret"),
        F.countDistinct("l_suppkey").alias("n_supp"),
    )


def derive(spark: SparkSession, sf_dir: str) -> Network:
    """A network of parts: labels from their attributes and sales, coordinates from cuts, edges from neighbouring order lines."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    lineitem = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag")
    words = F.split("p_name", " ")
    facts = part.join(part_stats(lineitem), part["p_partkey"] == F.col("l_partkey"), "left").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("model_id"),
        F.col("p_partkey"), F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size"),
        words[0].alias("word1"), words[1].alias("word2"),
        F.coalesce("n_orders", F.lit(0)).cast("bigint").alias("likes"), F.coalesce("qty", F.lit(0.0)).alias("downloads"),
        F.coalesce("ret", F.lit(0.0)).alias("ret"), F.coalesce("n_supp", F.lit(0)).cast("bigint").alias("n_supp"),
        (F.col("p_size") / 10.0).alias("params_b"),
        (1.0 - (F.col("p_size") % 5) / 20.0).alias("certification"),
        *[F.when(F.col("p_size") % 3 != 0, ((F.col("p_partkey") * k) % 21 - 10) / 10.0).alias(f"vibe_{a}") for k, a in ((1, "e"), (3, "p"), (7, "a"))],
    )
    facts = stored(facts, "facts")
    models = facts.select("model_id", F.col("p_brand").alias("author"), F.col("p_type").alias("source"), F.col("p_name").alias("display_name"))
    size_class = F.concat(F.lit("size-"), steps(F.col("p_size"), [5, 10, 20, 30, 40, 45], 1).cast("string"))

    def label(text: Column, bank: str, category: str, confidence: float, when: Column | None = None) -> Column:
        made = F.struct(text.alias("label"), F.lit(bank).alias("bank"), F.lit(category).alias("category"), F.lit(confidence).alias("confidence"))
        return made if when is None else F.when(when, made)

    emitted = F.array(
        label(F.col("p_brand"), "LINEAGE", "family", 0.95), label(F.col("p_type"), "CAPABILITY", "skill", 0.85),
        label(F.col("word1"), "DOMAIN", "broad", 0.8), label(F.col("word2"), "ARCHITECTURE", "type", 0.8), label(size_class, "EFFICIENCY", "size", 1.0),
        label(F.lit("high-volume"), "QUALITY", "popularity", 0.5, F.col("downloads") > 800),
        label(F.lit("multi-supplier"), "COMPATIBILITY", "supply", 0.5, F.col("n_supp") >= 24),
        label(F.lit("return-prone"), "TRAINING", "returns", 0.5, F.col("ret") > 0.4),
    )
    labelled = facts.select("model_id", F.explode(emitted).alias("x")).where("x is not null and x.label is not null").select("model_id", "x.*")
    identity = F.concat_ws(":", "bank", "label")
    model_anchors = stored(labelled.select("model_id", identity.alias("anchor_id"), "label", "bank", "category", "confidence"), "model-anchors")
    orphan = spark.sql("SELECT 'QUALITY:orphan-label' AS anchor_id, 'orphan-label' AS label, 'QUALITY' AS bank, 'none' AS category")
    anchors = stored(model_anchors.select("anchor_id", "label", "bank", "category").distinct().union(orphan), "anchors")
    popularity = 2 * F.log1p(F.col("likes").cast("double")) + 0.5 * F.log1p("downloads")
    places = F.array(*[
        F.struct(F.lit(bank).alias("bank"), v.cast("int").alias("v"))
        for bank, v in (
            ("EFFICIENCY", F.when(F.col("p_size") % 7 != 0, steps(F.col("p_size"), [5, 10, 20, 30, 40, 45], -3))),
            ("QUALITY", steps(popularity, [9.5, 10, 10.5, 11], -2)),
            ("COMPATIBILITY", steps(F.col("n_supp"), [20, 26, 31], -1)),
            ("TRAINING", steps(F.col("ret"), [0.25, 0.35, 0.45], -1)),
            ("DOMAIN", F.length("word1") % 3 - 1), ("ARCHITECTURE", F.length("word2") % 3 - 1), ("CAPABILITY", F.length("p_type") % 3 - 1),
            ("LINEAGE", F.substring("p_brand", 7, 10).cast("int") % 3 - 1),
        )
    ])
    positions = facts.select("model_id", F.explode(places).alias("x")).where("x.v is not null").select("model_id", "x.bank", F.signum("x.v").cast("int").alias("path_sign"), F.abs("x.v").alias("path_depth"))
    here = lineitem.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("target"))
    behind = lineitem.select("l_orderkey", (F.col("l_linenumber") - 1).alias("line"), F.col("l_partkey").alias("source"))
    pairs = here.join(behind, ["l_orderkey", "line"]).where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))
    name = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    links = pairs.select(name("source").alias("source_id"), name("target").alias("target_id"), F.when(F.col("source") > F.col("target"), "fine_tuned_from").otherwise("same_family").alias("relation"), "weight")
    typed = F.array(
        F.struct(F.lit("likes").alias("key"), F.col("likes").cast("string").alias("value"), F.lit("int").alias("value_type")),
        F.struct(F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"), F.lit("int").alias("value_type")),
        F.when(F.col("p_size") % 4 != 0, F.struct(F.lit("vibe_summary").alias("key"), F.col("p_name").alias("value"), F.lit("str").alias("value_type"))),
    )
    metadata = facts.select("model_id", F.explode(typed).alias("x")).where("x is not null").select("model_id", "x.*")
    return Network(models, stored(positions, "positions"), anchors, model_anchors.drop("category"), stored(links, "links"), stored(metadata, "metadata"), facts)


_KNOWN: dict[tuple[str, str], Network] = {}


def from_driver(spark: SparkSession, sf_dir: str) -> Network:
    """The derived network of an input folder, built once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _KNOWN:
        _KNOWN[key] = derive(spark, sf_dir)
    return _KNOWN[key]
