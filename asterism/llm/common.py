"""What the operators of this subpackage share: scratch tables, document keys, text normal forms."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scratch tables by path, each with a weak reference to the file index that every plan over it holds.
_TABLES: dict[str, object] = {}

#: ASCII white space as a Java character class; words are the maximal runs of anything else.
SPACE = r"[\x20\x09-\x0D]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary folder only in local mode where that is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="asterism-")
    spark.sparkContext.setCheckpointDir(made)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system; a session that has ended is left alone."""
    jvm = spark.sparkContext._jvm
    if jvm is None:
        return
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the scratch folder, removed when the driver's Python ends."""
    path = f"{scratch_dir(spark)}/asterism-{uuid.uuid4().hex}-{tag}"

    def clean() -> None:
        try:
            if spark.sparkContext._jsc is not None:
                remove(spark, path)
        except Exception:  # the JVM may have gone before this hook runs
            pass
        if path.startswith(("file:", "/")):
            shutil.rmtree("/" + path.removeprefix("file:").lstrip("/"), ignore_errors=True)

    atexit.register(clean)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared scratch folder and return a reader of it: lineage ends there and survives lost executors."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    index = made._jdf.queryExecution().analyzed().relation().location()
    _TABLES[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(index)
    return made


def bucketed(df: DataFrame, key: str, tag: str) -> DataFrame:
    """``materialize`` with the rows dealt and sorted by a key: later joins on the key move only what they are joined with.

    Only the plan knows the buckets; no table stays in the catalog.
    """
    spark, path, n = df.sparkSession, scratch_path(df.sparkSession, tag), partitions(df.sparkSession)
    name = f"asterism_{uuid.uuid4().hex}"
    df.repartition(n, key).write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(n, key).sortBy(key).saveAsTable(name)
    made = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # the files stay, as those of a table at a path of its own
    plan = made._jdf.queryExecution().analyzed()
    while plan.children().size():
        plan = plan.children().apply(0)
    _TABLES[path] = spark.sparkContext._jvm.java.lang.ref.WeakReference(plan.relation().location())
    return made


def drop(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read any more."""
    for table in tables:
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            remove(table.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Delete the scratch tables that no plan of this session can read any more, and let Spark drop shuffles nobody needs.

    A table goes only once the JVM has collected every plan that holds it, so a result that is still to be read keeps its
    tables. Long jobs call this between their parts.
    """
    for _ in range(2):  # what the first pass frees in Python the second frees in the JVM
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    for path in [p for p, held in _TABLES.items() if held.get() is None]:
        del _TABLES[path]
        remove(spark, path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, _UPPER, _LOWER)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
