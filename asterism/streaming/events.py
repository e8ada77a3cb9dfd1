"""Structured Streaming: windows over events, first-seen rows, and replay of change records into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def timed(events: DataFrame) -> DataFrame:
    """Event time as an instant in UTC, which watermarks need."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums by window and type; works on a stream and on a table alike."""
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(F.unix_seconds("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user: events less than ``gap`` apart."""
    s = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.unix_micros("w.start").alias("start"), "n")


def first_seen(events: DataFrame, keys: list[str], late: str = "2 hours") -> DataFrame:
    """One row for each key."""
    return timed(events).withWatermark("ts", late).dropDuplicates([*keys])


def replay(spark: SparkSession, folder: str, checkpoint: str, apply: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Feed change records, a JSON line each, to ``apply`` in batches; a line is taken once however often it comes.

    Hashes of lines that were taken are a table beside the checkpoint, which each batch is held against, so the stream
    keeps no state that grows. They are written after ``apply``, by batch: a batch that is run again finds its own gone.
    """
    ledger = f"{checkpoint.rstrip('/')}/lines"
    schema = "line string, batch bigint"

    def fresh(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        at = session.sparkContext._jvm.org.apache.hadoop.fs.Path(ledger)
        once = batch.withColumn("line", F.sha2("value", 256)).dropDuplicates(["line"])
        if at.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(at):
            taken = session.read.schema(schema).parquet(ledger).where(F.col("batch") != number)
            once = once.join(taken.select("line"), "line", "left_anti")
        apply(once.select("value", "line"), number)
        once.select("line").write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return spark.readStream.text(folder).writeStream.foreachBatch(fresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
