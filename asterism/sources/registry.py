"""Sources by name, and one search over all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import RAW, read_records

Source = Callable[[SparkSession], DataFrame]
_SOURCES: dict[str, Source] = {}


def register(name: str, source: Source) -> None:
    _SOURCES[name] = source


def names() -> list[str]:
    return sorted(_SOURCES)


def json_dump(path: str) -> Source:
    """A source that reads a dump of records, where the network isn't reachable."""
    return lambda spark: read_records(spark, path)


def federated(spark: SparkSession, wanted: list[str], limit: int, min_likes: int = 0) -> tuple[DataFrame, dict[str, str]]:
    """Records of several sources by likes, and the errors of sources that failed or are unknown."""
    found, errors = [], {}
    for name in wanted:
        try:
            rows = _SOURCES[name](spark).withColumn("source", F.lit(name)).where(F.col("likes") >= min_likes).orderBy(F.desc("likes"), "model_id").limit(limit).collect()
            found += [r.asDict() for r in rows]  # no source gives more than ``limit``; one that fails while it is read fails here
        except KeyError:
            errors[name] = "unknown source"
        except Exception as e:  # a source that fails must not take the others with it
            errors[name] = str(e).splitlines()[0]
    rows = spark.createDataFrame([tuple(r.get(c) for c in spark.createDataFrame([], RAW).columns) for r in found], RAW)
    return rows.orderBy(F.desc("likes"), "model_id").limit(limit), errors
