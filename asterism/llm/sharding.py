"""Reproducible shuffle and sharding by a keyed Feistel permutation of global row numbers.

Rows get consecutive global numbers in the order of given columns; a balanced Feistel network with cycle walking
permutes 0..n-1, and the permuted position p yields shard ``p % shards`` and slot ``p // shards``. Anyone who knows
n, the seed and a row's number can compute its place, and ``position_to_row`` inverts it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions

ROUNDS = 6


def _half_bits(n: int) -> int:
    return max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)


def _round(half: np.ndarray, key: int, mask: np.uint64) -> np.ndarray:
    x = (half + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x & mask


def _keys(seed: int) -> list[int]:
    rng = np.random.Generator(np.random.PCG64(seed))
    return [int(k) for k in rng.integers(0, 2**63, ROUNDS)]


def _network(x: np.ndarray, bits: int, keys: Sequence[int], back: bool) -> np.ndarray:
    mask, shift = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> shift, x & mask
    for key in reversed(keys) if back else keys:
        if back:
            left, right = right ^ _round(left, key, mask), left
        else:
            left, right = right, left ^ _round(right, key, mask)
    return (left << shift) | right


def permute(rows: np.ndarray, n: int, seed: int, back: bool = False) -> np.ndarray:
    """Permuted positions of row numbers below ``n`` (``back``: row numbers of positions).

    The network works on the smallest even-bit domain of at least n values, less than 4n; values that leave 0..n-1
    walk their cycle until they return, which keeps it a bijection.
    """
    keys, bits = _keys(seed), _half_bits(n)
    with np.errstate(over="ignore"):
        out = _network(np.asarray(rows, dtype=np.uint64), bits, keys, back)
        while (outside := out >= np.uint64(n)).any():
            out[outside] = _network(out[outside], bits, keys, back)
    return out.astype(np.int64)


def position_to_row(position: int, n: int, seed: int) -> int:
    return int(permute(np.array([position]), n, seed, back=True)[0])


def number_rows(df: DataFrame, order: Sequence[str], out: str = "row") -> tuple[DataFrame, int]:
    """Global row numbers 0..n-1 in the order of ``order`` (nulls first), and n.

    Range partitions are sorted and numbered locally, then shifted by the counts of the partitions before them, so no
    partition holds more than its range. Rows equal in ``order`` are dealt out by a salt, so a hot value spreads over
    partitions; which of them gets which number is free. The driver gets one count for each partition.
    """
    spark, salt, pid, local = df.sparkSession, "__salt", "__pid", "__local"
    cols = [F.col(c).asc_nulls_first() for c in order]
    ranged = (
        df.withColumn(salt, F.xxhash64(F.monotonically_increasing_id()))
        .repartitionByRange(partitions(spark), *cols, F.col(salt))
        .sortWithinPartitions(*cols, F.col(salt))
        .withColumn(pid, F.spark_partition_id())
        .withColumn(local, F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
        .drop(salt)
    )
    kept = materialize(ranged, "rows")
    counts = sorted((r[pid], r["count"]) for r in kept.groupBy(pid).count().collect())
    starts, n = [], 0
    for p, c in counts:
        starts.append((p, n))
        n += c
    offsets = spark.createDataFrame(starts or [(0, 0)], f"{pid} int, __start bigint")  # a row for each partition
    numbered = kept.join(F.broadcast(offsets), pid).withColumn(out, F.col("__start") + F.col(local)).drop(pid, local, "__start")
    return numbered, n


def shard_rows(df: DataFrame, order: Sequence[str], shards: int = 24, seed: int = 7) -> DataFrame:
    """``df`` with ``row``, ``position``, ``shard`` and ``slot``: shard sizes differ by at most one row and slots are gapless.

    Nulls in ``order`` come first; repeated rows are rows of their own; an empty input gives an empty result. Input
    columns of the four names are replaced.
    """
    df = df.drop("row", "position", "shard", "slot")
    numbered, n = number_rows(df, order)

    @F.pandas_udf("bigint")
    def place(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(permute(part.to_numpy(), n, seed))

    at = numbered.withColumn("position", place("row"))
    return at.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.floor(F.col("position") / F.lit(shards)).cast("bigint"))


def shard_documents(documents: DataFrame, shards: int = 24, seed: int = 7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``documents``: id, size (UTF-8 bytes plus 8), text_crc32, law, shard, slot, grown_shard.

    The law is ``rows``. A null text has no bytes; null and repeated ids are allowed. The order is (id, size, crc), so the
    result doesn't depend on how the input is laid out in files.
    """
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    small = documents.select(F.col(id_col).alias(id_col), (F.octet_length(raw) + 8).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"))
    return shard_rows(small, [id_col, "size", "text_crc32"], shards, seed).select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
