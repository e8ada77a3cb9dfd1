"""Exact top-k search by inner product with pivot-table elimination.

Vectors of integers are lifted by one coordinate so that a larger inner product with a query means a smaller Euclidean
distance. Distances of all vectors to many pivots, which lie far apart, are computed once and stored with the vectors; by
the triangle inequality the largest difference between a query's and a candidate's pivot distances bounds their distance
from below. The table is kept by tiles of candidates at like distances: a tile whose bound can't reach a query's
k-th best score, of those that it has seen or of a sample of candidates that every block of queries is compared with
first, is passed over; the queries that are left are multiplied with the tile as matrices, which is exact on integers.
Vectors meet in blocks of bounded size: each block of queries with each block of candidates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions

SCALE = 64
K = 20
EVERY = 20
PIVOTS = 48
#: Vectors that pivots are chosen from and that give the first thresholds: a bound of what the driver holds.
SAMPLE = 4096
#: Vectors in a block of queries and of candidates, at most, and numbers in either: a pair of blocks is what a task holds.
QUERY_BLOCK, CANDIDATE_BLOCK, NUMBERS = 65536, 32768, 1 << 22
#: Candidates that are passed over or evaluated together, and queries that are so at once.
TILE, SLICE = 256, 512


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """Rows (id, v): v array<bigint> of floor(scale * x) with x as double; rows whose vector or id is null, or whose vector holds a null or non-finite component, are left out. An empty vector scores 0 with any."""
    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.transform(F.col(vector_col), lambda c: c.cast("double")).alias("x"))
    ok = F.col("id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return slim.where(ok).select("id", F.transform("x", lambda c: F.floor(scale * c).cast("bigint")).alias("v"))


def kind_of(radius2: float) -> type:
    """The fastest type that holds every sum of products of such vectors exactly: by Cauchy and Schwarz none is over ``radius2``."""
    return np.float32 if radius2 <= 2.0**24 else np.float64 if radius2 < 2.0**53 else np.int64


def far_apart(vectors: np.ndarray, count: int) -> np.ndarray:
    """Places of up to ``count`` vectors, each the one farthest from those before it; equal vectors are taken once."""
    if not len(vectors):
        return np.empty(0, dtype=np.int64)
    out, norms = [int(np.einsum("ij,ij->i", vectors, vectors).argmax())], np.einsum("ij,ij->i", vectors, vectors)
    least = np.full(len(vectors), np.inf)
    while len(out) < count:
        least = np.minimum(least, norms + norms[out[-1]] - 2.0 * (vectors @ vectors[out[-1]]))
        k = int(least.argmax())
        if least[k] <= 0:
            break
        out.append(k)
    return np.array(out)


def pivot_table(vectors: np.ndarray, pivots: np.ndarray, radius2: float) -> np.ndarray:
    """Distances in the lifted space, a row for each vector and a column for each pivot."""
    lift = np.sqrt(np.maximum(radius2 - np.einsum("ij,ij->i", vectors, vectors), 0.0))
    plift = np.sqrt(np.maximum(radius2 - np.einsum("ij,ij->i", pivots, pivots), 0.0))
    return np.sqrt(np.maximum(radius2 + radius2 - 2.0 * (vectors @ pivots.T + lift[:, None] * plift[None, :]), 0.0))


def thresholds(sample: np.ndarray, sample_rows: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each query a score that k vectors reach: its k-th best of the sample, its own row left out."""
    out = np.full(len(query_rows), -np.inf)
    if len(sample) > k:
        for at in range(0, len(queries), SLICE):
            scores = (queries[at : at + SLICE] @ sample.T).astype(np.float64)
            scores[query_rows[at : at + SLICE, None] == sample_rows[None, :]] = -np.inf
            out[at : at + SLICE] = np.partition(scores, -k, axis=1)[:, -k]
    return out


def cut(table: np.ndarray, size: int) -> list[np.ndarray]:
    """Places of all rows in parts of at most ``size``: those with the same nearest pivot, halved at the median of the column that varies most."""
    cell = table.argmin(axis=1)
    order = np.argsort(cell, kind="stable")
    out, left = [], np.split(order, np.flatnonzero(np.diff(cell[order])) + 1)
    while left:
        part = left.pop()
        if len(part) <= size:
            out.append(part)
        else:
            here = table[part]
            halves = np.argpartition(here[:, here.var(axis=0).argmax()], len(part) // 2)
            left += [part[halves[: len(part) // 2]], part[halves[len(part) // 2 :]]]
    return out


def k_best(places: np.ndarray, ids: np.ndarray, rows: np.ndarray, scores: np.ndarray, floors: np.ndarray, k: int) -> np.ndarray:
    """Where each query's k best found rows stand, best first by query, ties to smaller ids, then rows; raises ``floors`` of queries that have k."""
    order = np.lexsort((rows, ids, -scores, places))
    of = places[order]
    firsts = np.flatnonzero(np.diff(of, prepend=-1))
    rank = np.arange(len(of)) - np.repeat(firsts, np.diff(firsts, append=len(of)))
    last = order[rank == k - 1]
    floors[places[last]] = np.maximum(floors[places[last]], scores[last])
    return order[rank < k]


def search(ids: np.ndarray, rows: np.ndarray, vectors: np.ndarray, table: np.ndarray, query_rows: np.ndarray, queries: np.ndarray, pivots: np.ndarray, radius2: float, floors: np.ndarray | None = None, k: int = K) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """For each slice of queries: places of queries and of their candidates of this block that may be among their k best, the scores, how many were evaluated for that query, and how many for the slice.

    Vectors are integers of a ``kind_of`` type for ``radius2``, which is at least every squared norm, so their products are
    exact. ``table`` has the candidates' distances to the pivots, ``floors`` scores that k rows are known to reach, which are
    raised in place; what is below isn't among the best of all and is left out. A query passes over the candidate that is
    its own row, ties go to smaller ids, then rows. Candidates of like distances share a tile, of which the least and
    largest distance to each pivot are known: where a query's distance lies outside, the gap bounds the scores of the
    whole tile. Queries that a tile may serve are multiplied with it at once. Distances get a slack that covers their rounding,
    so a candidate is only passed over if its exact score is below the k-th best, never if it ties.
    """
    real = queries.astype(np.float64)
    norms = np.einsum("ij,ij->i", real, real)
    # squared distances in the lifted space; queries have 0 there
    asked = np.sqrt(np.maximum(norms[:, None] + radius2 - 2.0 * (real @ pivots.T), 0.0))
    slack = 1e-6 * np.sqrt(4.0 * radius2 + norms.max(initial=0.0)) + 1e-3  # over the error of two square roots near zero
    rounding = 1e-3 + 1e-12 * radius2
    floors = np.full(len(query_rows), -np.inf) if floors is None else floors
    tiles = cut(table, TILE)
    tile_vectors = [vectors[tile] for tile in tiles]
    lows, highs = (np.array([side(table[tile], axis=0) for tile in tiles], dtype=np.float64) for side in (np.min, np.max))
    alike = np.concatenate(cut(asked, SLICE))
    for at in range(0, len(queries), SLICE):
        own = alike[at : at + SLICE]
        asks, limits, done = queries[own], floors[own], np.zeros(len(own), dtype=np.int64)
        gap = np.zeros((len(own), len(tiles)))
        for j in range(asked.shape[1]):
            here = asked[own, j, None]
            np.maximum(gap, lows[:, j] - here, out=gap)
            np.maximum(gap, here - highs[:, j], out=gap)
        best = np.floor((norms[own, None] + radius2 - np.maximum(gap - slack, 0.0) ** 2) / 2.0 + rounding)  # no score is above
        kept = (np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.empty(0, dtype=vectors.dtype))
        parts, pending = [kept], 0

        def settled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            places, found, scores = (np.concatenate(x) for x in zip(*parts))
            take = k_best(places, ids[found], rows[found], scores, limits, k)
            return places[take], found[take], scores[take]

        for t in np.argsort(-best.max(axis=0), kind="stable"):
            alive = np.flatnonzero(best[:, t] >= limits)
            if not len(alive):
                continue
            tile = tiles[t]
            scores = (asks if len(alive) == len(own) else asks[alive]) @ tile_vectors[t].T
            done[alive] += len(tile)
            reached = limits[alive, None]
            hits = np.flatnonzero(scores >= (reached.astype(scores.dtype) if scores.dtype.kind == "f" else reached))
            places, found = alive[hits // len(tile)], tile[hits % len(tile)]
            other = rows[found] != query_rows[own[places]]
            parts.append((places[other], found[other], scores.ravel()[hits[other]]))
            pending += len(hits)
            if pending >= k * len(own):
                parts, pending = [settled()], 0
        places, found, scores = settled()
        floors[own] = limits
        yield own[places], found, scores.astype(np.int64), done[places], int(done.sum())


def _blocks(vectors: DataFrame, size: int, n: int, name: str) -> DataFrame:
    """Rows (name, name_ids, name_rows, name_flat) of about ``size`` vectors, dealt by a hash of the row number."""
    dealt = vectors.withColumn(name, F.pmod(F.xxhash64("row"), F.lit(max(1, -(-n // size)))).cast("int"))
    rows = dealt.groupBy(name).agg(F.collect_list(F.struct("id", "row", "v", "d")).alias("rows"))
    return rows.select(name, F.col("rows.id").alias(f"{name}_ids"), F.col("rows.row").alias(f"{name}_rows"), F.flatten("rows.v").alias(f"{name}_flat"), F.flatten("rows.d").alias(f"{name}_table"))


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, k: int = K, pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """Rows (query_id, rank, id, score, evaluated): each query row's k best other rows by integer inner product, ties to smaller ids.

    Queries are the rows where ``is_query`` (of column id) holds, by default those whose id is divisible by 20. Repeated
    rows are rows of their own, also as queries. Vectors shorter than the longest, also empty ones, are padded with zeros.
    Without a valid vector or query the result is empty; other columns may have any name. Each block of candidates is
    sent to each block of queries, which an exact search of all rows needs where bounds don't tell; the blocks are
    bounded, and a pair of blocks is a task's unit. A sample of at most ``SAMPLE`` rows, drawn by a hash of their number,
    comes to the driver; at most ``pivots`` of it that lie far apart are the pivots, and all of it gives first thresholds.
    A ValueError says that scores wouldn't fit a long.
    """
    spark = df.sparkSession
    vectors = materialize(integer_vectors(df, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    asked = F.col("id") % EVERY == 0 if is_query is None else is_query
    n, width, radius2, n_asks = vectors.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max(square), F.count_if(asked)).first()
    if not n_asks:
        return spark.createDataFrame([], f"query_id bigint, rank int, {id_col} bigint, score bigint, evaluated bigint")
    if radius2 >= 2.0**62:
        raise ValueError("the largest inner product may not fit a long; use a smaller scale")
    kind = kind_of(radius2)
    stored = {np.float32: "float", np.float64: "double", np.int64: "bigint"}[kind]
    even = vectors.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(width) - F.size("v"))))
    drawn = even.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("row", "v").collect()
    sample = np.array([r["v"] for r in drawn], dtype=np.int64).reshape(len(drawn), width)
    chosen = sample[far_apart(sample.astype(np.float64), pivots)].astype(np.float64)
    base = spark.sparkContext.broadcast((chosen, float(radius2), sample.astype(kind), np.array([r["row"] for r in drawn], dtype=np.int64)))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, r2, *_ = base.value
        for batch in batches:
            flat = pc.list_flatten(batch.column(2)).to_numpy(zero_copy_only=False).reshape(batch.num_rows, width).astype(np.float64)
            far = pivot_table(flat, table, r2)
            made = pa.ListArray.from_arrays(np.arange(batch.num_rows + 1, dtype=np.int32) * len(table), pa.array(far.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=["id", "row", "v", "d"])

    far = materialize(even.select("id", "row", F.col("v").cast(f"array<{stored}>")).mapInArrow(measure, f"id bigint, row bigint, v array<{stored}>, d array<float>"), "pivot-table")
    query_block = max(1, min(QUERY_BLOCK, NUMBERS // max(1, width)))
    n_query_blocks = -(-n_asks // query_block)
    # small tables are cut finer, so that every core has pairs
    candidate_block = max(1, min(CANDIDATE_BLOCK, NUMBERS // (width + len(chosen)), -(-n * n_query_blocks // (2 * partitions(spark)))))
    q, c = _blocks(far.where(asked).withColumn("d", F.array().cast("array<float>")), query_block, n_asks, "q"), _blocks(far, candidate_block, n, "c")
    every = lambda of, size: F.explode(F.sequence(F.lit(0), F.lit(max(1, -(-of // size)) - 1)))
    # dealt by the pair into a number of tasks that stays, since a pair is much work for few bytes
    sent, asks = (x.repartition(partitions(spark), "q", "c") for x in (c.withColumn("q", every(n_asks, query_block)), q.drop("q_table").withColumn("c", every(n, candidate_block))))
    names = ["q", "q_ids", "q_rows", "q_flat", "c_ids", "c_rows", "c_flat", "c_table"]
    schema = pa.schema([("query_row", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("row", pa.int64()), ("score", pa.int64()), ("evaluated", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, r2, known, known_rows = base.value
        now, floors, held = None, np.empty(0), []
        # a task's pairs come in the order of their block of queries, which keeps its best rows from one pair to the next
        for batch in batches:
            for at in range(batch.num_rows):
                x = {name: batch.column(name)[at].values.to_numpy(zero_copy_only=False) for name in names[1:]}
                cv = x["c_flat"].reshape(len(x["c_ids"]), width)
                qv = x["q_flat"].reshape(len(x["q_ids"]), width)
                if batch.column("q")[at].as_py() != now:
                    if held:
                        yield pa.RecordBatch.from_arrays([pa.array(y) for y in held[1:]], schema=schema)
                    now, floors, held = batch.column("q")[at].as_py(), thresholds(known, known_rows, x["q_rows"], qv, k), []
                parts = [held] if held else []
                for places, found, scores, done, _ in search(x["c_ids"], x["c_rows"], cv, x["c_table"].reshape(len(cv), -1), x["q_rows"], qv, pivots, r2, floors, k):
                    parts.append([places, x["q_rows"][places], x["q_ids"][places], x["c_ids"][found], x["c_rows"][found], scores, done])
                held = [np.concatenate(y) for y in zip(*parts)]
                best = k_best(held[0], held[3], held[4], held[5], floors, k)
                held = [y[best] for y in held]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(y) for y in held[1:]], schema=schema)

    found = sent.join(asks, ["q", "c"]).select(*names).mapInArrow(run, "query_row bigint, query_id bigint, id bigint, row bigint, score bigint, evaluated bigint")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score", "evaluated")
