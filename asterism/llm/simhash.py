"""SimHash near-duplicate detection with pigeonring filtering.

A fingerprint's 64 bits lie on a ring of four 16-bit segments. If two fingerprints differ in at most 2 bits, some
segment starts a chain around the ring whose first l segments differ in at most floor(l / 2) bits for each l = 1..4:
the budgets are in proportion to the length. Budgets 0, 1, 1 make the first segment equal and one of the next two
equal, so six pairs of segments serve as join keys; the chain budgets then prune pairs before the full distance is
taken. A bucket of a key that is larger than ``crowd`` is not joined: its fingerprints agree on 32 bits, and the same
argument on a ring of the remaining bits gives keys of 48, then 56 bits, whose buckets hold 256 fingerprints at most.

``near_duplicates`` links fingerprints. ``keep_first`` links texts by the Jaccard similarity of their shingles, for which
2 of 64 bits are far too narrow and wide budgets would leave keys of a few bits: pairs of fingerprints are verified on
whole shingle sets there, and ``minhash`` completes them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import minhash
from .common import bucketed, materialize, sweep
from .components import components

BITS = 64
DISTANCE = 2
SHINGLE = 3
#: Buckets of at most this many different fingerprints are joined pair by pair; larger ones are keyed further.
CROWD = 512
_BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of whole text over XXH64 (seed 42) of its word shingles, repeats included; 0 without words."""
    return majority(minhash.shingle_hashes(text, shingle))


def majority(hashes: bytes) -> int:
    """The bits that are set in over half the 64-bit hashes; 0 without any."""
    counts, n = np.zeros(BITS, dtype=np.int64), len(hashes) // 8
    raw = np.frombuffer(hashes, dtype=np.uint8).reshape(-1, BITS // 8)
    for at in range(0, n, _BLOCK):
        counts += np.unpackbits(raw[at : at + _BLOCK], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, row_col: str | None = None) -> DataFrame:
    """Rows (id, fp, row): fp is the fingerprint as a signed bigint, row that column or null. Null and empty texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(2)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64)), batch.column(1)], names=["id", "fp", "row"])

    row = F.lit(None) if row_col is None else F.col(row_col)
    slim = df.select(F.col(id_col).cast("bigint").alias("id"), row.cast("bigint").alias("row"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id bigint, fp bigint, row bigint")


def _tables(free: list[tuple[int, int]]) -> list[tuple[int, list[tuple[int, int]], tuple[int, ...]]]:
    """For ring segments (offset, width): each pair of them as (mask of the pair, remaining segments, the pair)."""
    out = []
    for pair in combinations(range(len(free)), 2):
        mask = sum(((1 << free[k][1]) - 1) << free[k][0] for k in pair)
        out.append((mask, [free[k] for k in range(len(free)) if k not in pair], pair))
    return out


def _halves(segments: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return [x for at, width in segments for x in ((at, width // 2), (at + width // 2, width // 2))]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _chain(a: Column, b: Column, ring: list[tuple[int, int]]) -> Column:
    """Some rotation of the ring has prefix sums of differing bits within 0, 1, 1."""
    part = [F.bit_count(a.bitwiseXOR(b).bitwiseAND(F.lit(_signed(((1 << w) - 1) << o)))) for o, w in ring]
    n, found = len(ring), F.lit(False)
    for i in range(n):
        one, two = part[i], part[(i + 1) % n]
        found |= (one == 0) & (two <= 1) & (two + part[(i + 2) % n] <= 1)
    return found


def links(fps: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Rows (src, dst), src <> dst: every pair of different fingerprints of ``fps.fp`` within 2 bits, once or more often."""
    ring = [(48, 16), (32, 16), (16, 16), (0, 16)]
    out, rings = None, [(0, ring)]
    todo = fps.select("fp", F.lit(0).alias("parent"))
    for level in range(3):
        children, rows = [], {}
        for number, (known, segments) in enumerate(rings):
            rows[number] = []
            for mask, rest, _ in _tables(segments):
                rows[number].append((len(children), known | mask))
                children.append((known | mask, _halves(rest), segments))
        keys = F.when(F.lit(False), F.array(F.struct(F.lit(0).alias("t"), F.lit(0).cast("bigint").alias("k"))))
        for number, of in rows.items():
            keys = keys.when(F.col("parent") == number, F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for t, m in of]))
        keyed = todo.select("fp", F.explode(keys).alias("x")).select("fp", "x.t", "x.k")
        if level:
            keyed = keyed.distinct()  # several crowds may lead to one key
        last = level == 2
        sizes = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = materialize(keyed.join(sizes, ["t", "k"]), f"simhash-keys{level}")  # fingerprints alone in a bucket end here
        few = sized if last else sized.where(F.col("size") <= crowd)
        a, b = few.select("t", "k", F.col("fp").alias("src")), few.select("t", "k", F.col("fp").alias("dst"))
        near = (F.col("src") < F.col("dst")) & (_distance(F.col("src"), F.col("dst")) <= DISTANCE)
        if not level:
            near = (F.col("src") < F.col("dst")) & _chain(F.col("src"), F.col("dst"), ring) & near
        found = a.join(b, ["t", "k"]).where(near).select("src", "dst")
        out = found if out is None else out.union(found)
        crowded = sized.where(F.col("size") > crowd)
        if last or not crowded.limit(1).count():
            break
        todo = crowded.select("fp", F.col("t").alias("parent"))
        rings = [(mask, rest) for mask, rest, _ in children]
    return out


def _roots(prints: DataFrame, crowd: int) -> DataFrame:
    """Rows (fp, first, label): each different fingerprint, its smallest id and its component, from the shared folder."""
    distinct = prints.groupBy("fp").agg(F.min("id").alias("first"))
    labels = components(links(distinct, crowd), "simhash")
    rooted = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left")
    return materialize(rooted.select("fp", "first", F.coalesce("label", "fp").alias("label")), "simhash-roots")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Rows (id, fingerprint, component_id), one per input row.

    Fingerprints within 2 bits link; component_id is the smallest non-null id reachable, null only if all are null.
    Rows without words have fingerprint 0 and link like any other; repeated rows and null ids keep their rows. Copies
    meet as one fingerprint before any join. Very long texts are hashed whole, a block of shingles at a time. Only the id
    and the text are read, so other columns may have any name. An empty input gives an empty result.
    """
    prints = materialize(fingerprints(df, id_col, text_col), "simhash-fp")
    roots = _roots(prints, crowd)
    smallest = roots.groupBy("label").agg(F.min("first").alias("component_id"))
    named = roots.join(smallest, "label").select("fp", "component_id")
    return prints.join(named, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _prints(rows: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """Rows (id, row, fp, n, whole, bands): fingerprint, number of different shingles, a 128-bit hash of their set and its band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, n, whole, bands = [], [], [], []
            for t in batch.column(2):
                hashes = minhash.shingle_hashes(t.as_py(), shingle)
                different = minhash.as_set(hashes)
                fp.append(_signed(majority(hashes)))
                n.append(len(different))
                whole.append(xxhash.xxh128_digest(different.tobytes()))
                bands.append(minhash.band_keys(different))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64()), pa.array(n, pa.int64()), pa.array(whole, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "row", "fp", "n", "whole", "bands"])

    slim = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col("__row").alias("row"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "id bigint, row bigint, fp bigint, n bigint, whole binary, bands array<bigint>")


def keep_first(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = minhash.SHINGLE, percent: int = 80, crowd: int = minhash.CROWD) -> DataFrame:
    """One row of ``df`` for each component of texts whose sets of word shingles have a Jaccard similarity of ``percent`` (80 or more).

    That with the smallest id stays, nulls last; of repeated rows any one. Texts without words, null or empty, are copies
    of each other; very long texts are compared whole. Texts with equal sets meet as one node. Each node is paired with
    the nearest fingerprint that the pigeonring finds, and ``minhash`` verifies these pairs and completes them. The rows
    are numbered and written to the shared folder once, dealt by their number, so that null and repeated ids can be told
    apart and texts are moved again only where they are compared; other columns may have any name but __row.
    """
    sweep(df.sparkSession)
    rows = bucketed(df.withColumn("__row", F.monotonically_increasing_id()), "__row", "near-rows")
    prints = materialize(_prints(rows, id_col, text_col, shingle), "near-prints")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("x")
    kept = prints.groupBy("whole").agg(least).select(F.col("x.row").alias("row"))
    nodes = materialize(prints.join(kept, "row", "left_semi").select(F.col("row").alias("node"), "id", "fp", "n", "bands"), "near-nodes")

    distinct = nodes.where("n > 0").groupBy("fp").agg(F.min("node").alias("node"))
    near = links(distinct)
    nearest = near.union(near.select("dst", "src")).groupBy("src").agg(F.min("dst").alias("dst"))
    named = distinct.select(F.col("fp").alias("dst"), F.col("node").alias("other"))
    across = nearest.join(named, "dst").join(distinct.select(F.col("fp").alias("src"), "node"), "src").select(F.col("node").alias("src"), F.col("other").alias("dst"))
    within = nodes.select("fp", F.col("node").alias("src")).join(distinct, "fp").where("src <> node").select("src", F.col("node").alias("dst"))
    texts = rows.select(F.col("__row").alias("node"), F.col(text_col).alias("text"))
    labels = minhash.completed(texts, nodes, across.union(within), shingle, percent, crowd)

    named = nodes.join(labels, "node", "left").select("id", F.col("node").alias("row"), F.coalesce("label", "node").alias("label"))
    first = materialize(named.groupBy("label").agg(least).select(F.col("x.row").alias("__row")), "near-first")
    sweep(df.sparkSession)
    return rows.join(first, "__row", "left_semi").drop("__row")
