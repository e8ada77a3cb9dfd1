"""Pairs of texts by the Jaccard similarity of their word shingles, as SimHash's near-duplicates need them.

``verified`` decides pairs on whole shingle sets. ``completed`` finds the pairs that a first set of links leaves out. Each
text has 32 band keys of 4 minima; a pair of similarity 0.8 agrees on fewer than two of them with probability 1e-6.

1. Every text is compared with one leader of its buckets, which links groups of copies in linear time.
2. A bucket of more than ``crowd`` texts that still holds several components has texts that share a frequent passage, or
   heavily edited copies. Shingles of its texts are ordered from rare to frequent. The place of the first shingle that two
   texts share bounds what they can share, so a text with enough words of its own has no candidates at all. Each text is
   compared with one hub, a text with few words of its own.
3. Texts of different components that share two smaller buckets, or a shingle that the bound admits, are compared.

No bucket is collected, and no pair is left out for being in a crowd.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop, materialize, sweep
from .components import components

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Buckets of at most this many texts are compared pair by pair.
CROWD = 32
_LEADERS = 4
_BLOCK = 1 << 12
#: Pairs of one text that meet in a task's group at most.
_SLOT = 1024
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> bytes:
    """The XXH64 digests (seed 42) of the text's word shingles in order, repeats included; of a shorter text all words; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower() and split() know ASCII only
    if not words:
        return b""
    grams = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    digest = xxhash.xxh64_digest
    return b"".join([digest(g, 42) for g in grams])


def as_set(hashes: bytes) -> np.ndarray:
    return np.unique(np.frombuffer(hashes, dtype=">u8").astype(np.uint64))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of minima under multiplications modulo 2**64; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), _BLOCK):
        np.minimum(least, (_FACTORS[:, None] * hashes[None, at : at + _BLOCK]).min(axis=1), out=least)
    keys = [xxhash.xxh64_intdigest(row.tobytes()) for row in least.reshape(BANDS, ROWS)]
    return np.array(keys, dtype=np.uint64).view(np.int64).tolist()


def verified(texts: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows (src, dst) of the pairs whose sets have a Jaccard similarity of ``percent`` or more; ``texts`` has (node, text).

    Texts meet in two joins, and sets exist only in the task that compares them. A text in very many pairs is dealt out
    over as many groups as hold ``_SLOT`` of them each. Written to the shared folder.
    """
    pairs = materialize(pairs, "pairs")
    many = pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > _SLOT).select("dst", F.ceil(F.col("c") / _SLOT).alias("slots"))
    dealt = pairs.join(many, "dst", "left").select("src", "dst", F.pmod(F.xxhash64("src"), F.coalesce("slots", F.lit(1))).alias("slot"))
    ours = dealt.join(texts.select(F.col("node").alias("src"), F.col("text").alias("x")), "src")
    theirs = dealt.select("dst", "slot").distinct().join(texts.select(F.col("node").alias("dst"), F.col("text").alias("y")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, np.zeros(0, dtype=np.uint64)
        for batch in batches:
            keep = []
            for dst, x, y in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                if dst != last:
                    last, known = dst, as_set(shingle_hashes(y.as_py(), shingle))
                mine = as_set(shingle_hashes(x.as_py(), shingle))
                common = len(np.intersect1d(mine, known, assume_unique=True))
                keep.append((100 + percent) * common >= percent * (len(mine) + len(known)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["src", "dst"]).filter(pa.array(keep, pa.bool_()))

    found = materialize(ours.join(theirs, ["dst", "slot"]).select("src", "dst", "x", "y").mapInArrow(run, "src bigint, dst bigint"), "links")
    drop(pairs)
    return found


def _fits(a: str, b: str, percent: int) -> Column:
    """Sets of such sizes may be similar."""
    return percent * F.greatest(a, b) <= 100 * F.least(a, b)


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))


def _pairs(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Pairs (src, dst) of rows (keys, node, n, label, at) that share the keys, not the label, and may be similar.

    ``at`` is how many shingles stand before the shared one: if that is the first that two texts share, they share at
    most what is left of either. Similar texts pass with their first one.
    """
    a = rows.select(*keys, F.col("node").alias("src"), F.col("n").alias("x"), F.col("label").alias("c"), F.col("at").alias("i"))
    b = rows.select(*keys, F.col("node").alias("dst"), F.col("n").alias("y"), F.col("label").alias("d"), F.col("at").alias("j"))
    return a.join(b, keys).where((F.col("src") < F.col("dst")) & (F.col("c") != F.col("d")) & _fits("x", "y", percent) & _bound("x", "y", "i", "j", percent)).select("src", "dst")


def _bound(x: str, y: str, i: str, j: str, percent: int) -> Column:
    return (100 + percent) * F.least(F.col(x) - F.col(i), F.col(y) - F.col(j)) >= percent * (F.col(x) + F.col(y))


def _rare_first(texts: DataFrame, nodes: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Rows (h, node, n, at): of each node's shingles, rare ones first, those that may be the first it shares with a similar node, and their places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                made = [as_set(shingle_hashes(t.as_py(), shingle)).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "hashes"])

    sets = texts.join(nodes.select("node"), "node", "left_semi").select("node", "text").mapInArrow(run, "node bigint, hashes array<bigint>")
    each = materialize(sets.select("node", F.explode("hashes").alias("h")), "shingles")
    often = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    shared = each.join(often, "h").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("s"))  # a node's own shingles
    alone = F.col("n") - F.size("s")  # its own, which stand first
    most = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1 - alone
    first = shared.join(nodes, "node").withColumn("k", most.cast("int")).where("k > 0")
    placed = first.select("node", "n", alone.alias("alone"), F.posexplode(F.slice("s", F.lit(1), F.col("k"))).alias("p", "x"))
    out = materialize(placed.select(F.col("x.h").alias("h"), "node", "n", (F.col("alone") + F.col("p")).alias("at")), "rare")
    drop(each)
    return out


def _hubs(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (src, dst) of a node and the hub that most of its shingles have: of a shingle, the node with the least share of shingles before it."""
    least = F.min(F.struct((F.col("at") / F.col("n")).alias("share"), F.xxhash64("node").alias("mix"), "node", "n", "label", "at")).alias("hub")
    hubs = rare.groupBy("h").agg(F.count(F.lit(1)).alias("c"), least).where("c > 1").select("h", "hub")
    met = rare.join(hubs, "h").select("node", "n", "at", "label", F.col("hub.node").alias("hub"), F.col("hub.n").alias("y"), F.col("hub.at").alias("j"), F.col("hub.label").alias("d"))
    good = met.where((F.col("label") != F.col("d")) & _fits("n", "y", percent) & _bound("n", "y", "at", "j", percent)).groupBy("node", "hub").agg(F.count(F.lit(1)).alias("c"))
    return good.groupBy("node").agg(F.max(F.struct("c", "hub")).alias("x")).select(F.col("node").alias("src"), F.col("x.hub").alias("dst"))


def completed(texts: DataFrame, nodes: DataFrame, first: DataFrame, shingle: int, percent: int, crowd: int = CROWD) -> DataFrame:
    """Rows (node, label): the component of every node that has a link.

    ``texts`` has (node, text), ``nodes`` (node, n, bands): one node for texts with equal sets, with the set's size and
    band keys. ``first`` are pairs (src, dst) to verify beside those that the bands give.
    """
    keyed = nodes.select("node", "n", F.posexplode("bands").alias("t", "k"))
    lead = F.min(F.struct(F.xxhash64("node", F.col("t") % _LEADERS).alias("h"), "node", "n")).alias("lead")
    buckets = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("size"), lead).where("size > 1").select("t", "k", "size", F.col("lead.node").alias("lead"), F.col("lead.n").alias("lead_n"))
    sized = materialize(keyed.join(buckets, ["t", "k"]), "buckets")
    led = sized.where((F.col("node") != F.col("lead")) & _fits("n", "lead_n", percent)).groupBy("node", "lead").agg(F.count(F.lit(1)).alias("c"))
    best = led.groupBy("node").agg(F.max(F.struct("c", "lead")).alias("x")).select(F.col("node").alias("src"), F.col("x.lead").alias("dst"))
    links = verified(texts, first.select("src", "dst").union(best).distinct(), shingle, percent)
    labels = components(links, "near")

    crowded = _labelled(sized.where(F.col("size") > crowd).select("t", "k", "node", "n"), labels)
    mixed = crowded.groupBy("t", "k").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("t", "k")
    left = materialize(crowded.join(mixed, ["t", "k"], "left_semi").select("node", "n").distinct(), "left")
    rare = _rare_first(texts, left, shingle, percent) if left.limit(1).count() else None
    if rare is not None:
        more = verified(texts, _hubs(_labelled(rare, labels), percent), shingle, percent)
        links, labels = _merged(links, more, labels)

    few = _labelled(sized.where(F.col("size") <= crowd).select("t", "k", "node", "n"), labels).withColumn("at", F.lit(0))
    pairs = _pairs(few, ["t", "k"], percent).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("src", "dst")
    if rare is not None:
        pairs = pairs.union(_pairs(_labelled(rare, labels), ["h"], percent)).distinct()
    sweep(texts.sparkSession)
    links, labels = _merged(links, verified(texts, pairs, shingle, percent), labels)
    drop(sized, left, links, *([rare] if rare is not None else []))
    return labels


def _merged(links: DataFrame, more: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All links and their components; the tables that these replace go."""
    if not more.limit(1).count():
        drop(more)
        return links, labels
    both = materialize(links.union(more), "links")
    drop(links, more, labels)
    return both, components(both, "near")
