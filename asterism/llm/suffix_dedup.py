"""Exact removal of passages that repeat across documents, by sharded suffix arrays.

A byte goes if a passage of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. To find these
over all documents:

1. Documents are dealt into chunks of bounded size; their bytes are shuffled once and serve all later steps.
2. Each passage start has an anchor: the smallest hash of the ``ANCHOR``-byte strings in the passage. Equal passages have
   equal anchors, and neighbouring starts share one, so a chunk is a list of stretches with an anchor each. Anchors are
   counted by hash bucket; one that only one document has can't belong to a repeated passage.
3. The other stretches go to shards by anchor, each text once a chunk with the smallest id that has it. Stretches of an
   anchor with very many of them go as single passages, dealt by their own hash, so no shard gathers them.
4. A shard sorts the suffixes of its different texts by induction, takes permuted common prefixes, and so finds the
   smallest id that has each passage. A passage reaches at least half of its other bytes beyond one end of its anchor; a text that
   is the only one with its anchor and the bytes on either side has nothing to be sorted against. The shard answers with
   a bit per passage.
5. Chunks meet their answers and cut the bytes out.

Texts are compared only in suffix arrays; hashes just route them, so unequal passages never count as equal.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import partitions
from .suffix import smallest_owners

LENGTH = 50
ANCHOR = 16
#: Bytes of text for a chunk, for a bucket of anchors, and for a shard.
CHUNK_BYTES, BUCKET_BYTES, SHARD_BYTES = 4 << 20, 16 << 20, 3 << 20
#: Bytes of a shard's text that are sorted at once, but for an anchor that has more.
SORT_BYTES = 128 << 10
#: An anchor with more stretches than this is dealt out passage by passage.
CROWD = 4096
_BLOCK = 1 << 19
_U = np.uint64


def _anchors(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each passage start the place of its anchor, and the hash of the string at each place."""
    word = raw.astype(_U)
    for width in (1, 2, 4):
        word = word[:-width] | (word[width:] << _U(8 * width))
    hashed = word[: len(word) - (ANCHOR - 8)] * _U(0x9E3779B97F4A7C15)
    hashed ^= hashed >> _U(32)
    hashed += word[ANCHOR - 8 :]
    hashed *= _U(0xD6E8FEB86659FD93)
    hashed ^= hashed >> _U(29)
    hashed *= _U(0xBF58476D1CE4E5B9)
    least = (hashed & _U(0xFFFFFFFF00000000)) | np.arange(len(hashed), dtype=_U)  # equal upper halves: the leftmost
    window, wide = length - ANCHOR + 1, 1
    while 2 * wide <= window:
        least = np.minimum(least[:-wide], least[wide:])
        wide *= 2
    if wide < window:
        gap = window - wide
        least = np.minimum(least[:-gap], least[gap:])
    return (least & _U(0xFFFFFFFF)).astype(np.int64), hashed


class Chunk:
    """A chunk's documents in a fixed order, and its stretches: anchor, first start, number of starts, document."""

    def __init__(self, table: pa.Table, length: int) -> None:
        keys = pa.table({"n": pc.is_null(table["__id"]).cast(pa.int8()), "id": table["__id"], "th": table["__th"], "row": pa.array(np.arange(table.num_rows))})
        self.order = pc.sort_indices(keys, sort_keys=[("n", "ascending"), ("id", "ascending"), ("th", "ascending"), ("row", "ascending")])
        texts = table["__raw"].take(self.order)
        self.ids = np.array(table["__id"].take(self.order).fill_null(0), dtype=np.int64)
        owned = ~np.array(table["__id"].take(self.order).is_null(), dtype=bool)
        self.bytes = b"".join(x.as_py() for x in texts)
        self.sizes = np.array(pc.binary_length(texts), dtype=np.int64)
        self.bounds = np.concatenate([[0], np.cumsum(self.sizes)])
        self.raw = np.frombuffer(self.bytes, dtype=np.uint8)
        self.length = length
        parts: list[tuple[np.ndarray, ...]] = []
        for a in range(0, max(0, len(self.raw) - length + 1), _BLOCK):
            block = self.raw[a : a + _BLOCK + length - 1]
            at, hashed = _anchors(block, length)
            start = np.arange(a, a + len(at))
            doc = np.searchsorted(self.bounds, start, side="right") - 1
            at[(start + length > self.bounds[doc + 1]) | ~owned[doc]] = -1
            first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
            count = np.diff(np.concatenate([first, [len(at)]]))
            good = at[first] >= 0
            first, count = first[good], count[good]
            parts.append((hashed[at[first]], first + a, count, doc[first], at[first] + a))
        empty = (np.empty(0, dtype=_U), *[np.empty(0, dtype=np.int64)] * 4)
        self.anchor, self.start, self.count, self.doc, self.place = (np.concatenate(x) for x in zip(*parts)) if parts else empty

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
        """Different anchors, each stretch's number among them, and their numbers by bucket."""
        known, inverse = np.unique(self.anchor, return_inverse=True)
        bucket = ((known >> _U(40)) % _U(buckets)).astype(np.int64)
        return known, inverse, _split(bucket)

    def shared(self, status: np.ndarray, inverse: np.ndarray, shards: int) -> tuple[np.ndarray, ...]:
        """Stretches whose anchors are shared, those of crowded anchors as single passages, and their different texts.

        Gives starts, counts, documents and text numbers of the stretches, then for each text its first stretch, its
        shard and a key: 32 bits of its anchor, 16 of the bytes from ``side`` before it and 16 of those to ``side`` behind
        it, where the text has them. A single passage has a key of its own.
        """
        of = status[inverse]
        plain, crowded = np.flatnonzero(of == 1), np.flatnonzero(of == 2)
        many = self.count[crowded]
        start = np.concatenate([self.start[plain], np.repeat(self.start[crowded], many) + _ramp(many)])
        count = np.concatenate([self.count[plain], np.ones(int(many.sum()), dtype=np.int64)])
        doc = np.concatenate([self.doc[plain], np.repeat(self.doc[crowded], many)])
        anchor = np.concatenate([self.anchor[plain], np.zeros(int(many.sum()), dtype=_U)])
        known: dict[bytes, int] = {}
        number = np.empty(len(start), dtype=np.int64)
        # documents are in the order of their ids, so going through stretches in that order puts the smallest id first
        for k in np.argsort(doc, kind="stable").tolist():
            a = start[k]
            number[k] = known.setdefault(self.bytes[a : a + count[k] + self.length - 1], len(known))
        first = np.full(len(known), -1, dtype=np.int64)
        turn = np.argsort(doc, kind="stable")[::-1]
        first[number[turn]] = turn
        shard = ((anchor[first] >> _U(20)) % _U(shards)).astype(np.int64)
        key = anchor[first] & _U(0xFFFFFFFF00000000)
        side, place = (self.length - ANCHOR) // 2, np.concatenate([self.place[plain], np.zeros(int(many.sum()), dtype=np.int64)])
        for u, f in enumerate(first.tolist()):
            a = int(start[f])
            if f >= len(plain):
                whole = zlib.crc32(self.bytes[a : a + self.length])
                shard[u], key[u] = whole % shards, whole << 32
                continue
            p, end = int(place[f]), a + int(count[f]) + self.length - 1
            left = zlib.crc32(self.bytes[p - side : p + ANCHOR]) % 65535 + 1 if p - side >= a else 0
            right = zlib.crc32(self.bytes[p : p + ANCHOR + side]) % 65535 + 1 if p + ANCHOR + side <= end else 0
            key[u] |= _U(left << 16 | right)
        return start, count, doc, number, first, shard, key


def _ramp(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count c, one after another."""
    total = int(counts.sum())
    return np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)


def _several(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands there more than once."""
    _, inverse, counts = np.unique(keys, return_inverse=True, return_counts=True)
    return counts[inverse] > 1


def _split(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Places by key, in order."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    cuts = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
    return list(zip(ordered[np.concatenate([[0], cuts])].tolist(), np.split(order, cuts)))


def _blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


_ANCHOR_SCHEMA = "bucket int, chunk int, low binary, high binary, seen binary, many binary"


def _count_anchors(length: int, buckets: int):
    """Chunk -> per bucket its anchors (40 bits), how many stretches each has, and whether in two documents."""

    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, length)
        known, inverse, groups = chunk.by_bucket(buckets)
        seen = np.minimum(np.bincount(inverse, minlength=len(known)), 65535).astype("<u2")
        ids = chunk.ids[chunk.doc]
        low, high = np.full(len(known), np.iinfo(np.int64).max), np.full(len(known), np.iinfo(np.int64).min)
        np.minimum.at(low, inverse, ids)
        np.maximum.at(high, inverse, ids)
        number = table["__chunk"][0].as_py()
        rows = [(b, number, _blob((known[g] & _U(0xFFFFFFFF)).astype("<u4")), _blob((known[g] >> _U(32)).astype("u1")), _blob(seen[g]), _blob(np.packbits(low[g] != high[g]))) for b, g in groups]
        return _table(rows, ["bucket", "chunk", "low", "high", "seen", "many"], "iibbbb")

    return run


def _table(rows: list[tuple], names: list[str], kinds: str) -> pa.Table:
    types = {"i": pa.int32(), "l": pa.int64(), "b": pa.binary(), "s": pa.string()}
    columns = list(zip(*rows)) if rows else [()] * len(names)
    return pa.table({n: pa.array(c, types[k]) for n, c, k in zip(names, columns, kinds)})


def _judge_anchors(crowd: int):
    """Bucket -> per chunk two bits for each of its anchors: shared by documents, and crowded."""

    def run(table: pa.Table) -> pa.Table:
        chunks = table["chunk"].to_pylist()
        values, seen, many, sizes = [], [], [], []
        for low, high, count, two in zip(*(table[c].to_pylist() for c in ("low", "high", "seen", "many"))):
            low = np.frombuffer(low, dtype="<u4")
            values.append(low.astype(_U) | (np.frombuffer(high, dtype="u1").astype(_U) << _U(32)))
            seen.append(np.frombuffer(count, dtype="<u2"))
            many.append(np.unpackbits(np.frombuffer(two, dtype="u1"), count=len(low)))
            sizes.append(len(low))
        known, inverse, chunks_with = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        total = np.bincount(inverse, weights=np.concatenate(seen), minlength=len(known))
        within = np.bincount(inverse, weights=np.concatenate(many), minlength=len(known)) > 0
        shared = ((chunks_with > 1) | within)[inverse]
        crowded = (total > crowd)[inverse] & shared
        cuts = np.cumsum(sizes)[:-1]
        bucket = table["bucket"][0].as_py()
        rows = [(c, bucket, _blob(np.packbits(a)), _blob(np.packbits(b))) for c, a, b in zip(chunks, np.split(shared, cuts), np.split(crowded, cuts))]
        return _table(rows, ["chunk", "bucket", "shared", "crowded"], "iibb")

    return run


def _status(known: np.ndarray, groups: list[tuple[int, np.ndarray]], answers: dict[int, tuple[bytes, bytes]]) -> np.ndarray:
    """0 for an anchor of one document, 1 for a shared one, 2 for a crowded one."""
    status = np.zeros(len(known), dtype=np.int8)
    for bucket, places in groups:
        shared, crowded = (np.unpackbits(np.frombuffer(x, dtype="u1"), count=len(places)) for x in answers[bucket])
        status[places] = shared + crowded
    return status


_SHARD_SCHEMA = "shard int, chunk int, kind int, counts binary, ids binary, text binary, keys binary"


def _send(length: int, buckets: int, shards: int):
    """Chunk and its anchors' bits -> per shard its texts with their smallest ids; and the bits once more, for the chunk itself."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = ["shard", "chunk", "kind", "counts", "ids", "text", "keys"], "iiibbbb"
        if not left.num_rows or not right.num_rows:
            return _table([], names, kinds)
        chunk, number = Chunk(left, length), left["__chunk"][0].as_py()
        known, inverse, groups = chunk.by_bucket(buckets)
        answers = dict(zip(right["bucket"].to_pylist(), zip(right["shared"].to_pylist(), right["crowded"].to_pylist())))
        status = _status(known, groups, answers)
        start, count, doc, _, first, shard, key = chunk.shared(status, inverse, shards)
        rows = [(number % shards, number, 1, _blob(np.packbits(status > 0)), _blob(np.packbits(status > 1)), b"", b"")]
        for s, texts in _split(shard):
            k = first[texts]
            text = b"".join(chunk.bytes[a : a + n + length - 1] for a, n in zip(start[k].tolist(), count[k].tolist()))
            rows.append((s, number, 0, _blob(count[k].astype("u1")), _blob(chunk.ids[doc[k]].astype("<i8")), text, _blob(key[texts])))
        return _table(rows, names, kinds)

    return run


_ANSWER_SCHEMA = "chunk int, shard int, kind int, bits binary, more binary"


def _solve(length: int):
    """Shard -> per chunk a bit for each passage of its texts: whether a smaller id has it too. Rows of kind 1 pass through."""

    def run(table: pa.Table) -> pa.Table:
        rows, jobs, known, of = [], [], {}, []
        for shard, chunk, kind, counts, ids, text, keys in zip(*(c.to_pylist() for c in table.select(["shard", "chunk", "kind", "counts", "ids", "text", "keys"]).columns)):
            if kind:
                rows.append((chunk, shard, 1, counts, ids))
                continue
            at, these = 0, []
            counts = np.frombuffer(counts, dtype="u1").astype(np.int64)
            for n, key in zip(counts.tolist(), np.frombuffer(keys, dtype="<u8").tolist()):
                to = at + n + length - 1
                number = known.setdefault(text[at:to], len(known))
                if number == len(of):
                    of.append(key)
                these.append(number)
                at = to
            jobs.append((chunk, shard, counts, np.array(these), np.frombuffer(ids, dtype="<i8")))
        if jobs:
            least = np.full(len(known), np.iinfo(np.int64).max)
            for _, _, _, these, ids in jobs:
                np.minimum.at(least, these, ids)
            texts = list(known)
            sizes = np.array([len(s) - length + 1 for s in texts], dtype=np.int64)
            offset = np.cumsum(sizes) - sizes
            owners = np.repeat(least, sizes)
            key = np.array(of, dtype=_U)
            group, left, right = key >> _U(32), (key >> _U(16)) & _U(0xFFFF), key & _U(0xFFFF)
            met = np.flatnonzero((_several(group << _U(16) | left) & (left > 0)) | (_several(group << _U(16) | right) & (right > 0)))
            met = met[np.argsort(group[met], kind="stable")]
            # anchors are whole in a block; a block that the processor's caches hold is sorted fastest
            block = np.cumsum(sizes[met] + length) // SORT_BYTES
            block = np.maximum.accumulate(np.where(np.concatenate([[True], group[met][1:] != group[met][:-1]]), block, 0)) if len(met) else block
            for part in np.split(met, np.flatnonzero(block[1:] != block[:-1]) + 1) if len(met) else ():
                at = np.repeat(offset[part], sizes[part]) + _ramp(sizes[part])
                owners[at] = smallest_owners([texts[k] for k in part.tolist()], least[part], length)
            for chunk, shard, counts, these, ids in jobs:
                at = np.repeat(offset[these], counts) + _ramp(counts)
                rows.append((chunk, shard, 0, _blob(np.packbits(owners[at] < np.repeat(ids, counts))), b""))
        return _table(rows, ["chunk", "shard", "kind", "bits", "more"], "iiibb")

    return run


def _cut(length: int, shards: int, buckets: int, schema: pa.Schema, keep: list[str], text_col: str | None):
    """Chunk and its answers -> its rows with counts, and with the remaining text if ``text_col`` is given."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in schema})
        chunk = Chunk(left, length)
        known, inverse, _ = chunk.by_bucket(buckets)
        repeated = np.zeros(len(chunk.raw), dtype=np.int32)
        status, bits = np.zeros(len(known), dtype=np.int8), {}
        for shard, kind, a, b in zip(*(right[c].to_pylist() for c in ("shard", "kind", "bits", "more"))):
            if kind:
                status = sum(np.unpackbits(np.frombuffer(x, dtype="u1"), count=len(known)) for x in (a, b)).astype(np.int8)
            else:
                bits[shard] = np.frombuffer(a, dtype="u1")
        start, count, doc, number, first, shard, _ = chunk.shared(status, inverse, shards)
        if len(start):
            offset, flags, at = np.empty(len(first), dtype=np.int64), [], 0
            for s, texts in _split(shard):
                n = count[first[texts]]
                offset[texts] = at + np.cumsum(n) - n
                flags.append(np.unpackbits(bits[s], count=int(n.sum())))
                at += int(n.sum())
            flag = np.concatenate(flags)[np.repeat(offset[number], count) + _ramp(count)].astype(bool)
            flag |= np.repeat(chunk.ids[doc] > chunk.ids[doc[first[number]]], count)
            repeated[(np.repeat(start, count) + _ramp(count))[flag]] = 1
        total = np.cumsum(repeated)
        gone = total.copy()
        gone[length:] -= total[:-length] if len(total) > length else 0
        gone = gone > 0
        before = np.concatenate([[False], gone[:-1]]) if len(gone) else gone
        heads = gone & ~before
        edge = chunk.bounds[:-1][chunk.sizes > 0]
        heads[edge] = gone[edge]
        removed, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, heads))
        a, b = chunk.bounds[:-1], chunk.bounds[1:]
        n_removed, n_spans = removed[b] - removed[a], spans[b] - spans[a]
        kept = [chunk.bytes[x:y] if not n else chunk.raw[x:y][~gone[x:y]].tobytes() for x, y, n in zip(a.tolist(), b.tolist(), n_removed.tolist())]
        columns = {c: left[c].take(chunk.order) for c in keep}
        columns = {"n_bytes": pa.array(chunk.sizes), "n_removed": pa.array(n_removed), "n_spans": pa.array(n_spans), "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept])} | columns
        if text_col is not None:
            old = left[text_col].take(chunk.order)
            columns[text_col] = pa.array([o.as_py() if not n else k.decode("utf-8", "ignore") for o, n, k in zip(old, n_removed.tolist(), kept)], pa.string())
        return pa.table({f.name: columns[f.name].cast(f.type) for f in schema})

    return run


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, with_text: bool = False, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """Per input row: the columns ``keep`` (the id by default), n_bytes, n_removed, n_spans, kept_sha256; ``with_text`` replaces the text by what is left.

    A null text has no bytes and stays null. A very long text is one piece of a chunk, whose task holds it whole. Rows with a null id are neither sources nor cut. Rows that share an id don't
    count as repeats of each other. Characters whose bytes are cut in part are dropped from the returned text, not from
    the digest. An empty input gives an empty result. A kept column that has the name of a count stays and hides the count;
    other columns may have any name that doesn't start with two underscores.
    """
    spark, n = df.sparkSession, partitions(df.sparkSession)
    keep = [id_col] if keep is None else keep
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    total = df.agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).cast("bigint")).first()[0] or 0
    chunks, buckets, shards = (max(n, -(-total // size)) for size in (CHUNK_BYTES, BUCKET_BYTES, SHARD_BYTES))
    own = list(dict.fromkeys([*keep, *([text_col] if with_text else [])]))
    keyed = df.select(*own, F.col(id_col).cast("bigint").alias("__id"), F.xxhash64(text_col).alias("__th"), raw.alias("__raw"))
    dealt = keyed.withColumn("__chunk", F.pmod(F.xxhash64("__id", "__th", F.monotonically_increasing_id()), F.lit(chunks)).cast("int")).repartition(n, "__chunk")
    counted = dealt.groupBy("__chunk").applyInArrow(_count_anchors(length, buckets), _ANCHOR_SCHEMA)
    judged = counted.groupBy("bucket").applyInArrow(_judge_anchors(crowd), "chunk int, bucket int, shared binary, crowded binary")
    sent = dealt.groupBy("__chunk").cogroup(judged.groupBy("chunk")).applyInArrow(_send(length, buckets, shards), _SHARD_SCHEMA)
    solved = sent.groupBy("shard").applyInArrow(_solve(length), _ANSWER_SCHEMA)
    made = [("n_bytes", T.LongType()), ("n_removed", T.LongType()), ("n_spans", T.LongType()), ("kept_sha256", T.StringType())]
    out = T.StructType([df.schema[c] for c in own] + [T.StructField(c, t) for c, t in made if c not in own])
    arrow = _arrow_schema(spark, out)
    return dealt.groupBy("__chunk").cogroup(solved.groupBy("chunk")).applyInArrow(_cut(length, shards, buckets, arrow, keep, text_col if with_text else None), out)


def _arrow_schema(spark, schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
