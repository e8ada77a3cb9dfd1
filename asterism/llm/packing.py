"""Packing of tokenized documents into sequences by shortest-pack-first over the histogram of lengths.

Each document's ids (its tokens and an end id) are cut into full pieces and one remainder. The histogram of remainder
lengths, at most one count for each length, is packed on the driver: lengths are placed longest first, each into the
patterns that are shortest so far, which have the most room left, many sequences of a pattern at a time. Patterns are then joined back to the pieces by their rank among pieces of the same length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import materialize

CAPACITY = 1024
END_ID = 0
#: The split before merging that a byte-level pre-tokenizer with use_regex stands for.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MEMORY, WORD = 250_000, 48


def _byte_of_sign() -> dict[str, int]:
    """The byte that each printable sign of a byte-level vocabulary stands for: printable Latin-1 bytes are themselves, the rest follow from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokens(dict):
    """Ids as little-endian unsigned 32-bit bytes; as a dict it remembers words, which split before a space and a visible character."""

    def __init__(self, spec: str) -> None:
        super().__init__()
        self.whole, self.old, self.fast = Tokenizer.from_str(spec), {}, None
        known = json.loads(spec)
        self.specials = [t["content"] for t in known["added_tokens"]]
        model, before = known["model"], known.get("pre_tokenizer") or {}
        simple = model["type"] == "BPE" and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True) and not known.get("normalizer") and not model.get("ignore_merges") and not model.get("dropout")
        if simple:
            sign = _byte_of_sign()
            ranks = {bytes(sign[c] for c in piece): i for piece, i in model["vocab"].items() if piece not in self.specials}
            merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
            made = [model["vocab"][a + b] for a, b in merges]
            if made == sorted(made) and len(ranks) == 256 + len(merges):  # ids follow the order of merging
                self.fast = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, word: str) -> bytes:
        if (raw := self.old.get(word)) is None:
            raw = np.array(self.fast.encode_ordinary(word), dtype="<u4").tobytes()
        if len(word) <= WORD:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[word] = raw
        return raw

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.fast is None or any(s in text for s in self.specials):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.split(" ")
        words, hold = [], first
        for w in rest:  # a space stays with the white space around it, else it starts a word
            if w and not w[0].isspace():
                words.append(hold)
                hold = " " + w
            else:
                hold += " " + w
        words.append(hold)
        return b"".join(map(self.__getitem__, words))


def piece_lengths(n: int, capacity: int = CAPACITY) -> list[int]:
    """Full pieces, then the remainder."""
    full, rest = divmod(n, capacity)
    return [capacity] * full + ([rest] if rest else [])


def tokenized_pieces(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, pid, local (its place among this partition's pieces of its length), and with ``keep_ids`` ids."""
    with open(tokenizer_path) as f:
        spec = df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary file
    fields = [("id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("pid", pa.int32()), ("local", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if keep_ids else []))
    end = np.array([END_ID], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, tokens, seen = TaskContext.get().partitionId(), Tokens(spec.value), [0] * (capacity + 1)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw, at = tokens.encode(value.as_py() or "") + end, 0
                total = len(raw) // 4
                for length in piece_lengths(total, capacity):
                    part = raw[4 * at : 4 * (at + length)]
                    row = (key, at, length, zlib.crc32(part), total, pid, seen[length], *([np.frombuffer(part, dtype="<i4")] if keep_ids else []))
                    for column, x in zip(rows, row):
                        column.append(x)
                    seen[length] += 1
                    at += length
                if len(rows[0]) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)
                    rows = [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema)], schema=schema)

    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    more = ", ids array<int>" if keep_ids else ""
    return slim.mapInArrow(run, f"id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, pid int, local bigint{more}")


@dataclass
class Pattern:
    lengths: tuple[int, ...]
    count: int


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of lengths, longest first, that hold every length of the histogram as often as it counts.

    Work and result depend on the number of lengths, at most ``capacity``, and not on the counts: a length takes as many
    sequences of one pattern as there are, so each step uses up a pattern or a length.
    """
    by_room: dict[int, list[Pattern]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = next((r for r in range(capacity - 1, length - 1, -1) if by_room.get(r)), None)
            if room is None:  # no pack has room: open as many as this length needs when it fills each of them
                full, rest = divmod(left, capacity // length)
                for k, count in ((capacity // length, full), (rest, 1 if rest else 0)):
                    if count:
                        by_room.setdefault(capacity - k * length, []).append(Pattern((length,) * k, count))
                break
            held = by_room[room].pop()
            take = min(left, held.count)
            if held.count > take:
                by_room[room].append(Pattern(held.lengths, held.count - take))
            by_room.setdefault(room - length, []).append(Pattern((*held.lengths, length), take))
            left -= take
    return [p for room in sorted(by_room) for p in by_room[room] if p.count]


def placements(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the pieces of a length with these ranks go to consecutive sequences at the offset."""
    out, used, sequence = [], {}, 0
    for p in patterns:
        at = 0
        for length in p.lengths:
            first = used.get(length, 0)
            out.append((length, first, first + p.count, sequence, at))
            used[length] = first + p.count
            at += length
        sequence += p.count
    return out


def pack(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """A row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    Every row has at least the end id, so null and empty texts have a piece of one id; repeated rows and null ids are
    packed as they are; an empty input packs nothing. A very long text is tokenized whole in its task and cut into pieces.
    Only the id and the text are read, so other columns may have any name. Pieces are written to the shared folder once. A piece's rank is its
    place in its partition plus the counts of that length in earlier partitions, so a length that many documents share
    isn't gathered anywhere. To the driver go only the histogram's counts, at most ``capacity``; the placements are
    bounded by the histogram too and broadcast.
    """
    spark = df.sparkSession
    pieces = materialize(tokenized_pieces(df, tokenizer_path, id_col, text_col, capacity, keep_ids), "pieces")
    counts = pieces.groupBy("pid", "length").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = placements(shortest_pack_first(histogram, capacity))
    before = Window.partitionBy("length").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0))).select("pid", "length", "shift")
    at = spark.createDataFrame(places or [(0, 0, 0, 0, 0)], "place_length bigint, low bigint, high bigint, first bigint, offset bigint")
    ranked = pieces.join(starts, ["pid", "length"]).withColumn("rank", F.col("local") + F.col("shift"))
    inside = (F.col("length") == F.col("place_length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = ranked.join(F.broadcast(at), inside)
    more = ["ids"] if keep_ids else []
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("rank") - F.col("low")).alias("sequence_id"), "offset", *more)

