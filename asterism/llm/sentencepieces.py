"""Exact encoding and decoding with a SentencePiece merge model, by backtracking instead of a merge queue.

A sequence of pieces is the result of merging iff every piece is what its own text merges to and every two neighbours
stay apart when their joint text is merged again. So the encoder takes the longest piece at a position (all matches come
from one Aho-Corasick pass), checks it against the piece before it, falls back to its longest shorter prefix, and steps
back when none fits; a bitfield of positions that can't be reached with a valid rest keeps it from trying them again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
_FAR = 1 << 60
#: A worker remembers at most twice this many different words of at most so many characters.
MEMORY, WORD = 600_000, 48


@dataclass
class Tables:
    """What encoding and decoding need of a model; its size is that of the vocabulary."""

    pieces: list[str]
    rank: dict[str, int]  # of pieces that text can become: -1 for single characters, else the order of merging
    ids: dict[str, int]
    parts: dict[str, tuple[str, str]]  # the last merge of a piece
    prefix: dict[str, str | None]  # the longest shorter piece that a piece starts with
    byte_ids: list[int]
    special: set[int]
    unknown: int
    end: int
    breaks: bool  # no piece holds a mark behind another character
    complete: bool  # each character of a piece is a piece
    runs: frozenset[int]  # runs of so many marks are pieces that join last, leftmost first


def _merged(text: str, order: dict[str, float]) -> tuple[list[str], tuple[str, str] | None]:
    """The plain rule: join the best-scored neighbours, leftmost first, until none join; and the last join."""
    parts, last = list(text), None
    while len(parts) > 1:
        best = max(((order[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in order), default=None)
        if best is None:
            break
        i = -best[1]
        last = (parts[i], parts[i + 1])
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts, last


def tables(model: bytes) -> Tables:
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    byte_ids, special, score = [0] * 256, set(), {}
    for i, piece in enumerate(pieces):
        if sp.is_byte(i):
            byte_ids[int(piece[1:-1], 16)] = i
        elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
            special.add(i)
        else:
            score[piece] = sp.get_score(i)
    lowest = min(score.values())
    late = sorted(p for p, v in score.items() if len(p) > 1 and v == lowest)  # one score: the leftmost joins first
    if len(late) == 1 or any(p.strip(MARK) for p in late):
        late = []
    score = {p: v for p, v in score.items() if p not in late}
    if len({v for k, v in score.items() if len(k) > 1}) != sum(len(k) > 1 for k in score):
        raise ValueError("two pieces of the model have one score")
    ordered = {p: k for k, p in enumerate(sorted((p for p in score if len(p) > 1), key=lambda p: -score[p]))}
    rank, parts = {}, {}
    for piece in score:
        if len(piece) == 1:
            rank[piece] = -1
            continue
        made, last = _merged(piece, score)
        if made == [piece]:
            rank[piece], parts[piece] = ordered[piece], last
    prefix = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in rank), None) for p in rank}
    breaks = not any(a != MARK and b == MARK for p in rank for a, b in zip(p, p[1:]))
    complete = all(c in rank for p in rank for c in p)
    return Tables(pieces, rank, {p: i for i, p in enumerate(pieces) if p in rank or p in late}, parts, prefix, byte_ids, special, sp.unk_id(), sp.eos_id(), breaks, complete, frozenset(map(len, late)))


class Codec(dict):
    """Encodes and decodes; as a dict it remembers the ids of words, so that repeated words cost one look-up."""

    def __init__(self, t: Tables) -> None:
        super().__init__()
        if not t.complete:
            raise ValueError("a character of a piece is no piece of its own")
        self.t, self.apart, self.old = t, {}, {}
        self.automaton = ahocorasick.Automaton()
        for piece in t.rank:
            self.automaton.add_word(piece, len(piece) - 1)
        self.automaton.make_automaton()
        self.signs = frozenset(p for p in t.rank if len(p) == 1)
        self.raw = [b"" if i in t.special and i != t.unknown else p.replace(MARK, " ").encode() for i, p in enumerate(t.pieces)]
        self.raw[t.unknown] = " ⁇ ".encode()
        self.of_byte = {i: b for b, i in enumerate(t.byte_ids)}
        for i, b in self.of_byte.items():
            self.raw[i] = bytes([b])

    def stays_apart(self, a: str, b: str) -> bool:
        """Whether a and b remain two pieces when their joint text is merged: undo the later of the merges next to the
        border again and again, and see that the two pieces now at the border would not have joined before it."""
        rank, parts, left, right, before, good = self.t.rank, self.t.parts, a, b, _FAR, True
        while True:
            if (joined := rank.get(left + right)) is not None and joined < before:
                good = False
                break
            at_left, at_right = rank[left], rank[right]
            if at_left < 0 and at_right < 0:
                break
            if at_left > at_right:  # an equal merge at the left comes first
                before, left = at_left, parts[left][1]
            else:  # the border is left of that merge, so an equal one at the border comes first
                before, right = at_right + 1, parts[right][0]
        if len(self.apart) > 1_000_000:
            self.apart.clear()
        self.apart[a, b] = good
        return good

    def _known(self, text: str) -> list[int]:
        """Ids of text whose characters are all pieces."""
        n, ends = len(text), [0] * len(text)
        for last, back in self.automaton.iter(text):  # in order of their ends: the longest from a place comes last
            ends[last - back] = last + 1
        ids, to = self.t.ids, ends[0]
        if to == n and (not self.t.runs or text.count(MARK) < 2):
            return [ids[text]]  # a piece of its own
        prefix, apart, at, out, failed, before = self.t.prefix, self.apart, 0, [], bytearray((n >> 3) + 1), None
        piece: str | None = text[:to]
        while at < n:
            while piece is not None:
                to = at + len(piece)
                if not failed[to >> 3] >> (to & 7) & 1:
                    if before is None or (good := apart.get((before, piece))) or good is None and self.stays_apart(before, piece):
                        break
                piece = prefix[piece]
            if piece is not None:
                out.append(piece)
                at, before = to, piece
                if at < n:
                    piece = text[at : ends[at]]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                piece = out.pop()
                at -= len(piece)
                before = out[-1] if out else None
        return [ids[p] for p in (self._joined(out) if self.t.runs and text.count(MARK) > 1 else out)]

    def _joined(self, pieces: list[str]) -> list[str]:
        """Marks that follow one another join to runs, at the leftmost place where two pieces make a run first."""
        out: list[str] = []
        for single, group in groupby(pieces, key=lambda p: p == MARK):
            if not single:
                out += group
                continue
            left, sizes = sum(1 for _ in group), []
            while left:
                if sizes and sizes[-1] + 1 in self.t.runs:
                    sizes[-1] += 1
                    left -= 1
                else:
                    sizes.append(2 if left > 1 and 2 in self.t.runs else 1)
                    left -= sizes[-1]
                while len(sizes) > 1 and sizes[-2] + sizes[-1] in self.t.runs:
                    sizes[-2:] = [sizes[-2] + sizes[-1]]
            out += [MARK * k for k in sizes]
        return out

    def _any(self, text: str) -> tuple[int, ...]:
        """Ids of any text; a character that is no piece becomes its UTF-8 bytes and joins nothing."""
        rank, out, start = self.t.rank, [], 0
        if self.signs.issuperset(text):
            return tuple(self._known(text))
        for k, c in enumerate(text):
            if c not in rank:
                if start < k:
                    out += self._known(text[start:k])
                out += [self.t.byte_ids[b] for b in c.encode("utf-8", "replace")]
                start = k + 1
        if start < len(text):
            out += self._known(text[start:])
        return tuple(out)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if (ids := self.old.get(word)) is None:
            ids = self._any(MARK + word.replace(" ", MARK))
        if len(word) <= WORD:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def words(self, text: str) -> list[str]:
        """Parts of text that merge on their own: each stands for a mark and the part, with spaces for further marks."""
        found = text.replace(MARK, " ").split(" ") if self.t.breaks else [text.replace(MARK, " ")]
        if "" not in found:
            return found
        out, gap = [], -1
        for w in found:
            gap += 1
            if w:
                out.append(" " * gap + w)
                gap = -1
        if gap >= 0:
            out.append(" " * gap)
        return out

    def encode(self, text: str | None) -> list[int]:
        """Ids of whole text, the end id last; a null or empty text has the end id alone."""
        if not text:
            return [self.t.end]
        ids = list(chain.from_iterable(map(self.__getitem__, self.words(text))))
        ids.append(self.t.end)
        return ids

    def decode(self, ids: list[int]) -> str:
        """Text of ids: the space that encoding puts first goes, bytes that make no character become U+FFFD each."""
        try:  # a special id parts bytes that would make a character together
            text = b"".join(map(self.raw.__getitem__, ids)).decode() if self.t.special.isdisjoint(ids[:-1]) else self._lenient(ids)
        except UnicodeDecodeError:
            text = self._lenient(ids)
        first = next((i for i in ids if i not in self.t.special or i == self.t.unknown), None)
        return text[1:] if first is not None and first not in self.of_byte and first != self.t.unknown and text[:1] == " " else text

    def _lenient(self, ids: list[int]) -> str:
        out, held = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                size = next((k for k in (1, 2, 3, 4) if _is_character(bytes(held[at : at + k]), k)), 0)
                out.append(held[at : at + size].decode() if size else "�")
                at += size or 1
            held.clear()

        for i in ids:
            if (b := self.of_byte.get(i)) is not None:
                held.append(b)
            else:
                flush()
                out.append(self.raw[i].decode())
        flush()
        return "".join(out)


def _is_character(raw: bytes, size: int) -> bool:
    try:
        return len(raw) == size and len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def encode_documents(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` also ids array<int> and decoded string.

    Rows stay where they are: no shuffle. The model is read on the driver and its tables, bounded by the vocabulary, are
    broadcast. Null ids, repeated rows and empty inputs need no care; a null text is an empty one. A very long text is
    encoded whole in its task. Only the id and the text are read, so other columns may have any name.
    """
    with open(model_path, "rb") as f:
        known = df.sparkSession.sparkContext.broadcast(tables(f.read()))
    extra = [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] if with_ids else []
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *extra])
    names = [str(i) for i in range(len(known.value.pieces))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, sha = Codec(known.value), hashlib.sha256
        for batch in batches:
            counts, digests, decoded, lists, texts = [], [], [], [], []
            for value in batch.column(1):
                ids = codec.encode(value.as_py())
                text = codec.decode(ids)
                counts.append(len(ids))
                digests.append(sha(" ".join(map(names.__getitem__, ids)).encode()).hexdigest())
                decoded.append(sha(text.encode("utf-8", "replace")).hexdigest())
                if with_ids:
                    lists.append(ids)
                    texts.append(text)
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                columns += [pa.array(lists, pa.list_(pa.int32())), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    more = ", ids array<int>, decoded string" if with_ids else ""
    return slim.mapInArrow(run, f"id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string{more}").withColumnRenamed("id", id_col)
