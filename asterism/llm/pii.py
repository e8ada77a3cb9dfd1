"""Personal data: exact patterns with validators, and a semi-Markov conditional random field for what they leave out.

The model scores whole candidate segments of up to ``LONGEST`` tokens with features of the span: its shape, lengths,
checksums, separators and the word before it. A dynamic program over segment ends chooses boundaries and types jointly.
Only segments that hold a digit, an at sign or a written-out one can be entities, so the program runs over windows
around those; a token that no such segment reaches is outside in every labelling, so this changes no result. Windows,
scores and the program are linear in a text, and a block of tokens is in memory at a time. Weights are fitted by
``pii_train`` and kept beside this module.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base kinds in the order of results, then the kind that only the model finds.
KINDS = ("email", "ip", "card", "phone")
TYPES = (*KINDS, "secret")
#: Tokens in the longest entity that the model considers, and characters in the longest token of one.
LONGEST, LONG_TOKEN = 12, 128
#: Tokens before a segment that its score may look at, with the segment.
CONTEXT = LONGEST + 2
#: Characters of a shape.
SHAPE = 24

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_GLUE = _LOCAL - frozenset(".-%+_")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# A run of digits is matched whole or not at all, as greedy matching from its first digit does.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _HOST.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, kind by kind, leftmost and without overlap within a kind; matches that fail their check are dropped."""
    out = [("email", a, b) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x[-4:] or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


# --- the model

_TOKEN = re.compile(r"[^\W_]+|[^\s\w]|_")
_SEED = re.compile(r"[0-9]+|@|[\[({] ?(?:at|AT) ?[\])}]")
_WRITTEN_AT = re.compile(r"[\[({] ?(?:at|AT) ?[\])}]")
_SPACE = re.compile(r"\s")


def shape(text: str) -> str:
    """Digits to 9, letters to a or A, hexadecimal runs of 16 and more to h; repeated classes once."""
    out = []
    for c in text:
        k = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else "s" if c.isspace() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)[:SHAPE]


def _bucket(n: int) -> str:
    return str(n) if n <= 4 else "5-6" if n <= 6 else "7-8" if n <= 8 else "9-11" if n <= 11 else "12-15" if n <= 15 else "16-19" if n <= 19 else "20-31" if n <= 31 else "32+"


def span_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Features of the segment of tokens i to j, as whole span."""
    start, end = tokens[i][0], tokens[j - 1][1]
    span = text[start:end]
    digits = "".join(c for c in span if c.isascii() and c.isdigit())
    before = text[tokens[i - 1][0] : tokens[i - 1][1]].lower() if i else "^"
    two = text[tokens[i - 2][0] : tokens[i - 2][1]].lower() if i > 1 else "^"
    out = [
        "bias", f"n={_bucket(j - i)}", f"d={_bucket(len(digits))}", f"c={_bucket(len(span))}", f"s={shape(span)}",
        f"b={before[:12]}", f"bb={two[:12]}", f"first={shape(span[:1])}", f"last={shape(span[-1:])}",
        f"glueL={start > 0 and text[start - 1] in _LOCAL}", f"glueR={end < len(text) and text[end] in _GLUE}",
    ]
    if "@" in span or "[" in span or "(" in span or "{" in span:
        out.append(f"at={'@' in span or bool(_WRITTEN_AT.search(span))}")
    if digits:
        out.append(f"luhn={len(digits) >= 13 and luhn(digits)},{_bucket(len(digits))}")
        if span.count(".") == 3:
            out.append(f"quad={all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in span.split('.'))}")
        if len(span) >= 16 and all(c in "0123456789abcdefABCDEF" for c in span):
            out.append("hex")
    if _SPACE.search(span):
        out.append("space")
    return out


class Model:
    """Weights by type and feature, relative to a token that belongs to no entity, which scores 0."""

    def __init__(self, weights: dict[str, dict[str, float]]) -> None:
        self.weights = weights

    def score(self, kind: str, features: list[str]) -> float:
        w = self.weights.get(kind, {})
        return sum(w.get(f, 0.0) for f in features)

    def segments(self, text: str, tokens: list[tuple[int, int]], seeds: list[bool]) -> list[list[tuple[int, list[str]]]]:
        """For each end j the candidate entity segments (start, features) that hold a seed, start with a letter, digit, plus or bracket, end with a letter or digit, and have no wide gap, line end, long token or more than ``LONGEST`` tokens."""
        out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
        for j in range(1, len(tokens) + 1):
            held = False
            if not text[tokens[j - 1][1] - 1].isalnum():
                continue
            for i in range(j - 1, max(-1, j - 1 - LONGEST), -1):
                if i < j - 1 and (tokens[i + 1][0] - tokens[i][1] > 1 or "\n" in text[tokens[i][1] : tokens[i + 1][0]]) or tokens[i][1] - tokens[i][0] > LONG_TOKEN:
                    break
                held = held or seeds[i]
                if held and (text[tokens[i][0]].isalnum() or text[tokens[i][0]] in "+("):
                    out[j].append((i, span_features(text, tokens, i, j)))
        return out


def tokenize(text: str, start: int = 0, end: int | None = None) -> tuple[list[tuple[int, int]], list[bool]]:
    """Tokens of a window (letters and digits, or one other sign) and whether each touches a digit, an at sign or a written-out one."""
    end = len(text) if end is None else end
    tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
    marks = [m.span() for m in _SEED.finditer(text, start, end)]
    seeds, k = [], 0
    for a, b in tokens:
        while k < len(marks) and marks[k][1] <= a:
            k += 1
        seeds.append(k < len(marks) and marks[k][0] < b)
    return tokens, seeds


def windows(text: str) -> Iterator[tuple[int, int]]:
    """Stretches that hold every segment the model considers, and two tokens more on each side, in order and apart.

    Linear in the text: ends of tokens behind a seed are remembered for the next one, and no step goes back into the
    stretch before.
    """
    reach, start, end, ahead = CONTEXT, -1, -1, deque()
    for m in _SEED.finditer(text):
        a, b = m.span()
        if a > end:
            for _ in range(reach):
                if a <= max(end, 0):
                    break
                a = _step_back(text, a)
            if a > end:
                if start >= 0:
                    yield start, end
                start = a
        while ahead and ahead[0] <= b:
            ahead.popleft()
        at = ahead[-1] if ahead else b
        while len(ahead) < reach and at < len(text):
            t = _TOKEN.search(text, at)
            at = len(text) if t is None else t.end()
            ahead.append(at)
        end = ahead[-1] if ahead else len(text)
    if start >= 0:
        yield start, end


def _step_back(text: str, at: int) -> int:
    k = at
    while k and text[k - 1].isspace():
        k -= 1
    if not k:
        return 0
    word = text[k - 1].isalnum()
    k -= 1
    while word and k and text[k - 1].isalnum():
        k -= 1
    return k


# --- decoding

_BUCKETS = list(dict.fromkeys(map(_bucket, range(33))))
_CUTS = np.array([_BUCKETS.index(_bucket(n)) for n in range(33)])
#: Tokens that are scored at once; tokens and shapes whose parts are remembered.
_BLOCK, _REMEMBERED = 4096, 50_000


class _Weights:
    """The model's weights as rows of one number for each type, found by number instead of by name."""

    def __init__(self, crf: Model) -> None:
        self.crf = crf
        rows = lambda names: np.array([[crf.weights.get(k, {}).get(f, 0.0) for k in TYPES] for f in names])
        self.bias = rows(["bias"])[0]
        self.n, self.d, self.c = (rows([f"{x}={b}" for b in _BUCKETS]) for x in "ndc")
        self.glue_left, self.glue_right, self.at, self.quad = (rows([f"{x}=False", f"{x}=True"]) for x in ("glueL", "glueR", "at", "quad"))
        self.luhn = np.stack([rows([f"luhn={x},{b}" for b in _BUCKETS]) for x in (False, True)])
        self.hex, self.space = rows(["hex"])[0], rows(["space"])[0]
        self.named: dict[str, dict[str, int]] = {}
        self.table: dict[str, np.ndarray] = {}
        for prefix in ("b=", "bb=", "first=", "last=", "s="):
            names = sorted({f for k in TYPES for f in crf.weights.get(k, {}) if f.startswith(prefix)})
            self.named[prefix] = {f.removeprefix(prefix): k + 1 for k, f in enumerate(names)}
            self.table[prefix] = np.concatenate([np.zeros((1, len(TYPES))), rows(names).reshape(-1, len(TYPES))])

    def of(self, prefix: str, value: str) -> int:
        return self.named[prefix].get(value, 0)


class Decoder:
    """The best segmentations of a stream of windows: feed windows, take (number of the text, type, start, end) from ``found``.

    Windows stand one behind another, kept apart by gaps that no segment bridges. When a block of tokens is full, all its
    candidate segments are scored with array operations; only those that score more than 0 can win, since a token
    outside scores 0, and go through the dynamic program. What all best paths have in common is settled, and no more than
    the unsettled rest and the context of coming segments is kept: memory doesn't grow with a text.
    """

    def __init__(self, crf: Model) -> None:
        self.w = _Weights(crf)
        self.found: list[tuple[int, str, int, int]] = []
        self.known: dict[str, tuple] = {}
        self.rows: list[tuple] = []  # info, start, end, gap, seed, glue left, glue right, place in the window, text
        self.best, self.back, self.settled, self.old = [0.0], [], 0, 0
        self.shapes: dict[str, int] = {}
        self.names: list[str] = []
        self.joins: dict[int, int] = {}

    def info(self, word: str) -> tuple:
        """(shape, first, last, as word before, as word two before, digits, flags) of a token."""
        made = self.known.get(word)
        if made is None:
            long = len(word) > LONG_TOKEN
            digits = bytes(ord(c) - 48 for c in word if "0" <= c <= "9") if not long else b""
            low = word[:LONG_TOKEN].lower()[:12]
            byte = len(digits) == len(word) < 4 and int(word) < 256
            hexadecimal = not long and len(word) >= 16 and all(c in "0123456789abcdefABCDEF" for c in word)
            flags = (word == ".") + 2 * byte + 4 * (word[0].isalnum() or word[0] in "+(") + 8 * word[-1].isalnum() + 16 * hexadecimal + 32 * (word in "@[({") + 64 * (word == "@") + 128 * long + 256 * (word in ("at", "AT")) + 512 * (word in "])}")
            made = ("" if long else shape(word), self.w.of("first=", shape(word[0])), self.w.of("last=", shape(word[-1])), self.w.of("b=", low), self.w.of("bb=", low), digits, flags)
            if not long:
                if len(self.known) >= _REMEMBERED:
                    self.known.clear()
                self.known[word] = made
        return made

    def feed(self, number: int, text: str, a: int, b: int) -> None:
        seeds = _SEED.finditer(text, a, b)
        seed, before, size = next(seeds, None), -1, len(text)
        for place, m in enumerate(_TOKEN.finditer(text, a, b)):
            start, end = m.span()
            while seed is not None and seed.end() <= start:
                seed = next(seeds, None)
            gap = 0 if start == before else 2 if before < 0 or start - before > 1 or text[before] == "\n" else 1 if text[before] == " " else 3
            left, right = start > 0 and text[start - 1] in _LOCAL, end < size and text[end] in _GLUE
            self.rows.append((self.info(m[0]), start, end, gap, seed is not None and seed.start() < end, left, right, place if place < 2 else 2, number))
            before = end
            if len(self.rows) - self.old >= _BLOCK:
                self.flush()

    def _shape(self, text: str) -> int:
        made = self.shapes.get(text)
        if made is None:
            made = self.shapes[text] = len(self.names)
            self.names.append(text)
        return made

    def _joined(self, left: np.ndarray, gap: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Shapes of spans one token longer."""
        keys, inverse = np.unique((left << 33) | (right << 1) | gap, return_inverse=True)
        out = []
        for key in keys.tolist():
            made = self.joins.get(key)
            if made is None:
                s, t = self.names[key >> 33], self.names[(key >> 1) & 0xFFFFFFFF]
                if len(s) < SHAPE:
                    s += "s" if key & 1 and not s.endswith("s") else ""
                    s = (s + (t[1:] if t[:1] == s[-1:] else t))[:SHAPE]
                made = self.joins[key] = self._shape(s)
            out.append(made)
        return np.array(out, dtype=np.int64)[inverse]

    def _scores(self, first_end: int) -> list[list[tuple[int, float, int]]]:
        """For each new token the segments that end with it and score more than 0: (tokens, score, type)."""
        w, size = self.w, len(self.rows)
        infos, start, end, gap, seed, left, right, place, _ = zip(*self.rows)
        start, end, gap, place = (np.array(x, dtype=np.int64) for x in (start, end, gap, place))
        seed, left, right = (np.array(x, dtype=np.int64) for x in (seed, left, right))
        texts, firsts, lasts, b, bb, digits, flags = zip(*infos)
        if len(self.names) > _REMEMBERED:
            self.shapes, self.names, self.joins = {}, [], {}
        flag, own = np.array(flags, dtype=np.int64), np.array([self._shape(t) for t in texts], dtype=np.int64)
        b, bb = np.array(b, dtype=np.int64), np.array(bb, dtype=np.int64)
        before = np.where(place > 0, np.concatenate([[0], b[:-1]]), w.of("b=", "^"))
        two = np.where(place > 1, np.concatenate([[0, 0], bb[:-2]])[:size], w.of("bb=", "^"))
        at_start = w.table["b="][before] + w.table["bb="][two] + w.table["first="][np.array(firsts)] + w.glue_left[left] + w.bias
        at_end = w.table["last="][np.array(lasts)] + w.glue_right[right]
        total = lambda x: np.concatenate([[0], np.cumsum(x)])
        is_flag = lambda bit: (flag & bit) > 0
        barred, closed, seeded, spaced, dots, marks, signs = (total(x) for x in (gap == 2, is_flag(128), seed, gap & 1, is_flag(1), is_flag(32), is_flag(64)))
        d = np.frombuffer(b"".join(digits), dtype=np.uint8).astype(np.int64)
        offset = total([len(x) for x in digits])
        twice, odd = 2 * d - 9 * (d > 4), np.arange(len(d)) % 2 == 1
        checks = np.stack([total(np.where(odd, twice, d)), total(np.where(odd, d, twice))])
        written = np.full(size, -1, dtype=np.int64)  # where the last written-out at sign that ends here or before starts
        k = np.flatnonzero(is_flag(512)[2:] & is_flag(256)[1:-1] & (is_flag(32) & ~is_flag(64))[:-2] & (gap[2:] < 2) & (gap[1:-1] < 2))
        written[k + 2] = k
        written = np.maximum.accumulate(written)
        address = (is_flag(2), is_flag(1))
        out: list[list[tuple[int, float, int]]] = [[] for _ in range(size)]
        named = w.named["s="]
        shape_of, spans = own, np.arange(size)
        for n in range(1, LONGEST + 1):
            if n > 1:
                spans = spans[: size - n + 1]
                shape_of = self._joined(shape_of[: len(spans)], gap[n - 1 :] & 1, own[n - 1 :])
            i, j = spans, spans + n
            good = (j > first_end) & (barred[j] == barred[i + 1]) & (closed[j] == closed[i]) & (seeded[j] > seeded[i]) & is_flag(4)[i] & is_flag(8)[j - 1]
            i = i[good]
            if not len(i):
                continue
            j = i + n
            kinds, inverse = np.unique(shape_of[good], return_inverse=True)
            by_shape = w.table["s="][np.array([named.get(self.names[k], 0) for k in kinds.tolist()])]
            many = offset[j] - offset[i]
            bucket = _CUTS[np.minimum(many, 32)]
            v = at_start[i] + at_end[j - 1] + w.n[_CUTS[n]] + w.d[bucket] + w.c[_CUTS[np.minimum(end[j - 1] - start[i], 32)]] + by_shape[inverse]
            bracket, sign = marks[j] > marks[i], signs[j] > signs[i]
            v += np.where(bracket[:, None], w.at[(sign | (written[j - 1] >= i)).astype(np.int64)], 0.0)
            some, parity = many > 0, (offset[j] - 1) % 2
            sums = checks[parity, offset[j]] - checks[parity, offset[i]]
            v += np.where(some[:, None], w.luhn[((many >= 13) & (sums % 10 == 0)).astype(np.int64), bucket], 0.0)
            three = some & (dots[j] - dots[i] == 3)
            whole = np.zeros(len(i), dtype=np.int64)
            if n == 7:
                whole = (spaced[j] == spaced[i + 1]).astype(np.int64)
                for k in range(7):
                    whole &= address[k % 2][i + k]
            v += np.where(three[:, None], w.quad[whole], 0.0)
            if n == 1:
                v += np.where((some & is_flag(16)[i])[:, None], w.hex, 0.0)
            v += np.where((spaced[j] > spaced[i + 1])[:, None], w.space, 0.0)
            kind = v.argmax(axis=1)
            score = v[np.arange(len(v)), kind]
            for k in np.flatnonzero(score > 0).tolist():
                out[int(j[k]) - 1].append((n, float(score[k]), int(kind[k])))
        return out

    def flush(self, last: bool = False) -> None:
        """Score and settle what has been fed; ``last`` settles all."""
        size = len(self.rows)
        if size > self.old:
            scored = self._scores(self.old)
            for k in range(self.old, size):
                best, back = self.best[k], None
                for n, score, kind in scored[k]:
                    if (s := self.best[k + 1 - n] + score) > best:
                        best, back = s, (n, kind)
                self.best.append(best)
                self.back.append(back)
        paths = {size} if last else set(range(max(self.settled, size - LONGEST), size + 1))
        while len(paths) > 1:
            top = max(paths)
            paths.remove(top)
            paths.add(top - (self.back[top - 1][0] if self.back[top - 1] else 1))
        common, found = max(self.settled, paths.pop()), []
        k = common
        while k > self.settled:
            if (step := self.back[k - 1]) is None:
                k -= 1
                continue
            i = k - step[0]
            found.append((self.rows[i][8], TYPES[step[1]], self.rows[i][1], self.rows[k - 1][2]))
            k = i
        self.found += found[::-1]
        keep = size if last else min(common, max(0, size - CONTEXT))
        del self.rows[:keep], self.best[:keep], self.back[:keep]
        self.old, self.settled = size - keep, common - keep


@lru_cache(maxsize=1)
def model() -> Model:
    """The weights kept beside this module, in steps of 1/4096, so that sums are exact in any order."""
    found = json.loads((Path(__file__).parent / "pii_weights.json").read_text())
    return Model({kind: {f: round(x * 4096) / 4096 for f, x in w.items()} for kind, w in found.items()})


def find_all(texts: list[str], crf: Model | None = None) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """For each text (base spans, all spans): the model adds entities that overlap no base span."""
    decoder = Decoder(crf or model())
    for number, text in enumerate(texts):
        for a, b in windows(text):
            decoder.feed(number, text, a, b)
    decoder.flush(last=True)
    extra: dict[int, list[tuple[str, int, int]]] = {}
    for number, kind, a, b in decoder.found:
        extra.setdefault(number, []).append((kind, a, b))
    order, out = {k: n for n, k in enumerate(TYPES)}, []
    for number, text in enumerate(texts):
        base = base_spans(text)
        more = extra.get(number, [])
        if base and more:
            taken: list[list[int]] = []
            for _, a, b in sorted(base, key=lambda s: s[1:]):
                if taken and a < taken[-1][1]:
                    taken[-1][1] = max(taken[-1][1], b)
                else:
                    taken.append([a, b])
            starts = [a for a, _ in taken]
            # of disjoint stretches, the last that starts before the end of a span is the only one to look at
            more = [s for s in more if (k := bisect_left(starts, s[2])) == 0 or taken[k - 1][1] <= s[1]]
        out.append((base, sorted(dict.fromkeys(base + more), key=lambda s: (order[s[0]], s[1], s[2]))))
    return out


def find(text: str, crf: Model | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans) of one text."""
    return find_all([text], crf)[0]


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Text with each maximal run of overlapping spans replaced by the kind of its first span, like <EMAIL>."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per input row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, masked.

    Rows stay where they are: no shuffle. A null text is empty and has no spans; its mask is null. Null ids and repeated
    rows keep their rows; an empty input gives an empty result. Only the id and the text are read, so other columns may
    have any name. A very long text takes time in proportion to its length and memory for itself, its spans and a block
    of tokens. The model considers entities of at most ``LONGEST`` tokens of at most ``LONG_TOKEN`` characters; the base
    patterns have no such limit.
    """
    schema = pa.schema([("id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), ("masked", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model()
        for batch in batches:
            rows: list[list] = [[] for _ in schema.names[1:]]
            texts = batch.column(1).to_pylist()
            for text, (base, spans) in zip(texts, find_all([t or "" for t in texts], crf)):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                for column, x in zip(rows, (*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), None if text is None else mask(text, spans))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(rows, list(schema)[1:]))], schema=schema)

    slim = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    counts = "".join(f", n_{k} bigint" for k in KINDS)
    return slim.mapInArrow(run, f"id bigint{counts}, base_sha256 string, spans string, masked string").withColumnRenamed("id", id_col)


def mask_documents(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with every span of its texts, base and model's, replaced by its kind; other columns and null texts stay."""
    schema = df.schema
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = model()
        for batch in batches:
            given = batch.column(at).to_pylist()
            texts = [x if x is None else mask(x, spans) for x, (_, spans) in zip(given, find_all([x or "" for x in given], crf))]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return df.mapInArrow(run, schema)
