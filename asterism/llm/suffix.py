"""Suffix arrays by induced sorting and permuted common prefixes, on numpy arrays.

Induction goes through the buckets of first characters in order. Over bytes all suffixes of a bucket that are known are
handled at once, so a pass needs a few hundred array operations. The names of a reduced string make buckets of a few
suffixes, so there the same passes go suffix by suffix. Both are linear in the string, and recursion goes on until names
are unique, however many there are.
"""

from __future__ import annotations

import numpy as np

#: Over alphabets up to this, induction handles whole buckets; over larger ones, suffixes one by one.
BUCKETWISE = 1024


def _smaller_types(text: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one behind them; the last, a unique smallest sentinel, counts as such."""
    n = len(text)
    up = np.zeros(n, dtype=bool)
    up[:-1] = text[:-1] < text[1:]
    up[-1] = True
    decided = np.ones(n, dtype=bool)
    decided[:-1] = text[:-1] != text[1:]
    at = np.where(decided, np.arange(n), n)
    return up[np.minimum.accumulate(at[::-1])[::-1]]  # equal neighbours take the type of the next unequal pair


def _push(queues: list[list[np.ndarray]], positions: np.ndarray, chars: np.ndarray) -> None:
    """Append positions to the queues of their characters, in order."""
    if not len(positions):
        return
    order = np.argsort(chars, kind="stable")
    chars, positions = chars[order], positions[order]
    cuts = np.flatnonzero(chars[1:] != chars[:-1]) + 1
    bounds = [0, *cuts.tolist(), len(chars)]
    for a, b in zip(bounds, bounds[1:]):
        queues[chars[a]].append(positions[a:b])


def _scan(text: np.ndarray, of_type: np.ndarray, queues: list[list[np.ndarray]], c: int) -> np.ndarray:
    """Bucket c's suffixes of one type in scanning order; what they induce is pushed to the other buckets."""
    parts, now = [], np.concatenate(queues[c]) if queues[c] else None
    while now is not None and len(now):
        parts.append(now)
        before = now[now > 0] - 1
        before = before[of_type[before]]
        chars = text[before]
        own = chars == c
        _push(queues, before[~own], chars[~own])
        now = before[own]
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int32)


def _feed(text: np.ndarray, of_type: np.ndarray, queues: list[list[np.ndarray]], seen: np.ndarray) -> None:
    before = seen[seen > 0] - 1
    before = before[of_type[before]]
    _push(queues, before, text[before])


def _induce(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """The suffix array from the leftmost-smaller suffixes in order; from any order of them, leftmost-smaller substrings get sorted."""
    if alphabet > BUCKETWISE:
        return _induce_each(text, smaller, lms, alphabet)
    larger = ~smaller
    seeds: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    _push(seeds, lms, text[lms])
    queues: list[list[np.ndarray]] = [[] for _ in range(alphabet)]
    heads = []
    for c in range(alphabet):
        heads.append(_scan(text, larger, queues, c))
        if seeds[c]:
            _feed(text, larger, queues, np.concatenate(seeds[c]))
    queues = [[] for _ in range(alphabet)]
    tails: list[np.ndarray] = []
    for c in range(alphabet - 1, -1, -1):
        tails.append(_scan(text, smaller, queues, c)[::-1])
        _feed(text, smaller, queues, heads[c][::-1])
    out = [np.array([len(text) - 1], dtype=np.int32)]  # the sentinel, which nothing induces
    for head, tail in zip(heads, reversed(tails)):
        out += (head, tail)
    return np.concatenate(out)


def _induce_each(text: np.ndarray, smaller: np.ndarray, lms: np.ndarray, alphabet: int) -> np.ndarray:
    """``_induce`` with one array of all suffixes, whose buckets fill from their heads, then from their tails."""
    n = len(text)
    text = text.astype(np.int64)
    ends = np.cumsum(np.bincount(text, minlength=alphabet))
    starts = np.concatenate([[0], ends[:-1]])
    grouped = lms[np.argsort(text[lms], kind="stable")]
    chars = text[grouped]
    first = np.searchsorted(chars, chars)
    held = np.bincount(chars, minlength=alphabet)
    placed = np.full(n, -1, dtype=np.int64)
    placed[ends[chars] - held[chars] + np.arange(len(grouped)) - first] = grouped
    order = placed.tolist()
    # the character of the suffix before, if it has the type of the pass; else, and for empty places (-1), -1
    before = np.full(n + 1, -1, dtype=np.int64)
    before[1:n] = np.where(smaller[: n - 1], -1, text[: n - 1])
    heads, induced = starts.tolist(), before.tolist()
    for j in order:
        c = induced[j]
        if c >= 0:
            order[heads[c]] = j - 1
            heads[c] += 1
    before[1:n] = np.where(smaller[: n - 1], text[: n - 1], -1)
    tails, induced = ends.tolist(), before.tolist()
    for j in reversed(order):
        c = induced[j]
        if c >= 0:
            tails[c] -= 1
            order[tails[c]] = j - 1
    return np.array(order, dtype=np.int32)


def _names(text: np.ndarray, lms: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int]:
    """Names of the leftmost-smaller substrings in text order, and how many there are."""
    length = np.zeros(len(text), dtype=np.int32)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = ordered[:-1], ordered[1:]
    active = np.flatnonzero(length[a] == length[b])
    same = np.zeros(len(a), dtype=bool)
    k = 0
    while len(active):
        active = active[text[a[active] + k] == text[b[active] + k]]
        k += 1
        over = length[a[active]] == k
        same[active[over]] = True
        active = active[~over]
    name = np.zeros(len(text), dtype=np.int32)
    name[ordered] = np.concatenate([[0], np.cumsum(~same)])
    return name[lms], int(len(a) - same.sum()) + 1


def suffix_array(text: np.ndarray, alphabet: int) -> np.ndarray:
    """Starts of the suffixes of ``text`` in order. The text ends with its only 0, and its values are below ``alphabet``."""
    n = len(text)
    if n == 1:
        return np.zeros(1, dtype=np.int32)
    smaller = _smaller_types(text)
    lms = (np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1).astype(np.int32)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    rough = _induce(text, smaller, lms, alphabet)
    names, count = _names(text, lms, rough[is_lms[rough]])
    if count == len(lms):
        order = np.argsort(names)
    else:
        order = suffix_array(names, count)
    return _induce(text, smaller, lms[order], alphabet)


def _common(text: np.ndarray, words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a and b, which differ before the text ends."""
    out, active, k = np.zeros(len(a), dtype=np.int32), np.arange(len(a)), 0
    last = len(words)
    while len(active):  # four characters at a time
        x, y = a[active] + k, b[active] + k
        near = (x < last) & (y < last)
        go = np.zeros(len(active), dtype=bool)
        go[near] = words[x[near]] == words[y[near]]
        out[active[~go]] = k
        active = active[go]
        k += 4
    active = np.arange(len(a))
    while len(active):
        x, y = a[active] + out[active], b[active] + out[active]
        active = active[text[x] == text[y]]
        out[active] += 1
    return out


def permuted_common_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each suffix by its start the length it shares with the suffix before it in the array.

    Only where the characters before the two differ is the length found by comparing; elsewhere it is one less than that
    of the start before.
    """
    n = len(text)
    phi = np.full(n, -1, dtype=np.int64)
    phi[order[1:]] = order[:-1]
    m = max(0, n - 3)
    words = text[:m].astype(np.uint64)
    for k in range(1, 4):
        words |= text[k : m + k].astype(np.uint64) << np.uint64(16 * k)
    start = np.arange(n)
    fresh = np.ones(n, dtype=bool)
    inner = np.flatnonzero((start > 0) & (phi > 0))
    fresh[inner] = text[inner - 1] != text[phi[inner] - 1]
    found = np.zeros(n, dtype=np.int32)
    at = np.flatnonzero(fresh & (phi >= 0))
    found[at] = _common(text, words, at, phi[at])
    source = np.maximum.accumulate(np.where(fresh, start, 0))
    return np.where(phi >= 0, found[source] - (start - source), 0).astype(np.int32)


def smallest_owners(strings: list[bytes], owners: np.ndarray, length: int) -> np.ndarray:
    """For each substring of ``length`` bytes of each string, in order, the smallest owner of a string that holds it.

    The strings differ from one another. They are joined with separators and suffix-sorted; substrings that are equal
    stand next to each other, with common prefixes of at least ``length``.
    """
    sizes = np.array([len(s) for s in strings], dtype=np.int64)
    raw = np.frombuffer(b"\0".join(strings) + b"\0\0", dtype=np.uint8)
    text = raw.astype(np.uint16) + 2
    ends = np.cumsum(sizes + 1) - 1
    text[ends] = 1
    text[-1] = 0
    order = suffix_array(text, 258)
    prefix = permuted_common_prefixes(text, order)[order]
    piece = np.repeat(np.arange(len(strings)), sizes + 1)
    owner = np.full(len(text), np.iinfo(np.int64).max)
    owner[:-1] = owners[piece]
    heads = np.flatnonzero(prefix < length)
    least = np.minimum.reduceat(owner[order], heads)
    spread = np.empty(len(text), dtype=np.int64)
    spread[order] = np.repeat(least, np.diff(np.concatenate([heads, [len(text)]])))
    room = ends[piece] - np.arange(len(piece))  # bytes left in the string
    return spread[:-1][room >= length]
