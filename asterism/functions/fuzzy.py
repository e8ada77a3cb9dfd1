"""String likeness that the engine lacks: token-set ratio, in Arrow batches."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the summed lengths."""
    if not a and not b:
        return 1.0
    at: dict[str, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    full = rest = (1 << len(a)) - 1  # the bits that are 0 in the end count the subsequence
    for y in b:
        met = rest & at.get(y, 0)
        rest = (rest + met | rest - met) & full
    return 2 * (len(a) - rest.bit_count()) / (len(a) + len(b))


@lru_cache(maxsize=100_000)
def token_set(a: str, b: str) -> float:
    """The best ratio between the common words, and these with the rest of either side."""
    x, y = set(a.split()), set(b.split())
    common = " ".join(sorted(x & y))
    if common and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, [common, *sorted(s)])) for s in (x - y, y - x))
    best = ratio(left, right)
    return max(best, ratio(common, left), ratio(common, right)) if common else best


def name_score(fields: list[str], wanted: list[str]) -> float:
    """Mean over the wanted words of the best field's likeness, 0.2 more where the field contains the word, at most 1."""
    if not wanted:
        return 0.0
    return sum(max(min(1.0, token_set(w, f) + (0.2 if w in f else 0.0)) for f in fields) for w in wanted) / len(wanted)


@F.pandas_udf(DoubleType())
def token_set_ratio(fields: pd.Series, wanted: pd.Series) -> pd.Series:
    return pd.Series([name_score([f or "" for f in fs], w.split()) for fs, w in zip(fields, wanted)])


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts by matching blocks."""
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])
