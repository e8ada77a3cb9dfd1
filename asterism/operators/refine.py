"""From words to a query, and from a result back to better queries."""

from __future__ import annotations

import re
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..network import Network
from ..schema import Query
from . import navigate

#: Words that constrain a bank: (bank, lowest, highest, direction). Fixed values.
BANK_WORDS = {
    "small": ("EFFICIENCY", None, -1, -1), "tiny": ("EFFICIENCY", None, -2, -1), "large": ("EFFICIENCY", 1, None, 1), "huge": ("EFFICIENCY", 2, None, 1), "frontier": ("EFFICIENCY", 3, None, 1),
    "base": ("LINEAGE", -1, 0, -1), "fine-tune": ("LINEAGE", 1, None, 1), "finetune": ("LINEAGE", 1, None, 1), "derivative": ("LINEAGE", 2, None, 1), "trending": ("QUALITY", 1, None, 1), "popular": ("QUALITY", 1, None, 1),
    "novel": ("ARCHITECTURE", 1, None, 1), "specialized": ("DOMAIN", 1, None, 1), "general": ("DOMAIN", -1, 0, -1), "aligned": ("TRAINING", 1, None, 1), "rlhf": ("TRAINING", 1, None, 1), "dpo": ("TRAINING", 1, None, 1),
    "sft": ("TRAINING", None, 0, 0), "lora": ("TRAINING", None, -1, -1), "adapter": ("TRAINING", None, -1, -1), "distilled": ("TRAINING", None, -2, -1),
}
_LIKE = re.compile(r"(?:like|similar\s+to|related\s+to)\s+([a-zA-Z0-9/_.-]+)", re.IGNORECASE)


def parse(text: str, labels: dict[str, str] | None = None) -> tuple[Query, dict[str, tuple[int | None, int | None, int | None]]]:
    """A query from words: bank words give directions and ranges, known words labels, "like X" a seed.

    ``labels`` maps lower-case words to labels. Later words win over earlier ones of the same bank.
    """
    words = re.findall(r"[a-zA-Z0-9_.-]+", text.lower())
    directions: dict[str, int] = {}
    ranges: dict[str, tuple[int | None, int | None, int | None]] = {}
    for w in words:
        if w in BANK_WORDS:
            bank, low, high, direction = BANK_WORDS[w]
            directions[bank], ranges[bank] = direction, (low, high, direction)
    prefer = tuple(dict.fromkeys((labels or {})[w] for w in words if w in (labels or {})))
    seed = _LIKE.search(text)
    return Query(directions=directions, prefer=prefer, similar_to=seed[1] if seed else None), ranges


def refined(q: Query, **changes: Any) -> Query:
    """A query with changes: label tuples and dictionaries are added to, other fields replaced."""
    merged = {}
    for name, value in changes.items():
        old = getattr(q, name)
        merged[name] = tuple(dict.fromkeys((*old, *value))) if isinstance(old, tuple) and name != "vibe" else {**old, **value} if isinstance(old, dict) else value
    return replace(q, **merged)


def unknown_labels(net: Network, q: Query) -> list[str]:
    """Labels of a query that the vocabulary lacks, in order, each once."""
    asked = list(dict.fromkeys((*q.require, *q.prefer, *q.avoid, *q.context)))
    known = {r["label"] for r in net.anchors.where(F.col("label").isin(*asked)).select("label").collect()} if asked else set()
    return [a for a in asked if a not in known]


def guidance(net: Network, q: Query, window: DataFrame) -> dict[str, Any]:
    """What would sharpen a result: whether it is degraded or unfiltered, the open axes and labels that split it best, and a question."""
    axes = [r.asDict() for r in navigate.axis_hints(net, window, [*q.directions]).orderBy(F.desc("variance"), "bank").limit(3).collect()]
    labels = [r.asDict() for r in navigate.anchor_hints(net, window, 3).collect()]
    options = []
    for a in axes:
        if a["low"] < 0 < a["high"]:
            options += [(a["bank"], -1), (a["bank"], 1)]
        else:
            options.append((a["bank"], 1 if a["high"] > 0 else -1 if a["low"] < 0 else 0))
    question = f"Which side of {axes[0]['bank']}: lower or higher?" if axes else f"Should results carry {labels[0]['label']}?" if labels else ""
    return {"degraded": window.limit(1).count() == 0, "unfiltered": not q.require, "unknown": unknown_labels(net, q), "axes": axes, "labels": labels, "options": options, "question": question}
