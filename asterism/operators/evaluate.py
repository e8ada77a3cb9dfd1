"""Quality of answers: cases of a query with predicates over its window, and the difference of two reports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..network import Network
from ..schema import Query
from . import navigate


@dataclass(frozen=True)
class Case:
    """A query, predicates that every row of the window should satisfy, ones for the window, and labels of which one should appear."""

    name: str
    query: Query
    each: dict[str, Callable[[Row], bool]]
    window: dict[str, Callable[[list[Row]], bool]]
    expect_any: tuple[str, ...] = ()


CASES = (
    Case("promo", Query(require=("PROMO",), prefer=("red",), limit=10), {"has_promo": lambda r: "PROMO" in r["labels"]}, {"not_empty": bool}, ("red",)),
    Case("small", Query(directions={"EFFICIENCY": -1}, limit=10), {"aligned": lambda r: r["bank_alignment"] == 1.0}, {"ordered": lambda rows: all(r["score"] > 0 for r in rows)}),
    Case("unknown", Query(require=("no-such-label",), limit=10), {}, {"empty": lambda rows: not rows}),
    Case("avoid", Query(prefer=("high-volume",), avoid=("return-prone",), limit=10), {"not_avoided": lambda r: "return-prone" not in r["labels"]}, {"ten": lambda rows: len(rows) == 10}, ("high-volume",)),
)


def evaluate(net: Network, cases: tuple[Case, ...] = CASES) -> DataFrame:
    """A row per check: case, check, passed and total; windows have at most ``limit`` rows, which come to the driver."""
    rows = []
    for case in cases:
        window = navigate.navigate(net, case.query).orderBy("pos").collect()
        rows += [(case.name, name, sum(bool(f(r)) for r in window), len(window)) for name, f in case.each.items()]
        rows += [(case.name, name, int(bool(f(window))), 1) for name, f in case.window.items()]
        if case.expect_any:
            rows.append((case.name, "expect_any", int(any(a in r["labels"] for r in window for a in case.expect_any)), 1))
    return net.models.sparkSession.createDataFrame(rows, "case string, check string, passed int, total int")


def score(checks: DataFrame) -> DataFrame:
    return checks.agg(F.sum("passed").alias("passed"), F.sum("total").alias("total"), F.round(100.0 * F.sum("passed") / F.sum("total"), 2).alias("pct"))


def difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Checks whose share of passes changed between two reports."""
    share = F.col("passed") / F.col("total")
    a, b = before.select("case", "check", share.alias("before")), after.select("case", "check", share.alias("after"))
    return a.join(b, ["case", "check"], "full").where("not before <=> after")
