"""Enrichment around language-model and web steps: what is sent, how answers are checked, and what is kept of pages.

The steps that call out are pluggable: ``answer`` runs any callable over Arrow batches, by default a deterministic stub.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..network import Network

#: Words of the header of a table of benchmarks, as a pattern. Fixed value.
BENCHMARK_WORDS = "benchmark|eval|score|accuracy|perplexity|mmlu|hellaswag|winogrande|arc|gsm8k|truthfulqa|humaneval"
#: Scores from which a benchmark earns a label. Fixed values.
BENCHMARK_LABELS = {"mmlu": (70.0, "high-mmlu"), "humaneval": (40.0, "strong-humaneval"), "gsm8k": (60.0, "strong-gsm8k")}

#: Words of evaluation that are counted in paragraphs, as they are spelt there ("SOTA" never occurs in lower case). Fixed values.
EVALUATIVE = ("excellent", "outstanding", "poor", "mediocre", "benchmark", "compared to", "better than", "worse than", "outperforms", "evaluation", "results", "score", "accuracy", "performance", "beats",
              "state-of-the-art", "SOTA", "leaderboard", "fine-tuned", "trained on", "capabilities", "limitations", "mmlu", "humaneval", "gsm8k", "hellaswag", "arc")


def clean_card(card: Column, limit: int = 2000) -> Column:
    """Prose of a description: front matter, code, images, links, tags and table rules go, blanks collapse."""
    out = F.regexp_replace(card, r"(?s)^---\n.*?\n---\n", "")
    out = F.regexp_replace(out, r"(?s)```.*?```", " ")
    out = F.regexp_replace(out, r"!\[[^\]]*\]\([^)]*\)", " ")
    out = F.regexp_replace(out, r"\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    out = F.regexp_replace(out, r"\|[-: |]*\|", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, limit)


def paragraph_scores(text: Column, name: Column) -> Column:
    """Array of (i, n, points): each paragraph of 30 characters and more by its place, length and score in multiples of 1/2500.

    A paragraph scores 0.5 a part of the name in it, 0.3 a word of evaluation and up to 0.2 for 500 characters. Null texts
    have none.
    """
    parts = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(name, F.lit(""))), r"[/\s-]+"), lambda t: F.length(t) > 2))

    def scored(p: Column, i: Column) -> Column:
        low, n = F.lower(p), F.length(p)
        words = sum((low.contains(w).cast("int") for w in EVALUATIVE), F.lit(0))
        return F.struct(i.alias("i"), n.alias("n"), (1250 * F.size(F.filter(parts, lambda t: low.contains(t))) + 750 * words + F.least(n, F.lit(500))).alias("points"))

    stripped = F.transform(F.split(F.coalesce(text, F.lit("")), "\n\n"), lambda p: F.trim(p, F.lit(" \t\n\r\x0b\x0c")))
    return F.filter(F.transform(stripped, scored), lambda x: x["n"] >= 30)


def best_paragraphs(text: Column, name: Column, budget: int = 8000) -> Column:
    """(paragraphs, chars) of the best paragraphs until the first that would overflow the budget; of equal scores the earlier goes first."""
    ranked = F.array_sort(F.transform(paragraph_scores(text, name), lambda x: F.struct((-x["points"]).alias("order"), x["i"].alias("i"), x["n"].alias("n"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(True).alias("more"))

    def take(t: Column, x: Column) -> Column:
        fits = t["more"] & (t["chars"] + x["n"] <= budget)
        return F.struct((t["n"] + fits.cast("int")).alias("n"), (t["chars"] + F.when(fits, x["n"]).otherwise(0)).alias("chars"), fits.alias("more"))

    return F.aggregate(ranked, start, take, lambda t: F.struct(t["n"].cast("bigint").alias("paragraphs"), t["chars"].cast("bigint").alias("chars")))


def benchmark_rows(cards: DataFrame, key: str, text: str) -> DataFrame:
    """(key, benchmark, score) from the tables of descriptions whose header has a word of benchmarks; the last row of a name counts.

    A table is a run of rows with a header and a rule of dashes below it; the name is the first cell, with hyphens for
    blanks, and the score the first cell behind it that has a digit.
    """
    lines = cards.where(F.col(text).contains("|")).select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).where(F.col("line").rlike(r"^\s*\|.+\|\s*$"))
    runs = lines.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(key).orderBy("i")))
    of = Window.partitionBy(key, "run").orderBy("i")
    ruled = F.lead(F.col("line").rlike(r"^\s*\|[-:\s|]+\|\s*$") & F.col("line").contains("-")).over(of)
    headed = runs.withColumn("head", F.when(F.coalesce(ruled, F.lit(False)) & F.lower("line").rlike(BENCHMARK_WORDS), F.col("i")))
    body = headed.withColumn("first", F.min("head").over(Window.partitionBy(key, "run"))).where(F.col("i") >= F.col("first") + 2)
    inner = F.regexp_extract("line", r"^\s*\|(.+)\|\s*$", 1)
    cells = body.select(key, "i", F.transform(F.split(inner, r"\|"), lambda c: F.trim(c, F.lit(" \t\r"))).alias("c"))
    score = F.get(F.filter(F.slice("c", F.lit(2), F.size("c")), lambda x: x.rlike("[0-9]")), F.lit(0))
    found = cells.select(key, "i", F.replace(F.lower(F.get("c", F.lit(0))), F.lit(" "), F.lit("-")).alias("benchmark"), score.alias("score")).where("benchmark <> '' and score is not null")
    return found.groupBy(key, "benchmark").agg(F.max_by("score", "i").alias("score"))


def benchmark_labels(rows: DataFrame, key: str) -> DataFrame:
    """Labels that scores earn: the first number in a score against the benchmark's least."""
    out, value = F.lit(None).cast("string"), F.regexp_extract("score", r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    for name, (least, label) in BENCHMARK_LABELS.items():
        out = F.when((F.col("benchmark") == name) & (value >= least), label).otherwise(out)
    return rows.select(key, out.alias("label")).where("label is not null")


def prompts(net: Network, template: str = "Describe {name} of {author} in one sentence. Known: {labels}.") -> DataFrame:
    """A prompt per model, with its labels in order."""
    labels = net.model_anchors.groupBy("model_id").agg(F.array_join(F.array_sort(F.collect_set("label")), ", ").alias("labels"))
    out = F.lit(template)
    rows = net.models.join(labels, "model_id", "left")
    for name, column in (("{name}", "display_name"), ("{author}", "author"), ("{labels}", "labels")):
        out = F.replace(out, F.lit(name), F.coalesce(column, F.lit("")))
    return rows.select("model_id", out.alias("prompt"))


def answer(asked: DataFrame, model: Callable[[list[str]], list[str]] | None = None) -> DataFrame:
    """(model_id, response) of a callable over batches of prompts; the default repeats the prompt's end."""
    call = model or (lambda texts: [t[-80:] for t in texts])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"model_id": b["model_id"], "response": call(b["prompt"].tolist())})

    return asked.select("model_id", "prompt").mapInPandas(run, "model_id string, response string")


def verdicts(responses: DataFrame, net: Network, cap: int = 5) -> DataFrame:
    """Checked answers (model_id, summary, labels, quality, status): labels of the vocabulary only, at most ``cap``; quality from three marks of 0 to 3.

    invalid: no JSON or no summary; rejected: quality under one half; else ok.
    """
    schema = "summary string, selected_anchors array<string>, specificity int, coherence int, artifacts int"
    parsed = responses.select("model_id", F.from_json("response", schema).alias("r")).select("model_id", "r.*")
    known = F.broadcast(net.anchors.select(F.lower("label").alias("low"), F.col("label")))  # the closed vocabulary
    named = parsed.select("model_id", F.posexplode("selected_anchors").alias("pos", "a")).join(known, F.lower("a") == F.col("low"))
    first = named.groupBy("model_id", "label").agg(F.min("pos").alias("pos"))
    kept = first.withColumn("k", F.row_number().over(Window.partitionBy("model_id").orderBy("pos"))).where(F.col("k") <= cap).groupBy("model_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]), ",").alias("labels"))
    marks = [F.when(F.col(c).between(0, 3), F.col(c)) for c in ("specificity", "coherence", "artifacts")]
    quality = F.round((marks[0] + marks[1] + marks[2]) / 9.0, 6)
    status = F.when(F.col("summary").isNull() | (F.trim("summary") == ""), "invalid").when(F.coalesce("quality", F.lit(1.0)) < 0.5, "rejected").otherwise("ok")
    return parsed.withColumn("quality", quality).join(kept, "model_id", "left").select("model_id", "summary", F.coalesce("labels", F.lit("")).alias("labels"), "quality", status.alias("status"))


def mismatches(a: DataFrame, b: DataFrame, key: str, column: str, tolerance: float = 0.5) -> DataFrame:
    """Rows whose two values differ by more than a share of the larger; values over a million count in billions."""
    plain = lambda c: F.when(c > 1e6, c / 1e9).otherwise(c)
    both = a.select(key, plain(F.col(column)).alias("x")).join(b.select(key, plain(F.col(column)).alias("y")), key)
    gap = F.abs(F.col("x") - F.col("y")) / F.greatest(F.abs("x"), F.abs("y"))
    return both.where((F.greatest(F.abs("x"), F.abs("y")) > 0) & (gap > tolerance)).select(key, "x", "y", F.round(gap, 6).alias("gap"))


def drift(known: DataFrame, now: DataFrame, key: str, text: str) -> DataFrame:
    """Per key ok, stale (its text's hash changed), new or orphaned, between a manifest (key, hash) and current texts."""
    current = now.select(key, F.sha2(text, 256).alias("now"))
    both = known.select(key, F.col("hash").alias("old")).join(current, key, "full")
    status = F.when(F.col("old").isNull(), "new").when(F.col("now").isNull(), "orphaned").when(F.col("old") == F.col("now"), "ok").otherwise("stale")
    return both.select(key, status.alias("status"))


def thin_reasons(audit: DataFrame, reason: str = "reason") -> DataFrame:
    """Audit rows with an empty or a thin reason: a filler word, or one word of under 8 letters."""
    t = F.lower(F.trim(F.coalesce(reason, F.lit(""))))
    kind = F.when(t == "", "empty").when(t.isin("fix", "update", "test", "misc", "change"), "filler").when((F.length(t) < 8) & ~t.contains(" "), "short")
    return audit.withColumn("thin", kind).where("thin is not null")


def phase_status(records: DataFrame, flags: list[str], by: str = "source") -> DataFrame:
    """Per group the number of records and of those that each phase flag holds for."""
    return records.groupBy(by).agg(F.count(F.lit(1)).alias("total"), *[F.sum(F.col(f).cast("int")).cast("bigint").alias(f) for f in flags])
