"""Quality rules at document and host level, in DataFrame functions only.

A document's counts come from array functions over its own words. A host's share of failing documents is shrunk
towards a beta prior fitted to all hosts by moments; documents of hosts whose shrunk share is over a limit are rejected
with the host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialize

WINDOW = 5
MIN_WORDS = 10
MAX_REPEATED_PCT = 20
MAX_SYMBOL_PCT = 10
MAX_DUP_LINE_PCT = 30
#: A host goes if its shrunk share of failing documents is over this.
HOST_LIMIT = 0.5
#: The prior weighs as many documents as the moments say, within these bounds.
PRIOR_WEIGHT = (1.0, 1000.0)


def _window_hash(h: Column, i: Column) -> Column:
    return F.xxhash64(h, *[F.get(F.col("__wh"), i + k) for k in range(1, WINDOW)])


def _same_neighbour(x: Column, i: Column) -> Column:
    before, after = F.get(F.col("__sorted"), i - 1), F.get(F.col("__sorted"), i + 1)
    return F.when((x["h"] == before["h"]) | (x["h"] == after["h"]), x["i"])


def with_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (long).

    A null text counts as empty; then all are 0. Windows are compared by 64-bit hashes of word hashes. Only documents in
    which a window repeats sort their windows. Input columns of these names are replaced.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
    df = df.drop(*made)
    has_word = r"[^\x20\x09-\x0D]"
    a = df.withColumn("__t", F.coalesce(F.col(text_col), F.lit(""))).withColumns({
        "__words": F.array_remove(F.split("__t", SPACE), ""),
        "__lines": F.filter(F.split("__t", "\n"), lambda x: x.rlike(has_word)),
        "n_symbols": F.regexp_count("__t", F.lit(r"[#*$%&|<>]")).cast("bigint"),
    })
    b = a.withColumns({
        "n_words": F.size("__words").cast("bigint"),
        "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
        "n_lines": F.size("__lines").cast("bigint"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
        "__wh": F.transform("__words", lambda w: F.xxhash64(w)),
    }).drop("__t", "__words", "__lines")
    c = b.withColumn("__g", F.slice(F.transform("__wh", _window_hash), F.lit(1), F.greatest(F.lit(0), F.col("n_words").cast("int") - (WINDOW - 1)))).drop("__wh")
    d = c.withColumn("__sorted", F.when(F.size(F.array_distinct("__g")) < F.size("__g"), F.sort_array(F.transform("__g", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("__g")
    e = d.withColumn("__at", F.sort_array(F.filter(F.transform("__sorted", _same_neighbour), lambda x: x.isNotNull()))).drop("__sorted")
    gain = F.transform("__at", lambda p, i: F.when(i == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), p - F.get(F.col("__at"), i - 1))))
    covered = F.aggregate(gain, F.lit(0).cast("bigint"), lambda acc, x: acc + x)
    return e.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("__at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PCT * F.col("n_words"))


def any_rule_failed() -> Column:
    """The base rules, too many symbols for the words, or too many repeated lines."""
    return base_failed() | (100 * F.col("n_symbols") > MAX_SYMBOL_PCT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINE_PCT * F.col("n_lines"))


def host_verdicts(rated: DataFrame, host_col: str, failed_col: str, limit: float = HOST_LIMIT) -> DataFrame:
    """Per non-null host: documents, failures, share, shrunk and host_kept.

    One row for each host after map-side sums. The prior's mean and variance are those of the hosts' shares; without
    spread the prior has its largest weight.
    """
    hosts = rated.where(F.col(host_col).isNotNull()).groupBy(host_col).agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col(failed_col).cast("bigint")).alias("failures"))
    hosts = hosts.withColumn("share", F.col("failures") / F.col("documents"))
    moments = hosts.agg(F.avg("share").alias("m"), F.var_pop("share").alias("v"))
    weight = F.when(F.col("v") > 0, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(PRIOR_WEIGHT[1]))
    prior = moments.select("m", F.least(F.greatest(weight, F.lit(PRIOR_WEIGHT[0])), F.lit(PRIOR_WEIGHT[1])).alias("w"))
    m, w = prior.select("m").scalar(), prior.select("w").scalar()
    return hosts.withColumn("shrunk", (F.col("failures") + m * w) / (F.col("documents") + w)).withColumn("host_kept", F.col("shrunk") <= limit)


def judge(df: DataFrame, host_col: str = "source", text_col: str = "text", keep: list[str] | None = None, limit: float = HOST_LIMIT) -> DataFrame:
    """``df``'s columns ``keep`` (all by default) with counts, base_failed, rule_failed and kept.

    A document is kept if the base rules pass and its host isn't rejected; one without a host is judged alone.
    Repeated rows count once each; an empty input gives an empty result. A null text has no words, so it fails; a very
    long one is counted whole, as arrays in its task. Kept columns with names of the result's counts are replaced. Rated rows are written to the shared folder
    once, since both the hosts' sums and the result read them. Hosts meet their documents in a join that Spark may split
    when one host is hot.
    """
    cols = df.columns if keep is None else keep
    slim = df.select(*[F.col(c) for c in dict.fromkeys([*cols, host_col, text_col])]).withColumn("__host", F.col(host_col).cast("string"))
    counted = with_counts(slim, text_col)
    drop = [c for c in dict.fromkeys([host_col, text_col]) if c not in cols]
    rated = materialize(counted.withColumn("base_failed", base_failed()).withColumn("rule_failed", any_rule_failed()).drop(*drop), "rated")
    verdicts = host_verdicts(rated, "__host", "rule_failed", limit).select("__host", F.col("host_kept").alias("__ok"))
    joined = rated.join(verdicts, "__host", "left")
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("__ok"), F.lit(True))).drop("__host", "__ok")


def keep_good(df: DataFrame, host_col: str = "source", text_col: str = "text", limit: float = HOST_LIMIT) -> DataFrame:
    """The rows of ``df`` that ``judge`` keeps, with just their own columns, whatever these are called.

    Only hosts' verdicts are written; counts are taken a second time where rows are filtered, which costs less than moving
    or storing texts.
    """
    narrow = with_counts(df.select(df[host_col].cast("string").alias("__source"), df[text_col].alias("__body")), "__body")
    rated = materialize(narrow.select("__source", any_rule_failed().alias("failed")), "rated")
    verdicts = materialize(host_verdicts(rated, "__source", "failed", limit).select("__source", "host_kept"), "hosts")
    held = df.select(F.struct(*[df[c] for c in df.columns]).alias("__row"), df[host_col].cast("string").alias("__source"), df[text_col].alias("__body"))
    # the id keeps the optimizer from moving the filter below the counts, where it would take them again for every element
    counted = with_counts(held, "__body").withColumn("__guard", F.monotonically_increasing_id())
    passed = counted.where(~base_failed() & (F.col("__guard") >= 0)).select("__row", "__source")
    return passed.join(verdicts, "__source", "left").where(F.coalesce("host_kept", F.lit(True))).select("__row.*")
