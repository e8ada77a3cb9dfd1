"""Near-duplicates of the pipeline against brute force over exact 5-word Jaccard similarities."""

from __future__ import annotations

import random
from collections import Counter

import pytest

import corpus_pipeline
from asterism.llm import simhash

from test_operators import groups_of


def plain_set(text: str | None) -> frozenset[str]:
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(" ".join(w[k : k + 5]) for k in range(len(w) - 4)) or frozenset([" ".join(w)] if w else [])


def alike(a: frozenset, b: frozenset) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def fresh(r: random.Random, n: int) -> list[str]:
    return [f"w{r.randrange(100_000)}" for _ in range(n)]


def replaced(r: random.Random, words: list[str], n: int) -> list[str]:
    out = list(words)
    for k in r.sample(range(len(words)), n):
        out[k] = f"new{r.randrange(100_000)}"
    return out


@pytest.fixture(scope="module")
def near():
    """Bases with copies of similarity 0.7 to 1, a crowd around one base, texts that share half, short and empty texts."""
    r = random.Random(8)
    texts = []
    for n, changes in ((500, (10, 5, 16)), (200, (1, 3, 6)), (1000, (10, 20, 30)), (60, (1, 2)), (12, (1,))):
        for _ in range(4):
            base = fresh(r, n)
            texts += [" ".join(base), *(" ".join(replaced(r, base, c)) for c in changes)]
    base, half = fresh(r, 300), fresh(r, 100)
    texts += [" ".join(replaced(r, base, r.randint(1, 5))) for _ in range(40)]
    texts += [" ".join(half + fresh(r, r.randint(10, 60))) for _ in range(40)]
    texts += ["one two", "One  two", "one two three", "", None, " \n", texts[0], texts[3].upper()]
    order = list(range(len(texts)))
    r.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)] + [(None, texts[0]), (7, texts[order[7]])]


def wanted(rows) -> set[int]:
    sets = [plain_set(t) for _, t in rows]
    root = groups_of(sorted(set(range(len(rows)))), lambda a, b: alike(sets[a], sets[b]))
    first: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            first[root[k]] = min(i, first.get(root[k], i))
    return set(first.values())


@pytest.mark.parametrize("crowd", [2, 32])
def test_keep_first_matches_brute_force(spark, near, crowd):
    docs = spark.createDataFrame(near, "doc_id bigint, text string").repartition(3)
    got = Counter(x["doc_id"] for x in simhash.keep_first(docs, crowd=crowd).collect())
    assert got == Counter(wanted(near))


def test_pipeline_stage_links_near_copies(spark):
    r = random.Random(3)
    base = fresh(r, 500)
    rows = [(1, " ".join(base)), (2, " ".join(replaced(r, base, 10))), (3, " ".join(fresh(r, 500)))]
    assert alike(plain_set(rows[0][1]), plain_set(rows[1][1]))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == {1, 3}
