"""Queries over all documents against plain versions."""

from __future__ import annotations

import re

import pytest

from asterism.functions import text
from asterism.plans import registry

TEXTS = [(1, "en", "The robust model"), (2, "fr", "Le mod\u00e8le x est tiny, FAST and state-of-the-art"), (3, None, "long-context long context"), (4, "de", None), (5, "en", ""), (6, "es", "the and with"), (7, "en", "huge massive large. slow-ish slow")]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rows = [(i, t, lang, "hub/tiny-model" if i % 2 else None) for i, lang, t in TEXTS]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return path


def test_token_counts_of_all_languages(spark, folder):
    want = {i: None if t is None else sum(len(w) > 1 and w not in text.STOP_WORDS for w in re.findall("[a-z0-9_.-]+", t.lower())) for i, _, t in TEXTS}
    assert {r["doc_id"]: r["tokens"] for r in registry.queries()["token_counts"](spark, folder).collect()} == want


def test_epa_lexicon(spark, folder):
    got = {r["doc_id"]: (r["e"], r["p"], r["a"]) for r in registry.queries()["epa_scores"](spark, folder).collect()}
    none = (None, None, None)
    assert got == {1: (0.5, 0.3, 0.0), 2: (0.9, -0.4, 0.6), 3: (0.3, 0.5, 0.0), 4: none, 5: none, 6: none, 7: (-0.2, 1.0, -0.6)}


def test_best_paragraphs_keep_every_document(spark, tmp_path):
    long, fair, good = "x" * 9000, "plain words " * 10, "the benchmark accuracy of the tiny thing is excellent"
    texts = [long, f"{fair}\n\n{good}\n\nshort", f"{long}\n\n{fair}", "y" * 3000, None, f"{good}\n\n" + "z" * 7990 + f"\n\n{fair}"]
    spark.createDataFrame([(i, t, "hub/tiny-model") for i, t in enumerate(texts)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["paragraphs"], r["chars"]) for r in registry.queries()["paragraph_budget"](spark, str(tmp_path)).collect()}
    n, g = len(fair.strip()), len(good)
    assert got == {0: (0, 0), 1: (2, n + g), 2: (0, 0), 3: (1, 3000), 4: (0, 0), 5: (1, g)}


def test_card_sections(spark, tmp_path):
    texts = ["# Overview\n##usage\n## Fine-Tuning\n# results\n##  Bias\n# Citation", "A long line | with 3 signs http://x\n" * 30, "## How to use", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["quality"] for r in registry.queries()["card_quality"](spark, str(tmp_path)).collect()}
    assert got == {0: 1.0, 1: 0.0, 2: 0.17, 3: 0.0, 4: 0.0}
