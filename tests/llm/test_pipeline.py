"""The pipeline against a plain version of its stages, on a small corpus with copies, passages, junk and personal data."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from asterism.llm import packing, pii

from test_operators import groups_of, plain_fingerprint, plain_quality, words


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(21)
    passage = words(r, 60)
    texts = [words(r, r.randint(20, 300)) for _ in range(60)]
    texts += [texts[4], texts[4], texts[9]] + [f"{words(r, 30)} {passage}\n{words(r, 30)}" for _ in range(5)] + [f"{words(r, 20)} é x.y@example.com, call +1 (243) 555-5526 {words(r, 20)}" for _ in range(4)]
    texts += ["too short", "", None, "again and again " * 40, words(r, 3000)]
    rows = [(k, t, "en", None if k == 5 else f"src{k % 4}", len(t or "")) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{path}/documents.parquet")
    return path, rows


def plain_hosts(rows) -> dict[str, bool]:
    bad, all_ = Counter(), Counter()
    for _, t, _, host, _ in rows:
        n, _, symbols, dup, _, failed = plain_quality(t)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n"))
        if host is not None:
            all_[host] += 1
            bad[host] += failed or 100 * symbols > 10 * n or 100 * dup > 30 * lines
    shares = [bad[h] / all_[h] for h in all_]
    mean, var = float(np.mean(shares)), float(np.var(shares))
    weight = min(max(mean * (1 - mean) / var - 1 if var > 0 else 1000.0, 1.0), 1000.0)
    return {h: (bad[h] + mean * weight) / (all_[h] + weight) <= 0.5 for h in all_}


def plain_pipeline(rows) -> dict[int, str]:
    """Texts by id as they reach packing."""
    hosts = plain_hosts(rows)
    kept = [(i, t) for i, t, _, h, _ in rows if not plain_quality(t)[-1] and hosts.get(h, True)]
    prints = {i: plain_fingerprint(t) for i, t in kept}
    root = groups_of(sorted(set(prints.values())), lambda a, b: (a ^ b).bit_count() <= 2)
    first: dict[int, int] = {}
    for i, p in sorted(prints.items()):
        first.setdefault(root[p], i)
    kept = [(i, t) for i, t in kept if first[root[prints[i]]] == i]
    least: dict[bytes, int] = defaultdict(lambda: 1 << 60)
    for i, t in kept:
        b = t.encode()
        for k in range(len(b) - 49):
            least[b[k : k + 50]] = min(i, least[b[k : k + 50]])
    out = {}
    for i, t in kept:
        b = t.encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        left = bytes(c for c, g in zip(b, gone) if not g).decode("utf-8", "ignore")
        out[i] = pii.mask(left, pii.find(left)[1])
    return out


def test_pipeline_matches_the_plain_version(spark, corpus):
    path, rows = corpus
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, t in plain_pipeline(rows).items():
        ids = exact.encode(t, add_special_tokens=False).ids + [0]
        at = 0
        for n in packing.piece_lengths(len(ids)):
            want[i, at, n, zlib.crc32(np.array(ids[at : at + n], dtype="<u4").tobytes()), len(ids)] += 1
            at += n
    got = corpus_pipeline.run(spark, path).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want


def test_stages_keep_the_columns_and_clean_documents(spark, corpus):
    path, _ = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.where("false"), path).count() == 0
    clean = docs.where("doc_id between 10 and 40")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert {tuple(r) for r in stage(spark, clean, path).select("doc_id", "text").collect()} == {tuple(r) for r in clean.select("doc_id", "text").collect()}


def test_stages_with_clashing_columns_and_null_ids(spark, corpus):
    path, _ = corpus
    from pyspark.sql import functions as F

    odd = spark.read.parquet(f"{path}/documents.parquet").withColumns({"kept": F.lit("k"), "n_words": F.lit(-1), "fp": F.lit(2), "chunk": F.lit("c"), "n_removed": F.lit("r"), "label": F.lit(3)}).withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, odd, path)
        assert out.columns == odd.columns, name
        assert out.select("kept", "n_words", "fp", "chunk", "n_removed", "label").distinct().collect() == [("k", -1, 2, "c", "r", 3)], name
