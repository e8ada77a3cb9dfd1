"""The tools over the derived network, the ranked answer against a plain version, and extraction by hand."""

from __future__ import annotations

import math

import pytest

from asterism.atlas import Atlas, extract
from asterism.network import from_driver
from asterism.operators import navigate, records
from asterism.plans.catalogue import FIRST
from asterism.schema import BANKS, Query


@pytest.fixture(scope="module")
def atlas(spark, sf_dir):
    return Atlas(from_driver(spark, sf_dir))


def plain_navigate(net, q: Query) -> list[tuple]:
    """The seven factors, the window, re-ranking and tie clusters over dictionaries."""
    labels, places = {}, {}
    for r in net.model_anchors.collect():
        labels.setdefault(r["model_id"], set()).add(r["label"])
    for r in net.positions.collect():
        places[r["model_id"], r["bank"]] = (r["path_sign"], r["path_depth"])
    facts = {r["model_id"]: r for r in net.facts.collect()}
    bank_of = {r["label"]: r["bank"] for r in net.anchors.collect()}
    rank = {r["model_id"]: r["pagerank"] for r in navigate.profile(net).select("model_id", "pagerank").collect()}
    n = len(facts)
    uses = {a: sum(a in held for held in labels.values()) for a in bank_of}
    idf = {a: math.log(n / max(k, 1)) for a, k in uses.items()}
    mine = lambda m: labels.get(m, set())
    chosen = [m for m in facts if set(q.require) <= mine(m) and all((p := places.get((m, b))) and p[0] == q.directions[b] and p[1] >= d for b, d in q.min_depth.items())]
    share = {a: sum(a in mine(m) for m in chosen) / len(chosen) for a in bank_of}
    pmi = {a: max(0.0, math.log(share[a] / (uses[a] / n))) if share.get(a) else 0.0 for a in q.prefer}
    standard = {a: -math.log(p) for a, p in share.items() if p > 0.4 and a not in q.require}
    values = sorted({rank[m] for m in chosen if rank[m] > 0})
    fraction = lambda m: values.index(rank[m]) / (len(values) - 1) if rank[m] > 0 and len(values) > 1 else 0.0
    mechanical = {"EFFICIENCY": 1, "COMPATIBILITY": 1, "LINEAGE": 1, "ARCHITECTURE": 0.5}
    mass = [(mechanical.get(b, 0), 1.0) for b in q.directions] + [(mechanical.get(bank_of.get(a), 0), idf.get(a, 0.0)) for a in {*q.require, *q.prefer}]
    s = 1 - sum(m * w for m, w in mass) / sum(w for _, w in mass)
    rows = []
    for m in chosen:
        score = 1.0
        for b, d in q.directions.items():
            p = places.get((m, b))
            v = None if p is None else p[0] * p[1] * d
            score *= 0.3 if v is None else 1.0 if v > 0 else 0.5 if v == 0 else 0.05
        score *= sum(idf.get(a, 0.0) for a in q.prefer if a in mine(m)) / sum(idf.get(a, 0.0) for a in q.prefer) * 0.5 ** len(set(q.avoid) & mine(m))
        score *= facts[m]["certification"] * (1 + 0.5 * sum(idf.get(a, 0.0) for a in q.context if a in mine(m)) / sum(idf.get(a, 0.0) for a in q.context))
        at = [facts[m][c] for c in ("vibe_e", "vibe_p", "vibe_a")]
        if None not in at:
            for x, t in zip(at, q.vibe):
                score *= 1 if t is None else 0.5 ** (abs(x - t) / 0.6)
        rare = sum(pmi[a] for a in q.prefer if a in mine(m)) / (sum(pmi.values()) or 1)
        absent = sum(w for a, w in standard.items() if a not in mine(m)) / (sum(standard.values()) or 1)
        signals = sorted([(0.2 + 0.2 * (1 - s)) * fraction(m), (0.2 + 0.2 * s) * rare, (0.2 + 0.3 * s) * rare, (0.15 + 0.25 * s) * absent, (0.15 + 0.15 * s) * fraction(m) * rare], reverse=True)
        rows.append((m, score * (1 + sum(x * 0.7**k for k, x in enumerate(signals)))))
    window = sorted(rows, key=lambda r: (-round(r[1], 9), r[0]))[: q.limit]
    out, pool, weight = [], list(window), 0.85 - 0.35 * s
    while pool:
        likeness = lambda r: max((len(mine(r[0]) & mine(o[0])) / len(mine(r[0]) | mine(o[0])) for o in out), default=0.0)
        best = max(pool, key=lambda r: (weight * r[1] - (1 - weight) * likeness(r) * r[1] if out else r[1], -pool.index(r)))
        pool.remove(best)
        out.append(best)
    return out


def test_navigate_matches_the_plain_version(atlas):
    got = atlas.navigate(FIRST).orderBy("pos").collect()
    want = plain_navigate(atlas.net, FIRST)
    assert [r["model_id"] for r in got] == [m for m, _ in want]
    assert [r["score"] for r in got] == pytest.approx([x for _, x in want])
    runs: dict[int, list[float]] = {}
    for r in got:
        if r["cluster"] is not None:
            runs.setdefault(r["cluster"], []).append(r["score"])
    assert all(len(v) > 1 and all(a - b < 0.05 for a, b in zip(v, v[1:])) for v in runs.values())


def test_tools(atlas, spark):
    assert atlas.detail("p7").count() == 1 and atlas.stats().count() > 4
    found = atlas.search("small red like p7").collect()
    assert len(found) == 20 and all(a["score"] >= b["score"] for a, b in zip(found, found[1:]))
    assert max(r["spread_score"] for r in found) > 0 and max(r["fuzzy_score"] for r in found) > 0 and all(0 <= r["score"] <= 1 for r in found)
    changed, answer, hints = atlas.refine(FIRST, prefer=("blue",), limit=5)
    assert changed.prefer == (*FIRST.prefer, "blue") and answer.count() <= 5 and {"axes", "labels", "question"} <= set(hints)
    both, mean = atlas.compare(("p1", "p2", "p3"))
    assert {r["kind"] for r in both.select("kind").distinct().collect()} >= {"unique", "bank"} and 0 <= mean.first()[0] <= 1
    net, unknown = atlas.annotate("p7", "calm", ("red", "no-such-label"))
    assert unknown == ["no-such-label"] and net.metadata.where("model_id = 'p7' and key = 'vibe_summary'").collect()[0]["value"] == "calm"
    assert net.model_anchors.where("model_id = 'p7' and label = 'red'").count() == 1
    with pytest.raises(records.ContractError):
        atlas.annotate("nobody", "x")
    assert 0 < atlas.enrichment_status().first()["pct"] < 100
    assert atlas.evaluate().first()["pct"] == 100.0
    assert set(atlas.audit(spark.createDataFrame([("p7", "red", 0.4)], "model_id string, label string, confidence double"))) == {"findings", "null_coverage", "correlations", "orphans", "oversaturated", "dissent"}


def test_extraction_by_hand(spark):
    schema = "model_id string, author string, pipeline_tag string, tags array<string>, library_name string, likes bigint, downloads bigint, created_at string, license string, safetensors string, config string"
    rows = [
        ("org/llama-7B-Instruct-GGUF", "org", "text-generation", ["base_model:quantized:meta/Llama-7B", "en", "conversational"], "gguf", 2000, 10, "2024-01-01", "", None, '{"model_type": "llama", "num_attention_heads": 8, "num_key_value_heads": 2}'),
        ("org/encoder-chat", None, "sentence-similarity", None, None, None, None, None, None, None, None),
        (None, "x", "x", ["x"], "x", 1, 1, None, None, None, None),
    ]
    got = extract(spark.createDataFrame(rows, schema), spark.createDataFrame([("org/encoder-chat", "| Eval | v |\n|---|---|\n| MMLU | 71 |")], "model_id string, card string"))
    verdicts = {(r["model_id"], r["label"]): r["verdict"] for r in got.verdicts.collect()}
    one, two = rows[0][0], rows[1][0]
    assert verdicts[one, "grouped-query-attention"] == "CERTIFIED" and verdicts[one, "Llama-family"] == "CERTIFIED" and verdicts[one, "llama-cpp-compatible"] == "AUTO_ADDED"
    assert verdicts[one, "decoder-only"] == "CERTIFIED" and verdicts[two, "embedding"] == "AUTO_ADDED"
    assert {(r["table"], r["key"]) for r in got.items.where("table = 'model_links'").collect()} == {("model_links", f"{one}|meta/Llama-7B|quantized_from")}
    assert {r["key"] for r in got.metadata.where(f"model_id = '{one}'").collect()} >= {"likes", "tags", "model_type", "quantization_level", "has_chat_template", "supported_languages"}
    assert [tuple(r) for r in got.benchmarks.collect()] == [(two, "mmlu", "71")]
    assert {r["model_id"]: r["hardware"] for r in got.hardware.collect()} == {one: "mid-range-GPU"}
    assert {r["key"].split("|")[1] for r in got.items.where(f"table = 'model_positions' and key like '{one}%'").collect()} == set(BANKS)
