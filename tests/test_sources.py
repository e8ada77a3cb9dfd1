"""Sources and sinks: SQLite files, JSON lines, shards, expansion rules, federated search, extraction from records."""

from __future__ import annotations

import sqlite3

import pytest
from pyspark.sql import functions as F

from asterism.operators import extract, records, refine
from asterism.schema import Query
from asterism.sources import files, registry, sqlite

RECORDS = [
    '{"model_id": "org/Tiny-0.5B-q4_k_m", "tags": ["en", "dataset:wiki", "license:MIT"], "likes": 2000, "downloads": 5, "pipeline_tag": "text-generation", "safetensors": null, "config": "{\\"max_position_embeddings\\": 140000, \\"hidden_size\\": 8, \\"num_hidden_layers\\": 2, \\"num_attention_heads\\": 2, \\"vocab_size\\": 9}"}',
    '{"model_id": "org/big", "tags": ["70b"], "likes": 3, "downloads": 2000000, "safetensors": "{\\"parameters\\": {\\"F16\\": 60000000000, \\"I8\\": 1000000000}}", "created_at": "2024-12-31T00:00:00Z"}',
    '{"model_id": "org/unknown", "tags": []}',
    "not json",
    '{"likes": 5}',
    "",
]


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "records.json"
    path.write_text("\n".join(RECORDS))
    return str(path)


def test_lines_have_a_status(spark, dump):
    got = files.read_lines(spark, dump, files.RAW, "model_id").groupBy("status").count().collect()
    assert {r["status"]: r["count"] for r in got} == {"ok": 3, "error": 1, "skip": 1} or {r["status"]: r["count"] for r in got} == {"ok": 3, "error": 1, "skip": 1, "empty": 1}


def test_extract(spark, dump):
    got = {r["model_id"]: r for r in extract.extract(files.read_records(spark, dump), F.lit("2025-01-01").cast("date")).collect()}
    tiny, big, unknown = got["org/Tiny-0.5B-q4_k_m"], got["org/big"], got["org/unknown"]
    assert tiny["params_b"] == 0.5 and (tiny["efficiency_sign"], tiny["efficiency_depth"]) == (-1, 2) and tiny["license"] == "mit" and tiny["quant_level"] == "Q4_K_M" and len(tiny["fingerprint"]) == 16
    assert tiny["labels"].split(",") == ["1B-class", "community-favorite", "consumer-GPU-viable", "edge-deployable", "long-context-128k", "quantized"]
    assert big["params_b"] == 61.0 and big["labels"].split(",") == ["70B-class", "high-downloads"]
    assert unknown["efficiency_sign"] is None and unknown["params_b"] is None and unknown["labels"] == "" and unknown["quality_depth"] == 2


def test_number_before_b(spark):
    texts = ["7B", "model-1.5b-x", "93.b", "b", ".b", "0.05B", "9999b 13B", "a70Bc", "none"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(extract.number_before_b(F.col("t"))).collect()]
    assert got == [7.0, 1.5, 93.0, None, None, None, 13.0, 70.0, None]


def test_expansions(spark, dump):
    rules = files.expansion_rules({"expansions": [{"label": "both", "match_rules": {"operator": "AND", "conditions": [{"type": "tag_exact", "value": "EN"}, {"type": "name_regex", "value": "tiny"}]}}, {"label": "any", "match_rules": {"conditions": [{"type": "tag_regex", "value": "^[0-9]+b$"}, {"type": "pipeline_tag_in", "value": ["text-generation"]}, {"type": "bad"}]}}]})
    got = files.expand(files.read_records(spark, dump), rules).collect()
    assert {(r["model_id"], r["label"]) for r in got} == {("org/Tiny-0.5B-q4_k_m", "both"), ("org/Tiny-0.5B-q4_k_m", "any"), ("org/big", "any")}
    with pytest.raises(ValueError):
        files.expansion_rules({"expansions": [{"label": "x"}]})


def test_shards_and_resume(spark, tmp_path, dump):
    rows = files.read_records(spark, dump).select("model_id", "likes")
    files.export_shards(rows, str(tmp_path / "out"), 3, "model_id")
    again = spark.read.json(str(tmp_path / "out"))
    assert {r["model_id"] for r in again.collect()} == {r["model_id"] for r in rows.collect()}
    assert files.remaining(rows, rows.limit(1)).count() == 2
    assert [r["model_id"] for r in files.ingest(rows.where("model_id = 'org/big'"), rows.union(rows), 3).collect()] == ["org/Tiny-0.5B-q4_k_m"]


def test_federated(spark, dump):
    registry.register("dump", registry.json_dump(dump))
    registry.register("broken", registry.json_dump("/nowhere"))
    rows, errors = registry.federated(spark, ["dump", "nobody"], 1)
    assert [r["model_id"] for r in rows.collect()] == ["org/Tiny-0.5B-q4_k_m"] and errors == {"nobody": "unknown source"}
    assert "broken" in registry.federated(spark, ["broken"], 1)[1]


def test_sqlite_source(spark, tmp_path):
    path = str(tmp_path / "a.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE models (model_id TEXT, n INTEGER, w REAL)")
        db.executemany("INSERT INTO models VALUES (?, ?, ?)", [(f"m{k}", k, k / 2) for k in range(50)] + [(None, None, None)])
        db.execute("CREATE TABLE empty (a TEXT)")
    sqlite.register(spark)
    df = spark.read.format("sqlite_table").option("path", path).option("table", "models").option("parts", "4").load()
    assert df.agg(F.count(F.lit(1)), F.sum("n"), F.sum("w")).first() == (51, 1225, 612.5)
    assert spark.read.format("sqlite_table").option("path", path).option("table", "empty").load().count() == 0


def test_patches_keep_the_contract(spark):
    models = spark.createDataFrame([("a", "x"), ("b", None)], "model_id string, author string")
    same, audit = records.patch_field("models", models, {"model_id": "a"}, "author", "y", "typo")
    assert same is models and audit.first()["old_value"] == "x"
    after, _ = records.patch_field("models", models, {"model_id": "b"}, "author", "z", "known now", dry_run=False)
    assert sorted(tuple(r) for r in after.collect()) == [("a", "x"), ("b", "z")]
    for args in (("nope", {"model_id": "a"}, "author", "r"), ("models", {"id": "a"}, "author", "r"), ("models", {"model_id": "a"}, "model_id", "r"), ("models", {"model_id": "a"}, "author", " "), ("models", {"model_id": "q"}, "author", "r")):
        with pytest.raises(records.ContractError):
            records.patch_field(args[0], models, args[1], args[2], "v", args[3])
    grown, refused = records.insert_new(models, spark.createDataFrame([("a", "n"), ("c", "n"), ("c", "n"), (None, "n")], "model_id string, author string"), ["model_id"])
    assert grown.count() == 3 and sorted(r["error"] for r in refused.collect()) == ["exists", "null key"]


def test_parse_and_refine():
    q, ranges = refine.parse("small popular chat parts like org/x-1", {"chat": "chat"})
    assert q.directions == {"EFFICIENCY": -1, "QUALITY": 1} and q.prefer == ("chat",) and q.similar_to == "org/x-1" and ranges["EFFICIENCY"] == (None, -1, -1)
    more = refine.refined(q, prefer=("chat", "code"), directions={"DOMAIN": 1}, limit=5)
    assert more.prefer == ("chat", "code") and more.directions == {"EFFICIENCY": -1, "QUALITY": 1, "DOMAIN": 1} and more.limit == 5 and isinstance(more, Query)
