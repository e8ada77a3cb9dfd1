"""Each operator against a plain version on small and odd inputs: nulls, empty and long texts, ties, repeated rows, no rows, clashing names."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import tracemalloc
import zlib
from collections import Counter
from time import process_time

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from tokenizers import Tokenizer

from asterism.llm import licenses, packing, pii, quality, sentencepieces, sharding, simhash, suffix, suffix_dedup, topk, warc
from asterism.llm.components import components

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def words(r: random.Random, n: int) -> str:
    return " ".join(r.choice(WORDS) + r.choice(["", "", "ing", "s", "é"]) for _ in range(n))


@pytest.fixture(scope="module")
def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(4)
    passage = words(r, 40)
    rows = [(k, words(r, r.randint(1, 120))) for k in range(30)]
    rows += [(k, rows[3][1]) for k in range(30, 34)] + [(k, f"{words(r, 5)} {passage}\n{words(r, 9)}") for k in range(34, 40)]
    rows += [(40, ""), (41, None), (42, " \t\n"), (43, words(r, 4000)), (44, "Released under the MIT License. MIT license! mit-license"), (45, "x\n\nx\nx y\nx y\n" * 30), (46, "漢字" * 40 + "é"), (47, "aaaa" * 60)]
    return rows + [(None, passage), (5, rows[5][1]), (5, rows[5][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "s1" if k % 3 else None, -1, "x", True) for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_words int, chunk string, kept boolean").repartition(3).cache()


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.where("false")


def plain_fingerprint(text: str | None) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups_of(keys: list, linked) -> dict:
    root = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a, b in itertools.combinations(keys, 2):
            if linked(a, b) and root[a] != root[b]:
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
                changed = True
    return root


@pytest.mark.parametrize("crowd", [1, 512])
def test_simhash_matches_brute_force(docs, texts, crowd):
    prints = [plain_fingerprint(t) for _, t in texts]
    root = groups_of(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 2)
    least = {}
    for (i, _), p in zip(texts, prints):
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = Counter((i, f"{p:016x}", least.get(root[p])) for (i, _), p in zip(texts, prints))
    got = Counter(tuple(r) for r in simhash.near_duplicates(docs, crowd=crowd).collect())
    assert got == want


@pytest.mark.parametrize("crowd", [2, 512])
def test_simhash_links_random_fingerprints(spark, crowd):
    r = random.Random(1)
    base = [r.getrandbits(64) for _ in range(12)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(40)}
    values |= {base[0] ^ (1 << k) for k in range(64)}
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    found = simhash.links(spark.createDataFrame([(s,) for s in signed.values()], "fp bigint"), crowd).collect()
    want = {tuple(sorted((signed[a], signed[b]))) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 2}
    assert {tuple(sorted(x)) for x in found} == want


def test_simhash_on_nothing(nothing):
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.keep_first(nothing).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(chain, "src bigint, dst bigint")).collect()}
    assert got == {k: 0 for k in range(61)} | {k: 100 for k in range(100, 140)}
    assert components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def plain_licenses(text: str | None) -> tuple:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    places = [(k, label) for p, label in licenses.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(docs, texts, nothing, spark):
    got = Counter((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan(docs).collect())
    assert got == Counter((i, *plain_licenses(t)) for i, t in texts)
    assert licenses.scan(nothing).count() == 0
    notice = licenses.NOTICES["gpl-3.0"][1]
    broken = notice.replace("published", "ever published").replace("terms of", "terms and conditions of")
    odd = [(1, f"x y {broken} z"), (2, "GNU General Public Library License"), (3, "KİT mİt license MİT License"), (4, "This is licensed under CC BY-NC 4.0."), (5, "Released under the MIT License (MIT License)"), (6, f"{licenses.NOTICES['mit-notice'][1]} {licenses.NOTICES['zlib'][0]}")]
    rows = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(odd, "doc_id bigint, text string")).collect()}
    assert rows[1]["labels"].split(",") == ["gpl", "gpl-3.0"] and rows[1]["score"] == 1.0
    assert rows[2]["labels"] == "" and rows[3]["n_base"] == 0
    assert rows[4]["labels"] == "cc-by-nc" and rows[4]["base_labels"] == ""
    assert rows[5]["labels"] == "mit,mit-notice" and rows[5]["n_base"] == 2 and rows[6]["labels"] == "mit-notice,zlib"


def plain_repeats(rows: list[tuple[int | None, str | None]]) -> Counter:
    raw = [(i, (t or "").encode()) for i, t in rows]
    least: dict[bytes, int] = {}
    for i, b in raw:
        if i is not None:
            for k in range(len(b) - 49):
                least[b[k : k + 50]] = min(i, least.get(b[k : k + 50], i))
    out: Counter = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for k in range(len(b) - 49):
            if i is not None and least[b[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(bytes(c for c, x in zip(b, gone) if not x)).hexdigest()] += 1
    return out


@pytest.mark.parametrize("crowd", [1, 4096])
def test_repeats_match_brute_force(docs, texts, nothing, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    got = Counter(tuple(r) for r in suffix_dedup.remove_repeats(docs, crowd=crowd).collect())
    assert got == plain_repeats(texts)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_repeats_return_text_and_columns(docs):
    out = suffix_dedup.remove_repeats(docs, keep=docs.columns, with_text=True)
    assert set(docs.columns) <= set(out.columns)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert rows[31]["text"] == "" and rows[3]["text"] and rows[41]["text"] is None and rows[3]["chunk"] == "x"


@pytest.mark.parametrize("bucketwise", [1, 1024])
def test_suffix_arrays(bucketwise, monkeypatch):
    monkeypatch.setattr(suffix, "BUCKETWISE", bucketwise)
    r = random.Random(5)
    for _ in range(300):
        size = r.choice([2, 3, 200])
        text = np.array([r.randint(1, size) for _ in range(r.randint(0, 70))] + [0], dtype=np.uint16)
        order, n = suffix.suffix_array(text, size + 1), len(text)
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:].tolist())
        prefix = suffix.permuted_common_prefixes(text, order)
        for a, b in zip(order[1:], order[:-1]):
            shared = next(k for k in range(n) if text[a + k] != text[b + k])
            assert prefix[a] == shared


def test_suffix_arrays_recurse_on_names(monkeypatch):
    """A shard of three megabytes: reduced strings of many names are sorted by recursion, down to unique names."""
    r = random.Random(6)
    known = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 9))) for _ in range(5000)]
    text = np.frombuffer(" ".join(r.choice(known) for _ in range(600_000)).encode()[: 3 << 20] + b"\0", dtype=np.uint8).astype(np.uint16)
    calls, plain = [], suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda t, a: (calls.append((len(t), a)), plain(t, a))[1])
    order = suffix.suffix_array(text, 256)
    assert len(calls) >= 3 and calls[1][1] > 1024 and calls[1][0] > 400_000
    assert np.array_equal(np.sort(order), np.arange(len(text)))
    raw = text.astype(np.uint8).tobytes()
    for k in r.sample(range(len(text) - 1), 3000):
        assert raw[order[k] :][:4000] < raw[order[k + 1] :][:4000]


def test_packing(spark, docs, texts, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    odd = spark.createDataFrame([(90, "a<|endoftext|>b"), (91, " \n x  y\x1c z 　w")], "doc_id bigint, text string")
    given = docs.select("doc_id", "text").union(odd)
    rows = packing.pack(given, path, keep_ids=True).collect()
    exact = Tokenizer.from_file(path)
    want = Counter((i, tuple(exact.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in [*texts, (90, "a<|endoftext|>b"), (91, " \n x  y\x1c z 　w")])
    assert Counter((r["doc_id"], r["start"], r["length"]) for r in rows) == Counter((i, k, min(1024, len(ids) - k)) for i, ids in want.elements() for k in range(0, len(ids), 1024))
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) and len(r["ids"]) == r["length"]
        assert any(i == r["doc_id"] and list(ids[r["start"] : r["start"] + r["length"]]) == r["ids"] and len(ids) == r["doc_tokens"] for i, ids in want)
    for _, of in itertools.groupby(sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in of:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert {r["sequence_id"] for r in rows} == set(range(len({r["sequence_id"] for r in rows})))
    assert packing.pack(nothing, path).count() == 0


def test_shortest_pack_first_places_everything():
    r = random.Random(2)
    for _ in range(50):
        histogram = {r.randint(1, 64): r.randint(1, 500) for _ in range(r.randint(1, 40))}
        patterns = packing.shortest_pack_first(histogram, 64)
        assert all(sum(p.lengths) <= 64 and p.count > 0 for p in patterns)
        placed: Counter = Counter()
        for p in patterns:
            for length in p.lengths:
                placed[length] += p.count
        assert placed == Counter(histogram)


@pytest.mark.parametrize("block", [3, 8192])
def test_top_k_matches_brute_force(spark, block, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    r = random.Random(3)
    rows = [(k, [r.choice([-1.0, 0.0, 0.5, r.uniform(-1, 1)]) for _ in range(5)]) for k in range(70)]
    rows += [(k, rows[20][1]) for k in range(70, 80)] + [(20, rows[20][1]), (81, None), (82, [1.0, None]), (83, [float("nan")]), (84, [float("inf")]), (85, []), (None, [1.0]), (100, [0.25])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    good = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want: Counter = Counter()
    for at, (q, v) in enumerate(good):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for k, (i, w) in enumerate(good) if k != at)[:20]
            want += Counter((q, n + 1, i, -s) for n, (s, i) in enumerate(scored))
    monkeypatch.setattr(topk, "SAMPLE", 25)
    found = topk.top_k(df, pivots=7)
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in found.collect()) == want
    assert topk.top_k(df.where("false")).count() == 0


def test_pivots_eliminate_candidates():
    r = np.random.default_rng(1)
    centres = r.integers(-300, 300, (20, 8))
    vectors = (centres[r.integers(0, 20, 3000)] + r.integers(-3, 4, (3000, 8))).astype(float)
    ids = np.arange(3000)
    radius2 = float((vectors**2).sum(axis=1).max())
    pivots = vectors[topk.far_apart(vectors[:500], 32)]
    floors = topk.thresholds(vectors[:500], ids[:500], ids[:10], vectors[:10], 20)
    seen = [done for *_, done in topk.search(ids, ids, vectors, topk.pivot_table(vectors, pivots, radius2), ids[:10], vectors[:10], pivots, radius2, floors)]
    assert sum(seen) < 0.4 * 10 * 3000


@pytest.mark.parametrize(("high", "kind"), [(9, np.float32), (1 << 20, np.float64), (1 << 30, np.int64)])
def test_search_takes_queries_together(high, kind):
    """Slices of queries meet tiles of candidates, in a type that is exact; block after block the floors rise, and the best of all are found."""
    r = np.random.default_rng(4)
    vectors = r.integers(-high, high + 1, (2500, 4))
    vectors[::7] = vectors[3]  # ties
    radius2 = float((vectors.astype(float) ** 2).sum(axis=1).max())
    assert topk.kind_of(radius2) is kind
    ids, rows, asked = np.arange(2500) // 2, np.arange(2500), np.arange(0, 2500, 2)
    pivots = vectors[topk.far_apart(vectors[:300].astype(float), 16)].astype(float)
    table, own = topk.pivot_table(vectors.astype(float), pivots, radius2), vectors.astype(kind)
    floors, seen, got = np.full(len(asked), -np.inf), 0, [[] for _ in asked]
    for at in (slice(0, 1100), slice(1100, 1103), slice(1103, 2500)):
        slices = list(topk.search(ids[at], rows[at], own[at], table[at], asked, own[asked], pivots, radius2, floors, 5))
        assert len(slices) == -(-len(asked) // topk.SLICE)  # not one for each query
        for places, found, scores, _, done in slices:
            seen += done
            for p, x, s in zip(places.tolist(), found.tolist(), scores.tolist()):
                got[p].append((-s, ids[at][x], rows[at][x]))
    for p, q in enumerate(asked):
        scores = vectors @ vectors[q]
        want = sorted((-int(s), i, x) for x, (s, i) in enumerate(zip(scores, ids)) if x != q)[:5]
        assert sorted(got[p])[:5] == want and floors[p] <= float(-want[-1][0])
    assert seen <= len(asked) * 2500


def test_top_k_cost_follows_the_matrix_product():
    """Where pivots eliminate nothing, the search costs a few plain matrix products, not a hundred (which made it grow with the square of check_l)."""
    r = np.random.default_rng(5)
    vectors = np.floor(8 * r.normal(size=(4096, 64)))
    ids, own, radius2 = np.arange(4096), vectors.astype(np.float32), float((vectors**2).sum(axis=1).max())
    pivots = vectors[topk.far_apart(vectors[:500], 48)]
    table, floors = topk.pivot_table(vectors, pivots, radius2), topk.thresholds(own[:2048], ids[:2048], ids[:1024], own[:1024], 20)
    start = process_time()
    for at in range(0, 1024, 512):
        np.partition(vectors[at : at + 512] @ vectors.T, -20, axis=1)
    plain, start = process_time() - start, process_time()
    list(topk.search(ids, ids, own, table, ids[:1024], own[:1024], pivots, radius2, floors))
    assert process_time() - start < 10 * plain


def test_top_k_of_large_components(spark):
    """Products beyond 2**53 are exact; those that a long can't hold are refused."""
    r = random.Random(2)
    rows = [(k, [float(r.randint(-(1 << 24), 1 << 24)) for _ in range(4)]) for k in range(50)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    want = {(q, n + 1, i, -s) for q, v in rows if q % 20 == 0 for n, (s, i) in enumerate(sorted((-sum(int(64 * a) * int(64 * b) for a, b in zip(v, w)), i) for i, w in rows if i != q)[:20])}
    assert {(x["query_id"], x["rank"], x["vec_id"], x["score"]) for x in topk.top_k(df).collect()} == want
    with pytest.raises(ValueError):
        topk.top_k(spark.createDataFrame([(20, [1e9])], "vec_id bigint, embedding array<double>"))


def test_sharding(docs, texts, nothing):
    rows = sharding.shard_documents(docs).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts)
    slots: dict[int, list[int]] = {}
    for r in rows:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, sharding.shard_documents(docs.repartition(7)).collect()), key=repr)
    assert sharding.shard_documents(nothing).count() == 0


def test_feistel_is_a_bijection():
    for n in (1, 2, 3, 5, 100, 4097):
        out = sharding.permute(np.arange(n), n, 7)
        assert sorted(out) == list(range(n))
        assert all(sharding.position_to_row(int(p), n, 7) == k for k, p in list(enumerate(out))[:50])


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 200
    rows = [(1, "http://a/%0A\n", big), (7, "http://b", big), (3, None, big), (7, "http://b", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (8, "u", ""), (None, "u", big), (9, "u", "x" * 3_000_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, digest int")
    got = warc.round_trip(pages, f"file://{tmp_path}/warc").collect()
    want = Counter()
    for i, url, html in rows:
        raw = (html or "").encode()
        refers = 7 if html == big and i in (1, 3) else None
        want[i, url, len(raw), hashlib.sha1(raw).hexdigest(), "response" if refers is None else "revisit", refers, None if refers else raw] += 1
    assert Counter((r["page_id"], r["url"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], None if r["payload"] is None else bytes(r["payload"])) for r in got) == want
    assert warc.round_trip(pages.where("false")).count() == 0
    data = next(iter((tmp_path / "warc").glob("*.warc.zst"))).read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18"


def plain_quality(text: str | None) -> tuple:
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often = {g for g, c in Counter(grams).items() if c > 1}
    covered = {k for i, g in enumerate(grams) if g in often for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


def test_quality_counts(docs, texts, nothing):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judge(docs, keep=["doc_id"]).collect())
    assert got == Counter((i, *plain_quality(t)) for i, t in texts)
    assert quality.judge(nothing).count() == 0 and quality.keep_good(nothing).count() == 0
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r["n_words"] for r in kept.collect()} == {-1}


def test_hosts_of_mostly_bad_documents_go(spark):
    r = random.Random(8)
    good = [(k, words(r, 60), f"h{k % 5}") for k in range(200)]
    bad = [(1000 + k, "one two" if k % 10 else words(r, 60), "bad") for k in range(60)]
    df = spark.createDataFrame(good + bad + [(5000, words(r, 60), None)], "doc_id bigint, text string, source string")
    rows = {r["doc_id"]: r["kept"] for r in quality.judge(df).collect()}
    assert all(rows[k] for k in range(200)) and not any(rows[1000 + k] for k in range(60)) and rows[5000]


def plain_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


def test_pii_base_spans():
    r = random.Random(3)
    parts = ["a", "b.", "@", "@x", ".com", ".", "1", "12", "255", "256", "0001", "4111111111111111", " ", "-", "+", "+1", "(", ")", "%", "é", "1.2.3.4", "x@y.z", "5500 0000 0000 0004", "+49 (30) 123-456", "\n"]
    for _ in range(20000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert pii.base_spans(text) == plain_spans(text)


def test_pii_model(docs, nothing, spark):
    from asterism.llm import pii_train

    precision, recall = pii_train.measure(pii.model().weights, sentences=150, seed=12345)
    assert precision > 0.95 and recall > 0.93
    text = 'Mail jo.doe (at) mail.example.com, token = "04dbebab91ab85687d33eeaaf9ac699e1188f962", order 7536784127813051 on 12.3.2021, x@y.org'
    base, spans = pii.find(text)
    assert [text[a:b] for _, a, b in base] == ["x@y.org"]
    assert {k for k, _, _ in spans} == {"email", "secret"} and set(base) <= set(spans)
    assert pii.mask("a x@y.org b", pii.find("a x@y.org b")[1]) == "a <EMAIL> b"
    rows = pii.scan(docs).collect()
    assert len(rows) == docs.count() and pii.scan(nothing).count() == 0
    masked = pii.mask_documents(spark.createDataFrame([(1, "call +1 (243) 555-5526 now"), (2, None)], "n int, text string")).collect()
    assert [r["text"] for r in sorted(masked)] == ["call <PHONE> now", None]


def plain_decode(text: str) -> list[tuple[str, int, int]]:
    """The best segmentation over the whole text, segment by segment."""
    crf = pii.model()
    tokens, seeds = pii.tokenize(text)
    best, back = [0.0] + [-np.inf] * len(tokens), [("", 0)] * (len(tokens) + 1)
    candidates = crf.segments(text, tokens, seeds)
    for j in range(1, len(tokens) + 1):
        best[j], back[j] = best[j - 1], ("", j - 1)
        for i, features in candidates[j]:
            for kind in pii.TYPES:
                if (s := best[i] + crf.score(kind, features)) > best[j]:
                    best[j], back[j] = s, (kind, i)
    out, j = [], len(tokens)
    while j:
        kind, i = back[j]
        out += [(kind, tokens[i][0], tokens[j - 1][1])] if kind else []
        j = i
    return out[::-1]


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_pii_decoder_matches_the_plain_one(block, monkeypatch):
    from asterism.llm import pii_train

    monkeypatch.setattr(pii, "_BLOCK", block)
    r = random.Random(77)
    parts = ["a", "b.", "@", "@x", ".com", ".", "1", "12", "256", "0001", "4111111111111111", " ", "-", "+1", "(", ")", "%", "1.2.3.4", "x@y.z", "5500 0000 0000 0004", "+49 (30) 123-456", "\n", "[at]", " (at) ", "(\tat)", "_", "²", "٣", "deadbeef01234567", "  ", "\t", " lorem ipsum "]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 50))) for _ in range(250)]
    texts += [" ".join(pii_train.sentence(r)[0] + " lorem ipsum " * r.randint(0, 20) for _ in range(4)) for _ in range(30)]
    decoder = pii.Decoder(pii.model())
    for number, text in enumerate(texts):
        for a, b in pii.windows(text):
            decoder.feed(number, text, a, b)
    decoder.flush(last=True)
    want = [(number, *s) for number, text in enumerate(texts) for s in plain_decode(text)]
    assert decoder.found == want and len(want) > 300


def test_pii_in_very_long_texts():
    r = random.Random(9)
    number = lambda: str(r.randint(0, 10 ** r.randint(1, 12)))
    texts = {"hex": "".join(r.choice("0123456789abcdef") for _ in range(1_000_000)), "one token": "a1" * 500_000, "digits": "1 2" * 333_000, "numbers": " ".join(number() for _ in range(140_000)), "at signs": "a@" * 300_000, "plus signs": "+1(" * 300_000}
    for text in texts.values():
        took = process_time()
        tracemalloc.start()
        _, spans = pii.find(text[: len(text) // 10] + " mail jo.doe@example.com ")
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert ("email", len(text) // 10 + 6, len(text) // 10 + 24) in spans and peak < 60 << 20
        pii.find(text)
        assert process_time() - took < 120


def test_sentencepieces(spark, docs, texts, nothing):
    path = public_tokenizers.path("piece_bpe_32k.model")
    exact = sentencepiece.SentencePieceProcessor(model_file=path)
    with open(path, "rb") as f:
        codec = sentencepieces.Codec(sentencepieces.tables(f.read()))
    r = random.Random(1)
    parts = ["a", "the", "tion", " ", "  ", "▁", "\n", "é", "漢", "𠀀", "<s>", "</s>", "<unk>", "<0x41>", "\t", "\x00", "ﬁ", "23", "...", "aaaa", "                  "]
    for text in [*("".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(4000)), "a" * 5000, "ab " * 3000 + " " * 500]:
        ids = codec.encode(text)
        assert ids == exact.encode(text, add_eos=True) and codec.decode(ids) == exact.decode(ids)
    for _ in range(1000):
        ids = [r.randrange(32000) if r.random() < 0.5 else r.randrange(300) for _ in range(r.randint(0, 9))]
        assert codec.decode(ids) == exact.decode(ids)
    got = Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in sentencepieces.encode_documents(docs, path, with_ids=True).collect())
    assert got == Counter((i, tuple(exact.encode(t or "", add_eos=True)), exact.decode(exact.encode(t or "", add_eos=True))) for i, t in texts)
    assert sentencepieces.encode_documents(nothing, path).count() == 0
