"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import base64
import hashlib
import zlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from tessel.llm import bpe, embdedup, fingerprint, packing, quality, sharding, simhash, toxicity, urlfilter, warc

LONG = "word and Ünïcode, 12 " * 9000
ROWS = [(5, "one two three four.\nfive six", "a"), (1, None, None), (9, "", "b"), (3, LONG, "c"), (4, "one two three four.\nfive six", "a"), (None, "lost  \n x", "d"), (4, "one two three four.\nfive six", "a"), (7, "\x00  tab\t\U0001f600'll", None)]
SHAPE = "doc_id long, text string, lang string"
CLASH = ["ids", "bits", "key", "g", "shard", "size", "rank", "block", "length", "score", "predicted", "at", "part", "label", "__score"]


@pytest.fixture(scope="module")
def docs(spark):
    out = spark.createDataFrame(ROWS, SHAPE)
    return out.withColumns({c: F.lit(1) for c in CLASH})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SHAPE)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1, 1), (1, 0, 0), (9, None, 0), (None, 1, 1), (4, 0, 1), (4, 0, 1)], "doc_id long, quality int, toxic int")


def test_bpe_round_trip_is_tiktoken(docs, none):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    known = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t, _ in ROWS:
        ids = known.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(docs).collect()), key=str) == sorted(want, key=str)
    assert bpe.round_trip(none).collect() == []
    back = bpe.decode(bpe.encode(docs))
    assert sorted(bytes(r["bytes"]) for r in back.collect()) == sorted((t or "").encode() for _, t, _ in ROWS)


def test_simhash_groups(docs, none):
    found = {(r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert {(5, 4), (4, 4), (1, 1), (9, 1)} <= found
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None).count(4) == 1
    assert simhash.near_duplicates(none).collect() == [] and simhash.deduplicate(none).collect() == []


def test_covering_masks_meet_every_pair():
    masks = simhash.covering_masks(2)
    for i in range(64):
        for j in range(64):
            assert any(not (1 << i | 1 << j) & m for m in masks)


def test_simhash_chain_of_two_bit_steps(spark):
    values = [0, 3, 15, 63, 1 << 40, (1 << 40) | 7 << 50, -1, -1 ^ 5]
    met = simhash.collisions(spark.createDataFrame([(v,) for v in values], "bits long"), [(m,) for m in simhash.covering_masks(2)], 2)
    links = met.toDF("src", "dst")
    from tessel.operators.components import star_components

    found = {r["id"]: r["component"] for r in star_components(links).collect()}
    assert found[63] == found[15] == found[3] == found[0] == 0
    assert 1 << 40 in found and found[1 << 40] == 0  # one bit from 0
    assert (1 << 40 | 7 << 50) not in found
    assert found[-1] == found[-1 ^ 5]


def test_shards(docs, none):
    rows = sharding.shard(docs, shards=3).collect()
    assert len(rows) == len(ROWS)
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in ROWS if i is not None)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == want
    for s in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert sharding.shard(none).collect() == []


def test_shards_split_a_hot_text(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(F.concat(F.lit("text "), F.repeat(F.col("id").cast("string"), 5))).alias("text"))
    sizes = sharding.shard(rows).groupBy("shard").agg(F.sum("size").alias("s"), F.max("slot").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    total = [r["s"] for r in sizes]
    assert len(sizes) == 8 and max(total) < 1.1 * min(total) and all(r["m"] + 1 == r["n"] for r in sizes)


def test_edit_likeness(docs, none):
    rows = fingerprint.edit_likeness(docs).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t, _ in order]
    want = sorted((i, hashlib.sha256(fingerprint.edited(t, texts[(k + 1) % len(texts)]).encode()).hexdigest()) for k, ((i, *_), t) in enumerate(zip(order, texts, strict=True)) if i is not None)
    assert sorted((r["doc_id"], r["edited_sha256"]) for r in rows if r["doc_id"] is not None) == want
    same = {r["fingerprint"] for r in rows if r["doc_id"] in (4, 5)}
    assert len(same) == 1 and all(0 <= r["near_edited"] <= 1 for r in rows)
    assert fingerprint.edit_likeness(none).collect() == []


def test_multiset_hash_inserts_and_deletes():
    a = fingerprint.MultisetHash.of(["x", "y", "y"])
    assert a == fingerprint.MultisetHash.of(["y", "x", "y"]) and a != fingerprint.MultisetHash.of(["x", "y"])
    assert a.delete("y").insert("z") == fingerprint.MultisetHash.of(["x", "y", "z"])
    assert a.likeness(a) == 1 and fingerprint.MultisetHash().likeness(fingerprint.MultisetHash()) == 1


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = packing.pack(docs, capacity=100).collect()
    lengths = sorted((i, len(tok.encode(t or "", add_special_tokens=False).ids) + 1) for i, t, _ in ROWS if i is not None)
    total = {}
    for r in rows:
        total.setdefault((r["doc_id"], r["ids_crc32"], r["start"], r["sequence_id"], r["offset"]), r["length"])
    assert sum(r["length"] for r in rows if r["doc_id"] is not None) == sum(n for _, n in lengths)
    bins = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert bins.get(r["sequence_id"], 0) == r["offset"]
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 100
    assert packing.pack(none).collect() == []


@pytest.mark.parametrize(("module", "label", "keep"), [(quality, "quality", "keep_good"), (toxicity, "toxic", "drop_toxic")])
def test_classifiers_score_everything(docs, none, labels, module, label, keep):
    model = module.fit(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert getattr(module, keep)(docs, model).columns == docs.columns
    assert module.score(none, module.fit(none, labels)).collect() == []
    unlabelled = module.fit(docs, labels.where("false"))
    assert {r["score"] for r in module.score(docs, unlabelled).collect()} == {0.5}


def test_urls(spark):
    urls = [(1, "https://A.Example.COM/en/7?x"), (2, "http://example.com/en/8"), (3, "http://x.net/de/8#f"), (4, "http://example.net/de/8"), (5, None), (6, "no scheme"), (None, "ftp://x.org/es/?q"), (8, "http://notcom/en/"), (2, "http://example.com/en/8"), (9, "http://com?en/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumns({c: F.lit(1) for c in ("host", "tokens", "mined", "verdict")})
    rows = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    assert (rows[1]["host"], rows[1]["path"], rows[1]["rule"], rows[1]["verdict"]) == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert [rows[i]["rule"] for i in (2, 3, 4, None, 8, 9)] == ["com/en/", "net/de/", "example.net/de/8", "org/es/", None, None]
    assert rows[5]["host"] == rows[6]["host"] == rows[5]["path"] == "" and (rows[9]["host"], rows[9]["path"]) == ("com", "")
    assert urlfilter.judge(pages).count() == len(urls)
    assert urlfilter.judge(pages.where("false")).collect() == []


def test_mined_rules_match_brute_force(spark):
    rows = [(["a", "b"], "block")] * 6 + [(["a", "c"], "allow")] * 5 + [(["b", "c"], "block")] * 3 + [(["d"], "allow")]
    rules = urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.1, 0.8)
    for tokens, verdict, confidence, _ in rules:
        with_all = [v for t, v in rows if set(tokens) <= set(t)]
        assert abs(with_all.count(verdict) / len(with_all) - confidence) < 1e-9
    urls = spark.createDataFrame([("u1", ["a", "b"]), ("u2", ["z"]), ("u3", ["a", "c", "q"])], "url string, tokens array<string>")
    assert {r["url"]: r["mined"] for r in urlfilter.match(urls, rules).collect()} == {"u1": "block", "u3": "allow"}


def test_warc(spark):
    html = [(1, "http://a b", "same"), (2, "u", "same"), (3, None, None), (4, "u4", "x\r\n\r\nWARC/1.1\r\n" * 3), (5, "u5", ""), (2, "u", "same"), (None, "u", "same"), (-6, "é", LONG)]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha", "target", "refers", "content", "record")})
    rows = warc.archive(pages).collect()
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in rows), key=str)
    top = {}
    for i, _, h in html:
        top[h or ""] = max(top.get(h or "", -(1 << 63)), -(1 << 63) if i is None else i)
    want = [(i, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None) if i is None or i == top[h or ""] else ("revisit", top[h or ""]))) for i, _, h in html]
    assert got == sorted(want, key=str)
    assert warc.archive(pages.where("false")).collect() == []


def test_arc_versions():
    for version in (1, 2):
        content = warc.write_arc([(1, "http://x y", b"one"), (None, None, b"")], version, "n")
        records = list(warc.parse_arc(content))
        assert [warc.http_parts(b)[2] for _, b in records] == [b"one", b""] and records[0][0]["URL"] == "http://x%20y"
    with pytest.raises(ValueError, match="ends within"):
        list(warc.parse_arc(content[:-3]))
    for n in (None, 0, 7, -5, (1 << 63) - 1, -(1 << 63)):
        assert warc.page_id_of(warc.record_id(n)) == n


def test_embeddings(spark):
    unit = [1.0, 0.0, 0.0, 0.0]
    rows = [(1, unit, 0), (2, [0.99, 0.05, 0.0, 0.0], 0), (3, [2.0, 0.0, 0.0, 0.0], 0), (4, unit, 1), (5, unit, None), (6, None, 0), (7, [0.0] * 4, 0), (8, [float("nan"), 1.0, 0.0, 0.0], 0), (9, [None, 1.0, 0.0, 0.0], 0), (10, [0.0, 1.0, 0.0, 0.0], 0), (11, [1.0], 0), (1, unit, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({c: F.lit(1) for c in ("id", "vector", "good", "keys", "t")})
    found = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embdedup.near_duplicates(frame).collect())
    assert found[:4] == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (3, 3, 1, False)]
    assert all((n, c == v, k) == (0, True, True) for v, n, c, k in found[4:])
    assert embdedup.near_duplicates(frame.where("false")).collect() == []


def test_embeddings_in_many_blocks_match_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(12, 16))
    x = (base[rng.integers(0, 12, 400)] + 0.08 * rng.normal(size=(400, 16))).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist(), i % 2) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: r["n_links"] for r in embdedup.near_duplicates(frame, block=16).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = (u @ u.T >= 0.93) & (np.arange(400)[:, None] % 2 == np.arange(400)[None, :] % 2)
    np.fill_diagonal(near, False)
    want = near.sum(axis=1)
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * want.sum()


def test_pipeline_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    for table in (docs, none):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            before, rows = rows, stage(spark, rows, str(tmp_path))
            if name != "packing":
                assert rows.columns == before.columns
        rows.collect()
