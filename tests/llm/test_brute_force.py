"""Operators without a SQL twin against plain programs on small tables, and archives made by hand."""

import hashlib
import zlib

import numpy as np
import pytest
import xxhash

from tessel.llm import embdedup, fingerprint, quality, queries, simhash, toxicity, warc
from tessel.sources.tables import table

SF = "/root/testdata/sf0.01"


def components(ids: list, linked) -> dict:
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if linked(a, b) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    return {i: top(i) for i in ids}


def word_list(text: str) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\v\f\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def shingled(text: str, n: int) -> list[str]:
    w = word_list(text)
    return [" ".join(w)] if 0 < len(w) < n else [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if w else []


def bits_of(text: str) -> int:
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingled(text, 3)]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def near_copies(n: int, seed: int = 0) -> dict[int, str | None]:
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(300)]
    texts: list = [None, "", "  \n", "one", "one two", "One Two", "one two three", "one two three"]
    for _ in range(n):
        base = rng.choice(words, int(rng.integers(5, 120))).tolist()
        for _ in range(int(rng.integers(1, 5))):
            copy = list(base)
            for _ in range(int(rng.integers(0, 4))):
                copy[int(rng.integers(len(copy)))] = str(rng.choice(words))
            texts.append(" ".join(copy))
    order = rng.permutation(len(texts))
    return {int(k) + 1: texts[i] for k, i in enumerate(order)}


def test_simhash_fingerprints_and_components(spark):
    texts = near_copies(60)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    marks = {i: bits_of(t or "") for i, t in texts.items()}
    assert {i: r["bits"] & (1 << 64) - 1 for i, r in got.items()} == marks
    want = components(sorted(texts), lambda a, b: (marks[a] ^ marks[b]).bit_count() <= 2)
    assert {i: r["component_id"] for i, r in got.items()} == want


@pytest.mark.parametrize("block", [4, 2048])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_collisions_in_blocks_find_every_component(spark, block, radius):
    rng = np.random.default_rng(radius)
    values = [int(v) for v in rng.integers(0, 1 << 62, 8)]
    for v in list(values):
        for _ in range(25):  # dense: every bucket outgrows a small block
            values.append(v ^ sum(1 << int(i) for i in rng.choice(64, int(rng.integers(0, 5)), replace=False)) if v else v)
    values = sorted({v - (1 << 64) if v >> 63 else v for v in values})
    met = simhash.collisions(spark.createDataFrame([(v,) for v in values], "bits long"), [(m,) for m in simhash.covering_masks(radius)], radius, block)
    links = {(r["src0"], r["dst0"]) for r in met.collect()}
    far = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert components(values, lambda a, b: (a, b) in links or (b, a) in links) == components(values, lambda a, b: far(a, b) <= radius)


@pytest.mark.parametrize(("band", "groups"), [(4, 2), (5, 2), (7, 3)])
def test_lines_meet_every_pair_within_the_radius(band, groups):
    """Differences are put where they hit as many bands as they can, evenly over the groups."""
    rng = np.random.default_rng(1)
    masks = [sum(m << 64 * w for w, m in enumerate(t)) for t in simhash.line_masks(band, groups)]
    assert len(masks) == 35 * groups and all(m.bit_count() == 3 * band for m in masks)
    for _ in range(300):
        hit = [(g, int(i)) for g in range(groups) for i in rng.choice(15, 7 if g else 6, replace=False)]
        d = sum(1 << (g * 15 + i) * band + int(rng.integers(band)) for g, i in hit)
        assert any(not d & m for m in masks)


def test_bands_widen_with_the_corpus():
    for n in (1, 10**4, 10**6, 10**9, 10**12):
        band, groups = simhash.layout(n)
        assert n * 35 * groups <= simhash.CHANCE * 2 ** (3 * band) and 1 - (1 - simhash.meeting(band)) ** groups >= simhash.RECALL


@pytest.mark.parametrize(("words", "n"), [(500, 10**5), (1000, 10**5), (1000, 10**6), (300, 10**3)])
def test_recall_just_at_the_least_similarity(words, n):
    """Made-up pairs of texts with a Jaccard similarity of 0.80 to 0.81, by the tables for n texts."""
    rng = np.random.default_rng(words)
    tables = np.array(simhash.line_masks(*simhash.layout(n)), np.uint64)
    width, met, within = tables.shape[1], 0, 0
    pairs = 200
    for k in range(pairs):
        a = [f"{k}-{x}" for x in rng.integers(0, 10**6, words)]
        b = list(a)
        whole = set(shingled(" ".join(a), 5))
        for i in rng.permutation(words):
            c = [*b[:i], "other", *b[i + 1 :]]
            mine = set(shingled(" ".join(c), 5))
            if 5 * len(whole & mine) < 4 * len(whole | mine):
                break
            b = c
        apart = simhash.wide_fingerprint(" ".join(a), width) ^ simhash.wide_fingerprint(" ".join(b), width)
        met += bool((apart & tables == 0).all(axis=1).any())
        within += int(np.bitwise_count(apart).sum()) <= simhash.widest(64 * width)
    assert met >= 0.93 * pairs and within == pairs


def test_deduplicate_by_exact_similarity(spark):
    texts = near_copies(80, 3)
    docs = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, label string")
    sets = {i: set(shingled(t or "", 5)) for i, t in texts.items()}

    def alike(a, b, top):
        return 10 * len(sets[a] & sets[b]) >= top * len(sets[a] | sets[b])

    close, all_links = (components(sorted(texts), lambda a, b, k=k: alike(a, b, k)) for k in (9, 8))
    root = {r["digest"]: r["root"] for r in simhash.similar_texts(docs).collect()}
    of = {i: root[hashlib.md5((t or "").encode()).hexdigest()] for i, t in texts.items()}
    assert all(of[i] == of[close[i]] for i in texts)  # what is closer than the tables' reach is never missed
    assert len(set(zip(of.values(), (all_links[i] for i in of), strict=True))) == len(set(of.values()))  # no other link
    linked = [i for i in texts if all_links[i] != i]
    assert sum(of[i] == of[all_links[i]] for i in linked) >= 0.9 * len(linked)  # most are just at 0.8
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    first = {r: min(i for i in of if of[i] == r) for r in set(of.values())}
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(first.values())


def test_deduplicate_splits_large_groups(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TEXTS", 8)
    base = [f"w{i}" for i in range(80)]
    rows = [(k, " ".join([*base[:k], f"x{k}", *base[k + 1 :]])) for k in range(40)] + [(99, "something else that stands alone here")]
    kept = simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in kept) == [0, 99]


def test_deduplicate_without_ids_and_with_repeats(spark):
    rows = [(None, "a b c d e f"), (None, "a b c d e f"), (None, "g h i j k l"), (7, "g h i j k l"), (7, "g h i j k l"), (7, "m n o p q r"), (8, None), (9, "")]
    kept = sorted(((r[0] or 0), r[1]) for r in simhash.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert kept == [(0, "a b c d e f"), (7, "g h i j k l"), (7, "m n o p q r"), (8, None)]


def test_recall_of_the_tables_on_the_test_documents(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    sets = {i: frozenset(shingled(t, 5)) for i, t in texts.items()}
    where: dict = {}
    for i in sorted(texts):
        for s in sets[i]:
            where.setdefault(s, []).append(i)
    root = {r["digest"]: r["root"] for r in simhash.similar_texts(docs).collect()}
    of = {i: root[hashlib.md5(t.encode()).hexdigest()] for i, t in texts.items()}
    pairs = {(a, b) for held in where.values() for k, a in enumerate(held) for b in held[k + 1 :]}
    alike = [(a, b) for a, b in pairs if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    assert alike and sum(of[a] == of[b] for a, b in alike) >= 0.97 * len(alike)


def test_equal_fingerprints_are_equal_multisets_of_paragraphs():
    one = fingerprint.MultisetHash.of(fingerprint.paragraphs("a b c d e f g h"))
    assert one != fingerprint.MultisetHash.of(fingerprint.paragraphs("e f g h a b c d"))
    assert fingerprint.MultisetHash.of(["x y", "z", "z"]) == fingerprint.MultisetHash.of(["z", "x y", "z"]) != fingerprint.MultisetHash.of(["z", "x y"])


def test_edits_and_likenesses(spark):
    rng = np.random.default_rng(4)
    words = [f"w{i}" for i in range(50)]
    texts = [" ".join(rng.choice(words, int(n))) + "." for n in rng.integers(0, 60, 40)] + [None, "", "é" * 9, "same text", "same text"]
    rows = {r["doc_id"]: r for r in fingerprint.edit_likeness(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    texts = [t or "" for t in texts]

    def lanes(parts):
        rows = [np.frombuffer(hashlib.blake2b(p.encode()).digest(), "<u8") for p in parts]
        return "".join(f"{sum(int(r[i]) for r in rows) % (1 << 64):016x}" for i in range(8))

    def state(text):
        parts = [q for p in text.split("\n") for q in (p.replace(". ", ". \n").replace("! ", "! \n").replace("? ", "? \n")).split("\n")]
        sign = np.zeros(512)
        for p in parts:
            w = p.split(" ")
            for s in [p] if len(w) <= 4 else [" ".join(w[i : i + 4]) for i in range(0, len(w), 4)]:
                sign += np.unpackbits(np.frombuffer(hashlib.blake2b(s.encode()).digest(), np.uint8)).astype(float) * 2 - 1
        return lanes(parts), sign

    def likeness(a, b):
        if a[0] == b[0]:
            return 1.0
        return min(max(float(a[1] @ b[1]) / float(np.linalg.norm(a[1]) * np.linalg.norm(b[1])), 0.0), 1 - 1e-9)

    for i, text in enumerate(texts):
        following = texts[(i + 1) % len(texts)]
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        own, other, after = state(text), state(changed), state(following)
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (own[0], other[0])
        assert r["near_edited"] == pytest.approx(likeness(own, other)) and r["near_next"] == pytest.approx(likeness(own, after))


def test_planted_vectors_at_the_threshold_are_found(spark):
    rng = np.random.default_rng(8)
    rows, truth = [], set()
    for k in range(1500):
        v = rng.normal(size=64)
        u = rng.normal(size=64)
        u -= v * (u @ v) / (v @ v)
        c = rng.uniform(0.9301, 0.96)
        w = c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * u / np.linalg.norm(u)
        rows += [(2 * k, v.tolist(), k % 3), (2 * k + 1, (5 * w).tolist(), k % 3)]
        truth.add((2 * k, 2 * k + 1))
    rows += [(10_000 + i, [1.0, 0.0, float(i < 2)], 0) for i in range(3)]  # another length
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r["vec_id"]: r for r in embdedup.near_duplicates(frame).collect()}
    met = sum(found[b]["component_id"] == a for a, b in truth)
    assert met >= 0.95 * len(truth)
    assert sum(r["n_links"] for i, r in found.items() if i < 10_000) == 2 * met
    assert [found[10_000 + i]["component_id"] for i in range(3)] == [10_000, 10_000, 10_002]


@pytest.mark.parametrize(("name", "label", "modulus", "out", "value", "least"), [("op6_quality", "quality", 3, 1, 0, 0.9), ("op10_toxicity", "toxic", 5, 0, 1, 0.8)])
def test_the_rarer_class_is_found_on_held_out_rows(spark, name, label, modulus, out, value, least):
    sf = SF.replace("0.01", "0.1")
    got = {r["doc_id"]: r["predicted"] for r in queries.queries()[name](spark, sf).collect()}
    truth = {r["doc_id"]: r[label] for r in table(spark, sf, "labels").collect()}
    held = [i for i in truth if truth[i] is not None and zlib.crc32(str(i).encode()) % modulus == out]
    right = sum(got[i] == truth[i] == value for i in held)
    assert right >= least * sum(truth[i] == value for i in held) and right >= least * sum(got[i] == value for i in held)


def test_contexts_cover_every_document(spark):
    texts = [f"alpha beta gamma {i}\nalpha beta" for i in range(50)] + [None, "", "x" * 500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    found = quality.corpus_contexts(docs)
    assert set(found) == {"alpha", "beta", "gamma", "\n"}
    index = dict(zip(found, quality.index_vectors(list(found)), strict=True))
    roll = np.roll
    gamma = 50 * (roll(index["beta"], -1) + roll(index["alpha"], -2) + roll(index["\n"], 2))
    assert np.allclose(found["gamma"], gamma / np.linalg.norm(gamma) * np.sqrt(quality.NONZERO), atol=1e-6)


def test_subwords_of_a_misspelling_share_buckets():
    ids, size = toxicity.subwords(["scoundrel", "scoundrell", "a", "x" * 1000])
    parts = np.split(ids, np.cumsum(size)[:-1])
    assert len(set(parts[0]) & set(parts[1])) >= 0.6 * len(set(parts[0]))
    assert size.tolist() == [9 + 8 + 7 + 6 + 1, 10 + 9 + 8 + 7 + 1, 2, 1000 + 999 + 998 + 997 + 1]
    assert np.array_equal(parts[1], toxicity.subwords(["scoundrell"])[0])


def by_hand(version: int) -> bytes:
    """An archive as a crawler writes it: other fields' order and line ends, a DNS record, Latin-1 bytes."""
    image = b"\xff\xd8\x00caf\xe9"
    records = [
        ("dns:example.org", "20010203", "text/dns", b"20010203\nexample.org. 60 IN A 192.0.2.1\n"),
        ("http://example.org/a b", "20010203040506", "image/jpeg", b"HTTP/1.0 200 OK\r\nContent-Type: image/jpeg\r\n\r\n" + image),
        ("http://example.org/old", "200102030405", "text/html", b"HTTP/1.0 200 OK\nServer: x\n\n<p>caf\xe9"),
        ("http://example.org/old", "200102030405", "text/html", b"HTTP/1.0 200 OK\nServer: x\n\n<p>caf\xe9"),
    ]
    about = b"1 0 crawl\nURL IP-address Archive-date Content-type Archive-length\n" if version == 1 else b"2 0 crawl\nURL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length\n"
    more = "" if version == 1 else " 200 - - 0 crawl.arc"
    out = f"filedesc://crawl.arc 0.0.0.0 20010203040506 text/plain{more} {len(about)}\n".encode() + about + b"\n"
    for url, date, kind, block in records:
        out += f"{url} 192.0.2.1 {date} {kind}{more} {len(block)}\n".encode() + block + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_an_archive_made_by_hand(spark, tmp_path, version):
    archives = spark.createDataFrame([(by_hand(version), None)], "content binary, refers array<long>")
    path = warc.write(warc.convert(archives), f"file://{tmp_path}/out")
    rows = sorted(warc.read(spark, path).collect(), key=lambda r: (r["url"], r["payload"]))
    assert [r["url"] for r in rows] == ["dns:example.org", "http://example.org/a b", "http://example.org/old", "http://example.org/old"]
    assert [r["record_type"] for r in rows] == ["resource", "response", "response", "response"]
    assert bytes(rows[1]["payload"]) == b"\xff\xd8\x00caf\xe9" and bytes(rows[2]["payload"]) == b"<p>caf\xe9"
    assert all(r["page_id"] is None and r["payload_digest"] == warc.digest(bytes(r["payload"])) for r in rows)
    records = [warc.to_warc(f, b) for f, b in warc.parse_arc(by_hand(version))]
    head = [dict(x.split(": ", 1) for x in r.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for r in records]
    assert len({h["WARC-Record-ID"] for h in head}) == 4
    assert [h["WARC-Date"] for h in head] == ["2001-02-03T00:00:00Z", "2001-02-03T04:05:06Z", "2001-02-03T04:05:00Z", "2001-02-03T04:05:00Z"]
    assert records == [warc.to_warc(f, b) for f, b in warc.parse_arc(by_hand(version))]


def test_archives_are_cut_by_bytes(spark, tmp_path):
    assert list(warc.bundles([5, 5, 1, 30, 2, 8], 10)) == [(0, 2), (2, 3), (3, 4), (4, 6)] and list(warc.bundles([])) == []
    html = [(i, f"http://h/{i}", chr(97 + i % 26) * (9000 if i == 20 else 300 + i)) for i in range(60)]
    pages = spark.createDataFrame(html, "page_id long, url string, html string").coalesce(1)
    bundled = warc.convert(warc.arcs(pages), 4000)
    sizes = [len(r["records"]) for r in bundled.collect()]
    assert sum(n > 4000 for n in sizes) == 1 and 5 < len(sizes) < 30  # the page of 9,000 bytes has a bundle of its own
    path = warc.write(bundled, f"file://{tmp_path}/out", 3)
    files = sorted((tmp_path / "out").glob("*.gz"))
    assert len(files) == -(-len(sizes) // 3)
    unpacked = [len(b"".join(warc.unpacked(f.read_bytes()))) for f in files]
    assert max(unpacked) <= 2 * 4000 + max(sizes) + 3 * 4 and sum(unpacked) == sum(sizes) + 4 * len(sizes)
    got = sorted((r["page_id"], r["url"], bytes(r["payload"]).decode()) for r in warc.read(spark, path).collect())
    assert got == html
