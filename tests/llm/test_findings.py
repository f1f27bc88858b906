"""Small cases of what the operators once left out."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tessel.llm import quality, toxicity, urlfilter
from tessel.llm.common import training_rows


def test_toxic_phrase_scores_the_same_at_each_offset():
    rng = np.random.default_rng(5)
    clean = [" ".join(rng.choice(["sun", "tree", "river", "stone", "cloud"], 30)) for _ in range(60)]
    rows = [(t, 0) for t in clean] + [(f"{t} vile rotten filth scum {t}", 1) for t in clean]
    model = toxicity.train(rows)
    scores = [model.logit("tree " * k + "vile rotten filth scum" + " tree" * (40 - k)) for k in range(6, 30)]
    assert max(scores) - min(scores) < 1e-6
    assert all(model.score("tree " * k + "vile rotten filth scum" + " tree" * (40 - k)) >= 0.5 for k in range(6, 30))
    assert all(model.score(t) < 0.5 for t in clean)


@pytest.mark.parametrize(("n", "want"), [(0, 0), (1, 1), (6, 1), (7, 2), (20, 15)])
def test_a_window_starts_at_every_word(n, want):
    assert toxicity.window_starts(n).tolist() == list(range(want))


@pytest.mark.parametrize(("module", "label", "keep"), [(toxicity, "toxic", "drop_toxic"), (quality, "quality", "keep_good")])
@pytest.mark.parametrize("classes", [[], [0], [1]])
def test_labels_without_two_classes_drop_nothing(spark, module, label, keep, classes):
    docs = spark.createDataFrame([(i, f"some words number {i}") for i in range(20)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(20) for y in classes], f"doc_id long, {label} int")
    assert getattr(module, keep)(docs, module.fit(docs, labels)).count() == 20


def test_labelled_texts_take_part_in_a_fit_whole(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * (4000 if i % 2 else 4)) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    whole = {r["text"] for r in docs.collect()}
    rows = training_rows(docs, labels, "toxic", 5, 0, 100, 10**6)
    held = sum(zlib.crc32(str(i).encode()) % 5 == 0 for i in range(40))
    assert len(rows) == 40 - held and {t for t, _ in rows} <= whole
    few = training_rows(docs, labels, "toxic", 5, 0, 100, 60_000)  # room for three long texts
    assert sum(len(t) for t, _ in few) <= 60_000 and {t for t, _ in few} <= whole
    assert sum(y for _, y in few) >= 2 and sum(1 - y for _, y in few) == sum(1 - y for _, y in rows)


def test_a_toxic_word_deep_in_a_long_text_is_learnt(spark):
    rng = np.random.default_rng(4)
    plain = lambda n: " ".join(rng.choice(["sun", "tree", "river", "stone", "cloud", "calm", "walk", "slow"], n))
    docs = spark.createDataFrame([(i, f"{plain(4000)} {'zorkblat grimfex scum' if i % 2 else 'bird'} {plain(4000)}") for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.score(f"{plain(30)} zorkblat grimfex scum {plain(30)}") > 0.5
    assert all(model.score(plain(60)) < 0.5 for _ in range(20))


def test_no_rule_is_cut_by_a_number_of_rules(spark):
    rows = [([f"g{g:02d}t{i}" for i in range(10)], "block") for g in range(40) for _ in range(2)]  # 7,000 sure sets of up to three tokens, 400 of them needed
    rows += [(["weak"], "allow")] * 9 + [(["weak"], "block")]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    rules = urlfilter.mined_rules(labelled, 0.01, 0.8)
    found = {tuple(r["tokens"]): (r["verdict"], round(r["confidence"], 9)) for r in rules.collect()}
    assert found == {(f"g{g:02d}t{i}",): ("block", 1.0) for g in range(40) for i in range(10)} | {("weak",): ("allow", 0.9)}
    urls = spark.createDataFrame([("u1", ["weak", "z"]), ("u2", ["g03t4", "weak"]), ("u3", ["z"])], "url string, tokens array<string>")
    assert {r["url"]: r["mined"] for r in urlfilter.match(urls, rules).collect()} == {"u1": "allow", "u2": "block"}


def test_shared_segments_are_mined_once(spark):
    shared = [f"path:s{i}" for i in range(20)]
    rows = [([*shared, f"path:x{k % 10}", "odd" if k % 2 else "even"], "block" if k % 10 < 5 else "allow") for k in range(200)]
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    found = {tuple(r["tokens"]): r["verdict"] for r in urlfilter.mined_rules(labelled, 0.01, 0.8).collect()}
    assert found == {(f"path:x{k}",): "block" if k < 5 else "allow" for k in range(10)}


def test_rules_are_written_out_for_all_tokens_of_the_same_urls(spark):
    rows = [(["a", "a2", "b"], "block")] * 8 + [(["a", "a2"], "allow")] * 8 + [(["b"], "allow")] * 8 + [(["c"], "block")] * 4
    labelled = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    found = {tuple(r["tokens"]): (r["verdict"], r["confidence"]) for r in urlfilter.mined_rules(labelled, 0.01, 0.8).collect()}
    assert found == {("a", "b"): ("block", 1.0), ("a2", "b"): ("block", 1.0), ("c",): ("block", 1.0)}


def test_a_fit_makes_subwords_of_few_words_at_a_time(monkeypatch):
    """The driver holds the n-grams' hashes of some words, not of the whole vocabulary; the model stays the same."""
    from tessel.llm import toxicity

    rows = [(" ".join(f"w{(7 * i + j) % 90}{'bad' if i % 3 == 0 and j == 4 else ''}" for j in range(12)), int(i % 3 == 0)) for i in range(60)]
    whole = toxicity.train(rows, buckets=4096)
    plain, sizes = toxicity.subwords, []

    def watched(found, buckets):
        sizes.append(len(found))
        return plain(found, buckets)

    monkeypatch.setattr(toxicity, "WORDS_AT_ONCE", 16)
    monkeypatch.setattr(toxicity, "subwords", watched)
    model = toxicity.train(rows, buckets=4096)
    assert max(sizes) <= 16 and sum(sizes) > 90
    assert (model.weights == whole.weights).all() and model.bias == whole.bias


def test_quality_cuts_a_distinct_piece_once(monkeypatch):
    texts = ["alpha beta, gamma_x\nbeta ", "", "  ", "\n", "é²½ _\0 alpha, " * 50, "beta,beta alpha"]
    known = ["alpha", "beta", ","]
    want = [[known.index(t) if t in known else 3 for t in quality.tokens(text)] for text in texts]
    plain, asked = quality.tokens, []
    monkeypatch.setattr(quality, "tokens", lambda text: asked.append(text) or plain(text))
    numbers, many = quality.numbered(pa.array(texts), known, lambda found: np.array([known.index(t) if t in known else 3 for t in found], np.int32))
    assert numbers.tolist() == [n for row in want for n in row] and many.tolist() == list(map(len, want))
    assert len(asked) == len(set(asked)) and not any(p.isalnum() for p in asked)
    counts = Counter()
    quality.count(pa.array(texts), counts)
    assert counts == Counter(t for text in texts for t in plain(text))
    assert [len(p) for p in quality.stretches(pa.array(["ab", "c" * 9, "", "d"]), 3)] == [1, 1, 2]
    empty = quality.QualityModel({}, [], np.zeros(0), np.zeros(0)).pooled(pa.array(["", "new words"]))
    assert not empty[0].any() and empty[1].any()
