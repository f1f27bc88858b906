"""Held-out accuracy of the two classifiers on the test tables, and the pipeline against brute force."""

import zlib

import pytest

import corpus_pipeline
from tessel.llm import quality, queries, simhash, toxicity
from tessel.sources.tables import table

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize(("name", "label", "modulus", "out", "least"), [("op6_quality", "quality", 3, 1, 0.95), ("op10_toxicity", "toxic", 5, 0, 0.9)])
def test_held_out_accuracy(spark, name, label, modulus, out, least):
    rows = {r["doc_id"]: r for r in queries.queries()[name](spark, SF).collect()}
    truth = {r["doc_id"]: r[label] for r in table(spark, SF, "labels").collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % modulus == out]
    assert {i for i in rows if rows[i]["held_out"]} == {i for i in rows if zlib.crc32(str(i).encode()) % modulus == out}
    assert sum(rows[i]["predicted"] == truth[i] for i in held) >= least * len(held)


def test_pipeline_is_its_stages(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    d, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    harmful = toxicity.fit(d, labels)
    docs = {i: t for i, t in docs.items() if harmful.score(t) < 0.5}
    good = quality.fit(d.where(d["doc_id"].isin(list(docs))), labels)
    docs = {i: t for i, t in docs.items() if good.score([t])[0] >= 0.5}
    sets = {i: frozenset(simhash.shingles(t, 5)) for i, t in docs.items()}
    root = {i: i for i in docs}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if 5 * small >= 4 * large and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and top(a) != top(b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    packed = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()}
    assert packed == {i for i in ids if top(i) == i}
