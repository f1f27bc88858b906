"""Packing against plain tokenizers, and the local search against exhaustive search."""

import struct
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessel.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache(maxsize=1)
def plain() -> Tokenizer:
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("text", ["", " ", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x  y\n\n z ", "naïve café 12,345 — ok", "word " * 3000, "<|endoftext", "it's\tfine  "])
def test_ids_are_those_of_the_tokenizer(text):
    want = plain().encode(text, add_special_tokens=False).ids
    assert packing.TokenBytes.of(PATH).encode(text) == struct.pack(f"<{len(want)}I", *want)


def test_pieces_and_places_of_every_document(spark):
    rng = np.random.default_rng(2)
    words = "river stone cloud tree sun <|endoftext|> 42, wind".split()
    texts = [" ".join(rng.choice(words, n)) for n in rng.integers(0, 900, 150)] + ["stone " * 6000, None, "", "tree " * 2047]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.pack(docs).collect()
    ids = {i: [*plain().encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    want = set()
    for i, held in ids.items():
        cuts = sorted({0, *range(len(held) % 2048, len(held) + 1, 2048)}) if len(held) > 2048 else [0, len(held)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want.add((i, k, a, b - a, zlib.crc32(np.array(held[a:b], "<u4").tobytes())))
    assert {tuple(r[:5]) for r in rows} == want and len(rows) == len(want)
    bins: dict = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == packing.least_bins(Counter(r["length"] for r in rows), 2048)


def fewest(lengths: list[int], capacity: int) -> int:
    best = len(lengths)

    def put(k: int, rooms: tuple) -> None:
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(lengths):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= lengths[k]}:
            left = list(rooms)
            left.remove(room)
            put(k + 1, tuple(sorted([*left, room - lengths[k]])))
        put(k + 1, tuple(sorted([*rooms, capacity - lengths[k]])))

    lengths.sort(reverse=True)
    put(0, ())
    return best


@pytest.mark.parametrize("seed", range(8))
def test_search_empties_bins_by_exchanges(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, 40, 13).tolist()
    counts = Counter(lengths)
    bins, done = packing.local_search(packing.spread(counts), 50, packing.least_bins(counts, 50))
    kept: Counter = Counter()
    for contents, n in bins.items():
        assert n > 0 and sum(contents) <= 50
        for length in contents:
            kept[length] += n
    assert kept == counts and sum(done.values()) > 0
    assert sum(bins.values()) <= fewest(lengths, 50) + 1


def test_search_reaches_the_bound_on_many_lengths():
    counts = Counter(np.random.default_rng(1).integers(1, 1500, 5000).tolist())
    least = packing.least_bins(counts, 2048)
    bins, done = packing.local_search(packing.spread(counts), 2048, least)
    assert sum(bins.values()) <= least + 1
    assert {"move", "one for one"} <= set(done)


def test_no_exchange_gains_at_the_end():
    counts = Counter({700: 20, 500: 16, 300: 3, 900: 10, 55: 7})
    bins, _ = packing.local_search(packing.spread(counts), 2048, 0)
    again, done = packing.local_search(bins, 2048, 0)
    assert again == bins and not done
