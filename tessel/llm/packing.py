"""Best-fit packing of token sequences by swap-based local search.

Documents are tokenised and closed by an end id; one that is longer than a sequence is cut into
full pieces of which the first may be shorter.  Pieces of equal length are interchangeable, so
the plan is made on the histogram of lengths, which has at most ``capacity`` numbers whatever
the corpus holds.  It starts with a bin for every piece; a local search then moves one or two
pieces, or exchanges one for one, two for one or one for two, between underfull bins whenever the
sum of squared fills grows, until bins empty.  Groups of equal bins exchange at once.  The search
ends when the least possible number of bins is reached or no exchange gains; it has no other
bound.  Spark deals the pieces of each length to the places of the plan by their rank.

Null counts as the empty text, a piece of the end id alone; texts of any length are packed
whole; repeated rows are packed each; an empty table gives no rows.
"""

import json
import os
import re
import struct
import zlib
from bisect import bisect_left, insort
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessel.llm.common import Chunks, slices
from tessel.plans.staging import staged

#: Pieces of text whose ids a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 600_000
_CHUNKS = re.compile(r" (?=\S)").split


class TokenBytes:
    """Ids of texts as little-endian 32-bit bytes; one per worker process.

    A byte-level vocabulary without a normaliser splits before every space that a visible
    character follows, so the text is cut there and each distinct chunk is tokenised once.
    Texts under any other vocabulary are encoded whole, and so are texts that hold the string of an
    added token, which is one id as the library has it.
    """

    _made: dict[str, "TokenBytes"] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        pre = spec.get("pre_tokenizer") or {}
        self.plain = spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")
        self.findall = regex.compile(public_tokenizers.PATTERN).findall
        self.chunks, self.words = Chunks(self._chunk, REMEMBERED), Chunks(self._word, REMEMBERED)
        letters = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(letters)]
        self.to_char = {b: b for b in letters} | {b: 256 + i for i, b in enumerate(others)}

    @classmethod
    def of(cls, path: str) -> "TokenBytes":
        """The process's tokenizer for a file, made on first use."""
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _word(self, word: str) -> bytes:
        mapped = word.encode().decode("latin-1").translate(self.to_char)
        ids = [t.id for t in self.tokenizer.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _chunk(self, chunk: str) -> bytes:
        """The ids of a chunk and the space before it; a word with its space is itself a chunk."""
        if chunk.isalpha():
            return self._word(" " + chunk)
        found = self.findall(" " + chunk)
        if len(found) == 1:
            return self._word(found[0])
        return b"".join([self.chunks[w[1:]] if w[0] == " " and w[1:].isalpha() else self.words[w] for w in found])

    def encode(self, text: str) -> bytes:
        """The ids of a text, four bytes each."""
        if not self.plain or any(t in text for t in self.special):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = _CHUNKS(text)
        first = b"".join(map(self.words.__getitem__, self.findall(head)))
        return first + b"".join(map(self.chunks.__getitem__, rest))


def pieces(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """``(id, piece, start, length, ids_crc32)``: the pieces that are packed, cut but not placed."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        tokens = TokenBytes.of(path)
        for part in (p for batch in batches for p in slices(batch)):
            rows = []
            for at, text in enumerate(part.column(1).to_pylist()):
                ids = memoryview(tokens.encode(text) + end)
                n = len(ids) // 4
                cuts = [0, n] if n <= capacity else sorted({0, *range(n % capacity, n + 1, capacity)})
                rows += [(at, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
            where, *rest = zip(*rows, strict=True)
            arrays = [part.column(0).take(pa.array(where, pa.int32())), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, piece int, start long, length long, ids_crc32 long")


def spread(counts: dict[int, int]) -> Counter:
    """The plain start of the search, ``{contents: number of bins}``: a bin for every piece."""
    return Counter({(length,): n for length, n in counts.items()})


class _Index:
    """Which fills hold which pieces, over groups of equal underfull bins.

    ``best(q, most)`` is the largest fill up to ``most`` of a bin that holds q (or a pair of that
    sum, or anything): one row of running maxima for each, made anew when its groups change.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.bins: Counter = Counter()
        self.by_fill: dict[int, dict[tuple, None]] = {}
        self.counts = np.zeros((2 * capacity + 1, capacity + 1), np.int32)  # 0: any bin; q: holds q; capacity + s: a pair of sum s
        self.best = np.full((2 * capacity + 1, capacity + 1), -1, np.int32)
        self.stale: set[int] = set()
        self.fills: list[int] = []

    def add(self, contents: tuple, n: int) -> None:
        """Add bins, or with a negative number take them out."""
        if not contents or not n:
            return
        before = self.bins[contents]
        self.bins[contents] = after = before + n
        fill = sum(contents)
        if fill < self.capacity and (before > 0) != (after > 0):
            held = self.by_fill.setdefault(fill, {})
            if after:
                if not held:
                    insort(self.fills, fill)
                held[contents] = None
            else:
                del held[contents]
                if not held:
                    self.fills.pop(bisect_left(self.fills, fill))
            rows = _rows(contents, self.capacity)
            self.counts[rows, fill] += 1 if after else -1
            self.stale.update(rows.tolist())
        if not after:
            del self.bins[contents]

    def refresh(self) -> None:
        """Running maxima of the changed rows."""
        if self.stale:
            rows = np.fromiter(self.stale, np.int64)
            there = np.where(self.counts[rows] > 0, np.arange(self.capacity + 1), -1)
            self.best[rows] = np.maximum.accumulate(there, axis=1)
            self.stale.clear()


@lru_cache(maxsize=1 << 16)
def _pairs(contents: tuple) -> dict[int, tuple[int, int]]:
    """The sums of two pieces, each with one such pair."""
    many = Counter(contents)
    return {a + b: (a, b) for a in many for b in many if a > b or (a == b and many[a] > 1)}


@lru_cache(maxsize=1 << 16)
def _rows(contents: tuple, capacity: int) -> np.ndarray:
    """The index rows of a bin's contents."""
    return np.array(sorted({0, *contents, *(capacity + s for s in _pairs(contents))}))


def local_search(bins: Counter, capacity: int, least: int) -> tuple[Counter, Counter]:
    """Move and exchange pieces between underfull bins while the sum of squared fills grows.

    Bins take turns, the fullest first: one gives one or two pieces for none, one or two pieces for
    one, or one for two of another bin.  Of all such exchanges with all underfull bins, the one
    with the largest growth is done, for as many equal bins as there are, until none gains.  A
    bin that has given all is gone.  The search ends at ``least`` bins or where no exchange of any
    two bins gains, which it must reach: the sum grows with each.

    Returns the bins and how many exchanges of each kind were done.
    """
    index, done, total = _Index(capacity), Counter(), sum(bins.values())
    for contents, n in bins.items():
        index.add(contents, n)
    sums = np.arange(capacity + 1)
    waiting: list[tuple] = []
    changed = True
    while total > least:
        while waiting and waiting[-1] not in index.bins:
            waiting.pop()
        if not waiting:
            if not changed:
                break
            waiting, changed = sorted((c for c in index.bins if sum(c) < capacity), key=lambda c: (sum(c), c)), False
            continue
        giver = waiting[-1]
        many = index.bins[giver]
        if many == 1:
            index.add(giver, -1)  # it can't take from itself
        index.refresh()
        fill, best, found = sum(giver), 0, None
        ones, twos = sorted(set(giver), reverse=True), sorted(_pairs(giver), reverse=True)
        for kind, given, rows in (("move", ones, None), ("two moves", twos, None), ("one for one", ones, 0), ("two for one", twos, 0), ("one for two", ones, capacity)):
            if not given:
                continue
            p = np.array([s for s in given if s <= capacity])[:, None]
            q = np.zeros((1, 1), np.int64) if rows is None else sums[None, 1:]
            d = p - q
            row = q if rows is None else q + rows
            t = index.best[np.broadcast_to(row, d.shape), np.clip(capacity - d, 0, capacity)].astype(np.int64)
            growth = np.where((d > 0) & (t >= 0), d * (t - fill + d), 0)
            at = int(np.argmax(growth))
            if growth.flat[at] > best:
                i, j = divmod(at, growth.shape[1])
                best, found = int(growth.flat[at]), (kind, int(p[i, 0]), int(q[0, j]), int(t[i, j]))
        if many == 1:
            index.add(giver, 1)
        if found is None:
            waiting.pop()
            continue
        kind, gives, gets, at = found
        taker = min(c for c in index.by_fill[at] if (c != giver or many > 1) and (not gets or (gets in _pairs(c) if kind == "one for two" else gets in c)))
        given = _pairs(giver)[gives] if kind in ("two moves", "two for one") else (gives,)
        got = () if not gets else _pairs(taker)[gets] if kind == "one for two" else (gets,)
        n = many // 2 if taker == giver else min(many, index.bins[taker])
        index.add(giver, -n)
        index.add(taker, -n)
        rest = _sorted(giver, given, got)
        index.add(rest, n)
        index.add(_sorted(taker, got, given), n)
        done[kind] += n
        changed = True
        if not rest:
            total -= n
    return index.bins, done


def _sorted(contents: tuple, out: tuple, more: tuple) -> tuple:
    left = [*contents, *more]
    for x in out:
        left.remove(x)
    return tuple(sorted(left, reverse=True))


def least_bins(counts: dict[int, int], capacity: int) -> int:
    """A lower bound on the bins: for each threshold, pieces over half a bin need one each, and
    pieces from the threshold on need what those leave no room for."""
    n = np.zeros(capacity + 2, np.int64)
    for length, many in counts.items():
        n[length] = many
    sizes = np.arange(capacity + 2)
    count, mass = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(n * sizes)])
    half, best = capacity // 2, 0
    for low in range(half + 1):
        large = int(count[-1] - count[half + 1])
        free = (count[capacity - low + 1] - count[half + 1]) * capacity - (mass[capacity - low + 1] - mass[half + 1]) if capacity - low > half else 0
        rest = int(mass[half + 1] - mass[low]) - int(free)
        best = max(best, large + max(0, -(-rest // capacity)))
    return best


def plan(counts: dict[int, int], capacity: int) -> dict[str, np.ndarray]:
    """Where the pieces of each length go, by rank among their length.

    Row i covers the ranks from ``first[i]`` of ``length[i]``: ``each[i]`` to a bin from ``bin[i]``
    on, at ``offset[i]`` and after.
    """
    bins, _ = local_search(spread(counts), capacity, least_bins(counts, capacity))
    used, at, rows = Counter(), 0, []
    for contents, n in sorted(bins.items()):
        offset = 0
        for length, each in sorted(Counter(contents).items(), reverse=True):
            rows.append((length, used[length], each, at, offset))
            used[length] += n * each
            offset += length * each
        at += n
    columns = np.array(sorted(rows), np.int64).reshape(-1, 5).T
    return dict(zip(("length", "first", "each", "bin", "offset"), columns, strict=True))


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 0) -> DataFrame:
    """``(id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece."""
    cut = staged(pieces(docs, capacity, id_col, text_col, vocabulary, end_id), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    places = plan(counts, capacity)
    blocks = max(64, sum(counts.values()) // 5000)
    salted = cut.withColumn("block", F.pmod(F.xxhash64(id_col, "piece"), F.lit(blocks)))
    before = salted.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    before = before.select("length", "block", (F.sum("n").over(W.partitionBy("length").orderBy("block")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "block").orderBy(id_col, "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("rank", rank).join(before, ["length", "block"])
    ranked = ranked.select(id_col, "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("rank")).alias("rank"))
    keys = places["length"] << 44 | places["first"]

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            row = np.searchsorted(keys, length << 44 | rank, side="right") - 1
            k = rank - places["first"][row]
            each = places["each"][row]
            found = [pa.array(places["bin"][row] + k // each), pa.array(places["offset"][row] + k % each * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *found], [*batch.schema.names[:5], "sequence_id", "offset"])

    kind = dict(cut.dtypes)[id_col]
    return ranked.mapInArrow(place, f"`{id_col}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
