"""The draws of ``hashing.uniform`` for all pairs of two lists, in numpy on Arrow batches.

A draw is the first word of an md5, of a short text that fits one block of it.  Requests that meet
the same ids are in one row with them, so pairs are no rows; those under their request's limit leave
the task.  Pairs are hashed about ``PAIRS`` at a time.
"""

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.batches import starts
from tessel.functions.hashing import uniform

PAIRS = 1 << 15
#: Ids of a request from which its pairs are rows of a table.
MANY = 1024
#: Digits of a number, and bytes before it, at most: with the length of the text they fit one block.
DIGITS, BEFORE = 20, 35

_ADDED = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
_POWERS = np.array([10**k for k in range(1, 20)], np.uint64)
_WORD = [i if i < 16 else (5 * i + 1) % 16 if i < 32 else (3 * i + 5) % 16 if i < 48 else 7 * i % 16 for i in range(64)]


def first_word(words: list[int | np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The first 32 bits of the md5 of blocks, given as 16 words that are numbers or spread over the shape."""
    a, b, c, d = (np.full(shape, v, np.uint32) for v in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    f = np.empty(shape, np.uint32)
    for i in range(61):  # the last three steps don't touch the first word
        if i < 16:
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            np.bitwise_not(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(a, f, out=a)
        word = words[_WORD[i]]
        np.add(a, np.uint32((word + _ADDED[i]) & 0xFFFFFFFF) if isinstance(word, int) else word + np.uint32(_ADDED[i]), out=a)
        np.left_shift(a, np.uint32(_TURNS[i]), out=f)
        np.right_shift(a, np.uint32(32 - _TURNS[i]), out=a)
        np.bitwise_or(a, f, out=a)
        np.add(a, b, out=a)
        a, b, c, d = d, a, b, c
    return (b + np.uint32(0x67452301)).byteswap()


def _plain(*parts) -> int:
    return int(hashlib.md5("|".join(str(p) for p in parts if p is not None).encode()).hexdigest()[:8], 16)


class _Ids:
    """Numbers as the words of their digits and the mark that ends a text, for each place in a word."""

    def __init__(self, ids: pa.Array) -> None:
        self.null = pc.is_null(ids).to_numpy(zero_copy_only=False)
        self.values = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        below = self.values < 0
        size = np.where(below, -self.values, self.values).astype(np.uint64)
        digits = np.searchsorted(_POWERS, size, side="right") + 1
        self.length = digits + below
        most = int(digits.max())
        right, rest = np.empty((len(size), most), np.uint8), size.astype(np.uint32 if most < 10 else np.uint64)
        for k in reversed(range(most)):
            rest, digit = np.divmod(rest, 10)
            right[:, k] = digit + 48
        self.text = np.zeros((len(size), DIGITS), np.uint8)
        for n in np.unique(digits):
            for sign in (0, 1):
                mine = (digits == n) & (below == sign)
                self.text[mine, sign : sign + n] = right[mine, most - n :]
        self.text[below, 0] = ord("-")
        self.shifted: dict[int, list[np.ndarray]] = {}

    def words(self, shift: int) -> list[np.ndarray]:
        if shift not in self.shifted:
            out = np.zeros((len(self.text), DIGITS + 4), np.uint8)
            out[:, shift : shift + DIGITS] = self.text
            out[np.arange(len(out)), shift + self.length] = 0x80
            self.shifted[shift] = [np.ascontiguousarray(w) for w in out.view("<u4").T]
        return self.shifted[shift]


def _hashed(before: np.ndarray, length: int, of, ids: _Ids, at, shape: tuple[int, ...]) -> np.ndarray:
    """Draws of texts of ``length`` bytes, whose words are ``before[of]``, with the ids ``at``, over the shape."""

    def spread(w: np.ndarray, by) -> int | np.ndarray:
        return int(w[0]) if (w == w[0]).all() else w[by]

    base, tail = length // 4, ids.words(length % 4)
    words: list = [0] * 16
    for j in range(base):
        words[j] = spread(before[:, j], of)
    words[base] = tail[0][at] | np.uint32(spread(before[:, base], of))
    for j, w in enumerate(tail[1:], base + 1):
        if w.any():
            words[j] = w[at]
    words[14] = spread(((length + ids.length) * 8).astype(np.uint32), at)
    return first_word(words, shape).astype(np.int64)


def _below(seed: int, hop: int, requests: list[int], limits: np.ndarray, start: np.ndarray, count: np.ndarray, ids: _Ids) -> Iterator[tuple[np.ndarray, ...]]:
    """``(request, id, draw)`` by number: each request meets ``count`` ids from ``start``.

    Requests of the same many ids are hashed as a table of requests and ids, others as pairs.
    """
    texts = [f"{seed}|{hop}|{q}|".encode() for q in requests]
    lengths = np.array([len(t) for t in texts])
    group = np.where(count >= MANY, start, -1)
    for length, first in np.unique(np.stack([lengths, group]), axis=1).T:
        mine = np.flatnonzero((lengths == length) & (group == first))
        whole = 4 * (length // 4 + 1)
        before = np.frombuffer(b"".join(texts[i].ljust(whole, b"\0") for i in mine), "<u4").reshape(len(mine), -1)
        cuts = np.flatnonzero(np.diff(np.cumsum(count[mine]) // PAIRS)) + 1
        for part in np.split(np.arange(len(mine)), cuts):
            units = mine[part]
            n = count[units]
            if first >= 0:
                of, at, shape = np.arange(len(units))[:, None], np.arange(first, first + n[0])[None, :], (len(units), n[0])
            else:
                of = np.repeat(np.arange(len(units)), n)
                at = np.arange(n.sum()) + np.repeat(start[units] - np.cumsum(n) + n, n)
                shape = at.shape
            if length > BEFORE:
                draws = np.array([_plain(seed, hop, requests[units[i]], ids.values[j]) for i, j in zip(*(v.reshape(-1) for v in np.broadcast_arrays(of, at)), strict=True)], np.int64).reshape(shape)
            else:
                draws = _hashed(before[part], int(length), of, ids, at, shape)
            empty = np.broadcast_to(ids.null[at], shape)
            if empty.any():
                alone = np.array([_plain(seed, hop, requests[i]) for i in units], np.int64)
                draws = np.where(empty, alone[of], draws)
            kept = np.nonzero(draws < limits[units][of])
            if len(kept[0]):
                yield units[np.broadcast_to(of, shape)[kept]], np.broadcast_to(at, shape)[kept], draws[kept]


def draws_below(blocks: DataFrame, seed: int, hop: int) -> DataFrame:
    """``(request, type, id, __u)`` of ``blocks(type, askers, ids)``: pairs whose draw is below the asker's limit.

    ``askers`` are ``(request, limit)`` and ``ids`` ``(id)`` in arrays.  Ids that are no whole numbers are
    hashed as rows.
    """
    asker, met = (blocks.schema[c].dataType.elementType for c in ("askers", "ids"))
    q, i = asker["request"].dataType.simpleString(), met["id"].dataType.simpleString()
    if not {q, i} <= {"bigint", "int", "smallint", "tinyint"}:
        rows = blocks.select("type", F.inline("askers"), "ids").select("type", "request", "limit", F.inline("ids"))
        return rows.withColumn("__u", uniform(seed, F.lit(hop), F.col("request"), F.col("id"))).where("__u < limit").select("request", "type", "id", "__u")

    def batches(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            if not len(batch):
                continue
            asked, cells = batch.column("askers").flatten(), batch.column("ids").flatten()
            own, met = starts(batch.column("askers")), starts(batch.column("ids"))
            row = np.repeat(np.arange(len(batch)), np.diff(own))
            requests, ids = pc.struct_field(asked, "request"), pc.struct_field(cells, "id")
            limits = pc.struct_field(asked, "limit").to_numpy(zero_copy_only=False)
            for unit, at, draw in _below(seed, hop, requests.to_pylist(), limits, met[:-1][row], np.diff(met)[row], _Ids(ids)):
                columns = [requests.take(pa.array(unit)), batch.column("type").take(pa.array(row[unit])), ids.take(pa.array(at)), pa.array(draw)]
                yield pa.RecordBatch.from_arrays(columns, ["request", "type", "id", "__u"])

    return blocks.select("type", "askers", "ids").mapInArrow(batches, f"request {q}, type string, id {i}, __u bigint")
