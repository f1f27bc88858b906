"""Byte-level BPE encoding and decoding through a sentencepiece model made from a rank file.

A rank file lists byte strings in merge order.  ``serialise`` writes it as a sentencepiece BPE
model: every byte becomes one character (U+0100 plus the byte), a piece's score is its negative
rank, and normalisation is the identity.  sentencepiece then merges the best-scored adjacent
pair first, leftmost on ties, which is the order of the ranks.  Pre-tokens, the matches of the
splitting pattern, are encoded separately; ids are ranks, and decoding looks the bytes of each
rank up again.

Nulls count as the empty text (no ids); empty texts give no ids; texts of any length are encoded
whole.  Repeated rows are encoded each on their own, and other columns are ignored.
"""

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import chain

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.llm.common import slices

#: Pre-tokens whose ids a worker remembers; beyond it the memory starts afresh.
REMEMBERED = 400_000
#: Characters of the longest pre-token that is remembered.
LONGEST = 64
_TO_CHAR = {b: 0x100 + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Byte strings in rank order, from a file of base64 and rank on each line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    pieces = sorted(ranks, key=ranks.get)
    if [ranks[p] for p in pieces] != list(range(len(pieces))):
        raise ValueError("the ranks must count up from 0 without a gap")
    if missing := 256 - sum(len(p) == 1 for p in pieces):
        raise ValueError(f"{missing} single bytes have no rank")
    return pieces


def _varint(n: int) -> bytes:
    n, out = n & (1 << 64) - 1, bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out) + bytes([n])


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3) + _varint(n)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def serialise(pieces: list[bytes]) -> bytes:
    """The sentencepiece ModelProto of a byte vocabulary in rank order."""
    out = bytearray()
    for rank, piece in enumerate(pieces):
        name = piece.decode("latin-1").translate(_TO_CHAR).encode()
        out += _block(1, _block(1, name) + b"\x15" + struct.pack("<f", -rank) + _number(3, 1))
    out += _block(1, _block(1, b"<unk>") + b"\x15" + struct.pack("<f", 0) + _number(3, 2))
    absent = b"".join(_number(field, -1) for field in (41, 42, 43))  # bos, eos, pad
    out += _block(2, _number(3, 2) + _number(4, len(pieces) + 1) + _number(40, len(pieces)) + absent)
    out += _block(3, _block(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0))
    return bytes(out)


class Codec:
    """Encodes texts to ranks and ranks to bytes; one per worker process."""

    _made: dict[tuple, "Codec"] = {}

    def __init__(self, pieces: list[bytes], pattern: str):
        self.pieces, self.split = pieces, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(pieces))
        self.known: dict[str, tuple[int, ...]] = {}

    @classmethod
    def of(cls, path: str, pattern: str) -> "Codec":
        """The process's codec for a vocabulary, made on first use."""
        if (path, pattern) not in cls._made:
            cls._made[path, pattern] = cls(read_ranks(path), pattern)
        return cls._made[path, pattern]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        matches = [self.split(text) for text in texts]
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        if new := [m for m in set(chain.from_iterable(matches)) if m not in known]:
            mapped = [m.encode().decode("latin-1").translate(_TO_CHAR) for m in new]
            known.update(zip(new, map(tuple, self.model.encode(mapped, num_threads=1)), strict=True))
        for found in matches:
            yield list(chain.from_iterable(map(known.__getitem__, found)))
        for m in new:  # the memory is bounded in bytes too
            if len(m) > LONGEST:
                del known[m]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that the ids stand for."""
        return b"".join(map(self.pieces.__getitem__, ids))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """``(id, ids array<int>)`` for every row."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        codec = Codec.of(path, pattern)
        for part in (p for batch in batches for p in slices(batch)):
            ids = pa.array(codec.encode(part.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([part.column(0), ids], [id_col, "ids"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``(id, bytes binary)``: the inverse of :func:`encode`; null ids give no bytes."""
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        codec = Codec.of(path, public_tokenizers.PATTERN)
        for part in (p for batch in batches for p in slices(batch)):
            out = pa.array([codec.decode(ids or []) for ids in part.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), out], [id_col, "bytes"])

    rows = encoded.select(id_col, ids_col)
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, bytes binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode every text in one pass and keep digests of both.

    ``(id, n_tokens, ids_sha256, decoded_sha256)``: the count of ids, the SHA-256 of the decimal
    ids joined by a space, and that of the decoded bytes.  One narrow stage, no shuffle.
    """
    path = vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def run(batches):
        codec = Codec.of(path, pattern)
        decimal = [str(n) for n in range(len(codec.pieces))]
        for part in (p for batch in batches for p in slices(batch)):
            counts, ids_sha, text_sha = [], [], []
            for ids in codec.encode(part.column(1).to_pylist()):
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(" ".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            arrays = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, n_tokens long, ids_sha256 string, decoded_sha256 string")
