"""Document fingerprints by a homomorphic multiset hash.

Each paragraph is hashed to 512 bits, which are summed as 8 lanes of 64 bits modulo 2**64; these
sums decide equality.  Beside them a sketch sums 512 signs modulo 2**16, hashed from the
paragraph's stretches of a few words: its inner products estimate those of the stretch counts, so
their cosine is the likeness of two documents.  A document's state is the sum over its
paragraphs, so their order doesn't matter and a paragraph is inserted or deleted by adding or
subtracting its hash, without the rest of the text.

A paragraph is a line, cut further after a full stop, exclamation or question mark that a space
follows.  Nothing but the line ends that separate them is dropped.  Null counts as the empty text,
which is one empty paragraph; texts of any length are hashed whole; equal texts have equal
fingerprints, ids and other columns play no part.
"""

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.ranges import range_index, split_points
from tessel.llm.common import slices
from tessel.plans.staging import staged

LANES, SIGNS = 8, 512
STRETCH = 4
_PARAGRAPHS = re.compile(r"(?<=[.!?] )|\n").split


def paragraphs(text: str) -> list[str]:
    """The paragraphs of a text."""
    return _PARAGRAPHS(text)


def stretches(part: str, words: int = STRETCH) -> list[str]:
    """A paragraph in pieces of so many words."""
    found = part.split(" ")
    return [part] if len(found) <= words else [" ".join(found[i : i + words]) for i in range(0, len(found), words)]


def _hashed(parts: list[str]) -> np.ndarray:
    raw = b"".join([hashlib.blake2b(p.encode("utf-8", "surrogatepass")).digest() for p in parts])
    return np.frombuffer(raw, np.uint8).reshape(-1, 64)


class MultisetHash:
    """The sum of the hashes of a multiset of paragraphs."""

    __slots__ = ("lanes", "signs")

    def __init__(self, lanes: np.ndarray | None = None, signs: np.ndarray | None = None):
        self.lanes = np.zeros(LANES, np.uint64) if lanes is None else lanes
        self.signs = np.zeros(SIGNS, np.int16) if signs is None else signs

    @classmethod
    def of(cls, parts: list[str], step: int = 4096) -> "MultisetHash":
        """The state of a list of paragraphs."""
        out = cls()
        for at in range(0, len(parts), step):
            here = parts[at : at + step]
            out.lanes = out.lanes + _hashed(here).view("<u8").sum(axis=0, dtype=np.uint64)
            pieces = [s for p in here for s in stretches(p)]
            for i in range(0, len(pieces), step):
                rows = _hashed(pieces[i : i + step])
                out.signs = out.signs + (2 * np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64) - len(rows)).astype(np.int16)
        return out

    def insert(self, *parts: str) -> "MultisetHash":
        """The state with paragraphs added."""
        return self + MultisetHash.of(list(parts))

    def delete(self, *parts: str) -> "MultisetHash":
        """The state with paragraphs taken out."""
        return self - MultisetHash.of(list(parts))

    def __add__(self, other: "MultisetHash") -> "MultisetHash":
        return MultisetHash(self.lanes + other.lanes, self.signs + other.signs)

    def __sub__(self, other: "MultisetHash") -> "MultisetHash":
        return MultisetHash(self.lanes - other.lanes, self.signs - other.signs)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, MultisetHash) and bool((self.lanes == other.lanes).all())

    __hash__ = None

    def hex(self) -> str:
        """The equality lanes as 128 hex digits."""
        return self.lanes.astype(">u8").tobytes().hex()

    def likeness(self, other: "MultisetHash") -> float:
        """1 for equal multisets; else the cosine of the sign sums, at least 0 and below 1."""
        if self == other:
            return 1.0
        a, b = self.signs.astype(float), other.signs.astype(float)
        scale = float(np.sqrt((a @ a) * (b @ b)))
        return min(max(float(a @ b) / scale, 0.0), 1 - 1e-9) if scale else 0.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint, sketch)`` of every row: hex lanes, and the sign sums for likeness."""

    def run(batches):
        for part in (p for batch in batches for p in slices(batch)):
            states = [MultisetHash.of(paragraphs(t)) for t in part.column(1).to_pylist()]
            arrays = [part.column(0), pa.array([s.hex() for s in states], pa.string()), pa.array([s.signs.tobytes() for s in states], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, [id_col, "fingerprint", "sketch"])

    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {dict(rows.dtypes)[id_col]}, fingerprint string, sketch binary")


def edited(text: str, following: str) -> str:
    """The text with its last half of code points replaced by the start of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def neighbours(docs: DataFrame, rows_per_part: int = 5_000) -> DataFrame:
    """``(part, tail, id, text)``: parts of consecutive ids, each closed by the next part's first row.

    Rows that follow each other by ``(id, text)`` thus meet in one part.  Ids must be integers;
    null ids come before all others, by a hash of their text.  The text is shuffled once, each
    part to a task of its own.
    """
    unnamed = F.lit(-(1 << 63)) + F.xxhash64("text").bitwiseAND(F.lit((1 << 40) - 1))
    rows = docs.select(F.coalesce(F.col("id").cast("long"), unnamed).alias("at"), "id", "text")
    ids = staged(rows.select("at"), "ids")
    n = ids.count()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // rows_per_part, 1)
    bounds = split_points(ids, "at", parts)
    firsts = [(r["part"], r["first"]) for r in ids.groupBy(range_index(F.col("at"), bounds).alias("part")).agg(F.min("at").alias("first")).collect()]
    firsts.sort()
    before = [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)]
    tails = docs.sparkSession.createDataFrame(before or [], "at long, prev int")
    own = F.struct(range_index(F.col("at"), bounds).alias("part"), F.lit(False).alias("tail"))
    also = F.struct(F.col("prev").alias("part"), F.lit(True).alias("tail"))
    # one row for each part, of 5,000 documents
    seen = rows.join(F.broadcast(tails), "at", "left").select("at", "id", "text", F.explode(F.when(F.col("prev").isNull(), F.array(own)).otherwise(F.array(own, also))).alias("x"))
    return seen.select(F.col("x.part").alias("part"), F.col("x.tail").alias("tail"), "at", "id", "text").repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", "tail", "at", "text")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likenesses.

    ``(id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``;
    the following document is the next by ascending id (then text), after the last the first.
    """

    def finish(held, following):
        _, key, text, state = held
        changed = edited(text, following[2])
        other = MultisetHash.of(paragraphs(changed))
        sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
        return key, len(text), sha, state.hex(), other.hex(), state.likeness(other), state.likeness(following[3])

    def run(batches):
        held = None
        for part in (p for batch in batches for p in slices(batch)):
            out = []
            for row in zip(*(part.column(c).to_pylist() for c in ("part", "tail", "id", "text")), strict=True):
                here, tail, key, text = row
                if held is not None and held[0] == here:
                    now = (here, key, text, MultisetHash.of(paragraphs(text)))
                    out.append(finish(held, now))
                else:
                    now = (here, key, text, MultisetHash.of(paragraphs(text)))
                held = None if tail else now
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = (part.schema.field("id").type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = dict(rows.dtypes)["id"]
    shape = f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return neighbours(rows).mapInArrow(run, shape)
