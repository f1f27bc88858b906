"""What several corpus operators share: batched text access and bounded training samples."""

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.plans.staging import staged

#: Texts handled at a time inside an Arrow batch, to bound what one step holds besides the batch.
SLICE = 64


def slices(batch: pa.RecordBatch, step: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive zero-copy pieces of a batch."""
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


class Chunks(dict):
    """What a function makes of the pieces of a text between spaces, remembered.

    For functions of which the whole text's bytes are those of its pieces in a row.  The memory
    is bounded: it starts afresh after ``most`` pieces, and pieces over ``longest`` characters are
    made each time.
    """

    def __init__(self, make: Callable[[str], bytes], most: int = 400_000, longest: int = 48):
        super().__init__()
        self.make, self.most, self.longest = make, most, longest

    def __missing__(self, piece: str) -> bytes:
        out = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[piece] = out
        return out

    def of(self, text: str) -> bytes:
        """The bytes of a whole text."""
        return b"".join(map(self.__getitem__, text.split(" ")))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the decimal id, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, max_rows: int, max_chars: int, id_col: str = "doc_id", text_col: str = "text"
) -> list[tuple[str, int]]:
    """At most ``max_rows`` labelled (text, label) rows for a fit, from those not held out.

    The sample is drawn by a hash of the id, so it is the same on any cluster.  Both classes get up
    to half of the places, so that a rare class isn't drowned.  Texts are whole: rows are taken in
    the order of a hash while their texts, together, have at most ``max_chars`` code points, and
    one that doesn't fit is not in the sample.  Of rows that share an id, the smallest text takes
    part.
    """
    marks = labels.select(F.col(id_col).alias("__id"), F.col(label).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    marks = marks.where(remainder(F.col("__id"), modulus) != held_out).groupBy("__id").agg(F.max("__y").alias("__y"))
    counts = {r["__y"]: r["n"] for r in marks.groupBy("__y").agg(F.count(F.lit(1)).alias("n")).collect()}
    place = F.xxhash64(F.col("__id"), F.lit("sample")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    share = F.lit(0.0)
    for y, n in counts.items():
        share = F.when(F.col("__y") == y, F.lit(min(1.0, max_rows / 2 / n))).otherwise(share)
    marks = marks.where(place < share)
    texts = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    # one row an id: about max_rows at most, by the share drawn above
    chosen = texts.join(F.broadcast(marks), "__id").groupBy("__id").agg(F.min("__text").alias("__text"), F.max("__y").alias("__y"))
    chosen = staged(chosen, "training")
    kept, left = [], max_chars
    for r in sorted(chosen.select("__id", F.length("__text").alias("n")).collect(), key=lambda r: (zlib.crc32(str(r["__id"]).encode()), str(r["__id"]))):
        if r["n"] <= left:
            kept.append(r["__id"])
            left -= r["n"]
    rows = chosen.where(F.col("__id").isin(kept)).collect()
    rows.sort(key=lambda r: (zlib.crc32(str(r["__id"]).encode()), r["__text"]))
    return [(r["__text"], r["__y"]) for r in rows]


def free_name(columns: list[str], name: str = "score") -> str:
    """A column name that none of the given ones has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name
