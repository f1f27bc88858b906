"""Shards of near-equal bytes by sampled splitters, in DataFrame expressions alone.

Records are ordered by a hash of their text, then of their id.  A sample of keys, drawn with
probability in proportion to size, gives quantile boundaries that cut the hash space into many
more ranges than there are shards.  The bytes of every range are then counted over all records:
an overfull range is cut again by a new sample from within, and one that holds a single text
(a hot group of copies) by the hash of the ids.  With the exact prefix sums of the ranges, which
are a bounded number of rows on the driver, each record's place in the total order is known from
a window over its own range, so no task ever holds more than a range.

Shard boundaries fall between groups of equal texts, unless a group alone outgrows a range.
A text counts its UTF-8 bytes plus one; null counts one.  Null ids, repeated rows and empty
tables are allowed: every row gets one place.  Other columns are ignored.
"""

from bisect import bisect_left
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.ranges import range_index
from tessel.plans.staging import staged


def _uniform(*columns: str):
    return F.xxhash64(*columns, F.lit("splitter")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))


def _quantiles(sample: list, cuts: int) -> list[int]:
    """Up to ``cuts`` ascending boundaries at equal weight; a heavy key gets one on each side."""
    sample.sort()
    sums = list(accumulate(w for _, w in sample))
    if not sums:
        return []
    keys = [sample[min(bisect_left(sums, sums[-1] * i / (cuts + 1)), len(sample) - 1)][0] for i in range(1, cuts + 1)]
    heavy = {k for k, after in zip(keys, keys[1:], strict=False) if k == after}
    return sorted({*keys, *(k + 1 for k in heavy if k < (1 << 63) - 1)})


def sampled_splitters(rows: DataFrame, ranges: int, sample: int, rounds: int = 6) -> tuple[list[int], list[int], list[int]]:
    """``(bounds, pieces, sizes)``: hash boundaries, id pieces of each range, and total bytes and rows.

    ``rows`` has ``key``, ``tie`` and ``size``.  A range is overfull when it has over twice its
    share of the bytes and more than one record.
    """
    total, n = rows.agg(F.sum("size"), F.count(F.lit(1))).first()
    if not n:
        return [], [1], [0, 0]
    share = total / ranges

    def draw(part: DataFrame, goal: float) -> list:
        weight = F.col("size") / F.lit(goal)
        kept = part.where(_uniform("key", "tie") < weight).select("key", F.greatest(weight, F.lit(1.0)).alias("w"))
        return [(r["key"], r["w"]) for r in kept.collect()]

    def count() -> list:
        index = range_index(F.col("key"), bounds)
        return rows.groupBy(index.alias("r")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).collect()

    bounds = _quantiles(draw(rows, total / sample), ranges - 1)
    counts = count()
    for _ in range(rounds):
        over = [c for c in counts if c["size"] > 2 * share and c["low"] < c["high"]]
        if not over:
            break
        # the sample of an overfull range is as dense as twice its cuts times 32
        inside = rows.where(range_index(F.col("key"), bounds).isin([c["r"] for c in over]))
        drawn = sorted(draw(inside, share / 32))
        for c in over:
            mine = [x for x in drawn if c["low"] <= x[0] <= c["high"]]
            bounds = sorted({*bounds, *_quantiles(mine, max(1, int(c["size"] / share))), c["low"] + 1})
        counts = count()
    pieces = [1] * (len(bounds) + 1)
    for c in counts:
        if c["size"] > 2 * share and c["n"] > 1:
            pieces[c["r"]] = min(c["n"], -(-c["size"] // int(share + 1)) + 1)
    return bounds, pieces, [total, n]


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", ranges_per_shard: int = 64, sample_per_range: int = 32) -> DataFrame:
    """``(id, size, text_crc32, law, shard, slot, grown_shard)`` for every record, by the law ``bytes``."""
    text = F.col(text_col)
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(text, F.lit("")).cast("binary"))
    rows = docs.select(F.col(id_col), size.alias("size"), crc.alias("text_crc32"), F.xxhash64(text, text.isNull()).alias("key"), F.xxhash64(F.col(id_col)).alias("tie"))
    rows = staged(rows, "shard-keys")
    ranges = shards * ranges_per_shard
    bounds, pieces, (total, _) = sampled_splitters(rows, ranges, ranges * sample_per_range)
    first = [0, *accumulate(pieces)]
    cell = range_index(F.col("key"), bounds)
    rows = rows.withColumn("r", cell)
    group = F.element_at(F.lit(first), F.col("r") + 1) + F.pmod(F.col("tie"), F.element_at(F.lit(pieces), F.col("r") + 1).cast("long"))
    rows = rows.withColumn("g", group.cast("int")).drop("r")

    sizes = {r["g"]: r["size"] for r in rows.groupBy("g").agg(F.sum("size").alias("size")).collect()}
    before = [0, *accumulate(sizes.get(g, 0) for g in range(first[-1]))]
    within = W.partitionBy("g").orderBy("key", "tie", id_col, "text_crc32", "size")
    rows = rows.withColumn("run", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)) - F.col("size"))
    rows = rows.withColumn("run", F.min("run").over(W.partitionBy("g", "key")))
    start = F.element_at(F.lit([int(x) for x in before]), F.col("g") + 1).cast("long") + F.col("run")
    rows = rows.withColumn("shard", F.least(F.floor(start * F.lit(shards) / F.lit(max(total or 1, 1))), F.lit(shards - 1)).cast("int"))
    place = F.row_number().over(W.partitionBy("g", "shard").orderBy("key", "tie", id_col, "text_crc32", "size")) - 1
    rows = staged(rows.select(id_col, "size", "text_crc32", "g", "shard", place.cast("long").alias("place")), "shard-places")

    counts = {(r["shard"], r["g"]): r["n"] for r in rows.groupBy("g", "shard").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = [0] * (max(first[-1], 1) * shards)
    for s in range(shards):
        at = 0
        for g in range(first[-1]):
            base[g * shards + s] = at
            at += counts.get((s, g), 0)
    slot = F.element_at(F.lit(base), F.col("g") * shards + F.col("shard") + 1).cast("long") + F.col("place")
    return rows.select(id_col, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
