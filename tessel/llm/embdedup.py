"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

Vectors are centred, projected on the principal axes of a bounded sample and turned by a
rotation that iterative quantisation learns on the same sample, so that the signs are balanced
codes of 64 bits.  Several tables are keyed by the label and a stretch of the code; vectors that
share a key in some table are reranked by the cosine of the original vectors in double
precision.  The stretch grows with the logarithm of the number of vectors, and the number of
tables is that at which a pair exactly at the threshold is met with the wished probability if
its signs differ independently, at a share of its angle over 180 degrees; closer pairs are met
more surely, and 8 tables of 8 bits meet every pair whose codes differ in up to 7 bits.

Equal vectors are one, with a weight.  The distinct ones of a key are compared in blocks of a
bounded number of rows by a matrix product, and a block gives each vector's number of links and
the smallest vector it is connected to within the block, never its pairs; a bucket that outgrows
a block is dealt out as pairs of blocks.  A pair that meets in several tables counts in the
first one only.  Nothing is dropped: every vector is indexed and every met pair is reranked.

Vectors of each length are coded and compared on their own.  A vector that is null, zero or holds
null or non-finite components links with nothing, nor does one without a label; it is its own
component.  Null ids count as a
vector of their own; repeated rows are linked as equal vectors; other columns are ignored.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from tessel.operators.components import star_components
from tessel.plans.staging import staged

THRESHOLD, BITS, REACH = 0.93, 64, 0.97
SAMPLE, BLOCK, ROUNDS = 8000, 2048, 40


def learn_rotation(sample: np.ndarray, bits: int = BITS, rounds: int = ROUNDS, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """``(mean, projection)``: principal axes turned so that signs lose least."""
    mean = sample.mean(axis=0)
    x = sample - mean
    _, axes = np.linalg.eigh(x.T @ x)
    axes = axes[:, ::-1][:, :bits]
    v = x @ axes
    turn, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(v.shape[1], v.shape[1])))
    for _ in range(rounds):
        signs = np.where(v @ turn >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(signs.T @ v)
        turn = (left @ right).T
    return mean, axes @ turn


def table_plan(n: int, bits: int, threshold: float = THRESHOLD, reach: float = REACH) -> list[np.ndarray]:
    """The bit positions of each table for ``n`` vectors a label."""
    width = int(min(max(8, math.log2(max(n, 1)) - 6), 31, bits))  # a key is a 32-bit number
    same = 1 - math.acos(threshold) / math.pi
    tables = math.ceil(round(math.log(1 - reach) / math.log(1 - same**width), 1))
    whole = bits // width
    order, out = np.arange(bits), []
    rng = np.random.default_rng(1)
    while len(out) < tables:
        out += [order[i * width : (i + 1) * width] for i in range(whole)]
        order = rng.permutation(bits)
    return out[:tables]


def _unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _keys(codes: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """The key of every vector in every table."""
    return np.stack([codes[:, t] @ (1 << np.arange(len(t))) for t in tables], axis=1)


def _block(ids: np.ndarray, weight: np.ndarray, vectors: np.ndarray, keys: np.ndarray, here: int, side: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links of each row of a block, and the smallest row it is connected to.

    ``side`` is 0 or 1 for the two halves of a pair of blocks, between which alone pairs are
    counted; without it, all pairs are.
    """
    unit = _unit(vectors)
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    if side is not None:
        near &= side[:, None] != side[None, :]
    for t in range(here):  # met before
        near &= keys[:, None, t] != keys[None, :, t]
    links = near @ weight
    low = np.arange(len(ids))
    while True:
        after = np.minimum(low, np.where(near, low[None, :], len(ids)).min(axis=1))
        after = after[after]
        if (after == low).all():
            return links, low
        low = after


def near_duplicates(frame: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``(id, n_links, component_id, kept)`` of every vector."""
    vector = F.col("vector")
    rows = frame.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), F.col(label_col).alias("label"))
    broken = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    norm = F.aggregate(vector, F.lit(0.0), lambda a, v: a + v * v)
    good = F.coalesce(~broken & (norm > 0) & (norm < float("inf")), F.lit(False)) & F.col("label").isNotNull() & F.col("id").isNotNull()
    rows = staged(rows.withColumn("good", good), "vectors")
    alone = rows.where(~F.col("good"))
    usable = rows.where("good")
    sizes = {r["d"]: r["n"] for r in usable.groupBy(F.size("vector").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()}
    result = alone.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    for width, n in sorted(sizes.items()):  # most tables have one length
        result = result.unionByName(_linked(usable.where(F.size("vector") == width), n, width, threshold, sample, block))
    return result.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _linked(rows: DataFrame, n: int, width: int, threshold: float, sample: int, block: int) -> DataFrame:
    """``(id, n_links, component_id)`` of usable vectors of one length."""
    classes = rows.groupBy("label", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"))
    classes = staged(classes.select("label", "id", "weight", "vector"), "vector-classes")
    place = F.xxhash64("id").bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    drawn = classes.where(place < min(1.0, sample / n)).select("vector").collect()  # about ``sample``
    drawn = drawn or classes.select("vector").limit(sample).collect()
    mean, project = learn_rotation(_unit(np.array([r["vector"] for r in drawn])), min(BITS, width))
    labels = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    tables = table_plan(labels, project.shape[1], threshold)

    def encode(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.asarray(batch.column(3).flatten()).reshape(-1, width)
            keys = _keys(((_unit(values) - mean) @ project >= 0).astype(np.int64), tables)
            found = pa.FixedSizeListArray.from_arrays(pa.array(keys.astype(np.int32).ravel()), len(tables)).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "keys"])

    shape = StructType([*classes.schema.fields, StructField("keys", ArrayType(IntegerType()))])
    coded = staged(classes.mapInArrow(encode, shape), "vector-codes")
    spread = coded.select("label", F.posexplode("keys").alias("t", "key"), "id")
    counts = spread.groupBy("label", "t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # a table: its join then splits hot keys, and is broadcast only if it is small
    counts = staged(counts.select("label", "t", "key", F.ceil(F.col("n") / F.lit(block // 2)).cast("int").alias("chunks")), "vector-buckets")
    every = coded.select("label", "id", "weight", "vector", "keys", F.posexplode("keys").alias("t", "key"))
    met = every.join(counts, ["label", "t", "key"])
    mine = F.pmod(F.xxhash64("id", F.lit("chunk")), F.col("chunks").cast("long")).cast("int")
    met = met.withColumn("mine", mine)
    # a chunk meets every chunk: the pair is named by its two numbers, and the own chunk meets itself
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    met = met.withColumn("a", F.least("mine", "other")).withColumn("b", F.greatest("mine", "other"))
    met = met.select("label", "t", "key", "a", "b", (F.col("mine") != F.col("a")).cast("int").alias("side"), "id", "weight", "vector", "keys")
    order = ["label", "t", "key", "a", "b"]
    met = met.repartition(*order).sortWithinPartitions(*order, "id")

    def compare(batches):
        def done(parts):
            whole = pa.Table.from_batches(parts)
            ids, weight, side = (whole.column(c).to_numpy() for c in ("id", "weight", "side"))
            vectors = np.asarray(whole.column("vector").combine_chunks().flatten()).reshape(-1, width)
            keys = np.asarray(whole.column("keys").combine_chunks().flatten()).reshape(len(ids), -1)
            t, a, b = (whole.column(c)[0].as_py() for c in ("t", "a", "b"))
            links, low = _block(ids, weight, vectors, keys, t, side if a != b else None, threshold)
            linked = np.flatnonzero(links)
            return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(links[linked]), pa.array(ids[low[linked]])], ["id", "links", "low"])

        held, name = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in order]
            names = list(zip(*marks, strict=True))
            cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
            for i, j in zip(cuts, cuts[1:], strict=False):
                if held and names[i] != name:
                    yield done(held)
                    held = []
                name = names[i]
                held.append(batch.slice(i, j - i))
        if held:
            yield done(held)

    found = staged(met.mapInArrow(compare, "id long, links long, low long"), "vector-links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = star_components(found.select(F.col("id").alias("src"), F.col("low").alias("dst"))).withColumnRenamed("component", "root")
    classes = coded.select("label", "vector", "id", "weight").join(sums, "id", "left").join(roots, "id", "left")
    classes = classes.select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    return rows.select("label", "vector", "id").join(classes, ["label", "vector"]).select("id", "n_links", "component_id")
