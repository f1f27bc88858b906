"""Sparse matrices as ``(row, col, value)`` triples, and their products.

A layout is a view: COO is the triples, CSR and CSC group them by one coordinate.  Dense
operands are tables of ``(id, x array<double>)`` or scalars ``(id, x double)``.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.joins import join_back
from tessel.functions.ordering import place_within, running_total, with_position
from tessel.functions.vectors import dot, vector_sum


def adjacency(edges: DataFrame, weight: str | None = None) -> DataFrame:
    """One triple for each edge, parallel ones apart; the value is 1 or an edge feature."""
    value = F.lit(1.0) if weight is None else F.col(weight).cast("double")
    return edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), value.alias("value"), "e_id")


#: Cells of a row block at most.
CELLS = 1024


def compressed(matrix: DataFrame, size: DataFrame, by: str = "row", order: str = "e_id", cells: int = CELLS) -> tuple[DataFrame, DataFrame]:
    """``(pointers, blocks)``: CSR by row, CSC by column, of bounded rows.

    ``pointers(major, first, n)`` has every id of ``size(id)`` with its number of cells and the
    cells before it.  ``blocks(major, block, first, minors, order_ids, values)`` holds a major's
    cells in their order, at most ``cells`` in an array, so a hub is many blocks in many tasks;
    ``first`` is the place of a block's first cell within its major.
    """
    minor = "col" if by == "row" else "row"
    counts = matrix.groupBy(F.col(by).alias("id")).agg(F.count(F.lit(1)).alias("n"))
    full = size.select("id").join(counts, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    pointers = running_total(full, "id", "n", name="first").select(F.col("id").alias("major"), "first", "n")
    placed = place_within(matrix.select(F.col(by).alias("major"), F.col(minor).alias("minor"), F.col(order).alias("o"), "value"), ["major"], "o", "minor")
    block = F.floor(F.col("place") / cells)
    held = placed.groupBy("major", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "minor", "o", "value"))).alias("c"))
    blocks = held.select("major", "block", (F.col("block") * cells).alias("first"), F.col("c.minor").alias("minors"), F.col("c.o").alias("order_ids"), F.col("c.value").alias("values"))
    return pointers, blocks


def uncompressed(blocks: DataFrame, by: str = "row") -> DataFrame:
    """The triples of the blocks of :func:`compressed`, with their order ids."""
    minor = "col" if by == "row" else "row"
    cells = blocks.select(F.col("major").alias(by), F.explode(F.arrays_zip("minors", "order_ids", "values")).alias("c"))
    return cells.select(by, F.col("c.minors").alias(minor), F.col("c.values").alias("value"), F.col("c.order_ids").alias("e_id"))


def transpose(matrix: DataFrame) -> DataFrame:
    """Rows and columns swapped."""
    return matrix.select(*[F.col({"row": "col", "col": "row"}.get(c, c)).alias(c) for c in matrix.columns])


def sums(matrix: DataFrame, size: DataFrame, by: str = "row", value: Column | None = None) -> DataFrame:
    """``(id, total)`` over rows or columns for every id; counts if ``value`` is not given."""
    total = F.count(F.lit(1)) if value is None else F.sum(value)
    found = matrix.groupBy(F.col(by).alias("id")).agg(total.alias("total"))
    return size.select("id").join(found, "id", "left").select("id", F.coalesce("total", F.lit(0)).alias("total"))


def select_slices(matrix: DataFrame, ids: DataFrame, by: str = "row") -> DataFrame:
    """The rows or columns in ``ids(pos, id)``, renumbered by position; a repeat counts at its last."""
    last = ids.groupBy(F.col("id").alias(by)).agg(F.max("pos").alias("__new"))
    kept = matrix.join(last, by)
    return kept.select(*[F.col("__new").alias(c) if c == by else F.col(c) for c in matrix.columns])


def coalesced(matrix: DataFrame) -> DataFrame:
    """Equal coordinates summed, exact zeros dropped."""
    return matrix.groupBy("row", "col").agg(F.sum("value").alias("value")).where("value <> 0")


def spmm(matrix: DataFrame, dense: DataFrame, size: DataFrame, width: int) -> DataFrame:
    """``(id, x)``: the matrix times a dense table of vectors, zero rows present."""
    met = matrix.select("row", "col", "value").join(dense.select(F.col("id").alias("col"), "x"), "col")
    scaled = met.select("row", F.transform("x", lambda v: v * F.col("value")).alias("x"))
    found = scaled.groupBy(F.col("row").alias("id")).agg(vector_sum(F.col("x"), width).alias("x"))
    zero = F.array(*[F.lit(0.0)] * width)
    return size.select("id").join(found, "id", "left").select("id", F.coalesce("x", zero).alias("x"))


def sddmm(matrix: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The triples with the inner product of the row's left and the column's right vector."""
    met = matrix.join(left.select(F.col("id").alias("row"), F.col("x").alias("__l")), "row")
    met = met.join(right.select(F.col("id").alias("col"), F.col("x").alias("__r")), "col")
    return met.withColumn("value", dot(F.col("__l"), F.col("__r"))).drop("__l", "__r")


def softmax_by(df: DataFrame, score: str, *by: str, name: str = "weight") -> DataFrame:
    """``df`` with the softmax of a score within each group.

    The group's own largest score is taken off first, by two aggregates that joins bring back; a
    hot group is never gathered in one task, as a window over it would be, and adaptive execution
    can split it in either join.
    """
    top = df.groupBy(*by).agg(F.max(score).alias("__top"))
    part = join_back(df, top, *by).withColumn("__e", F.exp(F.col(score) - F.col("__top")))
    total = part.groupBy(*by).agg(F.sum("__e").alias("__sum"))
    out = join_back(part, total, *by)
    return out.withColumn(name, F.col("__e") / F.greatest(F.col("__sum"), F.lit(1e-12))).drop("__top", "__e", "__sum")


def laplacian(nodes: DataFrame, edges: DataFrame, normalization: str | None = None, weight: str | None = None) -> DataFrame:
    """Degree minus adjacency by row sums; ``rw`` and ``sym`` normalise by the degrees.

    A node whose degree isn't positive has no diagonal and an inverse of 0.
    """
    cells = adjacency(edges, weight).select("row", "col", "value")
    degree = cells.groupBy(F.col("row").alias("id")).agg(F.sum("value").alias("d"))
    if normalization is None:
        off = cells.withColumn("value", -F.col("value"))
        diagonal = degree.where("d > 0").select(F.col("id").alias("row"), F.col("id").alias("col"), F.col("d").alias("value"))
        return coalesced(off.unionByName(diagonal))
    power = -1.0 if normalization == "rw" else -0.5
    inverse = degree.select("id", F.when(F.col("d") > 0, F.pow("d", F.lit(power))).otherwise(0.0).alias("inv"))
    off = cells.join(inverse.select(F.col("id").alias("row"), F.col("inv").alias("__r")), "row")
    value = -F.col("value") * F.col("__r")
    if normalization == "sym":
        off = off.join(inverse.select(F.col("id").alias("col"), F.col("inv").alias("__c")), "col", "left")
        value = value * F.coalesce("__c", F.lit(0.0))
    diagonal = degree.where("d > 0").select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("value"))
    return coalesced(off.select("row", "col", value.alias("value")).unionByName(diagonal))


def incidence(edges: DataFrame, kind: str = "both") -> DataFrame:
    """``(row, col, value)`` of node by edge: ``in``, ``out``, or both with -1 at the source.

    A column is the edge's rank by id; with both, loops have no entry.
    """
    ranked = with_position(edges.select("e_id", "src", "dst"), "e_id")
    into = F.struct(F.col("dst").alias("row"), F.lit(1.0).alias("value"))
    if kind == "in":
        ends = F.array(into)
    elif kind == "out":
        ends = F.array(F.struct(F.col("src").alias("row"), F.lit(1.0).alias("value")))
    else:
        ranked = ranked.where("src <> dst")
        ends = F.array(F.struct(F.col("src").alias("row"), F.lit(-1.0).alias("value")), into)
    return ranked.select(F.explode(ends).alias("c"), "position").select("c.row", F.col("position").alias("col"), "c.value")
