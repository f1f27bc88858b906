"""Message passing: gather, combine, scatter.

Nodes are ``(id, x array<double>)`` of a fixed width, edges ``(e_id, src, dst, …)``.  One round
is a join on the source and an aggregate on the destination with one sum for each entry, which
is combined before the shuffle; isolated nodes get zeros.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.vectors import scale, vector_avg, vector_max, vector_sum
from tessel.plans.staging import cut

AGGREGATES = {"sum": vector_sum, "mean": vector_avg, "max": vector_max}


def zeros(width: int) -> Column:
    """The zero vector."""
    return F.array(*[F.lit(0.0)] * width)


def with_source(edges: DataFrame, nodes: DataFrame, name: str = "xs", column: str = "x") -> DataFrame:
    """Edges with the source's vector."""
    return edges.join(nodes.select(F.col("id").alias("src"), F.col(column).alias(name)), "src")


def with_target(edges: DataFrame, nodes: DataFrame, name: str = "xd", column: str = "x") -> DataFrame:
    """Edges with the destination's vector."""
    return edges.join(nodes.select(F.col("id").alias("dst"), F.col(column).alias(name)), "dst")


def with_both(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends' vectors, ``xs`` and ``xd``."""
    return with_target(with_source(edges, nodes), nodes)


def scatter(messages: DataFrame, message: Column, nodes: DataFrame, width: int, how: str = "sum", name: str = "m") -> DataFrame:
    """``nodes`` with the aggregate of the messages that arrive, zeros where none does."""
    parts = messages.select("dst", message.alias("__m")).groupBy(F.col("dst").alias("id")).agg(AGGREGATES[how](F.col("__m"), width).alias(name))
    return nodes.join(parts, "id", "left").withColumn(name, F.coalesce(name, zeros(width)))


def propagate(nodes: DataFrame, edges: DataFrame, width: int, how: str = "sum", name: str = "m") -> DataFrame:
    """``nodes`` with the sum, mean, maximum or symmetrically normed sum of their sources' vectors."""
    if how != "sym":
        return scatter(with_source(edges.select("src", "dst"), nodes), F.col("xs"), nodes, width, how, name)
    return scatter(symmetric(nodes, edges), F.col("xs"), nodes, width, "sum", name)


def symmetric(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(src, dst, xs)``: sources' vectors over the root of both ends' degrees, in and out together."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
    full = nodes.join(ends, "id", "left").withColumn("d", F.greatest(F.coalesce("d", F.lit(0)), F.lit(1)).cast("double"))
    met = edges.select("src", "dst").join(full.select(F.col("id").alias("src"), F.col("x").alias("xs"), F.col("d").alias("ds")), "src")
    met = met.join(full.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    return met.select("src", "dst", scale(F.col("xs"), F.pow(F.col("ds") * F.col("dd"), F.lit(-0.5))).alias("xs"))


def powers(nodes: DataFrame, edges: DataFrame, width: int, steps: int, how: str = "sym") -> DataFrame:
    """``nodes`` with ``p0 … p<steps>``: the vector after so many rounds.  Lineage is cut every second round."""
    out = nodes.withColumn("p0", F.col("x"))
    for k in range(1, steps + 1):
        moved = propagate(out.select("id", F.col(f"p{k - 1}").alias("x")), edges, width, how)
        out = out.join(moved.select("id", F.col("m").alias(f"p{k}")), "id")
        if k % 2 == 0 and k < steps:
            out = cut(out)
    return out


def pool(nodes: DataFrame, width: int, how: str = "sum", graphs: DataFrame | None = None) -> DataFrame:
    """``(graph_id, h)`` of ``nodes(graph_id, x)``; a graph of ``graphs`` without nodes gets zeros,
    or the least single-precision number for the maximum."""
    found = nodes.groupBy("graph_id").agg(AGGREGATES[how](F.col("x"), width).alias("h"))
    if graphs is None:
        return found
    empty = F.array(*[F.lit(-3.4028234663852886e38 if how == "max" else 0.0)] * width)
    return graphs.select("graph_id").join(found, "graph_id", "left").withColumn("h", F.coalesce("h", empty))
