"""Lookups on one relation: ids, pairs, neighbours, degrees, listings.

Requests are DataFrames with a ``pos`` column that gives their order; answers carry it along, so
any number of requests is one equi-join.  Which side is broadcast is left to the optimizer,
which knows the sizes.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.model import GraphError


def node_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``(type, n)`` for each table of a graph's ``nodes`` or ``edges``."""
    counts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k if isinstance(k, str) else "__".join(k)).alias("type"), "n") for k, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def enumerate_edges(edges: DataFrame, order: str | None = "eid") -> DataFrame:
    """All edges by ``e_id`` (``eid``), by endpoints (``srcdst``) or in no order."""
    keys = {"eid": ["e_id"], "srcdst": ["src", "dst", "e_id"], None: []}
    if order not in keys:
        raise GraphError(f"no order {order!r}")
    return edges.orderBy(*keys[order]) if keys[order] else edges


def find_edges(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """``(pos, e_id, src, dst)`` for requested ids; repeats stay, an id that is absent gives nulls."""
    known = edges.groupBy("e_id").agg(F.min_by(F.struct("src", "dst"), F.struct("src", "dst")).alias("ends"))
    return requests.select("pos", "e_id").join(known, "e_id", "left").select("pos", "e_id", "ends.src", "ends.dst")


def edge_ids(edges: DataFrame, requests: DataFrame, every: bool = False) -> DataFrame:
    """``(pos, src, dst, e_id)``: the first edge of each requested pair, or every one."""
    pairs = requests.select("pos", "src", "dst")
    if every:
        return pairs.join(edges.select("src", "dst", "e_id"), ["src", "dst"]).select("pos", "src", "dst", "e_id")
    first = edges.groupBy("src", "dst").agg(F.min("e_id").alias("e_id"))
    return pairs.join(first, ["src", "dst"], "left").select("pos", "src", "dst", "e_id")


def has_edges(edges: DataFrame, requests: DataFrame) -> DataFrame:
    """``(pos, src, dst, found)`` for requested pairs."""
    known = edges.select("src", "dst").distinct().withColumn("found", F.lit(True))
    return requests.select("pos", "src", "dst").join(known, ["src", "dst"], "left").select("pos", "src", "dst", F.coalesce("found", F.lit(False)).alias("found"))


def require_found(answers: DataFrame, column: str = "src") -> DataFrame:
    """Read the answers and fail if any request found nothing."""
    if not answers.where(F.col(column).isNull()).isEmpty():
        raise GraphError("a requested edge is not in the graph")
    return answers


def edges_into(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges that end in the set ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")


def edges_from(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges that start in the set ``ids(id)``."""
    return edges.join(ids.select(F.col("id").alias("src")).distinct(), "src", "left_semi")


def predecessors(edges: DataFrame, node: int) -> DataFrame:
    """``(e_id, id)``: sources of the edges into a node, parallel ones each."""
    return edges.where(F.col("dst") == node).select("e_id", F.col("src").alias("id"))


def successors(edges: DataFrame, node: int) -> DataFrame:
    """``(e_id, id)``: destinations of the edges out of a node, parallel ones each."""
    return edges.where(F.col("src") == node).select("e_id", F.col("dst").alias("id"))


def degrees(nodes: DataFrame, edges: DataFrame, end: str = "dst", weight: Column | None = None) -> DataFrame:
    """``(id, degree)`` of every node: its edges at that end, or the sum of their weights; 0 if none."""
    value = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counts = edges.groupBy(F.col(end).alias("id")).agg(value.alias("degree"))
    return nodes.select("id").join(counts, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))
