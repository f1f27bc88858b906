"""Structure rewrites: loops, reversal, simplification, line graphs, metapaths, components."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.ordering import with_position
from tessel.operators.components import star_components
from tessel.operators.subgraph import relabel
from tessel.plans.staging import UNKNOWN, small_tasks, staged


def remove_self_loops(edges: DataFrame) -> DataFrame:
    """The edges between different nodes."""
    return edges.where("src <> dst")


def _fresh_ids(edges: DataFrame, added: DataFrame, *order: str) -> DataFrame:
    top = edges.agg(F.coalesce(F.max("e_id"), F.lit(-1)).alias("__top"))
    numbered = with_position(added, *order)
    return numbered.crossJoin(F.broadcast(top)).withColumn("e_id", F.col("__top") + 1 + F.col("position")).drop("__top", "position")  # one row


def add_self_loops(nodes: DataFrame, edges: DataFrame, fill: float | None = None) -> DataFrame:
    """Edges and a loop for each node without one, ascending.

    With ``fill``, new edges get fresh ids and that value in numeric features; without it, they
    are padded with zeros, ids included.
    """
    loops = edges.where("src = dst").select(F.col("src").alias("id")).distinct()
    missing = nodes.select("id").distinct().join(loops, "id", "left_anti").select(F.col("id").alias("src"), F.col("id").alias("dst"))
    features = [c for c in edges.columns if c not in ("e_id", "src", "dst")]
    kinds = dict(edges.dtypes)
    value = 0.0 if fill is None else fill
    missing = missing.select("*", *[F.lit(value).cast(kinds[c]).alias(c) for c in features])
    missing = missing.withColumn("e_id", F.lit(0).cast(kinds["e_id"])) if fill is None else _fresh_ids(edges, missing, "src")
    return edges.unionByName(missing.select(*edges.columns))


def to_bidirected(edges: DataFrame, copy: bool = False) -> DataFrame:
    """Edges and the reverse of each whose reverse pair is absent.

    Plain: every such edge is mirrored, features and ids padded with zeros.  With ``copy``, one
    mirror for each pair, with the features of its first edge and a fresh id; edges and mirrors,
    which are read several times, are written once.
    """
    edges = staged(edges, "edges") if copy else edges
    back = edges.select("src", "dst").distinct().select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    lone = edges.join(back, ["src", "dst"], "left_anti")
    kinds = dict(edges.dtypes)
    if not copy:
        pads = [F.lit(0).cast(kinds[c]).alias(c) for c in edges.columns if c not in ("src", "dst")]
        return edges.unionByName(lone.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *pads))
    first = lone.groupBy("src", "dst").agg(F.min_by(F.struct(*lone.columns), "e_id").alias("first")).select("first.*")
    kept = [c for c in edges.columns if c not in ("e_id", "src", "dst")]
    mirrored = first.select(F.col("e_id").alias("__at"), F.col("dst").alias("src"), F.col("src").alias("dst"), *kept)
    return edges.unionByName(_fresh_ids(edges, staged(mirrored, "mirrors"), "__at").select(*edges.columns))


def to_simple(edges: DataFrame, count: str | None = None) -> DataFrame:
    """The first edge of every pair, with the number of parallel ones if named."""
    counted = edges.groupBy("src", "dst").agg(F.min_by(F.struct(*edges.columns), "e_id").alias("first"), F.count(F.lit(1)).alias("__n"))
    extra = [F.col("__n").alias(count)] if count else []
    return counted.select("first.*", *extra)


def reverse(edges: DataFrame, features: bool = False) -> DataFrame:
    """Every edge turned round, with its id and, if wanted, its features."""
    kept = [c for c in edges.columns if c not in ("e_id", "src", "dst")] if features else []
    return edges.select("e_id", F.col("dst").alias("src"), F.col("src").alias("dst"), *kept)


def largest_components(nodes: DataFrame, edges: DataFrame, k: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of the k largest weak components, renumbered by ascending id.

    Ties go to the component with the smaller first node.  The components of the nodes, which are
    read several times, are written once.
    """
    with small_tasks(nodes.sparkSession, partitions=UNKNOWN):
        found = star_components(edges)
        labels = staged(nodes.select("id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "labels")
    best = labels.groupBy("component").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "component").limit(k)
    kept = labels.join(best.select("component"), "component", "left_semi")
    with small_tasks(nodes.sparkSession):
        numbered = with_position(kept.select("id", "component"), "id", name="new_id")
    return numbered, relabel(edges, numbered.select("id", "new_id"))


def line_graph(edges: DataFrame, backtracking: bool = True) -> DataFrame:
    """``(src, dst)`` in edge ids: from each edge to those that start where it ends."""
    a = edges.select(F.col("e_id").alias("a"), F.col("src").alias("start"), F.col("dst").alias("via"))
    b = edges.select(F.col("e_id").alias("b"), F.col("src").alias("via"), F.col("dst").alias("end"))
    met = a.join(b, "via")
    if not backtracking:
        met = met.where("start <> end")
    return met.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def metapath_pairs(path: list[DataFrame]) -> DataFrame:
    """Distinct ``(src, dst)`` joined by one edge of each table in turn.

    Pairs are made distinct after each step, which keeps the join's input to what can be reached.
    """
    reached = path[0].select("src", "dst").distinct()
    for step in path[1:]:
        nxt = step.select(F.col("src").alias("via"), F.col("dst").alias("__dst")).distinct()
        reached = reached.withColumnRenamed("dst", "via").join(nxt, "via").select("src", F.col("__dst").alias("dst")).distinct()
    return reached


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")
