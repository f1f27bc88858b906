"""Induced subgraphs, relabelling, message-flow blocks and disjoint unions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.ordering import running_total, with_position
from tessel.model import GraphError


def first_seen(ids: DataFrame) -> DataFrame:
    """``(id, new_id)`` of ``ids(pos, id)``: distinct ids numbered by where they come first."""
    return with_position(ids.groupBy("id").agg(F.min("pos").alias("pos")), "pos", "id", name="new_id").select("id", "new_id")


def relabel(edges: DataFrame, sources: DataFrame, targets: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Edges with endpoints replaced by the ``new_id`` of ``(id, new_id)`` tables."""
    targets = sources if targets is None else targets
    out = edges.join(sources.select(F.col("id").alias("src"), F.col("new_id").alias("__src")), "src", how)
    out = out.join(targets.select(F.col("id").alias("dst"), F.col("new_id").alias("__dst")), "dst", how)
    return out.select(*[F.col({"src": "__src", "dst": "__dst"}.get(c, c)).alias(c) for c in edges.columns])


def node_subgraph(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` induced on ``ids(pos, id)``, nodes numbered as first seen."""
    numbered = first_seen(ids)
    return numbered, relabel(edges, numbered)


def induced_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges with both ends in ``ids(id)``, under their own ids."""
    ids = ids.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def edge_subgraph(edges: DataFrame, positions: DataFrame) -> DataFrame:
    """Edges picked by their position in ``e_id`` order, for each row of ``positions(pos, position)``."""
    return positions.join(with_position(edges, "e_id"), "position").select("pos", *edges.columns)


def frontier_subgraph(edges: dict, ids: dict[str, DataFrame], end: str) -> dict:
    """For every relation, the edges whose ``end`` lies in the ids of its type; none without ids."""
    side = 0 if end == "src" else 2
    return {k: e.join(ids[k[side]].select(F.col("id").alias(end)).distinct(), end, "left_semi") if k[side] in ids else e.limit(0) for k, e in edges.items()}


def compact(edges: DataFrame, ids: DataFrame, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(mapping, edges)`` with the ends numbered by ``ids(pos, id)``, which must hold every end."""
    numbered = first_seen(ids)
    if check:
        ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if not ends.join(numbered, "id", "left_anti").isEmpty():
            raise GraphError("an edge has an end that is not listed")
    return numbered, relabel(edges, numbered)


def to_block(edges: DataFrame, targets: DataFrame, include_targets: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(sources, targets, edges)`` of the message-flow layer into ``targets(pos, id)``.

    Sources are the targets first, if included, then the predecessors in edge order.
    """
    into = edges.join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    wanted = first_seen(targets)
    met = into.groupBy(F.col("src").alias("id")).agg(F.min("e_id").alias("pos"))
    if include_targets:
        met = met.join(wanted, "id", "left_anti").select("id", "pos", F.lit(1).alias("part"))
        own = wanted.select("id", F.col("new_id").alias("pos"), F.lit(0).alias("part"))
        met = own.unionByName(met)
    else:
        met = met.withColumn("part", F.lit(1))
    sources = with_position(met, "part", "pos", "id", name="new_id").select("id", "new_id")
    return sources, wanted, relabel(into, sources, wanted)


def to_hetero_block(edges: dict, targets: dict[str, DataFrame], include_targets: bool = True) -> tuple[dict, dict, dict]:
    """``(sources, targets, edges)`` by type for several relations; a type has one source numbering.

    Relations go in the order of their names; every relation's destination type needs targets,
    which may be empty.
    """
    if missing := sorted({k[2] for k in edges} - set(targets)):
        raise GraphError(f"no targets for the types {missing}")
    wanted = {k: first_seen(t) for k, t in targets.items()}
    into = {k: e.join(wanted[k[2]].select(F.col("id").alias("dst")), "dst", "left_semi") for k, e in edges.items()}
    sources = {}
    for kind in sorted({k[0] for k in edges} | (set(targets) if include_targets else set())):
        parts = [e.select(F.col("src").alias("id"), F.lit(i + 1).alias("part"), F.col("e_id").alias("pos")) for i, (k, e) in enumerate(sorted(into.items())) if k[0] == kind]
        if include_targets and kind in wanted:
            parts.insert(0, wanted[kind].select("id", F.lit(0).alias("part"), F.col("new_id").alias("pos")))
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        firsts = union.groupBy("id").agg(F.min(F.struct("part", "pos")).alias("at")).select("id", "at.part", "at.pos")
        sources[kind] = with_position(firsts, "part", "pos", "id", name="new_id").select("id", "new_id")
    return sources, wanted, {k: relabel(e, sources[k[0]], wanted[k[2]]) for k, e in into.items()}


def graph_pointers(nodes: DataFrame) -> DataFrame:
    """``(graph_id, n, first)``: the nodes of each graph and the number before them."""
    counts = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    return running_total(counts, "graph_id", "n", name="first").select("graph_id", "n", "first")


def union_batch(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The disjoint union of many graphs: ``nodes(graph_id, id)`` and ``edges(graph_id, src, dst)``
    shifted by the nodes of the graphs before; ids of a graph count from 0."""
    first = graph_pointers(nodes).select("graph_id", "first")
    shifted = nodes.join(first, "graph_id").withColumn("id", F.col("id") + F.col("first")).drop("first")
    moved = edges.join(first, "graph_id").withColumn("src", F.col("src") + F.col("first")).withColumn("dst", F.col("dst") + F.col("first")).drop("first")
    return shifted, moved


def typed_batch(nodes: dict[str, DataFrame], edges: dict) -> tuple[dict, dict]:
    """The disjoint union of many typed graphs: each type's ids are shifted by the nodes of that
    type in the graphs before, and a relation's ends by those of its end types.

    Tables are ``nodes[type](graph_id, id, …)`` and ``edges[relation](graph_id, src, dst, …)``; a
    graph without nodes of a type has no edge to one.
    """
    first = {k: graph_pointers(n).select("graph_id", "first") for k, n in nodes.items()}
    shifted = {k: n.join(first[k], "graph_id").withColumn("id", F.col("id") + F.col("first")).drop("first") for k, n in nodes.items()}
    moved = {}
    for (a, name, b), e in edges.items():
        ends = e.join(first[a].withColumnRenamed("first", "__a"), "graph_id").join(first[b].withColumnRenamed("first", "__b"), "graph_id")
        moved[(a, name, b)] = ends.withColumn("src", F.col("src") + F.col("__a")).withColumn("dst", F.col("dst") + F.col("__b")).drop("__a", "__b")
    return shifted, moved


def sample_batch(nodes: DataFrame, edges: DataFrame, samples: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``union_batch`` of sampled graphs, with ``samples(graph_id, seed, …)``: each record's seed,
    an id within its own graph, is shifted along; its label and names stay."""
    shifted, moved = union_batch(nodes, edges)
    first = graph_pointers(nodes).select("graph_id", "first")
    return shifted, moved, samples.join(first, "graph_id").withColumn("seed", F.col("seed") + F.col("first")).drop("first")


def without_supervision(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The edges that equal no supervised ``(src, dst)`` pair, all parallel copies gone."""
    return edges.join(pairs.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
