"""Attention of every node of a graph to every node of it, over collections of graphs.

Nodes are ``(graph_id, id, x)`` with ids of their own across graphs, edges ``(src, dst)`` within
graphs.  Pairs of nodes are never rows: a graph's nodes are cut into tiles of 64, a node meets
each tile of its graph once, and an expression over the tile gives a softmax state of each head,
its largest score, the sum and the weighted vector, which are then merged like any aggregate.  A
graph with more nodes than a bound is an error, as its work grows with the square.

A graph of one tile is a single row with its nodes and its edges in arrays, dealt once, by graph,
however many layers there are; :mod:`tessel.operators.tiles` works on batches of such rows.  Edges
may have a ``graph_id``; without one they are joined to their source's.

Distances for Graphormer come from a breadth-first search that is bit-parallel: a word has a bit
for each of 64 seeds, a tile, and a round is one bitwise aggregate over the edges.
"""

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.joins import join_back
from tessel.functions.ordering import place_within
from tessel.functions.vectors import add, bound, dot, linear, scale
from tessel.model import GraphError
from tessel.operators import tiles
from tessel.operators.attention import feed_forward, part, vector
from tessel.operators.layers import layer_norm
from tessel.operators.propagate import propagate, zeros
from tessel.plans.staging import cut, staged

#: Nodes of a tile, and of a graph at most.
TILE, MOST = 64, 65_536


def placed_nodes(nodes: DataFrame, most: int = MOST) -> DataFrame:
    """``nodes`` with ``tile`` and ``bit``, a node's place within its graph; refuses larger graphs."""
    out = staged(place_within(nodes, ["graph_id"], "id", name="__place"), "graph-nodes")
    if not out.where(F.col("__place") >= most).isEmpty():
        raise GraphError(f"a graph has more than {most} nodes")
    return out.withColumn("tile", F.floor(F.col("__place") / TILE)).withColumn("bit", (F.col("__place") % TILE).cast("int")).drop("__place")


def _state(scores: Column, values: Column, size: int) -> Column:
    """The softmax state of one head over a tile: largest score, sum, weighted vector."""

    def weighed(s: Column, top: Column) -> Column:
        return bound(F.transform(s, lambda v: F.exp(v - top)), lambda e: F.struct(top.alias("top"), F.aggregate(e, F.lit(0.0), lambda a, v: a + v).alias("sum"), _blend(e, values, size).alias("vec")))

    return bound(scores, lambda s: bound(F.array_max(s), lambda top: weighed(s, top)))


def _blend(e: Column, values: Column, size: int) -> Column:
    return F.aggregate(F.zip_with(e, values, lambda w, v: scale(v, w)), zeros(size), add)


def _head(h: int, size: int, spatial: list[list[float]] | None) -> Column:
    """One head's state of a row with ``q`` and a tile's ``bits, ks, vs`` and maybe ``near``."""
    own = part(F.col("q"), h, size)
    score = F.transform("ks", lambda k: dot(own, part(k, h, size)) / math.sqrt(size))
    if spatial is not None:
        bias = F.transform("bits", lambda b: _bias(b, F.col("near"), [row[h] for row in spatial]))
        score = F.zip_with(score, bias, lambda a, b: a + b)
    return _state(score, F.transform("vs", lambda v: part(v, h, size)), size)


def attended(placed: DataFrame, x: Column, w: dict, heads: int, masks: DataFrame | None = None, spatial: list[list[float]] | None = None) -> DataFrame:
    """``(id, m)``: the heads' attention within each graph over ``placed`` nodes, through ``out``.

    ``masks(id, tile, near)`` has for each distance from 0 the bits of a tile's nodes at it;
    ``spatial`` has for each distance, and last for all that are farther, a number for each head.
    """
    width = len(w["query"][0])
    size = width // heads
    mapped = placed.select("graph_id", "id", "tile", "bit", linear(x, *w["query"]).alias("q"), linear(x, *w["key"]).alias("k"), linear(x, *w["value"]).alias("v"))
    mapped = staged(mapped, "graph-maps")
    cells = F.array_sort(F.collect_list(F.struct("bit", "k", "v")))
    tiles = mapped.groupBy("graph_id", "tile").agg(cells.alias("cells"))  # TILE nodes
    tiles = tiles.select("graph_id", "tile", F.col("cells.bit").alias("bits"), F.col("cells.k").alias("ks"), F.col("cells.v").alias("vs"))
    met = mapped.select("graph_id", "id", "q").join(tiles, "graph_id")
    if masks is not None:
        met = met.join(masks, ["id", "tile"], "left")
    states = [_head(h, size, spatial).alias(f"s{h}") for h in range(heads)]
    found = met.select("id", *states)
    tops = found.groupBy("id").agg(*[F.max(f"s{h}.top").alias(f"t{h}") for h in range(heads)])
    scaled = join_back(found, tops, "id")
    sums = []
    for h in range(heads):
        by = F.exp(F.col(f"s{h}.top") - F.col(f"t{h}"))
        sums += [F.sum(F.col(f"s{h}.sum") * by).alias(f"n{h}"), *[F.sum(F.col(f"s{h}.vec")[i] * by).alias(f"v{h}_{i}") for i in range(size)]]
    total = scaled.groupBy("id").agg(*sums)
    merged = F.array(*[F.col(f"v{h}_{i}") / F.col(f"n{h}") for h in range(heads) for i in range(size)])
    return total.select("id", bound(merged, lambda m: linear(m, *w["out"])).alias("m"))


def _bias(bit: Column, near: Column, values: list[float]) -> Column:
    """The number of the first distance whose mask has the bit, or the last one."""
    out = F.lit(float(values[-1]))
    for d in reversed(range(len(values) - 1)):
        hit = F.call_function("getbit", F.coalesce(near[d], F.lit(0).cast("long")), bit) == 1
        out = F.when(hit, F.lit(float(values[d]))).otherwise(out)
    return out


def distances(placed: DataFrame, edges: DataFrame, most: int) -> DataFrame:
    """``(id, tile, near)``: for each distance up to ``most``, edges both ways, the bits of the tile's nodes."""
    power = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bit"))
    seen = placed.select("id", "tile", F.array(power).alias("near"))
    steps = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct()
    none = F.lit(0).cast("long")
    for d in range(1, most + 1):
        front = seen.select(F.col("id").alias("src"), "tile", F.col("near")[d - 1].alias("bits")).where("bits <> 0")
        moved = front.join(steps, "src").groupBy(F.col("dst").alias("id"), "tile").agg(F.bit_or("bits").alias("bits"))
        both = seen.join(moved, ["id", "tile"], "full").withColumn("near", F.coalesce("near", F.array(*[none] * d)))
        old = F.aggregate("near", none, lambda a, b: a.bitwiseOR(b))
        seen = cut(both.select("id", "tile", F.concat("near", F.array(F.coalesce("bits", none).bitwiseAND(F.bitwise_not(old)))).alias("near")))
    return seen


def parted(nodes: DataFrame, edges: DataFrame, most: int = MOST) -> tuple[DataFrame, tuple[DataFrame, DataFrame] | None]:
    """The graphs of one tile as rows, and the nodes and edges of all larger ones, if there are any.

    A row has ``graph_id``, ``ids`` in their order, ``xs`` and ``links``, ``(src, dst, n)`` with the number
    of parallel edges.  Refuses graphs of more than ``most`` nodes.
    """
    nodes = nodes.where("graph_id is not null")
    counts = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    largest = counts.agg(F.max("n")).first()[0] or 0
    if largest > most:
        raise GraphError(f"a graph has more than {most} nodes")
    if "graph_id" not in edges.columns:
        edges = edges.select("src", "dst").join(nodes.select(F.col("id").alias("src"), "graph_id"), "src")
    rest = None
    if largest > TILE:
        large = staged(counts.where(F.col("n") > TILE).select("graph_id"), "large-graphs")
        rest = tuple(df.join(large, "graph_id", "left_semi") for df in (nodes, edges))
        nodes, edges = (df.join(large, "graph_id", "left_anti") for df in (nodes, edges))
    cells = nodes.groupBy("graph_id").agg(F.array_sort(F.collect_list(F.struct("id", "x"))).alias("cells"))  # TILE nodes
    pairs = edges.groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("n"))
    links = pairs.groupBy("graph_id").agg(F.collect_list(F.struct("src", "dst", "n")).alias("links"))  # a tile's pairs
    return cells.join(links, "graph_id", "left").select("graph_id", F.col("cells.id").alias("ids"), F.col("cells.x").alias("xs"), "links"), rest


def _settled(df: DataFrame, more: Column, w: dict) -> DataFrame:
    one = df.select(*[c for c in ("graph_id", "id", "tile", "bit") if c in df.columns], layer_norm(add(F.col("x"), more)).alias("x"))
    return one.withColumn("x", layer_norm(add(F.col("x"), feed_forward(F.col("x"), w["up"], w["down"]))))


def gps(nodes: DataFrame, edges: DataFrame, w: dict, local, heads: int = 1, most: int = MOST) -> DataFrame:
    """A local layer ``local(nodes, edges)`` and attention within the graph, added to the node and settled."""
    rows, rest = parted(nodes, edges, most)
    near = local(nodes.select("id", "x"), edges.drop("graph_id"))
    met = tiles.over(rows.drop("links"), len(w["query"][0][0]), ["x", "m"], lambda x, links, more: [x, tiles.attended(x, w, heads)])
    if rest is not None:
        placed = placed_nodes(rest[0], most)
        met = met.unionByName(placed.join(attended(placed, F.col("x"), w, heads), "id").select("id", "x", "m"))
    return _settled(met.join(near.select("id", "h"), "id"), add(F.col("h"), F.col("m")), w).select("id", F.col("x").alias("h"))


def sgformer(nodes: DataFrame, edges: DataFrame, layers: list[dict], alpha: float = 0.5, heads: int = 1, most: int = MOST) -> DataFrame:
    """Layers of ``alpha`` times the mean of the sources' ``local`` map plus the rest of attention, through ``mix``."""
    rows, rest = parted(nodes, edges, most)

    def mixed(near: Column, m: Column, w: dict) -> Column:
        return bound(add(scale(near, F.lit(float(alpha))), scale(m, F.lit(1.0 - alpha))), lambda v: linear(v, *w["mix"]))

    def stack(x, links, more):
        for w in layers:
            near = tiles.mean(tiles.affine(x, *w["local"]), links)
            x = tiles.settled(x, tiles.affine(alpha * near + (1.0 - alpha) * tiles.attended(x, w, heads), *w["mix"]), w)
        return [x]

    found = tiles.over(rows, len(layers[0]["query"][0][0]), ["x"], stack)
    if rest is not None:
        out, edges = placed_nodes(rest[0], most), rest[1]
        for w in layers:
            near = propagate(out.select("id", linear(F.col("x"), *w["local"]).alias("x")), edges, len(w["local"][0]), "mean", "near").select("id", "near")
            far = attended(out, F.col("x"), w, heads)
            out = _settled(out.join(near, "id").join(far, "id"), mixed(F.col("near"), F.col("m"), w), w)
            out = out if w is layers[-1] else cut(out)
        found = found.unionByName(out.select("id", "x"))
    return found.select("id", F.col("x").alias("h"))


def graphormer(nodes: DataFrame, edges: DataFrame, layers: list[dict], max_distance: int, heads: int = 1, most: int = MOST) -> DataFrame:
    """Layers of attention with a vector for the capped in-degree and a number for the capped distance.

    A layer's ``degree`` has a vector for each degree, the last for all that are higher, and its
    ``spatial`` a row for each distance up to ``max_distance`` and one for the rest.
    """

    def shift(degree: Column, w: dict) -> Column:
        last = len(w["degree"]) - 1
        return reduce(lambda rest, k: F.when(degree == k, vector(w["degree"][k])).otherwise(rest), range(last), vector(w["degree"][last]))

    def stack(x, links, more):
        degree, far = (links.sum(-1) + more).astype(int), tiles.distances(links, max_distance)
        for w in layers:
            vectors, spatial = np.array(w["degree"], float), np.array(w["spatial"], float)
            hidden = x + vectors[np.minimum(degree, len(vectors) - 1)]
            x = tiles.settled(x, tiles.attended(hidden, w, heads, spatial[np.minimum(far, len(spatial) - 1)]), w)
        return [x]

    rows, rest = parted(nodes, edges, most)
    found = tiles.over(rows, len(layers[0]["query"][0][0]), ["x"], stack)
    if rest is not None:
        placed, edges = placed_nodes(rest[0], most), rest[1]
        near = staged(distances(placed, edges, max_distance), "graph-distances")
        counts = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("d"))
        out = placed.join(counts, "id", "left").withColumn("degree", F.coalesce("d", F.lit(0))).drop("d")
        for i, w in enumerate(layers):
            far = attended(out, add(F.col("x"), shift(F.col("degree"), w)), w, heads, near, w["spatial"])
            settled = _settled(out.join(far, "id"), F.col("m"), w)
            out = settled if i == len(layers) - 1 else cut(settled.join(out.select("id", "degree"), "id"))
        found = found.unionByName(out.select("id", "x"))
    return found.select("id", F.col("x").alias("h"))
