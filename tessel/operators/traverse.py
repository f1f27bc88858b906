"""Reachability, neighbourhood expansion and random walks.

Every walk, seed or query is a key in one table, so a thousand of them are one plan.  Iterative
state is checkpointed to the shared folder between rounds.  Random choices are hash draws
(:mod:`tessel.functions.hashing`), so a seed always gives the same result.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.hashing import SPAN, uniform
from tessel.functions.joins import join_back
from tessel.functions.ordering import place_within
from tessel.plans.staging import cut, staged


def _undirected(edges: DataFrame) -> DataFrame:
    ends = F.explode(F.array(F.struct(F.col("src").alias("at"), F.col("dst").alias("id")), F.struct(F.col("dst").alias("at"), F.col("src").alias("id"))))
    return edges.select(ends.alias("x")).select("x.at", "x.id").distinct()


def khop(edges: DataFrame, seeds: DataFrame, hops: int, direction: str = "out", key: str | None = None) -> DataFrame:
    """``([key], id, hop)``: nodes within so many directed hops of ``seeds([key], id)``, seeds included."""
    keys = [key] if key else []
    at, to = ("src", "dst") if direction == "out" else ("dst", "src")
    steps = edges.select(F.col(at).alias("at"), F.col(to).alias("to")).distinct()
    seen = seeds.select(*keys, "id").distinct().withColumn("hop", F.lit(0))
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1)
        met = front.select(*keys, F.col("id").alias("at")).join(steps, "at").select(*keys, F.col("to").alias("id")).distinct()
        new = met.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti").withColumn("hop", F.lit(hop))
        seen = cut(seen.unionByName(new)) if hop < hops else seen.unionByName(new)
    return seen


def expand(edges: DataFrame, seeds: DataFrame, fanouts: list[int], seed: int = 0, key: str | None = None) -> DataFrame:
    """``([key], id, hop)``: undirected expansion with a cap on each hop's whole frontier.

    A cap of -1 takes all; otherwise the new nodes with the smallest draws are kept.  The cap is
    found by a threshold join on ranks within each key.
    """
    keys = [key] if key else []
    near = cut(_undirected(edges))
    seen = seeds.select(*keys, "id").distinct().withColumn("hop", F.lit(0))
    for hop, cap in enumerate(fanouts, 1):
        front = seen.where(F.col("hop") == hop - 1)
        met = front.select(*keys, F.col("id").alias("at")).join(near, "at").select(*keys, "id").distinct()
        new = met.join(seen.select(*keys, "id"), [*keys, "id"], "left_anti")
        if cap >= 0:
            draw = uniform(seed, F.lit(hop), F.col("id"))
            if keys:
                order = W.partitionBy(*keys).orderBy("__u", "id")
                new = new.withColumn("__u", draw).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= cap).drop("__u", "__n")
            else:
                new = new.withColumn("__u", draw).orderBy("__u", "id").limit(cap).drop("__u")
        seen = cut(seen.unionByName(new.withColumn("hop", F.lit(hop))))
    return seen


def expand_typed(edges: dict, seeds: dict[str, DataFrame], fanouts: list[int], seed: int = 0) -> dict[str, DataFrame]:
    """``{type: (id, hop)}``: expansion over all relations in both directions, with a cap for each type."""
    seen = {k: s.select("id").distinct().withColumn("hop", F.lit(0)) for k, s in seeds.items()}
    for hop, cap in enumerate(fanouts, 1):
        found: dict[str, DataFrame] = {}
        for (src, _, dst), e in edges.items():
            for a, b, at, to in ((src, dst, "src", "dst"), (dst, src, "dst", "src")):
                if a in seen:
                    front = seen[a].where(F.col("hop") == hop - 1).select(F.col("id").alias(at))
                    met = e.join(front, at, "left_semi").select(F.col(to).alias("id")).distinct()
                    found[b] = found[b].unionByName(met) if b in found else met
        after = dict(seen)
        for kind, met in found.items():
            new = met.distinct()
            if kind in seen:
                new = new.join(seen[kind].select("id"), "id", "left_anti")
            if cap >= 0:
                new = new.withColumn("__u", uniform(seed, F.lit(hop), F.col("id"))).orderBy("__u", "id").limit(cap).drop("__u")
            new = new.withColumn("hop", F.lit(hop))
            after[kind] = cut(seen[kind].unionByName(new) if kind in seen else new)
        seen = after
    return seen


def neighbour_index(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(steps, degrees)``: ``steps(at, k, to)`` numbers a node's out-edges from 0 by ``(dst, e_id)``.

    A hub's edges lie in many ranges of that order; ``degrees(at, n)`` has the out-degrees.
    """
    steps = place_within(edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), "e_id"), ["at"], "to", "e_id", name="k").select("at", "k", "to")
    steps = staged(steps, "steps")
    return steps, staged(steps.groupBy("at").agg(F.count(F.lit(1)).alias("n")), "degrees")


def random_walk(steps: list[DataFrame], starts: DataFrame, seed: int = 0) -> DataFrame:
    """``(walk, step, id)`` of walks from ``starts(walk, id)`` over one edge table a step.

    Each step picks uniformly among the out-edges, parallel ones apart; after a dead end the id
    is -1.  A step is a draw of an edge's number below the degree and an equi-join on it.
    """
    indexed = {}
    front = starts.select("walk", F.col("id").alias("at"))
    trace = front.select("walk", F.lit(0).alias("step"), F.col("at").alias("id"))
    for i, edges in enumerate(steps, 1):
        if id(edges) not in indexed:
            indexed[id(edges)] = neighbour_index(edges)
        near, degree = indexed[id(edges)]
        draw = uniform(seed, F.col("walk"), F.lit(i))
        picked = join_back(front, degree, "at", how="left").select("walk", "at", (draw % F.col("n")).alias("k"))
        moved = picked.join(near, ["at", "k"], "left")
        front = cut(moved.select("walk", F.coalesce("to", F.lit(-1)).alias("at")))
        trace = trace.unionByName(front.select("walk", F.lit(i).alias("step"), F.col("at").alias("id")))
    return trace


#: Proposals of a round for each walk.
PROPOSALS = 16


def node2vec_walk(edges: DataFrame, starts: DataFrame, length: int, p: float = 1.0, q: float = 1.0, seed: int = 0) -> DataFrame:
    """``(walk, step, id)`` of second-order walks; weights 1/p back, 1 to out-neighbours of the last, 1/q else.

    By rejection: a uniform out-edge is proposed and taken with its weight over the largest one,
    so a walk at a hub looks at a few of its edges.  A round has :data:`PROPOSALS` numbered
    proposals for each walk, and the first that is taken counts; walks without one go on to the
    next round, with new numbers.  The chance of that falls by a constant factor a round.
    """
    near, degree = neighbour_index(edges)
    pairs = staged(edges.select(F.col("src").alias("prev"), F.col("dst").alias("to")).distinct(), "pairs")
    most = max(1.0 / p, 1.0, 1.0 / q)
    trace = random_walk([edges], starts, seed)
    front = cut(trace.groupBy("walk").agg(F.max(F.when(F.col("step") == 0, F.col("id"))).alias("prev"), F.max(F.when(F.col("step") == 1, F.col("id"))).alias("at")))
    for i in range(2, length + 1):
        waiting = cut(join_back(front, degree, "at"))  # walks at a dead end stay there
        moved, first = None, 0
        while moved is None or not waiting.isEmpty():
            tries = waiting.withColumn("j", F.explode(F.sequence(F.lit(first), F.lit(first + PROPOSALS - 1))))
            tries = tries.withColumn("k", uniform(seed, F.col("walk"), F.lit(i), F.col("j"), F.lit("edge")) % F.col("n"))
            met = tries.join(near, ["at", "k"]).join(pairs.withColumn("tied", F.lit(True)), ["prev", "to"], "left")
            weight = F.when(F.col("to") == F.col("prev"), 1.0 / p).when(F.col("tied").isNotNull(), 1.0).otherwise(1.0 / q)
            taken = uniform(seed, F.col("walk"), F.lit(i), F.col("j"), F.lit("take")) / F.lit(SPAN) < weight / most
            got = cut(met.where(taken).groupBy("walk").agg(F.min_by("to", "j").alias("next")))
            moved = got if moved is None else moved.unionByName(got)
            waiting = cut(waiting.join(got, "walk", "left_anti"))
            first += PROPOSALS
        front = cut(front.join(moved, "walk", "left").select("walk", F.col("at").alias("prev"), F.coalesce("next", F.lit(-1)).alias("at")))
        trace = trace.unionByName(front.select("walk", F.lit(i).alias("step"), F.col("at").alias("id")))
    return trace


def draw_rows(df: DataFrame, key: str, n: int, seed: int = 0, forced: DataFrame | None = None) -> DataFrame:
    """The ``n`` rows with the smallest draws; rows of ``forced(key)`` come first."""
    out = df.withColumn("__u", uniform(seed, F.col(key)))
    if forced is not None:
        out = out.join(forced.select(key).distinct().withColumn("__f", F.lit(0)), key, "left").withColumn("__f", F.coalesce("__f", F.lit(1)))
        return out.orderBy("__f", "__u", key).limit(n).drop("__f", "__u")
    return out.orderBy("__u", key).limit(n).drop("__u")


def clusters(nodes: DataFrame, parts: int, seed: int = 0) -> DataFrame:
    """``(id, part)``: nodes dealt at random into parts of near-equal size.

    A node's part is that of its draw among equal shares of the draws' range.
    """
    return nodes.select("id", F.floor(uniform(seed, F.col("id")) * F.lit(parts) / F.lit(SPAN)).cast("int").alias("part"))


def cluster_edges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """The edges within a part, with it; edges between parts are cut."""
    a = parts.select(F.col("id").alias("src"), "part")
    b = parts.select(F.col("id").alias("dst"), F.col("part").alias("__part"))
    return edges.join(a, "src").join(b, "dst").where("part = __part").drop("__part")
