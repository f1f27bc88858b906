"""Seeded neighbourhoods: for every request, the nodes around its seeds and the edges among them.

A request is a key in one table, so any number of them is one plan.  Its frontier is keyed by
``(request, type)`` and grows over every relation in both directions.  Each hop takes at most
so many new nodes of each type for a request, those with the smallest draws: a hash of the seed,
the hop, the request and the node, so a run can be repeated and requests draw apart.  With a
history, a request only sees edges before its own time, at every hop and in the subgraph.

The cap is a selection by threshold.  Without a history, the degrees of a request's frontier tell
under which draw enough new nodes are to be expected; only those below it leave the task that
hashes the request's lists, and a
request that gets too few is asked again without a threshold.  With a history one aggregate counts
a request's draws under falling powers of two, the rows above the first power that leaves enough
are dropped, and only the rest, about twice the cap, is ranked.  The subgraph looks edges up from their end with fewer edges, so no hub
lists its edges for each request.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.batches import gathered
from tessel.functions.draws import draws_below
from tessel.functions.hashing import uniform
from tessel.functions.joins import join_back
from tessel.model import GraphError, PropertyGraph, Relation
from tessel.operators.history import events_before
from tessel.plans.staging import cut

#: Draws are below two to this power.
DRAW_BITS = 32
#: Neighbours of a node, and requests of it, that meet in one row at most.
CHUNK, ASKERS = 4096, 256


@dataclass(frozen=True)
class History:
    """Which edges a request with a time ``t`` sees: before it, or also at it; no older than
    ``window``; of all edges of its relation, the latest ``last``."""

    strict: bool = True
    window: int | None = None
    last: int | None = None

    def __post_init__(self):
        if self.window is not None and self.window < 0:
            raise GraphError("a window can't be negative")
        if self.last is not None and self.last < 1:
            raise GraphError("the latest events kept must be 1 or more")


def smallest_draws(rows: DataFrame, keys: list[str], draw: str, ties: list[str], most: int) -> DataFrame:
    """The ``most`` rows of each key with the smallest draws, without ranking a key's other rows."""
    below = [F.count_if(F.col(draw) < F.lit(1 << (DRAW_BITS - j))).alias(f"__n{j}") for j in range(DRAW_BITS)]
    counts = rows.groupBy(*keys).agg(*below)
    enough = [F.when(F.col(f"__n{j}") >= most, F.lit(1 << (DRAW_BITS - j))) for j in reversed(range(DRAW_BITS))]
    limits = counts.select(*keys, F.coalesce(*enough, F.lit(1 << DRAW_BITS)).alias("__limit"))
    near = join_back(rows, limits, *keys).where(F.col(draw) < F.col("__limit")).drop("__limit")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(draw, *ties))
    return near.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def _reached(steps: DataFrame, front: DataFrame) -> DataFrame:
    """``(at_type, at, type, chunk, ids)``: the steps from nodes of a frontier, in chunks; dealt by their start.

    A step that comes twice is mostly left out here, and its draw later.
    """
    at = ["at_type", "at"]
    near = steps.repartition(*at).join(front.select(*at).distinct(), at, "left_semi")
    return cut(gathered(near, [*at, "type"], "id", CHUNK, "ids", "id").withColumn("chunk", F.monotonically_increasing_id()))


def _drawn(front: DataFrame, near: DataFrame, seen: DataFrame, hop: int, most: int, seed: int) -> DataFrame:
    """``(request, type, id)``: the ``most`` new nodes of each request and type with the smallest draws.

    A request and type has a limit under which about ``mean`` draws are expected, some deviations
    above what the cap and the nodes that were seen before can take.
    """
    at, key, full = ["at_type", "at", "type"], ["request", "type"], 1 << DRAW_BITS
    tasks = int(front.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    degrees = near.groupBy(*at).agg(F.sum(F.size("ids")).alias("n"))
    asked = front.join(degrees, ["at_type", "at"])
    have = seen.groupBy(*key).agg(F.count(F.lit(1)).alias("have"))
    need = F.lit(most) + F.coalesce("have", F.lit(0))
    mean = need + 4 * F.sqrt(need) + 8
    # two nodes of a frontier may share neighbours
    distinct = F.greatest(F.max("n"), F.sum("n") / 2).alias("distinct")
    limits = asked.groupBy(*key).agg(distinct).join(have, key, "left")
    limits = cut(limits.select(*key, F.least(F.lit(full), F.ceil(mean / F.col("distinct") * full)).alias("limit")))

    def taken(limits: DataFrame) -> DataFrame:
        parts = asked.drop("n").join(limits, key).repartition(*at)
        blocks = gathered(parts, at, "request", ASKERS, "askers", "request", "limit").join(near, at)
        # few bytes, much work: a number of partitions that isn't lowered by the bytes in them
        met = draws_below(blocks.repartition(tasks, "chunk", F.col("askers")[0]["request"]), seed, hop)
        new = met.distinct().join(seen.select(*key, "id"), [*key, "id"], "left_anti")
        rank = F.row_number().over(W.partitionBy(*key).orderBy("__u", "id"))
        return cut(new.withColumn("__rank", rank).where(F.col("__rank") <= most).select(*key, "id"))

    found = taken(limits)
    counts = found.groupBy(*key).agg(F.count(F.lit(1)).alias("found"))
    short = cut(limits.where(F.col("limit") < full).join(counts, key, "left").where(F.coalesce("found", F.lit(0)) < most).select(*key))
    if short.isEmpty():
        return found
    return found.join(short, key, "left_anti").unionByName(taken(short.withColumn("limit", F.lit(full))))


def _fanouts(fanouts: int | list[int]) -> list[int]:
    found = [fanouts] if isinstance(fanouts, int) else list(fanouts)
    if not found or any(f < -1 or f == 0 for f in found):
        raise GraphError("a neighbourhood needs hops, each with a positive cap or -1")
    return found


def _steps(graph: PropertyGraph, relations: list[Relation], starts: set[str] | None = None) -> DataFrame | None:
    """``(at_type, at, type, id[, t, rel, p])``: every edge from either end, or from ends of the types ``starts``; None if there are none."""
    parts = []
    timed = [graph.time] if graph.time else []
    for i, k in enumerate(relations):
        e, (a, _, b) = graph.edges[k], k
        more = [F.col(c).alias("t") for c in timed]
        for at_type, at, to_type, to in ((a, "src", b, "dst"), (b, "dst", a, "src")):
            if starts is not None and at_type not in starts:
                continue
            parts.append(e.select(F.lit(at_type).alias("at_type"), F.col(at).alias("at"), F.lit(to_type).alias("type"), F.col(to).alias("id"), F.lit(i).alias("rel"), *more, "e_id"))
    out = parts[0] if parts else None
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _seen(met: DataFrame, history: History) -> DataFrame:
    """Rows whose edge time ``t`` lies in the request's history ``(until, since)``."""
    before = F.col("t") < F.col("until") if history.strict else F.col("t") <= F.col("until")
    return met.where(before & (F.struct("t", "e_id") >= F.col("since")))


def _bounds(graph: PropertyGraph, seeds: DataFrame, relations: list[Relation], history: History) -> DataFrame:
    """``(request, until, since)``: each request's time and its earliest edge ``(t, e_id)``.

    ``last`` counts over all edges of the relation, so the earliest edge is the one that lies so
    many places before the request in the order of time.
    """
    times = seeds.groupBy("request").agg(F.max("t").alias("until"))
    first = F.struct(F.lit(-(1 << 62)).alias("t"), F.lit(-(1 << 62)).alias("e_id"))
    if history.window is not None:
        first = F.struct((F.col("until") - history.window).alias("t"), F.lit(-(1 << 62)).alias("e_id"))
    times = times.withColumn("since", first)
    if history.last is None:
        return times
    if len(relations) != 1:
        raise GraphError("the latest events are those of one relation; name it")
    asked = times.select(F.col("request").alias("q"), F.col("until").alias("t"))
    kept = events_before(graph.edges[relations[0]].withColumnRenamed(graph.time, "t").select("t", "e_id"), asked, history.last, strict=history.strict)
    # if there are fewer than ``last`` edges before a request, it sees all of them
    nth = kept.where(F.col("back") == history.last).select(F.col("q").alias("request"), F.struct("t", "e_id").alias("__nth"))
    return times.join(nth, "request", "left").select("request", "until", F.greatest("since", "__nth").alias("since"))


def neighbourhood_nodes(
    graph: PropertyGraph, seeds: DataFrame, fanouts: int | list[int], seed: int = 0, history: History | None = None, relations: list[Relation] | None = None
) -> DataFrame:
    """``(request, type, id, hop)`` around ``seeds(request, type, id[, t])``, seeds at hop 0.

    A cap of -1 takes all new nodes of a hop.  ``relations`` are those that are walked, all of
    them if not given.  A history needs a graph with a time column and seeds with ``t``.
    """
    relations = list(graph.edges) if relations is None else relations
    if history is not None:
        if graph.time is None:
            raise GraphError("a history needs a graph with a time column")
        steps, bounds = _steps(graph, relations), cut(_bounds(graph, seeds, relations, history))
    seen = seeds.select("request", "type", "id").distinct().withColumn("hop", F.lit(0))
    for hop, most in enumerate(_fanouts(fanouts), 1):
        front = seen.where(F.col("hop") == hop - 1).select("request", F.col("type").alias("at_type"), F.col("id").alias("at"))
        if history is None:
            # a row for each type: relations that no node of the frontier can walk aren't read
            steps = _steps(graph, relations, {r["at_type"] for r in front.select("at_type").distinct().collect()})
            if steps is None:
                break
            steps = steps.select("at_type", "at", "type", "id")
        if history is None and most > 0:
            new = _drawn(front, _reached(steps, front), seen, hop, most, seed)
            seen = cut(seen.unionByName(new.withColumn("hop", F.lit(hop))))
            continue
        if history is not None:
            front = front.join(bounds, "request")
        met = front.join(steps, ["at_type", "at"])
        if history is not None:
            met = _seen(met, history)
        new = met.select("request", "type", "id").distinct().join(seen.select("request", "type", "id"), ["request", "type", "id"], "left_anti")
        if most > 0:
            drawn = new.withColumn("__u", uniform(seed, F.lit(hop), F.col("request"), F.col("id")))
            new = smallest_draws(drawn, ["request", "type"], "__u", ["id"], most).drop("__u")
        seen = cut(seen.unionByName(new.withColumn("hop", F.lit(hop))))
    return seen


def numbered(nodes: DataFrame) -> DataFrame:
    """``nodes`` with ``new_id``: a request's nodes of a type numbered by id.

    The window is over one request's sample; where hops have no cap that is all it reaches.
    """
    return nodes.withColumn("new_id", (F.row_number().over(W.partitionBy("request", "type").orderBy("id")) - 1).cast("long"))


def neighbourhood_edges(graph: PropertyGraph, nodes: DataFrame, bounds: DataFrame | None = None, history: History | None = None, relations: list[Relation] | None = None) -> DataFrame:
    """``(request, relation, e_id, src, dst)``: the edges among each request's nodes, ends numbered.

    ``nodes`` has ``request, type, id, new_id``; ``relation`` is the relation's own name.
    """
    nodes = nodes.select("request", "type", "id", "new_id")
    out = None
    for relation in list(graph.edges) if relations is None else relations:
        a, name, b = relation
        more = [F.col(graph.time).alias("t")] if history is not None else []
        edges = graph.edges[relation].select("e_id", "src", "dst", *more)
        heads, tails = nodes.where(F.col("type") == a).drop("type"), nodes.where(F.col("type") == b).drop("type")
        # only edges from sampled to sampled nodes take part; each is looked up from its rarer end
        edges = edges.join(heads.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(tails.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
        n_src = edges.groupBy("src").agg(F.count(F.lit(1)).alias("__a"))
        n_dst = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("__b"))
        sided = join_back(join_back(edges, n_src, "src"), n_dst, "dst").withColumn("__by_src", F.col("__a") <= F.col("__b")).drop("__a", "__b")
        sided = cut(sided)
        for by_src, near, far, ends in ((True, "src", "dst", (heads, tails)), (False, "dst", "src", (tails, heads))):
            part = sided.where(F.col("__by_src") == by_src)
            met = part.join(ends[0].select("request", F.col("id").alias(near), F.col("new_id").alias(f"__{near}")), near)
            met = met.join(ends[1].select("request", F.col("id").alias(far), F.col("new_id").alias(f"__{far}")), ["request", far])
            if history is not None:
                met = _seen(met.join(bounds, "request"), history)
            found = met.select("request", F.lit(name).alias("relation"), "e_id", F.col("__src").alias("src"), F.col("__dst").alias("dst"))
            out = found if out is None else out.unionByName(found)
    return out


@dataclass(frozen=True)
class Neighbourhoods:
    """The sampled nodes ``(request, type, id, hop, new_id)``, the edges among them, and the
    requests' own ends in their numbering."""

    nodes: DataFrame
    edges: DataFrame
    seeds: DataFrame

    def with_features(self, features: dict[str, DataFrame]) -> dict[str, DataFrame]:
        """For each type, its sampled nodes with the columns of ``features[type](id, ...)``."""
        return {k: self.nodes.where(F.col("type") == k).join(df, "id", "left") for k, df in features.items()}

    def layers(self, hops: int) -> list[DataFrame]:
        """The edges into each layer's targets, outermost first: those into nodes within ``hops - 1 .. 0`` hops."""
        at = self.nodes.select("request", "type", F.col("new_id").alias("dst"), F.col("hop"))
        one_type = self.edges.join(at.drop("type"), ["request", "dst"])
        return [one_type.where(F.col("hop") <= k).drop("hop") for k in reversed(range(hops))]


def _sampled(graph, seeds, fanouts, seed, history=None, relations=None, without: DataFrame | None = None) -> Neighbourhoods:
    nodes = cut(numbered(neighbourhood_nodes(graph, seeds, fanouts, seed, history, relations)))
    used = list(graph.edges) if relations is None else relations
    bounds = cut(_bounds(graph, seeds, used, history)) if history is not None else None
    edges = neighbourhood_edges(graph, nodes, bounds, history, relations)
    own = nodes.select("request", "type", "id", "new_id")
    return Neighbourhoods(nodes, edges, seeds.select("request", "type", "id").join(own, ["request", "type", "id"]))


def node_neighbourhoods(graph: PropertyGraph, seeds: DataFrame, fanouts: int | list[int], seed: int = 0) -> Neighbourhoods:
    """Around ``seeds(request, type, id)``; a request may have several seeds."""
    return _sampled(graph, seeds, fanouts, seed)


def _ends(records: DataFrame, relation: Relation, *more: str) -> DataFrame:
    a, _, b = relation
    ends = F.array(F.struct(F.lit(a).alias("type"), F.col("src").alias("id")), F.struct(F.lit(b).alias("type"), F.col("dst").alias("id")))
    return records.select("request", F.explode(ends).alias("__e"), *more).select("request", "__e.type", "__e.id", *more)


def link_neighbourhoods(graph: PropertyGraph, records: DataFrame, fanouts: int | list[int], seed: int = 0, relation: Relation | None = None, without_seed_edges: bool = False) -> Neighbourhoods:
    """Around both ends of ``records(request, src, dst)``; records that share a request share a sample.

    ``without_seed_edges`` leaves every edge of the relation out of a request's subgraph that
    equals one of its records.
    """
    relation = graph.relation(relation)
    found = _sampled(graph, _ends(records, relation), fanouts, seed)
    if not without_seed_edges:
        return found
    a, name, b = relation
    ids = found.nodes.select("request", "type", "id", "new_id")
    pairs = records.select("request", "src", "dst").distinct()
    for end, kind in (("src", a), ("dst", b)):
        local = ids.where(F.col("type") == kind).select("request", F.col("id").alias(end), F.col("new_id").alias(f"__{end}"))
        pairs = pairs.join(local, ["request", end])
    pairs = pairs.select("request", F.lit(name).alias("relation"), F.col("__src").alias("src"), F.col("__dst").alias("dst"))
    return Neighbourhoods(found.nodes, found.edges.join(pairs, ["request", "relation", "src", "dst"], "left_anti"), found.seeds)


def temporal_neighbourhoods(graph: PropertyGraph, records: DataFrame, fanouts: int | list[int], seed: int = 0, relation: Relation | None = None, history: History | None = None) -> Neighbourhoods:
    """Around both ends of ``records(request, src, dst, t)`` over the relation's edges of the past."""
    relation = graph.relation(relation)
    return _sampled(graph, _ends(records, relation, "t"), fanouts, seed, history or History(), [relation])
