"""Layers of several attention heads, of typed graphs and of each node's own tokens.

As in :mod:`tessel.operators.layers`, nodes are ``(id, x)``, weights are literals and a layer
gives ``(id, h)``.  An affine map is a pair of a matrix and a bias or None; a map of several heads
has one head's rows after another's.  All heads share one pass over the edges.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.joins import join_back
from tessel.functions.vectors import add, bound, dot, gelu, linear, scale, sigmoid, vector_max
from tessel.operators.layers import Matrix, layer_norm
from tessel.operators.propagate import AGGREGATES, powers, scatter, with_both, with_source, zeros
from tessel.plans.staging import cut

Affine = tuple[Matrix, list[float] | None]


def part(x: Column, head: int, size: int) -> Column:
    """One head's entries of a vector."""
    return F.slice(x, head * size + 1, size)


def vector(values: list[float]) -> Column:
    """A literal vector."""
    return F.lit([float(v) for v in values])


def mixed(vectors: list[Column], scores: list[Column]) -> Column:
    """The sum of some vectors of one row, weighted by the softmax of as many numbers."""

    def weigh(s: Column) -> Column:
        return bound(F.array_max(s), lambda top: F.transform(s, lambda v: F.exp(v - top)))

    def share(e: Column) -> Column:
        return bound(F.aggregate(e, F.lit(0.0), lambda a, v: a + v), lambda total: F.transform(e, lambda v: v / total))

    by = bound(bound(F.array(*scores), weigh), share)
    return bound(by, lambda w: blend(vectors, [w[i] for i in range(len(vectors))]))


def blend(vectors: list[Column], by: list[Column]) -> Column:
    """The weighted sum of some vectors of one row."""
    return reduce(add, [scale(v, w) for v, w in zip(vectors, by, strict=True)])


def attend_heads(met: DataFrame, scores: list[Column], values: list[Column], nodes: DataFrame, size: int) -> DataFrame:
    """``nodes`` with each head's softmax-weighted sum of its values, one head after another."""
    heads = len(scores)
    rows = met.select("dst", F.array(*scores).alias("__s"), F.concat(*values).alias("__v"))
    top = rows.groupBy("dst").agg(vector_max(F.col("__s"), heads).alias("__top"))
    e = [F.exp(F.col("__s")[h] - F.col("__top")[h]) for h in range(heads)]
    weighed = [scale(part(F.col("__v"), h, size), e[h]) for h in range(heads)]
    out = scatter(join_back(rows, top, "dst"), F.concat(*weighed, F.array(*e)), nodes, heads * (size + 1))
    least = F.lit(1e-12)
    return out.withColumn("m", F.concat(*[scale(part(F.col("m"), h, size), 1 / F.greatest(F.col("m")[heads * size + h], least)) for h in range(heads)]))


def merged(m: Column, heads: int, size: int, concat: bool) -> Column:
    """The heads as they are, or their mean."""
    return m if concat else scale(reduce(add, [part(m, h, size) for h in range(heads)]), F.lit(1 / heads))


def transformer(nodes, edges, query: Affine, key: Affine, value: Affine, heads=1, concat=True, root: Affine | None = None, beta: Affine | None = None):
    """Scaled dot-product attention over in-edges; ``beta`` gates between the root map and what arrives."""
    size = len(query[0]) // heads
    mapped = nodes.select("id", "x", linear(F.col("x"), *query).alias("q"), F.concat(linear(F.col("x"), *key), linear(F.col("x"), *value)).alias("kv"))
    met = edges.select("src", "dst").join(mapped.select(F.col("id").alias("src"), "kv"), "src").join(mapped.select(F.col("id").alias("dst"), "q"), "dst")
    scores = [dot(part(F.col("q"), h, size), part(F.col("kv"), h, size)) / math.sqrt(size) for h in range(heads)]
    values = [part(F.col("kv"), heads + h, size) for h in range(heads)]
    out = attend_heads(met, scores, values, nodes.select("id", "x"), size).withColumn("m", merged(F.col("m"), heads, size, concat))
    if root is None:
        return out.select("id", F.col("m").alias("h"))
    out = out.withColumn("r", linear(F.col("x"), *root))
    if beta is None:
        return out.select("id", add(F.col("m"), F.col("r")).alias("h"))
    gate = bound(F.concat("m", "r", F.zip_with("r", "m", lambda a, b: a - b)), lambda v: linear(v, *beta))
    out = out.withColumn("g", F.transform(gate, sigmoid))
    kept = F.zip_with(F.zip_with("g", "r", lambda g, r: g * r), F.zip_with("g", "m", lambda g, m: (1 - g) * m), lambda a, b: a + b)
    return out.select("id", kept.alias("h"))


def gatv2(nodes, edges, source: Matrix, target: Matrix, attention: Matrix, heads=1, concat=True):
    """Attention by a . tanh(W source + W destination), a row of ``attention`` for each head."""
    size = len(source) // heads
    met = with_both(edges.select("src", "dst"), nodes)
    met = met.select("dst", linear(F.col("xs"), source).alias("s"), linear(F.col("xd"), target).alias("d"))
    both = F.transform(add(F.col("s"), F.col("d")), F.tanh)
    out = attend_heads(met, [dot(part(both, h, size), vector(attention[h])) for h in range(heads)], [part(F.col("s"), h, size) for h in range(heads)], nodes.select("id"), size)
    return out.select("id", merged(F.col("m"), heads, size, concat).alias("h"))


def feed_forward(x: Column, up: Affine, down: Affine) -> Column:
    """Two affine maps with GELU between."""
    return bound(F.transform(linear(x, *up), gelu), lambda v: linear(v, *down))


def _settled(df: DataFrame, more: Column, w: dict) -> DataFrame:
    """``(id, x)``: a residual and a layer norm around ``more``, then around the feed-forward network."""
    one = df.select("id", layer_norm(add(F.col("x"), more)).alias("x"))
    return one.select("id", layer_norm(add(F.col("x"), feed_forward(F.col("x"), w["up"], w["down"]))).alias("x"))


def encoder(nodes, edges, layers: list[dict], heads=1):
    """Layers of attention (heads averaged, root, gate if given) and a feed-forward network."""
    out = nodes.select("id", "x")
    for w in layers:
        attended = transformer(out, edges, w["query"], w["key"], w["value"], heads, False, w["root"], w.get("beta"))
        out = step(_settled(out.join(attended, "id"), F.col("h"), w), w is layers[-1])
    return out.withColumnRenamed("x", "h")


def step(out: DataFrame, last: bool) -> DataFrame:
    """A layer's nodes, checkpointed unless they are the result: a layer names its input several
    times, and without the cut a plan would grow as the power of its layers."""
    return out if last else cut(out)


def heat(nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], weights: dict, size: int, heads=1, attr="attr") -> dict[str, DataFrame]:
    """Additive attention of typed nodes and relations; ``(id, h)`` for each node type.

    A head's score is ``attention`` . tanh of the query and key, each with its type's vector, the
    relation's vector and the edge's map, end to end; a message is the value plus the relation's
    vector and the edge's map.  ``weights`` has, by node type, ``query key value type output`` and
    maybe ``root``; by relation, ``relation``; for all, ``attention`` and maybe ``edge``.
    """
    width = heads * size
    out = {t: n.select("id", "x", zeros(width).alias("sum")) for t, n in nodes.items()}
    for name, rel in edges.items():
        a, _, b = name
        bias = vector(weights["relation"][name])
        met = with_source(rel, nodes[a]).join(nodes[b].select(F.col("id").alias("dst"), F.col("x").alias("xd")), "dst")
        of = linear(F.col(attr), weights["edge"]) if weights.get("edge") else zeros(width)
        met = met.select(
            "dst",
            add(linear(F.col("xd"), weights["query"][b]), vector(weights["type"][b])).alias("q"),
            add(linear(F.col("xs"), weights["key"][a]), vector(weights["type"][a])).alias("k"),
            linear(F.col("xs"), weights["value"][a]).alias("v"),
            of.alias("e"),
        )
        four = (F.col("q"), F.col("k"), bias, F.col("e"))
        scores = [dot(F.transform(F.concat(*[part(c, h, size) for c in four]), F.tanh), vector(weights["attention"])) for h in range(heads)]
        message = add(add(F.col("v"), bias), F.col("e"))
        got = attend_heads(met, scores, [part(message, h, size) for h in range(heads)], nodes[b].select("id"), size)
        out[b] = out[b].join(got, "id").select("id", "x", add(F.col("sum"), F.col("m")).alias("sum"))
    last = {}
    for t, df in out.items():
        h = linear(F.col("sum"), *weights["output"][t])
        last[t] = df.select("id", (add(h, linear(F.col("x"), weights["root"][t])) if weights.get("root") else h).alias("h"))
    return last


def rgat(nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], weights: dict, size: int, heads=1, attr="attr") -> dict[str, DataFrame]:
    """Dot attention of typed nodes within each relation; ``(id, h)`` for each node type.

    ``weights`` has, by node type, ``query``, ``output`` (affine) and maybe ``root``; by relation,
    ``key`` and ``value``, maps of the source, and maybe ``edge``, a map of the edge's vector that
    both are shifted by.  What arrives is summed over relations before the output map.
    """
    width = heads * size
    out = {t: n.select("id", "x", zeros(width).alias("sum")) for t, n in nodes.items()}
    for name, rel in edges.items():
        a, _, b = name
        met = with_source(rel, nodes[a]).join(nodes[b].select(F.col("id").alias("dst"), linear(F.col("x"), weights["query"][b]).alias("q")), "dst")
        shift = linear(F.col(attr), weights["edge"][name]) if weights.get("edge") else zeros(width)
        met = met.select("dst", "q", linear(F.col("xs"), weights["key"][name]).alias("k"), linear(F.col("xs"), weights["value"][name]).alias("v"), shift.alias("e"))
        met = met.select("dst", "q", add(F.col("k"), F.col("e")).alias("k"), add(F.col("v"), F.col("e")).alias("v"))
        scores = [dot(part(F.col("q"), h, size), part(F.col("k"), h, size)) / math.sqrt(size) for h in range(heads)]
        got = attend_heads(met, scores, [part(F.col("v"), h, size) for h in range(heads)], nodes[b].select("id"), size)
        out[b] = out[b].join(got, "id").select("id", "x", add(F.col("sum"), F.col("m")).alias("sum"))
    last = {}
    for t, df in out.items():
        h = linear(F.col("sum"), *weights["output"][t])
        last[t] = df.select("id", (add(h, linear(F.col("x"), weights["root"][t])) if weights.get("root") else h).alias("h"))
    return last


def _product(a: Matrix, b: Matrix) -> Matrix:
    return [[sum(x * y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)] for row in a]


def hgt(nodes: dict[str, DataFrame], edges: dict[tuple[str, str, str], DataFrame], weights: dict, size: int, heads=1) -> dict[str, DataFrame]:
    """``rgat`` whose keys and values are maps by node type, then by relation (``relation_key`` and
    ``relation_value``); the two maps of a relation are multiplied beforehand."""
    of = {m: {k: _product(weights[f"relation_{m}"][k], weights[m][k[0]]) for k in edges} for m in ("key", "value")}
    return rgat(nodes, edges, {**weights, **of, "edge": None}, size, heads)


def supergat(nodes, edges, weight: Matrix, left: Matrix, right: Matrix, heads=1, concat=True, kind="MX", slope=0.2, loops=True, bias: list[float] | None = None):
    """Attention by a leaky additive score (``MX``) or the scaled dot product (``SD``) of mapped ends.

    ``left`` and ``right`` have a row for each head; with ``loops``, self-loops are renewed.
    """
    size = len(weight) // heads
    plain = edges.select("src", "dst")
    if loops:
        plain = plain.where("src <> dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))
    mapped = nodes.select("id", linear(F.col("x"), weight).alias("x"))
    met = with_both(plain, mapped)
    scores = []
    for h in range(heads):
        s, d = part(F.col("xs"), h, size), part(F.col("xd"), h, size)
        raw = dot(s, vector(left[h])) + dot(d, vector(right[h])) if kind == "MX" else dot(s, d) / math.sqrt(size)
        scores.append(F.greatest(raw, slope * raw) if kind == "MX" else raw)
    out = attend_heads(met, scores, [part(F.col("xs"), h, size) for h in range(heads)], nodes.select("id"), size)
    h = merged(F.col("m"), heads, size, concat)
    return out.select("id", (add(h, vector(bias)) if bias else h).alias("h"))


def general(nodes, edges, message: Affine, root: Affine | None = None, how="sum", attention: Matrix | None = None, heads=1, directed=True, l2_normalize=False):
    """The aggregate of a map of both ends (``directed``) or of the source, weighed by each head's
    softmax if there is ``attention``, plus the root map or the node itself, normed if wanted."""
    width = len(message[0])
    size = width // heads
    met = with_both(edges.select("src", "dst"), nodes)
    ends = F.concat("xs", "xd") if directed else F.col("xs")
    rows = met.select("dst", linear(ends, *message).alias("v"), (linear(ends, attention) if attention else zeros(heads)).alias("s"))
    if attention is None:
        out = scatter(rows, F.col("v"), nodes.select("id", "x"), width, how)
    elif how == "max":
        top = rows.groupBy("dst").agg(vector_max(F.col("s"), heads).alias("__top"))
        rows = join_back(rows, top, "dst").withColumn("e", F.zip_with("s", "__top", lambda a, b: F.exp(a - b)))
        total = rows.groupBy("dst").agg(AGGREGATES["sum"](F.col("e"), heads).alias("__sum"))
        rows = join_back(rows, total, "dst")
        weighed = F.concat(*[scale(part(F.col("v"), h, size), F.col("e")[h] / F.col("__sum")[h]) for h in range(heads)])
        out = scatter(rows, weighed, nodes.select("id", "x"), width, "max")
    else:  # weights of a head sum to 1, so the mean over them is the sum
        out = attend_heads(rows, [F.col("s")[h] for h in range(heads)], [part(F.col("v"), h, size) for h in range(heads)], nodes.select("id", "x"), size)
    h = add(F.col("m"), linear(F.col("x"), *root) if root else F.col("x"))
    if l2_normalize:
        h = bound(h, lambda v: scale(v, 1 / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12))))
    return out.select("id", h.alias("h"))


def dna(nodes, edges, history: list[str], query: Affine, key: Affine, value: Affine, out: Affine, heads=1):
    """Attention to every step of the source's history, then over in-edges by the best step's score.

    ``history`` names the columns of a node's vectors, the current one last.
    """
    size = len(query[0]) // heads
    now, n = F.col(history[-1]), range(len(history))
    tokens = nodes.select(F.col("id").alias("src"), *[linear(F.col(c), *key).alias(f"k{i}") for i, c in enumerate(history)], *[linear(F.col(c), *value).alias(f"v{i}") for i, c in enumerate(history)])
    met = edges.select("src", "dst").join(tokens, "src").join(nodes.select(F.col("id").alias("dst"), linear(now, *query).alias("q")), "dst")
    met = met.select("*", *[(dot(part(F.col("q"), h, size), part(F.col(f"k{i}"), h, size)) / math.sqrt(size)).alias(f"s{h}_{i}") for h in range(heads) for i in n])
    own = [[F.col(f"s{h}_{i}") for i in n] for h in range(heads)]
    best = [F.greatest(*s) if len(s) > 1 else s[0] for s in own]
    values = [mixed([part(F.col(f"v{i}"), h, size) for i in n], own[h]) for h in range(heads)]
    moved = attend_heads(met, best, values, nodes.select("id", now.alias("x")), size)
    return moved.select("id", add(linear(F.col("m"), *out), F.col("x")).alias("h"))


def spline(nodes, edges, weights: list[Matrix], kernel: tuple[int, ...], root: Affine | None = None, pseudo="pseudo", how="mean"):
    """The aggregate of the source's maps weighted by linear B-splines of the edge's coordinates, plus root.

    ``weights`` has a map for each knot of the grid, the last coordinate's running fastest.
    """
    basis = [F.lit(1.0)]
    for i, k in enumerate(kernel):
        u = F.least(F.greatest(F.col(pseudo)[i], F.lit(0.0)), F.lit(1.0))
        hats = [F.greatest(1 - F.abs(u - j / (k - 1)) * (k - 1), F.lit(0.0)) for j in range(k)] if k > 1 else [F.lit(1.0)]
        basis = [a * b for a in basis for b in hats]
    met = with_source(edges.select("src", "dst", pseudo), nodes)
    message = blend([linear(F.col("xs"), w) for w in weights], basis)
    out = scatter(met, message, nodes.select("id", "x"), len(weights[0]), how)
    return out.select("id", (add(F.col("m"), linear(F.col("x"), *root)) if root else F.col("m")).alias("h"))


def hop_encoder(nodes, edges, width: int, places: Matrix, layers: list[dict], heads=1):
    """A transformer over each node's own symmetric rounds, one token for each, pooled by the mean.

    ``places`` has a vector for each round, which tells how many there are; a layer has affine
    maps ``query key value out up down``.  Only the rounds need the edges.
    """
    names, size = [f"p{k}" for k in range(len(places))], width // heads
    out = powers(nodes, edges, width, len(places) - 1)
    out = out.select("id", "x", *[add(F.col(c), vector(p)).alias(c) for c, p in zip(names, places, strict=True)])
    for w in layers:
        out = out.select("*", *[linear(F.col(c), *w[m]).alias(f"{c}_{m}") for c in names for m in ("query", "key", "value")])
        seen = []
        for c in names:
            own = []
            for h in range(heads):
                scores = [dot(part(F.col(f"{c}_query"), h, size), part(F.col(f"{d}_key"), h, size)) / math.sqrt(size) for d in names]
                own.append(mixed([part(F.col(f"{d}_value"), h, size) for d in names], scores))
            seen.append(layer_norm(add(F.col(c), bound(F.concat(*own), lambda v: linear(v, *w["out"])))).alias(c))
        out = out.select("id", "x", *seen)
        out = step(out.select("id", "x", *[layer_norm(add(F.col(c), feed_forward(F.col(c), w["up"], w["down"]))).alias(c) for c in names]), w is layers[-1])
    mean = scale(reduce(add, [F.col(c) for c in names]), F.lit(1 / len(names)))
    return out.select("id", layer_norm(add(mean, F.col("x"))).alias("h"))


def group_reversible(nodes, edges, width: int, chosen: list):
    """Groups of entries, each plus a layer of the running one: the first runs on the others' sum.

    ``chosen`` has a layer ``f(nodes, edges)`` for each group; ``group_inverse`` undoes it.
    """
    n = len(chosen)
    size = width // n
    groups = [part(F.col("x"), g, size) for g in range(n)]
    out = nodes.select("id", "x", reduce(add, groups[1:]).alias("y"))
    ys = []
    for g, layer in enumerate(chosen):
        moved = layer(out.select("id", F.col("y").alias("x")), edges).withColumnRenamed("h", "__h")
        out = step(out.join(moved, "id").withColumn("y", add(groups[g], F.col("__h"))).withColumn(f"y{g}", F.col("y")).drop("__h"), g == n - 1)
        ys.append(f"y{g}")
    return out.select("id", F.concat(*ys).alias("h"))


def group_inverse(nodes, edges, width: int, chosen: list):
    """The vectors that ``group_reversible`` made into ``x``."""
    n = len(chosen)
    size = width // n
    out = nodes.select("id", "x")
    for g in reversed(range(n)):
        running = part(F.col("x"), g - 1, size) if g else reduce(add, [F.col(f"x{i}") for i in range(1, n)])
        moved = chosen[g](out.select("id", running.alias("x")), edges).withColumnRenamed("h", "__h")
        out = step(out.join(moved, "id").withColumn(f"x{g}", F.zip_with(part(F.col("x"), g, size), "__h", lambda a, b: a - b)).drop("__h"), g == 0)
    return out.select("id", F.concat(*[f"x{g}" for g in range(n)]).alias("h"))


def tgat(nodes, edges, query: Matrix, key: Matrix, value: Matrix, time: Matrix, frequency: list[float], phase: list[float], out: Affine, root: Matrix | None = None, heads=1, now: Column | str = "now"):
    """Attention over in-edges whose keys and values are shifted by a map of the encoded age.

    Edges have ``t``, and ``now`` is the time each is asked about, both as plain numbers.
    """
    from tessel.operators.temporal import time_encode

    size = len(query) // heads
    age = (F.col(now) if isinstance(now, str) else now) - F.col("t")
    aged = edges.select("src", "dst", bound(time_encode(age, frequency, phase), lambda c: linear(c, time)).alias("shift"))
    met = with_both(aged, nodes)
    met = met.select("dst", linear(F.col("xd"), query).alias("q"), add(linear(F.col("xs"), key), F.col("shift")).alias("k"), add(linear(F.col("xs"), value), F.col("shift")).alias("v"))
    scores = [dot(part(F.col("q"), h, size), part(F.col("k"), h, size)) / math.sqrt(size) for h in range(heads)]
    got = attend_heads(met, scores, [part(F.col("v"), h, size) for h in range(heads)], nodes.select("id", "x"), size)
    h = bound(F.col("m"), lambda m: linear(m, *out))
    return got.select("id", (add(h, linear(F.col("x"), root)) if root else h).alias("h"))


def tgat_encoder(nodes, edges, layers: list[dict], heads=1, now: Column | str = "now"):
    """Layers of ``tgat`` and a feed-forward network, each with a residual and a layer norm."""
    out = nodes.select("id", "x")
    for w in layers:
        moved = tgat(out, edges, *[w[k] for k in ("query", "key", "value", "time", "frequency", "phase", "output")], w.get("root"), heads, now)
        out = step(_settled(out.join(moved, "id"), F.col("h"), w), w is layers[-1])
    return out.withColumnRenamed("x", "h")
