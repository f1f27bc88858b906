"""Message-passing layers with explicit weights.

Each takes nodes ``(id, x)`` and edges, and returns ``(id, h)``.  A weight matrix is a list of
rows, one for each output.  Every layer is a composition of the rounds in
:mod:`tessel.operators.propagate`; weights are literals in the plan.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessel.functions.joins import join_back
from tessel.functions.vectors import add, bound, dot, gelu, linear, relu, scale, sigmoid, softplus
from tessel.operators.propagate import AGGREGATES, powers, propagate, scatter, with_both, with_source, zeros
from tessel.operators.sparse import softmax_by

Matrix = list[list[float]]


def _out(df: DataFrame, h: Column) -> DataFrame:
    return df.select("id", h.alias("h"))


def _mix(columns: list[Column], shares: list[float]) -> Column:
    total = scale(columns[0], F.lit(float(shares[0])))
    for c, s in zip(columns[1:], shares[1:], strict=True):
        total = add(total, scale(c, F.lit(float(s))))
    return total


def _steps(k: int) -> list[Column]:
    return [F.col(f"p{i}") for i in range(k + 1)]


def simple(nodes, edges, width, how="mean"):
    """The plain aggregate."""
    return _out(propagate(nodes, edges, width, how), F.col("m"))


def gcn(nodes, edges, width, weight: Matrix, bias=None):
    """L(sum); the plain attention layer without attention is the same."""
    return _out(propagate(nodes, edges, width), linear(F.col("m"), weight, bias))


gat = gcn


def sage(nodes, edges, width, weight: Matrix, bias=None):
    """L(own, sum)."""
    return _out(propagate(nodes, edges, width), linear(F.concat("x", "m"), weight, bias))


def gin(nodes, edges, width, layers: list[tuple], eps=0.0):
    """A ReLU network of (1 + eps) x + sum."""
    return _out(propagate(nodes, edges, width), mlp(add(scale(F.col("x"), F.lit(1.0 + eps)), F.col("m")), layers))


def mlp(x: Column, layers: list[tuple]) -> Column:
    """Affine maps with ReLU between."""
    for i, (weight, bias) in enumerate(layers):
        x = linear(x, weight, bias)
        if i + 1 < len(layers):
            x = relu(x)
    return x


def gine(nodes, edges, width, edge_weight: Matrix, layers: list[tuple], eps=0.0, attr="attr"):
    """As gin over ReLU(source + L(edge))."""
    met = with_source(edges, nodes)
    sent = scatter(met, relu(add(F.col("xs"), linear(F.col(attr), edge_weight))), nodes, width)
    return _out(sent, mlp(add(scale(F.col("x"), F.lit(1.0 + eps)), F.col("m")), layers))


def graph_conv(nodes, edges, width, weight: Matrix, root: Matrix):
    """L1(sum) + L2(own)."""
    return _out(propagate(nodes, edges, width), add(linear(F.col("m"), weight), linear(F.col("x"), root)))


def lg(nodes, edges, width, normalize=True):
    """The symmetric round, or the plain sum."""
    return _out(propagate(nodes, edges, width, "sym" if normalize else "sum"), F.col("m"))


def wl(nodes, edges, width):
    """Half of own and mean."""
    return _out(propagate(nodes, edges, width, "mean"), scale(add(F.col("x"), F.col("m")), F.lit(0.5)))


def sg(nodes, edges, width, weight: Matrix, k=1):
    """L of the k-th mean round."""
    return _out(powers(nodes, edges, width, k, "mean"), linear(F.col(f"p{k}"), weight))


def ssg(nodes, edges, width, steps=10, alpha=0.1):
    """Own mixed with the mean of the symmetric rounds."""
    return _out(powers(nodes, edges, width, steps), _mix(_steps(steps), [alpha] + [(1 - alpha) / steps] * steps))


def tag(nodes, edges, width, weight: Matrix, k=2):
    """L of all mean rounds."""
    return _out(powers(nodes, edges, width, k, "mean"), linear(F.concat(*_steps(k)), weight))


def cheb(nodes, edges, width, weight: Matrix, k=2):
    """L of the Chebyshev terms of the mean round."""
    terms = [nodes.withColumn("t0", F.col("x"))]
    out = terms[0]
    for i in range(1, k + 1):
        moved = propagate(out.select("id", F.col(f"t{i - 1}").alias("x")), edges, width, "mean").select("id", "m")
        out = out.join(moved, "id")
        term = F.col("m") if i == 1 else F.zip_with("m", f"t{i - 2}", lambda a, b: 2 * a - b)
        out = out.withColumn(f"t{i}", term).drop("m")
    return _out(out, linear(F.concat(*[F.col(f"t{i}") for i in range(k + 1)]), weight))


def appnp(nodes, edges, width, weight: Matrix, steps=10, alpha=0.1):
    """Personalised rounds of the plain sum after L."""
    first = nodes.select("id", linear(F.col("x"), weight).alias("x"))
    out, size = first.withColumn("x0", F.col("x")), len(weight)
    for _ in range(steps):
        out = propagate(out, edges, size).withColumn("x", _mix([F.col("m"), F.col("x0")], [1 - alpha, alpha])).drop("m")
    return _out(out, F.col("x"))


def gpr(nodes, edges, width, steps=10, alpha=0.1, gamma=None):
    """Symmetric rounds under given or geometric shares."""
    gamma = gamma or [alpha * (1 - alpha) ** k for k in range(steps)] + [(1 - alpha) ** steps]
    return _out(powers(nodes, edges, width, steps), _mix(_steps(steps), gamma))


def bern(nodes, edges, width, steps=3):
    """Symmetric rounds under binomial shares."""
    return _out(powers(nodes, edges, width, steps), _mix(_steps(steps), [math.comb(steps, k) / 2**steps for k in range(steps + 1)]))


def arma(nodes, edges, width, layers=2, alpha=0.1):
    """Repeated (1 - alpha) round + alpha own, one stack."""
    out = nodes.withColumn("x0", F.col("x"))
    for _ in range(layers):
        out = propagate(out, edges, width, "sym").withColumn("x", _mix([F.col("m"), F.col("x0")], [1 - alpha, alpha])).drop("m")
    return _out(out, F.col("x"))


def dagnn(nodes, edges, width, gate: list[float], steps=3):
    """Each node's softmax over the rounds by a gate."""
    out = powers(nodes, edges, width, steps)
    scores = F.array(*[dot(c, F.lit([float(g) for g in gate])) for c in _steps(steps)])
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    mixed = scale(F.col("p0"), e[0] / total)
    for k in range(1, steps + 1):
        mixed = add(mixed, scale(F.col(f"p{k}"), e[k] / total))
    return _out(out, mixed)


def mixhop(nodes, edges, width, weight: Matrix, hops=(0, 1, 2)):
    """L of chosen symmetric rounds."""
    return _out(powers(nodes, edges, width, max(hops)), linear(F.concat(*[F.col(f"p{k}") for k in hops]), weight))


def h2gcn(nodes, edges, width, weight: Matrix):
    """L of own, mean and the mean's mean."""
    return tag(nodes, edges, width, weight, 2)


def cluster_gcn(nodes, edges, width, weight: Matrix, root: Matrix, diagonal=0.0):
    """L1(mean) + L2((1 + diagonal) own)."""
    return _out(propagate(nodes, edges, width, "mean"), add(linear(F.col("m"), weight), linear(scale(F.col("x"), F.lit(1.0 + diagonal)), root)))


def gcn2(nodes, edges, width, weight: Matrix, alpha=0.1, theta=1.0, layer=1):
    """Initial residual and identity map around the symmetric round; the initial vector is ``x``."""
    beta = math.log(theta / layer + 1)
    mixed = _mix([F.col("m"), F.col("x")], [1 - alpha, alpha])
    out = propagate(nodes, edges, width, "sym").withColumn("s", mixed)
    return _out(out, _mix([F.col("s"), linear(F.col("s"), weight)], [1 - beta, beta]))


def antisymmetric(nodes, edges, width, weight: Matrix, rounds=1, epsilon=0.1, gamma=0.1, bias=None):
    """x + epsilon tanh(x (W - W' - gamma I) + round + b)."""
    skew = [[weight[j][i] - weight[i][j] - (gamma if i == j else 0.0) for j in range(width)] for i in range(width)]
    out = nodes
    for _ in range(rounds):
        moved = propagate(out, edges, width, "sym")
        step = F.transform(add(linear(F.col("x"), skew, bias), F.col("m")), lambda v: F.tanh(v) * epsilon)
        out = moved.withColumn("x", add(F.col("x"), step)).drop("m")
    return _out(out, F.col("x"))


def twirls(nodes, edges, width, before: Matrix, after: Matrix, steps=4, alpha=0.5, lam=1.0):
    """Unfolded smoothing between two affine maps."""
    out, size = nodes.select("id", linear(F.col("x"), before).alias("x")), len(before)
    out = out.withColumn("x0", F.col("x"))
    for _ in range(steps):
        smooth = _mix([F.col("m"), F.col("x"), F.col("x0")], [(1 - alpha) * lam, (1 - alpha) * (1 - lam), alpha])
        out = propagate(out, edges, size, "sym").withColumn("x", smooth).drop("m")
    return _out(out, linear(F.col("x"), after))


def gru(x: Column, h: Column, w: dict, size: int) -> Column:
    """One step of a gated recurrent unit: ``w`` has ``ir iz in hr hz hn`` and biases with ``b`` before."""

    def part(name: str, v: Column) -> Column:
        return linear(v, w[name], w.get("b" + name))

    r = F.transform(add(part("ir", x), part("hr", h)), sigmoid)
    z = F.transform(add(part("iz", x), part("hz", h)), sigmoid)
    n = F.transform(add(part("in", x), F.zip_with(r, part("hn", h), lambda a, b: a * b)), F.tanh)
    return F.zip_with(F.zip_with(z, n, lambda g, v: (1 - g) * v), F.zip_with(z, h, lambda g, v: g * v), lambda a, b: a + b)


def gated_graph(nodes, edges, width, weight: Matrix, cell: dict, steps=3):
    """GRU of the sum of L(source)."""
    out = nodes
    for _ in range(steps):
        moved = propagate(out.withColumn("x", linear(F.col("x"), weight)), edges, width).select("id", "m")
        out = out.join(moved, "id").withColumn("x", gru(F.col("m"), F.col("x"), cell, width)).drop("m")
    return _out(out, F.col("x"))


def mfconv(nodes, edges, width, weights: list[Matrix], roots: list[Matrix]):
    """Weights chosen by the capped in-degree, on mean and own."""
    degree = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    out = propagate(nodes, edges, width, "mean").join(degree, "id", "left")
    d = F.least(F.coalesce("d", F.lit(0)), F.lit(len(weights) - 1))
    h = add(linear(F.col("m"), weights[-1]), linear(F.col("x"), roots[-1]))
    for i in range(len(weights) - 1):
        h = F.when(d == i, add(linear(F.col("m"), weights[i]), linear(F.col("x"), roots[i]))).otherwise(h)
    return _out(out, h)


def multi(nodes, edges, width, aggregators=("sum", "mean", "max")):
    """``nodes`` with one column for each aggregate, from a single pass over the edges."""
    met = with_source(edges.select("src", "dst"), nodes)
    parts = met.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("d"), *[AGGREGATES[a](F.col("xs"), width).alias(a) for a in aggregators])
    out = nodes.join(parts, "id", "left").withColumn("d", F.coalesce("d", F.lit(0)).cast("double"))
    return out.withColumns({a: F.coalesce(a, zeros(width)) for a in aggregators})


def pna(nodes, edges, width, weight: Matrix, root: Matrix, delta: float, aggregators=("sum", "mean", "max"), scalers=("identity", "amplification", "attenuation")):
    """L of every aggregate under every degree scaler, plus L(own); ``delta`` is the reference log degree."""
    logd = F.log1p(F.greatest(F.col("d"), F.lit(1.0)))
    by = {"identity": F.lit(1.0), "amplification": logd / delta, "attenuation": F.lit(delta) / logd}
    parts = [scale(F.col(a), by[s]) for s in scalers for a in aggregators]
    return _out(multi(nodes, edges, width, aggregators), add(linear(F.concat(*parts), weight), linear(F.col("x"), root)))


def degree_reference(histogram: list[int]) -> float:
    """The mean log(1 + d) of a degree histogram, counting degree i at place i - 1, at least 1."""
    total = sum(histogram)
    return max(sum(n * math.log1p(i + 1) for i, n in enumerate(histogram)) / max(total, 1), 1.0)


def egconv(nodes, edges, width, weight: Matrix, aggregators=("sum", "mean", "max")):
    """L of several aggregates."""
    return _out(multi(nodes, edges, width, aggregators), linear(F.concat(*aggregators), weight))


def leconv(nodes, edges, width, source: Matrix, target: Matrix, root: Matrix):
    """L3(own) + sum of L1(source) - L2(destination)."""
    met = with_both(edges.select("src", "dst"), nodes)
    message = F.zip_with(linear(F.col("xs"), source), linear(F.col("xd"), target), lambda a, b: a - b)
    return _out(scatter(met, message, nodes, len(source)), add(linear(F.col("x"), root), F.col("m")))


def film(nodes, edges, width, weight: Matrix, gamma: Matrix, beta: Matrix, root: Matrix):
    """Sum of gamma(destination) L(source) + beta(destination), plus root."""
    met = with_both(edges.select("src", "dst"), nodes)
    message = add(F.zip_with(linear(F.col("xd"), gamma), linear(F.col("xs"), weight), lambda a, b: a * b), linear(F.col("xd"), beta))
    return _out(scatter(met, message, nodes, len(weight)), add(F.col("m"), linear(F.col("x"), root)))


def res_gated(nodes, edges, width, gate_source: Matrix, gate_target: Matrix, value: Matrix, root: Matrix):
    """Sum of sigmoid gates times values, plus root."""
    met = with_both(edges.select("src", "dst"), nodes)
    gate = F.transform(add(linear(F.col("xs"), gate_source), linear(F.col("xd"), gate_target)), sigmoid)
    message = F.zip_with(gate, linear(F.col("xs"), value), lambda a, b: a * b)
    return _out(scatter(met, message, nodes, len(value)), add(F.col("m"), linear(F.col("x"), root)))


def gated_gcn(nodes, edges, width, gate_source: Matrix, gate_target: Matrix, gate_edge: Matrix, value: Matrix, root: Matrix, attr="attr", residual=True):
    """Gated mean of values, the gates from both ends and the edge, plus root and own."""
    met, size = with_both(edges, nodes), len(value)
    gate = F.transform(add(add(linear(F.col("xs"), gate_source), linear(F.col("xd"), gate_target)), linear(F.col(attr), gate_edge)), sigmoid)
    both = F.concat(F.zip_with(gate, linear(F.col("xs"), value), lambda a, b: a * b), gate)
    out = scatter(met, both, nodes, 2 * size)
    mean = F.zip_with(F.slice("m", 1, size), F.slice("m", size + 1, size), lambda a, b: a / F.greatest(b, F.lit(1e-6)))
    h = add(mean, linear(F.col("x"), root))
    return _out(out, add(h, F.col("x")) if residual and size == width else h)


def cgconv(nodes, edges, width, gate: Matrix, value: Matrix, how="sum", attr=None):
    """Own plus the aggregate of sigmoid(L z) softplus(L z) for z of both ends and the edge."""
    z = F.concat("xd", "xs", *([attr] if attr else []))
    message = F.zip_with(F.transform(linear(z, gate), sigmoid), F.transform(linear(z, value), softplus), lambda a, b: a * b)
    return _out(scatter(with_both(edges, nodes), message, nodes, width, how), add(F.col("x"), F.col("m")))


def edge_conv(nodes, edges, width, layers: list[tuple], how="max"):
    """The aggregate of a network of (own, source - own)."""
    met = with_both(edges.select("src", "dst"), nodes)
    z = F.concat("xd", F.zip_with("xs", "xd", lambda a, b: a - b))
    return _out(scatter(met, mlp(z, layers), nodes, len(layers[-1][0]), how), F.col("m"))


def nnconv(nodes, edges, width, network: list[tuple], root: Matrix, how="mean", attr="attr"):
    """The aggregate of an edge's own matrix, made by a network, times the source, plus root."""
    size = len(root)
    flat = mlp(F.col(attr), network)
    rows = F.array(*[dot(F.slice(flat, o * width + 1, width), F.col("xs")) for o in range(size)])
    return _out(scatter(with_source(edges, nodes), rows, nodes, size, how), add(F.col("m"), linear(F.col("x"), root)))


ecconv = nnconv


def pdn(nodes, edges, width, weight: Matrix, network: list[tuple], edge_width: int, attr="attr"):
    """Degree-normed sum of L(source) times an edge weight, with loops of zero attributes."""
    plain = edges.select("src", "dst", F.col(attr).alias("attr"))
    loops = nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.array(*[F.lit(0.0)] * edge_width).alias("attr"))
    met = with_source(plain.unionByName(loops), nodes)
    share = sigmoid(mlp(F.col("attr"), network)[0])
    out = scatter(met, F.concat(scale(linear(F.col("xs"), weight), share), F.array(F.lit(1.0))), nodes, len(weight) + 1)
    return _out(out, scale(F.slice("m", 1, len(weight)), 1 / F.greatest(F.element_at("m", len(weight) + 1), F.lit(1.0))))


def gmm(nodes, edges, width, weights: list[Matrix], means: Matrix, widths: Matrix, root: Matrix, attr="attr"):
    """Sum over Gaussian kernels on edge coordinates of the kernel's map of the source, plus root."""
    message = None
    for weight, mean, spread in zip(weights, means, widths, strict=True):
        power = F.lit(0.0)
        for i, (m, s) in enumerate(zip(mean, spread, strict=True)):
            power = power + F.pow(F.col(attr)[i] - m, F.lit(2.0)) / (s * s)
        part = scale(linear(F.col("xs"), weight), F.exp(-0.5 * power))
        message = part if message is None else add(message, part)
    return _out(scatter(with_source(edges, nodes), message, nodes, len(root)), add(F.col("m"), linear(F.col("x"), root)))


def pointnet(nodes, edges, width, layers: list[tuple], root: Matrix, pos="pos", how="max"):
    """The aggregate of a network of (source, its position less own), plus root."""
    met = with_source(edges.select("src", "dst"), nodes)
    met = met.join(nodes.select(F.col("id").alias("src"), F.col(pos).alias("ps")), "src").join(nodes.select(F.col("id").alias("dst"), F.col(pos).alias("pd")), "dst")
    z = F.concat("xs", F.zip_with("ps", "pd", lambda a, b: a - b))
    return _out(scatter(met, mlp(z, layers), nodes, len(layers[-1][0]), how), add(F.col("m"), linear(F.col("x"), root)))


def attend(met: DataFrame, score: Column, value: Column, nodes: DataFrame, size: int, *by: str) -> DataFrame:
    """``nodes`` with the softmax-weighted sum of values over the edges into each."""
    rows = met.select("dst", *by, score.alias("__score"), value.alias("__value"))
    top = rows.groupBy("dst", *by).agg(F.max("__score").alias("__top"))
    e = F.exp(F.col("__score") - F.col("__top"))
    if by:  # each group's own softmax, summed over the groups
        return scatter(softmax_by(rows, "__score", "dst", *by), scale(F.col("__value"), F.col("weight")), nodes, size)
    # one aggregate sums the weighed values and the weights
    out = scatter(join_back(rows, top, "dst"), F.concat(scale(F.col("__value"), e), F.array(e)), nodes, size + 1)
    return out.withColumn("m", scale(F.slice("m", 1, size), 1 / F.greatest(F.element_at("m", size + 1), F.lit(1e-12))))


def agnn(nodes, edges, width, beta=1.0):
    """Attention by beta times the cosine of both ends."""
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    met = with_both(edges.select("src", "dst"), nodes)
    score = beta * dot(F.col("xs"), F.col("xd")) / F.greatest(norm("xs") * norm("xd"), F.lit(1e-8))
    return _out(attend(met, score, F.col("xs"), nodes, width), F.col("m"))


def fagcn(nodes, edges, width, gate: list[float], eps=0.1):
    """(1 - eps) attention by tanh of a gate on both ends, plus eps own."""
    met = with_both(edges.select("src", "dst"), nodes)
    score = F.tanh(dot(F.concat("xd", "xs"), F.lit([float(g) for g in gate])))
    return _out(attend(met, score, F.col("xs"), nodes, width), _mix([F.col("m"), F.col("x")], [1 - eps, eps]))


def faconv(nodes, edges, width, weight: Matrix, left: list[float], right: list[float], eps=0.1):
    """(1 - eps) attention by tanh(a source + b destination) on L(source), plus eps own."""
    met = with_both(edges.select("src", "dst"), nodes)
    score = F.tanh(dot(F.col("xs"), F.lit([float(a) for a in left])) + dot(F.col("xd"), F.lit([float(a) for a in right])))
    return _out(attend(met, score, linear(F.col("xs"), weight), nodes, width), _mix([F.col("m"), F.col("x")], [1 - eps, eps]))


def feast(nodes, edges, width, weights: list[Matrix], scores: Matrix, root: Matrix):
    """The mean over heads of attention by L(source - destination), plus root."""
    met = with_both(edges.select("src", "dst"), nodes)
    difference = F.zip_with("xs", "xd", lambda a, b: a - b)
    out, size = nodes, len(root)
    for h, (weight, row) in enumerate(zip(weights, scores, strict=True)):
        part = attend(met, dot(difference, F.lit([float(v) for v in row])), linear(F.col("xs"), weight), nodes.select("id"), size)
        out = out.join(part.select("id", F.col("m").alias(f"h{h}")), "id")
    mean = _mix([F.col(f"h{h}") for h in range(len(weights))], [1 / len(weights)] * len(weights))
    return _out(out, add(mean, linear(F.col("x"), root)))


def gen(nodes, edges, width, weight: Matrix, root: Matrix, beta=1.0):
    """Attention by beta times the mean entry of the message, plus root."""
    met = with_source(edges.select("src", "dst"), nodes)
    value = linear(F.col("xs"), weight)
    score = beta * F.aggregate(value, F.lit(0.0), lambda a, v: a + v) / len(weight)
    return _out(attend(met, score, value, nodes, len(weight)), add(F.col("m"), linear(F.col("x"), root)))


def point_transformer(nodes, edges, width, query: Matrix, key: Matrix, value: Matrix, position: Matrix, pos="pos"):
    """Attention over position-shifted values."""
    met = with_both(edges.select("src", "dst"), nodes)
    met = met.join(nodes.select(F.col("id").alias("src"), F.col(pos).alias("ps")), "src").join(nodes.select(F.col("id").alias("dst"), F.col(pos).alias("pd")), "dst")
    delta = linear(F.zip_with("ps", "pd", lambda a, b: a - b), position)
    raw = add(F.zip_with(linear(F.col("xd"), query), linear(F.col("xs"), key), lambda a, b: a - b), delta)
    score = F.aggregate(raw, F.lit(0.0), lambda a, v: a + v)
    return _out(attend(met, score, add(linear(F.col("xs"), value), delta), nodes, len(value)), F.col("m"))


def directed(nodes, edges, width, layer, alpha=0.5, root: Matrix | None = None):
    """A layer over the edges and over their reverse, mixed, plus root."""
    ahead = layer(nodes, edges).withColumnRenamed("h", "a")
    back = layer(nodes, edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).withColumnRenamed("h", "b")
    out = nodes.join(ahead, "id").join(back, "id")
    h = _mix([F.col("a"), F.col("b")], [alpha, 1 - alpha])
    return _out(out, add(h, linear(F.col("x"), root)) if root else h)


def relational(nodes, relations: dict[str, DataFrame], width, weights: dict[str, Matrix], root: Matrix, how="mean"):
    """One map for each relation, aggregated over all edges into a node, plus root."""
    union = None
    for name, edges in relations.items():
        part = with_source(edges.select("src", "dst"), nodes).select("dst", linear(F.col("xs"), weights[name]).alias("v"))
        union = part if union is None else union.unionByName(part)
    return _out(scatter(union, F.col("v"), nodes, len(root), how), add(F.col("m"), linear(F.col("x"), root)))


def semantic(nodes, relations: dict[str, DataFrame], width, weights: dict[str, Matrix], own: Matrix, gate: list[float]):
    """Each relation's mean of L(source) and L(own), mixed by each node's softmax of a gate."""
    out, parts = nodes.withColumn("r", linear(F.col("x"), own)), [F.col("r")]
    for i, (name, edges) in enumerate(relations.items()):
        mapped = nodes.select("id", linear(F.col("x"), weights[name]).alias("x"))
        out = out.join(propagate(mapped, edges, len(own), "mean").select("id", F.col("m").alias(f"r{i}")), "id")
        parts.append(F.col(f"r{i}"))
    scores = F.array(*[dot(p, F.lit([float(g) for g in gate])) for p in parts])
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    mixed = scale(parts[0], e[0] / total)
    for i, p in enumerate(parts[1:], 1):
        mixed = add(mixed, scale(p, e[i] / total))
    return _out(out, mixed)


def layer_norm(x: Column, eps: float = 1e-5) -> Column:
    """A vector less its mean, over its deviation."""

    def mean(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / F.size(v)

    centred = bound(x, lambda v: bound(mean(v), lambda m: F.transform(v, lambda a: a - m)))
    return bound(centred, lambda c: bound(F.sqrt(dot(c, c) / F.size(c) + eps), lambda d: F.transform(c, lambda a: a / d)))


def by_relation(nodes: dict[str, DataFrame], edges: dict, width: int, chosen: dict) -> dict:
    """One layer for each relation, not merged: ``chosen[relation](nodes, edges, width)``.

    Both ends' types are put in one table, the destinations' rows are kept.
    """
    out = {}
    for key, layer in chosen.items():
        src, _, dst = key
        if src == dst:
            out[key] = layer(nodes[dst], edges[key], width)
            continue
        marked = nodes[dst].select((F.col("id") * 2).alias("id"), "x").unionByName(nodes[src].select((F.col("id") * 2 + 1).alias("id"), "x"))
        moved = edges[key].withColumns({"src": F.col("src") * 2 + 1, "dst": F.col("dst") * 2})
        out[key] = layer(marked, moved, width).where("id % 2 = 0").withColumn("id", (F.col("id") / 2).cast("long"))
    return out
