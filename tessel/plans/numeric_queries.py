"""Queries on sparse algebra, propagation, layers, features, metrics, losses, time and partitions.

Layers use fixed weights, small multiples of a quarter, that both engines spell out.
"""

import math

from pyspark.sql import functions as F

from tessel.functions.vectors import ERFC
from tessel.functions.hashing import SPAN, uniform_sql  # noqa: F401
from tessel.operators import features, layers, losses, metrics, partition, sparse, temporal
from tessel.operators import attention as attended_heads
from tessel.operators.propagate import pool, propagate
from tessel.plans import graphs as g
from tessel.plans.graphs import WIDTH
from tessel.plans.graphs import with_views as views
from tessel.plans.registry import query
from tessel.plans.structure_queries import rounded

D = range(WIDTH)


def weight(rows: int, cols: int, salt: int = 0) -> list[list[float]]:
    """A fixed matrix."""
    return [[((o * 7 + i * 3 + salt) % 5 - 2) / 4 for i in range(cols)] for o in range(rows)]


def row(cols: int, salt: int = 0) -> list[float]:
    """A fixed vector."""
    return weight(1, cols, salt)[0]


# SQL pieces: a vector is a list of scalar expressions


def cols(prefix: str, n: int = WIDTH) -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def lin(x: list[str], w: list[list[float]]) -> list[str]:
    return ["(" + " + ".join(f"({c}) * ({v})" for c, v in zip(x, r, strict=True)) + ")" for r in w]


def plus(*vectors: list[str]) -> list[str]:
    return ["(" + " + ".join(p) + ")" for p in zip(*vectors, strict=True)]


def times(x: list[str], by) -> list[str]:
    return [f"({c}) * ({by})" for c in x]


def dotted(a: list[str], b: list) -> str:
    return "(" + " + ".join(f"({p}) * ({q})" for p, q in zip(a, b, strict=True)) + ")"


def shown(x: list[str], prefix: str = "h") -> str:
    return ", ".join(f"round({c}, 5) + 0.0 AS {prefix}{i}" for i, c in enumerate(x))


def named(x: list[str], prefix: str) -> str:
    return ", ".join(f"{c} AS {prefix}{i}" for i, c in enumerate(x))


SIGM = "(1 / (1 + exp(-({}))))"


def gelu_sql(x: str) -> str:
    """x times the normal distribution function at x, by the same fit as ``vectors.gelu``."""
    t = f"(1 / (1 + 0.5 * abs({x}) / sqrt(2.0)))"
    power = str(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = f"({c} + {t} * {power})"
    tail = f"0.5 * {t} * exp({power} - ({x}) * ({x}) / 2)"
    return f"(({x}) * CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def agg_sql(source: str, how: str = "sum", n: int = WIDTH, edges: str = "handoff") -> str:
    """``SELECT id, m0 …`` of one round over table ``source(id, x0 …)``."""
    if how == "sym":
        deg = f"deg AS (SELECT id, greatest(count(e), 1) AS d FROM users LEFT JOIN (SELECT src AS e FROM {edges} UNION ALL SELECT dst FROM {edges}) ON e = id GROUP BY id)"
        body = ", ".join(f"coalesce(sum(s.x{i} / sqrt(a.d * b.d)), 0) AS m{i}" for i in range(n))
        return f"WITH {deg} SELECT u.id, {body} FROM users u LEFT JOIN {edges} e ON e.dst = u.id LEFT JOIN {source} s ON s.id = e.src LEFT JOIN deg a ON a.id = e.src LEFT JOIN deg b ON b.id = e.dst GROUP BY u.id"
    f = {"sum": "sum", "mean": "avg", "max": "max"}[how]
    body = ", ".join(f"coalesce({f}(s.x{i}), 0) AS m{i}" for i in range(n))
    return f"SELECT u.id, {body} FROM users u LEFT JOIN {edges} e ON e.dst = u.id LEFT JOIN {source} s ON s.id = e.src GROUP BY u.id"


def rounds_sql(steps: int, how: str) -> str:
    """Tables ``r0`` to ``r<steps>`` of ``(id, x0 …)``."""
    out = "r0 AS (SELECT * FROM feat)"
    for k in range(1, steps + 1):
        out += f",\nr{k} AS (SELECT id, {named(cols('m'), 'x')} FROM ({agg_sql(f'r{k - 1}', how)}))"
    return out


def joined(steps: int) -> str:
    return "r0 " + " ".join(f"JOIN r{k} USING (id)" for k in range(1, steps + 1))


def at_round(k: int) -> list[str]:
    return [f"r{k}.x{i}" for i in D]


def layer(name: str, sql: str | None = None, more: str = "", width: int = WIDTH):
    """Register a layer over the hand-off graph: ``f(nodes, edges)`` gives ``(id, h)``."""

    def keep(f):
        full = None if sql is None else views("handoff", "feat", more=more) + sql
        query(name, full)(lambda spark, sf: rounded(f(g.feat(spark, sf), g.handoff(spark, sf)), width=width))
        return f

    return keep


X, M, XS, XD = cols("x"), cols("m"), cols("s.x"), cols("d.x")
ONE = f"FROM feat JOIN ({{}}) USING (id)"
W1, W2, W3 = weight(WIDTH, WIDTH), weight(WIDTH, WIDTH, 1), weight(WIDTH, WIDTH, 2)


def one_round(h: list[str], how: str = "sum") -> str:
    return f"SELECT id, {shown(h)} " + ONE.format(agg_sql("feat", how))


layer("prop_sym", one_round(M, "sym"))(lambda n, e: propagate(n, e, WIDTH, "sym").select("id", F.col("m").alias("h")))

layer("simple_mean", one_round(M, "mean"))(lambda n, e: layers.simple(n, e, WIDTH))
layer("lg", one_round(M, "sym"))(lambda n, e: layers.lg(n, e, WIDTH))
layer("wl", one_round(times(plus(X, M), 0.5), "mean"))(lambda n, e: layers.wl(n, e, WIDTH))
layer("gcn", one_round(lin(M, W1)))(lambda n, e: layers.gcn(n, e, WIDTH, W1))
layer("gat", one_round(lin(M, W2)))(lambda n, e: layers.gat(n, e, WIDTH, W2))
layer("sage", one_round(lin(X + M, weight(3, 6))))(lambda n, e: layers.sage(n, e, WIDTH, weight(3, 6)))
layer("gin", one_round(lin([f"greatest({c}, 0)" for c in lin(plus(times(X, 1.5), M), W1)], W2)))(lambda n, e: layers.gin(n, e, WIDTH, [(W1, None), (W2, None)], 0.5))
layer("graph_conv", one_round(plus(lin(M, W1), lin(X, W2))))(lambda n, e: layers.graph_conv(n, e, WIDTH, W1, W2))
layer("cluster_gcn", one_round(plus(lin(M, W1), lin(times(X, 1.5), W2)), "mean"))(lambda n, e: layers.cluster_gcn(n, e, WIDTH, W1, W2, 0.5))
_S = plus(times(M, 0.9), times(X, 0.1))
_B = math.log(2.0)
layer("gcn2", one_round(plus(times(_S, 1 - _B), times(lin(_S, W1), _B)), "sym"))(lambda n, e: layers.gcn2(n, e, WIDTH, W1))
_SKEW = [[W1[j][i] - W1[i][j] - (0.1 if i == j else 0) for j in D] for i in D]
layer("antisymmetric", one_round(plus(X, times([f"tanh({c})" for c in plus(lin(X, _SKEW), M)], 0.1)), "sym"))(lambda n, e: layers.antisymmetric(n, e, WIDTH, W1))


def stepped(name: str, steps: int, how: str, h: list[str], f) -> None:
    """Register a layer that reads several rounds."""
    layer(name, f"SELECT id, {shown(h)} FROM {joined(steps)}", more=rounds_sql(steps, how))(f)


stepped("sg2", 2, "mean", lin(at_round(2), W1), lambda n, e: layers.sg(n, e, WIDTH, W1, 2))
stepped("ssg", 3, "sym", plus(times(at_round(0), 0.1), *[times(at_round(k), 0.9 / 3) for k in (1, 2, 3)]), lambda n, e: layers.ssg(n, e, WIDTH, 3, 0.1))
stepped("tag", 2, "mean", lin(at_round(0) + at_round(1) + at_round(2), weight(3, 9)), lambda n, e: layers.tag(n, e, WIDTH, weight(3, 9)))
stepped("h2", 2, "mean", lin(at_round(0) + at_round(1) + at_round(2), weight(3, 9, 1)), lambda n, e: layers.h2gcn(n, e, WIDTH, weight(3, 9, 1)))
stepped("cheb", 2, "mean", lin(at_round(0) + at_round(1) + plus(times(at_round(2), 2), times(at_round(0), -1)), weight(3, 9)), lambda n, e: layers.cheb(n, e, WIDTH, weight(3, 9)))
stepped("mixhop", 2, "sym", lin(at_round(0) + at_round(1) + at_round(2), weight(3, 9)), lambda n, e: layers.mixhop(n, e, WIDTH, weight(3, 9)))
_G = [0.1 * 0.9**k for k in range(3)] + [0.9**3]
stepped("gpr", 3, "sym", plus(*[times(at_round(k), _G[k]) for k in range(4)]), lambda n, e: layers.gpr(n, e, WIDTH, 3, 0.1))
stepped("bern", 3, "sym", plus(*[times(at_round(k), math.comb(3, k) / 8) for k in range(4)]), lambda n, e: layers.bern(n, e, WIDTH, 3))
_E = [f"exp({dotted(at_round(k), row(3))})" for k in range(3)]
stepped("dagnn", 2, "sym", [f"({c}) / ({' + '.join(_E)})" for c in plus(*[times(at_round(k), _E[k]) for k in range(3)])], lambda n, e: layers.dagnn(n, e, WIDTH, row(3), 2))


def smoothed(steps: int, how: str, alpha: float, start: list[str]) -> str:
    out = f"r0 AS (SELECT id, {named(start, 'x')} FROM feat)"
    for k in range(1, steps + 1):
        out += f",\nr{k} AS (SELECT id, {named(plus(times(M, 1 - alpha), times([f'r0.x{i}' for i in D], alpha)), 'x')} FROM ({agg_sql(f'r{k - 1}', how)}) JOIN r0 USING (id))"
    return out


layer("appnp", f"SELECT id, {shown(X)} FROM r3", smoothed(3, "sum", 0.1, lin(X, W1)))(lambda n, e: layers.appnp(n, e, WIDTH, W1, 3, 0.1))
layer("arma", f"SELECT id, {shown(X)} FROM r2", smoothed(2, "sym", 0.1, X))(lambda n, e: layers.arma(n, e, WIDTH, 2, 0.1))
layer("twirls", f"SELECT id, {shown(lin(X, W2))} FROM r2", smoothed(2, "sym", 0.5, lin(X, W1)))(lambda n, e: layers.twirls(n, e, WIDTH, W1, W2, 2))


def edgewise(message: list[str], how: str = "sum", edges: str = "handoff") -> str:
    """``SELECT id, m0 …`` of an aggregate of messages over both ends ``s`` and ``d``."""
    f = {"sum": "sum", "mean": "avg", "max": "max"}[how]
    inner = f"SELECT e.dst, {named(message, 'q')} FROM {edges} e JOIN feat s ON s.id = e.src JOIN feat d ON d.id = e.dst"
    return f"SELECT u.id, {', '.join(f'coalesce({f}(q{i}), 0) AS m{i}' for i in range(len(message)))} FROM users u LEFT JOIN ({inner}) z ON z.dst = u.id GROUP BY u.id"


def over_edges(name: str, message: list[str], h: list[str], f, how: str = "sum") -> None:
    layer(name, f"SELECT id, {shown(h)} " + ONE.format(edgewise(message, how)))(f)


over_edges("le", plus(lin(XS, W1), times(lin(XD, W2), -1)), plus(lin(X, W3), M), lambda n, e: layers.leconv(n, e, WIDTH, W1, W2, W3))
over_edges("film", plus([f"({a}) * ({b})" for a, b in zip(lin(XD, W2), lin(XS, W1), strict=True)], lin(XD, W3)), plus(M, lin(X, W1)), lambda n, e: layers.film(n, e, WIDTH, W1, W2, W3, W1))
over_edges("res_gated", [f"{SIGM.format(a)} * ({b})" for a, b in zip(plus(lin(XS, W1), lin(XD, W2)), lin(XS, W3), strict=True)], plus(M, lin(X, W1)), lambda n, e: layers.res_gated(n, e, WIDTH, W1, W2, W3, W1))
over_edges("edge_conv", lin(XD + plus(XS, times(XD, -1)), weight(3, 6)), M, lambda n, e: layers.edge_conv(n, e, WIDTH, [(weight(3, 6), None)]), "max")
over_edges("cg", [f"{SIGM.format(a)} * ln(1 + exp({b}))" for a, b in zip(lin(XD + XS, weight(3, 6)), lin(XD + XS, weight(3, 6, 1)), strict=True)], plus(X, M), lambda n, e: layers.cgconv(n, e, WIDTH, weight(3, 6), weight(3, 6, 1)))
_GATE = [SIGM.format(c) for c in plus(lin(XS, W1), lin(XD, W2), lin(["e.value / 100"], weight(3, 1)))]
layer("gated_gcn", f"SELECT id, {shown(plus([f'm{i} / greatest(m{i + 3}, 1e-6)' for i in D], lin(X, W1), X))} " + ONE.format(edgewise([f"({a}) * ({b})" for a, b in zip(_GATE, lin(XS, W3), strict=True)] + _GATE)))(
    lambda n, e: layers.gated_gcn(n, e.withColumn("attr", F.array(F.col("value") / 100)), WIDTH, W1, W2, weight(3, 1), W3, W1))
layer("gine", f"SELECT id, {shown(lin(plus(times(X, 1.0), M), W1))} " + ONE.format(edgewise([f"greatest({c}, 0)" for c in plus(XS, lin(["e.value / 100"], weight(3, 1)))])))(
    lambda n, e: layers.gine(n, e.withColumn("attr", F.array(F.col("value") / 100)), WIDTH, weight(3, 1), [(W1, None)]))
_NN = lin(["e.value / 100"], weight(9, 1))
layer("nnconv", f"SELECT id, {shown(plus(M, lin(X, W1)))} " + ONE.format(edgewise([dotted(XS, _NN[3 * o : 3 * o + 3]) for o in D], "mean")))(
    lambda n, e: layers.nnconv(n, e.withColumn("attr", F.array(F.col("value") / 100)), WIDTH, [(weight(9, 1), None)], W1))
layer("gmm", f"SELECT id, {shown(plus(M, lin(X, W1)))} " + ONE.format(edgewise(times(lin(XS, W2), "exp(-0.5 * power(e.value / 100 - 0.5, 2) / 0.25)"))))(
    lambda n, e: layers.gmm(n, e.withColumn("attr", F.array(F.col("value") / 100)), WIDTH, [W2], [[0.5]], [[0.5]], W1))

_MULTI = f"""SELECT u.id, CAST(count(s.id) AS DOUBLE) AS d, {', '.join(f'coalesce(sum(s.x{i}), 0) AS a{i}, coalesce(avg(s.x{i}), 0) AS b{i}, coalesce(max(s.x{i}), 0) AS c{i}' for i in D)}
 FROM users u LEFT JOIN handoff e ON e.dst = u.id LEFT JOIN feat s ON s.id = e.src GROUP BY u.id"""
_ALL = cols("a") + cols("b") + cols("c")
layer("eg", f"SELECT id, {shown(lin(_ALL, weight(3, 9)))} " + ONE.format(_MULTI))(lambda n, e: layers.egconv(n, e, WIDTH, weight(3, 9)))
_LOGD = "ln(1 + greatest(d, 1))"
layer("pna", f"SELECT id, {shown(plus(lin(_ALL + times(_ALL, _LOGD + ' / 4.0') + times(_ALL, '4.0 / ' + _LOGD), weight(3, 27)), lin(X, W1)))} " + ONE.format(_MULTI))(lambda n, e: layers.pna(n, e, WIDTH, weight(3, 27), W1, 4.0))
_DEGREES = [f"CASE WHEN d = 0 THEN {a} WHEN d = 1 THEN {b} ELSE {c} END" for a, b, c in zip(*[plus(lin(cols("b"), weight(3, 3, k)), lin(X, weight(3, 3, k + 1))) for k in range(3)], strict=True)]
layer("mf", f"SELECT id, {shown(_DEGREES)} " + ONE.format(_MULTI))(lambda n, e: layers.mfconv(n, e, WIDTH, [weight(3, 3, k) for k in range(3)], [weight(3, 3, k + 1) for k in range(3)]))


def attention(score: str, value: list[str], extra: str = "", edges: str = "handoff") -> str:
    """``SELECT id, m0 …`` of softmax attention over the edges into each node."""
    inner = f"SELECT e.dst, {score} AS sc, {named(value, 'v')} FROM {edges} e JOIN feat s ON s.id = e.src JOIN feat d ON d.id = e.dst"
    soft = f"SELECT *, exp(sc - max(sc) OVER (PARTITION BY dst)) AS ex FROM ({inner})"
    return f"SELECT u.id, {', '.join(f'coalesce(sum(v{i} * ex) / sum(ex), 0) AS m{i}' for i in range(len(value)))} FROM users u LEFT JOIN ({soft}) z ON z.dst = u.id GROUP BY u.id"


def attended(name: str, score: str, value: list[str], h: list[str], f) -> None:
    layer(name, f"SELECT id, {shown(h)} " + ONE.format(attention(score, value)))(f)


_COS = f"{dotted(XS, XD)} / greatest(sqrt({dotted(XS, XS)}) * sqrt({dotted(XD, XD)}), 1e-8)"
attended("agnn", f"2.0 * {_COS}", XS, M, lambda n, e: layers.agnn(n, e, WIDTH, 2.0))
attended("gatv2", dotted([f"tanh({c})" for c in plus(lin(XS, W1), lin(XD, W2))], row(3)), lin(XS, W1), M, lambda n, e: attended_heads.gatv2(n, e, W1, W2, [row(3)]))
attended("attention_dot", f"{dotted(lin(XD, W1), lin(XS, W2))} / sqrt(3.0)", lin(XS, W3), plus(M, lin(X, W1)), lambda n, e: attended_heads.transformer(n, e, (W1, None), (W2, None), (W3, None), root=(W1, None)))
attended("fagcn", f"tanh({dotted(XD + XS, row(6))})", XS, plus(times(M, 0.9), times(X, 0.1)), lambda n, e: layers.fagcn(n, e, WIDTH, row(6)))
attended("fa", f"tanh({dotted(XS, row(3))} + {dotted(XD, row(3, 1))})", lin(XS, W1), plus(times(M, 0.9), times(X, 0.1)), lambda n, e: layers.faconv(n, e, WIDTH, W1, row(3), row(3, 1)))
attended("gen", f"({' + '.join(lin(XS, W1))}) / 3.0", lin(XS, W1), plus(M, lin(X, W2)), lambda n, e: layers.gen(n, e, WIDTH, W1, W2))
attended("feast", dotted(plus(XS, times(XD, -1)), row(3)), lin(XS, W1), plus(M, lin(X, W2)), lambda n, e: layers.feast(n, e, WIDTH, [W1], [row(3)], W2))
layer("directed", f"SELECT id, {shown(plus(times(cols('a.m'), 0.5), times(cols('b.m'), 0.5), lin(X, W1)))} FROM feat JOIN ({agg_sql('feat')}) a USING (id) JOIN ({agg_sql('feat', edges='turned')}) b USING (id)",
      more="turned AS (SELECT dst AS src, src AS dst FROM handoff)")(
    lambda n, e: layers.directed(n, e, WIDTH, lambda a, b: propagate(a, b, WIDTH).select("id", F.col("m").alias("h")), 0.5, W1))


def _two(edges):
    return {"even": edges.where("e_id % 2 = 0"), "odd": edges.where("e_id % 2 = 1")}


_REL = [f"CASE WHEN e.e_id % 2 = 0 THEN {a} ELSE {b} END" for a, b in zip(lin(XS, W1), lin(XS, W2), strict=True)]
layer("rel_mean", f"SELECT id, {shown(plus(M, lin(X, W3)))} " + ONE.format(edgewise(_REL, "mean")))(lambda n, e: layers.relational(n, _two(e), WIDTH, {"even": W1, "odd": W2}, W3))
_HALVES = "evens AS (SELECT * FROM handoff WHERE e_id % 2 = 0), odds AS (SELECT * FROM handoff WHERE e_id % 2 = 1), "
_PARTS = [lin(X, W3), cols("a.m"), cols("b.m")]
_SE = [f"exp({dotted(p, row(3))})" for p in _PARTS]
layer("semantic_mix", f"SELECT id, {shown([f'({c}) / ({chr(43).join(_SE)})' for c in plus(*[times(p, w) for p, w in zip(_PARTS, _SE, strict=True)])])} FROM feat JOIN ({agg_sql('fe', 'mean', edges='evens')}) a USING (id) JOIN ({agg_sql('fo', 'mean', edges='odds')}) b USING (id)",
      more=_HALVES + f"fe AS (SELECT id, {named(lin(X, W1), 'x')} FROM feat), fo AS (SELECT id, {named(lin(X, W2), 'x')} FROM feat)")(lambda n, e: layers.semantic(n, _two(e), WIDTH, {"even": W1, "odd": W2}, W3, row(3)))
_CELL = {k: weight(3, 3, i) for i, k in enumerate(("ir", "iz", "in", "hr", "hz", "hn"))}

def gru_sql(x: list[str], h: list[str], cell: dict | None = None) -> list[str]:
    """One step of the gated unit with the fixed cell, or another."""
    part = {k: lin(x if k[0] == "i" else h, w) for k, w in (cell or _CELL).items()}
    r = [SIGM.format(c) for c in plus(part["ir"], part["hr"])]
    z = [SIGM.format(c) for c in plus(part["iz"], part["hz"])]
    n = [f"tanh({a} + {b} * {c})" for a, b, c in zip(part["in"], r, part["hn"], strict=True)]
    return [f"((1 - {g}) * {v} + {g} * {old})" for g, v, old in zip(z, n, h, strict=True)]


def norm_sql(x: list[str]) -> list[str]:
    """Layer norm of three entries."""
    mean = f"(({' + '.join(x)}) / 3)"
    var = f"(({' + '.join(f'power({c} - {mean}, 2)' for c in x)}) / 3)"
    return [f"(({c} - {mean}) / sqrt({var} + 1e-5))" for c in x]


_GATED = "g0 AS (SELECT * FROM feat)"
for _k in (1, 2):
    _GATED += f""",
s{_k} AS (SELECT id, {named(lin(X, W1), 'x')} FROM g{_k - 1}),
g{_k} AS (SELECT id, {named(gru_sql(M, [f'g{_k - 1}.x{i}' for i in D]), 'x')} FROM g{_k - 1} JOIN ({agg_sql(f's{_k}')}) USING (id))"""
layer("gated_graph", f"SELECT id, {shown(X)} FROM g2", more=_GATED)(lambda n, e: layers.gated_graph(n, e, WIDTH, W1, _CELL, 2))
_PADDED = "padded AS (SELECT src, dst, value / 100 AS attr FROM handoff UNION ALL SELECT id, id, 0 FROM users)"
layer("pdn", f"SELECT id, {shown(M)} " + ONE.format(edgewise(times(lin(XS, W1), SIGM.format("0.5 * e.attr + 0.1")), "mean", "padded")), more=_PADDED)(
    lambda n, e: layers.pdn(n, e.withColumn("attr", F.array(F.col("value") / 100)), WIDTH, W1, [([[0.5]], [0.1])], 1))
_SHIFT = ["(s.x0 - d.x0)", "(s.x1 - d.x1)"]
over_edges("pointnet", lin(XS + _SHIFT, weight(3, 5)), plus(M, lin(X, W1)), lambda n, e: layers.pointnet(n.withColumn("pos", F.slice("x", 1, 2)), e, WIDTH, [(weight(3, 5), None)], W1), "max")
_DELTA = lin(_SHIFT, weight(3, 2))
attended("point_transformer", " + ".join(plus(lin(XD, W1), times(lin(XS, W2), -1), _DELTA)), plus(lin(XS, W3), _DELTA), M,
         lambda n, e: layers.point_transformer(n.withColumn("pos", F.slice("x", 1, 2)), e, WIDTH, W1, W2, W3, weight(3, 2)))

# sparse algebra


@query("adjacency_csr", views("users", "handoff") + """SELECT id AS major, CAST(sum(n) OVER (ORDER BY id) - n AS BIGINT) AS first, n, total FROM (
 SELECT u.id, CAST(count(e_id) AS INTEGER) AS n, CAST(coalesce(sum(dst), 0) AS BIGINT) AS total FROM users u LEFT JOIN handoff ON src = u.id GROUP BY u.id)""")
def adjacency_csr(spark, sf):
    pointers, blocks = sparse.compressed(sparse.adjacency(g.handoff(spark, sf)), g.users(spark, sf), cells=16)
    part = blocks.select("major", F.aggregate("minors", F.lit(0).cast("long"), lambda a, v: a + v).alias("part"))
    totals = part.groupBy("major").agg(F.sum("part").alias("total"))
    return pointers.join(totals, "major", "left").select("major", "first", F.col("n").cast("int").alias("n"), F.coalesce("total", F.lit(0)).alias("total"))


@query("adjacency_csc", views("users", "handoff") + "SELECT src AS row, dst AS col, e_id FROM handoff")
def adjacency_csc(spark, sf):
    blocks = sparse.compressed(sparse.adjacency(g.handoff(spark, sf)), g.users(spark, sf), by="col")[1]
    return sparse.uncompressed(blocks, by="col").select("row", "col", "e_id")


@query("incidence_both", views("handoff", more="r AS (SELECT *, row_number() OVER (ORDER BY e_id) - 1 AS c FROM handoff)") + "SELECT src AS row, c AS col, -1.0 AS value FROM r WHERE src <> dst UNION ALL SELECT dst, c, 1.0 FROM r WHERE src <> dst")
def incidence_both(spark, sf):
    return sparse.incidence(g.handoff(spark, sf))


_LAP = """a AS (SELECT src AS row, dst AS col, CAST(1.0 AS DOUBLE) AS value FROM handoff), deg AS (SELECT row AS id, sum(value) AS d FROM a GROUP BY 1),
cells AS (SELECT row, col, {off} AS value FROM a JOIN deg r ON r.id = row LEFT JOIN deg c ON c.id = col UNION ALL SELECT id, id, {diag} FROM deg)"""
_LAPQ = "SELECT row, col, round(sum(value), 5) + 0.0 AS value FROM cells GROUP BY row, col HAVING sum(value) <> 0"
for _name, _norm, _off, _diag in (("laplacian", None, "-value", "d"), ("laplacian_rw", "rw", "-value / r.d", "1.0"), ("laplacian_sym", "sym", "-value / sqrt(r.d) * coalesce(1 / sqrt(c.d), 0)", "1.0")):
    query(_name, views("handoff", more=_LAP.format(off=_off, diag=_diag)) + _LAPQ)(
        lambda spark, sf, norm=_norm: sparse.laplacian(g.users(spark, sf), g.handoff(spark, sf), norm).select("row", "col", (F.round("value", 5) + F.lit(0.0)).alias("value")))


@query("row_sum", views("parts", "copart") + "SELECT id, coalesce(sum(w), 0) AS total FROM parts LEFT JOIN copart ON src = id GROUP BY id")
def row_sum(spark, sf):
    return sparse.sums(sparse.adjacency(g.copart(spark, sf), "w"), g.parts(spark, sf), "row", F.col("value"))


@query("col_sum", views("parts", "copart") + "SELECT id, count(dst) AS total FROM parts LEFT JOIN copart ON dst = id GROUP BY id")
def col_sum(spark, sf):
    return sparse.sums(sparse.adjacency(g.copart(spark, sf)), g.parts(spark, sf), "col")


@query("rows_selected", views("handoff") + "SELECT pos AS row, dst AS col, e_id FROM handoff JOIN (VALUES (3, 3), (1, 5), (2, 8)) v(pos, id) ON id = src")
def rows_selected(spark, sf):
    picked = g.ids(spark, [3, 5, 8, 3])
    return sparse.select_slices(sparse.adjacency(g.handoff(spark, sf)), picked).select("row", "col", "e_id")


@query("transposed", views("handoff") + "SELECT dst AS row, src AS col, e_id FROM handoff")
def transposed(spark, sf):
    return sparse.transpose(sparse.adjacency(g.handoff(spark, sf))).select("row", "col", "e_id")


@query("coalesced", views("copart") + "SELECT src AS row, dst AS col, sum(w) AS value FROM copart GROUP BY 1, 2 HAVING sum(w) <> 0")
def coalesced(spark, sf):
    return sparse.coalesced(sparse.adjacency(g.copart(spark, sf), "w"))


@query("spmm", views("handoff", "feat") + f"SELECT u.id, {', '.join(f'round(coalesce(sum(s.x{i} * e.value), 0), 5) + 0.0 AS x{i}' for i in D)} FROM users u LEFT JOIN handoff e ON e.src = u.id LEFT JOIN feat s ON s.id = e.dst GROUP BY u.id")
def spmm(spark, sf):
    out = sparse.spmm(sparse.adjacency(g.handoff(spark, sf), "value"), g.feat(spark, sf), g.users(spark, sf), WIDTH)
    return rounded(out, "x")


@query("spmm_blocks", views("handoff", "feat") + f"SELECT u.id, {', '.join(f'round(coalesce(sum(s.x{i} * e.value), 0), 5) + 0.0 AS x{i}' for i in D)} FROM users u LEFT JOIN handoff e ON e.src = u.id LEFT JOIN feat s ON s.id = e.dst GROUP BY u.id")
def spmm_blocks(spark, sf):
    blocks = sparse.compressed(sparse.adjacency(g.handoff(spark, sf), "value"), g.users(spark, sf), cells=32)[1]
    return rounded(sparse.spmm(sparse.uncompressed(blocks), g.feat(spark, sf), g.users(spark, sf), WIDTH), "x")


@query("sddmm", views("handoff", "feat") + f"SELECT e_id, round({dotted(XS, XD)}, 5) + 0.0 AS value FROM handoff e JOIN feat s ON s.id = e.src JOIN feat d ON d.id = e.dst")
def sddmm(spark, sf):
    x = g.feat(spark, sf)
    return sparse.sddmm(sparse.adjacency(g.handoff(spark, sf)), x, x).select("e_id", (F.round("value", 5) + F.lit(0.0)).alias("value"))


@query("edge_softmax", views("handoff") + "SELECT e_id, round(exp(value / 50 - max(value / 50) OVER w) / sum(exp(value / 50)) OVER w * exp(max(value / 50) OVER w), 5) AS weight FROM handoff WINDOW w AS (PARTITION BY dst)")
def edge_softmax(spark, sf):
    return sparse.softmax_by(g.handoff(spark, sf).withColumn("s", F.col("value") / 50), "s", "dst").select("e_id", F.round("weight", 5).alias("weight"))


# pools, features, splits

for _how, _fn in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    query(f"pool_{_how}", views("li") + f"SELECT l_orderkey AS graph_id, round({_fn}(l_quantity), 5) AS h0, round({_fn}(l_extendedprice), 6) AS h1 FROM li GROUP BY 1")(
        lambda spark, sf, how=_how: pool(g.li(spark, sf).select(F.col("l_orderkey").alias("graph_id"), F.array("l_quantity", "l_extendedprice").alias("x")), 2, how).select("graph_id", F.round(F.col("h")[0], 5).alias("h0"), F.round(F.col("h")[1], 6).alias("h1")))

ALL = range(g.FULL)
_SUM = " + ".join(f"x{i}" for i in ALL)
_STD = "SELECT id, {h} FROM feat_full, (SELECT {s} FROM feat_full {w})"
_STATS = ", ".join(f"avg(x{i}) AS a{i}, stddev_pop(x{i}) AS s{i}" for i in ALL)
_STDH = shown([f"(x{i} - a{i}) / greatest(s{i}, 1e-12)" for i in ALL], "x")


def featured(name: str, sql: str):
    """Register a query on whole embeddings, given as a function of the feature table."""
    return lambda made: query(name, views("feat_full", "handoff") + sql)(lambda spark, sf: rounded(made(g.feat(spark, sf, g.FULL), spark, sf), "x", g.FULL))


featured("norm_rows", f"SELECT id, {shown([f'x{i} / greatest({_SUM}, 0.05)' for i in ALL], 'x')} FROM feat_full")(lambda x, spark, sf: features.normalize_rows(x, eps=0.05))
featured("standardize", _STD.format(h=_STDH, s=_STATS, w=""))(lambda x, spark, sf: features.standardize(x, g.FULL))
featured("standardize_train", _STD.format(h=_STDH, s=_STATS, w="WHERE id % 3 = 0"))(lambda x, spark, sf: features.standardize(x, g.FULL, where="id % 3 = 0"))
for _how, _fn in (("sum", "sum"), ("mean", "avg"), ("max", "max")):
    _GOT = f"(SELECT dst, {', '.join(f'{_fn}(s.x{i}) AS m{i}' for i in ALL)} FROM handoff JOIN feat_full s ON s.id = src GROUP BY dst)"
    featured(f"prop_{_how}", f"SELECT id, {shown([f'coalesce(m{i}, 0)' for i in ALL], 'x')} FROM feat_full LEFT JOIN {_GOT} ON dst = id")(
        lambda x, spark, sf, how=_how: propagate(x, g.handoff(spark, sf), g.FULL, how).select("id", F.col("m").alias("x")))

_SPLIT = "(SELECT *, row_number() OVER (ORDER BY {u}, id) - 1 AS r, count(*) OVER () AS n FROM {t})"


@query("split_node", views("users") + "SELECT id, CASE WHEN r < floor(n * 0.1) THEN 'val' WHEN r < floor(n * 0.1) + floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM " + _SPLIT.format(u=uniform_sql(11, "id"), t="users"))
def split_node(spark, sf):
    return features.split_rows(g.users(spark, sf), 0.1, 0.2, seed=11)


@query("split_graph", "SELECT id, CASE WHEN r < floor(n * 0.1) THEN 'val' WHEN r < floor(n * 0.1) + floor(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM " + _SPLIT.format(u=uniform_sql(12, "id"), t="(SELECT o_orderkey AS id FROM orders)"))
def split_graph(spark, sf):
    return features.split_rows(g.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), 0.1, 0.2, seed=12)


_U13 = uniform_sql(13, "id")


@query("split_node_per_class", f"""WITH c AS (SELECT c_custkey AS id, c_mktsegment AS y, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {uniform_sql(13, 'c_custkey')}, c_custkey) AS k FROM customer),
r AS (SELECT *, row_number() OVER (ORDER BY {_U13}, id) - 1 AS n FROM c WHERE k > 20)
SELECT id, y, 'train' AS part FROM c WHERE k <= 20 UNION ALL SELECT id, y, CASE WHEN n < 50 THEN 'val' WHEN n < 150 THEN 'test' ELSE 'none' END FROM r""")
def split_node_per_class(spark, sf):
    rows = g.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("y"))
    return features.split_per_class(rows, "y", 20, 50, 100, seed=13)


@query("split_link", views("handoff", more="pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(e_id) AS id FROM handoff GROUP BY 1, 2)")
       + "SELECT e_id, src, dst, CASE WHEN r < floor(n * 0.1) THEN 'val' WHEN r < floor(n * 0.1) + floor(n * 0.1) THEN 'test' ELSE 'train' END AS part FROM handoff JOIN " + _SPLIT.format(u=uniform_sql(14, "id"), t="pairs") + " ON a = least(src, dst) AND b = greatest(src, dst)")
def split_link(spark, sf):
    return features.split_links(g.handoff(spark, sf).select("e_id", "src", "dst"), 0.1, 0.1, seed=14, undirected=True)


# metrics and losses

query("accuracy", views("preds") + "SELECT round(avg(CASE WHEN label = CASE WHEN z0 >= z1 AND z0 >= z2 THEN 0 WHEN z1 >= z2 THEN 1 ELSE 2 END THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM preds")(
    lambda spark, sf: metrics.accuracy(g.preds(spark, sf), "z").select(F.round("accuracy", 6).alias("accuracy")))
_RANK = "rk AS (SELECT q, 1 + sum(CASE WHEN label = 0 AND score > best THEN 1 ELSE 0 END) AS rank FROM (SELECT *, max(CASE WHEN label = 1 THEN score END) OVER (PARTITION BY q) AS best FROM scored {w}) GROUP BY q)"
for _f, _w in (("", ""), ("filtered_", "WHERE label = 1 OR NOT filtered")):
    query(f"{_f}mrr", views("scored", more=_RANK.format(w=_w)) + "SELECT round(avg(1.0 / rank), 6) AS mrr FROM rk")(lambda spark, sf, f=_f: metrics.build_metric(f"{f}mrr")(g.scored(spark, sf)).select(F.round("mrr", 6).alias("mrr")))
    query(f"{_f}hits_k", views("scored", more=_RANK.format(w=_w)) + "SELECT round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hits FROM rk")(lambda spark, sf, f=_f: metrics.build_metric(f"{f}hits@3")(g.scored(spark, sf)).select(F.round("hits", 6).alias("hits")))

_COUNTS = [100, 50, 10]


def logp(p: str, shift: list[float] | None = None) -> list[str]:
    z = [f"({p}{i} + ({s}))" for i, s in enumerate(shift or [0, 0, 0])]
    return [f"({c} - ln({' + '.join(f'exp({v})' for v in z)}))" for c in z]


def true(values: list[str]) -> str:
    return f"(CASE label WHEN 0 THEN {values[0]} WHEN 1 THEN {values[1]} ELSE {values[2]} END)"


P, Q = logp("z"), logp("y")
T = true(P)
_ENT = "-(" + " + ".join(f"exp({v}) * {v}" for v in P) + ")"
_MAR = [0.5 * (c**-0.25) / max(k**-0.25 for k in _COUNTS) for c in _COUNTS]
_LDAM = true([logp("z", [-_MAR[i] if i == j else 0 for i in D])[j] for j in D])
_KL = lambda a, b: "(" + " + ".join(f"exp({p}) * ({p} - {q})" for p, q in zip(a, b, strict=True)) + ")"
_BIN = "(CASE WHEN label = 1 THEN 1 ELSE 0 END)"
_BCE = f"(ln(1 + exp(z0)) - {_BIN} * z0)"
for _name, _loss, _sql in (
    ("cross_entropy", lambda: losses.cross_entropy(F.col("z"), F.col("label"), 0.1), f"-0.9 * {T} - 0.1 * ({' + '.join(P)}) / 3"),
    ("focal", lambda: losses.focal(F.col("z"), F.col("label")), f"-power(1 - exp({T}), 2) * {T}"),
    ("balanced_softmax", lambda: losses.balanced_softmax(F.col("z"), F.col("label"), _COUNTS), f"-{true(logp('z', [math.log(c) for c in _COUNTS]))}"),
    ("logit_adjust", lambda: losses.logit_adjusted(F.col("z"), F.col("label"), _COUNTS, 0.5), f"-{true(logp('z', [0.5 * math.log(c / 160) for c in _COUNTS]))}"),
    ("ldam", lambda: losses.ldam(F.col("z"), F.col("label"), _COUNTS), f"-{_LDAM}"),
    ("bce", lambda: losses.binary_cross_entropy(F.col("z")[0], (F.col("label") == 1).cast("int"), 2.0), f"{_BCE} + {_BIN} * ln(1 + exp(-z0))"),
    ("bce_focal", lambda: losses.focal_binary(F.col("z")[0], (F.col("label") == 1).cast("int")), f"power(1 - CASE WHEN label = 1 THEN {SIGM.format('z0')} ELSE 1 - {SIGM.format('z0')} END, 2) * {_BCE}"),
    ("bootstrap", lambda: losses.bootstrap(F.col("z"), F.col("label")), f"-0.95 * {T} + 0.05 * {_ENT}"),
    ("bootstrap_hard", lambda: losses.bootstrap(F.col("z"), F.col("label"), hard=True), f"-0.95 * {T} - 0.05 * greatest({', '.join(P)})"),
    ("conf_penalty", lambda: losses.confidence_penalty(F.col("z"), F.col("label"), 0.1), f"-{T} - 0.1 * ({_ENT})"),
    ("gce", lambda: losses.generalized_cross_entropy(F.col("z"), F.col("label")), f"(1 - exp(0.7 * {T})) / 0.7"),
    ("poly1", lambda: losses.poly1(F.col("z"), F.col("label")), f"-{T} + (1 - exp({T}))"),
    ("sce", lambda: losses.symmetric_cross_entropy(F.col("z"), F.col("label")), f"-{T} - ({math.log(1e-4)}) * (1 - exp({T}))"),
    ("rdrop", lambda: losses.rdrop(F.col("z"), F.col("y"), F.col("label")), f"(-{T} - {true(Q)}) / 2 + ({_KL(P, Q)} + {_KL(Q, P)}) / 2"),
):
    query(f"loss_{_name}", views("preds") + f"SELECT label, round(avg({_sql}), 5) AS loss FROM preds GROUP BY label")(
        lambda spark, sf, loss=_loss: g.preds(spark, sf).groupBy("label").agg(F.round(F.avg(loss()), 5).alias("loss")))
query("loss_flooding", views("preds") + f"SELECT round(abs(avg(-{T}) - 3) + 3, 5) AS loss FROM preds")(
    lambda spark, sf: g.preds(spark, sf).agg(F.round(losses.flooding(F.avg(losses.cross_entropy(F.col("z"), F.col("label"))), 3.0), 5).alias("loss")))


# time

query("snapshot", views("handoff") + "SELECT e_id, src, dst FROM handoff WHERE t <= (SELECT min(epoch_us(ts)) + 864000000000 FROM events)")(
    lambda spark, sf: _timed(spark, sf, lambda gr, t0: gr.snapshot(t0 + 864_000_000_000)))
query("window", views("handoff") + "SELECT e_id, src, dst FROM handoff WHERE t BETWEEN (SELECT min(epoch_us(ts)) + 86400000000 FROM events) AND (SELECT min(epoch_us(ts)) + 864000000000 FROM events)")(
    lambda spark, sf: _timed(spark, sf, lambda gr, t0: gr.window(t0 + 86_400_000_000, t0 + 864_000_000_000)))


def _timed(spark, sf, f):
    from tessel.model import PropertyGraph

    edges = g.handoff(spark, sf)
    first = g.table(spark, sf, "events").agg(F.min(g.micros("ts")).alias("t")).first()["t"]
    return f(PropertyGraph.homogeneous(g.users(spark, sf), edges, "t"), first).edge_table().select("e_id", "src", "dst")


_MSG = "msgs AS (SELECT src AS id, t, e_id * 2 AS pos, value FROM handoff UNION ALL SELECT dst, t, e_id * 2 + 1, value FROM handoff)"


def _messages(spark, sf):
    return temporal.both_ends(g.handoff(spark, sf).withColumn("msg", F.array("value")))


query("msg_last", views("handoff", more=_MSG) + "SELECT id, t, value AS msg FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, pos) AS n FROM msgs) WHERE n = 1")(
    lambda spark, sf: temporal.last_messages(_messages(spark, sf)).select("id", "t", F.col("msg")[0].alias("msg")))
query("msg_mean", views("handoff", more=_MSG) + "SELECT id, max(t) AS t, round(avg(value), 5) AS msg FROM msgs GROUP BY id")(
    lambda spark, sf: temporal.mean_messages(_messages(spark, sf), 1).select("id", "t", F.round(F.col("msg")[0], 5).alias("msg")))
query("time_encode", views("handoff") + "SELECT e_id, round(cos((t % 1000000000) * 1e-6 + 0.5), 5) + 0.0 AS h0 FROM handoff")(
    lambda spark, sf: rounded(g.handoff(spark, sf).select("e_id", temporal.time_encode(F.col("t") % 1_000_000_000, [1e-6], [0.5]).alias("h")), width=1, keep=("e_id",)))


@query("memory_step", views("handoff", "feat", more=_MSG + ", got AS (SELECT id, t, value / 100 AS v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, pos) AS n FROM msgs) WHERE n = 1)")
       + f"SELECT id, coalesce(t, 0) AS t, {', '.join(f'round(CASE WHEN v IS NULL THEN x{i} ELSE {c} END, 5) + 0.0 AS x{i}' for i, c in enumerate(gru_sql(['v', 'v', 'v'], X)))} FROM feat LEFT JOIN got USING (id)")
def memory_step(spark, sf):
    memory = g.feat(spark, sf).withColumn("t", F.lit(0).cast("long"))
    msgs = temporal.both_ends(g.handoff(spark, sf).withColumn("msg", F.transform(F.array("value", "value", "value"), lambda v: v / 100)))
    return rounded(temporal.memory_update(memory, temporal.last_messages(msgs), _CELL, WIDTH), "x", keep=("id", "t"))


@query("memory_replay", views("handoff", more="""b AS (SELECT src AS id, CAST(t // 864000000000 AS BIGINT) AS batch, sum(value) AS v FROM handoff GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY batch) AS k FROM b), s AS (SELECT id, batch, k, v AS state FROM o WHERE k = 1 UNION ALL SELECT o.id, o.batch, o.k, s.state * 0.371377 + o.v FROM s JOIN o ON o.id = s.id AND o.k = s.k + 1)""")
       + "SELECT id, batch, round(state, 4) AS state FROM s")
def memory_replay(spark, sf):
    events = g.handoff(spark, sf).select(F.col("src").alias("id"), F.floor(F.col("t") / 864_000_000_000).cast("long").alias("batch"), "value")
    return temporal.replay(events, decay=0.371377).select("id", "batch", F.round("state", 4).alias("state"))


#: Batches of the hand-offs by time, and a cell for messages of two memories, a raw value and a time.
_BATCHES = 5
_WIDE_CELL = {k: weight(3, 8 if k[0] == "i" else 3, i) for i, k in enumerate(("ir", "iz", "in", "hr", "hz", "hn"))}
_SPAN = f"sp AS (SELECT min(t) AS lo, max(t) AS hi FROM handoff), bt AS (SELECT e_id, src, dst, t, value / 100 AS raw, CAST((t - lo) * {_BATCHES} // (hi - lo + 1) AS BIGINT) AS batch FROM handoff, sp)"


def _memories_sql(aggregate: str) -> str:
    """One clause a batch: the memory of all nodes after it."""
    out = _SPAN + ", y0 AS (SELECT id, 0.0::DOUBLE AS x0, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0::BIGINT AS t, false AS hit FROM users)"
    parts = [f"a.x{i}" for i in D] + [f"b.x{i}" for i in D] + ["e.raw", "cos((e.t - a.t) / 1e6 * 1e-7 + 0.3)"]
    for k in range(_BATCHES):
        ends = f"SELECT src AS id, dst AS other, t, raw, e_id * 2 AS pos FROM bt WHERE batch = {k} UNION ALL SELECT dst, src, t, raw, e_id * 2 + 1 FROM bt WHERE batch = {k}"
        if aggregate == "last":
            ends = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY t DESC, pos) AS n FROM ({ends})) WHERE n = 1"
        told = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(parts))
        out += f""",\nz{k} AS MATERIALIZED (SELECT e.id, max(e.t) AS t, {told} FROM ({ends}) e JOIN y{k} a ON a.id = e.id JOIN y{k} b ON b.id = e.other GROUP BY e.id),
y{k + 1} AS MATERIALIZED (SELECT y.id, {", ".join(f"CASE WHEN z.id IS NULL THEN y.x{i} ELSE {c} END AS x{i}" for i, c in enumerate(gru_sql([f"z.m{i}" for i in range(8)], [f"y.x{i}" for i in D], _WIDE_CELL)))}, coalesce(z.t, y.t) AS t, z.id IS NOT NULL AS hit FROM y{k} y LEFT JOIN z{k} z USING (id))"""
    return out


def _memories(aggregate):
    def run(spark, sf):
        events = g.handoff(spark, sf)
        lo, hi = events.agg(F.min("t"), F.max("t")).first()
        events = events.withColumn("batch", F.expr(f"(t - {lo}L) * {_BATCHES} div {hi - lo + 1}L")).withColumn("raw", F.array(F.col("value") / 100))
        memory = g.users(spark, sf).select("id", F.array(*[F.lit(0.0)] * WIDTH).alias("x"), F.lit(0).cast("long").alias("t"))
        out = temporal.memory_over_batches(events, memory, _WIDE_CELL, WIDTH, [1e-7], [0.3], aggregate)
        return rounded(out, "x", keep=("id", "batch", "t"))

    return run


for _kind in ("last", "mean"):
    query(f"memory_batches_{_kind}", views("users", "handoff", more=_memories_sql(_kind)) + " UNION ALL ".join(f"SELECT id, CAST({k} AS BIGINT) AS batch, t, {shown(X, 'x')} FROM y{k + 1} WHERE hit" for k in range(_BATCHES)))(_memories(_kind))


# partitions

_PART = "placed AS (SELECT e_id, src, dst, src // s AS a, dst // s AS b FROM copart, (SELECT CAST(ceil(count(*) / 8.0) AS BIGINT) AS s FROM part))"


def _placed(spark, sf):
    n = g.table(spark, sf, "part").count()
    return partition.placed_edges(g.copart(spark, sf).select("e_id", "src", "dst"), n, 8), n


query("part_local", views("copart", more=_PART) + "SELECT e_id, src, dst, CAST(a AS INTEGER) AS part FROM placed WHERE a = b")(lambda spark, sf: _placed(spark, sf)[0].where("kind = 'local'").select("e_id", "src", "dst", "part"))
query("part_boundary", views("copart", more=_PART) + "SELECT e_id, CAST(a AS INTEGER) AS part FROM placed WHERE a <> b UNION ALL SELECT e_id, CAST(b AS INTEGER) FROM placed WHERE a <> b")(lambda spark, sf: _placed(spark, sf)[0].where("kind = 'boundary'").select("e_id", "part"))


@query("route_nodes", "SELECT l_orderkey AS pos, l_partkey AS id, CAST(l_partkey // s AS INTEGER) AS part, l_partkey % s AS local FROM lineitem, (SELECT CAST(ceil(count(*) / 8.0) AS BIGINT) AS s FROM part)")
def route_nodes(spark, sf):
    asked = g.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("id"))
    return partition.route(asked, g.table(spark, sf, "part").count(), 8)


@query("gather_features", "SELECT l_orderkey AS pos, l_partkey AS id, p_retailprice FROM lineitem JOIN part ON p_partkey = l_partkey")
def gather_features(spark, sf):
    asked = g.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("pos"), F.col("l_partkey").alias("id"))
    return partition.gather(asked, g.table(spark, sf, "part").withColumnRenamed("p_partkey", "id"), "p_retailprice")


_LINKNEG = "pairs AS (SELECT e_id AS id FROM handoff), val AS (SELECT e_id AS q, src, dst FROM handoff JOIN " + _SPLIT.format(u=uniform_sql(15, "id"), t="pairs") + """ s ON s.id = e_id WHERE r < floor(n * 0.02)),
tot AS (SELECT unnest(range((SELECT max(user_id) + 1 FROM events))) AS id), s AS (SELECT DISTINCT src FROM val),
free AS (SELECT s.src, tot.id, row_number() OVER (PARTITION BY s.src ORDER BY tot.id) - 1 AS k, count(*) OVER (PARTITION BY s.src) AS n FROM s, tot WHERE NOT EXISTS (SELECT 1 FROM handoff h WHERE h.src = s.src AND h.dst = tot.id)),
d AS (SELECT q, src, slot, """ + uniform_sql(15, "q", "slot") + " AS u FROM val, (VALUES (1), (2)) v(slot))"


@query("split_link_neg", views("handoff", more=_LINKNEG) + "SELECT q, src, dst, 1 AS label, 0 AS slot FROM val UNION ALL SELECT q, d.src, f.id, 0, slot FROM d JOIN free f ON f.src = d.src AND f.k = d.u % f.n")
def split_link_neg(spark, sf):
    from tessel.operators import sampling

    edges = g.handoff(spark, sf).select("e_id", "src", "dst")
    val = features.split_links(edges, 0.02, 0.1, seed=15).where("part = 'val'").select(F.col("e_id").alias("q"), "src", "dst")
    return sampling.uniform_negatives(edges, val, 2, g.user_total(spark, sf), seed=15)


@query("csv_roundtrip", views("users", "handoff", more="num AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS new_id FROM users)") + "SELECT e_id, a.new_id AS src, b.new_id AS dst, round(value, 4) AS value FROM handoff JOIN num a ON a.id = src JOIN num b ON b.id = dst")
def csv_roundtrip(spark, sf):
    from tessel.model import PropertyGraph
    from tessel.plans.staging import scratch_path
    from tessel.sources.graph_files import read_csv_tables, write_csv_tables

    nodes, edges = scratch_path(spark, "nodes-csv"), scratch_path(spark, "edges-csv")
    write_csv_tables(PropertyGraph.homogeneous(g.users(spark, sf), g.handoff(spark, sf).select("e_id", "src", "dst", "value")), nodes, edges)
    return read_csv_tables(spark, nodes, edges).edge_table().select("e_id", "src", "dst", F.round("value", 4).alias("value"))


@query("event_messages", views("handoff", "feat") + f"SELECT e_id, {', '.join([f'round(s.x{i}, 5) + 0.0 AS msg{i}, round(d.x{i}, 5) + 0.0 AS msg{i + 3}' for i in D])}, round(value, 5) AS msg6, round(cos((t - 1600000000000000) / 1e6 * 1e-7), 5) + 0.0 AS msg7 FROM handoff JOIN feat s ON s.id = src JOIN feat d ON d.id = dst")
def event_messages(spark, sf):
    memory = g.feat(spark, sf).withColumn("t", F.lit(1_600_000_000_000_000))
    events = g.handoff(spark, sf).withColumn("raw", F.array("value"))
    return rounded(temporal.event_messages(events, memory, "raw", [1e-7], [0.0]), "msg", 8, keep=("e_id",))


@query("by_relation", views("li") + "SELECT p_partkey AS id, round(coalesce(sum(l_orderkey % 7), 0), 5) AS h0 FROM part LEFT JOIN li ON l_partkey = p_partkey GROUP BY 1")
def by_relation(spark, sf):
    graph, key = g.commerce(spark, sf), ("orders", "contains", "part")
    nodes = {"orders": graph.nodes["orders"].withColumn("x", F.array((F.col("id") % 7).cast("double"))), "part": graph.nodes["part"].withColumn("x", F.array(F.lit(0.0)))}
    out = layers.by_relation(nodes, {key: graph.edges[key].select("src", "dst")}, 1, {key: lambda n, e, w: layers.simple(n, e, w, "sum")})
    return rounded(out[key], width=1)
