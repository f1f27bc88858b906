"""Queries on layers of several heads, of typed nodes, of tokens, of whole graphs, and on their stacks."""

from pyspark.sql import functions as F

from tessel.operators import attention as heads_of
from tessel.operators import global_attention, layers
from tessel.operators.propagate import propagate
from tessel.plans import graphs as g
from tessel.plans.graphs import WIDTH
from tessel.plans.graphs import with_views as views
from tessel.plans.numeric_queries import D, M, ONE, SIGM, W1, W2, W3, X, XD, XS, agg_sql, attention, cols, dotted, edgewise, gelu_sql, layer, lin, named, norm_sql, plus, row, rounded, shown, times, weight
from tessel.plans.registry import query

#: Maps of two heads of three entries each.
Q2, K2, V2 = weight(6, 3), weight(6, 3, 1), weight(6, 3, 2)


def rows_of(w: list[list[float]], h: int, size: int = WIDTH) -> list[list[float]]:
    """One head's rows."""
    return w[h * size : (h + 1) * size]


def two_heads(score, value, source: str = "feat", edges: str = "handoff", size: int = WIDTH) -> str:
    """``SELECT id, m0 .. m<2 * size - 1>``: ``score(h)`` and ``value(h)`` are a head's SQL."""
    one = [f"({attention(score(h), value(h), edges=edges).replace('JOIN feat ', f'JOIN {source} ')})" for h in range(2)]
    picked = ", ".join(f"{'ab'[h]}.m{i} AS m{h * size + i}" for h in range(2) for i in range(size))
    return f"SELECT id, {picked} FROM {one[0]} a JOIN {one[1]} b USING (id)"


def scaled(q, k, size: int = WIDTH) -> callable:
    return lambda h: f"{dotted(lin(XD, rows_of(q, h, size)), lin(XS, rows_of(k, h, size)))} / sqrt({float(size)})"


def mean_heads(size: int = WIDTH) -> list[str]:
    return [f"((m{i} + m{i + size}) / 2)" for i in range(size)]


DOT2 = two_heads(scaled(Q2, K2), lambda h: lin(XS, rows_of(V2, h)))
BETA = weight(3, 9, 1)


def gated_sql(m: list[str], r: list[str]) -> list[str]:
    gate = [SIGM.format(c) for c in lin(m + r + plus(r, times(m, -1)), BETA)]
    return [f"({a} * {b} + (1 - {a}) * {c})" for a, b, c in zip(gate, r, m, strict=True)]


def affine(w):
    return (w, None)


_MAPS = {"query": affine(Q2), "key": affine(K2), "value": affine(V2), "root": affine(W1), "beta": affine(BETA), "up": affine(weight(6, 3)), "down": affine(weight(3, 6))}
layer("transformer_heads", f"SELECT id, {shown(gated_sql(mean_heads(), lin(X, W1)))} FROM feat JOIN ({DOT2}) USING (id)")(
    lambda n, e: heads_of.transformer(n, e, affine(Q2), affine(K2), affine(V2), 2, False, affine(W1), affine(BETA)))
_ADDED = two_heads(lambda h: dotted([f"tanh({c})" for c in plus(lin(XS, rows_of(V2, h)), lin(XD, rows_of(Q2, h)))], row(3, h)), lambda h: lin(XS, rows_of(V2, h)))
layer("gatv2_heads", f"SELECT id, {shown(cols('m', 6))} FROM ({_ADDED})", width=6)(lambda n, e: heads_of.gatv2(n, e, V2, Q2, [row(3), row(3, 1)], 2))


def settled_sql(x: list[str], more: list[str], source: str, name: str, keys: str = "id") -> str:
    """Clauses ``<name>_one`` and ``<name>`` of a residual and feed-forward step over ``source``."""
    fed = plus(X, lin([gelu_sql(c) for c in lin(X, weight(6, 3))], weight(3, 6)))
    one = f"{name}_one AS MATERIALIZED (SELECT {keys}, {named(norm_sql(cols('z')), 'x')} FROM (SELECT {keys}, {named(plus(x, more), 'z')} FROM {source}))"
    return f"{one},\n{name} AS MATERIALIZED (SELECT {keys}, {named(norm_sql(cols('z')), 'x')} FROM (SELECT {keys}, {named(fed, 'z')} FROM {name}_one))"


def stacked(attend, more) -> str:
    """Two layers: ``attend(source)`` is SQL for what arrives, ``more`` the SQL of what is added."""
    return "l0 AS (SELECT * FROM feat)" + "".join(",\n" + settled_sql(X, more, f"l{k} JOIN ({attend(f'l{k}')}) USING (id)", f"l{k + 1}") for k in range(2))


_ENCODED = stacked(lambda s: two_heads(scaled(Q2, K2), lambda h: lin(XS, rows_of(V2, h)), s), gated_sql(mean_heads(), lin(X, W1)))
layer("encoder", f"SELECT id, {shown(X)} FROM l2", more=_ENCODED)(lambda n, e: heads_of.encoder(n, e, [_MAPS, dict(_MAPS)], 2))

_NOW, _T = 1_700_000_000.0, "(e.t / 1e6)"
_TIME = weight(6, 2)
_CLOCK = [f"cos(({_NOW} - {_T}) * 1e-6)", f"cos(({_NOW} - {_T}) * 1e-7 + 0.5)"]


def _aged(w, h):
    return plus(lin(XS, rows_of(w, h)), lin(_CLOCK, rows_of(_TIME, h)))


def aged_heads(source: str) -> str:
    return two_heads(lambda h: f"{dotted(lin(XD, rows_of(Q2, h)), _aged(K2, h))} / sqrt(3.0)", lambda h: _aged(V2, h), source)


def _seconds(e):
    return e.withColumn("t", F.col("t") / 1e6)


_OUT = weight(3, 6, 2)
layer("tgat", f"SELECT id, {shown(plus(lin(cols('m', 6), _OUT), lin(X, W1)))} FROM feat JOIN ({aged_heads('feat')}) USING (id)")(
    lambda n, e: heads_of.tgat(n, _seconds(e), Q2, K2, V2, _TIME, [1e-6, 1e-7], [0.0, 0.5], affine(_OUT), W1, 2, F.lit(_NOW)))
_TGAT = {"query": Q2, "key": K2, "value": V2, "time": _TIME, "frequency": [1e-6, 1e-7], "phase": [0.0, 0.5], "output": affine(_OUT), "root": W1, "up": _MAPS["up"], "down": _MAPS["down"]}
layer("tgat_encoder", f"SELECT id, {shown(X)} FROM l2", more=stacked(aged_heads, plus(lin(cols("m", 6), _OUT), lin(X, W1))))(
    lambda n, e: heads_of.tgat_encoder(n, _seconds(e), [_TGAT, dict(_TGAT)], 2, F.lit(_NOW)))

_LOOPED = "looped AS (SELECT src, dst FROM handoff WHERE src <> dst UNION ALL SELECT id, id FROM users)"


def _leaky(h):
    raw = f"({dotted(lin(XS, rows_of(V2, h)), row(3, h))} + {dotted(lin(XD, rows_of(V2, h)), row(3, h + 1))})"
    return f"greatest({raw}, 0.2 * {raw})"


layer("supergat", f"SELECT id, {shown(cols('m', 6))} FROM ({two_heads(_leaky, lambda h: lin(XS, rows_of(V2, h)), edges='looped')})", more=_LOOPED, width=6)(
    lambda n, e: heads_of.supergat(n, e, V2, [row(3), row(3, 1)], [row(3, 1), row(3, 2)], 2))
_SELF = two_heads(lambda h: f"{dotted(lin(XS, rows_of(V2, h)), lin(XD, rows_of(V2, h)))} / sqrt(3.0)", lambda h: lin(XS, rows_of(V2, h)), edges="looped")
layer("supergat_dot", f"SELECT id, {shown(mean_heads())} FROM ({_SELF})", more=_LOOPED)(lambda n, e: heads_of.supergat(n, e, V2, [], [], 2, False, "SD"))

_BOTH = XS + XD
_UNIT = plus(M, X)
layer("general", f"SELECT id, {shown([f'({c}) / greatest(sqrt({dotted(_UNIT, _UNIT)}), 1e-12)' for c in _UNIT])} " + ONE.format(edgewise(lin(_BOTH, weight(3, 6)))))(
    lambda n, e: heads_of.general(n, e, affine(weight(3, 6)), l2_normalize=True))
_WEIGHED = two_heads(lambda h: dotted(_BOTH, row(6, h)), lambda h: lin(_BOTH, rows_of(weight(6, 6), h)))
layer("general_attention", f"SELECT id, {shown(plus(cols('m', 6), lin(X, Q2)))} FROM feat JOIN ({_WEIGHED}) USING (id)", width=6)(
    lambda n, e: heads_of.general(n, e, affine(weight(6, 6)), affine(Q2), attention=[row(6), row(6, 1)], heads=2))


# typed nodes: users of even and of odd ids

_TYPES = "ev AS (SELECT * FROM feat WHERE id % 2 = 0), od AS (SELECT * FROM feat WHERE id % 2 = 1)"
_RELS = {("even", "on", "odd"): (0, 1), ("odd", "on", "even"): (1, 0), ("even", "by", "even"): (0, 0)}


def _typed(spark, sf):
    n, e = g.feat(spark, sf), g.handoff(spark, sf).select("src", "dst", F.array(F.col("value") / 100).alias("attr"))
    return {"even": n.where("id % 2 = 0"), "odd": n.where("id % 2 = 1")}, {k: e.where(f"src % 2 = {a} AND dst % 2 = {b}") for k, (a, b) in _RELS.items()}


def typed(name: str, score, value, out, more_weights) -> None:
    """Register a typed layer: ``score(k, h)`` and ``value(k, h)`` are SQL of a relation ``k``'s head."""
    clauses, sums = [_TYPES], {"even": [], "odd": []}
    for i, (k, (a, b)) in enumerate(_RELS.items()):
        clauses.append(f"e{i} AS (SELECT * FROM handoff WHERE src % 2 = {a} AND dst % 2 = {b})")
        clauses.append(f"r{i} AS ({two_heads(lambda h, k=k: score(k, h), lambda h, k=k: value(k, h), edges=f'e{i}')})")
        sums[k[2]].append(f"r{i}")
    body = []
    for t, part in (("even", "ev"), ("odd", "od")):
        total = plus(*[[f"{r}.m{i}" for i in range(6)] for r in sums[t]])
        body.append(f"SELECT id, {shown(out(t, total))} FROM {part} " + " ".join(f"JOIN {r} USING (id)" for r in sums[t]))

    def run(spark, sf):
        nodes, edges = _typed(spark, sf)
        found = more_weights(nodes, edges)
        return rounded(found["even"].unionByName(found["odd"]))

    query(name, views("handoff", "feat", more=",\n".join(clauses)) + " UNION ALL ".join(body))(run)


_NAMES = list(_RELS)
_BY = {t: weight(6, 3, i) for i, t in enumerate(("even", "odd"))}
_KEYS, _VALUES = {k: weight(6, 3, i + 1) for i, k in enumerate(_NAMES)}, {k: weight(6, 3, i + 2) for i, k in enumerate(_NAMES)}
_EDGE = {k: weight(6, 1, i) for i, k in enumerate(_NAMES)}
_LAST, _ROOT = {"even": (weight(3, 6), row(3)), "odd": (weight(3, 6, 1), row(3, 1))}, {"even": W1, "odd": W2}
_ATTR = ["e.value / 100"]


def _output(t, total):
    return plus(lin(total, _LAST[t][0]), [str(v) for v in _LAST[t][1]], lin(X, _ROOT[t]))


typed(
    "rgat",
    lambda k, h: f"{dotted(lin(XD, rows_of(_BY[k[2]], h)), plus(lin(XS, rows_of(_KEYS[k], h)), lin(_ATTR, rows_of(_EDGE[k], h))))} / sqrt(3.0)",
    lambda k, h: plus(lin(XS, rows_of(_VALUES[k], h)), lin(_ATTR, rows_of(_EDGE[k], h))),
    _output,
    lambda n, e: heads_of.rgat(n, e, {"query": _BY, "key": _KEYS, "value": _VALUES, "edge": _EDGE, "output": _LAST, "root": _ROOT}, WIDTH, 2),
)
_DEEP_K, _DEEP_V = {k: weight(6, 6, i) for i, k in enumerate(_NAMES)}, {k: weight(6, 6, i + 1) for i, k in enumerate(_NAMES)}
_OWN_K, _OWN_V = {"even": weight(6, 3, 3), "odd": weight(6, 3, 4)}, {"even": weight(6, 3, 1), "odd": weight(6, 3, 2)}
typed(
    "hgt",
    lambda k, h: f"{dotted(lin(XD, rows_of(_BY[k[2]], h)), lin(lin(XS, _OWN_K[k[0]]), rows_of(_DEEP_K[k], h)))} / sqrt(3.0)",
    lambda k, h: lin(lin(XS, _OWN_V[k[0]]), rows_of(_DEEP_V[k], h)),
    _output,
    lambda n, e: heads_of.hgt(n, e, {"query": _BY, "key": _OWN_K, "value": _OWN_V, "relation_key": _DEEP_K, "relation_value": _DEEP_V, "output": _LAST, "root": _ROOT}, WIDTH, 2),
)
_KIND, _LINK, _SCORE = {"even": row(6), "odd": row(6, 1)}, {k: row(6, i + 2) for i, k in enumerate(_NAMES)}, row(12)
_EDGES = weight(6, 1, 1)


def _four(k, h):
    at = slice(3 * h, 3 * h + 3)
    q = plus(lin(XD, rows_of(_BY[k[2]], h)), [str(v) for v in _KIND[k[2]][at]])
    key = plus(lin(XS, rows_of(_OWN_K[k[0]], h)), [str(v) for v in _KIND[k[0]][at]])
    return q + key + [str(v) for v in _LINK[k][at]] + lin(_ATTR, rows_of(_EDGES, h))


typed(
    "heat",
    lambda k, h: dotted([f"tanh({c})" for c in _four(k, h)], _SCORE),
    lambda k, h: plus(lin(XS, rows_of(_OWN_V[k[0]], h)), [str(v) for v in _LINK[k][3 * h : 3 * h + 3]], lin(_ATTR, rows_of(_EDGES, h))),
    _output,
    lambda n, e: heads_of.heat(n, e, {"query": _BY, "key": _OWN_K, "value": _OWN_V, "type": _KIND, "relation": _LINK, "edge": _EDGES, "attention": _SCORE, "output": _LAST, "root": _ROOT}, WIDTH, 2),
)


# histories, splines, hops, reversible groups

_H0, _H1 = (lambda a: [f"{a}.x{i} * 0.5 + 0.1" for i in D]), (lambda a: [f"{a}.x{i}" for i in D])


def _dna_sql() -> str:
    s = [f"{dotted(lin(XD, W1), lin(t, W2))} / sqrt(3.0)" for t in (_H0("s"), _H1("s"))]
    e = [f"exp({c} - greatest({s[0]}, {s[1]}))" for c in s]
    value = [f"({a} * {e[0]} + {b} * {e[1]}) / ({e[0]} + {e[1]})" for a, b in zip(lin(_H0("s"), W3), lin(_H1("s"), W3), strict=True)]
    return attention(f"greatest({s[0]}, {s[1]})", value)


layer("dna", f"SELECT id, {shown(plus(lin(M, W1), X))} " + ONE.format(_dna_sql()))(
    lambda n, e: heads_of.dna(n.withColumn("old", F.transform("x", lambda v: v * 0.5 + 0.1)), e, ["old", "x"], affine(W1), affine(W2), affine(W3), affine(W1)))
_U = "least(greatest(e.value / 100, 0), 1)"
_HATS = [f"greatest(1 - abs({_U} - {j} / 2.0) * 2, 0)" for j in range(3)]
layer("spline", f"SELECT id, {shown(plus(M, lin(X, W2)))} " + ONE.format(edgewise(plus(*[times(lin(XS, weight(3, 3, j)), _HATS[j]) for j in range(3)]), "mean")))(
    lambda n, e: heads_of.spline(n, e.withColumn("pseudo", F.array(F.col("value") / 100)), [weight(3, 3, j) for j in range(3)], (3,), affine(W2)))

_PLACES = [row(3), row(3, 1), row(3, 2)]


def _hops_sql() -> str:
    out = "r0 AS (SELECT * FROM feat)" + "".join(f",\nr{k} AS (SELECT id, {named(M, 'x')} FROM ({agg_sql(f'r{k - 1}', 'sym')}))" for k in (1, 2))
    token = [plus([f"r{k}.x{i}" for i in D], [str(v) for v in _PLACES[k]]) for k in range(3)]
    out += ",\ntk AS MATERIALIZED (SELECT id, " + ", ".join(f"{c} AS p{k}_{i}" for k in range(3) for i, c in enumerate(token[k])) + " FROM r0 JOIN r1 USING (id) JOIN r2 USING (id))"
    p = [[f"p{k}_{i}" for i in D] for k in range(3)]
    picked = []
    for k in range(3):
        s = [f"exp({dotted(lin(p[k], W1), lin(p[j], W2))} / sqrt(3.0))" for j in range(3)]
        seen = [f"({' + '.join(f'{lin(p[j], W3)[i]} * {s[j]}' for j in range(3))}) / ({' + '.join(s)})" for i in D]
        picked += [f"{c} AS q{k}_{i}" for i, c in enumerate(plus(p[k], lin(seen, W1)))]
    out += f",\natt AS MATERIALIZED (SELECT id, {', '.join(picked)} FROM tk)"
    for a, b, step in (("att", "n1", norm_sql), ("n1", "f1", lambda v: plus(v, lin([gelu_sql(c) for c in lin(v, weight(6, 3))], weight(3, 6)))), ("f1", "n2", norm_sql)):
        out += f",\n{b} AS MATERIALIZED (SELECT id, " + ", ".join(f"{c} AS q{k}_{i}" for k in range(3) for i, c in enumerate(step([f"q{k}_{i}" for i in D]))) + f" FROM {a})"
    mean = [f"((q0_{i} + q1_{i} + q2_{i}) / 3)" for i in D]
    return out + f",\npooled AS MATERIALIZED (SELECT id, {named(plus(mean, X), 'z')} FROM n2 JOIN feat USING (id))"


layer("hop_encoder", f"SELECT id, {shown(norm_sql(cols('z')))} FROM pooled", more=_hops_sql())(
    lambda n, e: heads_of.hop_encoder(n, e, WIDTH, _PLACES, [{"query": affine(W1), "key": affine(W2), "value": affine(W3), "out": affine(W1), "up": _MAPS["up"], "down": _MAPS["down"]}]))


def _half(n, e):
    """A layer of one entry: half the mean of the sources."""
    return propagate(n, e, 1, "mean").select("id", F.transform("m", lambda v: v * 0.5).alias("h"))


_REV = "y0 AS (SELECT id, x1 + x2 AS x0 FROM feat)"
for _i in D:
    _REV += f",\ny{_i + 1} AS MATERIALIZED (SELECT id, x{_i} + m0 * 0.5 AS x0 FROM (SELECT id, x{_i} FROM feat) JOIN ({agg_sql(f'y{_i}', 'mean', 1)}) USING (id))"
layer("group_reversible", f"SELECT id, {shown([f'y{i + 1}.x0' for i in D])} FROM y1 JOIN y2 USING (id) JOIN y3 USING (id)", more=_REV)(lambda n, e: heads_of.group_reversible(n, e, WIDTH, [_half] * 3))
layer("group_inverse", f"SELECT id, {shown(X)} FROM feat")(
    lambda n, e: heads_of.group_inverse(heads_of.group_reversible(n, e, WIDTH, [_half] * 3).withColumnRenamed("h", "x"), e, WIDTH, [_half] * 3))


# whole graphs: the lines of an order, each leading to the next

_LINES = """nd AS (SELECT l_orderkey AS graph_id, e_id AS id, l_quantity / 50 AS x0, l_discount * 10 AS x1, l_tax * 10 AS x2 FROM li),
ed AS (SELECT * FROM (SELECT e_id AS src, lead(e_id) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, e_id) AS dst FROM li) WHERE dst IS NOT NULL)"""


def _orders(spark, sf):
    from pyspark.sql import Window as W

    lines = g.li(spark, sf)
    x = F.array(F.col("l_quantity") / 50, F.col("l_discount") * 10, F.col("l_tax") * 10)
    nodes = lines.select(F.col("l_orderkey").alias("graph_id"), F.col("e_id").alias("id"), x.alias("x"))
    following = F.lead("e_id").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "e_id"))
    return nodes, lines.select(F.col("l_orderkey").alias("graph_id"), F.col("e_id").alias("src"), following.alias("dst")).where("dst is not null")


_GQ, _GK, _GV = (weight(4, 3, i) for i in range(3))
_WHOLE = {"query": affine(_GQ), "key": affine(_GK), "value": affine(_GV), "out": (weight(3, 4), row(3)), "up": _MAPS["up"], "down": _MAPS["down"]}


def all_pairs(source: str, bias: str = "0", extra: str = "") -> str:
    """``SELECT id, a0 ..``: attention of two heads of two entries within each graph, mapped."""
    parts = []
    for h in range(2):
        score = f"{dotted(lin(XD, rows_of(_GQ, h, 2)), lin(XS, rows_of(_GK, h, 2)))} / sqrt(2.0) + {bias.format(h=h)}"
        value = lin(XS, rows_of(_GV, h, 2))
        soft = f"SELECT id, exp(sc - max(sc) OVER (PARTITION BY id)) AS ex, v0, v1 FROM (SELECT d.id, {score} AS sc, {named(value, 'v')} FROM {source} d JOIN {source} s ON s.graph_id = d.graph_id {extra})"
        parts.append(f"(SELECT id, sum(v0 * ex) / sum(ex) AS w0, sum(v1 * ex) / sum(ex) AS w1 FROM ({soft}) GROUP BY id)")
    got = lin(["a.w0", "a.w1", "b.w0", "b.w1"], weight(3, 4))
    return f"SELECT id, {named([f'({c} + {v})' for c, v in zip(got, row(3), strict=True)], 'a')} FROM {parts[0]} a JOIN {parts[1]} b USING (id)"


def near_sql(source: str, f: str = "avg") -> str:
    return f"SELECT n.id, {', '.join(f'coalesce({f}(s.x{i}), 0) AS m{i}' for i in D)} FROM nd n LEFT JOIN ed e ON e.dst = n.id LEFT JOIN {source} s ON s.id = e.src GROUP BY n.id"


def whole_settled(source: str, x: list[str], more: list[str], name: str) -> str:
    return settled_sql(x, more, source, name, "graph_id, id")


def whole(name: str, more: str, last: str, f) -> None:
    query(name, views("li", more=_LINES + ",\n" + more) + f"SELECT id, {shown(X)} FROM {last}")(lambda spark, sf: rounded(f(*_orders(spark, sf))))


A3 = cols("a")
_GPS = whole_settled(f"nd JOIN ({all_pairs('nd')}) USING (id) JOIN ({near_sql('nd', 'sum')}) USING (id)", X, plus(lin(M, W1), A3), "l1")
whole("gps", _GPS, "l1", lambda n, e: global_attention.gps(n, e, _WHOLE, lambda a, b: layers.gcn(a, b, WIDTH, W1), 2))
_SG = ""
for _i, _s in ((1, "nd"), (2, "l1")):
    _mapped = f"u{_i} AS MATERIALIZED (SELECT id, {named(lin(X, W2), 'x')} FROM {_s})"
    _mix = lin(plus(times(M, 0.3), times(A3, 0.7)), W3)
    _SG += ("" if _i == 1 else ",\n") + _mapped + ",\n" + whole_settled(f"{_s} JOIN ({all_pairs(_s)}) USING (id) JOIN ({near_sql(f'u{_i}')}) USING (id)", X, _mix, f"l{_i}")
_SG_MAPS = _WHOLE | {"local": affine(W2), "mix": affine(W3)}
whole("sgformer", _SG, "l2", lambda n, e: global_attention.sgformer(n, e, [_SG_MAPS, dict(_SG_MAPS)], 0.3, 2))

_DEGREE, _SPATIAL = [row(3, k) for k in range(4)], [[0.5, -0.25], [0.25, 0.5], [-0.5, 0.0], [0.1, -0.1]]
_BFS = """both_ways AS (SELECT src AS a, dst AS b FROM ed UNION SELECT dst, src FROM ed),
far AS (SELECT a AS id, b AS other, 1 AS d FROM both_ways UNION SELECT x.a, y.b, 2 FROM both_ways x JOIN both_ways y ON x.b = y.a),
near_by AS (SELECT id, other, min(d) AS d FROM far WHERE id <> other GROUP BY ALL), dg AS (SELECT n.id, least(count(e.src), 3) AS k FROM nd n LEFT JOIN ed e ON e.dst = n.id GROUP BY n.id)"""

def _bias(h: int) -> str:
    return "CASE CASE WHEN d.id = s.id THEN 0 ELSE coalesce(nb.d, 3) END " + " ".join(f"WHEN {k} THEN {_SPATIAL[k][h]}" for k in range(4)) + " END"


def _formed(source: str, k: int) -> str:
    """Clauses of one layer: the degree is added before the attention, which adds to the plain vector."""
    shift = ["CASE k " + " ".join(f"WHEN {j} THEN {_DEGREE[j][i]}" for j in range(4)) + " END" for i in D]
    shifted = f"s{k} AS MATERIALIZED (SELECT graph_id, id, {named(plus(X, shift), 'x')} FROM {source} JOIN dg USING (id))"
    body = all_pairs(f"s{k}", "{{h}}", "LEFT JOIN near_by nb ON nb.id = d.id AND nb.other = s.id")
    for h in range(2):
        body = body.replace("{h}", _bias(h), 1)
    return shifted + ",\n" + whole_settled(f"{source} JOIN ({body}) USING (id)", X, A3, f"l{k}")


whole("graphormer", _BFS + ",\n" + _formed("nd", 1) + ",\n" + _formed("l1", 2), "l2",
      lambda n, e: global_attention.graphormer(n, e, [_WHOLE | {"degree": _DEGREE, "spatial": _SPATIAL}] * 2, 2, 2))
