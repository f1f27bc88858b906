"""Layers of heads, types and tokens against loops in numpy, and the link split's laws."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.operators import attention, features, layers

N, C, H = 5, 4, 2
PAIRS = [(0, 1), (2, 1), (3, 1), (1, 0), (4, 0), (0, 2), (1, 2), (1, 2), (3, 3)]  # node 4 has no in-edge
RNG = np.random.default_rng(7)
X = RNG.normal(size=(N, C))
erf = np.vectorize(math.erf)


def matrix(rows, cols):
    return RNG.normal(size=(rows, cols)).round(3)


def affine(rows, cols):
    return matrix(rows, cols), RNG.normal(size=rows).round(3)


def plain(w):
    """Weights as lists."""
    if isinstance(w, dict):
        return {k: plain(v) for k, v in w.items()}
    return tuple(plain(v) for v in w) if isinstance(w, tuple) else w.tolist() if isinstance(w, np.ndarray) else w


def ap(x, w):
    return x @ w[0].T + w[1]


def softmax(v, axis=0):
    e = np.exp(v - v.max(axis=axis, keepdims=True))
    return e / e.sum(axis=axis, keepdims=True)


def norm(x):
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


def gelu(x):
    return x * (1 + erf(x / math.sqrt(2))) / 2


def settle(x, more, w):
    y = norm(x + more)
    return norm(y + ap(gelu(ap(y, w["up"])), w["down"]))


def attended(score, value, size, n=N, pairs=PAIRS):
    """Loops over destinations; ``score(e, h)`` and ``value(e)`` of an edge's number."""
    out = np.zeros((n, H, size))
    for d in range(n):
        into = [e for e, (_, t) in enumerate(pairs) if t == d]
        for h in range(H if into else 0):
            by = softmax(np.array([score(e, h) for e in into]))
            out[d, h] = sum(w * value(e).reshape(H, size)[h] for w, e in zip(by, into, strict=True))
    return out


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, X[i].tolist()) for i in range(N)], "id long, x array<double>")
    edges = spark.createDataFrame([(e, s, d, [e / 9, 1 - e / 9], float(e), 20.0 + e) for e, (s, d) in enumerate(PAIRS)], "e_id long, src long, dst long, pseudo array<double>, t double, now double")
    return nodes, edges


def close(df, want):
    got = np.array([r["h"] for r in df.orderBy("id").collect()])
    assert np.allclose(got, want, atol=1e-5), abs(got - want).max()


def dotted(x, w, size):
    q, k, v = (ap(x, w[n]).reshape(-1, H, size) for n in ("query", "key", "value"))
    return attended(lambda e, h: q[PAIRS[e][1], h] @ k[PAIRS[e][0], h] / math.sqrt(size), lambda e: v[PAIRS[e][0]].ravel(), size)


def gated(x, w, size, concat):
    m = dotted(x, w, size)
    m = m.reshape(N, -1) if concat else m.mean(1)
    r = ap(x, w["root"])
    g = 1 / (1 + np.exp(-ap(np.concatenate([m, r, r - m], -1), w["beta"])))
    return g * r + (1 - g) * m


@pytest.mark.parametrize("concat", [True, False])
def test_transformer(graph, concat):
    out = 6 if concat else 3
    w = {"query": affine(6, C), "key": affine(6, C), "value": affine(6, C), "root": affine(out, C), "beta": affine(out, 3 * out)}
    p = plain(w)
    close(attention.transformer(*graph, p["query"], p["key"], p["value"], H, concat, p["root"], p["beta"]), gated(X, w, 3, concat))


def test_gatv2(graph):
    s, d, a = matrix(6, C), matrix(6, C), matrix(H, 3)
    xs, xd = X @ s.T, X @ d.T
    want = attended(lambda e, h: np.tanh(xs[PAIRS[e][0]] + xd[PAIRS[e][1]]).reshape(H, 3)[h] @ a[h], lambda e: xs[PAIRS[e][0]], 3)
    close(attention.gatv2(*graph, plain(s), plain(d), plain(a), H), want.reshape(N, -1))
    close(attention.gatv2(*graph, plain(s), plain(d), plain(a), H, concat=False), want.mean(1))


def test_encoder_of_two_layers(graph):
    made = [{"query": affine(2 * C, C), "key": affine(2 * C, C), "value": affine(2 * C, C), "root": affine(C, C), "beta": affine(C, 3 * C), "up": affine(5, C), "down": affine(C, 5)} for _ in range(2)]
    x = X
    for w in made:
        x = settle(x, gated(x, w, C, False), w)
    close(attention.encoder(*graph, [plain(w) for w in made], H), x)


def test_heat_of_two_types(spark, graph):
    nodes, _ = graph
    other = RNG.normal(size=(2, C))
    tables = {"a": nodes, "b": spark.createDataFrame([(i, other[i].tolist()) for i in range(2)], "id long, x array<double>")}
    xs = {"a": X, "b": other}
    rels = {("a", "to", "b"): [(0, 0), (1, 0), (4, 1)], ("b", "on", "b"): [(0, 1), (1, 1)], ("b", "back", "a"): [(0, 3), (1, 3), (1, 0)]}
    edges = {k: spark.createDataFrame([(s, d, [e / 2, 1.0]) for e, (s, d) in enumerate(v)], "src long, dst long, attr array<double>") for k, v in rels.items()}
    size, width = 3, 3 * H
    w = {n: {t: matrix(width, C) for t in "ab"} for n in ("query", "key", "value")}
    w |= {"type": {t: matrix(1, width)[0] for t in "ab"}, "relation": {k: matrix(1, width)[0] for k in rels}, "edge": matrix(width, 2), "attention": matrix(1, 4 * size)[0]}
    w |= {"output": {t: affine(2, width) for t in "ab"}, "root": {t: matrix(2, C) for t in "ab"}}
    want = {t: np.zeros((len(xs[t]), width)) for t in "ab"}
    for (a, name, b), ends in rels.items():
        r = w["relation"][a, name, b]
        of = [w["edge"] @ np.array([e / 2, 1.0]) for e in range(len(ends))]

        def score(e, h):
            s, d = ends[e]
            four = (w["query"][b] @ xs[b][d] + w["type"][b], w["key"][a] @ xs[a][s] + w["type"][a], r, of[e])
            return np.tanh(np.concatenate([v.reshape(H, size)[h] for v in four])) @ w["attention"]

        want[b] += attended(score, lambda e: w["value"][a] @ xs[a][ends[e][0]] + r + of[e], size, len(xs[b]), ends).reshape(-1, width)
    got = attention.heat(tables, edges, plain(w), size, H)
    for t in "ab":
        close(got[t], ap(want[t], w["output"][t]) + xs[t] @ w["root"][t].T)


def test_dna(graph):
    nodes, edges = graph
    old = X * X - 0.5
    q, k, v, o = (affine(C, C) for _ in range(4))
    query, keys, values = ap(X, q).reshape(N, H, 2), ap(np.stack([old, X], 1), k).reshape(N, 2, H, 2), ap(np.stack([old, X], 1), v).reshape(N, 2, H, 2)
    s = np.array([[[keys[a, i, h] @ query[b, h] / math.sqrt(2) for i in range(2)] for h in range(H)] for a, b in PAIRS])
    message = [np.stack([softmax(s[e, h]) @ values[a, :, h] for h in range(H)]).ravel() for e, (a, _) in enumerate(PAIRS)]
    want = attended(lambda e, h: s[e, h].max(), lambda e: message[e], 2).reshape(N, C)
    both = nodes.select("id", F.transform("x", lambda a: a * a - 0.5).alias("old"), "x")
    close(attention.dna(both, edges, ["old", "x"], *(plain(w) for w in (q, k, v, o)), heads=H), ap(want, o) + X)


@pytest.mark.parametrize("how", ["mean", "sum"])
def test_spline(graph, how):
    kernels, root = [matrix(2, C) for _ in range(6)], affine(2, C)
    want = np.zeros((N, 2))
    for e, (a, b) in enumerate(PAIRS):
        u = (e / 9, 1 - e / 9)
        basis = [max(0, 1 - abs(u[0] - i / 2) * 2) * max(0, 1 - abs(u[1] - j)) for i in range(3) for j in range(2)]
        want[b] += sum(w * (m @ X[a]) for w, m in zip(basis, kernels, strict=True))
    if how == "mean":
        want /= np.maximum(np.bincount([d for _, d in PAIRS], minlength=N), 1)[:, None]
    close(attention.spline(*graph, [plain(m) for m in kernels], (3, 2), plain(root), how=how), want + ap(X, root))


def test_hop_encoder(graph):
    nodes, edges = graph
    places = matrix(3, C)
    made = [{n: affine(C, C) for n in ("query", "key", "value", "out")} | {"up": affine(6, C), "down": affine(C, 6)} for _ in range(2)]
    degree = np.maximum(np.bincount(np.array(PAIRS).ravel(), minlength=N), 1)
    rounds = [X]
    for _ in range(2):
        moved = np.zeros((N, C))
        for a, b in PAIRS:
            moved[b] += rounds[-1][a] / math.sqrt(degree[a] * degree[b])
        rounds.append(moved)
    tokens = np.stack(rounds, 1) + places
    for w in made:
        q, k, v = (ap(tokens, w[n]).reshape(N, 3, H, 2) for n in ("query", "key", "value"))
        by = softmax(np.einsum("nqhd,nkhd->nhqk", q, k) / math.sqrt(2), -1)
        tokens = settle(tokens, ap(np.einsum("nhqk,nkhd->nqhd", by, v).reshape(N, 3, C), w["out"]), w)
    close(attention.hop_encoder(nodes, edges, C, plain(places), [plain(w) for w in made], H), norm(tokens.mean(1) + X))


def test_group_reversible_and_back(graph):
    nodes, edges = graph
    maps = [matrix(2, 2) for _ in range(2)]
    chosen = [lambda n, e, m=m: layers.gcn(n, e, 2, m.tolist()) for m in maps]
    running, want = X[:, 2:], []
    for g, m in enumerate(maps):
        moved = np.zeros((N, 2))
        for a, b in PAIRS:
            moved[b] += running[a]
        running = X[:, 2 * g : 2 * g + 2] + moved @ m.T
        want.append(running)
    out = attention.group_reversible(nodes, edges, C, chosen)
    close(out, np.concatenate(want, 1))
    close(attention.group_inverse(out.withColumnRenamed("h", "x"), edges, C, chosen), X)


def test_tgat(graph):
    nodes, edges = graph
    made = [{n: matrix(6, C) for n in ("query", "key", "value")} | {"time": matrix(6, 2), "frequency": [0.3, 0.01], "phase": [0.0, 0.5], "output": affine(C, 6), "root": matrix(C, C), "up": affine(5, C), "down": affine(C, 5)} for _ in range(2)]

    def layer(x, w):
        shift = [w["time"] @ np.cos(20.0 * np.array(w["frequency"]) + w["phase"]) for _ in PAIRS]
        q, k, v = (x @ w[n].T for n in ("query", "key", "value"))
        score = lambda e, h: (q[PAIRS[e][1]] * (k[PAIRS[e][0]] + shift[e])).reshape(H, 3)[h].sum() / math.sqrt(3)
        return ap(attended(score, lambda e: v[PAIRS[e][0]] + shift[e], 3).reshape(N, 6), w["output"]) + x @ w["root"].T

    p = plain(made[0])
    close(attention.tgat(nodes, edges, p["query"], p["key"], p["value"], p["time"], p["frequency"], p["phase"], p["output"], p["root"], H), layer(X, made[0]))
    x = X
    for w in made:
        x = settle(x, layer(x, w), w)
    close(attention.tgat_encoder(nodes, edges, [plain(w) for w in made], H), x)


def test_link_split(spark):
    edges = spark.range(60).select(F.col("id").alias("e_id"), (F.col("id") % 7).alias("src"), (F.col("id") % 7 + 1 + F.col("id") % 5).alias("dst"))
    back = edges.select((F.col("e_id") + 100).alias("e_id"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    links, messages = features.link_split(edges, 0.2, 6, seed=3, disjoint=0.25, reverse=back)
    part = {r["e_id"]: r["part"] for r in links.collect()}
    over = {(s, k): set() for s in ("train", "val", "test") for k in ("edge", "reverse")}
    for r in messages.collect():
        over[r["split"], r["kind"]].add(r["e_id"])
    asked = {p: {e for e, q in part.items() if q == p} for p in ("train", "val", "test")}
    assert [len(asked[p]) for p in ("train", "val", "test")] == [10, 12, 6] and len(over["train", "edge"]) == 32
    assert not over["train", "edge"] & set(part) and over["val", "edge"] == over["train", "edge"]
    assert over["test", "edge"] == over["train", "edge"] | asked["val"]
    ends = {r["e_id"]: (r["src"], r["dst"]) for r in edges.collect()}
    for s in ("train", "val", "test"):
        turned = {ends[e] for e in over[s, "edge"]}
        assert over[s, "reverse"] == {e + 100 for e in ends if ends[e] in turned}
    links, messages = features.link_split(edges, 5, 5, seed=3, undirected=True, val_in_test=False)
    assert links.count() == 60 and messages.groupBy("split").count().select("count").distinct().count() == 1
    pairs = links.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "part").distinct()
    assert pairs.groupBy("a", "b").count().where("count > 1").isEmpty()
