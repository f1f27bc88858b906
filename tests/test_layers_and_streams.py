"""Attention over whole graphs beyond one tile, plans of stacked layers, batches, splits, files and late data."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.model import GraphError
from tessel.operators import attention, features, global_attention, propagate, subgraph
from tessel.sources import graph_files
from tessel.streaming import events as streaming
from tessel.streaming import memory

RNG = np.random.default_rng(3)
C, H = 4, 2


def affine(rows, cols):
    return RNG.normal(size=(rows, cols)).round(3).tolist(), RNG.normal(size=rows).round(3).tolist()


def ap(x, w):
    return x @ np.array(w[0]).T + np.array(w[1])


def softmax(v):
    e = np.exp(v - v.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def norm(x):
    return (x - x.mean(-1, keepdims=True)) / np.sqrt(x.var(-1, keepdims=True) + 1e-5)


erf = np.vectorize(math.erf)


def settled(x, more, w):
    y = norm(x + more)
    up = ap(y, w["up"])
    return norm(y + ap(up * (1 + erf(up / math.sqrt(2))) / 2, w["down"]))


def maps():
    return {k: affine(C, C) for k in ("query", "key", "value", "out", "local", "mix")} | {"up": affine(5, C), "down": affine(C, 5)}


SIZES = (150, 1, 65)  # three tiles, one node, one node over a tile
GRAPHS, EDGES = [], []
for g_, n_ in enumerate(SIZES):
    GRAPHS += [(g_, 1000 * g_ + i) for i in range(n_)]
    EDGES += [(1000 * g_ + int(a), 1000 * g_ + int(b)) for a, b in RNG.integers(0, n_, (n_ + 5, 2))]
X = RNG.normal(size=(len(GRAPHS), C))
AT = {i: k for k, (_, i) in enumerate(GRAPHS)}


@pytest.fixture(scope="module")
def collection(spark):
    nodes = spark.createDataFrame([(g, i, X[k].tolist()) for k, (g, i) in enumerate(GRAPHS)], "graph_id long, id long, x array<double>")
    return nodes, spark.createDataFrame(EDGES, "src long, dst long")


def within(x, w, bias=None):
    q, k, v = (ap(x, w[n]).reshape(-1, H, C // H) for n in ("query", "key", "value"))
    score = np.einsum("nhd,mhd->hnm", q, k) / math.sqrt(C // H)
    of = np.array([g for g, _ in GRAPHS])
    score = np.where(of[:, None] == of[None, :], score + (0 if bias is None else bias), -np.inf)
    return ap(np.einsum("hnm,mhd->nhd", softmax(score), v).reshape(len(x), C), w["out"])


def mean_of_sources(x):
    out, n = np.zeros_like(x), np.zeros(len(x))
    for a, b in EDGES:
        out[AT[b]] += x[AT[a]]
        n[AT[b]] += 1
    return out / np.maximum(n, 1)[:, None]


def close(df, want):
    got = {r["id"]: r["h"] for r in df.collect()}
    assert np.allclose([got[i] for _, i in GRAPHS], want, atol=1e-5)


def test_gps_and_sgformer_over_several_tiles(collection):
    w, v = maps(), maps()
    close(global_attention.gps(*collection, w, lambda n, e: propagate.propagate(n, e, C, "mean").select("id", F.col("m").alias("h")), H), settled(X, mean_of_sources(X) + within(X, w), w))
    x = X
    for m in (w, v):
        x = settled(x, ap(0.3 * mean_of_sources(ap(x, m["local"])) + 0.7 * within(x, m), m["mix"]), m)
    close(global_attention.sgformer(*collection, [w, v], 0.3, H), x)


def test_graphormer_over_several_tiles(collection):
    far = np.full((len(GRAPHS), len(GRAPHS)), 4)
    np.fill_diagonal(far, 0)
    near = {i: set() for _, i in GRAPHS}
    for a, b in EDGES:
        near[a].add(b)
        near[b].add(a)
    for _, i in GRAPHS:
        front, seen = {i}, {i}
        for d in (1, 2, 3):
            front = {b for a in front for b in near[a]} - seen
            seen |= front
            for b in front:
                far[AT[i], AT[b]] = d
    w = maps() | {"degree": RNG.normal(size=(4, C)).round(3).tolist(), "spatial": RNG.normal(size=(5, H)).round(3).tolist()}
    count = np.zeros(len(GRAPHS), int)
    for _, b in EDGES:
        count[AT[b]] += 1
    x = X
    for _ in range(2):
        hidden = x + np.array(w["degree"])[np.minimum(count, 3)]
        x = settled(x, within(hidden, w, np.moveaxis(np.array(w["spatial"])[far], -1, 0)), w)
    close(global_attention.graphormer(*collection, [w, dict(w)], 3, H), x)


def test_a_graph_over_the_bound_is_refused(collection):
    with pytest.raises(GraphError):
        global_attention.gps(*collection, maps(), None, H, most=149)


def test_pairs_of_nodes_are_never_rows(collection):
    w = maps()
    plan = global_attention.attended(global_attention.placed_nodes(collection[0]), F.col("x"), w, H)
    rows = int(re.search(r"\d+", str(plan.count())).group())
    text = plan._jdf.queryExecution().toString()
    assert rows == len(GRAPHS) and "Cartesian" not in text and "NestedLoop" not in text


def joins(df) -> int:
    return len(re.findall(r"\bJoin ", df._jdf.queryExecution().optimizedPlan().toString()))


def test_stacks_plan_no_more_joins_than_one_layer(spark):
    nodes = spark.createDataFrame([(i, [0.1 * i] * 4) for i in range(4)], "id long, x array<double>")
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (3, 2, 3.0)], "src long, dst long, t double")
    w = {k: affine(C, C) for k in ("query", "key", "value", "root")} | {"up": affine(5, C), "down": affine(C, 5)}
    one, four = (attention.encoder(nodes, edges, [dict(w) for _ in range(n)]) for n in (1, 4))
    assert joins(four) <= joins(one) and four.count() == 4
    m = [[0.1] * 4] * 4
    t = {"query": m, "key": m, "value": m, "time": [[0.1]] * 4, "frequency": [1.0], "phase": [0.0], "output": affine(C, C), "root": m, "up": w["up"], "down": w["down"]}
    one, three = (attention.tgat_encoder(nodes, edges, [dict(t) for _ in range(n)], now=F.lit(9.0)) for n in (1, 3))
    assert joins(three) <= joins(one)

    def layer(n, e):
        return propagate.propagate(n, e, 1).select("id", F.col("m").alias("h"))

    two, four = (attention.group_reversible(nodes, edges, 4, [layer] * n) for n in (2, 4))
    assert joins(four) <= joins(two)


def test_typed_batches_shift_by_type(spark):
    nodes = {"a": spark.createDataFrame([(5, 0), (5, 1), (7, 0)], "graph_id long, id long"), "b": spark.createDataFrame([(5, 0), (7, 0), (7, 1)], "graph_id long, id long")}
    edges = {("a", "to", "b"): spark.createDataFrame([(5, 1, 0), (7, 0, 1)], "graph_id long, src long, dst long")}
    n, e = subgraph.typed_batch(nodes, edges)
    assert sorted(map(tuple, n["b"].select("graph_id", "id").collect())) == [(5, 0), (7, 1), (7, 2)]
    assert sorted(map(tuple, e["a", "to", "b"].select("src", "dst").collect())) == [(1, 0), (2, 2)]


@pytest.mark.parametrize("ratio", [0, 1, 2, 0.5, 2.3])
def test_split_negatives_are_as_many_as_the_ratio(spark, ratio):
    edges = spark.createDataFrame([(i, i % 11, (i * 7) % 23) for i in range(60)], "e_id long, src long, dst long").dropDuplicates(["src", "dst"])
    links, _ = features.link_split(edges, 0.2, 0.1, seed=2)
    out = features.split_negatives(edges, links, 40, ratio, ("train", "val", "test"), seed=4)
    known = {(r["src"], r["dst"]) for r in edges.collect()}
    rows = out.collect()
    for part in ("train", "val", "test"):
        mine = [r for r in rows if r["part"] == part]
        n = sum(r["label"] for r in mine)
        assert n == links.where(F.col("part") == part).count() and len(mine) - n == int(n * ratio)
    assert all((r["src"], r["dst"]) not in known and 0 <= r["dst"] < 40 for r in rows if not r["label"])


def test_manifests_and_lists_with_data_are_checked(spark):
    good = {"name": "g", "version": "1", "splits": {"train": 2}}
    assert graph_files.checked_manifest(good) == good
    for bad in ({}, {**good, "version": 1}, {**good, "splits": {"train": -1}}, {**good, "splits": {"train": True}}, {**good, "name": ""}, []):
        with pytest.raises(GraphError):
            graph_files.checked_manifest(bad)
    graph = graph_files.from_pairs(spark, [(0, 1), (1, 2), (2, 0)], node_data={"x": [[1, 2], [3, 4], [5, 6]], "y": [1, 0, 1]}, edge_data={"w": [0.5, 1, 2]})
    assert [tuple(r) for r in graph.node_table().orderBy("id").collect()] == [(0, [1.0, 2.0], 1), (1, [3.0, 4.0], 0), (2, [5.0, 6.0], 1)]
    assert [r["w"] for r in graph.edge_table().orderBy("e_id").collect()] == [0.5, 1.0, 2.0]
    with pytest.raises(GraphError):
        graph_files.from_pairs(spark, [(0, 1), (1, 2), (2, 0)], edge_data={"w": [1]})
    with pytest.raises(GraphError):
        graph_files.from_pairs(spark, [(0, 1), (1, 2), (2, 0)], nodes=4, node_data={"y": [1, 2, 3]})


def test_late_rows_are_dropped_and_idle_memory_ends(spark, tmp_path):
    batches = [
        [(1, "2024-01-01 00:00:00", 8.0), (1, "2024-01-01 00:01:00", 1.0), (2, "2024-01-01 00:00:30", 5.0)],
        [(1, "2024-01-01 00:10:00", 2.0)],  # the watermark is 00:05 after this batch
        [(1, "2024-01-01 00:02:00", 100.0), (1, "2024-01-01 00:08:00", 4.0)],  # the first is late, the second isn't
        [(3, "2024-01-01 02:00:00", 7.0)],  # the others have been idle for an hour
        [(3, "2024-01-01 02:01:00", 7.0)],
    ]
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "id long, at string, value double").selectExpr("id", "cast(at as timestamp) at", "value").coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("*.parquet"))
        part.rename(source / f"{i}.parquet")
        import os

        os.utime(source / f"{i}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema("id long, at timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(source))
        streaming.run_to_table(memory.node_memory(stream, "5 minutes", 60.0, 3600.0), "memories", str(tmp_path / "state"))
        rows = [tuple(r) for r in spark.table("memories").select("id", F.date_format("t", "HH:mm:ss").alias("t"), "state", "n", "ended").collect()]
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    one = [r for r in rows if r[0] == 1]
    want = 8 * 0.5 + 1
    assert one[0] == (1, "00:01:00", pytest.approx(want), 2, False)
    want = want * 0.5**9 + 2
    assert one[1] == (1, "00:10:00", pytest.approx(want), 3, False)
    want += 4 * 0.5**2  # the late hundred isn't in it
    assert one[2] == (1, "00:10:00", pytest.approx(want), 4, False)
    assert one[3] == (1, "00:10:00", pytest.approx(want), 4, True)
    assert [r[4] for r in rows if r[0] == 2] == [False, True] and not any(r[4] for r in rows if r[0] == 3)


#: Graphs of one tile among larger ones, with loops, parallel edges and a node without any.
MANY = [*((7, 7000 + i) for i in range(5)), *((8, 8000 + i) for i in range(64)), *((9, 9000 + i) for i in range(66))]


def test_graphs_of_one_tile_are_as_tiles_of_larger_ones(spark, monkeypatch):
    """The rows of small graphs against the general way, which a smaller tile makes all of them take."""
    x = RNG.normal(size=(len(MANY), C))
    pairs = [(int(a), int(b)) for g, n in ((7000, 4), (8000, 64), (9000, 66)) for a, b in g + RNG.integers(0, n, (n * 2, 2))] + [(7000, 7001)] * 3 + [(7002, 7002)]
    nodes = spark.createDataFrame([(g, i, x[k].tolist()) for k, (g, i) in enumerate(MANY)], "graph_id long, id long, x array<double>")
    edges = spark.createDataFrame(pairs, "src long, dst long")
    w = maps() | {"degree": RNG.normal(size=(4, C)).round(3).tolist(), "spatial": RNG.normal(size=(4, H)).round(3).tolist()}

    def local(n, e):
        return propagate.propagate(n, e, C, "mean").select("id", F.col("m").alias("h"))

    def found():
        made = (global_attention.gps(nodes, edges, w, local, H), global_attention.sgformer(nodes, edges, [w, dict(w)], 0.3, H), global_attention.graphormer(nodes, edges, [w, dict(w)], 2, H))
        return [{r["id"]: r["h"] for r in df.collect()} for df in made]

    with_rows = found()
    monkeypatch.setattr(global_attention, "TILE", 4)
    for one, other in zip(with_rows, found(), strict=True):
        assert set(one) == set(other) == {i for _, i in MANY}
        assert np.allclose([one[i] for i in sorted(one)], [other[i] for i in sorted(one)], atol=1e-9)


def test_small_graphs_are_dealt_once(spark):
    """Two layers over graphs of one tile shuffle no more than one: nodes and edges by their graph."""
    nodes = spark.createDataFrame([(g, 10 * g + i, [0.1 * i] * C) for g in range(3) for i in range(3)], "graph_id long, id long, x array<double>")
    edges = spark.createDataFrame([(g, 10 * g, 10 * g + 1) for g in range(3)], "graph_id long, src long, dst long")
    w = maps() | {"degree": [[0.1] * C] * 2, "spatial": [[0.1] * H] * 3}
    for df in (global_attention.sgformer(nodes, edges, [w] * 2, 0.3, H), global_attention.graphormer(nodes, edges, [w] * 2, 1, H)):
        assert df._jdf.queryExecution().executedPlan().toString().count("Exchange") <= 3 and df.count() == 9


def test_small_graphs_are_worked_on_in_batches(spark):
    """No expression is worked out for each entry of a row's arrays; what one graph lacks leaves the others as they are."""
    x = {10: [0.1, 0.4, -0.2, 0.3], 11: [0.5, 0.2, 0.1, -0.4], 12: [0.3, 0.3, 0.9, 0.2]}
    more = {20: [0.7, None, 0.1, 0.2], 21: [0.1, 0.2, 0.3, 0.4], 30: None, 40: [1.0, 2.0, 0.5, 0.1]}
    known = [(1, i, v) for i, v in x.items()]
    edges = [(1, 10, 11), (1, 10, 11), (1, 12, 11), (1, 11, 11), (1, 99, 12)]  # 99 is no node
    w = maps() | {"degree": RNG.normal(size=(4, C)).round(3).tolist(), "spatial": RNG.normal(size=(3, H)).round(3).tolist()}
    near = np.array([[0, 1, 2], [1, 0, 1], [2, 1, 0]])
    want, plain = np.array(list(x.values())), np.array(list(x.values()))
    for _ in range(2):
        hidden = want + np.array(w["degree"])[[0, 3, 1]]
        q, k, v = (ap(hidden, w[n]).reshape(3, H, C // H) for n in ("query", "key", "value"))
        score = np.einsum("nhd,mhd->hnm", q, k) / math.sqrt(C // H) + np.moveaxis(np.array(w["spatial"])[near], -1, 0)
        want = settled(want, ap(np.einsum("hnm,mhd->nhd", softmax(score), v).reshape(3, C), w["out"]), w)
    for nodes in (known, known + [(i // 10, i, v) for i, v in more.items()]):
        frames = spark.createDataFrame(nodes, "graph_id long, id long, x array<double>"), spark.createDataFrame(edges, "graph_id long, src long, dst long")
        df = global_attention.graphormer(*frames, [w, dict(w)], 1, H)
        text = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in text and "lambda" not in text.split("MapInArrow")[0]
        got = {r["id"]: r["h"] for r in df.collect()}
        assert set(got) == {i for _, i, _ in nodes}
        assert np.allclose([got[i] for i in x], want, atol=1e-5)
    assert got[21] == [None] * C and None not in got[40] and not np.allclose(want, plain)
