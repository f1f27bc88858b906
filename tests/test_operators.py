"""Single operators on tiny graphs with results worked out by hand, and laws that hold on any graph."""

import pytest
from pyspark.sql import functions as F

from tessel.functions.ordering import with_position
from tessel.functions.ranges import range_index, split_points
from tessel.model import GraphError, PropertyGraph
from tessel.operators import features, layers, lookup, losses, metrics, partition, propagate, rewrite, sampling, sparse, subgraph, temporal, traverse
from tessel.operators.components import star_components
from tessel.sources import graph_files
from tessel.streaming import events as streaming


@pytest.fixture(scope="module")
def triangle(spark):
    nodes = spark.range(4).withColumn("x", F.array(F.col("id").cast("double"), F.lit(1.0)))
    edges = spark.createDataFrame([(0, 0, 1, 1, 2.0), (1, 1, 2, 3, 1.0), (2, 2, 0, 5, 1.0), (3, 0, 1, 7, 4.0)], "e_id long, src long, dst long, t long, w double")
    return PropertyGraph.homogeneous(nodes, edges, "t")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())


def test_graph_checks(spark, triangle):
    with pytest.raises(GraphError):
        PropertyGraph.homogeneous(spark.range(1), spark.range(1))
    with pytest.raises(GraphError):
        PropertyGraph.homogeneous(spark.range(2), triangle.edge_table()).check_endpoints()
    with pytest.raises(GraphError):
        PropertyGraph.homogeneous(triangle.node_table(), triangle.edge_table()).snapshot(1)
    assert triangle.snapshot(3).edge_table().count() == 2 and triangle.window(3, 5).edge_table().count() == 2
    assert triangle.register("tri") == ["tri_node", "tri_node_to_node"]
    assert spark.sql("SELECT count(*) AS n FROM tri_node_to_node").first()["n"] == 4


def test_lookups(spark, triangle):
    e = triangle.edge_table()
    asked = spark.createDataFrame([(0, 0, 1), (1, 2, 0), (2, 1, 0)], "pos long, src long, dst long")
    assert pairs(lookup.edge_ids(e, asked), "pos", "e_id") == [(0, 0), (1, 2), (2, None)]
    assert pairs(lookup.edge_ids(e, asked, every=True), "pos", "e_id") == [(0, 0), (0, 3), (1, 2)]
    assert [r["found"] for r in lookup.has_edges(e, asked).orderBy("pos").collect()] == [True, True, False]
    with pytest.raises(GraphError):
        lookup.require_found(lookup.find_edges(e, spark.createDataFrame([(0, 99)], "pos long, e_id long")))
    assert pairs(lookup.degrees(triangle.node_table(), e), "id", "degree") == [(0, 1), (1, 2), (2, 1), (3, 0)]
    assert lookup.degrees(triangle.node_table(), e).agg(F.sum("degree")).first()[0] == e.count()


def test_subgraphs(spark, triangle):
    e = triangle.edge_table().select("e_id", "src", "dst")
    ids = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "pos long, id long")
    nodes, kept = subgraph.node_subgraph(e, ids)
    assert pairs(nodes, "id", "new_id") == [(0, 1), (2, 0)] and pairs(kept, "e_id", "src", "dst") == [(2, 0, 1)]
    with pytest.raises(GraphError):
        subgraph.compact(e, ids)
    sources, _, inner = subgraph.to_block(e, spark.createDataFrame([(0, 1)], "pos long, id long"))
    assert pairs(sources, "id", "new_id") == [(0, 1), (1, 0)] and pairs(inner, "e_id", "src", "dst") == [(0, 1, 0), (3, 1, 0)]


def test_rewrites(spark, triangle):
    e = triangle.edge_table()
    back = rewrite.reverse(rewrite.reverse(e, True), True)
    assert pairs(back, "e_id", "src", "dst", "w") == pairs(e, "e_id", "src", "dst", "w")
    assert pairs(rewrite.to_simple(e, "n"), "src", "dst", "n") == [(0, 1, 2), (1, 2, 1), (2, 0, 1)]
    padded = rewrite.add_self_loops(triangle.node_table(), e)
    assert padded.count() == 8 and padded.where("src = dst and e_id = 0").count() == 4
    minted = rewrite.add_self_loops(triangle.node_table(), e, 1.0)
    assert pairs(minted.where("src = dst"), "e_id", "src", "w") == [(4, 0, 1.0), (5, 1, 1.0), (6, 2, 1.0), (7, 3, 1.0)]
    assert rewrite.to_bidirected(e).count() == 8 and rewrite.to_bidirected(e, copy=True).count() == 7
    line = spark.createDataFrame([(0, 0, 1), (1, 1, 2), (2, 1, 0)], "e_id long, src long, dst long")
    assert pairs(rewrite.line_graph(line), "src", "dst") == [(0, 1), (0, 2), (2, 0)]
    assert pairs(rewrite.line_graph(line, backtracking=False), "src", "dst") == [(0, 1)]


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).unionByName(spark.createDataFrame([(1000, 1001)], "src long, dst long"))
    found = star_components(chain)
    assert pairs(found.groupBy("component").count(), "component", "count") == [(0, 301), (1000, 2)]
    assert star_components(chain.where("false")).collect() == []


def test_positions_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k"))
    got = [r["position"] for r in with_position(df, "k", rows_per_range=100).orderBy("k").collect()]
    assert got == list(range(1000))
    bounds = split_points(df, "k", 10)
    assert df.where(range_index(F.col("k"), bounds) != F.size(F.filter(F.lit(bounds), lambda b: b <= F.col("k")))).count() == 0


def test_sparse_laws(triangle):
    n, e = triangle.node_table(), triangle.edge_table()
    sums = sparse.laplacian(n, e).groupBy("row").agg(F.sum("value").alias("s")).collect()
    assert all(abs(r["s"]) < 1e-12 for r in sums)
    soft = sparse.softmax_by(e, "w", "dst").groupBy("dst").agg(F.sum("weight").alias("s")).collect()
    assert all(abs(r["s"] - 1) < 1e-12 for r in soft)
    pointers, blocks = sparse.compressed(sparse.adjacency(e), n)
    assert pairs(pointers, "major", "first", "n") == [(0, 0, 2), (1, 2, 1), (2, 3, 1), (3, 4, 0)]
    assert pairs(sparse.uncompressed(blocks), "row", "col", "e_id") == pairs(sparse.adjacency(e), "row", "col", "e_id")
    assert pairs(sparse.incidence(e, "out"), "row", "col") == [(0, 0), (0, 3), (1, 1), (2, 2)]


def test_propagation_and_layers(triangle):
    n, e = triangle.node_table(), triangle.edge_table()
    out = {r["id"]: list(r["m"]) for r in propagate.propagate(n, e, 2).collect()}
    assert out == {0: [2.0, 1.0], 1: [0.0, 2.0], 2: [1.0, 1.0], 3: [0.0, 0.0]}
    eye = [[1.0, 0.0], [0.0, 1.0]]
    assert {r["id"]: list(r["h"]) for r in layers.gcn(n, e, 2, eye).collect()} == out
    mean = {r["id"]: list(r["h"]) for r in layers.simple(n, e, 2).collect()}
    assert mean[1] == [0.0, 1.0]
    grouped = n.withColumn("graph_id", F.col("id") % 2)
    graphs = grouped.select("graph_id").distinct().unionByName(grouped.sparkSession.createDataFrame([(9,)], "graph_id long"))
    pooled = {r["graph_id"]: list(r["h"]) for r in propagate.pool(grouped, 2, "max", graphs).collect()}
    assert pooled[0] == [2.0, 1.0] and pooled[9][0] < -3e38


def test_traversal(spark, triangle):
    e = triangle.edge_table()
    seeds = spark.createDataFrame([(0,)], "id long")
    assert pairs(traverse.khop(e, seeds, 1), "id", "hop") == [(0, 0), (1, 1)]
    assert pairs(traverse.khop(e, seeds, 1, "in"), "id") == [(0,), (2,)]
    assert pairs(traverse.expand(e, seeds, [-1]), "id") == [(0,), (1,), (2,)]
    assert traverse.expand(e, seeds, [1]).count() == 2
    typed = traverse.expand_typed(triangle.edges, {"node": seeds}, [-1, -1])
    assert pairs(typed["node"], "id") == [(0,), (1,), (2,)]
    walk = traverse.random_walk([e] * 3, spark.createDataFrame([(7, 0), (8, 3)], "walk long, id long"))
    assert [r["id"] for r in walk.where("walk = 7").orderBy("step").collect()] == [0, 1, 2, 0]
    assert [r["id"] for r in walk.where("walk = 8").orderBy("step").collect()] == [3, -1, -1, -1]


def test_negatives_and_history(spark, triangle):
    e = triangle.edge_table()
    drawn = sampling.uniform_negatives(e, e.where("e_id = 0").select(F.lit(0).alias("q"), "src", "dst"), 50, 4)
    assert {r["dst"] for r in drawn.where("label = 0").collect()} == {0, 2, 3}
    event = spark.createDataFrame([(0, 1, 2, 5)], "q long, src long, dst long, t long")
    assert pairs(sampling.history(e, event), "e_id") == [(0,), (1,)]
    assert pairs(sampling.history(e, event, strict=False, last=2), "e_id") == [(1,), (2,)]
    assert pairs(sampling.history(e, event, strict=False, window=2), "e_id") == [(1,), (2,)]


def test_features_splits_metrics(spark, triangle):
    n = triangle.node_table()
    assert list(features.normalize_rows(n).where("id = 3").first()["x"]) == [0.75, 0.25]
    scaled = features.standardize(n, 2).agg(F.avg(F.col("x")[0]), F.stddev_pop(F.col("x")[0])).first()
    assert abs(scaled[0]) < 1e-12 and abs(scaled[1] - 1) < 1e-12
    parts = features.split_rows(spark.range(10), 2, 0.3).groupBy("part").count()
    assert pairs(parts, "part", "count") == [("test", 3), ("train", 5), ("val", 2)]
    ranked = spark.createDataFrame([(0, 0.5, 1, False), (0, 0.5, 0, False), (0, 0.9, 0, True), (1, 0.1, 1, False), (1, 0.2, 0, False)], "q long, score double, label int, filtered boolean")
    assert metrics.mrr(ranked).first()[0] == 0.5 and metrics.build_metric("filtered_mrr")(ranked).first()[0] == 0.75
    assert metrics.build_metric("hits@1")(ranked).first()[0] == 0 and metrics.build_metric("filtered_hits@1")(ranked).first()[0] == 0.5
    told = spark.createDataFrame([([0.1, 0.9], 1), ([0.8, 0.2], 0)], "logits array<double>, label int")
    assert metrics.accuracy(told).first()[0] == 1.0
    even = told.select(F.avg(losses.cross_entropy(F.array(F.lit(0.0), F.lit(0.0)), F.col("label")))).first()[0]
    assert abs(even - 0.6931471805599453) < 1e-12


def test_messages(spark):
    m = spark.createDataFrame([(1, 5, 3, [1.0]), (1, 5, 2, [2.0]), (1, 4, 1, [6.0])], "id long, t long, pos long, msg array<double>")
    assert list(temporal.last_messages(m).first()["msg"]) == [2.0]
    assert list(temporal.mean_messages(m, 1).first()["msg"]) == [3.0]


def test_partitions_and_files(spark, triangle, tmp_path):
    n, e = triangle.node_table(), triangle.edge_table()
    manifest = partition.write_partitions(n.select("id"), e, str(tmp_path / "p"), 2)
    assert manifest == partition.read_manifest(spark, str(tmp_path / "p")) == {"nodes": 4, "parts": 2, "range": 2}
    nodes, edges = partition.read_partition(spark, str(tmp_path / "p"), 0)
    assert pairs(nodes, "id") == [(0,), (1,)] and pairs(edges, "e_id", "kind") == [(0, "local"), (1, "boundary"), (2, "boundary"), (3, "local")]
    asked = spark.createDataFrame([(0, 3), (1, 9)], "pos long, id long")
    assert pairs(partition.route(asked, 4, 2), "pos", "part", "local") == [(0, 1, 1), (1, None, None)]
    graph_files.write_graph(triangle, str(tmp_path / "g"))
    again = graph_files.read_graph(spark, str(tmp_path / "g"))
    assert again.time == "t" and pairs(again.edge_table(), "e_id", "src", "dst", "w") == pairs(e, "e_id", "src", "dst", "w")
    scalar = PropertyGraph.homogeneous(n.select("id", (F.col("id") * 10).alias("n_id"), (F.col("id") / 2).alias("v")), e)
    graph_files.write_csv_tables(scalar, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    read = graph_files.read_csv_tables(spark, str(tmp_path / "n.csv"), str(tmp_path / "e.csv"))
    assert pairs(read.node_table(), "n_id", "v") == pairs(scalar.node_table(), "n_id", "v")
    assert pairs(read.edge_table(), "e_id", "src", "dst") == pairs(e, "e_id", "src", "dst")
    graph_files.write_edge_list(triangle, str(tmp_path / "l.csv"))
    assert graph_files.read_edge_list(spark, str(tmp_path / "l.csv")).node_table().count() == 3
    assert pairs(graph_files.from_pairs(spark, [[0, 1], [2, 3]]).edge_table(), "src", "dst") == [(0, 2), (1, 3)]
    with pytest.raises(GraphError):
        graph_files.from_pairs(spark, [(0, 1), (1, 2), (2, 5)], nodes=3)


def test_streams(spark, tmp_path):
    rows = spark.sql("SELECT * FROM VALUES (1L, TIMESTAMP_NTZ'2024-01-01 10:00:00', 7L, 'a', 1.0D, '{}'), (2L, TIMESTAMP_NTZ'2024-01-01 10:30:00', 7L, 'a', 2.0D, '{}'), (3L, TIMESTAMP_NTZ'2024-01-03 10:00:00', 7L, 'a', 4.0D, '{}') AS t(event_id, ts, user_id, event_type, value, props)")
    rows.write.parquet(str(tmp_path / "in"))
    source = streaming.read_events(spark, str(tmp_path / "in"))
    streaming.run_to_table(streaming.windowed_activity(source), "activity", str(tmp_path / "c1"), "complete")
    assert pairs(spark.table("activity"), "n", "total") == [(1, 4.0), (2, 3.0)]
    streaming.run_to_table(streaming.latest_value(source), "latest", str(tmp_path / "c2"), "complete")
    assert pairs(spark.table("latest"), "user_id", "value") == [(7, 4.0)]
    streaming.run_to_table(streaming.look_back(source, rows, 3), "looked", str(tmp_path / "c3"))
    assert pairs(spark.table("looked"), "event_id", "past_id") == [(2, 1), (3, 1), (3, 2)]
