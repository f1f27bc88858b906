"""One key with most of the rows, features of whole vectors and expressions against plain programs."""

import itertools
import math

import pytest
from pyspark.sql import functions as F

from tessel.functions.joins import join_back
from tessel.functions.vectors import gelu
from tessel.operators import components, rewrite, sampling, sparse
from tessel.operators.components import star_components
from tessel.plans import staging


@pytest.fixture
def splitting(spark):
    """Adaptive execution that splits small partitions too."""
    wanted = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def most_in_a_task(df) -> int:
    parts = df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("v"), F.sum("w")).collect()
    return max(r["n"] for r in parts)


def test_a_hot_key_is_split(spark, splitting, tmp_path):
    rows = spark.range(400_000).select(F.when(F.col("id") % 10 < 9, 0).otherwise(F.col("id")).alias("k"), F.rand(1).alias("v"), F.rand(2).alias("w"))
    rows.repartition(16).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    joined = join_back(rows, rows.groupBy("k").agg(F.max("v").alias("top")), "k")
    assert joined.count() == 400_000
    assert most_in_a_task(joined) < 250_000
    assert most_in_a_task(sparse.softmax_by(rows, "v", "k")) < 250_000


def test_unfinished_components_are_an_error(spark):
    chain = spark.range(200).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    with pytest.raises(RuntimeError):
        star_components(chain, max_rounds=1)
    assert {r["component"] for r in star_components(chain).collect()} == {0}


def test_gelu(spark):
    values = [-9.0, -3.0, -1.0, -0.1, 0.0, 0.1, 0.5, 2.0, 9.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(gelu(F.col("v"))).collect()]
    assert got == pytest.approx([v * 0.5 * (1 + math.erf(v / math.sqrt(2))) for v in values], abs=2e-7)


def test_negatives_of_a_source_without_known_destinations(spark):
    edges = spark.createDataFrame([(1, 0)], "src long, dst long")
    positives = spark.createDataFrame([(9, 5, 77)], "q long, src long, dst long")
    drawn = sampling.uniform_negatives(edges, positives, 4, 10).where("label = 0").collect()
    assert len(drawn) == 4 and all(0 <= r["dst"] < 10 for r in drawn)


def test_line_graph_and_components_match_plain_programs(spark):
    pairs = [(0, 1), (1, 2), (2, 0), (1, 0), (4, 5), (5, 5), (7, 8)]
    edges = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "e_id long, src long, dst long")
    want = {(i, j) for i, (a, b) in enumerate(pairs) for j, (c, d) in enumerate(pairs) if b == c and a != d}
    assert {tuple(r) for r in rewrite.line_graph(edges, backtracking=False).collect()} == want
    assert {r["id"]: r["component"] for r in star_components(edges).collect()} == {0: 0, 1: 0, 2: 0, 4: 4, 5: 4, 7: 7, 8: 7}


def test_hand_off_across_ranges(spark):
    from tessel.plans import graphs
    from tessel.sources.tables import table

    sf = "/root/testdata/sf0.001"
    events = sorted((r["ts"], r["event_id"], r["user_id"]) for r in table(spark, sf, "events").collect())
    want = {(a[1], a[2], b[2]) for a, b in itertools.pairwise(events)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = graphs._handoff(spark, sf).select("e_id", "src", "dst")
        assert {tuple(r) for r in got.collect()} == want and got.count() == 999
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {tuple(r) for r in graphs.handoff(spark, sf).select("e_id", "src", "dst").collect()} == want


def test_temporary_tables_go(spark):
    from tessel.plans.staging import staged, temporary

    with temporary(spark):
        gone, kept = staged(spark.range(3).toDF("x"), "gone"), staged(spark.range(3).toDF("x"), "kept", keep=True)
        assert gone.count() == 3
    assert kept.count() == 3
    path = gone.inputFiles()[0].removeprefix("file:")
    import os

    assert not os.path.exists("/" + path.lstrip("/"))


def test_mirrors_are_made_once(spark):
    edges = spark.createDataFrame([(0, 1, 2, 0.5), (1, 2, 1, 0.5), (2, 3, 1, 0.7), (3, 3, 1, 0.9)], "e_id long, src long, dst long, w double")
    found = rewrite.to_bidirected(edges, copy=True)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in edges.collect()} | {(4, 1, 3, 0.7)}
    assert "Join LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_components_bound_what_a_task_holds(spark, monkeypatch):
    advisory, first = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    keys = (advisory, "spark.sql.files.maxPartitionBytes", first)
    before, seen, plain = {k: spark.conf.get(k, None) for k in keys}, [], components._contracted
    monkeypatch.setattr(components, "_contracted", lambda links: seen.append([spark.conf.get(k) for k in keys]) or plain(links))
    monkeypatch.setattr(staging, "TASK_ROWS", 1)
    edges = spark.createDataFrame([(i, i, i + 1) for i in range(600)], "e_id long, src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(700)], "id long")
    got = [(r["id"], r["component"], r["new_id"]) for r in rewrite.largest_components(nodes, edges, 1)[0].orderBy("id").collect()]
    assert got == [(i, 0, i) for i in range(601)]
    assert seen and all(int(a[:-1]) <= staging.TASK_BYTES >= int(b[:-1]) and int(n) >= 600 for a, b, n in seen)
    assert {k: spark.conf.get(k, None) for k in keys} == before
    with pytest.raises(KeyError), staging.small_tasks(spark):
        raise KeyError
    assert {k: spark.conf.get(k, None) for k in keys} == before
