"""Partitioned graphs: contiguous node ranges, local and boundary edges, routing."""

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_size(nodes: int, parts: int) -> int:
    """Nodes of a partition: the count over the parts, rounded up."""
    return -(-nodes // parts)


def part_of(node: Column, nodes: int, parts: int) -> Column:
    """The partition of a node id counted from 0."""
    return F.floor(node / F.lit(range_size(nodes, parts))).cast("int")


def route(requests: DataFrame, nodes: int, parts: int) -> DataFrame:
    """``(pos, id, part, local)`` of ``requests(pos, id)``; an id out of range has nulls."""
    inside = (F.col("id") >= 0) & (F.col("id") < nodes)
    size = range_size(nodes, parts)
    return requests.select("pos", "id", F.when(inside, part_of(F.col("id"), nodes, parts)).alias("part"), F.when(inside, F.col("id") % size).alias("local"))


def placed_edges(edges: DataFrame, nodes: int, parts: int) -> DataFrame:
    """Edges by partition with ``kind``: ``local`` once, ``boundary`` in the partitions of both ends."""
    a, b = part_of(F.col("src"), nodes, parts), part_of(F.col("dst"), nodes, parts)
    at = F.when(a == b, F.array(a)).otherwise(F.array(a, b))
    return edges.select("*", F.explode(at).alias("part"), F.when(a == b, "local").otherwise("boundary").alias("kind"))


def local_ids(local: DataFrame, nodes: int, parts: int) -> DataFrame:
    """Local edges with ends counted from their partition's first node."""
    size = F.lit(range_size(nodes, parts))
    return local.withColumn("src", F.col("src") % size).withColumn("dst", F.col("dst") % size)


def gather(requests: DataFrame, features: DataFrame, *columns: str) -> DataFrame:
    """``(pos, id, …)``: requested rows of a feature table, repeats kept."""
    return requests.select("pos", "id").join(features.select("id", *columns), "id", "left").select("pos", "id", *columns)


def write_partitions(nodes: DataFrame, edges: DataFrame, path: str, parts: int) -> dict:
    """Write node ranges and placed edges by partition with a manifest; ids count from 0.

    A partition is a directory, so reading one prunes the others.
    """
    n = nodes.count()
    nodes.withColumn("part", part_of(F.col("id"), n, parts)).repartition("part").write.partitionBy("part").parquet(f"{path}/nodes")
    placed_edges(edges, n, parts).repartition("part").write.partitionBy("part", "kind").parquet(f"{path}/edges")
    manifest = {"nodes": n, "parts": parts, "range": range_size(n, parts)}
    nodes.sparkSession.createDataFrame([(json.dumps(manifest),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    return manifest


def read_manifest(spark, path: str) -> dict:
    """The manifest of a partitioned graph."""
    return json.loads(spark.read.text(f"{path}/manifest").first()["value"])


def read_partition(spark, path: str, part: int) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of one partition, boundary edges included."""
    return tuple(spark.read.parquet(f"{path}/{k}").where(F.col("part") == part) for k in ("nodes", "edges"))
