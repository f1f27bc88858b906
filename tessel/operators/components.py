"""Weakly connected components over an edge table of any size."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.joins import join_back
from tessel.plans.staging import drop_path, scratch_path, small_tasks


def star_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id on an edge; the component is its smallest id.

    Alternates the large-star and small-star contractions, which converge in a number of rounds
    logarithmic in the component size, long chains included.  Every round is two aggregates and
    two equi-joins, in which adaptive execution can split hub nodes, and leaves its links as a
    table in the shared folder in place of the last round's: small tables are read again by few
    tasks, whatever number wrote them.  What a task holds is bounded (:func:`small_tasks`).  Self-loops and nulls are ignored; an empty input gives
    an empty result.  Contractions that haven't converged after ``max_rounds`` raise an error:
    no unfinished component is returned.
    """
    spark = edges.sparkSession
    a, b = F.col(src), F.col(dst)
    links = edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    path = scratch_path(spark, "star")
    with small_tasks(spark):
        links.write.parquet(path)
        links = spark.read.schema(links.schema).parquet(path)
        rows = links.count()
    with small_tasks(spark, rows):
        links = _rounds(links, path, max_rounds)
    roots = links.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)


def _rounds(links: DataFrame, path: str, max_rounds: int) -> DataFrame:
    """The contracted links, a table in place of that in ``path``."""
    spark = links.sparkSession
    for _ in range(max_rounds):
        if _contracted(links):
            return links
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "v")
        large = join_back(links, low, "v").select("u", F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = join_back(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        last, path = path, scratch_path(spark, "star")
        links.write.parquet(path)
        drop_path(spark, last)
        links = spark.read.schema(links.schema).parquet(path)
    raise RuntimeError(f"components not finished after {max_rounds} rounds")


def _contracted(links: DataFrame) -> bool:
    """Whether every id has one link at most to a smaller one, which has none itself."""
    ends = links.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    each = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return each.where("up > 1 OR (up = 1 AND down = 1)").agg(F.count(F.lit(1))).first()[0] == 0
