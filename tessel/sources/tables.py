"""Lazy access to the parquet tables of a data directory."""

from pyspark.sql import DataFrame, SparkSession

from tessel.plans.shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of the directory; any path that Spark can read will do."""
    return ship(spark).read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")
