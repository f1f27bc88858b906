"""Joining rows with an aggregate of themselves when one key may hold most of them."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_back(rows: DataFrame, sums: DataFrame, *on: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``sums``, an aggregate on the same keys, so that a hot key can be split.

    An aggregate is already dealt by its keys, and Spark would join in that dealing, with all rows
    of a key in one task: adaptive execution splits a join only between two shuffles.  The second
    key, a hash of the first ones, gives the aggregate a shuffle of its own.
    """
    own = F.xxhash64(*on)
    return rows.withColumn("__own", own).join(sums.withColumn("__own", own), [*on, "__own"], how).drop("__own")
