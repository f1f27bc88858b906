"""Dense positions in a total order without gathering the rows in one task."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.plans.staging import staged

#: Up to so many rows are ranked by one window.
ROWS_PER_RANGE = 200_000
#: ``monotonically_increasing_id`` has a row's number within its task in the bits below.
TASK_BITS = 33


def in_order(df: DataFrame, *keys: str | Column, name: str = "at") -> DataFrame:
    """``df`` as a table dealt by ranges of the keys, with a number that rises in their order.

    The table is written once in the shared folder, so the numbers stay whatever is read again;
    :func:`task_of` gives the range that a number lies in.  Ranges come from Spark's own sample of
    the keys, and equal keys share one: end with a key that tells copies apart.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return staged(dealt.withColumn(name, F.monotonically_increasing_id()), "order")


def task_of(at: str | Column) -> Column:
    """The range of a number that :func:`in_order` gave."""
    return F.shiftright(at, TASK_BITS)


def with_position(df: DataFrame, key: str, *ties: str, name: str = "position", rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``df`` with the rank of each row, from 0, by ``key`` and then ``ties``.

    Many rows are written in order; the counts of the ranges, one row for each task, give every
    range's first rank.
    """
    if df.count() <= rows_per_range:
        return df.withColumn(name, (F.row_number().over(W.orderBy(key, *ties)) - 1).cast("long"))
    ordered = in_order(df, key, *ties, name="__at").withColumn("__task", task_of("__at"))
    counts = ordered.groupBy("__task").agg(F.count(F.lit(1)).alias("__n"))
    first = counts.select("__task", (F.sum("__n").over(W.orderBy("__task")) - F.col("__n")).alias("__first"))
    within = F.col("__at").bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    # one row for each task of the write
    return ordered.join(F.broadcast(first), "__task").withColumn(name, F.col("__first") + within).drop("__at", "__task", "__first")


def place_within(df: DataFrame, keys: list[str], *order: str, name: str = "place") -> DataFrame:
    """``df`` with each row's rank, from 0, among the rows of its keys, which aren't null.

    Rows of a key may lie in many ranges of the order; their counts, a row for each range and key,
    give a range's first rank, so a key that most rows have is never ranked in one task.
    """
    ordered = in_order(df, *keys, *order, name="__at").withColumn("__task", task_of("__at"))
    parts = ordered.groupBy(*keys, "__task").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__low"))
    before = F.sum("__n").over(W.partitionBy(*keys).orderBy("__task")) - F.col("__n")
    first = parts.select(*keys, "__task", (before - F.col("__low")).alias("__shift"))
    return ordered.join(first, [*keys, "__task"]).withColumn(name, F.col("__at") + F.col("__shift")).drop("__at", "__task", "__shift")


def running_total(df: DataFrame, key: str, value: str, name: str = "before") -> DataFrame:
    """``df`` with the sum of an integer value over all rows of a smaller key."""
    ordered = in_order(df, key, name="__at").withColumn("__task", task_of("__at"))
    totals = ordered.groupBy("__task").agg(F.sum(value).alias("__n"))
    base = totals.select("__task", (F.sum("__n").over(W.orderBy("__task")) - F.col("__n")).alias("__base"))  # a row for each task
    within = F.sum(value).over(W.partitionBy("__task").orderBy("__at")) - F.col(value)
    return ordered.join(F.broadcast(base), "__task").withColumn(name, F.col("__base") + within).drop("__at", "__task", "__base")
