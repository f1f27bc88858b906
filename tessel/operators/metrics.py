"""Classification and ranking metrics, each one aggregate over a table of predictions."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def argmax(column: str):
    """The first position of the largest entry of a vector."""
    return F.array_position(column, F.array_max(column)) - 1


def accuracy(predictions: DataFrame, logits: str = "logits", label: str = "label", binary: bool = False) -> DataFrame:
    """``(accuracy)``: share of rows whose largest logit, or sign, tells the label."""
    told = (F.col(logits) >= 0).cast("int") if binary else argmax(logits).cast("int")
    return predictions.agg(F.avg((told == F.col(label)).cast("double")).alias("accuracy"))


def ranks(scored: DataFrame, filtered: bool = False) -> DataFrame:
    """``(q, rank)`` of ``scored(q, score, label, filtered)``: one plus the negatives that score higher."""
    rows = scored.where((F.col("label") == 1) | ~F.col("filtered")) if filtered else scored
    best = rows.where("label = 1").groupBy("q").agg(F.max("score").alias("best"))
    return rows.join(best, "q").groupBy("q").agg((F.lit(1) + F.sum(((F.col("label") == 0) & (F.col("score") > F.col("best"))).cast("int"))).alias("rank"))


def mrr(scored: DataFrame, filtered: bool = False) -> DataFrame:
    """``(mrr)``: mean reciprocal rank of the positives."""
    return ranks(scored, filtered).agg(F.avg(1 / F.col("rank")).alias("mrr"))


def hits(scored: DataFrame, k: int, filtered: bool = False) -> DataFrame:
    """``(hits)``: share of positives ranked within the first k."""
    return ranks(scored, filtered).agg(F.avg((F.col("rank") <= k).cast("double")).alias("hits"))


def build_metric(name: str):
    """A metric by name: ``accuracy``, ``binary_accuracy``, ``mrr``, ``hits@k`` and the filtered forms of ranks."""
    filtered, _, base = name.rpartition("filtered_")
    kept = name.startswith("filtered_")
    if base == "accuracy":
        return accuracy
    if base == "binary_accuracy":
        return lambda df: accuracy(df, binary=True)
    if base == "mrr":
        return lambda df: mrr(df, kept)
    if base.startswith("hits@"):
        return lambda df: hits(df, int(base[5:]), kept)
    raise ValueError(f"no metric {name!r}")
