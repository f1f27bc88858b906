"""Negative links, candidates and temporal histories, keyed by request."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.hashing import uniform
from tessel.functions.joins import join_back
from tessel.functions.ordering import place_within
from tessel.operators.history import all_before, events_before, events_within, with_places
from tessel.plans.staging import staged


def uniform_negatives(edges: DataFrame, positives: DataFrame, n: int, total: int, seed: int = 0) -> DataFrame:
    """``(q, src, dst, label, slot)``: each positive of ``positives(q, src, dst)`` and n drawn negatives.

    Ids run from 0 to ``total - 1``.  A negative is drawn with replacement from the ids that are
    neither the positive's own nor a known destination of its source.  The k-th free id is k plus
    the number of taken ids with at most k free ones below: a search in the order of
    ``(source, free ids below)``, which taken ids and draws share, so a source that knows most ids
    is neither gathered nor copied to its draws.  A source without a free id gives no negative.
    """
    asked = positives.select("src").distinct()
    known = edges.select("src", "dst").join(asked, "src", "left_semi").unionByName(positives.select("src", "dst")).distinct()
    # each taken id's place among those of its source gives the free ids below it
    placed = staged(place_within(known.where((F.col("dst") >= 0) & (F.col("dst") < total)), ["src"], "dst"), "taken")
    gaps = placed.select("src", (F.col("dst") - F.col("place")).alias("t"), F.col("dst").alias("e_id"))
    sizes = placed.groupBy("src").agg(F.count(F.lit(1)).alias("taken"))

    rows = join_back(positives.select("q", "src"), sizes, "src", how="left").withColumn("free", F.lit(total) - F.coalesce("taken", F.lit(0)))
    draws = rows.where("free > 0").withColumn("slot", F.explode(F.sequence(F.lit(1), F.lit(n))))
    draws = draws.select(F.struct("q", "slot").alias("q"), "src", (uniform(seed, F.col("q"), F.col("slot")) % F.col("free")).alias("t"))
    _, found = with_places(gaps, draws, strict=False, keys=["src"])
    negative = found.select("q.q", "src", (F.col("t") + F.col("place") - F.col("low")).alias("dst"), F.lit(0).alias("label"), "q.slot")
    return positives.select("q", "src", "dst", F.lit(1).alias("label"), F.lit(0).alias("slot")).unionByName(negative)


def hard_negatives(edges: DataFrame, positives: DataFrame, hard: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``(q, src, dst, slot)``: up to n distinct destinations from ``hard(q, dst)`` that aren't positives."""
    known = edges.select("src", "dst").unionByName(positives.select("src", "dst")).distinct()
    options = positives.select("q", "src").join(hard.select("q", "dst").distinct(), "q").join(known, ["src", "dst"], "left_anti")
    order = W.partitionBy("q").orderBy(uniform(seed, F.col("q"), F.col("dst")), "dst")
    return options.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= n).select("q", "src", "dst", "slot")


def candidates(edges: DataFrame, positives: DataFrame, options: DataFrame) -> DataFrame:
    """``(q, src, dst, label, filtered)``: the positive, then every ``options(q, dst)`` as a negative.

    Options that are known destinations stay, marked to be filtered in ranking.
    """
    known = edges.select("src", "dst").distinct().withColumn("filtered", F.lit(True))
    own = positives.select("q", "src", F.col("dst").alias("__own"))
    rest = own.join(options.select("q", "dst").distinct(), "q").where("dst <> __own").drop("__own")
    rest = rest.join(known, ["src", "dst"], "left").select("q", "src", "dst", F.lit(0).alias("label"), F.coalesce("filtered", F.lit(False)).alias("filtered"))
    return positives.select("q", "src", "dst", F.lit(1).alias("label"), F.lit(False).alias("filtered")).unionByName(rest)


def history(edges: DataFrame, events: DataFrame, time: str = "t", strict: bool = True, window: int | None = None, last: int | None = None, on: list[tuple[str, str]] | None = None) -> DataFrame:
    """The edges before each event ``events(q, src, dst, t)``, with ``q``.

    ``on`` pairs edge and event columns that must be equal; ``window`` bounds how far back,
    ``last`` keeps the latest so many by time and id.  No form compares every edge with every
    event (:mod:`tessel.operators.history`), though without any bound that many rows may result.
    """
    keys = [f"__k{i}" for i, _ in enumerate(on or [])]
    lines = edges.select("*", *[F.col(a).alias(k) for k, (a, _) in zip(keys, on or [], strict=True)])
    if time != "t":
        lines = lines.withColumn("t", F.col(time))
    asked = events.select("q", "t", *[F.col(b).alias(k) for k, (_, b) in zip(keys, on or [], strict=True)])
    names = [*edges.columns, "q"]
    if last is not None:
        found = events_before(lines.select(*keys, "t", "e_id"), asked, last, strict, keys)
        if window is not None:
            found = found.join(asked.select("q", F.col("t").alias("__t")), "q").where(F.col("t") >= F.col("__t") - window)
        return edges.join(found.select("q", "e_id"), "e_id").select(*names)
    if window is not None:
        return events_within(lines, asked, window, strict, keys).select(*names)
    if keys:
        met = lines.join(asked.withColumnRenamed("t", "__t"), keys)
        return met.where(F.col("t") < F.col("__t") if strict else F.col("t") <= F.col("__t")).select(*names)
    return all_before(lines, asked, strict).select(*names)
