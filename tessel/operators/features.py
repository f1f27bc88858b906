"""Feature normalisers and deterministic splits."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.hashing import uniform
from tessel.functions.ordering import place_within, with_position
from tessel.functions.vectors import items
from tessel.operators.sampling import uniform_negatives


def normalize_rows(nodes: DataFrame, column: str = "x", eps: float = 1e-12) -> DataFrame:
    """Vectors divided by the larger of their sum and ``eps``."""
    total = F.aggregate(column, F.lit(0.0), lambda a, v: a + v)
    return nodes.withColumn(column, F.transform(column, lambda v: v / F.greatest(total, F.lit(eps))))


def standardize(nodes: DataFrame, width: int, column: str = "x", eps: float = 1e-12, where: str | None = None) -> DataFrame:
    """Entries less their mean, over their population deviation; statistics from all rows or some.

    The statistics are one row, joined back by a broadcast of that row.
    """
    used = nodes.where(where) if where else nodes
    x = items(F.col(column), width)
    stats = used.agg(F.array(*[F.avg(v) for v in x]).alias("__m"), F.array(*[F.stddev_pop(v) for v in x]).alias("__s"))
    scaled = F.transform(F.arrays_zip(F.col(column).alias("x"), F.col("__m").alias("m"), F.col("__s").alias("s")), lambda z: (z["x"] - z["m"]) / F.greatest(z["s"], F.lit(eps)))
    return nodes.crossJoin(F.broadcast(stats)).withColumn(column, scaled).drop("__m", "__s")


def _ranked(ids: DataFrame, seed: int) -> DataFrame:
    return with_position(ids.withColumn("__u", uniform(seed, F.col("id"))), "__u", "id", name="__n")


def split_rows(ids: DataFrame, val: float | int, test: float | int, seed: int = 0) -> DataFrame:
    """``(…, part)``: a permutation's first rows are ``val``, the next ``test``, the rest ``train``.

    A float is a share of the rows, rounded down.
    """
    n = ids.count()
    n_val, n_test = (int(n * x) if isinstance(x, float) else x for x in (val, test))
    part = F.when(F.col("__n") < n_val, "val").when(F.col("__n") < n_val + n_test, "test").otherwise("train")
    return _ranked(ids, seed).withColumn("part", part).drop("__n", "__u")


def split_per_class(ids: DataFrame, label: str, per_class: int, val: int, test: int, seed: int = 0) -> DataFrame:
    """``(…, part)``: the first of each class are ``train``, then ``val`` and ``test``, the rest ``none``."""
    drawn = ids.withColumn("__u", uniform(seed, F.col("id")))
    drawn = drawn.withColumn("__c", F.row_number().over(W.partitionBy(label).orderBy("__u", "id")))
    rest = with_position(drawn.where(F.col("__c") > per_class), "__u", "id", name="__n")
    part = F.when(F.col("__n") < val, "val").when(F.col("__n") < val + test, "test").otherwise("none")
    train = drawn.where(F.col("__c") <= per_class).withColumn("part", F.lit("train")).drop("__u", "__c")
    return train.unionByName(rest.withColumn("part", part).drop("__u", "__c", "__n"))


def split_links(edges: DataFrame, val: float | int, test: float | int, seed: int = 0, undirected: bool = False) -> DataFrame:
    """Edges with ``part``; with ``undirected`` an edge and its reverse go together.

    Messages may pass over train edges for train and val, over train and val edges for test.
    """
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")] if undirected else [F.col("e_id").alias("a"), F.lit(0).alias("b")]
    keyed = edges.select("*", *pair)
    groups = keyed.groupBy("a", "b").agg(F.min("e_id").alias("id"))
    parts = split_rows(groups, val, test, seed).select("a", "b", "part")
    return keyed.join(parts, ["a", "b"]).drop("a", "b")


def split_negatives(edges: DataFrame, links: DataFrame, total: int, ratio: float | int, splits: tuple[str, ...] = ("val", "test"), seed: int = 0) -> DataFrame:
    """``(part, q, src, dst, label, slot)``: each chosen split's links and its drawn negatives.

    A split of n links has ``floor(n * ratio)`` negatives: every link, in the order of its draw,
    gives one before any gives another.  ``splits`` with ``train`` gives negatives for training
    too.  A negative is no edge of the whole graph.
    """
    asked = links.where(F.col("part").isin(*splits)).select("part", F.col("e_id").alias("q"), "src", "dst")
    counts = {r["part"]: int(r["n"] * ratio) for r in asked.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each split
    drawn = place_within(asked.withColumn("__u", uniform(seed + 2, F.col("q"))), ["part"], "__u", "q", name="__k").drop("__u")
    sizes = {r["part"]: r["n"] for r in drawn.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = uniform_negatives(edges, drawn.select("q", "src", "dst"), max(1, math.ceil(ratio)), total, seed)
    wanted, size = F.lit(0), F.lit(1)
    for name, n in counts.items():
        wanted, size = F.when(F.col("part") == name, n).otherwise(wanted), F.when(F.col("part") == name, sizes[name]).otherwise(size)
    kept = found.join(drawn.select("q", "part", "__k"), "q").where((F.col("label") == 1) | ((F.col("slot") - 1) * size + F.col("__k") < wanted))
    return kept.select("part", "q", "src", "dst", "label", "slot")


def link_split(edges: DataFrame, val: float | int, test: float | int, seed: int = 0, undirected: bool = False, disjoint: float | int = 0.0, val_in_test: bool = True, reverse: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """``(links, messages)``: which edges each split is asked about, and which it may pass messages over.

    ``links(e_id, src, dst, part)``.  With ``disjoint``, that share or number of the training groups
    is asked about and the others pass messages; without, all do both.  ``messages(split, kind,
    e_id, src, dst)`` has every split's edges, of kind ``edge`` or, for those of ``reverse`` that run
    against them, ``reverse``; validation edges pass messages in the test with ``val_in_test``.
    """
    pair = [F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")] if undirected else [F.col("e_id").alias("a"), F.lit(0).cast("long").alias("b")]
    keyed = edges.select("e_id", "src", "dst", *pair)
    groups = split_rows(keyed.groupBy("a", "b").agg(F.min("e_id").alias("id")), val, test, seed)
    apart = int(groups.where("part = 'train'").count() * disjoint) if isinstance(disjoint, float) else disjoint
    if apart:
        asked = _ranked(groups.where("part = 'train'").select("id"), seed + 1).select("id", (F.col("__n") < apart).alias("asked"))
        groups = groups.join(asked, "id", "left")
    else:
        groups = groups.withColumn("asked", F.lit(None).cast("boolean"))
    placed = keyed.join(groups.select("a", "b", "part", "asked"), ["a", "b"]).select("e_id", "src", "dst", "part", "asked")
    links = placed.where("part <> 'train' or asked is null or asked").select("e_id", "src", "dst", "part")
    train = F.array(F.lit("train"), F.lit("val"), F.lit("test"))
    splits = F.when((F.col("part") == "train") & ~F.coalesce("asked", F.lit(False)), train)
    if val_in_test:
        splits = splits.when(F.col("part") == "val", F.array(F.lit("test")))
    passing = placed.select(F.explode(splits).alias("split"), "e_id", "src", "dst")
    messages = passing.select("split", F.lit("edge").alias("kind"), "e_id", "src", "dst")
    if reverse is not None:
        turned = passing.select("split", F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
        back = reverse.select("e_id", "src", "dst").join(turned, ["src", "dst"])
        messages = messages.unionByName(back.select("split", F.lit("reverse").alias("kind"), "e_id", "src", "dst"))
    return links, messages
