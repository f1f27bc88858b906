"""Mixing sources to target weights by systematic sampling, in DataFrame expressions.

Sources in code point order, null last, weigh 1, 2, 3, 1, 2, 3 and so on and share all words by
weight.  A target stops at ``most`` times its source's words; what lies above is shared anew by
weight among the others until none is above.  A document's expected copies are its source's target
over its source's words.  The documents of a source stand in order of their size, then of
their id; expected copies are summed along that order from one random offset, and a document
comes out once for each whole number that the sum crosses.  As sizes rise along the order, words
come as near the target as copies do: within about the largest document.

Documents are dealt by ranges of that order, so a source with most rows lies in many tasks; the
counts of the ranges, a row for each task and source, give every document's place.  No source's
rows meet in one task.

A size is the number of words; null and empty texts have none.  A source without words has the
target 0 and nothing is taken of it.  Null ids and repeated rows are documents of their own; an
empty table gives no rows; other columns are ignored.  The result depends on the rows and the seed
alone: rows that agree in source, size and id are alike in it.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessel.functions.hashing import SPAN, uniform
from tessel.functions.ordering import in_order, task_of, with_position
from tessel.plans.staging import staged

WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int) -> DataFrame:
    """``sources(words, weight, ...)`` with ``target``.

    With a common rate the target of a source is the rate times its weight, or its bound if that
    is less.  The rate rises from that of no bound, by what the bounds leave over, until no
    further source is above its bound; each round is one sum over the sources.
    """
    bound = F.lit(most) * F.col("words")
    rate, before = 0.0, None
    while True:
        over = bound <= F.lit(rate) * F.col("weight") if before is not None else F.lit(False)
        said = sources.agg(
            F.sum("words").alias("all"), F.sum(F.when(over, bound).otherwise(0)).alias("bounded"),
            F.sum(F.when(over, 0).otherwise(F.col("weight"))).alias("weight"), F.count(F.when(over, 1)).alias("n"),
        ).first()
        if not said["weight"] or said["n"] == before:
            break
        rate, before = (said["all"] - said["bounded"]) / said["weight"], said["n"]
    return sources.withColumn("target", F.least(bound.cast("double"), F.lit(rate) * F.col("weight")))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", most: int = 3, seed: int = 13) -> DataFrame:
    """``(id, size, source_size, target, copies, taken)`` for every document.

    ``copies`` is how often the mix holds the document, ``taken`` the words of those copies.
    """
    source = F.col(source_col).cast("string")
    light = docs.select(F.col(id_col).alias("id"), source.isNull().alias("unnamed"), F.coalesce(source, F.lit("")).alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = in_order(staged(light, "mix-sizes"), "unnamed", "source", "size", "id", name="at").withColumn("task", task_of("at"))

    parts = staged(rows.groupBy("unnamed", "source", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.min("at").alias("at")), "mix-parts")
    ranked = with_position(parts.groupBy("unnamed", "source").agg(F.sum("words").alias("words"), F.min("at").alias("at")), "at", name="rank")
    weight = F.element_at(F.lit(list(WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int") + 1)
    sources = targets(staged(ranked.select("unnamed", "source", "words", weight.alias("weight")), "mix-sources"), most)

    before = F.sum("n").over(W.partitionBy("unnamed", "source").orderBy("task")) - F.col("n")  # a row for each task
    first = parts.select("unnamed", "source", "task", before.alias("before"), F.col("at").alias("low")).join(sources, ["unnamed", "source"])
    place = F.col("before") + F.col("at") - F.col("low")
    copies = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(F.lit(0.0))
    offset = uniform(seed, F.col("unnamed").cast("int"), F.col("source")) / F.lit(SPAN)
    crossed = lambda k: F.floor(k * copies + offset)
    drawn = F.least(crossed(place + 1) - crossed(place), F.lit(most))  # more only by rounding
    out = rows.join(first, ["unnamed", "source", "task"]).withColumn("copies", drawn)
    return out.select(F.col("id").alias(id_col), "size", F.col("words").alias("source_size"), "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))

