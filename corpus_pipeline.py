"""From raw documents to packed sequences: toxicity, quality, near-duplicates, packing.

Every stage takes ``(spark, docs, sf_dir)`` and gives a DataFrame; all but the last keep the
columns of ``docs``.  ``run`` writes each stage's rows as Parquet in the shared folder and reads
them back, so a lost executor never reaches back over a stage.
"""

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import packing, quality, simhash, toxicity
from tessel.plans.shipping import ship
from tessel.plans.staging import staged, temporary
from tessel.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity model, fitted on labelled ones among them, doesn't reject."""
    ship(spark)
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality model, fitted on labelled ones among them, accepts."""
    ship(spark)
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts: five-word shingles, Jaccard similarity 0.8."""
    ship(spark)
    return simhash.deduplicate(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, placed in sequences of 2048 tokens."""
    ship(spark)
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("simhash", drop_near_duplicates), ("packing", pack)]

#: The classifiers can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a directory."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary(spark):  # what the stage wrote for itself goes
            docs = staged(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
