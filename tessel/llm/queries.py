"""One registered query for each corpus operator, over its whole table."""

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import bpe, dialogue, embdedup, fingerprint, infill, mixing, oracles, packing, quality, sharding, simhash, toxicity, urlfilter, warc
from tessel.sources.tables import table


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document by the 50k byte ranks."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("bits")).alias("fingerprint"), "component_id")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in 8 shards of near-equal bytes."""
    return sharding.shard(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multiset fingerprint of every document, and its likeness to an edit and to the next one."""
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, stated rule and verdict of every page's URL."""
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A WARC record for every page, written and read back."""
    return warc.archive(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector among those of its label."""
    return embdedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, from labels that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model)


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its middle moved to the end, and the text restored from that."""
    done = infill.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    proof = infill.digests(F.col("fim.output"), F.col("fim.form"))
    return done.select("doc_id", "fim.n", "fim.form", "fim.prefix_chars", "fim.middle_chars", proof.alias("proof")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "proof.*")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    found, rows = dialogue.repair(dialogue.damage(table(spark, sf_dir, "conversations")))
    digests = dialogue.digests(rows).withColumnRenamed("conv_id", "__id")
    none = hashlib.sha256(b"").hexdigest()
    whole = found.join(digests, F.col("conv_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    return whole.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(none)))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document comes in a mix of the sources by weight."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("copies")


def queries() -> dict:
    """Queries by name."""
    return {f.__name__: f for f in (op1_byte_bpe, op2_simhash, op3_sharding, op4_fingerprint, op5_packing, op6_quality, op7_url_filter, op8_warc, op9_embedding_dedup, op10_toxicity, op11_fill_in_middle, op12_conversation_repair, op13_mixing)}


def oracle_sql() -> dict:
    """SQL twins, where SQL can express the operator and is quick enough on whole tables."""
    return dict(oracles.ORACLES)
