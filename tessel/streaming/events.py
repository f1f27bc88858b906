"""Temporal operators over a stream of events.

Time is the event's own; rows later than the watermark are dropped and old state with them.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, schema: str = EVENTS, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of parquet files of events, with a zoned ``at`` for watermarks."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder).withColumn("at", F.col("ts").cast("timestamp"))


def windowed_activity(events: DataFrame, length: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """``(start, user_id, n, total)``: events and values of each user in tumbling or sliding windows."""
    at = F.window("at", length, slide) if slide else F.window("at", length)
    found = events.withWatermark("at", late).groupBy(at.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "user_id", "n", "total")


def sessions(events: DataFrame, gap: str = "1 hour", late: str = "2 days") -> DataFrame:
    """``(start, end, user_id, n)``: runs of a user's events without a longer pause."""
    found = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def latest_value(events: DataFrame) -> DataFrame:
    """``(user_id, ts, value)``: each user's last event so far; state is one row for each user."""
    return events.groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "value")).alias("x")).select("user_id", "x.ts", "x.value")


def look_back(events: DataFrame, history: DataFrame, days: int = 7) -> DataFrame:
    """``(event_id, user_id, n)``-ready rows: streamed events with the user's earlier static ones."""
    past = history.select(F.col("user_id"), F.col("ts").alias("past_ts"), F.col("event_id").alias("past_id"))
    near = (F.col("past_ts") < F.col("ts")) & (F.col("past_ts") >= F.col("ts") - F.expr(f"INTERVAL {int(days)} DAYS"))
    return events.join(past, "user_id").where(near).select("event_id", "user_id", "past_id")


def run_to_table(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Read all there is into a memory table and stop."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
