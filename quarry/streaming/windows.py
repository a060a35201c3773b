"""Event-time windows over events: the same plans for a table and for a stream.

The engine's dialect has no streams; this is Spark's Structured Streaming for those who feed tables from one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def awaited(rows: DataFrame, late: str | None) -> DataFrame:
    """With a watermark, which Spark wants on instants rather than wall-clock times."""
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if late else rows


def tumbling_counts(rows: DataFrame, length: str = "1 hour", late: str | None = None) -> DataFrame:
    """Counts and sums of each event type in windows of one length; late: how long a stream waits for rows."""
    rows = awaited(rows, late)
    found = rows.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def session_counts(rows: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Each user's runs of events with less than the gap between them."""
    rows = awaited(rows, late)
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.col("w.start").alias("start"), "n")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tumbling_counts(events(spark, sf_dir))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_counts(events(spark, sf_dir))


def stream(spark: SparkSession, folder: str, schema, plan, target: str, checkpoint: str, late: str = "1 hour") -> StreamingQuery:
    """Run a plan over Parquet files as they arrive; finished windows are appended to target, exactly once.

    All that is there is worked off and the query ends. Called again, it goes on from its checkpoint.
    """
    found = plan(spark.readStream.schema(schema).parquet(folder), late=late)
    return found.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
