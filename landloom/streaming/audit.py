"""The append-only audit trail as a stream: new rows of a folder, counted by action in windows, late rows within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id string, run_id string, actor string, action string, target string, result string, detail string, created_at timestamp"


def trail(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an audit folder as they come."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def activity(rows: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Actions by window and actor; windows close when the watermark has passed them."""
    counted = rows.withWatermark("created_at", late).groupBy(F.window("created_at", window).alias("w"), "actor", "action").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), "actor", "action", "n")


def to_store(rows: DataFrame, path: str, checkpoint: str):
    """Starts a query that appends rows to Parquet by day, exactly once."""
    return rows.withColumn("day", F.to_date("created_at")).writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
