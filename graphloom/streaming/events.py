"""Structured Streaming over event logs: rollups by window with a watermark, and graph upserts batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.sources.io import EVENT


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New JSON-lines files of a folder as a stream of events."""
    return spark.readStream.schema(EVENT).json(folder)


def table_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The driver's event table as a stream; event time gets a zone, which watermarks need."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet*").parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(events: DataFrame, kind: str = "event_type", late: str = "1 hour") -> DataFrame:
    """(day, kind, n): counts by day; events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("w"), F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("day"), "kind", "n")


def sessions(events: DataFrame, user: str = "user_id", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n): runs of events without a longer pause."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), F.col(user).alias("user")).agg(F.count(F.lit(1)).alias("n")).select("user", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_to_table(stream: DataFrame, target: str, checkpoint: str, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there, writes each batch as Parquet under target and returns the result: in complete mode the
    last batch, which holds all, else all batches. A batch that is run again after a failure replaces its own folder."""
    spark, schema, batches = stream.sparkSession, stream.schema, []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch-{number}")
        batches.append(number)

    stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    wanted = sorted(set(batches))[-1:] if mode == "complete" else sorted(set(batches))
    return spark.read.schema(schema).parquet(*[f"{target}/batch-{k}" for k in wanted]) if wanted else spark.createDataFrame([], schema)


def sync(stream: DataFrame, apply, checkpoint: str):
    """Hands every micro-batch to apply(batch, id): incremental extraction or an upsert."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
