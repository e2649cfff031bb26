"""Sharding into contiguous runs of near equal bytes: global prefix sums from per-partition totals.

Rows are dealt into ranges of (doc_id, checksum, position); each range gives one total; the running sum of
the few totals is each range's base, and a running sum inside a range gives every row its global byte position.
The row belongs to the shard in whose equal share of all bytes the middle of the row lies. Only DataFrame
functions run, and only three numbers a row are shuffled, never the text.

Defined results: a null text has size 1 and the checksum of the empty text, as an empty one has; very long texts count whole; rows of equal doc_id and text are
interchangeable and each gets its own slot; a null doc_id sorts first; an empty table gives an empty result;
extra columns of the input are ignored; one row larger than a share makes that shard longer, never lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, partitions

N_SHARDS = 16


def shard(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, begin (bytes before the row), shard, slot of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("tie"),
    )
    # the ranges are fixed by writing them: a lost executor cannot deal them anew
    ranges = cut(
        rows.repartitionByRange(partitions(spark), F.col("doc_id").asc_nulls_first(), "text_crc32", "tie").withColumn("part", F.spark_partition_id()),
        "ranges",
    )
    totals = ranges.groupBy("part").agg(F.sum("size").alias("part_bytes"))
    # one row for each range: a window without a key holds as many rows as there are partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bases = totals.select("part", F.coalesce(F.sum("part_bytes").over(before), F.lit(0)).alias("base"), F.sum("part_bytes").over(everything).alias("all_bytes"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "tie").rowsBetween(Window.unboundedPreceding, -1)
    placed = (
        ranges.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(F.broadcast(bases), "part")
        .withColumn("begin", F.col("base") + F.col("within"))
        .withColumn("shard", F.least(F.lit(n_shards - 1), F.floor((F.col("begin") + F.col("size") / 2) * n_shards / F.col("all_bytes"))).cast("int"))
    )
    # slots: the same two steps over (shard, range) counts, so that no shard is ever in one task
    counts = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    order = Window.partitionBy("part", "shard").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "tie")
    return (
        placed.withColumn("rank", F.row_number().over(order) - 1)
        .join(F.broadcast(starts), ["shard", "part"])
        .select("doc_id", "size", "text_crc32", "begin", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
