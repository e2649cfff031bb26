"""Importance resampling towards a target distribution: hashed features, gains of buckets, Gumbel top-k.

Two passes in Arrow batches. The first hashes every feature (a run of consecutive words) into one of BUCKETS buckets
and counts them with np.bincount; each partition gives one vector of counts, and treeReduce adds the vectors, so the
driver adds some hundred of 80 KB each, however many partitions there are. The gain of a bucket is the logarithm of its share of the target over
its share of the raw texts. The second pass gathers the gains, which are broadcast (80 KB, whatever the data), and sums
them for each document with the weights of np.bincount. Gumbel noise made from the row's id turns the highest
scores into a sample without replacement; the ranking cuts the scores into sorted ranges and adds up their sizes.

Defined results: a null or empty text has no features and weight 0; a null id counts as the empty string in the noise and
sorts after all others among equal scores; rows are drawn one by one, so repeated rows each have a rank of their own; no
documents give no rows; an empty target makes all buckets' gains those of t = 0; extra columns are ignored; very long
texts are read whole. All scores are whole thousandths, so sums are exact in any order.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import cut, partitions, slices, text_bytes, tune

BUCKETS = 10_000
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
#: Bytes of text handled at a time, and the length from which a feature is hashed by itself.
SLICE = 1 << 20
LONG = 40


def _tables():
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    inside = np.zeros(256, bool)  # after lower-casing: digits, letters, and all bytes of characters beyond ASCII
    inside[0x30:0x3A] = inside[0x61:0x7B] = inside[0x80:] = True
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0xEDB88320), crc >> 1)
    return lower, inside, crc


LOWER, INSIDE, CRC = _tables()


def crc32_of(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The crc32 of each slice of data, all slices one byte further at a time, longest first."""
    order = np.argsort(-length, kind="stable")
    at, size = start[order], length[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    n_long = int(np.searchsorted(-size, -LONG, "left"))
    for p in range(int(size[n_long]) if n_long < len(size) else 0):
        m = int(np.searchsorted(-size, -p, "left"))  # slices that have a byte here
        now = crc[n_long:m]
        crc[n_long:m] = CRC[(now ^ data[at[n_long:m] + p]) & 255] ^ (now >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for k in range(n_long):
        crc[k] = zlib.crc32(data[at[k] : at[k] + size[k]].tobytes())
    out = np.empty_like(crc)
    out[order] = crc
    return out


def buckets_of(data: np.ndarray, offsets: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each feature, its text's number, number of words of each text); runs of 1 to `longest` words."""
    n = len(offsets) - 1
    data = LOWER[data]
    inside = INSIDE[data]
    # a gap after each text keeps words of two texts apart
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begins = np.flatnonzero(inside & (edge[:-1] | ~np.concatenate(([False], inside[:-1])))) if len(data) else np.empty(0, np.int64)
    if not len(begins):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(n, np.int64)
    ends = np.flatnonzero(inside & (edge[1:] | ~np.concatenate((inside[1:], [False])))) + 1
    length = ends - begins
    text = np.searchsorted(offsets, begins, "right") - 1
    if longest == 1:
        return crc32_of(data, begins, length).astype(np.int64) % buckets, text, np.bincount(text, minlength=n)
    # all words with one space between two
    at = np.cumsum(length + 1) - (length + 1)
    joined = np.full(int(at[-1] + length[-1]), 32, np.uint8)
    joined[np.arange(int(length.sum())) + np.repeat(np.arange(len(at)), length)] = data[inside]
    found, owner = [], []
    for k in range(longest):
        first = np.flatnonzero(text[: len(text) - k] == text[k:]) if k < len(text) else np.empty(0, np.int64)
        found.append(crc32_of(joined, at[first], at[first + k] + length[first + k] - at[first]).astype(np.int64) % buckets)
        owner.append(text[first])
    return np.concatenate(found), np.concatenate(owner), np.bincount(text, minlength=n)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all rows' text fall in each bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            for i, j in slices(offsets, SLICE):
                total += np.bincount(buckets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], longest, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    vectors = texts.select("text").mapInArrow(count, "counts binary").rdd.map(lambda row: np.frombuffer(row[0], np.int64))
    n = vectors.getNumPartitions()
    return vectors.treeReduce(np.add, depth=2 if n < 10_000 else 3) if n else np.zeros(buckets, np.int64)


def gains_of(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's share of the target over its share of the raw texts, both smoothed by one."""
    n, s_all, t_all = len(raw), float(raw.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + n) / ((float(s) + 1) * (t_all + n)))) for s, t in zip(raw, target)], np.float64)


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = 1) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row; nothing is shuffled."""
    kind, shared = docs.schema["doc_id"].dataType.simpleString(), docs.sparkSession.sparkContext.broadcast(gains)

    def run(batches):
        gain = shared.value
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            parts = []
            for i, j in slices(offsets, SLICE):
                bucket, text, words = buckets_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], longest, len(gain))
                parts.append((words, np.bincount(text, minlength=j - i), np.bincount(text, gain[bucket], j - i).astype(np.int64)))
            columns = [pa.array(np.concatenate([np.empty(0, np.int64), *c])) for c in zip(*parts)] if parts else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def noise(seed: int):
    """Gumbel noise of a row in whole thousandths, from the id alone."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, percent: int, min_words: int) -> DataFrame:
    """scored with rank 1, 2, ... of the highest `percent` percent of the rows of min_words words, null for all others."""
    spark = scored.sparkSession
    kept, order = scored.filter(F.col("n_words") >= min_words), (F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("tie"))
    # the ranges are fixed by writing them: a lost executor cannot deal them anew
    ranges = cut(kept.repartitionByRange(partitions(spark), *order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    bases = sizes.select("part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("all_rows"))
    place = F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    placed = ranges.join(F.broadcast(bases), "part").withColumn("place", place).withColumn("rank", F.when(F.col("place") <= F.floor(F.lit(percent) * F.col("all_rows") / 100), F.col("place")).cast("long"))
    return placed.drop("part", "base", "all_rows", "place").unionByName(scored.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of every row of docs(doc_id, text), drawn
    to resemble the texts of target(text)."""
    tune(docs.sparkSession)
    gains = gains_of(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored = weigh(docs, gains, longest).withColumn("score", F.col("weight") + noise(seed)).withColumn("tie", F.monotonically_increasing_id())
    return ranked(cut(scored, "scored"), percent, min_words).drop("tie")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
