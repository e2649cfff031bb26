"""Packing of token sequences by minimum bin slack.

Documents become pieces of at most CAPACITY tokens. Pieces of one length are interchangeable, so the plan is made
from the number of pieces of each length alone (at most CAPACITY numbers, whatever the input): the longest length
left opens a bin, a bitset subset-sum over the lengths still available finds the fullest combination for the rest,
and the combination is taken as often as the counts allow and then removed. Each piece gets a rank among those of its
length (its rank in its task plus the task's base), and the rank says which bin and offset it takes.

Defined results: a null or empty text is the one token 0; repeated rows are packed as often as they occur; a null
doc_id stays null; an empty table gives an empty result; extra columns are ignored; longer documents are cut.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.bpe import default_tokenizer, encoder, text_slices
from graphloom.llm.common import cut, tune

CAPACITY = 2048
END = b"\0\0\0\0"


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """Lengths, within their counts, whose sum is as near to room as any can be without passing it."""
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), reverse=True):
        left, k = min(counts[length], room // length), 1
        while left:
            k = min(k, left)
            before = reach
            reach |= (reach << (length * k)) & mask
            if reach != before:
                steps.append((length, k, before))
            left -= k
            k *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for length, k, before in reversed(steps):
        if not before >> total & 1:
            chosen += [length] * k
            total -= length * k
    return chosen


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """(times, lengths) for each combination used."""
    counts, out = {k: n for k, n in histogram.items() if n}, []
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        bin_ = [longest, *fullest(counts, capacity - longest)]
        counts[longest] += 1
        used: dict[int, int] = {}
        for x in bin_:
            used[x] = used.get(x, 0) + 1
        times = min(counts[x] // n for x, n in used.items())
        for x, n in used.items():
            counts[x] -= n * times
            if not counts[x]:
                del counts[x]
        out.append((times, bin_))
    return out


def placements(plan_: list[tuple[int, list[int]]]) -> tuple[np.ndarray, ...]:
    """key (length and first rank), first sequence and offset of each run of ranks, sorted by key."""
    rank: dict[int, int] = {}
    rows, sequence = [], 0
    for times, lengths in plan_:
        offset = 0
        for x in lengths:
            rows.append((x << 44 | rank.get(x, 0), sequence, offset))
            rank[x] = rank.get(x, 0) + times
            offset += x
        sequence += times
    rows.sort()
    return tuple(np.array([r[i] for r in rows], np.int64) for i in range(3))


def cut_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, for ranks, the task (src) and the rank in it (ord) of each piece."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select("doc_id", "text")
    spark.sparkContext.addFile(tokenizer_path)
    tokenizer = os.path.basename(tokenizer_path)

    def pieces(batches):
        enc = encoder("ids", SparkFiles.get(tokenizer), None, lambda _: None)
        src, seen = TaskContext.get().partitionId(), {}
        for batch in batches:
            row, piece, length, crc, order = [], [], [], [], []
            at = 0
            for texts in text_slices(batch.column(1)):
                split = [t.split() for t in texts]
                memo = enc.learn(split)
                for words in split:
                    ids = b"".join(map(memo.__getitem__, words)) + END
                    for k, i in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[i : i + 4 * capacity]
                        n = len(own) // 4
                        row.append(at)
                        piece.append(k)
                        length.append(n)
                        crc.append(zlib.crc32(own))
                        order.append(seen.get(n, 0))
                        seen[n] = order[-1] + 1
                    at += 1
            k = np.array(piece, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(row, pa.int64())),
                    pa.array(k.astype(np.int32)),
                    pa.array(k * capacity),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                    pa.array(np.full(len(row), src, np.int32)),
                    pa.array(order, pa.int64()),
                ],
                ["doc_id", "piece", "start", "length", "ids_crc32", "src", "ord"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, src int, ord long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs(doc_id, text)."""
    spark = docs.sparkSession
    pieces = cut(cut_documents(docs, tokenizer_path, capacity), "pieces")
    counts = pieces.groupBy("length", "src").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    places = spark.sparkContext.broadcast(placements(plan(histogram, capacity)))
    bases = counts.select(
        "length", "src", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("src").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base")
    )
    ranked = pieces.join(bases, ["length", "src"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("ord")).alias("rank"))

    def place(batches):
        keys, sequences, offsets = places.value
        for batch in batches:
            want = batch.column(3).to_numpy() << 44 | batch.column(5).to_numpy()
            at = np.searchsorted(keys, want, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequences[at] + want - keys[at], pa.int64()), pa.array(offsets[at], pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
