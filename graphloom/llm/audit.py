"""Audit of how filters interact: what each removes in every order, and its Shapley value, from counts of failure masks.

Every document gets a mask of the filters that it fails; documents are counted by part and mask, at most 2 ** n rows a
part. A part's removal polynomial is the multilinear extension of "documents removed by a set of filters",

    V(x) = sum over masks of count(mask) * (1 - product over its filters i of (1 - x_i)).

Its values at corners of the cube are the documents removed by a set of filters, so survivors of any order come from
corners along that order; the integral of the partial derivative along the diagonal is a filter's Shapley value, worked
out in exact rationals and scaled by n! (the sum over all orders). Only the masks touch documents.

"A copy" is decided by counts, not by a join of copies: rows are counted by (checksum, mask, part, labels) with the smallest
id and how often it occurs, which combines before the shuffle, so a text that a third of all rows share is one row a task.

Defined results: a null text is empty; an empty text has no words and fails the first filter alone (or copies another
empty one); a null id is larger than all others; rows that share both id and text are no copies of each other; a null part
is the empty string; of several labels of an id each counts that any of them gives, and ids without labels count as neither good nor toxic; an
empty table gives no rows; extra columns are ignored; texts are read whole, and equal SHA-256 sums count as equal texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.quality import let, words_of

#: Filters that an audit may have: orders grow as the factorial, 5,040 with seven.
MOST_FILTERS = 7
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filter that fails copies of a text with a smaller id.
COPIES = "E"


def text_filters(text: Column) -> Column:
    """Struct of whether the text fails each of A, B, C, D: too short, repetitive, shouting, with symbols."""

    def by_words(w: Column) -> Column:
        return F.struct((F.size(w) < 100).alias("A"), (100 * F.size(F.array_distinct(w)) < 80 * F.size(w)).alias("B"))

    def with_characters(found: Column) -> Column:
        capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
        return F.struct(found["A"].alias("A"), found["B"].alias("B"), (100 * capitals.cast("long") > 10 * F.length(text).cast("long")).alias("C"), text.rlike("[#$%&*|]").alias("D"))

    return let(let(words_of(text), by_words), with_characters)


def mask_counts(docs: DataFrame, labels: DataFrame, filters: Callable[[Column], Column] = text_filters, part: str = "lang") -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail (bit k for filter k, the last for
    copies), and how many of them are labelled so. docs(doc_id, text, part), labels(doc_id, quality, toxic)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    failed = docs.select(F.col("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sum"), filters(text).alias("failed"))
    names = failed.schema["failed"].dataType.fieldNames()
    copy = 1 << len(names)
    mask = sum((F.when(F.col("failed")[name], F.lit(1 << k)).otherwise(F.lit(0)) for k, name in enumerate(names)), F.lit(0))
    # repeated rows become one before ids are joined, so a frequent id (null among them) is one row a text
    rows = failed.select("doc_id", "part", "sum", mask.alias("mask")).groupBy("doc_id", "sum", "mask", "part").agg(F.count(F.lit(1)).alias("n"))
    yes = labels.groupBy("doc_id", F.lit(0).alias("salt")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    # null ids meet no label; the salt spreads them
    rows = rows.withColumn("salt", F.when(F.col("doc_id").isNull(), F.hash("sum")).otherwise(F.lit(0)))
    known = rows.join(yes, ["doc_id", "salt"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("good", "toxic")})
    # nulls order last: (is null, id) is the smallest for the smallest id that is there
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")
    same = known.groupBy("sum", "mask", "part", "good", "toxic").agg(F.sum("n").alias("n"), F.min(F.struct(first.alias("first"), "n")).alias("low"))
    least = F.min("low.first").over(Window.partitionBy("sum"))
    kept = same.withColumn("own", F.when(F.col("low.first") == least, F.col("low.n")).otherwise(F.lit(0)))
    split = kept.select("part", "good", "toxic", F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("own").alias("n")), F.struct((F.col("mask") + copy).alias("mask"), (F.col("n") - F.col("own")).alias("n")))).alias("x"))
    n = F.col("x.n")
    counted = split.filter(n > 0).groupBy("part", F.col("x.mask").alias("mask"))
    return counted.agg(F.sum(n).alias("n"), F.sum(n * F.col("good")).alias("good"), F.sum(n * F.col("toxic")).alias("toxic"))


def removal_polynomial(counts: dict[int, int], n: int) -> list[int]:
    """Coefficients of V, by the set of variables of each monomial (as a bit mask)."""
    return [0] + [(-1) ** (bin(t).count("1") + 1) * sum(c for mask, c in counts.items() if mask & t == t) for t in range(1, 1 << n)]


def at_corner(polynomial: list[int], chosen: int) -> int:
    """V where the chosen variables are 1 and the others 0."""
    return sum(c for t, c in enumerate(polynomial) if t & chosen == t)


def shapley(polynomial: list[int], i: int) -> Fraction:
    """Integral over t from 0 to 1 of the partial derivative by variable i at (t, ..., t)."""
    return sum((Fraction(c, bin(t).count("1")) for t, c in enumerate(polynomial) if t >> i & 1), Fraction(0))


def orders_of(letters: str, counts: list[tuple[int, int, int, int]]) -> list[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of every order and
    step, from the rows (mask, n, good, toxic) of one part."""
    n = len(letters)
    every, good, toxic = (removal_polynomial({row[0]: row[k] for row in counts}, n) for k in (1, 2, 3))
    total, whole = sum(row[1] for row in counts), (1 << n) - 1
    corners = [[at_corner(p, s) for s in range(1 << n)] for p in (every, good, toxic)]
    alone = [corners[0][whole] - corners[0][whole ^ (1 << i)] for i in range(n)]
    values = [int(shapley(every, i) * math.factorial(n)) for i in range(n)]
    out = []
    for order in itertools.permutations(range(n)):
        name, done = "".join(letters[i] for i in order), 0
        for step, i in enumerate(order, 1):
            now = done | 1 << i
            removed, good_lost, toxic_lost = (c[now] - c[done] for c in corners)
            out.append((name, step, total - corners[0][now], removed, corners[0][1 << i] - removed, alone[i], good_lost, toxic_lost, values[i]))
            done = now
    return out


ROWS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def audit(docs: DataFrame, labels: DataFrame, filters: Callable[[Column], Column] = text_filters, part: str = "lang") -> DataFrame:
    """One row for each part, order of the filters and step."""
    names = docs.select(filters(F.lit("")).alias("f")).schema["f"].dataType.fieldNames()
    letters = "".join(names) + COPIES
    if len(letters) > MOST_FILTERS or len(letters) != len(names) + 1 or len(set(letters)) != len(letters):
        raise ValueError(f"filters need different single letters other than {COPIES}, {MOST_FILTERS - 1} at most")
    counts = mask_counts(docs, labels, filters, part)
    # at most 2 ** n rows a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("counts"))

    def run(batches):
        types = [pa.string(), pa.int32()] + [pa.int64()] * 7
        for batch in batches:
            for name, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = orders_of(letters, [(c["mask"], c["n"], c["good"], c["toxic"]) for c in held])
                columns = [pa.array([row[k] for row in rows], t) for k, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *columns], [c.split()[0] for c in ROWS.split(", ")])

    return parts.mapInArrow(run, ROWS)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return audit(docs, labels)
