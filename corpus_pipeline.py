"""The corpus pipeline: quality rules, n-gram Jaccard join, suffix-array dedup, personal data, best-fit packing.

Each stage works on all rows that the stage before it kept. All but the last return the columns of documents: the
first drops documents that the rules reject, the second keeps the smallest doc_id of each group of near duplicates,
the third takes repeated bytes out of text, the fourth replaces personal data by its kind; both set n_chars anew.
Rows with a null text are rejected by the first stage; empty tables pass through all stages as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bpe, jaccard, packing, pii, quality, suffixes
from graphloom.lineage import cut, forget, paths_made


def _recount(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_documents(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one_of_each(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(suffixes.cut_repeats(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(pii.redact(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, bpe.default_tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("personal data", personal_data),
    ("best-fit packing", best_fit_packing),
]
#: SQL can express neither the learned stages nor the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        with paths_made() as made:
            docs = cut(stage(spark, docs, sf_dir), f"stage-{k}")
        for path in held + made[:-1]:  # what the stage read and what it wrote on its way have served
            forget(spark, path)
        held = made[-1:]
    return STAGES[-1][1](spark, docs, sf_dir)
