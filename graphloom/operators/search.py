"""Search: postings, phrases ranked by BM25, keyword relevance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.lineage import cut
from graphloom.operators.traverse import reach

K1, B = 1.2, 0.75
WORD_BREAK = "[^a-z0-9]+"


def postings(docs: DataFrame, key: str, *columns: str) -> DataFrame:
    """(key, field, position, term) of every word of the text columns."""
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("body")) for c in columns])).alias("x")
    words = docs.select(F.col(key).alias("key"), fields).select("key", "x.field", F.posexplode(F.array_remove(F.split(F.lower(F.coalesce("x.body", F.lit(""))), WORD_BREAK), "")).alias("position", "term"))
    return words


def _terms(phrase: str) -> list[str]:
    """The words of a phrase; none if one of them can be no word of a text."""
    terms = [t for t in phrase.lower().replace("-", " ").split() if t]
    return terms if all(re.fullmatch("[a-z0-9]+", t) for t in terms) else []


def _ranked(found: DataFrame, whole: DataFrame) -> DataFrame:
    """(key, hits, score) of found(key, length, hits), by BM25 over the phrase; whole: n_docs, mean, df (one row)."""
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    score = idf * F.col("hits") * (K1 + 1) / (F.col("hits") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return found.join(F.broadcast(whole)).select("key", F.col("hits").cast("long").alias("hits"), score.alias("score"))


def search(docs: DataFrame, key: str, phrase: str, *columns: str) -> DataFrame:
    """(key, hits, score) of documents that hold the words of the phrase in a row in one field, by BM25 over the phrase.

    One pass over all texts; build_index() and search_index() answer many phrases. A phrase without words meets nothing.
    """
    terms = _terms(phrase)
    bodies = [F.lower(F.coalesce(c, F.lit(""))) for c in columns]
    # places where the first word begins and the others follow, so that phrases that overlap themselves are all counted
    pattern = F.lit(f"(?<![a-z0-9]){'[^a-z0-9]+'.join(terms[:1])}(?=" + "".join(f"[^a-z0-9]+{t}" for t in terms[1:]) + "(?![a-z0-9]))") if terms else None
    hits = [F.regexp_count(b, pattern) if terms else F.lit(0) for b in bodies]
    per_doc = docs.select(F.col(key).alias("key"), sum((F.regexp_count(b, F.lit("[a-z0-9]+")) for b in bodies), F.lit(0)).alias("length"), sum(hits, F.lit(0)).alias("hits"))
    whole = per_doc.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean"), F.count_if(F.col("hits") > 0).alias("df"))
    return _ranked(per_doc.where("hits > 0"), whole)


def build_index(docs: DataFrame, key: str, path: str, *columns: str, buckets: int = 256, shares: int = 16) -> None:
    """Writes a positional inverted index of the text columns to a folder.

    Postings (term, key, field, places, length of the whole document) lie in `buckets` folders by the hash of the term, sorted by
    term; `shares` of the documents of a term go to different tasks and files, so that a term of every document is no task's alone.
    """
    spark, field = docs.sparkSession, [F.struct(F.lit(k).alias("field"), F.col(c).alias("body")) for k, c in enumerate(columns)]
    length = sum((F.regexp_count(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+")) for c in columns), F.lit(0))
    docs = docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), length.alias("length"), *columns)
    fields = docs.select("key", "row", "length", F.explode(F.array(*field)).alias("x")).select("key", "row", "length", "x.field", F.lower(F.coalesce("x.body", F.lit(""))).alias("body"))
    words = fields.select("key", "row", "length", "field", F.posexplode(F.array_remove(F.split("body", WORD_BREAK), "")).alias("place", "term"))
    words = words.withColumns({"bucket": F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"), "share": F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int")})
    dealt = words.repartition("bucket", "share").groupBy("bucket", "share", "term", "key", "row", "field").agg(F.array_sort(F.collect_list("place")).alias("places"), F.first("length").alias("length"))
    dealt.drop("share").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("length").alias("mean"), F.lit(buckets).alias("buckets"), F.lit(docs.schema["key"].dataType.simpleString()).alias("kind")).write.mode("overwrite").parquet(f"{path}/whole")


def search_index(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """What search() gives, from an index; only the buckets of the phrase's words are read.

    The rarest word decides where the phrase can be; the places of the others, shifted by their distance to it, are
    intersected with its places.
    """
    terms = _terms(phrase)
    whole = spark.read.parquet(f"{path}/whole")
    buckets, kind = whole.select("buckets", "kind").first()
    postings_ = spark.read.schema(f"term string, key {kind}, row long, field int, places array<int>, length int, bucket int").parquet(f"{path}/postings")
    where = {r["t"]: r["b"] for r in spark.createDataFrame([(t,) for t in {*terms, "a"}], "t string").select("t", F.pmod(F.xxhash64("t"), F.lit(buckets)).cast("int").alias("b")).collect()}
    held = {t: postings_.where((F.col("bucket") == where[t]) & (F.col("term") == t)).drop("bucket", "term") for t in terms}
    counts = {t: df.count() for t, df in held.items()}
    if not terms or not all(counts.values()):
        return spark.createDataFrame([], f"key {kind}, hits long, score double")
    rare = min(range(len(terms)), key=lambda k: counts[terms[k]])
    found = held[terms[rare]]
    for k in sorted((k for k in range(len(terms)) if k != rare), key=lambda k: counts[terms[k]]):
        other = held[terms[k]].select("row", "field", F.transform("places", lambda x: x - (k - rare)).alias("also"))
        found = found.join(other, ["row", "field"]).withColumn("places", F.array_intersect("places", "also")).drop("also").where(F.size("places") > 0)
    per_doc = found.groupBy("row", "key").agg(F.sum(F.size("places")).alias("hits"), F.first("length").alias("length"))
    return _ranked(per_doc, whole.join(F.broadcast(per_doc.agg(F.count(F.lit(1)).alias("df")))))


def relevant_nodes(g: Graph, words: list[str]) -> DataFrame:
    """(id, score, why) of all nodes by how many of the words their id, title or path has, then of the nodes these lead to.

    why is match, same_file, inheritance (ten first parents up and the children of classes, with the nodes of their files)
    or import (files that a found file imports and that hold a name like a word, with their nodes). Order is by score.
    """
    title, path = (F.lower(F.coalesce(c, F.lit(""))) for c in ("title", "file_path"))
    words = [w.lower() for w in words]
    # read many times below
    nodes = cut(g.nodes.select("id", "title", "file_path", "node_type", "node_kind"), "nodes")
    edges = cut(g.edges.where("relation in ('inherits', 'imports')").select("src", "dst", "relation", "ord"), "edges")

    def has(w: str) -> Column:
        turned = (F.length(title) >= 5) & F.lit(w).contains(F.regexp_replace(title, "^_+", ""))
        return F.lower("id").contains(w) | title.contains(w) | path.contains(w) | turned

    def of_kind(kind: str) -> Column:
        return F.coalesce(F.lower("node_kind") == kind, F.lit(False)) | F.coalesce(F.col("node_type") == kind, F.lit(False))

    def in_files(ids: DataFrame) -> DataFrame:
        files = nodes.join(ids, "id", "left_semi").where("file_path is not null").select("file_path").distinct()
        return nodes.join(files, "file_path", "left_semi").select("id")

    def grown(found: DataFrame, ids: DataFrame, why: str) -> DataFrame:
        new = ids.distinct().join(found, "id", "left_anti").join(nodes, "id", "left_semi")
        return cut(found.unionByName(new.select("id", F.lit(0).alias("score"), F.lit(why).alias("why"))), why)

    score = sum((has(w).cast("int") for w in words), F.lit(0))
    found = cut(nodes.select("id", score.alias("score"), F.lit("match").alias("why")).where("score > 0"), "match")
    found = grown(found, in_files(found.select("id")), "same_file")

    kin = edges.where("relation = 'inherits'").select("src", "dst", "ord")
    classes = nodes.where(of_kind("class")).join(found, "id", "left_semi").select("id").distinct()
    parents = kin.groupBy(F.col("src").alias("at")).agg(F.min_by("dst", "ord").alias("to"), F.lit("inherits").alias("via"), F.min("ord").alias("ord"))
    seeds = classes.join(parents, classes["id"] == parents["at"], "left_semi").select(F.col("id").alias("seed"))
    above = reach(parents, seeds, 10).select("id")
    below = kin.join(classes, kin["dst"] == classes["id"], "left_semi").select(F.col("src").alias("id"))
    kin_ids = above.unionByName(below).distinct().join(found, "id", "left_anti")
    found = grown(found, kin_ids.unionByName(in_files(kin_ids)), "inheritance")

    files = nodes.where(of_kind("file")).select("id", "file_path")
    near = files.join(found, "id", "left_semi").select(F.col("id").alias("src")).distinct()
    imported = edges.where("relation = 'imports'").join(near, "src", "left_semi").select(F.col("dst").alias("id")).distinct()
    like = F.lit(False)
    for w in words:
        like = like | title.contains(w) | F.lit(w).contains(title)
    named = nodes.where(~of_kind("file") & like).select("file_path").distinct()
    new = files.join(imported, "id", "left_semi").join(found, "id", "left_anti").join(named, "file_path", "left_semi").select("id")
    return grown(found, new.unionByName(in_files(new)), "import")
