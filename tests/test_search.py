"""Phrase search by scan and by index against brute force."""

from __future__ import annotations

import math
import random
import re

from graphloom.operators import search

PHRASES = ("a b", "a a", "a", "b-c a", "zz", "a zz", "", "x.y", "a b c d")


def brute(docs, phrase):
    terms = phrase.lower().replace("-", " ").split()
    words = lambda t: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w]
    length = [sum(len(words(t)) for t in d[1:]) for d in docs]
    hits = [sum(words(t)[i : i + len(terms)] == terms for t in d[1:] for i in range(len(words(t)))) if terms else 0 for d in docs]
    df, mean = sum(h > 0 for h in hits), sum(length) / len(docs)
    idf = math.log(1 + (len(docs) - df + 0.5) / (df + 0.5))
    return sorted((str(d[0]), h, round(idf * h * 2.2 / (h + 1.2 * (0.25 + 0.75 * n / mean)), 6)) for d, h, n in zip(docs, hits, length) if h)


def test_search_and_index(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: "".join(rng.choice("abcAB") + rng.choice([" ", ", ", "\n", "-", "é", ""]) for _ in range(n))
    docs = [(i, text(rng.randint(0, 40)), rng.choice([None, "", "a b", text(9)])) for i in range(80)] + [(7, "a a a a", None), (None, "a b", "a b"), (81, None, None), (82, "a " * 3000, "")]
    df = spark.createDataFrame(docs, "id long, body string, title string").repartition(3)
    path = f"file://{tmp_path}/index"
    search.build_index(df, "id", path, "body", "title", buckets=8, shares=3)
    for phrase in PHRASES:
        want = brute(docs, phrase)
        for found in (search.search(df, "id", phrase, "body", "title"), search.search_index(spark, path, phrase)):
            assert sorted((str(r.key), r.hits, round(r.score, 6)) for r in found.collect()) == want, phrase


def test_index_reads_only_the_buckets_of_the_words(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    df = spark.createDataFrame([(i, f"w{i} w{i + 1} same") for i in range(200)], "id long, body string")
    search.build_index(df, "id", path, "body", buckets=32)
    found = search.search_index(spark, path, "w5 w6")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PartitionFilters: [isnotnull(bucket") >= 2 and [r.key for r in found.collect()] == [5]
    assert search.search_index(spark, path, "w5 w7").count() == 0
    search.build_index(df.limit(0), "id", path, "body")
    assert search.search_index(spark, path, "same").count() == 0
