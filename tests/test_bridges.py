from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.operators import setops


def test_ids_meet_the_segments_they_contain(spark):
    project = ["task:111-abab", "task:ABCDE", "a", "", "x/ab/cde", "Zürich-über"]
    code = ["f:src/1/11/111.rs", "f:lib/ab.x", "f:abab/ab", "f:abc.py", "f:über/é", "f:main.rs", "cde", "f:abcdefgh"]
    nodes = spark.createDataFrame([(i, None, None) for i in project] + [(i, "extract", f"p{k}") for i in code for k in range(2)], "id string, source string, file_path string")
    found = sorted(tuple(r) for r in setops.bridge_edges(Graph(nodes, None)).collect())
    segments = {"f:src/1/11/111.rs": ["1", "11", "111"], "f:lib/ab.x": ["ab"], "f:abab/ab": ["abab", "ab"], "f:abc.py": ["abc"], "f:über/é": ["über", "é"], "f:main.rs": [], "cde": ["cde"], "f:abcdefgh": ["abcdefgh"]}
    assert found == sorted((p, c, 0.8) for p in project for c in code if any(s in p.lower() for s in segments[c]))


def test_segments_that_begin_alike_do_not_meet_every_id(spark):
    """100,000 segments and 1,000 ids share their first letters: 100 million meetings before, five pieces an id now."""
    code = spark.range(100_000).select(F.concat(F.lit("f:abc"), F.col("id").cast("string")).alias("id"), F.lit("extract").alias("source"))
    project = spark.range(1000).select(F.concat(F.lit("t:abc"), (F.col("id") + 10**5).cast("string")).alias("id"), F.lit(None).cast("string").alias("source"))
    nodes = code.unionByName(project).withColumn("file_path", F.col("id"))
    edges = setops.bridge_edges(Graph(nodes, None))
    assert edges.count() == 1000 * 5  # abc1, abc10, ... of each id
    assert "contains" not in edges._jdf.queryExecution().executedPlan().toString().lower()
