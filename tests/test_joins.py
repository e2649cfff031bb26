"""Joins of the graph view broadcast what was measured, and queries over it do their whole job."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


def test_ids_that_only_compress_well_are_not_broadcast(spark, tmp_path):
    from graphloom.plans import registry

    for t in ("region", "nation", "supplier", "part", "orders", "lineitem"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    spark.range(1, 1_500_001).selectExpr("id AS c_custkey", "'c' AS c_name", "id % 25 AS c_nationkey").selectExpr(
        *[f"CAST({c.name} AS {c.dataType.simpleString()}) AS {c.name}" if c.name in ("c_custkey", "c_name", "c_nationkey") else f"CAST(NULL AS {c.dataType.simpleString()}) AS {c.name}" for c in customers.schema]
    ).write.parquet(str(tmp_path / "customer.parquet"))
    df = registry.queries()["j18_callers"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()  # before it runs: by estimates alone
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan
    assert df.count() == registry.queries()["j18_callers"](spark, SF).count() > 0


def test_touch_summary_takes_every_supplier(spark):
    from graphloom.plans import registry

    row = registry.queries()["a18_touch_summary"](spark, SF).first()
    assert row["n_nodes"] == spark.read.parquet(f"{SF}/supplier.parquet").count()


def test_names_in_a_long_text_are_found_in_one_pass(spark):
    import time

    from graphloom.operators.setops import mentioned

    word = "".join(chr(97 + k % 26) + chr(97 + k // 26 % 26) + "é" for k in range(100_000))
    texts = spark.createDataFrame([(1, word + "needle.rs"), (1, "x😀y"), (None, "a needle.rs"), (2, "none")], "key int, text string")
    names = spark.createDataFrame([(x,) for x in ("needle.rs", "😀y", "n", "", "needle.rs2", "ab é")], "name string")
    began = time.time()
    got = {tuple(r) for r in mentioned(texts, names).collect()}
    assert got == {(1, "needle.rs"), (1, "😀y"), (1, "n"), (None, "needle.rs"), (None, "n"), (2, "n")}
    assert time.time() - began < 40  # time grows with the length, not with its square


def test_a_task_reads_few_rows_of_what_is_written_between_steps(spark):
    from pyspark.sql import functions as F

    from graphloom.lineage import SHUFFLE_PARTS, cut
    from graphloom.sources.graph_view import build_graph

    build_graph(spark, SF)
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "8MB"
    assert int(spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) >= SHUFFLE_PARTS
    ids = cut(spark.range(5_000_000, numPartitions=1).selectExpr("concat('order:', id) AS id"))
    assert ids.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2_000_000
