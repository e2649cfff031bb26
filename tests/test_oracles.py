"""Some queries against their SQL on the smallest driver tables, where these are at hand."""

from __future__ import annotations

import os
from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = ("g01_impact_filtered", "g26_ready_tasks", "a06_fold_call_edges", "a10_co_citation", "u02_snapshot_diff", "j01_missing_refs", "m09_rename", "f01_slugify", "x06_call_edges", "j17_drift", "st_daily_counts",
        "a02_health", "a19_complexity", "g29_layer_violations", "m17_dead_code", "j12_bridge_edges", "p09_resolve_node", "m13_backfill", "g04_topological_ranks", "g22_execution_layers", "x06_rust_calls", "r07_task_context", "f04_classify_error")


def value(v):
    return round(v, 6) if isinstance(v, float) else float(v) if v.__class__.__name__ == "Decimal" else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    import duckdb

    from graphloom.plans import registry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = Counter(tuple(value(r[c]) for c in columns) for r in df.collect())
    found = con.execute(registry.oracle_sql()[name])
    at = [[d[0] for d in found.description].index(c) for c in columns]
    assert got == Counter(tuple(value(r[i]) for i in at) for r in found.fetchall())


def test_entry_module_lists_queries():
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
