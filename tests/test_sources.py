"""Sinks that keep all columns, and YAML graphs as a Spark source."""

from __future__ import annotations

import sqlite3

from graphloom.graph import EDGE, NODE, Graph, fill
from graphloom.sources import io

NODES = (
    "SELECT 'a' AS id, 't' AS title, 'done' AS status, 'what' AS description, 'me' AS assigned_to, array('y', 'x') AS tags, 2 AS priority, 'task' AS node_type, map('k', '1', 'l', '\"s\"') AS metadata, 'p/q.py' AS file_path, 'py' AS lang, "
    "3 AS start_line, 9 AS end_line, 'def q()' AS signature, 'public' AS visibility, 'doc' AS doc_comment, 'docs/q.md' AS doc_path, 'ff' AS body_hash, 'Function' AS node_kind, 'o' AS owner, 'extract' AS source, 'r' AS repo, 'z' AS parent_id, "
    "4 AS depth, 1.5D AS complexity, true AS is_public, 'return' AS body, '2024' AS created_at, '2025' AS updated_at, 0 AS ord, "
    "named_struct('findings', map('f', 'g'), 'file_cache', map('c', 'd'), 'tool_history', array(named_struct('tool_name', 'n', 'timestamp', 's', 'summary', 'u'))) AS knowledge"
)


def graph(spark) -> Graph:
    nodes = fill(spark.sql(NODES), NODE).unionByName(fill(spark.sql("SELECT 'b' AS id, 1 AS ord"), NODE))
    edges = fill(spark.sql("SELECT 'a' AS src, 'b' AS dst, 'calls' AS relation, 0.5D AS weight, 0.25D AS confidence, '{\"k\": 1}' AS metadata, 'extract' AS edge_source, 3 AS call_count, true AS in_error_path, 0 AS ord"), EDGE)
    return Graph(nodes, edges.unionByName(fill(spark.sql("SELECT 'b' AS src, 'gone' AS dst, 'depends_on' AS relation, 1 AS ord"), EDGE)), "project")


def test_sqlite_keeps_every_column(spark, tmp_path):
    g, path = graph(spark), f"{tmp_path}/graph.db"
    for _ in range(2):  # an old file is replaced
        io.save_sqlite(g, path)
    back = io.load_sqlite(spark, path)
    assert back.project == "project" and back.nodes.columns == g.nodes.columns and back.edges.columns == g.edges.columns
    assert [r.asDict(True) for r in back.nodes.orderBy("ord").collect()] == [r.asDict(True) for r in g.nodes.orderBy("ord").collect()]
    assert [r.asDict(True) for r in back.edges.orderBy("ord").collect()] == [r.asDict(True) for r in g.edges.orderBy("ord").collect()]
    assert sqlite3.connect(path).execute("SELECT count(*) FROM node_tags").fetchone() == (2,) and len(list(tmp_path.iterdir())) == 1


def test_a_folder_of_yaml_files(spark, tmp_path):
    from pyspark.sql import functions as F

    from graphloom.sources.yaml_source import load_yaml_folder, read_yaml

    g = graph(spark)
    io.save_yaml(g, f"{tmp_path}/one/graph.yml")
    (tmp_path / "many" / "sub").mkdir(parents=True)
    for k in range(300):
        name = f"{tmp_path}/many/{'sub/' if k % 2 else ''}g{k:03}.{'yml' if k % 3 else 'yaml'}"
        with open(name, "w") as f:
            f.write(f"project: {{name: p{k}}}\nnodes:\n- {{id: n{k}, title: {k}, type: task, tags: [a, b], metadata: {{x: 1, y: s}}}}\n- {{id: same}}\nedges:\n- {{from: n{k}, to: same}}\n- {{from: n{k}, to: same, metadata: {{source: extract}}}}\n")
    (tmp_path / "many" / "empty.yml").write_text("")
    (tmp_path / "many" / "other.txt").write_text("nodes: [{id: no}]")
    one, alone = load_yaml_folder(spark, f"{tmp_path}/one"), io.load_yaml(spark, f"{tmp_path}/one/graph.yml")
    for a, b in ((one.nodes, alone.nodes), (one.edges, alone.edges)):
        assert a.columns == b.columns and [r.asDict(True) for r in a.orderBy("ord").collect()] == [r.asDict(True) for r in b.orderBy("ord").collect()]
    nodes = read_yaml(spark, f"file://{tmp_path}/many", "nodes")
    assert nodes.rdd.getNumPartitions() == 301 and nodes.count() == 600
    row = nodes.where("id = 'n7'").first()
    assert (row.title, row.node_type, row.tags, row.metadata, row.project, row.status) == ("7", "task", ["a", "b"], {"x": "1", "y": "s"}, "p7", "todo")
    only = nodes.where(F.col("file") == row.file)
    assert only.rdd.getNumPartitions() == 1 and only.count() == 2
    whole = load_yaml_folder(spark, f"{tmp_path}/many")
    assert whole.edges.count() == 300 and whole.edges.where("edge_source is null").count() == 300
