"""Logs of operations against the operations one by one; versions that are damaged, raced or restored."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from graphloom.graph import EDGE, NODE, Graph
from graphloom.operators import oplog
from graphloom.sources import versions

NODE_DDL = "id string, title string, tags array<string>, metadata map<string,string>, ord long"
EDGE_DDL = "src string, dst string, relation string, weight double, ord long"


def struct(ddl: str) -> str:
    return "struct<" + ", ".join(f"{x.split(' ', 1)[0]}:{x.split(' ', 1)[1]}" for x in ddl.split(", ")) + ">"


OPS = f"seq long, op string, id string, node {struct(NODE_DDL)}, src string, dst string, relation string, edge {struct(EDGE_DDL)}, tags array<string>, metadata map<string,string>"


def one_by_one(nodes, edges, ops):
    nodes, edges = dict(nodes), list(edges)
    for o in sorted(ops, key=lambda o: o["seq"]):
        if o["op"] == "put_node":
            nodes[o["id"]] = dict(o["node"])
        elif o["op"] == "delete_node":
            nodes.pop(o["id"], None)
            edges = [e for e in edges if o["id"] not in (e["src"], e["dst"])]
        elif o["op"] == "add_edge":
            edges.append(dict(o["edge"]))
        elif o["op"] == "remove_edge":
            edges = [e for e in edges if (e["src"], e["dst"], e["relation"]) != (o["src"], o["dst"], o["relation"])]
        else:
            key = o["op"][4:]
            if o["id"] not in nodes:
                raise ValueError
            nodes[o["id"]] = nodes[o["id"]] | {key: o[key]}
    return nodes, edges


def random_log(seed: int, n: int = 60):
    rng = random.Random(seed)
    ids = [f"n{k}" for k in range(8)]
    node = lambda i: {"id": i, "title": f"t{rng.randrange(99)}", "tags": [f"g{rng.randrange(5)}"], "metadata": {"k": str(rng.randrange(9))}, "ord": rng.randrange(99)}
    edge = lambda: {"src": rng.choice(ids), "dst": rng.choice(ids), "relation": rng.choice("ab"), "weight": rng.random(), "ord": rng.randrange(99)}
    nodes = {i: node(i) for i in ids[:5]}
    edges = [edge() for _ in range(20)]
    there, ops = set(nodes), []
    for seq in range(n):
        op = rng.choice(oplog.OPERATIONS[:6])
        if op.startswith("set") and not there:
            continue
        e = edge()
        i = rng.choice(sorted(there)) if op.startswith("set") else rng.choice(ids)
        there = there | {i} if op == "put_node" else there - {i} if op == "delete_node" else there
        ops.append({"seq": seq, "op": op, "id": i, "node": node(i), "edge": e, "tags": [f"s{seq}"], "metadata": {"s": str(seq)}} | {k: e[k] for k in ("src", "dst", "relation")})
    rng.shuffle(ops)
    return nodes, edges, ops


def plain(rows):
    return sorted(repr(sorted((k, sorted(v.items()) if isinstance(v, dict) else v) for k, v in r.items())) for r in rows)


def graph(spark, nodes, edges) -> Graph:
    return Graph(spark.createDataFrame(list(nodes.values()), NODE_DDL), spark.createDataFrame(edges, EDGE_DDL))


@pytest.mark.parametrize("seed", range(4))
def test_log_equals_operations_one_by_one(spark, seed):
    nodes, edges, ops = random_log(seed)
    got = oplog.apply_log(graph(spark, nodes, edges), spark.createDataFrame(ops, OPS).repartition(3))
    want_nodes, want_edges = one_by_one(nodes, edges, ops)
    assert plain(r.asDict() for r in got.nodes.collect()) == plain(want_nodes.values())
    assert plain(r.asDict() for r in got.edges.collect()) == plain(want_edges)


def test_set_on_a_missing_node_refuses_all(spark):
    nodes, edges, _ = random_log(0)
    g = graph(spark, nodes, edges)
    for ops in ([{"seq": 1, "op": "set_tags", "id": "nowhere", "tags": ["x"]}], [{"seq": 1, "op": "delete_node", "id": "n0"}, {"seq": 2, "op": "set_tags", "id": "n0", "tags": ["x"]}], [{"seq": 1, "op": "grow", "id": "n0"}]):
        with pytest.raises(ValueError):
            oplog.apply_log(g, spark.createDataFrame(ops, OPS))
    assert oplog.apply_log(g, spark.createDataFrame([], OPS)).edges.count() == len(edges)


def test_checksum_sees_flips_losses_repeats_and_moves(spark):
    nodes, edges, _ = random_log(1)
    df = graph(spark, nodes, edges).nodes
    whole = versions.checksum(df)
    assert versions.checksum(df.repartition(5)) == whole
    flipped = df.withColumn("title", F.when(F.col("id") == "n1", "other").otherwise(F.col("title")))
    lost, repeated = df.where("id <> 'n2'"), df.unionByName(df.where("id = 'n3'"))
    for k, other in (("changed", flipped), ("lost", lost), ("extra", repeated)):
        assert versions.checksum(other) != whole
        assert [(r.change, r.n) for r in versions.differences(df, other, ["id"]).collect()] == [(k, 1)]
    a = spark.createDataFrame([(None, "x"), ("y", None)], "a string, b string")
    b = spark.createDataFrame([("x", None), (None, "y")], "a string, b string")
    assert versions.checksum(a) != versions.checksum(b)
    assert versions.checksum(spark.createDataFrame([({"p": "1", "q": "2"},)], "m map<string,string>")) == versions.checksum(spark.createDataFrame([({"q": "2", "p": "1"},)], "m map<string,string>"))
    assert versions.checksum(df.limit(0)) == {"rows": 0, "total": "0", "mix": "0"}


def test_versions(spark, tmp_path, monkeypatch):
    nodes, edges, ops = random_log(2)
    store, g = versions.Versions(spark, f"file://{tmp_path}/store"), graph(spark, nodes, edges)
    assert store.current() == 0 and store.commit(g, "first") == 1 and store.verify() == []
    assert store.apply(spark.createDataFrame(ops, OPS), "log") == 2
    assert plain(r.asDict() for r in store.read().nodes.collect()) == plain(one_by_one(nodes, edges, ops)[0].values())
    with pytest.raises(versions.Conflict):  # another writer was faster
        store.commit(g, base=1)
    monkeypatch.setattr(versions, "checksum", lambda df: {})  # what is read back differs
    with pytest.raises(versions.Damaged):
        store.commit(g)
    monkeypatch.undo()
    assert store.numbers() == [2, 1] and len(list((tmp_path / "store" / "data").iterdir())) == 2
    assert store.restore(1) == 3 and versions.checksum(store.read().edges) == versions.checksum(g.edges)
    path = store.version(1).tables["nodes"]["path"]
    g.nodes.where("id <> 'n0'").write.mode("overwrite").parquet(f"{tmp_path}/store/{path}")
    assert len(store.verify(1)) >= 2
    with pytest.raises(versions.Damaged):
        store.restore(1)
    assert store.prune(1) == [2, 1] and store.numbers() == [3]


def test_all_node_columns_survive_a_migration(spark, tmp_path):
    from graphloom.graph import fill

    row = spark.sql(
        "SELECT 'a' AS id, 't' AS title, 'done' AS status, array('x', 'y') AS tags, 2 AS priority, 'task' AS node_type, map('k', '1') AS metadata, true AS is_public, 1.5D AS complexity, 0 AS ord, "
        "named_struct('findings', map('f', 'g'), 'file_cache', map('c', 'd'), 'tool_history', array(named_struct('tool_name', 'n', 'timestamp', 's', 'summary', 'u'))) AS knowledge"
    )
    g = Graph(fill(row, NODE), fill(spark.createDataFrame([("a", "a", "calls")], "src string, dst string, relation string"), EDGE), "p")
    store = versions.Versions(spark, f"file://{tmp_path}/new")
    report = store.migrate(g, ["task"], ["calls"])
    assert (report["nodes"], report["edges"], report["tags"], report["metadata"], report["status"], report["backup"]) == (1, 1, 2, 1, "success", None)
    back = store.read()
    assert len(back.nodes.columns) == 31 and back.nodes.collect() == g.nodes.collect() and back.edges.collect() == g.edges.collect() and back.project == "p"
    with pytest.raises(ValueError):
        store.migrate(g, ["file"], ["calls"])
    assert store.migrate(g, ["file"], ["calls"], strict=False)["backup"] == 1
