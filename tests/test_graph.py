"""Small hand-made graphs with exact expected results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.graph import EDGE, NODE, Graph, fill
from graphloom.operators import advise, aggregates, community, components, context, extract, integrity, mutate, projection, scans, schedule, search, setops, traverse
from graphloom.sources import io


def graph(spark, nodes, edges):
    """nodes: ids or (id, fields); edges: (src, dst, relation, confidence)."""
    rows = [(n, "task", "todo", None) if isinstance(n, str) else (n[0], n[1].get("node_type", "task"), n[1].get("status", "todo"), n[1].get("file_path")) for n in nodes]
    n = fill(spark.createDataFrame([(r[0], r[0], *r[1:], i) for i, r in enumerate(rows)], "id string, title string, node_type string, status string, file_path string, ord long"), NODE)
    full = [(*e, *(("depends_on", None)[len(e) - 2 :]), i) for i, e in enumerate(edges)]
    return Graph(n, fill(spark.createDataFrame(full, "src string, dst string, relation string, confidence double, ord long"), EDGE))


def ids(df, column="id"):
    return {r[column] for r in df.select(column).collect()}


def test_impact_by_relation(spark):
    g = graph(spark, "ABCDE", [("A", "B"), ("B", "C"), ("A", "D", "implements"), ("E", "D", "belongs_to")])
    assert ids(traverse.impact(g, "C")) == {"A", "B"}
    assert ids(traverse.impact(g, "D", "depends_on")) == set() and ids(traverse.impact(g, "D")) == {"A", "E"}


def test_confidence_hides_edges(spark):
    g = graph(spark, ["wm", "r1", "r2", "r3", "p", "t", "d"], [("r1", "wm", "calls", 1.0), ("r2", "wm", "calls", 1.0), ("r3", "wm", "calls", 0.9), ("p", "wm", "calls", 0.6), ("t", "wm", "calls", 0.6), ("d", "wm", "calls", 0.6)])
    assert ids(traverse.impact(g, "wm", None, 0.8)) == {"r1", "r2", "r3"} and traverse.hidden_edges(g, "wm").first()[0] == 3
    assert len(ids(traverse.impact(g, "wm", None, 0.0))) == 6 and traverse.hidden_edges(g, "wm", None, 0.0).first()[0] == 0


def test_gate_blocks_traversal(spark):
    g = graph(spark, "ABC", [("A", "B", "calls", 1.0), ("B", "C", "calls", 0.6)])
    assert ids(traverse.deps(g, "A")) == {"B"} and traverse.hidden_edges(g, "A", direction="out").first()[0] == 1


def test_cycles(spark):
    g = graph(spark, "abcde", [("a", "b"), ("b", "a"), ("c", "d"), ("d", "c"), ("e", "e")])
    assert {tuple(r) for r in integrity.cycles(g).collect()} == {("a", "a"), ("a", "b"), ("c", "c"), ("c", "d")}
    diamond = graph(spark, "abcd", [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")])
    assert integrity.cycles(diamond).count() == 0 and ids(traverse.neighbors(diamond, "a", 2, "out")) == set("abcd")
    blocks = graph(spark, "ab", [("a", "b", "blocks"), ("b", "a", "blocks")])
    assert integrity.cycles(blocks).count() == 0 and integrity.cycles(blocks, ("blocks",)).count() == 2
    joined = graph(spark, "abcdef", [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "d")])
    assert {tuple(r) for r in integrity.cycles(joined).collect()} == {("a", x) for x in "abc"} | {("d", x) for x in "def"}


def test_depth_path_and_cycle_check(spark):
    g = graph(spark, "abcd", [("a", "b"), ("b", "c"), ("c", "d")])
    assert [len(ids(traverse.neighbors(g, "a", k, "out"))) for k in (0, 1, 2)] == [1, 2, 3]
    assert [r.id for r in traverse.path(g, "d", "a").orderBy("position").collect()] == ["d", "c", "b", "a"]
    assert traverse.would_create_cycle(g, "d", "a") and not traverse.would_create_cycle(g, "a", "d")
    assert traverse.bounded_path(g, "a", "d", 2).count() == 0 and traverse.bounded_path(g, "a", "d", 3).count() == 4


def test_schedule(spark):
    g = graph(spark, "abcd", [("b", "a"), ("c", "b"), ("d", "a")])
    assert [r.id for r in schedule.critical_path(g).orderBy("position").collect()] == ["a", "b", "c"]
    assert {r.id: r.layer for r in schedule.execution_layers(g).collect()} == {"a": 0, "b": 1, "d": 1, "c": 2}
    done = graph(spark, [("a", {"status": "done"}), "b"], [("b", "a")])
    assert {r.id: r.layer for r in schedule.execution_layers(done).collect()} == {"b": 0}
    odd = graph(spark, ["A", "B", ("F", {"node_type": "feature"})], [("A", "B"), ("A", "F")])
    assert {r.id: r.layer for r in schedule.execution_layers(odd).collect()} == {"B": 0, "A": None}
    assert {r.id: r.layer for r in schedule.execution_layers(odd, strict=True).collect()} == {"B": 0, "A": 1}
    ghost = graph(spark, "a", [("a", "ghost")])
    assert schedule.topological_ranks(ghost).first()["rank"] is None
    assert ids(schedule.orphan_tasks(graph(spark, "abc", [("b", "a")]))) == {"c"}
    assert ids(schedule.newly_ready(g, "a")) == {"b", "d"}


def test_resolve_node(spark):
    g = graph(spark, ["feat-auth", "task-auth-login", "impl-jwt", ("file-main", {"file_path": "src/main.rs"})], [])
    assert ids(scans.resolve_node(g, "auth")) == {"feat-auth", "task-auth-login"} and ids(scans.resolve_node(g, "main.rs")) == {"file-main"}


def test_health_of_no_project_nodes_is_nan(spark):
    g = graph(spark, "a", [])
    code = g.with_nodes(g.nodes.withColumn("source", F.lit("extract")))
    assert aggregates.health(code).first()[0] != aggregates.health(code).first()[0]
    assert aggregates.health(g.with_nodes(g.nodes.limit(0))).first()[0] == 0.0


def test_diff_merge_repair(spark):
    g = graph(spark, "abc", [("a", "b"), ("a", "b"), ("b", "b"), ("a", "ghost")])
    assert setops.diff(g, g).count() == 0
    fixed, plan = integrity.repair(g)
    assert {tuple(r) for r in fixed.edges.select("src", "dst").collect()} == {("a", "b")}
    assert {r.kind for r in plan.collect()} == {"duplicate_edge", "self_edge", "orphan_edge", "orphan_node"}
    merged = mutate.merge(g, "a", "c", "ac")
    assert ids(merged.nodes) == {"b", "ac"} and ids(mutate.merge(g, "a", "c", "a").nodes) == {"b"}
    with pytest.raises(ValueError):
        mutate.rename(g, "a", "b")


def test_co_citation_and_communities(spark):
    e = [("f1", "a"), ("f1", "b"), ("f2", "a"), ("f2", "b"), ("f2", "c"), ("f3", "d"), ("f3", "e")]
    g = graph(spark, ["a"], [(s, d, "imports") for s, d in e])
    assert [(r.a, r.b, round(r.weight, 6)) for r in projection.co_citation(g.edges).collect()] == [("a", "b", 0.8)]
    links = [(i, j, 1.0) for base in (0, 4) for i in range(base, base + 4) for j in range(base, base + 4) if i != j] + [(0, 4, 0.1)]
    module, bits = community.optimise(8, links)
    assert len(set(module[:4])) == 1 and len(set(module[4:])) == 1 and module[0] != module[4]
    p, flow = community.flows(8, links, 0.05)
    assert bits <= community.codelength(p, flow, [0] * 8) and community.optimise(8, links) == (module, bits)
    net = spark.createDataFrame([(f"n{a}", f"n{b}", w) for a, b, w in links], "a string, b string, weight double")
    found = {r.file: r.community for r in community.communities(net).collect()}
    assert found["n0"] == found["n3"] != found["n4"]


def test_text_functions(spark):
    cases = spark.createDataFrame([(x,) for x in ("getOAuthToken", "HTMLParser", "XMLHttpRequest", "parseJSON", "")], "s string")
    got = [r[0] for r in cases.select(X.split_camel_case(F.col("s"))).collect()]
    assert got == [["get", "O", "Auth", "Token"], ["HTML", "Parser"], ["XML", "Http", "Request"], ["parse", "JSON"], []]
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.symbol_tokens(F.lit("getOAuthToken"))) == ["auth", "token"] and one(X.symbol_tokens(F.lit("aB"))) == []
    assert [one(X.slugify(F.lit(s))) for s in ("Hello, World!", "é", "a--b", "")] == ["hello-world", "unnamed", "a-b", "unnamed"]
    assert one(X.normalize_relative(F.lit("../x"))) is None and one(X.normalize_relative(F.lit("a/./b/../c"))) == "a/c"
    assert one(X.common_prefix_len(F.lit("src/a/x"), F.lit("src/b/x"))) == 4
    assert one(X.keywords(F.lit("the AuthManager and auth_token auth_token in x.y zz"))) == ["AuthManager", "auth_token", "x.y"]


def test_budget(spark):
    rows = [("t", 0, "implements", "target", 1.0, 100, 0), ("a", 1, "calls", "direct", 0.9, 80, 1), ("b", 1, "calls", "direct", 0.8, 90, 2), ("c", 2, "calls", "transitive", 0.5, 10, 3)]
    found = spark.createDataFrame(rows, "id string, hop int, relation string, category string, score double, tokens int, ord long")
    state = {r.id: (r.state, r.tokens) for r in context.fit_budget(found, 200).collect()}
    assert state == {"t": ("included", 100), "a": ("included", 80), "b": ("dropped", 0), "c": ("included", 10)}
    assert {r.id: r.tokens for r in context.fit_budget(found, 230).collect()}["b"] == 50


def test_sources_and_extract(spark, tmp_path):
    g = graph(spark, ["a", "b"], [("a", "b")])
    io.save_yaml(g, f"{tmp_path}/x/graph.yml")
    io.save_sqlite(g, f"{tmp_path}/graph.db")
    for h in (io.load_yaml(spark, f"{tmp_path}/x/graph.yml"), io.load_sqlite(spark, f"{tmp_path}/graph.db")):
        assert setops.diff(g, h).count() == 0
    assert io.detect_backend(f"{tmp_path}/x") == "yaml" and io.detect_backend(str(tmp_path)) == "sqlite"
    (tmp_path / "log.jsonl").write_text('{"event": "task_done", "ts": "2024-01-01T00:00:00Z", "turns": 20}\nnot json\n{"event": "complete", "ts": "2024-01-02T00:00:00Z", "duration_s": 200}\n')
    assert io.read_events(spark, f"{tmp_path}/log.jsonl").count() == 2 and io.read_events(spark, f"{tmp_path}/log.jsonl", "2024-01-02").count() == 1
    (tmp_path / "src/pkg").mkdir(parents=True)
    (tmp_path / "src/node_modules").mkdir()
    (tmp_path / "src/node_modules/x.py").write_text("x = 1")
    (tmp_path / "src/pkg/core.py").write_text("class A:\n    def go(self):\n        return 1\n\nclass B(A):\n    def go(self):\n        return helper()\n\ndef helper():\n    return 2\n")
    (tmp_path / "src/pkg/test_core.py").write_text("from pkg.core import helper\n\ndef test_it():\n    assert helper() == 2\n")
    (tmp_path / "src/lib.rs").write_text("pub struct S;\nfn one() { two(); }\nfn two() {}\n")
    src = io.scan_sources(spark, f"{tmp_path}/src")
    assert ids(src, "path") == {"pkg/core.py", "pkg/test_core.py", "lib.rs"}
    nodes, edges = extract.extract(src)
    got = {(r.src, r.dst, r.relation) for r in edges.collect()}
    assert ("method:pkg/core.py:B.go", "func:pkg/core.py:helper", "calls") in got and ("func:pkg/test_core.py:test_it", "func:pkg/core.py:helper", "calls") in got
    assert ("class:pkg/core.py:B", "class:pkg/core.py:A", "inherits") in got and ("method:pkg/core.py:A.go", "method:pkg/core.py:B.go", "overrides") in got
    assert ("file:pkg/test_core.py", "file:pkg/core.py", "tests_for") in got and ("func:lib.rs:one", "func:lib.rs:two", "calls") in got
    assert "module:pkg" in ids(nodes)


def test_dead_code(spark):
    g = graph(spark, [(x, {"node_type": "function"}) for x in ("main", "used", "unused", "test_a")], [("main", "used", "calls")])
    assert ids(advise.dead_code(g)) == {"unused"}


def test_relevant_nodes(spark):
    node = lambda i, kind, path=None: (i, {"node_type": kind, "file_path": path})
    nodes = [f"hit{i}" for i in range(30)]
    nodes += [node("hit_class", "class", "a"), node("beside", "file", "a"), node("parent", "class", "b"), node("by_parent", "function", "b"), node("second", "class"), node("child", "class"), node("far", "task", "z")]
    nodes += [node("imported", "file", "c"), node("hi", "function", "c"), node("other", "file", "d"), node("unlike", "function", "d")]
    edges = [("hit_class", "parent", "inherits"), ("hit_class", "second", "inherits"), ("child", "hit_class", "inherits"), ("beside", "imported", "imports"), ("beside", "other", "imports")]
    got = {r.id: (r.score, r.why) for r in search.relevant_nodes(graph(spark, nodes, edges), ["HIT", "none"]).collect()}
    expected = {f"hit{i}": (1, "match") for i in range(30)} | {"hit_class": (1, "match"), "beside": (0, "same_file")}
    assert got == expected | {k: (0, "inheritance") for k in ("parent", "by_parent", "child")} | {k: (0, "import") for k in ("imported", "hi")}


def partitions(n):
    """All ways to group 0..n-1, as module lists."""
    if n == 0:
        yield []
        return
    for rest in partitions(n - 1):
        for m in range(max(rest, default=-1) + 2):
            yield [*rest, m]


def test_map_equation_finds_the_shortest_code():
    import random

    rng = random.Random(3)
    best = 0
    for trial in range(12):
        links = [(a, b, rng.choice((0.2, 1.0, 3.0))) for a in range(7) for b in range(7) if a != b and rng.random() < (0.7 if (a < 4) == (b < 4) else 0.15)]
        p, flow = community.flows(7, links, 0.05)
        module, bits = community.optimise(7, links)
        assert abs(bits - community.codelength(p, flow, module)) < 1e-9
        shortest = min(community.codelength(p, flow, m) for m in partitions(7))
        assert bits >= shortest - 1e-9
        best += bits <= shortest + 1e-9
    assert best >= 10


def test_large_communities_are_split():
    clique = lambda at, n: [(a, b, 1.0) for a in range(at, at + n) for b in range(at, at + n) if a != b]
    links = clique(0, 10) + clique(10, 10) + clique(20, 4) + [(0, 10, 1.0)]
    parts = community.split_large([list(range(20)), list(range(20, 24))], links, 15, 0.05)
    assert sorted(map(sorted, parts)) == [list(range(10)), list(range(10, 20)), list(range(20, 24))]
    assert community.split_large([list(range(10))], links, 5, 0.05) == [list(range(10))]  # whole stays whole
    assert [community.most_members(n) for n in (1, 50, 100, 500, 5000, 10**6)] == [15, 24, 28, 38, 52, 60]


def test_orphans_join_clusters(spark):
    members = [("file:a/x", 0), ("file:a/y", 0), ("file:b/x", 1), ("file:b/y", 1), ("file:c/o1", 2), ("file:c/o2", 3), ("file:d/p", 4), ("file:d/q", 5), ("file:a/z/r", 6), ("file:zz/alone", 7)]
    edges = [("file:c/o1", "file:a/x", 1.0), ("file:b/x", "file:c/o1", 0.6), ("file:b/y", "file:c/o1", 0.6), ("file:c/o2", "file:c/o1", 0.1)]
    net = spark.createDataFrame(edges, "a string, b string, weight double")
    got = {r.file: r.cluster for r in components.reassign_orphans(spark.createDataFrame(members, "file string, cluster long"), net, 2).collect()}
    assert got["file:c/o1"] == got["file:c/o2"] == 1  # the sum of both edges wins; the second follows in the next round
    assert got["file:d/p"] == got["file:d/q"] not in (0, 1) and got["file:a/z/r"] == 0
    assert len([f for f, c in got.items() if c == got["file:zz/alone"]]) == 1 and len(got) == len(members)


def test_calls_by_language(spark):
    files = {
        "p/a.py": "from q.b import far\nclass Base:\n    def go(self):\n        return self.help()\n    def help(self):\n        return 1\nclass Sub(Base):\n    def __init__(self):\n        self.x = 1\n    def run(self):\n        self.go()\n        far()\n        thing.rare()\n        near()\ndef make():\n    return Sub()\n",
        "p/c.py": "def near():\n    return 1\n",
        "q/b.py": "def far():\n    return 1\ndef rare():\n    return 2\n",
        "r/l.rs": "pub trait Shape {\n    fn area(&self) -> f64;\n}\npub struct Sq;\nimpl Shape for Sq {\n    fn area(&self) -> f64 {\n        self.side() * one()\n    }\n}\nimpl Sq {\n    fn side(&self) -> f64 { 2.0 }\n}\nfn one() -> f64 {\n    Sq::area(&Sq)\n}\n",
        "t/m.ts": "export class Box {\n  open(k: number): void {\n    this.shut();\n    helper(k);\n  }\n  shut() {\n    return 1;\n  }\n}\nfunction helper(k) {\n  return k;\n}\nclass Crate extends Box {\n}\n",
    }
    nodes, edges = extract.extract(spark.createDataFrame(list(files.items()), "path string, content string"))
    calls = {(r.src.split(":")[-1], r.dst.split(":")[-1], round(r.confidence, 2)) for r in edges.where("relation = 'calls'").collect()}
    assert calls == {
        ("Base.go", "Base.help", 0.9), ("Sub.run", "Base.go", 0.9), ("Sub.run", "far", 0.75), ("Sub.run", "rare", 0.3), ("Sub.run", "near", 0.7), ("make", "Sub.__init__", 0.8),
        ("Sq.area", "Sq.side", 0.9), ("Sq.area", "one", 0.9), ("one", "Sq.area", 0.95), ("Box.open", "Box.shut", 0.9), ("Box.open", "helper", 0.9),
    }
    other = {(r.src, r.dst, r.relation) for r in edges.where("relation <> 'calls'").collect()}
    assert ("class:r/l.rs:Sq", "trait:r/l.rs:Shape", "inherits") in other and ("method:r/l.rs:Shape.area", "method:r/l.rs:Sq.area", "overrides") in other
    assert ("class:t/m.ts:Crate", "class:t/m.ts:Box", "inherits") in other and ("method:r/l.rs:Sq.side", "class:r/l.rs:Sq", "defined_in") in other


def test_targets_are_never_cut(spark):
    rows = [("t", 0, "implements", "target", 1.0, 500, 0)] + [(f"c{i:03d}", 1, "calls", "caller", 0.9, 1, i + 1) for i in range(400)]
    found = spark.createDataFrame(rows, "id string, hop int, relation string, category string, score double, tokens int, ord long")
    states = {r.id: r.state for r in context.fit_budget(found, 100).collect()}
    assert states["t"] == "included" and len(states) == 401 and set(states.values()) == {"included", "dropped"}
    states = {r.id: r.state for r in context.fit_budget(found, 650).collect()}
    assert sum(v == "included" for v in states.values()) == 151


def test_features_get_free_ids(spark):
    g = graph(spark, ["feat-log-in", "task-log-in-a"], [])
    made = mutate.add_feature(mutate.add_feature(g, "Log in", [{"title": "A"}, {"title": "B", "deps": ["A", "C"]}]), "Log in", [{"title": "A"}])
    assert ids(made.nodes) == {"feat-log-in", "feat-log-in-2", "feat-log-in-3", "task-log-in-a", "task-log-in-a-2", "task-log-in-a-3", "task-log-in-b"}
    assert {tuple(r) for r in made.edges.select("src", "dst", "relation").collect()} == {
        ("task-log-in-a-2", "feat-log-in-2", "implements"), ("task-log-in-b", "feat-log-in-2", "implements"), ("task-log-in-b", "task-log-in-a-2", "depends_on"), ("task-log-in-a-3", "feat-log-in-3", "implements"),
    }


def test_pairs_in_blocks(spark):
    rows = [(k, f"m{i}") for k, n in (("a", 23), ("b", 1), ("c", 5)) for i in range(n)]
    one, two = spark.createDataFrame(rows, "k string, a string"), spark.createDataFrame(rows, "k string, b string")
    got = {tuple(r) for r in projection.in_blocks(one, two, "k", "a", "b", block=4).select("k", "a", "b").collect()}
    assert got == {(k, x, y) for k, x in rows for j, y in rows if j == k and x < y}


def test_layers_convert_there_and_back(spark):
    nodes = spark.createDataFrame([("f:a", "a", "Function", "x.rs", "pub", ["inline"], True, 7), ("c:b", "b", "Class", "x.rs", None, [], False, 0)], "id string, name string, kind string, file_path string, visibility string, decorators array<string>, is_test boolean, line_count long")
    edges = spark.createDataFrame([("f:a", "c:b", "calls", 0.5, 0.9, 3, True), ("f:a", "c:b", "depends_on", 0.5, 0.9, 1, False)], "src string, dst string, relation string, weight double, confidence double, call_count int, in_error_path boolean")
    g = setops.code_to_graph(nodes, edges)
    a = g.nodes.where("id = 'f:a'").first()
    assert (a.status, a.node_type, a.node_kind, a.is_public, a.metadata) == ("done", "code", "Function", True, {"is_test": "true", "line_count": "7", "decorators": '["inline"]'})
    assert [r.metadata for r in g.edges.where("relation = 'calls'").collect()] == ['{"source":"extract","call_count":3,"in_error_path":true}']
    back, kept = setops.graph_to_code(g)
    assert {(r.id, r.kind, r.is_test) for r in back.collect()} == {("f:a", "Function", True), ("c:b", "Class", False)} and [r.relation for r in kept.collect()] == ["calls"]


def test_co_citation_of_hubs_equals_that_of_pairs(spark):
    import random

    rng = random.Random(3)
    rows = list({(f"c{rng.randrange(9)}", f"f{rng.randrange(30)}é") for _ in range(200)})
    edges = spark.createDataFrame([(a, b, "imports", rng.uniform(0.6, 0.89)) for a, b in rows], "src string, dst string, relation string, confidence double")
    one = {(r.a, r.b): (r.citers, round(r.weight, 9)) for r in projection.co_citation(edges, hub=10**9).collect()}
    assert one == {(r.a, r.b): (r.citers, round(r.weight, 9)) for r in projection.co_citation(edges, hub=12).collect()} != {}
    cited = edges.selectExpr("src AS citer", "dst AS to", "confidence AS c")
    whole, parts = (projection.pairs_of_hubs(cited, *most).groupBy("a", "b").agg(F.sum("n").alias("n"), F.round(F.sum("trust"), 9).alias("t")) for most in ((100, 100), (4, 2)))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in parts.collect()} and whole.where("a >= b").isEmpty()
