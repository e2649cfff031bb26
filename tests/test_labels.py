"""The text join against a nested loop, and label contexts of a small component."""

from __future__ import annotations

import random

from graphloom.graph import Graph
from graphloom.operators import components, setops


def test_mentioned(spark):
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("abA.é🙂") for _ in range(n))
    texts = [(k, word(rng.randint(0, 60))) for k in range(60)] + [(60, None), (61, ""), (61, "ab.a ab.a"), (None, "ab.ab")]
    names = [word(rng.randint(1, 7)) for _ in range(50)] + ["", "a", "ab.a", "ab.a"]
    got = setops.mentioned(spark.createDataFrame(texts, "key long, text string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    assert sorted(map(repr, {tuple(r) for r in got})) == sorted(map(repr, {(k, n) for k, t in texts for n in names if n and n in (t or "")})) and len(got) == len({tuple(r) for r in got})


def test_tasks_link_to_files_once(spark):
    nodes = spark.createDataFrame([("t1", "fix main.rs", None, 0), ("t2", "x", "see src/io/main.rs and it.py", 1)], "id string, title string, description string, ord long")
    edges = spark.createDataFrame([("t1", "code_src_main.rs", "relates_to")], "src string, dst string, relation string")
    files = spark.createDataFrame([("src/main.rs",), ("src/io/main.rs",), ("a/it.py",), ("it.pyx",)], "file_path string")
    got = {tuple(r) for r in setops.link_tasks_to_code(Graph(nodes, edges), files).collect()}
    assert got == {(t, d, "relates_to") for t, d in (("t1", "code_src_io_main.rs"), ("t2", "code_src_main.rs"), ("t2", "code_src_io_main.rs"), ("t2", "code_a_it.py"))}


def test_label_contexts(spark):
    doc = "First words. " + "more text " * 30
    nodes = [("file:a.py", "a.py", "file", "File", "a.py", None, doc), ("file:b.py", "b.py", "file", None, None, None, "  "), ("f1", "one", "function", "Function", "a.py", "def one()", None), ("f2", "two", "function", None, "b.py", None, None)]
    nodes += [("C", "C", "class", "Struct", "a.py", None, None), ("C2", "C", "class", "Impl", "a.py", None, None), ("odd", "odd", "thing", "Thing", None, "odd!", None), ("none", "none", "thing", "Thing", None, None, None)]
    g = Graph(
        spark.createDataFrame([(*n, k) for k, n in enumerate(nodes)], "id string, title string, node_type string, node_kind string, file_path string, signature string, doc_comment string, ord long"),
        spark.createDataFrame([("f1", "file:a.py", "defined_in", 5), ("C", "file:a.py", "defined_in", 4), ("file:b.py", "f2", "contains", 3)], "src string, dst string, relation string, ord long"),
    )
    made = [("infer:component:1", "One", 0), ("infer:component:2", "Two", 1)]
    holds = [("infer:component:1", x, "contains", k) for k, x in enumerate(["file:b.py", "file:a.py", "C2", "odd", "none", "gone"])] + [("infer:component:2", "infer:component:1", "contains", 9)]
    inferred = Graph(spark.createDataFrame(made, "id string, title string, ord long"), spark.createDataFrame(holds, "src string, dst string, relation string, ord long"))
    one, two = sorted(components.label_contexts(g, inferred).collect(), key=lambda r: r.id)
    brief = "a.py: " + doc[:201].rsplit(" ", 1)[0].rstrip() + "…"
    assert tuple(one)[1:] == ("One", 3, 1, ["a.py", "a.py", "b.py"], ["C"], ["def one()", "odd!", "two"], [brief], [])
    assert tuple(two)[1:] == ("Two", 0, 0, [], [], [], [], ["One"])
    assert components.label_contexts(g, inferred, functions=1).where("title = 'One'").first().functions == ["two"]
