"""Incremental extraction and the store of facts against extraction of everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.operators import extract
from graphloom.sources.fact_store import FactStore

A = "from b import g, Base\n\nclass Own(Base):\n    def run(self):\n        return self.step()\n    def step(self):\n        return g()\n"
B = "class Base:\n    def run(self):\n        return 1\n\ndef g():\n    return h()\n\ndef h():\n    return 2\n"
RUST = "use crate::kinds::Kind;\n\nimpl Shape for Kind {\n    fn area(&self) -> i32 { side() }\n}\n\nfn side() -> i32 { 1 }\n"
KINDS = "pub struct Kind;\n\npub trait Shape { fn area(&self) -> i32; }\n"
TEST = "from a import Own\n\ndef test_run():\n    assert Own().run()\n"
OLD = {"src/a.py": A, "src/b.py": B, "src/area.rs": RUST, "src/kinds.rs": KINDS, "tests/test_a.py": TEST, "src/gone.py": "def lost():\n    return 1\n", "src/uses.py": "from gone import lost\n\ndef u():\n    return lost()\n"}


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "path string, content string").withColumn("content_hash", F.sha2("content", 256))


def rows(nodes, edges):
    n = {(r.id, r.title, r.node_type, r.file_path, r.start_line, r.end_line) for r in nodes.collect()}
    return n, sorted(tuple(r) for r in edges.select("src", "dst", "relation", F.round("confidence", 6).alias("confidence"), "call_count", "in_error_path").collect())


EDITS = {
    "callee": {"src/b.py": "# new\n" + B.replace("return 2", "return 3")},
    "impl and base go": {"src/area.rs": "fn side() -> i32 { 1 }\n", "src/a.py": A.replace("(Base)", "")},
    "all at once": {"src/a.py": A + "\ndef more():\n    return h()\n", "src/b.py": B + "\n# end\n", "src/gone.py": None, "src/area.rs": RUST + "// end\n", "src/new.py": "from b import h\n\ndef fresh():\n    return h()\n"},
}


def test_incremental_equals_full_extraction(spark):
    old = files(spark, OLD)
    before = [df.cache() for df in extract.extract(old)]
    for name, edit in EDITS.items():
        new = files(spark, {k: v for k, v in (OLD | edit).items() if v is not None})
        got = rows(*extract.extract_incremental(*before, old.select("path", "content_hash"), new))
        want = rows(*extract.extract(new))
        assert got == want, name
    assert any(r == ("func:src/b.py:g") or r[1] == "func:src/b.py:g" for r in want[1])


def test_store_parses_each_content_once(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/facts"
    facts = lambda df: sorted(map(repr, df.collect()))
    want = facts(extract.facts(files(spark, OLD)))
    store = FactStore(spark, root, "repo@1")
    assert facts(store.facts(files(spark, OLD))) == want and (store.parsed, store.reused) == (7, 0)
    again = FactStore(spark, root, "repo@1")
    assert facts(again.facts(files(spark, OLD))) == want and (again.parsed, again.reused) == (0, 7)
    moved = {("lib/" + k if k == "src/b.py" else k): v for k, v in OLD.items()} | {"src/copy.py": OLD["src/gone.py"], "src/empty.py": ""}
    assert facts(again.facts(files(spark, moved))) == facts(extract.facts(files(spark, moved))) and (again.parsed, again.reused) == (1, 8)
    other = FactStore(spark, root, "repo@2")
    other.facts(files(spark, OLD))
    assert (other.parsed, other.reused) == (7, 0)
    monkeypatch.setattr(extract, "PARSERS", extract.PARSERS + 1)  # other parsers find other things
    again.facts(files(spark, OLD))
    assert again.parsed == 7
    assert again.facts(files(spark, OLD).limit(0)).count() == 0


def test_texts_of_one_file_are_parsed_by_many_tasks(spark):
    one = files(spark, {f"src/f{k}.py": f"def f{k}():\n    return 1\n" for k in range(400)}).coalesce(1)
    found = extract.facts(one)
    assert found.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
    assert found.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 100 and found.count() == 400


def test_nodes_alone_are_those_of_an_extraction(spark, monkeypatch):
    want = rows(*extract.extract(files(spark, OLD)))[0]
    monkeypatch.setattr(extract, "call_edges", None)  # calls are not resolved for nodes
    nodes = extract.extract_nodes(files(spark, OLD))
    assert {(r.id, r.title, r.node_type, r.file_path, r.start_line, r.end_line) for r in nodes.collect()} == want


def test_a_prefix_of_the_store_is_written_by_several_tasks(spark, tmp_path, monkeypatch):
    from graphloom.sources import fact_store

    monkeypatch.setattr(fact_store, "WRITTEN", 2)
    texts = files(spark, {f"src/f{k}.py": f"def f{k}():\n    return 1\n" for k in range(200)})
    store = FactStore(spark, f"file://{tmp_path}/facts", digits=1)
    assert store.facts(texts).count() == 200 and FactStore(spark, f"file://{tmp_path}/facts", digits=1).facts(texts).count() == 200
    seen = []
    real = type(texts).repartition
    monkeypatch.setattr(type(texts), "repartition", lambda self, *a: seen.append(a) or real(self, *a))
    FactStore(spark, f"file://{tmp_path}/other", digits=1).facts(texts)
    assert sum(a[0] == "prefix" and len(a) == 2 for a in seen) == 2
