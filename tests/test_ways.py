"""Numbers of ways, dependents, back edges and places in a hierarchy against brute force on small random graphs."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from graphloom.graph import Graph
from graphloom.operators import advise, community, components, integrity, traverse


def graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, k) for k, i in enumerate(nodes)], "id string, ord long")
    return Graph(n, spark.createDataFrame([(s, d, "depends_on", k) for k, (s, d) in enumerate(edges)], "src string, dst string, relation string, ord long"))


def upstream(edges, node):
    seen, more = {node}, {node}
    while more:
        more = {s for s, d in edges if d in seen} - seen
        seen |= more
    return seen


def ways(edges, node):
    """Ways from each id to node; None where some are endless."""
    into = [(s, d) for s, d in edges if s != node]
    ids = upstream(into, node)

    def count(i, path):
        if i == node:
            return 1
        if i in path:
            return None
        found = [count(d, path | {i}) for s, d in into if s == i and d in ids]
        return None if None in found else sum(found)

    return {i: count(i, frozenset()) for i in ids}


@pytest.mark.parametrize("seed", range(2))
def test_path_counts_and_dependents(spark, seed):
    rng = random.Random(seed)
    ids = "abcdefghijkl"
    edges = [(rng.choice(ids), rng.choice(ids)) for _ in range(18)] + [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("d", "c"), ("e", "d")]
    if not seed:
        edges = [(s, d) for s, d in edges if s > d]
    g = graph(spark, ids[:-1], edges)  # l is no node
    got = {r.id: None if r.times is None else int(r.times) for r in traverse.path_counts(g, "a").collect()}
    assert got == ways(edges, "a") and (seed or got["e"] >= 3)
    there = [(s, d) for s, d in edges if s != "l"]
    walked = upstream(there, "a")
    assert {r.id: r.times for r in traverse.dependents(g, "a").collect()} == Counter(s for s, d in there if d in walked)


def test_without_back_edges_there_are_no_cycles(spark):
    rng = random.Random(3)
    ids = [f"n{k:02}" for k in range(25)]
    edges = sorted({(rng.choice(ids), rng.choice(ids)) for _ in range(60)} | {("n01", "n01")})
    back = {(r.src, r.dst) for r in integrity.back_edges(graph(spark, ids, edges)).collect()}
    assert ("n01", "n01") in back and all(s in reach(edges, d) for s, d in back)
    left = [e for e in edges if e not in back]
    assert not any(i in reach(left, i) for i in ids)
    assert integrity.back_edges(graph(spark, ids, left)).count() == 0


def reach(edges, node):
    seen, more = set(), {d for s, d in edges if s == node}
    while more:
        seen |= more
        more = {d for s, d in edges if s in seen} - seen
    return seen


def test_hierarchy(spark):
    rng = random.Random(4)
    ids = [f"c{k:02}" for k in range(40)]
    contains = [(ids[k - 1], ids[k], rng.randrange(9)) for k in range(1, 9)]  # depth 9
    contains += [(ids[rng.randrange(k)], ids[k], rng.randrange(9)) for k in range(10, 40)] + [("c00", "c20", 99), ("r1", "r2", 0), ("r2", "r1", 0), ("r1", "r3", 0), ("s", "s", 1)]
    first = {}
    for p, c, o in contains:
        if p != c:
            first[c] = min(first.get(c, (o, p)), (o, p))
    kids = {}
    for c, (o, p) in first.items():
        kids.setdefault(p, []).append((o, c))
    want = {}

    def walk(i, path):
        below = sorted(kids.get(i, []))
        want[i] = (path, path.count(".") + 1, len(below), sum(1 + walk(c, f"{path}.{k}") for k, (_, c) in enumerate(below)))
        return want[i][3]

    for k, root in enumerate(sorted({p for p, _, _ in contains} - first.keys())):
        walk(root, str(k))
    got = components.hierarchy(spark.createDataFrame(contains, "parent string, child string, ord long").repartition(3)).collect()
    assert {r.id: (r.path, r.depth, r.children, r.descendants) for r in got} == want and max(r.depth for r in got) >= 9


def test_advice_of_a_network_too_large_to_cluster(spark, monkeypatch):
    n = [(f"file:d{k}/f{k}", "file", f"d{k}/f{k}", "todo", f"f{k}", k) for k in range(5)]
    g = Graph(spark.createDataFrame(n, "id string, node_type string, file_path string, status string, title string, ord long"), spark.createDataFrame([(n[a][0], n[b][0], "calls", 1.0, a * 9 + b) for a in range(5) for b in range(5) if a < b], "src string, dst string, relation string, weight double, ord long"))
    monkeypatch.setattr(community, "MOST_EDGES", 3)
    assert [r.what.split(":")[0] for r in advise.module_suggestions(g).collect()] == ["not looked at"]
    assert {r.settled for r in community.label_propagation(spark.createDataFrame([("a", "b", 1.0)], "a string, b string, weight double"), 3).collect()} == {False}
