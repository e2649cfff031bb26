"""Best-first chains against a search with a heap, on random graphs."""

from __future__ import annotations

import heapq
import random

import pytest

from graphloom.graph import Graph
from graphloom.operators import analysis


def brute(nodes, edges, symptoms, depth, most):
    paths = dict(nodes)
    test = lambda i: "/tests/" in paths[i] or "/test_" in paths[i]
    found = []
    for symptom in symptoms:
        if symptom not in paths:
            continue
        for way in "fb":
            heap, visited = [(-1.0, 1, symptom, [symptom], [])], {symptom}
            while heap:
                heavy, _, at, chain, links = heapq.heappop(heap)
                for src, dst, relation, w in edges:
                    a, to = (src, dst) if way == "f" else (dst, src)
                    if a != at or relation not in analysis.LINKS[way] or to in visited or to not in paths or (way == "b" and test(to)):
                        continue
                    visited.add(to)
                    found.append((chain + [to], links + [analysis.LINKS[way][relation]], -heavy * w))
                    if len(chain) + 1 < depth:
                        heapq.heappush(heap, (heavy * w, len(chain) + 1, to, *found[-1][:2]))
    found.sort(key=lambda c: (len(c[0]), -sum(not test(i) for i in c[0])))
    ends = [c for c in found if not any(len(d[0]) > len(c[0]) and d[0][: len(c[0])] == c[0] for d in found)]
    return [(c[0][0], " > ".join(c[0]), " > ".join(c[1]), round(c[2], 6)) for c in ends[:most]]


def chains(spark, nodes, edges, symptoms, depth, most):
    n = spark.createDataFrame([(i, p, k) for k, (i, p) in enumerate(nodes)], "id string, file_path string, ord long")
    e = spark.createDataFrame([(*x, k) for k, x in enumerate(edges)], "src string, dst string, relation string, weight double, ord long")
    return [tuple(r)[:4] for r in sorted(analysis.causal_chains(Graph(n, e), symptoms, depth, most).collect(), key=lambda r: r.rank)]


def test_the_heaviest_way_is_not_the_heaviest_step(spark):
    nodes = [(i, "src/x.py") for i in "sabcd"]
    edges = [("s", "a", "calls", 0.1), ("s", "b", "calls", 0.9), ("b", "c", "calls", 0.9), ("c", "d", "calls", 0.9), ("a", "d", "calls", 0.9)]
    assert [c[1] for c in chains(spark, nodes, edges, ["s"], 4, 10)] == ["s > a", "s > b > c > d"]


@pytest.mark.parametrize("seed", range(3))
def test_chains_equal_a_search_with_a_heap(spark, seed):
    rng = random.Random(seed)
    nodes = [(f"n{k:02}", rng.choice(["src/a.py", "src/tests/t.py", "x/test_b.py", "src/b.py"])) for k in range(14)]
    ids = [i for i, _ in nodes] + ["ghost"]
    # weights that no two chains share, so that no order is left open
    edges = [(rng.choice(ids), rng.choice(ids), rng.choice(["calls", "imports", "overrides", "inherits", "tests_for", "uses"]), rng.uniform(0.05, 0.999)) for _ in range(70)]
    symptoms, depth = ["n03", "nowhere", "n07"], rng.choice([2, 3, 4, 6])
    want = brute(nodes, edges, symptoms, depth, 10_000)
    assert sorted(chains(spark, nodes, edges, symptoms, depth, 10_000)) == sorted(want)
    assert chains(spark, nodes, edges, symptoms, depth, 7) == want[:7]


def test_steps_that_no_chain_can_take_are_not_written(spark):
    from graphloom.lineage import paths_made

    nodes = [(i, "src/x.py") for i in "sabcd"] + [(f"far{k}", "src/y.py") for k in range(500)]
    edges = [("s", "a", "calls", 0.5), ("a", "b", "calls", 0.5), ("b", "c", "calls", 0.5), ("c", "d", "calls", 0.5)] + [(f"far{k}", f"far{k + 1}", "calls", 0.5) for k in range(499)]
    with paths_made() as made:
        assert [c[1] for c in chains(spark, nodes, edges, ["s"], 3, 10)] == ["s > a > b"]
    sizes = [spark.read.parquet(p).count() for p in made if not p.rpartition("/")[2].startswith("cut-")]
    assert sizes and max(sizes) < 20
