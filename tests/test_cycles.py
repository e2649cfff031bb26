"""Strongly connected components and back edges against a plain computation."""

from __future__ import annotations

import random

import pytest

from graphloom.graph import Graph
from graphloom.operators import integrity


def _components(edges):
    to = {}
    for a, b in edges:
        to.setdefault(a, set()).add(b)

    def met(a):
        seen, todo = set(), [a]
        while todo:
            for b in to.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    reach = {a: met(a) for a in {x for e in edges for x in e}}
    return {(min(b for b in reach[a] if a in reach[b]), a) for a in reach if any(b != a and a in reach[b] for b in reach[a])}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_of_random_edges(spark, seed):
    rng = random.Random(seed)
    edges = {(f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(70)}
    edges |= {(b, a) for a, b in list(edges)[:12]} | {(f"c{k}", f"c{k + 1}") for k in range(9)} | {(f"c{k + 1}", f"c{k}") for k in (0, 1, 2, 5, 6)} | {("r1", "r2"), ("r2", "r3"), ("r3", "r1"), ("r3", "c0")}
    e = spark.createDataFrame([(a, b, "depends_on", k) for k, (a, b) in enumerate(sorted(edges))], "src string, dst string, relation string, ord long")
    n = spark.createDataFrame([("n00",)], "id string")
    got = {(r.component, r.id) for r in integrity.cycles(Graph(n, e)).collect()}
    assert got == _components(edges)


def test_back_edges_of_ways_there_and_back_take_few_jobs(spark):
    # 40 nodes in a row, each leading to the next and back: joined by doubling, not walked colour by colour
    ways = [(f"a{k:02d}", f"a{k + 1:02d}") for k in range(40)]
    e = spark.createDataFrame([(a, b, "depends_on", k) for k, (a, b) in enumerate(ways + [(b, a) for a, b in ways])], "src string, dst string, relation string, ord long")
    rounds, whole = [], integrity.cut
    integrity.cut = lambda df, name="step": (rounds.append(name), whole(df, name))[1]
    try:
        got = integrity.cycles(Graph(spark.createDataFrame([("a00",)], "id string"), e)).collect()
    finally:
        integrity.cut = whole
    assert {(r.component, r.id) for r in got} == {("a00", f"a{k:02d}") for k in range(41)} and len(rounds) < 40
    back = integrity.back_edges(Graph(spark.createDataFrame([("a00",)], "id string"), e)).collect()
    assert {(r.src, r.dst) for r in back} == {(b, a) for a, b in ways}
