"""Levels against a recursion, and closures against sets, on random graphs."""

from __future__ import annotations

import random

import pytest

from graphloom.operators import schedule, traverse


def brute(nodes, edges):
    out = {n: {d for s, d in edges if s == n} for n in nodes}
    level = {}
    for _ in range(len(nodes) + 1):
        for n in nodes:
            if n not in level and all(d in level for d in out[n]):
                level[n] = 1 + max((level[d] for d in out[n]), default=-1)
    return {n: level.get(n) for n in nodes}


@pytest.mark.parametrize("seed", range(4))
def test_levels(spark, seed):
    rng = random.Random(seed)
    nodes = [f"n{k:03}" for k in range(60)]
    edges = [(nodes[k], nodes[k - 1]) for k in range(1, 25)]  # one long way
    edges += [(nodes[rng.randrange(25, 60)], nodes[rng.randrange(0, 60)]) for _ in range((20, 40, 70, 30)[seed])]
    edges = [(s, d) for s, d in edges if s > d or rng.random() < 0.1] + [("n030", "gone")] * (seed % 2) + [("n031", "n031")] * (seed > 1) + [("alien", "n001")]
    got = {r.id: r.level for r in schedule.levels(spark.createDataFrame([(n,) for n in nodes + nodes[:3]], "id string"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    assert got == brute(nodes, edges)


def test_levels_of_ways_circles_and_nothing(spark):
    say = lambda nodes, edges: {r.id: r.level for r in schedule.levels(spark.createDataFrame([(n,) for n in nodes], "id string"), spark.createDataFrame(edges, "src string, dst string")).collect()}
    way = [f"w{k:02}" for k in range(40)]
    assert say(way, list(zip(way[1:], way))) == {w: k for k, w in enumerate(way)}
    assert say("abcde", [("a", "b"), ("b", "a"), ("c", "a"), ("d", "e")]) == {"a": None, "b": None, "c": None, "d": 1, "e": 0}
    assert say("a", []) == {"a": 0} and say([], []) == {}


def test_closure(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(40), rng.randrange(40)) for _ in range(45)]
    want, more = {"0", "3"}, True
    while more:
        more = {str(b) for a, b in edges if str(a) in want} - want
        want |= more
    got = traverse.closure(spark.createDataFrame([(str(a), str(b)) for a, b in edges], "at string, to string"), spark.createDataFrame([("0",), ("3",)], "id string"))
    assert sorted(r.id for r in got.collect()) == sorted(want)
