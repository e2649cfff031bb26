"""Community detection on a weighted directed network by the two-level map equation.

The file network of a repository is small; the optimiser takes at most MOST_EDGES edges to the driver, checked first. communities()
gives larger ones to map_equation, which optimises the same code with the links on the executors. Label propagation, another method
with other results, runs distributed for networks of any size.
"""

from __future__ import annotations

import math
import random
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import cut

MOST_EDGES = 200_000


def flows(n: int, links: list[tuple[int, int, float]], tau: float, rounds: int = 200) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Visit rates of a random walk with teleportation, and the flow along each link."""
    out = [0.0] * n
    for a, _, w in links:
        out[a] += w
    p = [1.0 / n] * n
    for _ in range(rounds):
        lost = sum(p[i] for i in range(n) if out[i] == 0)
        q = [(tau + (1 - tau) * lost) / n] * n
        for a, b, w in links:
            q[b] += (1 - tau) * p[a] * w / out[a]
        if max(abs(x - y) for x, y in zip(p, q)) < 1e-12:
            break
        p = q
    return p, [(a, b, (1 - tau) * p[a] * w / out[a]) for a, b, w in links]


def _h(x: float) -> float:
    return x * math.log2(x) if x > 0 else 0.0


def codelength(p: list[float], flow: list[tuple[int, int, float]], module: list[int]) -> float:
    """Bits per step of the two-level description."""
    leave: dict[int, float] = {}
    inside: dict[int, float] = {}
    for i, x in enumerate(p):
        inside[module[i]] = inside.get(module[i], 0.0) + x
        leave.setdefault(module[i], 0.0)
    for a, b, f in flow:
        if module[a] != module[b]:
            leave[module[a]] += f
    return _h(sum(leave.values())) - 2 * sum(map(_h, leave.values())) - sum(map(_h, p)) + sum(_h(inside[m] + leave[m]) for m in inside)


class _Level:
    """Nodes with visit rates and flows between them, and a partition whose codelength moves change by their own terms only."""

    def __init__(self, rate: list[float], near: list[dict[int, list[float]]], module: list[int]):
        self.rate, self.near, self.module = rate, near, module  # near[i][j]: flow to j, flow from j
        self.out = [sum(f for f, _ in x.values()) for x in near]
        self.inside, self.leave = defaultdict(float), defaultdict(float)
        for i, m in enumerate(module):
            self.inside[m] += rate[i]
            self.leave[m] += sum(f for j, (f, _) in near[i].items() if module[j] != m)
        self.total = sum(self.leave.values())

    def move(self, i: int) -> float:
        """Moves i to the neighbouring module that shortens the code most; the bits that it saves."""
        a, rate = self.module[i], self.rate[i]
        to, back = defaultdict(float), defaultdict(float)
        for j, (f, g) in self.near[i].items():
            to[self.module[j]] += f
            back[self.module[j]] += g
        left = self.leave[a] - (self.out[i] - to[a]) + back[a]
        best, saved = a, 1e-10
        for b in sorted(to):
            if b == a:
                continue
            joined = self.leave[b] + (self.out[i] - to[b]) - back[b]
            total = self.total - self.leave[a] - self.leave[b] + left + joined
            before = _h(self.total) - 2 * (_h(self.leave[a]) + _h(self.leave[b])) + _h(self.inside[a] + self.leave[a]) + _h(self.inside[b] + self.leave[b])
            after = _h(total) - 2 * (_h(left) + _h(joined)) + _h(self.inside[a] - rate + left) + _h(self.inside[b] + rate + joined)
            if before - after > saved:
                best, saved, chosen = b, before - after, (joined, total)
        if best == a:
            return 0.0
        self.leave[a], (self.leave[best], self.total) = left, chosen
        self.inside[a] -= rate
        self.inside[best] += rate
        self.module[i] = best
        return saved


def _settle(level: _Level, rng: random.Random) -> bool:
    """Moves single nodes until none saves anything; whether any moved."""
    order, moved = list(range(len(level.rate))), False
    while True:
        rng.shuffle(order)
        if not sum(level.move(i) > 0 for i in order):
            return moved
        moved = True


def _folded(level: _Level) -> tuple[_Level, list[int]]:
    """The modules of a level as the nodes of the next one, each in a module of its own, and the node that each is in."""
    names = {m: k for k, m in enumerate(dict.fromkeys(level.module))}
    place = [names[m] for m in level.module]
    rate, near = [0.0] * len(names), [defaultdict(lambda: [0.0, 0.0]) for _ in names]
    for i, k in enumerate(place):
        rate[k] += level.rate[i]
        for j, (f, g) in level.near[i].items():
            if place[j] != k:
                near[k][place[j]][0] += f
                near[k][place[j]][1] += g
    return _Level(rate, near, list(range(len(names)))), place


def optimise(n: int, links: list[tuple[int, int, float]], tau: float = 0.05, trials: int = 10, seed: int = 42) -> tuple[list[int], float]:
    """(module of each node, codelength): moves of single nodes, then of whole modules, in turn, the best of several orders.

    A move costs what its own edges cost; the whole code is worked out once a trial.
    """
    if n == 0:
        return [], 0.0
    p, flow = flows(n, links, tau)
    best: tuple[float, list[int]] = (codelength(p, flow, [0] * n), [0] * n)
    near: list[dict[int, list[float]]] = [defaultdict(lambda: [0.0, 0.0]) for _ in range(n)]
    for a, b, f in flow:
        if a != b:
            near[a][b][0] += f
            near[b][a][1] += f
    for trial in range(trials):
        rng = random.Random(seed + trial)
        module = list(range(n))
        for _ in range(50):
            level = _Level(p, near, module)
            moved = _settle(level, rng)
            top, at = _folded(level)  # at: the node of the top level that each node is in
            while _settle(top, rng):  # whole modules, then modules of modules
                moved = True
                top, place = _folded(top)
                at = [place[k] for k in at]
            module = at
            if not moved:
                break
        now = codelength(p, flow, module)
        if now < best[0] - 1e-10:
            best = (now, module)
    names = {m: k for k, m in enumerate(dict.fromkeys(best[1]))}
    return [names[m] for m in best[1]], best[0]


def bounded_network(network: DataFrame) -> tuple[list[str], list[tuple[int, int, float]]]:
    """Names and links of network(a, b, weight), of MOST_EDGES edges at most; more is an error, not another method."""
    network = cut(network.select("a", "b", "weight"), "network")
    if network.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges: use label_propagation, or a smaller network")
    rows = sorted(tuple(r) for r in network.collect())  # at most MOST_EDGES
    names = sorted({x for a, b, _ in rows for x in (a, b)})
    place = {x: i for i, x in enumerate(names)}
    return names, [(place[a], place[b], w) for a, b, w in rows]


def communities(network: DataFrame, tau: float = 0.05, trials: int = 10, seed: int = 42) -> DataFrame:
    """(file, community) of network(a, b, weight); beyond MOST_EDGES edges by rounds on the executors, in one trial."""
    from graphloom.operators.map_equation import communities_at_size

    network = cut(network.select("a", "b", "weight"), "network")
    if network.limit(MOST_EDGES + 1).count() > MOST_EDGES:
        return communities_at_size(network, tau, seed, MOST_EDGES)
    names, links = bounded_network(network)
    module, _ = optimise(len(names), links, tau, trials, seed)
    return network.sparkSession.createDataFrame(list(zip(names, module)), "file string, community int")


def split_large(members: list[list[int]], links: list[tuple[int, int, float]], most: int, tau: float, trials: int = 10, seed: int = 42, depth: int = 3) -> list[list[int]]:
    """Communities of more than `most` members clustered again by their own links, with half as much again of teleportation
    (0.15 at most); those that stay whole stay, and parts that are still too large are split up to `depth` times."""
    if not depth:
        return members
    out, again, tau_ = [], False, min(0.15, tau * 1.5)
    for group in members:
        parts = [group]
        if len(group) > most:
            place = {x: i for i, x in enumerate(group)}
            own = [(place[a], place[b], w) for a, b, w in links if a in place and b in place]
            module, _ = optimise(len(group), own, tau_, trials, seed)
            if max(module) > 0:
                parts = [[x for x, m in zip(group, module) if m == k] for k in range(max(module) + 1)]
                again = True
        out += parts
    return split_large(out, links, most, tau, trials, seed, depth - 1) if again else out


def label_propagation(network: DataFrame, rounds: int = 20) -> DataFrame:
    """(file, community, settled): every node takes the heaviest label around it, ties to the smallest, for a number of rounds.

    Labels of some networks swing for ever; settled tells whether a file's label stayed in the last round.
    """
    both = network.select("a", "b", "weight").unionByName(network.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    both = cut(both.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "links")
    label = both.select(F.col("a").alias("file")).distinct().select("file", F.col("file").alias("label"), F.lit(True).alias("settled"))
    for _ in range(rounds):
        votes = both.join(label.select(F.col("file").alias("b"), "label"), "b").groupBy("a", "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy(F.col("a").alias("file")).agg(F.min(F.struct((-F.col("w")).alias("w"), "label")).alias("x"))
        label = cut(best.join(label.select("file", F.col("label").alias("old")), "file").select("file", F.col("x.label").alias("label"), (F.col("x.label") == F.col("old")).alias("settled")), "labels")
        if label.where("not settled").isEmpty():
            break
    return label.select("file", F.pmod(F.xxhash64("label"), F.lit(2**31 - 1)).cast("int").alias("community"), "settled")


def auto_config(n_files: int, mean_degree: float) -> dict:
    """Smallest community by size of the network, teleportation by its density: a walker in a sparse network stays longer."""
    smallest = 2 if n_files < 50 else 3 if n_files < 500 else 5 if n_files < 2000 else 8
    return {
        "min_size": smallest, "hierarchical": n_files >= 50, "max_size": most_members(n_files),
        "tau": 0.01 if mean_degree < 3 else 0.05 if mean_degree <= 20 else 0.10,
    }


def most_members(n: int) -> int:
    """Files that a community has at most before it is split."""
    return min(60, max(15, math.ceil(math.log(max(n, 1)) * 6)))


def name_communities(members: DataFrame) -> DataFrame:
    """(community, name): the deepest directory that all files share, else the most frequent one; equal names get a suffix."""
    from pyspark.sql import Window

    from graphloom.functions.text import parent_dir

    dirs = members.select("community", parent_dir(F.col("file")).alias("dir"))
    counts = dirs.groupBy("community", "dir").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("community").agg(F.min(F.struct((-F.col("n")).alias("n"), "dir")).alias("x"), F.min("dir").alias("lo"), F.max("dir").alias("hi"))
    shared = F.array_join(F.transform(F.filter(F.arrays_zip(F.split("lo", "/").alias("a"), F.split("hi", "/").alias("b")), lambda x: x["a"] == x["b"]), lambda x: x["a"]), "/")
    named = best.select("community", F.when(shared != "", shared).otherwise(F.col("x.dir")).alias("name"))
    twice = F.count(F.lit(1)).over(Window.partitionBy("name")) > 1
    return named.select("community", F.when(twice, F.concat_ws("-", "name", F.col("community").cast("string"))).otherwise(F.col("name")).alias("name"))
