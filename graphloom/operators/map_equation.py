"""The two-level map equation on networks whose links do not fit the driver.

Links stay on the executors, packed by node; the driver and each task hold some numbers for each file (48 bytes), never a
number for each link. In a round every node looks for the module that shortens the code most, all by the same modules; a share
of them moves, what crosses the modules is summed anew, and a round that did not shorten the code is taken back and tried with a
smaller share. Modules are then folded to nodes, on the executors again as long as their links are many.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.lineage import cut

# Executors need no copy of this package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Entries (two for each link) of a packed part.
ENTRIES = 500_000
#: Part of the code that a round, or a turn of rounds, has to save for another one.
WORTH = 1e-5


def h(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0)), 0.0)


def numbered(files: DataFrame) -> tuple[DataFrame, int]:
    """(file, k) with k from 0 on in the order of files(file), and how many there are."""
    sorted_ = cut(files.select("file").distinct().orderBy("file").withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33)
    sizes = sorted(sorted_.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row for each part
    starts, n = [], 0
    for p, size in sizes:
        starts.append((p, n))
        n += size
    start = F.broadcast(files.sparkSession.createDataFrame(starts, "part long, start long"))
    return sorted_.withColumn("part", part).join(start, "part").select("file", (F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).cast("int").alias("k")), n


class Packed:
    """Links (i, j, w) of n nodes, packed by node: for each node and each other end what leads there and what comes from there."""

    def __init__(self, links: DataFrame, n: int, n_links: int):
        parts = max(8, -(-2 * n_links // ENTRIES))
        none = F.lit(0.0)
        both = links.select(F.col("i").alias("node"), F.col("j").alias("other"), F.col("w").alias("to"), none.alias("back"))
        both = both.unionByName(links.select(F.col("j").alias("node"), F.col("i").alias("other"), none.alias("to"), F.col("w").alias("back")))

        def pack(batches):
            held = [b for b in batches if b.num_rows]
            if held:
                t = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_arrays([pa.array([t[c].to_numpy().tobytes()], pa.binary()) for c in t.column_names], names=t.column_names)

        dealt = both.repartition(parts, "node").sortWithinPartitions("node", "other", "to", "back")
        self.rows, self.n = cut(dealt.mapInArrow(pack, "node binary, other binary, to binary, back binary"), "packed"), n

    def each(self, fn, *vectors) -> list[tuple[np.ndarray, ...]]:
        """fn(node, other, to, back, *vectors) of every part: arrays whose sizes go with the nodes, not with the links."""
        sent = self.rows.sparkSession.sparkContext.broadcast(vectors)

        def run(batches):
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns)):
                    found = fn(*(np.frombuffer(x, t) for x, t in zip(row, (np.int32, np.int32, float, float))), *sent.value)
                    yield pa.RecordBatch.from_arrays([pa.array([row[0][:4]], pa.binary())] + [pa.array([x.astype(float).tobytes()], pa.binary()) for x in found] + [pa.array([b""], pa.binary())] * (3 - len(found)), names=["first", "x", "y", "z"])

        found = self.rows.mapInArrow(run, "first binary, x binary, y binary, z binary").collect()
        sent.unpersist()
        return [tuple(np.frombuffer(x) for x in r[1:]) for r in sorted(tuple(bytes(x) for x in r) for r in found)]

    def summed(self, fn, *vectors) -> np.ndarray:
        """The sums by number of what fn returns as (numbers, values)."""
        out = np.zeros(self.n)
        for at, x, _ in self.each(fn, *vectors):
            out += np.bincount(at.astype(np.int64), x, self.n)
        return out


def _by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, place = np.unique(keys, return_inverse=True)
    return names, np.bincount(place, values, len(names))


def _outgoing(node, other, to, back):
    return _by(node, to)


def _incoming(node, other, to, back, share):
    return _by(node, back * share[other])


def _crossing(node, other, to, back, share, module):
    ends = module[node]
    return _by(ends, np.where(ends != module[other], to * share[node], 0.0))


def _leaving(node, other, to, back, share):
    return _by(node, np.where(node != other, to * share[node], 0.0))


def _moves(node, other, to, back, share, module, rate, out, inside, leave):
    """(node, module, bits saved) of the nodes of a part that another module would shorten the code of."""

    def bits(x):
        return np.where(x > 0, x * np.log2(np.where(x > 0, x, 1.0)), 0.0)

    total, real = leave.sum(), node != other
    node, other = node[real], other[real]
    to, back = to[real] * share[node], back[real] * share[other]
    if not len(node):
        return (np.zeros(0),) * 3
    key = node.astype(np.int64) << 32 | module[other]
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
    to, back = np.add.reduceat(to[order], start), np.add.reduceat(back[order], start)
    i, b = (key[order][start] >> 32), key[order][start] & 0xFFFFFFFF
    a = module[i]
    # what goes between a node and the rest of its own module
    own = np.flatnonzero(a == b)
    names, place = np.unique(i, return_inverse=True)
    to_a, back_a = np.zeros(len(names)), np.zeros(len(names))
    to_a[place[own]], back_a[place[own]] = to[own], back[own]
    left = np.maximum(0, leave[a] - (out[i] - to_a[place]) + back_a[place])
    joined = np.maximum(0, leave[b] + (out[i] - to) - back)
    after = bits(np.maximum(0, total - leave[a] - leave[b] + left + joined)) - 2 * (bits(left) + bits(joined)) + bits(np.maximum(0, inside[a] - rate[i]) + left) + bits(inside[b] + rate[i] + joined)
    saved = bits(total) - 2 * (bits(leave[a]) + bits(leave[b])) + bits(inside[a] + leave[a]) + bits(inside[b] + leave[b]) - after
    saved[own] = 0
    best = np.lexsort((b, -saved, place))  # of equal ones the smallest module
    best = best[np.concatenate(([True], np.diff(place[best]) != 0))]
    best = best[saved[best] > 1e-10]
    return i[best], b[best], saved[best]


def visit_rates(links: Packed, tau: float, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Visit rates of a random walk with teleportation, and the share of its rate that each unit of a node's links carries."""
    n, out = links.n, links.summed(_outgoing)
    per = np.divide(1 - tau, out, out=np.zeros(n), where=out > 0)
    p = np.full(n, 1.0 / n)
    for _ in range(rounds):
        q = (tau + (1 - tau) * p[out == 0].sum()) / n + links.summed(_incoming, per * p)
        if np.abs(q - p).max() < 1e-12:
            break
        p = q
    return p, per * p


def code(rate: np.ndarray, module: np.ndarray, leave: np.ndarray, term: float) -> float:
    """Bits per step; term: the sum of h over the visit rates of the files."""
    inside = np.bincount(module, rate, len(leave))
    return float(h(leave.sum()) - 2 * h(leave).sum() - term + h(inside + leave).sum())


def settle(links: Packed, share: np.ndarray, rate: np.ndarray, module: np.ndarray, term: float, seed: int, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Modules after rounds of moves of single nodes, and the bits of the code; no round makes it longer."""
    n, rng, part = links.n, np.random.default_rng(seed), 0.5
    out = links.summed(_leaving, share)
    leave = links.summed(_crossing, share, module)
    now = code(rate, module, leave, term)
    found = None
    for _ in range(rounds):
        if found is None:
            inside = np.bincount(module, rate, n)
            found = [np.concatenate(x) for x in zip(*links.each(_moves, share, module, rate, out, inside, leave))]
        node, to = found[0].astype(np.int64), found[1].astype(np.int64)
        if not len(node):
            break
        moving = rng.random(len(node)) < part
        if not moving.any():
            moving[np.argmax(found[2])] = True
        tried = module.copy()
        tried[node[moving]] = to[moving]
        crossing = links.summed(_crossing, share, tried)
        bits = code(rate, tried, crossing, term)
        if bits < now - 1e-12:
            small = now - bits < WORTH * now
            module, leave, now, found, part = tried, crossing, bits, None, min(0.5, part * 1.5)
            if small:
                break
        elif moving.sum() == 1:  # the best move alone does not help
            break
        else:
            part /= 4
            if part * len(node) < 1:
                part = 0.0  # the best one alone
    return module, now


def folded(links: Packed, share: np.ndarray, place: np.ndarray) -> DataFrame:
    """(i, j, w): the flow between modules, summed on the executors."""
    sent = links.rows.sparkSession.sparkContext.broadcast((share, place))

    def run(batches):
        share_, place_ = sent.value
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                node, other, to, _ = (np.frombuffer(x, t) for x, t in zip(row, (np.int32, np.int32, float, float)))
                i, j, w = place_[node].astype(np.int64), place_[other].astype(np.int64), to * share_[node]
                real = (i != j) & (w > 0)
                key, w = _by(i[real] << 32 | j[real], w[real])
                yield pa.RecordBatch.from_arrays([pa.array((key >> 32).astype(np.int32)), pa.array((key & 0xFFFFFFFF).astype(np.int32)), pa.array(w)], names=["i", "j", "w"])

    return cut(links.rows.mapInArrow(run, "i int, j int, w double").groupBy("i", "j").agg(F.sum("w").alias("w")), "folded")


def _names(module: np.ndarray) -> tuple[np.ndarray, int]:
    """Modules numbered in the order in which nodes name them."""
    _, first, place = np.unique(module, return_index=True, return_inverse=True)
    rank = np.empty(len(first), np.int64)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[place].astype(np.int32), len(first)


def _upper(links: Packed, share: np.ndarray, rate: np.ndarray, module: np.ndarray, term: float, seed: int, most: int) -> np.ndarray:
    """Modules after whole modules have moved, and modules of modules: on the driver once their links are `most` at most."""
    from graphloom.operators import community

    place, k = _names(module)
    if k < 2:
        return place
    flow = folded(links, share, place)
    n_links, inside = flow.count(), np.bincount(place, rate, k)
    if n_links <= most:
        import random
        from collections import defaultdict

        near = [defaultdict(lambda: [0.0, 0.0]) for _ in range(k)]
        for i, j, w in sorted(tuple(r) for r in flow.collect()):  # at most `most`
            near[i][j][0] += w
            near[j][i][1] += w
        level, at, rng = community._Level(inside.tolist(), near, list(range(k))), list(range(k)), random.Random(seed)
        while community._settle(level, rng):
            level, up = community._folded(level)
            at = [up[x] for x in at]
        return np.array(at, np.int32)[place]
    again = Packed(flow, k, n_links)
    moved, _ = settle(again, np.ones(k), inside, np.arange(k, dtype=np.int32), term, seed)
    if len(np.unique(moved)) < k:
        moved = _upper(again, np.ones(k), inside, moved, term, seed, most)
    return moved[place]


def communities_at_size(network: DataFrame, tau: float, seed: int, most: int, turns: int = 10) -> DataFrame:
    """(file, community) of network(a, b, weight) of any number of links."""
    names, n = numbered(network.select(F.col("a").alias("file")).unionByName(network.select(F.col("b").alias("file"))))
    names = cut(names, "names")
    links = network.join(names.withColumnsRenamed({"file": "a", "k": "i"}), "a").join(names.withColumnsRenamed({"file": "b", "k": "j"}), "b")
    links = cut(links.select("i", "j", F.col("weight").cast("double").alias("w")), "links")
    packed = Packed(links, n, links.count())
    rate, share = visit_rates(packed, tau)
    term = float(h(rate).sum())
    module, now = np.arange(n, dtype=np.int32), np.inf
    for turn in range(turns):
        tried, _ = settle(packed, share, rate, module, term, seed + turn)
        tried, _ = _names(_upper(packed, share, rate, tried, term, seed + turn, most))
        bits = code(rate, tried, packed.summed(_crossing, share, tried), term)
        if bits < now:
            module, before, now = tried, now, bits
            if before - now > WORTH * abs(now):
                continue
        break
    if now > -term - 1e-10:  # one module is as good
        module = np.zeros(n, np.int32)
    module, _ = _names(module)
    sent = network.sparkSession.sparkContext.broadcast(module)

    def name(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sent.value[b.column(1).to_numpy()])], names=["file", "community"])

    return cut(names.mapInArrow(name, "file string, community int"), "communities")
