"""Near-duplicate vectors by a random-projection tree forest.

Equal vectors are one from the start. Every tree splits recursively by random directions at the median; vectors within
the spill band around a median go to both sides. The top of the trees is grown on a sample of at most SAMPLE_BYTES (the
vectors with the smallest checksums), and every vector is dropped through it. Leaves that then hold more than LEAF
vectors are split further, level by level over all vectors: their quantiles come from a distributed sketch, and no
vector moves. So leaves keep their size however many vectors there are. A leaf whose vectors all point one way, such as
a large group of near copies, is not split: most of its pairs are links, and halves would lose them.

Within a leaf every two vectors are compared by exact cosine; a pair that meets in several leaves counts in the first
leaf that both share, which each vector's list of leaves tells, so no pair is ever a row. A leaf of more than TILE
vectors is cut into tiles, and every two tiles are a unit of work of their own, so no leaf is an unbounded group.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components link with nothing and are
their own component; vectors of another length than the usual one are compared among themselves; repeated rows link
like copies; a null vec_id is kept, and names a component only if the component has no other; an empty table gives an
empty result; extra columns are ignored; a cosine of exactly 0.95, as doubles give it, links. Vectors have 64-bit names: among 2 ** 32 of them two unequal ones share a name
with even odds.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import cut, partitions, share_bytes, tune
from graphloom.llm.components import connected_components

COSINE = 0.95
TREES = 10
LEAF = 1024
#: Share of a node's vectors that goes to both sides.
SPILL = 0.1
#: Vectors on which trees are grown: so many bytes of them at most.
SAMPLE_BYTES = 24 << 20
TILE = 1024
#: Spread of a leaf's projections (half of the distance between the 16th and the 84th hundredth) below which it is not
#: split; two vectors with a cosine of 0.95 lie 0.32 apart on average.
NARROW = 0.4
#: Levels below the sample's leaves: each halves them.
MOST_LEVELS = 40
SEED = 20_240_607


def grow(sample: np.ndarray, trees: int = TREES, spill: float = SPILL, seed: int = SEED) -> tuple[list[tuple], list[int]]:
    """(direction, low, high, children) arrays of each tree, and the tree of each leaf; a child below 0 is leaf -child - 1,
    numbered through all trees."""
    out, n_leaves, leaf, tree_of = [], 0, LEAF, []
    for tree in range(trees):
        rng = np.random.default_rng((seed, tree))
        nodes: list[list] = []
        stack = [(np.arange(len(sample)), -1, 0)]
        root = None
        while stack:
            rows, parent, side = stack.pop()
            if len(rows) > leaf:
                d = rng.standard_normal(sample.shape[1]).astype(np.float32)
                p = sample[rows] @ d
                low, high = np.quantile(p, [0.5 - spill / 2, 0.5 + spill / 2])
                left, right = rows[p <= high], rows[p >= low]
            if len(rows) <= leaf or len(left) > 0.9 * len(rows) or len(right) > 0.9 * len(rows):
                n_leaves += 1
                name = -n_leaves
                tree_of.append(tree)
            else:
                name = len(nodes)
                nodes.append([d, low, high, 0, 0])
                stack += [(right, name, 4), (left, name, 3)]
            if parent < 0:
                root = name
            else:
                nodes[parent][side] = name
        out.append(
            (
                root,
                np.array([x[0] for x in nodes], np.float32).reshape(len(nodes), sample.shape[1]),
                np.array([x[1] for x in nodes], np.float32),
                np.array([x[2] for x in nodes], np.float32),
                np.array([x[3:] for x in nodes], np.int64).reshape(len(nodes), 2),
            )
        )
    return out, tree_of


def leaves_of(forest: list[tuple], unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of every leaf that a unit vector reaches, sorted by row and leaf."""
    rows_, leaves_ = [], []
    for root, direction, low, high, children in forest:
        row, node = np.arange(len(unit)), np.full(len(unit), root)
        while len(row):
            end = node < 0
            rows_.append(row[end])
            leaves_.append(-node[end] - 1)
            row, node = row[~end], node[~end]
            p = np.einsum("ij,ij->i", unit[row], direction[node]) if len(row) else np.empty(0, np.float32)
            left, right = p <= high[node], p >= low[node]
            row, node = np.concatenate((row[left], row[right])), np.concatenate((children[node[left], 0], children[node[right], 1]))
    row, leaf = np.concatenate(rows_), np.concatenate(leaves_)
    order = np.lexsort((leaf, row))
    return row[order], leaf[order]


def describe(vectors: DataFrame) -> DataFrame:
    """vec_id, key (checksum; null if the vector links with nothing), dim and body (doubles, or floats if exact) of every row."""

    def run(batches):
        for batch in batches:
            keys, dims, bodies = [], [], []
            for v in batch.column(1).to_pylist():
                body = key = None
                if v and None not in v:
                    x = np.array(v, np.float64)
                    if np.isfinite(x).all() and x.any():
                        body = x.tobytes()
                        key = int.from_bytes(hashlib.md5(body).digest()[:8], "little", signed=True)
                        if (x == x.astype(np.float32)).all():  # the same numbers in half the bytes
                            body = x.astype(np.float32).tobytes()
                keys.append(key)
                dims.append(len(v) if body else 0)
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(dims, pa.int32()), pa.array(bodies, pa.binary())], ["vec_id", "key", "dim", "body"])

    return vectors.mapInArrow(run, "vec_id long, key long, dim int, body binary")


def _unit(bodies: list[bytes], dim: int) -> np.ndarray:
    if len({len(b) for b in bodies}) == 1:
        x = np.frombuffer(b"".join(bodies), np.float64 if len(bodies[0]) == 8 * dim else np.float32).reshape(-1, dim).astype(np.float64)
    else:
        x = np.array([np.frombuffer(b, np.float64 if len(b) == 8 * dim else np.float32) for b in bodies], np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither squares of huge nor of tiny components leave the range
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def place(distinct: DataFrame, forest, usual: int) -> DataFrame:
    """distinct with leaves (packed, ascending); vectors of another length than usual get a leaf for their length."""
    shipped = distinct.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for batch in batches:
            dims = batch.column(2).to_numpy()
            bodies = batch.column(3).to_pylist()
            lists = [None] * len(dims)
            fit = np.flatnonzero(dims == usual)
            for i in np.flatnonzero(dims != usual).tolist():
                lists[i] = np.array([-int(dims[i])], np.int64).tobytes()
            if len(fit):
                row, leaf = leaves_of(shipped.value, _unit([bodies[i] for i in fit], usual).astype(np.float32))
                ends = np.searchsorted(row, np.arange(len(fit) + 1))
                leaf = leaf.astype(np.int64)
                for k, i in enumerate(fit.tolist()):
                    lists[i] = leaf[ends[k] : ends[k + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lists, pa.binary())], ["key", "copies", "dim", "body", "leaves"])

    return distinct.select("key", "copies", "dim", "body").mapInArrow(run, PLACED)


PLACED = "key long, copies long, dim int, body binary, leaves binary"


def _level_directions(trees: int, level: int, dim: int) -> np.ndarray:
    """One direction for each tree at a level below the sample's leaves."""
    return np.stack([np.random.default_rng((SEED, tree, 1000 + level)).standard_normal(dim).astype(np.float32) for tree in range(trees)])


def _flat(lists: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) of packed lists of leaves."""
    return np.repeat(np.arange(len(lists)), [len(x) // 8 for x in lists]), np.frombuffer(b"".join(lists), np.int64)


def refine(placed: DataFrame, tree_of: list[int], dim: int) -> DataFrame:
    """placed with every leaf of more than LEAF vectors split, level by level, unless it is NARROW or does not part."""
    spark, leaves = placed.sparkSession, len(tree_of)
    tree_of = np.array(tree_of, np.int64)
    done = np.empty(0, np.int64)  # leaves that stay as they are
    nodes_type = np.dtype([("leaf", "<i8"), ("tree", "<i8"), ("low", "<f4"), ("high", "<f4"), ("left", "<i8")])

    def names(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_flat(batch.column(0).to_pylist())[1])], ["leaf"])

    for level in range(MOST_LEVELS):
        sizes = placed.select("leaves").mapInArrow(names, "leaf long").filter("leaf >= 0").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > LEAF)
        big = np.array([r["leaf"] for r in sizes.select("leaf").collect()], np.int64)  # a share of 1 / LEAF of the vectors times TREES, 8 bytes each
        big = np.sort(np.setdiff1d(big, done))
        if not len(big):
            break
        asked = share_bytes(spark, np.rec.fromarrays([big, tree_of[big]], names="leaf,tree").tobytes(), "leaves")

        def project(batches, asked=asked, level=level):
            wanted = np.fromfile(SparkFiles.get(asked), np.dtype([("leaf", "<i8"), ("tree", "<i8")]))
            directions = _level_directions(TREES, level, dim)
            for batch in batches:
                dims, bodies, lists = batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
                fit = np.flatnonzero(dims == dim)
                if not len(fit):
                    continue
                p = _unit([bodies[i] for i in fit], dim).astype(np.float32) @ directions.T
                row, leaf = _flat([lists[i] for i in fit])
                at = np.minimum(np.searchsorted(wanted["leaf"], leaf), len(wanted) - 1)
                hit = wanted["leaf"][at] == leaf
                yield pa.RecordBatch.from_arrays([pa.array(leaf[hit]), pa.array(p[row[hit], wanted["tree"][at[hit]]])], ["leaf", "p"])

        marks = [0.16, 0.5 - SPILL / 2, 0.5 + SPILL / 2, 0.84]
        found = placed.mapInArrow(project, "leaf long, p float").groupBy("leaf").agg(F.percentile_approx("p", marks, 2000).alias("q")).collect()
        found = sorted((r["leaf"], r["q"]) for r in found)
        narrow = [leaf for leaf, q in found if (q[3] - q[0]) / 2 < NARROW or not q[1] < q[2]]
        done = np.union1d(done, np.array(narrow, np.int64))
        parted = [(leaf, q) for leaf, q in found if (q[3] - q[0]) / 2 >= NARROW and q[1] < q[2]]
        if not parted:
            break
        nodes = np.zeros(len(parted), nodes_type)
        nodes["leaf"] = [leaf for leaf, _ in parted]
        nodes["tree"] = tree_of[nodes["leaf"]]
        nodes["low"], nodes["high"] = [q[1] for _, q in parted], [q[2] for _, q in parted]
        nodes["left"] = leaves + 2 * np.arange(len(parted))
        leaves += 2 * len(parted)
        tree_of = np.concatenate((tree_of, np.repeat(nodes["tree"], 2)))
        split = share_bytes(spark, nodes.tobytes(), "nodes")

        def part(batches, split=split, level=level):
            known = np.fromfile(SparkFiles.get(split), nodes_type)
            directions = _level_directions(TREES, level, dim)
            for batch in batches:
                dims, bodies, lists = batch.column(2).to_numpy(), batch.column(3).to_pylist(), batch.column(4).to_pylist()
                fit = np.flatnonzero(dims == dim)
                if len(fit):
                    p = _unit([bodies[i] for i in fit], dim).astype(np.float32) @ directions.T
                    row, leaf = _flat([lists[i] for i in fit])
                    at = np.minimum(np.searchsorted(known["leaf"], leaf), len(known) - 1)
                    hit = known["leaf"][at] == leaf
                    node, own = known[at[hit]], row[hit]
                    q = p[own, node["tree"]]
                    left, right = q <= node["high"], q >= node["low"]
                    row = np.concatenate((row[~hit], own[left], own[right]))
                    leaf = np.concatenate((leaf[~hit], node["left"][left], node["left"][right] + 1))
                    order = np.lexsort((leaf, row))
                    row, leaf = row[order], leaf[order]
                    ends = np.searchsorted(row, np.arange(len(fit) + 1))
                    for k, i in enumerate(fit.tolist()):
                        lists[i] = leaf[ends[k] : ends[k + 1]].tobytes()
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(lists, pa.binary())], ["key", "copies", "dim", "body", "leaves"])

        placed = cut(placed.mapInArrow(part, PLACED), f"level-{level}")
    return placed


def compare(sides: np.ndarray, keys: np.ndarray, copies: np.ndarray, unit: np.ndarray, leaves: list[np.ndarray], leaf: int, cosine: float):
    """(links to count here, component label) of each vector of a unit of work; sides differ if only pairs across count."""
    near = unit @ unit.T >= cosine
    np.fill_diagonal(near, False)
    if sides.any() and not sides.all():
        near &= sides[:, None] != sides[None, :]
    label = keys.copy()
    while True:
        lowest = np.minimum(label, np.where(near, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lowest == label).all():
            break
        label = lowest
    linked = np.flatnonzero(near.any(axis=1))
    # pairs that share an earlier leaf count there
    if len(linked):
        earlier = [leaves[i][leaves[i] < leaf] for i in linked]
        names, place_ = np.unique(np.concatenate(earlier), return_inverse=True)
        member = np.zeros((len(linked), len(names)), np.float32)
        member[np.repeat(np.arange(len(linked)), [len(x) for x in earlier]), place_] = 1
        own = near[np.ix_(linked, linked)] & ~(member @ member.T > 0)
        links = own @ copies[linked]
    else:
        links = np.empty(0, np.int64)
    return linked, links, label[linked]


def vector_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of vectors(vec_id, embedding)."""
    spark = vectors.sparkSession
    tune(spark)
    n_parts = partitions(spark)
    rows = cut(describe(vectors.select(F.col("vec_id").cast("long"), "embedding")), "vectors")
    usable = rows.filter("key is not null")
    distinct = usable.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.first("dim").alias("dim"), F.first("body").alias("body"))
    usual = distinct.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    forest, tree_of, dim = [], [], 0
    if usual is not None:
        dim = usual["dim"]
        sample = distinct.filter(F.col("dim") == dim).orderBy("key").limit(max(1, SAMPLE_BYTES // (8 * dim))).select("body").collect()  # SAMPLE_BYTES at most
        forest, tree_of = grow(_unit([bytes(r["body"]) for r in sample], dim).astype(np.float32))
        del sample
    placed = refine(cut(place(distinct, forest, dim), "leaves"), tree_of, dim)

    def names(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_flat(batch.column(0).to_pylist())[1])], ["leaf"])

    # leaves that could not be split, and those of unusual lengths: at most TREES for each TILE vectors
    sizes = placed.select("leaves").mapInArrow(names, "leaf long").groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > TILE)
    tiles = spark.sparkContext.broadcast({r["leaf"]: -(-r["n"] // TILE) for r in sizes.collect()})

    def units(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            out = []
            for i, (key, blob) in enumerate(zip(keys.tolist(), batch.column(4).to_pylist())):
                for leaf in np.frombuffer(blob, np.int64).tolist():
                    n = tiles.value.get(leaf, 1)
                    own = (key >> 7) % n
                    for other in range(n):
                        out.append((leaf, min(own, other), max(own, other), own, i))
            for k in range(0, len(out), 4000):
                leaf, low, high, own, at = zip(*out[k : k + 4000])
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(own, pa.int32()), *(batch.column(c).take(at) for c in range(5))],
                    ["leaf", "low", "high", "own", "key", "copies", "dim", "body", "leaves"],
                )

    def verify(batches):
        now, held = None, []

        def solve():
            own, keys, copies, dims, bodies, lists = zip(*held)
            linked, links, label = compare(
                np.array(own) != now[1], np.array(keys), np.array(copies), _unit(bodies, dims[0]), [np.frombuffer(x, np.int64) for x in lists], now[0], cosine
            )
            return pa.RecordBatch.from_arrays([pa.array(np.array(keys)[linked]), pa.array(links.astype(np.int64)), pa.array(label)], ["key", "links", "label"])

        for batch in batches:
            for leaf, low, high, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                if (leaf, low, high) != now:
                    if len(held) > 1:
                        yield solve()
                    now, held = (leaf, low, high), []
                held.append(rest)
        if len(held) > 1:
            yield solve()

    parts = "leaf long, low int, high int, own int, key long, copies long, dim int, body binary, leaves binary"
    dealt = placed.mapInArrow(units, parts).repartition(n_parts, "leaf", "low", "high").sortWithinPartitions("leaf", "low", "high")
    met = cut(dealt.mapInArrow(verify, "key long, links long, label long"), "met")
    counts = met.groupBy("key").agg(F.sum("links").alias("links"))
    groups = cut(connected_components(met.select(F.col("key").alias("a"), F.col("label").alias("b")).filter("a <> b").distinct()), "groups").select(F.col("id").alias("key"), "component")
    about = distinct.select("key", "copies").join(counts, "key", "left").join(groups, "key", "left").select(
        "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("component")
    )
    named = usable.select("vec_id", "key").join(about, "key")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    linked = named.join(least, "component").select("vec_id", "n_links", "component_id")
    alone = rows.filter("key is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
