"""File-level projection of a code graph and the edges inferred on it."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import parent_dir, symbol_tokens
from graphloom.graph import Graph
from graphloom.lineage import cut
from graphloom.operators.aggregates import relation_weight

# Executors need no copy of this package: functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def entity_files(g: Graph) -> DataFrame:
    """(id, file): file nodes are their own file, others belong to that of their file_path."""
    file_ = F.when(F.col("node_type") == "file", F.col("id")).when(F.col("file_path").isNotNull(), F.concat(F.lit("file:"), "file_path"))
    return g.nodes.select("id", file_.alias("file")).where("file is not null").distinct()


def file_network(edges: DataFrame, owners: DataFrame, overrides: dict | None = None) -> DataFrame:
    """(a, b, weight): edges between entities summed over their owners; within one owner, and of weight 0, none."""
    w = relation_weight(F.col("relation"), overrides) * F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    e = edges.select("src", "dst", w.alias("w")).where("w > 0")
    e = e.join(owners.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(owners.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst")
    return e.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("weight"))


# Relations by which one file cites another, and those that couple two files directly.
CITING = ("imports", "calls", "uses", "type_reference", "depends_on")
COUPLING = ("calls", "imports", "uses", "type_reference")


def on_files(edges: DataFrame, owners: DataFrame | None) -> DataFrame:
    """(a, b, relation, c) of edges between owners, with their confidence within 0 and 1; without owners between the ends."""
    e = edges.select("src", "dst", "relation", F.least(F.greatest(F.coalesce("confidence", F.lit(1.0)), F.lit(0.0)), F.lit(1.0)).alias("c"))
    if owners is None:
        return e.select(F.col("src").alias("a"), F.col("dst").alias("b"), "relation", "c").where("a <> b")
    own = owners.select("id", "file")
    e = e.join(own.withColumnsRenamed({"id": "src", "file": "a"}), "src").join(own.withColumnsRenamed({"id": "dst", "file": "b"}), "dst")
    return e.where("a <> b").select("a", "b", "relation", "c")


def co_citation(edges: DataFrame, owners: DataFrame | None = None, weight: float = 0.4, least: int = 2, most: float = 2.0, minimum: float = 0.7, direct: float = 0.9, hub: int = 200) -> DataFrame:
    """(a, b, citers, weight) with a < b for files that the same files cite, unless one is surely coupled with the other.

    Both directions get the weight. A file that cites more than `hub` is a hub: the pairs of files that hubs cite are made whole, and
    written nowhere, in one task for each two blocks of files (pairs_of_hubs). owners: (id, file) of the ends; without, the ends
    themselves are the files.
    """
    def surest(relations):
        return F.max(F.when(F.col("relation").isin(*relations), F.col("c")))

    # one row for each two files, read for both questions
    between = cut(on_files(edges, owners).groupBy("a", "b").agg(surest(CITING).alias("cites"), surest(COUPLING).alias("couples")), "between")
    cited = between.where(F.col("cites") >= minimum).select(F.col("a").alias("citer"), F.col("b").alias("to"), F.col("cites").alias("c"))
    # only files that enough others cite can be in a pair, and only what cites two of them makes one
    often = cited.groupBy("to").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("to")
    cited = cited.join(often, "to", "left_semi")
    cited = cut(cited.join(cited.groupBy("citer").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("citer"), "citer", "left_semi").select("citer", "to", "c"), "cited")
    many = cut(cited.groupBy("citer").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hub).select("citer"), "hubs")
    few = cited.join(many, "citer", "left_anti")
    a, b = few.select("citer", F.col("to").alias("a"), F.col("c").alias("ca")), few.select("citer", F.col("to").alias("b"), F.col("c").alias("cb"))
    pairs = a.join(b, "citer").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.sqrt(F.col("ca") * F.col("cb"))).alias("trust"))
    coupled = between.where(F.col("couples") >= direct).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    by_hubs = cut(cited.join(many, "citer", "left_semi"), "cited-by-hubs")
    # pairs of two files that hubs cite are added up where those of the hubs are made; only the others are shuffled
    known = cut(by_hubs.select("to").distinct(), "known").withColumn("known", F.lit(True))

    def both(df):
        return df.join(known.withColumnsRenamed({"to": "a", "known": "ka"}), "a", "left").join(known.withColumnsRenamed({"to": "b", "known": "kb"}), "b", "left").withColumn("both", F.coalesce(F.col("ka") & F.col("kb"), F.lit(False))).drop("ka", "kb")

    pairs = both(cut(pairs, "pairs"))
    others = pairs.where("not both and n >= " + str(least)).join(coupled, ["a", "b"], "left_anti").select("a", "b", "n", "trust")
    made = pairs_of_hubs(by_hubs, more=pairs.where("both").drop("both"), gone=both(coupled).where("both").select("a", "b"), least=least)
    found = others.unionByName(made).withColumnsRenamed({"n": "citers"}).withColumn("trust", F.col("trust") / F.col("citers"))
    return found.select("a", "b", "citers", F.least(F.lit(most), weight * F.col("citers") * F.col("trust")).alias("weight"))


#: Cited files of a block, and hubs of a share, that are multiplied at once.
FILES, HUBS = 2000, 500
#: Tasks that the blocks are dealt over at most.
MOST_TASKS = 4000
#: Pairs that a task gives out at once.
GIVEN = 250_000


def pairs_of_hubs(cited: DataFrame, files: int = FILES, hubs: int = HUBS, more: DataFrame | None = None, gone: DataFrame | None = None, least: int = 1) -> DataFrame:
    """(a, b, n, trust) with a < b: of files that hubs cite, how many hubs cite both, and the sum of the roots of the products of
    their confidence. more(a, b, n, trust) is added to that, pairs of gone(a, b) are left out, and so are those of n below least.

    cited(citer, to, c) is a matrix of hubs and files; its product with itself is made in one task for each two blocks of files, which
    adds up the shares of the hubs one after the other. A pair is whole where it is made, so no pair is shuffled: what is, is each
    file with its hubs once for each block.
    """
    names = cut(cited.select("to").distinct(), "names")
    citers = cut(cited.select("citer").distinct().withColumn("k", F.monotonically_increasing_id()), "citers")  # written, so that numbers stay
    blocks, shares = (max(1, -(-df.count() // most)) for df, most in ((names, files), (citers, hubs)))
    block = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    share = F.pmod(F.xxhash64("k"), F.lit(shares))
    rows = cited.join(citers, "citer").groupBy("to", share.alias("share")).agg(F.collect_list(F.struct("k", F.sqrt("c").alias("root"))).alias("x"))
    rows = rows.select("to", "share", F.col("x.k").alias("ks"), F.col("x.root").alias("roots"))
    rows = rows.unionByName(names.select("to", F.lit(-1).cast("long").alias("share")), allowMissingColumns=True)  # a task first hears all names
    rows = rows.withColumn("block", block("to")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)).cast("array<long>")))
    rows = rows.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "share", (F.col("block") > F.col("other")).alias("right"), F.col("to").alias("a"), "ks", "roots")
    for kind, df in enumerate((more, gone)):
        if df is not None:
            i, j = block("a"), block("b")
            rows = rows.unionByName(df.withColumns({"i": F.least(i, j), "j": F.greatest(i, j), "share": F.lit(shares + kind).cast("long"), "right": i > j}), allowMissingColumns=True)
    for name in ("b string", "n long", "trust double"):
        if name.split()[0] not in rows.columns:
            rows = rows.withColumn(name.split()[0], F.lit(None).cast(name.split()[1]))
    dealt = rows.repartition(min(MOST_TASKS, blocks * (blocks + 1) // 2), "i", "j").sortWithinPartitions("i", "j", "share")

    def run(batches):
        now, product = None, None
        for batch in batches:
            i, j, share_ = (batch[k].to_numpy() for k in ("i", "j", "share"))
            starts = np.flatnonzero(np.concatenate(([True], (np.diff(i) != 0) | (np.diff(j) != 0) | (np.diff(share_) != 0)))) if len(i) else []
            for at, end in zip(starts, [*starts[1:], len(i)]):
                if now != (i[at], j[at]):
                    if product:
                        yield from product.pairs(least)
                    now, product = (i[at], j[at]), _Product(i[at] == j[at], shares)
                product.take(int(share_[at]), batch.slice(at, end - at))
        if product:
            yield from product.pairs(least)

    return dealt.select("i", "j", "share", "right", "a", "ks", "roots", "b", "n", "trust").mapInArrow(run, "a string, b string, n long, trust double")


class _Product:
    """The pairs of two blocks, or of one and itself; what it takes comes in the order of shares."""

    def __init__(self, same: bool, shares: int):
        self.same, self.shares, self.sides, self.at, self.held = same, shares, ([], []), None, []

    def _begin(self):
        sides = [sorted(x) for x in self.sides]  # by code points, as bytes of UTF-8 are
        self.names = [sides[0], sides[0] if self.same else sides[1]]
        self.place = [{x: k for k, x in enumerate(side)} for side in self.names]
        self.n, self.trust = (np.zeros((len(self.names[0]), len(self.names[1]))) for _ in range(2))

    def take(self, share: int, rows) -> None:
        if share != self.at:
            self._multiply()
            if self.at == -1:
                self._begin()
            self.at = share
        if share == -1:
            for name, right in zip(rows["a"].to_pylist(), rows["right"].to_pylist()):
                self.sides[right].append(name)
        elif share < self.shares:
            self.held.append(rows)
        else:
            right = rows["right"].to_pylist()
            one, two = rows["a"].to_pylist(), rows["b"].to_pylist()
            x = [self.place[0][b if r else a] for a, b, r in zip(one, two, right)]
            y = [self.place[1][a if r else b] for a, b, r in zip(one, two, right)]
            if share == self.shares:
                np.add.at(self.n, (x, y), rows["n"].to_numpy(zero_copy_only=False))
                np.add.at(self.trust, (x, y), rows["trust"].to_numpy(zero_copy_only=False))
            else:
                self.n[x, y] = 0

    def _multiply(self) -> None:
        """Adds what the hubs of one share make."""
        if not self.held:
            return
        rows, self.held = pa.Table.from_batches(self.held).combine_chunks(), []
        sizes = pa.compute.list_value_length(rows["ks"]).to_numpy()
        citers, k = np.unique(pa.compute.list_flatten(rows["ks"]).to_numpy(), return_inverse=True)
        root = pa.compute.list_flatten(rows["roots"]).to_numpy()
        right = rows["right"].to_numpy()
        names = rows["a"].to_pylist()
        made = []
        for side in range(1 if self.same else 2):
            of = np.flatnonzero(right == bool(side))
            column = np.full(len(names), -1)
            column[of] = [self.place[side][names[x]] for x in of]
            column = np.repeat(column, sizes)
            own = column >= 0
            cites, roots = (np.zeros((len(citers), len(self.names[side]))) for _ in range(2))
            cites[k[own], column[own]], roots[k[own], column[own]] = 1, root[own]
            made.append((cites, roots))
        (a, ra), (b, rb) = made[0], made[-1]
        self.n += a.T @ b
        self.trust += ra.T @ rb

    def pairs(self, least: int):
        self._multiply()
        if self.at == -1:
            return
        left, right = (np.array(x, object) for x in self.names)
        names = np.concatenate((left, right))
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(len(names))
        lines, names = max(1, GIVEN // max(1, len(right))), pa.array(names, pa.string())
        for at in range(0, len(left), lines):
            n = self.n[at : at + lines]
            x, y = np.nonzero((np.triu(n, at + 1) if self.same else n) >= max(1, least))  # one block is in order, so above its diagonal a < b
            if not len(x):
                continue
            n, trust = n[x, y].astype(np.int64), self.trust[at : at + lines][x, y]
            x, y = x + at, y + len(left)
            turned = (rank[x] > rank[y]) & (not self.same)
            low, high = np.where(turned, y, x), np.where(turned, x, y)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(low)), names.take(pa.array(high)), pa.array(n), pa.array(trust)], names=["a", "b", "n", "trust"])


#: Members of a group that meet in one task.
BLOCK = 2000


def in_blocks(left: DataFrame, right: DataFrame, key: str, a: str, b: str, block: int = BLOCK) -> DataFrame:
    """The pairs a < b of left and right, two views of one frame, within each key, made block by block.

    A group is cut into ceil(n / block) blocks by hash, each block of the left goes to every block of the right, and the
    join is on (key, left block, right block): the pairs of a large group are made in many tasks.
    """
    sizes = left.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    lefts = left.join(sizes, key).withColumn("_i", F.pmod(F.xxhash64(a), F.col("blocks"))).withColumn("_j", F.explode(every.cast("array<long>"))).drop("blocks")
    rights = right.join(sizes, key).withColumn("_j", F.pmod(F.xxhash64(b), F.col("blocks"))).withColumn("_i", F.explode(every.cast("array<long>"))).drop("blocks")
    return lefts.join(rights, [key, "_i", "_j"]).where(F.col(a) < F.col(b)).drop("_i", "_j")


def token_similarity(names: DataFrame, weight: float = 0.5, least: int = 2, jaccard: float = 0.15, common: int = 200) -> DataFrame:
    """(a, b, shared, weight) for owners whose names share tokens; tokens of more than `common` owners bring nobody together."""
    tokens = names.groupBy("owner").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(symbol_tokens(F.col("name")))))).alias("tokens"))
    each = tokens.select("owner", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    rare = each.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") <= common).select("token")
    kept = each.join(rare, "token")
    a, b = kept.select("token", F.col("owner").alias("a"), F.col("n").alias("na")), kept.select("token", F.col("owner").alias("b"), F.col("n").alias("nb"))
    pairs = a.join(b, "token").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("shared")).where(F.col("shared") >= least)
    whole = tokens.select("owner", "tokens")
    pairs = pairs.join(whole.select(F.col("owner").alias("a"), F.col("tokens").alias("ta")), "a").join(whole.select(F.col("owner").alias("b"), F.col("tokens").alias("tb")), "b")
    j = F.col("shared") / F.size(F.array_union("ta", "tb"))
    return pairs.withColumn("j", j).where(F.col("j") >= jaccard).select("a", "b", "shared", (weight * F.col("j")).alias("weight"))


def co_location(files: DataFrame, network: DataFrame, weight: float = 0.3) -> DataFrame:
    """(a, b, weight) for files without any edge yet that lie in the same directory."""
    linked = network.select(F.col("a").alias("file")).union(network.select(F.col("b").alias("file"))).distinct()
    alone = files.select("file").distinct().join(linked, "file", "left_anti").withColumn("dir", parent_dir(F.col("file")))
    a, b = alone.select("dir", F.col("file").alias("a")), alone.select("dir", F.col("file").alias("b"))
    return in_blocks(a, b, "dir", "a", "b").select("a", "b", F.lit(weight).alias("weight"))


def hubs(edges: DataFrame, owners: DataFrame, share: float = 0.05, least: int = 10) -> DataFrame:
    """(file, degree) of owners with more edges from other owners than a share of all owners, and than `least`."""
    e = edges.join(owners.select(F.col("id").alias("src"), F.col("file").alias("a")), "src").join(owners.select(F.col("id").alias("dst"), F.col("file").alias("b")), "dst").where("a <> b")
    degree = e.groupBy(F.col("b").alias("file")).agg(F.count(F.lit(1)).alias("degree"))
    n = owners.agg(F.countDistinct("file").alias("n"))
    return degree.join(F.broadcast(n)).where(F.col("degree") > F.greatest(F.ceil(F.col("n") * share), F.lit(least))).select("file", "degree")


def without(network: DataFrame, gone: DataFrame) -> DataFrame:
    ids = gone.select("file")
    return network.join(ids.withColumnRenamed("file", "a"), "a", "left_anti").join(ids.withColumnRenamed("file", "b"), "b", "left_anti").select(network.columns)
