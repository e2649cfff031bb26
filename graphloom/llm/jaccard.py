"""N-gram Jaccard join by set-relation skipping.

Texts with equal shingle sets are one set from the start. Sets meet in index lists, one for each shingle of their
prefix; lists are ordered by size and cut into blocks of like size and position, and two blocks whose sizes or
positions rule out enough overlap are skipped whole. Sets that may meet form candidate groups; inside a group one
set's answers are computed against all others, and each set similar to it derives its own: the Jaccard distance obeys
the triangle inequality, so only sets not yet connected and near enough to the computed one are compared at all.

Which shingles form a prefix. Sets of size n that link share ceil(0.8 n) shingles, so among the first
n - ceil(0.8 n) + l of a common order they share l at least. With l(n) = n / 10 + 1 in hash order, every set may
afterwards leave out its l(ceil(0.8 n)) - 1 most frequent prefix shingles, by one order for all sets, and still meets
each partner in one of the others. That empties the lists of passages that many documents share, without losing a link.

Nothing is capped: a candidate group with more than BLOCK_BYTES of sets is cut into blocks and every two blocks that
hold a candidate group's sets are compared in a task of their own.

Defined results: a null or wordless text has an empty set, links with nothing and is its own component; repeated rows
link like copies; a null doc_id takes part and cannot be a component's name unless its whole component has none; an
empty table gives an empty result; extra columns are ignored; very long texts are sets of all their shingles; a similarity
of exactly 0.8 links, in whole numbers.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm.common import blobs_by_part, by_part, cut, gather, pack, partitions, scatter, text_bytes, tune
from graphloom.llm.components import Groups, connected_components
from graphloom.llm.shingles import set_ids, shingle_sets

#: Similarity in hundredths.
LINK_AT = 80
#: Bytes of sets of one candidate group that a task holds at once.
BLOCK_BYTES = 8 << 20
POSTING = (np.uint64, np.int64, np.uint32, np.uint32)


def need(n):
    """Shingles that a set of size n shares with every partner at least."""
    return -(-LINK_AT * n // 100)


def extra(n):
    return n // 10 + 1


def links(inter, a, b):
    return 100 * inter >= LINK_AT * (a + b - inter)


def sized(a, b):
    """Whether sizes allow a link."""
    return 100 * np.minimum(a, b) >= LINK_AT * np.maximum(a, b)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, mark (checksum of the text), n (set size) and sid (name of the set) of every row of docs(doc_id, text, mark)."""

    def run(batches):
        for batch in batches:
            sets = list(shingle_sets(*text_bytes(batch.column(1))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_ids(sets))], ["doc_id", "mark", "n", "sid"]
            )

    return docs.mapInArrow(run, "doc_id long, mark long, n long, sid long")


def _blob_rows(parts):
    rows = [(p, pack(*arrays)) for p, arrays in parts]
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def index_prefixes(docs: DataFrame, n_parts: int) -> DataFrame:
    """Blobs of (shingle, sid, n, position), dealt by shingle; copies within a batch count once."""

    def run(batches):
        for batch in batches:
            sets = [s for s in shingle_sets(*text_bytes(batch.column(1))) if len(s)]
            own = set_ids(sets)
            _, once = np.unique(own, return_index=True)
            sets, own = [sets[i] for i in once], own[once]
            if not sets:
                continue
            sizes = np.array([len(s) for s in sets], np.int64)
            used = np.minimum(sizes, sizes - need(sizes) + extra(sizes))
            h = np.concatenate([s[:k] for s, k in zip(sets, used)])
            position = np.arange(len(h)) - np.repeat(np.cumsum(used) - used, used)
            part = (h & np.uint64(0x7FFFFFFF)) % np.uint64(n_parts)
            yield _blob_rows(scatter(part, n_parts, h, np.repeat(own, used), np.repeat(sizes, used).astype(np.uint32), position.astype(np.uint32)))

    return docs.mapInArrow(run, "part int, blob binary")


def shared_postings(index: DataFrame, n_parts: int) -> DataFrame:
    """Postings of shingles that two sets have, with the number of sets, dealt by sid."""

    def run(batches):
        for _, blobs in blobs_by_part(batches):
            h, sid, n, position = gather(blobs, *POSTING)
            order = np.lexsort((sid, h))
            h, sid, n, position = h[order], sid[order], n[order], position[order]
            first = np.concatenate(([True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])))
            h, sid, n, position = h[first], sid[first], n[first], position[first]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.append(start, len(h)))
            often = np.repeat(count, count)
            keep = often > 1
            part = sid[keep].view(np.uint64) % np.uint64(n_parts)
            yield _blob_rows(scatter(part, n_parts, h[keep], sid[keep], n[keep], position[keep], often[keep].astype(np.uint32)))

    return by_part(index, n_parts).mapInArrow(run, "part int, blob binary")


def rare_postings(shared: DataFrame, n_parts: int) -> DataFrame:
    """Each set without the most frequent of its prefix shingles, dealt by shingle again."""

    def run(batches):
        for _, blobs in blobs_by_part(batches):
            h, sid, n, position, often = gather(blobs, *POSTING, np.uint32)
            if not len(h):
                continue
            order = np.lexsort((h, often, sid))
            h, sid, n, position = h[order], sid[order], n[order].astype(np.int64), position[order]
            start = np.flatnonzero(np.concatenate(([True], sid[1:] != sid[:-1])))
            count = np.diff(np.append(start, len(sid)))
            from_end = np.repeat(count, count) - (np.arange(len(sid)) - np.repeat(start, count))
            keep = from_end > extra(need(n)) - 1
            part = (h[keep] & np.uint64(0x7FFFFFFF)) % np.uint64(n_parts)
            yield _blob_rows(scatter(part, n_parts, h[keep], sid[keep], n[keep].astype(np.uint32), position[keep]))

    return by_part(shared, n_parts).mapInArrow(run, "part int, blob binary")


def _may_link(n1, p1, n2, p2):
    """Whether sizes, and the positions of one shingle that both have, leave room for enough common shingles."""
    most = np.minimum(p1, p2) + 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1)
    return sized(n1, n2) & (100 * most >= LINK_AT * (n1 + n2 - most))


def _list_edges(n: np.ndarray, p: np.ndarray):
    """Pairs (i, j) of places in one index list, sorted by size, that connect all that may link; blocks first."""
    if len(n) <= 24:
        i, j = np.triu_indices(len(n), 1)
        ok = _may_link(n[i], p[i], n[j], p[j])
        return i[ok], j[ok]
    block = np.floor(np.log(n) / np.log(1.08)).astype(np.int64) * 64 + np.minimum(63, 256 * p // n)
    order = np.argsort(block, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], np.diff(block[order]) != 0)))
    low = [np.minimum.reduceat(x[order], edges) for x in (n, p)]
    high = [np.maximum.reduceat(x[order], edges) for x in (n, p)]
    head = order[edges]
    inner = np.repeat(head, np.diff(np.append(edges, len(n))))
    i, j = np.triu_indices(len(edges), 1)
    # the best that any two members of blocks i and j could do; blocks that cannot are skipped whole
    ok = 100 * np.minimum(high[0][i], high[0][j]) >= LINK_AT * np.maximum(low[0][i], low[0][j])
    best = np.zeros(len(i), np.int64)
    for a, b in ((i, j), (j, i)):
        # members of a come first: shingles are missing between the positions in the set of b alone
        most = np.minimum(high[0][a], high[0][b] - np.maximum(0, low[1][b] - high[1][a]))
        best = np.maximum(best, np.where(low[1][a] <= high[1][b], most, 0))
    ok &= (100 + LINK_AT) * best >= LINK_AT * (low[0][i] + low[0][j])
    return np.concatenate((inner, head[i[ok]])), np.concatenate((order, head[j[ok]]))


def candidate_edges(rare: DataFrame, n_parts: int) -> DataFrame:
    """Stars (a, b) of the sets that may link, for each share of the shingles."""

    def run(batches):
        for _, blobs in blobs_by_part(batches):
            h, sid, n, p = gather(blobs, *POSTING)
            if not len(h):
                continue
            names, place = np.unique(sid, return_inverse=True)
            n, p = n.astype(np.int64), p.astype(np.int64)
            order = np.lexsort((n, h))
            h, place, n, p = h[order], place[order], n[order], p[order]
            start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            count = np.diff(np.append(start, len(h)))
            two = start[count == 2]
            two = two[_may_link(n[two], p[two], n[two + 1], p[two + 1])]
            found = [np.stack((place[two], place[two + 1]))]
            for s, c in zip(start[count > 2].tolist(), count[count > 2].tolist()):
                i, j = _list_edges(n[s : s + c], p[s : s + c])
                found.append(np.stack((place[s + i], place[s + j])))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1)
            groups = Groups(len(names))
            for x, y in pairs.T.tolist():
                groups.join(x, y)
            kept = groups.stars(np.unique(pairs).tolist())  # names ascend, so roots are the smallest names
            if kept:
                x, y = np.array(kept).T
                yield pa.RecordBatch.from_arrays([pa.array(names[x]), pa.array(names[y])], ["a", "b"])

    return by_part(rare, n_parts).mapInArrow(run, "a long, b long")


def resolve(sets: list[np.ndarray], blocks: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs that link the sets as all links among them would: a spanning forest of the link graph.

    blocks: 0 or 1 for each set; given, only pairs of unlike blocks matter.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(sizes, kind="stable")
    groups, forest = Groups(len(sets)), []
    data = np.concatenate([sets[i] for i in order])
    ends = np.cumsum(sizes[order])
    starts = ends - sizes[order]
    root = np.arange(len(sets))  # of order[k]
    waiting = np.ones(len(sets), bool)

    def shared(k: int, others: np.ndarray) -> np.ndarray:
        own = sets[order[k]]
        if len(others) == len(sets):
            body, sz, off = data, sizes[order], starts
        else:
            body = np.concatenate([sets[order[o]] for o in others])
            sz = sizes[order[others]]
            off = np.cumsum(sz) - sz
        at = np.searchsorted(own, body)
        hit = own[np.minimum(at, len(own) - 1)] == body
        return np.add.reduceat(hit.astype(np.int64), off)

    def join(k: int, o: int) -> None:
        if groups.join(k, o):
            forest.append((int(order[k]), int(order[o])))

    def compare(k: int, others: np.ndarray) -> np.ndarray:
        """Jaccard similarity of k and the others; links are joined."""
        inter = shared(k, others)
        a, b = sizes[order[k]], sizes[order[others]]
        ok = links(inter, a, b)
        if blocks is not None:
            ok &= blocks[order[k]] != blocks[order[others]]
        hits = others[ok]
        for o in hits[root[hits] != root[k]].tolist():
            join(k, o)
        if len(hits):
            lead = min(root[hits].min(), root[k])
            root[np.isin(root, np.append(root[hits], root[k]))] = lead
        return inter / (a + b - inter)

    for k in range(len(sets)):
        if not waiting[k]:
            continue
        waiting[k] = False
        others = np.flatnonzero(waiting)
        others = others[sized(sizes[order[k]], sizes[order[others]]) | (root[others] == root[k])]
        if not len(others):
            continue
        if len(others) * 2 > len(sets):
            similarity = np.zeros(len(sets))
            similarity[:] = compare(k, np.arange(len(sets)))
        else:
            similarity = np.full(len(sets), -1.0)
            similarity[others] = compare(k, others)
        # sets similar to k derive their answers from k's
        near = others[similarity[others] * 100 >= LINK_AT]
        for m in near[np.argsort(-similarity[near], kind="stable")].tolist():
            waiting[m] = False
            if blocks is None and (root == root[k]).all():
                continue
            rest = np.flatnonzero(root != root[m]) if blocks is None else np.flatnonzero((root != root[m]) & (blocks[order] != blocks[order[m]]))
            rest = rest[sized(sizes[order[m]], sizes[order[rest]])]
            known = similarity[rest] >= 0
            # d(m, x) >= d(k, x) - d(k, m): beyond 1 - LINK_AT / 100 there is no link
            far = known & ((1 - similarity[rest]) - (1 - similarity[m]) > 1 - LINK_AT / 100 + 1e-9)
            rest = rest[~far]
            if len(rest):
                compare(m, rest)
    return forest


def similar_components(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, sid) of every row and (sid, grp) of every set that links with another, grp naming its component."""
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("mark"))
    n_parts = partitions(spark)
    rows = cut(describe(docs), "sets")
    index = index_prefixes(docs, n_parts)
    edges = candidate_edges(rare_postings(shared_postings(index, n_parts), n_parts), n_parts)
    candidates = cut(connected_components(edges).select(F.col("id").alias("sid"), F.col("component").alias("grp")), "candidates")
    # one (doc_id, checksum) for each candidate set says where its text is; a set that only rows without a doc_id hold has one too
    where = rows.join(candidates, "sid").groupBy("sid", "grp").agg(F.min(F.struct(F.isnull("doc_id").alias("without"), "doc_id", "mark")).alias("at"), F.max("n").alias("n"))
    where = where.select("sid", "grp", "at.doc_id", "at.mark", "n")
    group = where.groupBy("grp").agg(F.sum(8 * F.col("n")).alias("bytes"))
    where = where.join(group, "grp").withColumn("n_blocks", F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int"))
    where = cut(where, "where")
    # by merge at every size: what is shuffled then follows the input, not a switch to broadcasting
    at = where.select(F.col("doc_id").alias("at_id"), F.col("mark").alias("at_mark"), "sid", "grp", "n_blocks").hint("merge")
    texts = docs.join(at, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("mark") == F.col("at_mark")))

    def sets(batches):
        sent = set()  # repeated rows of one doc_id and text meet here, and go once
        for batch in batches:
            if not batch.num_rows:
                continue
            found = list(shingle_sets(*text_bytes(batch.column(1))))
            sids = batch.column(2).to_numpy()
            first = np.zeros(len(sids), bool)
            first[np.unique(sids, return_index=True)[1]] = True
            # the checksum in the join is no proof: the set is
            keep = [i for i in np.flatnonzero(first & (set_ids(found) == sids)).tolist() if sids[i] not in sent]
            sent.update(sids[keep].tolist())
            taken = pa.array(keep, pa.int64())
            blobs = pa.array([found[i].tobytes() for i in keep], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(i).take(taken) for i in (2, 3, 4)] + [blobs], ["sid", "grp", "n_blocks", "blob"])

    made = texts.select("doc_id", "text", "sid", "grp", "n_blocks").mapInArrow(sets, "sid long, grp long, n_blocks int, blob binary")
    block = F.pmod(F.xxhash64("sid"), F.col("n_blocks")).cast("int")
    # a group of one block is one unit of work; of more, one for each two blocks, with each block's sets where it is needed
    units = (
        made.withColumn("block", block)
        .withColumn("other", F.explode(F.when(F.col("n_blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n_blocks") - 1))))
        .select("grp", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "sid", "blob")
    )

    def verify(batches):
        now, held = None, []

        def solve():
            by_sid = {}
            for block_, sid, blob in held:
                by_sid.setdefault(sid, (block_, np.frombuffer(blob, np.uint64)))
            if len(by_sid) < 2:
                return None
            sids = list(by_sid)
            own = [by_sid[s][1] for s in sids]
            blocks = None if now[1] == now[2] else np.array([by_sid[s][0] != now[1] for s in sids])
            forest = resolve(own, blocks)
            if not forest:
                return None
            names = sorted({sids[i] for pair in forest for i in pair})
            groups = Groups(len(names))
            for i, j in forest:
                groups.join(bisect.bisect_left(names, sids[i]), bisect.bisect_left(names, sids[j]))
            stars = groups.stars(range(len(names)))
            return pa.RecordBatch.from_arrays([pa.array([names[i] for i, _ in stars], pa.int64()), pa.array([names[j] for _, j in stars], pa.int64())], ["a", "b"])

        for batch in batches:
            for grp, low, high, block_, sid, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, low, high) != now:
                    if held and (out := solve()) is not None:
                        yield out
                    now, held = (grp, low, high), []
                held.append((block_, sid, blob))
        if held and (out := solve()) is not None:
            yield out

    linked = units.repartition(n_parts, "grp", "low", "high").sortWithinPartitions("grp", "low", "high").mapInArrow(verify, "a long, b long")
    return rows, connected_components(linked).select(F.col("id").alias("sid"), F.col("component").alias("grp"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs(doc_id, text)."""
    rows, found = similar_components(docs)
    found = cut(found, "components")
    named = rows.filter("n > 0").join(found, "sid", "left").withColumn("grp", F.coalesce("grp", "sid"))
    least = named.groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    linked = named.join(least, "grp").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with their own columns, of which no smaller doc_id is in the same component; repeated rows go once.

    Rows without a doc_id stay.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    # other columns travel in one struct, so that no name of theirs can clash
    packed = docs.select("doc_id", "text", F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in others]).alias("others"))
    kept = jaccard_components(docs).filter("doc_id = component_id").select("doc_id").distinct()
    rank = F.row_number().over(Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1)))
    once = packed.join(kept, "doc_id").withColumn("rank", rank).filter("rank = 1").drop("rank")
    rows = once.unionByName(packed.filter("doc_id is null"))
    return rows.select(*[F.col(c) if c in ("doc_id", "text") else F.col("others").getField(c).alias(c) for c in docs.columns])
