"""Reachability: one frontier loop, and the traversals that are thin layers over it.

Each level joins the frontier with the edges, drops what is seen and is written to the shared folder; nothing is
gathered on the driver but whether a frontier is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import DEFAULT_CONFIDENCE, Graph, related, trusted
from graphloom.lineage import Rounds, cut

REACHED = "seed string, id string, hop int, parent string, via string"


def reach(steps: DataFrame, seeds: DataFrame, most: int | None = None, stop_at: str | None = None) -> DataFrame:
    """(seed, id, hop, parent, via) of everything that steps(at, to, via, ord) lead to, seeds included with hop 0.

    Each id has the hop at which it is first met, and the parent and relation of the first edge (by ord) that led there.
    The steps are written once, filters and all; a level is then one join of the last level with them and one write.
    """
    spark, steps = steps.sparkSession, cut(steps.select("at", "to", "via", "ord"), "steps")
    found, nothing = Rounds(spark, REACHED), F.lit(None).cast("string")
    found.add(seeds.select("seed", F.col("seed").alias("id"), F.lit(0).alias("hop"), nothing.alias("parent"), nothing.alias("via")).distinct())
    hop = 0
    while most is None or hop < most:
        hop += 1
        met = found.last().select("seed", F.col("id").alias("at")).join(steps, "at").groupBy("seed", F.col("to").alias("id")).agg(F.min(F.struct("ord", "at", "via")).alias("x"))
        new = met.join(found.all().select("seed", "id"), ["seed", "id"], "left_anti")
        if not found.add(new.select("seed", "id", F.lit(hop).alias("hop"), F.col("x.at").alias("parent"), F.col("x.via").alias("via"))):
            break
        if stop_at is not None and not found.last().where(F.col("id") == stop_at).isEmpty():
            break
    return found.all()


def closure(steps: DataFrame, starts: DataFrame) -> DataFrame:
    """(id) of all that steps(at, to) lead to from any of the starts, these included. Each id is walked from once, however many
    starts lead to it."""
    found = Rounds(steps.sparkSession, "id string")
    steps = cut(steps.select("at", "to").distinct(), "steps")
    found.add(starts.select("id").distinct())
    while True:
        met = steps.join(found.last().select(F.col("id").alias("at")), "at", "left_semi").select(F.col("to").alias("id")).distinct()
        if not found.add(met.join(found.all(), "id", "left_anti")):
            return found.all()


def walk_back(met: DataFrame, end: str) -> DataFrame:
    """(position, id) from the seed of what reach() found to end; empty if end was not reached. One join for each hop, on the
    driver's side of it nothing but the hop of end."""
    spark = met.sparkSession
    top = met.where(F.col("id") == end).agg(F.min("hop")).first()[0]
    rows = Rounds(spark, "position int, id string, parent string")
    if top is None:
        return spark.createDataFrame([], "position int, id string")
    rows.add(met.where((F.col("id") == end) & (F.col("hop") == top)).select(F.col("hop").alias("position"), "id", "parent"))
    for hop in range(top - 1, -1, -1):
        up = rows.last().select(F.col("parent").alias("id"))
        rows.add(met.where(F.col("hop") == hop).join(F.broadcast(up), "id", "left_semi").select(F.col("hop").alias("position"), "id", "parent"))  # up has one row
    return rows.all().select("position", "id")


def steps_of(edges: DataFrame, direction: str) -> DataFrame:
    out = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), F.col("relation").alias("via"), "ord")
    back = edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), F.col("relation").alias("via"), "ord")
    return {"out": out, "in": back}.get(direction) if direction != "both" else out.unionByName(back)


def seed_frame(g: Graph, *ids: str) -> DataFrame:
    return g.nodes.sparkSession.createDataFrame([(i,) for i in ids], "seed string")


def _eligible(g: Graph, relations, minimum) -> DataFrame:
    return g.edges.where(related(relations) & trusted(minimum))


def impact(g: Graph, node: str, relations=None, minimum: float | None = DEFAULT_CONFIDENCE) -> DataFrame:
    """Existing nodes that lead to node, without node itself; ids that have no node are walked through."""
    met = reach(steps_of(_eligible(g, relations, minimum), "in"), seed_frame(g, node)).where(F.col("id") != node)
    return g.nodes.join(met.select("id", "hop"), "id")


def hidden_edges(g: Graph, node: str, relations=None, minimum: float = DEFAULT_CONFIDENCE, direction: str = "in") -> DataFrame:
    """How many edges of the relations into (or out of) what was visited are below the confidence."""
    met = reach(steps_of(_eligible(g, relations, minimum), direction), seed_frame(g, node)).select("id")
    low = g.edges.where(related(relations) & ~trusted(minimum))
    end = "dst" if direction == "in" else "src"
    return low.join(met.withColumnRenamed("id", end), end, "left_semi").agg(F.count(F.lit(1)).alias("hidden"))


def deps(g: Graph, node: str, transitive: bool = True, relations=None, minimum: float | None = DEFAULT_CONFIDENCE) -> DataFrame:
    """Existing nodes that node leads to. One hop keeps node itself if it has a self-loop; the closure never does."""
    edges = _eligible(g, relations, minimum)
    if transitive:
        met = reach(steps_of(edges, "out"), seed_frame(g, node)).where(F.col("id") != node).select("id", "hop")
    else:
        met = edges.where(F.col("src") == node).select(F.col("dst").alias("id"), F.lit(1).alias("hop")).distinct()
    return g.nodes.join(met, "id")


def path(g: Graph, start: str, end: str) -> DataFrame:
    """(position, id) of a shortest path by any relation in any direction; ties go to the first edge; empty if there is none."""
    spark = g.nodes.sparkSession
    if start == end:
        return spark.createDataFrame([(0, start)], "position int, id string")
    return walk_back(reach(steps_of(g.edges, "both"), seed_frame(g, start), stop_at=end), end)


def would_create_cycle(g: Graph, start: str, end: str) -> bool:
    """Whether a depends_on edge from start to end would close a cycle."""
    if start == end:
        return True
    met = reach(steps_of(g.edges.where("relation = 'depends_on'"), "out"), seed_frame(g, end), stop_at=start)
    return not met.where(F.col("id") == start).isEmpty()


def neighbors(g: Graph, node: str, depth: int, direction: str = "both") -> DataFrame:
    """Existing nodes within min(depth, 10) hops, node itself included."""
    met = reach(steps_of(g.edges, direction), seed_frame(g, node), most=min(depth, 10))
    return g.nodes.join(met.select("id", "hop"), "id")


def common_cause(g: Graph, a: str, b: str) -> DataFrame:
    """What both lead to, by any relation and without a confidence gate."""
    met = reach(steps_of(g.edges, "out"), seed_frame(g, a, b)).where("id <> seed")
    both = met.groupBy("id").agg(F.countDistinct("seed").alias("n")).where("n = 2").select("id")
    return g.nodes.join(both, "id", "left_semi")


def callers(g: Graph, node: str) -> DataFrame:
    """One row for each calls edge into node whose caller exists."""
    e = g.edges.where((F.col("dst") == node) & (F.col("relation") == "calls"))
    return e.select(F.col("src").alias("id"), "confidence", "call_count").join(g.nodes, "id")


def callees(g: Graph, node: str) -> DataFrame:
    e = g.edges.where((F.col("src") == node) & (F.col("relation") == "calls"))
    return e.select(F.col("dst").alias("id"), "confidence", "call_count").join(g.nodes, "id")


def impact_of_many(g: Graph, seeds: DataFrame, relations=None, minimum: float | None = DEFAULT_CONFIDENCE) -> DataFrame:
    """(seed, id, hop): the impact of each seed, all in one loop."""
    return reach(steps_of(_eligible(g, relations, minimum), "in"), seeds.select(F.col("id").alias("seed"))).where("hop > 0").select("seed", "id", "hop")


def bounded_path(g: Graph, start: str, end: str, most: int) -> DataFrame:
    """(position, id) of a directed path of at most `most` edges."""
    return walk_back(reach(steps_of(g.edges, "out"), seed_frame(g, start), most=most, stop_at=end), end)


def upstream_findings(g: Graph, node: str) -> DataFrame:
    """(key, value) of the findings of node and of what leads to it; the nearest wins, then the first inserted."""
    met = reach(steps_of(g.edges, "in"), seed_frame(g, node))
    own = g.nodes.join(met.select("id", "hop"), "id").select("hop", "ord", F.explode("knowledge.findings").alias("key", "value"))
    return own.groupBy("key").agg(F.min_by("value", F.struct("hop", "ord")).alias("value"))


def inheritance_chain(g: Graph, node: str, most: int = 10) -> DataFrame:
    """(position, id): the first inherits edge of each, followed at most `most` times."""
    first = g.edges.where("relation = 'inherits'").groupBy(F.col("src").alias("at")).agg(F.min_by("dst", "ord").alias("id"))
    first = cut(first, "inherits")
    rows = Rounds(g.nodes.sparkSession, "position int, id string")
    rows.add(seed_frame(g, node).select(F.lit(0).alias("position"), F.col("seed").alias("id")))
    for k in range(most):
        last = rows.last().select(F.col("id").alias("at"))
        if not rows.add(first.join(F.broadcast(last), "at").select(F.lit(k + 1).alias("position"), "id")):  # one row
            break
    return rows.all().where("position > 0")


def dependents(g: Graph, node: str, relations=None) -> DataFrame:
    """(id, times): existing nodes that lead to node over existing ones, and how often: once for each edge of theirs into what
    was walked, node itself included, so one of a cycle is its own dependent. Ends that are no nodes are not walked on from."""
    e = g.edges.where(related(relations)).join(g.nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
    e = cut(e, "edges")
    walked = closure(e.select(F.col("dst").alias("at"), F.col("src").alias("to")), seed_frame(g, node).select(F.col("seed").alias("id")))
    return e.join(walked.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("times"))


def path_counts(g: Graph, node: str) -> DataFrame:
    """(id, times): of every node that leads to node, the number of ways there, parallel edges counted each; node itself once.

    Nodes on a cycle, and those that lead to node only over one or also over one, have no finite number: times is null. The
    ways are summed level by level from node on, not walked one by one.
    """
    from graphloom.operators.schedule import levels

    e = g.edges.where(F.col("src") != node).select("src", "dst")
    ids = cut(closure(e.select(F.col("dst").alias("at"), F.col("src").alias("to")), seed_frame(g, node).select(F.col("seed").alias("id"))), "upstream")
    inside = cut(e.join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n")), "inside")
    level = cut(levels(ids, inside), "levels")
    placed = cut(inside.join(level.where("level is not null").withColumnRenamed("id", "src"), "src"), "placed")
    found, k = Rounds(g.nodes.sparkSession, "id string, times decimal(38,0)"), 1
    found.add(seed_frame(g, node).select(F.col("seed").alias("id"), F.lit(1).cast("decimal(38,0)").alias("times")))
    while found.add(
        placed.where(F.col("level") == k).join(found.all().withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum(F.col("times") * F.col("n")).cast("decimal(38,0)").alias("times"))
    ):
        k += 1
    return ids.join(found.all(), "id", "left").select("id", "times")
