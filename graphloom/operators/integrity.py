"""Integrity: orphans, missing ends, duplicates, cycles, and the plan that repairs them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.lineage import Rounds, cut
from graphloom.operators.scans import first_by_order

CODE_LIKE = ("file", "function", "class", "module", "method", "trait", "enum", "constant", "test", "impl", "code")


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def orphan_nodes(g: Graph) -> DataFrame:
    """Nodes in no edge; a self-loop counts as an edge."""
    return g.nodes.join(endpoints(g.edges), "id", "left_anti")


def missing_refs(g: Graph) -> DataFrame:
    """One row for each missing end of each edge."""
    ids = g.nodes.select("id").distinct()
    ends = g.edges.select("src", "dst", "relation", "ord", F.explode(F.array(F.struct(F.lit("src").alias("side"), F.col("src").alias("id")), F.struct(F.lit("dst").alias("side"), F.col("dst").alias("id")))).alias("x"))
    return ends.select("src", "dst", "relation", "ord", F.col("x.side").alias("side"), F.col("x.id").alias("id")).join(ids, "id", "left_anti").withColumnRenamed("id", "missing")


def duplicate_nodes(g: Graph) -> DataFrame:
    """One row for each occurrence of an id after the first."""
    return g.nodes.withColumn("copy", F.row_number().over(Window.partitionBy("id").orderBy("ord")) - 1).where("copy > 0").select("id", "ord", "copy")


def duplicate_edges(g: Graph) -> DataFrame:
    return g.edges.withColumn("copy", F.row_number().over(Window.partitionBy("src", "dst", "relation").orderBy("ord")) - 1).where("copy > 0").select("src", "dst", "relation", "ord", "copy")


def self_edges(g: Graph) -> DataFrame:
    return g.edges.where("src = dst")


def back_edges(g: Graph, relations=("depends_on",)) -> DataFrame:
    """(component, src, dst, relation): edges without which there are no cycles, self-loops included; each is on a cycle.

    Of each strongly connected component the nodes are ordered by their distance from the smallest id within it, then by id;
    the edges inside that do not lead forward in this order are listed.
    """
    e = cut(g.edges.where(F.col("relation").isin(*relations)).select("src", "dst", "relation"), "edges")
    members = cut(_components_of(e).select("component", "id"), "members")
    # a component is named after its smallest id
    inside = e.where("src <> dst").join(members.select(F.col("component").alias("from"), F.col("id").alias("src")), "src").join(members.select(F.col("component").alias("from"), F.col("id").alias("dst")), ["from", "dst"])
    inside = cut(inside.select("from", "src", "dst", "relation"), "inside")
    # a node is in one component alone, so edges that lead to what was met are dropped, and each round has fewer
    hops, hop = Rounds(g.nodes.sparkSession, "id string, hop int"), 0
    hops.add(members.select(F.col("component").alias("id"), F.lit(0).alias("hop")).distinct())
    left = inside.select("src", "dst").distinct()
    while hops.rows:
        left, hop = cut(left.join(hops.last().select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"), "left"), hop + 1
        hops.add(left.join(hops.last().select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"), F.lit(hop).alias("hop")).distinct())
    hops = hops.all()
    placed = inside.join(hops.withColumnsRenamed({"id": "src", "hop": "a"}), "src").join(hops.withColumnsRenamed({"id": "dst", "hop": "b"}), "dst")
    back = placed.where((F.col("b") < F.col("a")) | ((F.col("b") == F.col("a")) & (F.col("dst") <= F.col("src")))).select(F.col("from").alias("component"), "src", "dst", "relation")
    return back.unionByName(e.where("src = dst").select(F.col("src").alias("component"), "src", "dst", "relation")).distinct()


def cycles(g: Graph, relations=("depends_on",)) -> DataFrame:
    """(component, id) of strongly connected components of two nodes or more; self-loops alone are none."""
    return _components_of(g.edges.where(F.col("relation").isin(list(relations))))


def _joined(pairs: DataFrame) -> DataFrame:
    """(id, group) of the ends of pairs(a, b), there in both directions: the smallest id that they lead to.

    Each id points to the smallest id around it and pointers double to their ends; then the groups so made point to the smallest
    group around them, and so on. A way of n nodes takes some log n rounds.
    """
    group = cut(pairs.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("low")).select("id", F.least("id", "low").alias("group")), "groups")
    while True:
        while True:
            on = group.select(F.col("id").alias("group"), F.col("group").alias("next"))
            moved = cut(group.join(on, "group").select("id", "next", F.col("group").alias("old")), "moved")
            group = moved.select("id", F.col("next").alias("group"))
            if moved.where("next <> old").isEmpty():
                break
        ends = pairs.join(group.select(F.col("id").alias("a"), F.col("group").alias("mine")), "a").join(group.select(F.col("id").alias("b"), F.col("group").alias("other")), "b")
        lower = cut(ends.where("other < mine").groupBy(F.col("mine").alias("id")).agg(F.min("other").alias("low")), "lower")
        if lower.isEmpty():
            return group
        group = cut(group.join(lower, "id", "left").select("id", F.coalesce("low", "group").alias("group")), "groups")


def _components_of(every: DataFrame) -> DataFrame:
    """(component, id) of the strongly connected components of every(src, dst), the component being its smallest id.

    Nodes that lead to each other directly are one from the start. Of these, nodes without a predecessor or successor left are
    trimmed until none is left; then every node takes the largest node that reaches it as its colour, and the nodes of a colour that
    its root can be reached from are a component. No component has two colours, so edges between colours go.
    """
    whole = cut(every.where("src <> dst").select("src", "dst").distinct(), "edges")
    # ends that nothing leads to, or that lead nowhere, are on no cycle
    whole = cut(whole.join(whole.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(whole.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"), "edges")
    back = whole.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    group = _joined(cut(whole.join(back, ["src", "dst"], "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("b")), "mutual"))
    edges = whole.join(group.select(F.col("id").alias("src"), F.col("group").alias("a")), "src", "left").join(group.select(F.col("id").alias("dst"), F.col("group").alias("b")), "dst", "left")
    edges = cut(edges.select(F.coalesce("a", "src").alias("src"), F.coalesce("b", "dst").alias("dst")).where("src <> dst").distinct(), "edges")
    found = None

    def trim(e: DataFrame) -> DataFrame:
        n = e.count()
        while n:
            e2 = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst")
            e2 = cut(e2, "trimmed")
            m = e2.count()
            if m == n:
                break
            e, n = e2, m
        return e if n else e.limit(0)

    edges = trim(edges)
    while not edges.isEmpty():
        colour = endpoints(edges).withColumn("colour", F.col("id"))
        state = None
        while True:
            incoming = edges.join(colour.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.max("colour").alias("best"))
            colour = cut(colour.join(incoming, "id", "left").select("id", F.greatest("colour", F.coalesce("best", "colour")).alias("colour")), "colour")
            now = colour.agg(F.sum(F.xxhash64("id", "colour").cast("decimal(38,0)"))).first()
            if now == state:
                break
            state = now
        # backwards from each root within its colour
        inner = edges.join(colour.withColumnRenamed("id", "src"), "src").join(colour.select(F.col("id").alias("dst"), F.col("colour").alias("colour2")), "dst").where("colour = colour2").select("src", "dst", "colour")
        member = cut(colour.where("id = colour"), "member")
        frontier = member
        while not frontier.isEmpty():
            reached = inner.join(frontier.select(F.col("id").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("id"), "colour").distinct()
            frontier = cut(reached.join(member, ["id", "colour"], "left_anti"), "frontier")
            member = cut(member.unionByName(frontier), "member")
        found = member if found is None else found.unionByName(member)
        done = member.select("id")
        edges = trim(cut(inner.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti").select("src", "dst"), "rest"))
    members = group.select("id", F.col("group").alias("colour"))
    if found is not None:
        found = found.select("id", "colour")
        alone = found.join(group.select(F.col("group").alias("id")), "id", "left_anti")  # in no group
        members = members.join(found.select(F.col("id").alias("colour"), F.col("colour").alias("over")), "colour", "left").select("id", F.coalesce("over", "colour").alias("colour")).unionByName(alone)
    sizes = members.groupBy("colour").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("component")).where("n > 1")
    return members.join(sizes, "colour").select("component", "id")


def repair(g: Graph, orphans: bool = True) -> tuple[Graph, DataFrame]:
    """The repaired graph, and one row for each finding (kind, what, applied).

    In order: duplicate nodes and edges keep the first; self-edges and edges with a missing end go; then nodes in no
    edge go if they are code, others are only reported.
    """
    nodes = first_by_order(g.nodes, ["id"])
    unique = first_by_order(g.edges, ["src", "dst", "relation"]).where("src <> dst")
    ids = nodes.select("id")
    edges = unique.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(g.edges.columns)
    lonely = nodes.join(endpoints(edges), "id", "left_anti")
    code = F.coalesce(F.col("node_type").isin(list(CODE_LIKE)), F.lit(False))
    edge_name = F.concat_ws(" ", "src", "relation", "dst")
    plan = (
        duplicate_nodes(g).select(F.lit("duplicate_node").alias("kind"), F.col("id").alias("what"), F.lit(True).alias("applied"))
        .unionByName(duplicate_edges(g).select(F.lit("duplicate_edge").alias("kind"), edge_name.alias("what"), F.lit(True).alias("applied")))
        .unionByName(self_edges(g).select(F.lit("self_edge").alias("kind"), edge_name.alias("what"), F.lit(True).alias("applied")))
        .unionByName(unique.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").unionByName(unique.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_anti"), allowMissingColumns=True).select(F.lit("orphan_edge").alias("kind"), edge_name.alias("what"), F.lit(True).alias("applied")))
        .unionByName(lonely.select(F.lit("orphan_node").alias("kind"), F.col("id").alias("what"), code.alias("applied")))
    )
    kept = nodes.join(lonely.where(code).select("id"), "id", "left_anti").select(g.nodes.columns) if orphans else nodes
    return Graph(kept, edges, g.project), plan
