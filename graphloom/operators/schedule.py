"""Scheduling: ready tasks, layers, critical path, topological order, chain depths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, layer_of
from graphloom.lineage import Rounds, cut

DONE = ("done", "cancelled")


def depends_on(g: Graph) -> DataFrame:
    return g.edges.where("relation = 'depends_on'").select("src", "dst", "ord")


def ready_tasks(g: Graph) -> DataFrame:
    """Project nodes that are todo and whose dependencies are done or missing."""
    open_ = g.nodes.where("status <> 'done'").select(F.col("id").alias("dst")).distinct()
    waiting = depends_on(g).join(open_, "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    return g.nodes.where((F.col("status") == "todo") & (layer_of(F.col("source")) == "project")).join(waiting, "id", "left_anti")


def newly_ready(g: Graph, completed: str) -> DataFrame:
    """Tasks that become ready when one is done."""
    after = g.with_nodes(g.nodes.withColumn("status", F.when(F.col("id") == completed, "done").otherwise(F.col("status"))))
    return ready_tasks(after).join(ready_tasks(g).select("id"), "id", "left_anti")


def topological_ranks(g: Graph) -> DataFrame:
    """(id, rank) by depends_on, dependencies first; rank null where a cycle, a self-loop or a missing end keeps a node back."""
    return levels(g.nodes.select("id"), depends_on(g)).withColumnRenamed("level", "rank")


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, level) of nodes(id): 0 without edges (src, dst), else one more than the highest level that its edges lead to; null
    where they lead into a cycle, a self-loop or an end that is no node.

    A node with one edge follows from the end of the way that such nodes make: pointers double, so ways of n nodes
    take log n rounds. Nodes with more edges are then placed round by round among themselves alone.
    """
    nodes, edges = cut(nodes.select("id").distinct(), "nodes"), cut(edges.select("src", "dst").distinct(), "edges")
    out = cut(nodes.join(edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("dst").alias("to")), "id", "left").fillna(0, ["n"]), "out")
    single = out.where("n = 1").select("id").withColumn("single", F.lit(True))
    # (id, to, far, done): the place `far` edges on; done where that is no node with one edge
    ways = cut(out.where("n = 1").select("id", "to").join(single.withColumnRenamed("id", "to"), "to", "left").select("id", "to", F.lit(1).alias("far"), F.col("single").isNull().alias("done")), "ways")
    n_done = ways.where("done").count()
    while True:
        on = ways.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("far").alias("far2"), F.col("done").alias("done2"))
        moved = ways.where("not done").join(on, "to").select("id", F.col("to2").alias("to"), (F.col("far") + F.col("far2")).alias("far"), F.col("done2").alias("done"))
        ways, before = cut(ways.where("done").unionByName(moved), "ways"), n_done
        n_done = ways.where("done").count()
        if n_done == before:  # the others go round in circles
            break
    # edges of nodes with several, led to where ways end: a node with none, one with several, or nothing (null)
    ends = out.where("n <> 1").select(F.col("id").alias("end"), (F.col("n") > 0).alias("inner"))
    jump = ways.select(F.col("id").alias("dst"), F.when(F.col("done"), F.col("to")).alias("to"), "far")
    several = edges.join(out.where("n > 1").select(F.col("id").alias("src")), "src", "left_semi").join(jump, "dst", "left")
    several = several.select("src", F.when(F.col("far").isNull(), F.col("dst")).otherwise(F.col("to")).alias("end"), (F.coalesce("far", F.lit(0)) + 1).alias("far")).join(ends, "end", "left")
    several = cut(several.groupBy("src", "end", "inner").agg(F.max("far").alias("far")), "several")
    held = several.groupBy("src").agg(F.max(F.when(~F.col("inner"), F.col("far"))).alias("least"), F.bool_or(F.col("inner").isNull()).alias("never"), F.bool_or(F.coalesce("inner", F.lit(False))).alias("waits"))
    held = cut(held.where("not never").select(F.col("src").alias("id"), F.coalesce("least", F.lit(0)).alias("least"), "waits"), "held")
    placed = Rounds(nodes.sparkSession, "id string, level int")
    left = cut(several.where("inner").join(held.where("waits").select(F.col("id").alias("src"), "least"), "src").select("src", "end", "far", "least"), "left")
    placed.add(held.where("not waits").select("id", F.col("least").alias("level")))
    while True:
        done = placed.all().withColumnRenamed("id", "end")
        ready = left.join(done, "end", "left").groupBy("src").agg(F.count_if(F.col("level").isNull()).alias("open"), F.max(F.greatest("least", F.col("level") + F.col("far"))).alias("level")).where("open = 0")
        if not placed.add(ready.select(F.col("src").alias("id"), "level").join(placed.all(), "id", "left_anti").select("id", F.col("level").cast("int").alias("level"))):
            break
    known = out.where("n = 0").select("id", F.lit(0).alias("level")).unionByName(placed.all())
    known = known.unionByName(ways.where("done").select("id", F.col("to").alias("end"), "far").join(known.withColumnRenamed("id", "end"), "end").select("id", (F.col("level") + F.col("far")).alias("level")))
    return nodes.join(known, "id", "left").select("id", F.col("level").cast("int").alias("level"))


def open_tasks(g: Graph) -> DataFrame:
    return g.nodes.where((F.col("node_type") == "task") & ~F.col("status").isin(*DONE))


def execution_layers(g: Graph, strict: bool = False) -> DataFrame:
    """(id, layer) of the open tasks; layer null for tasks that are kept back.

    The first layer asks only for dependencies among the open tasks; later layers ask that every dependency is placed,
    done or missing, so that an unfinished node that is no task holds a task back. strict applies the first rule throughout.
    """
    tasks = cut(open_tasks(g).select("id").distinct(), "tasks")
    deps = depends_on(g).select("src", "dst").join(tasks.select(F.col("id").alias("src")), "src", "left_semi")
    inside = cut(deps.join(tasks.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst"), "inside")
    if strict:
        return levels(tasks, inside).withColumnRenamed("level", "layer")
    unfinished = g.nodes.where("status <> 'done'").select(F.col("id").alias("dst")).distinct()
    # a task without dependencies among the open tasks is in the first layer whatever else it waits for
    waiting = deps.join(unfinished, "dst", "left_semi").join(inside.select("src"), "src", "left_semi").select("src", "dst")
    return levels(tasks, waiting).withColumnRenamed("level", "layer")


def chain_depths(g: Graph) -> DataFrame:
    """(id, depth): the longest chain of depends_on edges below each node; null for nodes that lead into a cycle."""
    nodes = g.nodes.select("id").distinct()
    edges = cut(depends_on(g).where("src <> dst").select("src", "dst").distinct(), "edges")
    every = nodes.unionByName(edges.select(F.col("dst").alias("id"))).distinct()  # ends that are no nodes have depth 0
    return levels(every, edges).withColumnRenamed("level", "depth").join(nodes, "id", "left_semi")


def critical_path(g: Graph) -> DataFrame:
    """(position, id) of the longest chain of open tasks, dependencies first; equal lengths go to the smallest ids."""
    tasks = open_tasks(g)
    sub = Graph(tasks, depends_on(g).withColumn("relation", F.lit("depends_on")).join(tasks.select(F.col("id").alias("src")), "src", "left_semi").join(tasks.select(F.col("id").alias("dst")), "dst", "left_semi"))
    depth = cut(chain_depths(sub).where("depth is not null"), "depth")
    spark = g.nodes.sparkSession
    top = depth.orderBy(F.desc("depth"), "id").first()
    if top is None:
        return spark.createDataFrame([], "position int, id string")
    steps = cut(sub.edges.select("src", "dst").distinct().join(depth.select(F.col("id").alias("dst"), "depth"), "dst"), "steps")
    rows = Rounds(spark, "position int, id string")
    rows.add(spark.createDataFrame([(top["depth"], top["id"])], "position int, id string"))
    for d in range(top["depth"] - 1, -1, -1):
        at = rows.last().select(F.col("id").alias("src"))  # one row
        rows.add(steps.where(F.col("depth") == d).join(F.broadcast(at), "src").agg(F.min("dst").alias("id")).select(F.lit(d).alias("position"), "id"))
    return rows.all()


def orphan_tasks(g: Graph) -> DataFrame:
    """Tasks in no depends_on edge that implement nothing."""
    used = depends_on(g).select(F.col("src").alias("id")).union(depends_on(g).select(F.col("dst").alias("id"))).union(g.edges.where("relation = 'implements'").select(F.col("src").alias("id")))
    return g.nodes.where("node_type = 'task'").join(used.distinct(), "id", "left_anti")
