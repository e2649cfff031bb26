"""An ordered log of operations on a graph, folded by key: the result is that of the operations one after another.

operations: seq (unique, ascending), op, and by op
  put_node id, node (a struct with the columns of nodes): replaces the whole node, its edges stay;
  delete_node id: the node goes, and every edge at it that is there at that time;
  add_edge src, dst, relation, edge (a struct with the columns of edges): one more edge, even beside an equal one;
  remove_edge src, dst, relation: all edges of the triple that are there at that time;
  set_tags id, tags; set_metadata id, metadata; set_knowledge id, knowledge: the node must be there at that time.

Nothing runs in the order of the log: of each node the last operation of each kind decides, of each edge whether a removal or a
deletion of one of its ends came after it. A set operation on a missing node refuses the whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.lineage import cut

OPERATIONS = ("put_node", "delete_node", "add_edge", "remove_edge", "set_tags", "set_metadata", "set_knowledge")
SETTERS = {"set_tags": "tags", "set_metadata": "metadata", "set_knowledge": "knowledge"}


def refused(g: Graph, operations: DataFrame) -> DataFrame:
    """(seq, op, id, why): unknown operations, and set operations on a node that is not there at that time."""
    unknown = operations.where(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False))).select("seq", "op", "id", F.lit("unknown operation").alias("why"))
    about = operations.where(F.col("op").isin("put_node", "delete_node", *SETTERS)).select("seq", "op", "id")
    before = Window.partitionBy("id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("op").isin("put_node", "delete_node"), F.col("op")), ignorenulls=True).over(before)
    timed = about.withColumn("last", last).where(F.col("op").isin(*SETTERS) & (F.col("last").isNull() | (F.col("last") == "delete_node")))
    missing = timed.where("last = 'delete_node'").unionByName(timed.where("last is null").join(g.nodes.select("id"), "id", "left_anti").select(timed.columns))
    return unknown.unionByName(missing.select("seq", "op", "id", F.lit("no such node").alias("why")))


def apply_log(g: Graph, operations: DataFrame) -> Graph:
    """g after a log of operations; ValueError if an operation is refused."""
    operations = cut(operations, "operations")
    if bad := refused(g, operations).orderBy("seq").first():
        raise ValueError(f"operation {bad['seq']} ({bad['op']} {bad['id']}): {bad['why']}")
    of = lambda op: F.when(F.col("op") == op, F.col("seq"))
    setters = {op: c for op, c in SETTERS.items() if c in g.nodes.columns and c in operations.columns}
    last = operations.where(F.col("op").isin("put_node", "delete_node", *setters)).groupBy("id").agg(
        F.max(of("put_node")).alias("put_at"), F.max(of("delete_node")).alias("gone_at"), F.max_by("node", of("put_node")).alias("put"),
        *[F.max(of(op)).alias(f"{op}_at") for op in setters], *[F.max_by(c, of(op)).alias(f"new_{c}") for op, c in setters.items()],
    )
    never = F.lit(-1).cast("long")
    reset = F.greatest(F.coalesce("put_at", never), F.coalesce("gone_at", never))

    def with_sets(df: DataFrame, value) -> DataFrame:
        """The columns of nodes, with what was set since the last put or deletion."""
        new = {c: F.when(F.coalesce(f"{op}_at", never) > reset, F.col(f"new_{c}")) for op, c in setters.items()}
        at = {c: f"{op}_at" for op, c in setters.items()}
        return df.select(*[(F.when(F.coalesce(at[c], never) > reset, new[c]).otherwise(value(c)) if c in new else value(c)).cast(g.nodes.schema[c].dataType.simpleString()).alias(c) for c in g.nodes.columns])

    old = g.nodes.withColumnsRenamed({c: f"old_{c}" for c in g.nodes.columns if c != "id"}).join(last, "id", "left")
    stay = with_sets(old.where("put_at is null and gone_at is null"), lambda c: F.col(c if c == "id" else f"old_{c}"))
    put = with_sets(last.where("put_at is not null and put_at > coalesce(gone_at, -1)"), lambda c: F.col("id") if c == "id" else F.col("put")[c])

    ends = {"src", "dst", "relation"}
    added = operations.where("op = 'add_edge'").select("seq", *[(F.col(c) if c in ends else F.col("edge")[c]).cast(g.edges.schema[c].dataType.simpleString()).alias(c) for c in g.edges.columns])
    every = g.edges.withColumn("seq", never).unionByName(added)
    removed = operations.where("op = 'remove_edge'").groupBy("src", "dst", "relation").agg(F.max("seq").alias("removed_at"))
    gone = operations.where("op = 'delete_node'").groupBy("id").agg(F.max("seq").alias("gone_at"))
    every = every.join(removed, ["src", "dst", "relation"], "left")
    for end in ("src", "dst"):
        every = every.join(gone.withColumnsRenamed({"id": end, "gone_at": f"{end}_gone"}), end, "left")
    after = F.greatest(F.coalesce("removed_at", F.lit(-2)), F.coalesce("src_gone", F.lit(-2)), F.coalesce("dst_gone", F.lit(-2)))
    return Graph(stay.unionByName(put), every.where(F.col("seq") > after).select(g.edges.columns), g.project)
