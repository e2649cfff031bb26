"""Mutations: each returns a new graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import slugify
from graphloom.graph import Graph
from graphloom.operators.scans import first_by_order, infer_node_type

STATUS_RANK = ("todo", "in_progress", "done")


def _row(df: DataFrame, values: dict) -> DataFrame:
    """One row in the shape of df."""
    one = df.sparkSession.range(1)
    return one.select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])


def add_node(g: Graph, **values) -> Graph:
    """A node, unless its id exists; its type is told by the id if not given."""
    new = _row(g.nodes, values)
    new = new.withColumn("node_type", F.coalesce("node_type", infer_node_type(F.col("id")))).withColumn("status", F.coalesce("status", F.lit("todo")))
    return g.with_nodes(g.nodes.unionByName(new.join(g.nodes.where(F.col("id") == values["id"]).select("id"), "id", "left_anti").select(g.nodes.columns)))


def remove_node(g: Graph, node_id: str) -> Graph:
    """The first node of that id, and every edge at it."""
    first = g.nodes.where(F.col("id") == node_id).agg(F.min("ord").alias("ord"))
    nodes = g.nodes.join(F.broadcast(first), "ord", "left_anti").select(g.nodes.columns)
    return Graph(nodes, g.edges.where((F.col("src") != node_id) & (F.col("dst") != node_id)), g.project)


def add_edge(g: Graph, **values) -> Graph:
    """An edge, unless its triple exists."""
    new = _row(g.edges, {"relation": "depends_on", "call_count": 1, "in_error_path": False} | values)
    same = g.edges.where((F.col("src") == values["src"]) & (F.col("dst") == values["dst"]) & (F.col("relation") == values.get("relation", "depends_on")))
    return g.with_edges(g.edges.unionByName(new.join(same.select("src"), "src", "left_anti").select(g.edges.columns)))


def remove_edge(g: Graph, src: str, dst: str, relation: str | None = None) -> Graph:
    """All edges of a pair, or those of one relation."""
    hit = (F.col("src") == src) & (F.col("dst") == dst)
    return g.with_edges(g.edges.where(~(hit if relation is None else hit & (F.col("relation") == relation))))


def update_status(g: Graph, node_id: str, status: str) -> Graph:
    return g.with_nodes(g.nodes.withColumn("status", F.when(F.col("id") == node_id, F.lit(status)).otherwise(F.col("status"))))


def upsert_nodes(g: Graph, nodes: DataFrame) -> Graph:
    """Nodes by id: new ones replace old ones."""
    return g.with_nodes(g.nodes.join(nodes.select("id"), "id", "left_anti").select(g.nodes.columns).unionByName(nodes))


def rename(g: Graph, old: str, new: str) -> Graph:
    """A new id for a node, on its edges too; it must be free."""
    if not g.nodes.where(F.col("id") == new).isEmpty():
        raise ValueError(f"{new} exists")
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    return Graph(g.nodes.withColumn("id", swap("id")), g.edges.withColumn("src", swap("src")).withColumn("dst", swap("dst")), g.project)


def _retarget(edges: DataFrame, table: DataFrame) -> DataFrame:
    """Edges with ends replaced by a small table (old, new), first of each triple, no self-loops."""
    e = edges
    for c in ("src", "dst"):
        e = e.join(F.broadcast(table.select(F.col("old").alias(c), F.col("new").alias("_new"))), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
    return first_by_order(e.where("src <> dst"), ["src", "dst", "relation"]).select(edges.columns)


def merge(g: Graph, a: str, b: str, new_id: str) -> Graph:
    """Two nodes as one: titles joined, descriptions as two paragraphs, tags united in order, the better status, edges moved.

    All else of the new node has its default; its type is told by the id. The graph stays as it is if one of the two is not
    there. As in the original, a new id that is one of the two makes the node vanish, and a node that has it already stays.
    """
    first = g.nodes.where(F.col("id").isin(a, b)).groupBy("id").agg(F.min_by(F.struct(*g.nodes.columns), "ord").alias("x")).select("x.*")
    has = set(g.nodes.columns)
    text = F.col("description") if "description" in has else F.lit(None).cast("string")
    tags = F.coalesce("tags", F.array().cast("array<string>")) if "tags" in has else F.array().cast("array<string>")
    # two rows at most
    pair = first.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct((F.col("id") != a).alias("k"), "title", text.alias("text"), "status", tags.alias("tags"), "ord"))).alias("p")).where("n = 2")
    status = F.col("p")["status"]
    made = pair.select(
        F.concat_ws(" + ", F.col("p")["title"]).alias("title"),
        F.when(F.size(F.filter(F.col("p")["text"], lambda x: x.isNotNull())) > 0, F.concat_ws("\n\n", F.col("p")["text"])).alias("description"),
        F.array_sort(F.array_distinct(F.flatten(F.col("p")["tags"]))).alias("tags"),
        F.when(F.array_contains(status, "done"), "done").when(F.array_contains(status, "in_progress"), "in_progress").otherwise(status[0]).alias("status"),
        F.array_min(F.col("p")["ord"]).alias("ord"), F.lit(new_id).alias("id"),
    ).withColumn("node_type", infer_node_type(F.col("id")))
    made = made.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in made.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in g.nodes.schema])
    if first.count() < 2:
        return g
    taken = g.nodes.where(F.col("id") == new_id).select("id")
    nodes = g.nodes.unionByName(made.join(taken, "id", "left_anti").select(g.nodes.columns))
    table = g.nodes.sparkSession.createDataFrame([(a, new_id), (b, new_id)], "old string, new string")
    edges = _retarget(g.edges, table)
    # as after a removal: rows of the two ids go, and edges that still lead to them
    return Graph(nodes.where(~F.col("id").isin(a, b)), edges.where(~F.col("src").isin(a, b) & ~F.col("dst").isin(a, b)), g.project)


def split(g: Graph, node_id: str, parts: list[str]) -> Graph:
    """A node as several; all its edges go to the first."""
    own = g.nodes.where(F.col("id") == node_id)
    made = own.select(*[F.explode(F.array(*map(F.lit, parts))).alias("id") if c == "id" else F.col(c) for c in g.nodes.columns])
    table = g.nodes.sparkSession.createDataFrame([(node_id, parts[0])], "old string, new string")
    return Graph(g.nodes.where(F.col("id") != node_id).unionByName(made), _retarget(g.edges, table), g.project)


def extract_parent(g: Graph, parent: str, title: str, children: list[str]) -> Graph:
    """A new module node that contains some nodes."""
    top = g.nodes.agg(F.max("ord")).first()[0] or 0
    out = add_node(g, id=parent, title=title, node_type="module", ord=top + 1)
    made = g.nodes.sparkSession.createDataFrame([(c, k) for k, c in enumerate(children)], "dst string, k long")
    edges = made.select(*[{"src": F.lit(parent), "dst": F.col("dst"), "relation": F.lit("contains"), "ord": F.lit(top + 1) + F.col("k")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in g.edges.schema])
    return out.with_edges(g.edges.unionByName(edges))


def apply_edits(g: Graph, edits: list[dict]) -> Graph:
    """add_node, add_edge, remove_node, update_status operations in order."""
    for e in edits:
        op, rest = e["op"], {k: v for k, v in e.items() if k != "op"}
        g = {"add_node": add_node, "add_edge": add_edge, "remove_node": remove_node, "update_status": update_status}[op](g, **rest)
    return g


def add_feature(g: Graph, name: str, tasks: list[dict]) -> Graph:
    """A feature and its tasks: ids by slug, made unique; each task implements the feature and depends on those of its
    `deps` that are titles among the tasks; others are skipped. tasks: title, and status, tags, deps if wanted."""
    spark = g.nodes.sparkSession
    slug_of = {r["t"]: r["s"] for r in spark.createDataFrame([(x,) for x in {name, *(t["title"] for t in tasks)}], "t string").select("t", slugify(F.col("t")).alias("s")).collect()}
    slug = slug_of[name]
    bases = [f"feat-{slug}", *(f"task-{slug}-{slug_of[t['title']]}" for t in tasks)]
    like = g.nodes.where(F.regexp_replace("id", "-([2-9]|[1-9][0-9]{1,2})$", "").isin(bases) | F.col("id").isin(bases)).select("id").distinct()
    used = {r["id"] for r in like.collect()}  # a thousand at most for each new node

    def unique(base: str) -> str:
        free = next((x for x in (base, *(f"{base}-{k}" for k in range(2, 1000))) if x not in used), f"{base}-overflow")
        used.add(free)
        return free

    last = max(g.nodes.agg(F.max("ord")).first()[0] or 0, g.edges.agg(F.max("ord")).first()[0] or 0)
    feature = unique(bases[0])
    nodes = [{"id": feature, "title": name, "node_type": "feature", "status": "todo", "ord": last + 1}]
    edges, by_title = [], {}
    for k, (t, base) in enumerate(zip(tasks, bases[1:])):
        own = unique(base)
        nodes.append({"id": own, "title": t["title"], "node_type": "task", "status": t.get("status", "todo"), "tags": t.get("tags", []), "ord": last + 2 + k})
        edges.append((own, feature, "implements"))
        by_title[t["title"]] = own
    for t in tasks:
        edges += [(by_title[t["title"]], by_title[d], "depends_on") for d in t.get("deps", []) if d in by_title]
    new_nodes = _rows(g.nodes, nodes)
    new_edges = _rows(g.edges, [{"src": a, "dst": b, "relation": r, "call_count": 1, "in_error_path": False, "ord": last + 1 + i} for i, (a, b, r) in enumerate(dict.fromkeys(edges))])
    return Graph(g.nodes.unionByName(new_nodes), g.edges.unionByName(new_edges), g.project)


def _rows(df: DataFrame, rows: list[dict]) -> DataFrame:
    """Rows in the shape of df."""
    out = df.limit(0)
    for values in rows:
        out = out.unionByName(df.sparkSession.range(1).select(*[(F.array(*map(F.lit, v)) if isinstance(v := values.get(f.name), list) else F.lit(v)).cast(f.dataType).alias(f.name) for f in df.schema]))
    return out


def rename_preview(g: Graph, old: str, new: str) -> DataFrame:
    """(what, id, was, becomes): what a rename would change, without changing it."""
    node = g.nodes.where(F.col("id") == old).select(F.lit("node").alias("what"), "id", F.col("id").alias("was"), F.lit(new).alias("becomes"))
    edge = F.concat_ws(" ", "src", "relation", "dst")
    swap = lambda c: F.when(F.col(c) == old, F.lit(new)).otherwise(F.col(c))
    edges = g.edges.where((F.col("src") == old) | (F.col("dst") == old)).select(F.lit("edge").alias("what"), edge.alias("id"), edge.alias("was"), F.concat_ws(" ", swap("src"), "relation", swap("dst")).alias("becomes"))
    return node.unionByName(edges)
