"""Scans, filters and lookups over a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, layer_of


def get_node(g: Graph, node_id: str) -> DataFrame:
    return g.nodes.where(F.col("id") == node_id)


def query_nodes(g: Graph, node_type=None, status=None, path_prefix=None, tag=None, owner=None, limit=None, offset=None) -> DataFrame:
    """Filters joined by AND; a path prefix may hold the wildcards % and _; ordered by id where rows are cut."""
    out = g.nodes
    for name, value in (("node_type", node_type), ("status", status), ("owner", owner)):
        out = out.where(F.col(name) == value) if value is not None else out
    if path_prefix is not None:
        out = out.where(F.col("file_path").like(path_prefix + "%"))
    if tag is not None:
        out = out.where(F.array_contains("tags", tag))
    if limit is not None or offset:
        out = out.orderBy("id", "ord")
        out = out.offset(offset) if offset else out
        out = out.limit(limit) if limit is not None else out
    return out


def get_edges(g: Graph, node_id: str) -> DataFrame:
    return g.edges.where((F.col("src") == node_id) | (F.col("dst") == node_id))


def edges_from(g: Graph, node_id: str) -> DataFrame:
    return g.edges.where(F.col("src") == node_id)


def edges_to(g: Graph, node_id: str) -> DataFrame:
    return g.edges.where(F.col("dst") == node_id)


def counts(g: Graph) -> DataFrame:
    n = g.nodes.agg(F.lit("nodes").alias("what"), F.count(F.lit(1)).alias("n"))
    return n.unionByName(g.edges.agg(F.lit("edges").alias("what"), F.count(F.lit(1)).alias("n")))


def nodes_of_layer(g: Graph, layer: str) -> DataFrame:
    return g.nodes.where(layer_of(F.col("source")) == layer)


def layer_filter(g: Graph, layer: str) -> Graph:
    """The induced subgraph of a layer; "all" is the graph itself."""
    return g if layer == "all" else g.induced(nodes_of_layer(g, layer))


def edges_of_layer(g: Graph, layer: str) -> DataFrame:
    """code: extracted; bridge: auto-bridge; project: all others, edges of no stated source included."""
    source = F.coalesce("edge_source", F.lit(""))
    return g.edges.where({"code": source == "extract", "bridge": source == "auto-bridge", "project": ~source.isin("extract", "auto-bridge")}[layer])


# What the beginning of an id says about the node.
ID_PREFIXES = {
    "file": "file", "fn": "function", "func": "function", "struct": "class", "class": "class", "mod": "module", "module": "module", "method": "method",
    "trait": "trait", "interface": "trait", "enum": "enum", "const": "constant", "static": "constant", "test": "test", "impl": "impl",
}
# The relations and types that a graph file may hold.
KNOWN_RELATIONS = (
    "depends_on", "blocks", "subtask_of", "relates_to", "implements", "contains", "tests_for", "calls", "imports", "defined_in",
    "belongs_to", "maps_to", "overrides", "inherits", "documents", "extends", "specifies", "used_by",
)
KNOWN_NODE_TYPES = (
    "task", "file", "component", "feature", "layer", "code", "module", "class", "function", "method", "trait", "enum", "struct", "interface", "test", "config", "doc", "legacy",
)


def infer_node_type(node_id: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ID_PREFIXES.items() for x in kv])
    return F.when(F.instr(node_id, ":") > 0, table[F.substring_index(node_id, ":", 1)])


def known_relation(relation: Column, known=KNOWN_RELATIONS) -> Column:
    return relation.isin(list(known))


def resolve_node(g: Graph, ref: str) -> DataFrame:
    """Nodes of the first tier that matches at all: id (its first row); title; all segments of ref between : - / in those of
    the id or of the title; the same between underscores; path, title, id containing ref. All but the first ignore case."""
    low = ref.lower()

    def has_all(c: Column, pattern: str) -> Column:
        want = F.array_remove(F.split(F.lit(low), pattern), "")
        return (F.size(want) > 0) & (F.size(F.array_except(want, F.split(F.lower(c), pattern))) == 0)

    structure, words = "[:/-]", "_"
    tier = (
        F.when(F.col("id") == ref, 1)
        .when(F.lower("title") == low, 2)
        .when(has_all(F.col("id"), structure) | has_all(F.col("title"), structure), 3)
        .when(has_all(F.col("id"), words) | has_all(F.col("title"), words), 4)
        .when(F.contains(F.lower("file_path"), F.lit(low)), 5)
        .when(F.contains(F.lower("title"), F.lit(low)), 6)
        .when(F.contains(F.lower("id"), F.lit(low)), 7)
    )
    found = g.nodes.withColumn("tier", tier).where("tier is not null")
    best = found.agg(F.min(F.struct("tier", F.when(F.col("tier") == 1, F.col("ord")).alias("ord"))).alias("best"))  # one row
    found = found.join(F.broadcast(best)).where((F.col("tier") == F.col("best.tier")) & ((F.col("tier") > 1) | (F.col("ord") == F.col("best.ord"))))
    return found.select(*g.nodes.columns, "tier")


def has_node(g: Graph, path: str, name: str) -> bool:
    return not find_node(g, path, name).isEmpty()


def find_node(g: Graph, path: str, name: str) -> DataFrame:
    """The first node of a name in a file."""
    return g.nodes.where((F.col("file_path") == path) & (F.col("title") == name)).orderBy("ord").limit(1)


def first_by_order(df: DataFrame, keys: list[str], last: bool = False) -> DataFrame:
    """One row for each key: the first, or last, inserted."""
    order = F.col("ord").desc() if last else F.col("ord")
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("_rank = 1").drop("_rank")
