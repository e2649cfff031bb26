"""The property graph: two frames, immutable.

nodes: id, title, status, node_type, node_kind, source, file_path, ord (insertion order) and whatever else a source has.
edges: src, dst, relation, weight, confidence, edge_source, call_count, in_error_path, ord. A null confidence means trusted.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = (
    "id string, title string, status string, description string, assigned_to string, tags array<string>, priority short, node_type string, "
    "knowledge struct<findings:map<string,string>,file_cache:map<string,string>,tool_history:array<struct<tool_name:string,timestamp:string,summary:string>>>, "
    "metadata map<string,string>, file_path string, lang string, start_line long, end_line long, signature string, visibility string, doc_comment string, "
    "doc_path string, body_hash string, node_kind string, owner string, source string, repo string, parent_id string, depth int, complexity double, "
    "is_public boolean, body string, created_at string, updated_at string, ord long"
)
EDGE = (
    "src string, dst string, relation string, weight double, confidence double, metadata string, edge_source string, call_count int, in_error_path boolean, ord long"
)
STATUSES = ("todo", "in_progress", "done", "blocked", "cancelled", "failed", "needs_resolution")
DEFAULT_CONFIDENCE = 0.8


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    project: str | None = None

    def with_nodes(self, nodes: DataFrame) -> Graph:
        return replace(self, nodes=nodes)

    def with_edges(self, edges: DataFrame) -> Graph:
        return replace(self, edges=edges)

    def induced(self, nodes: DataFrame) -> Graph:
        """The subgraph on some nodes: edges stay if both ends do."""
        ids = nodes.select("id").distinct()
        edges = self.edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
        return replace(self, nodes=nodes, edges=edges.select(self.edges.columns))


def fill(df: DataFrame, ddl: str) -> DataFrame:
    """df with the columns of ddl that it lacks, as nulls; tags never null, status and relation with their defaults."""
    defaults = {"status": F.lit("todo"), "relation": F.lit("depends_on"), "tags": F.array().cast("array<string>"), "call_count": F.lit(1), "in_error_path": F.lit(False)}
    out = []
    for f in T.StructType.fromDDL(ddl):
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if f.name in defaults:
            c = F.coalesce(c, defaults[f.name])
        out.append(c.cast(f.dataType).alias(f.name))
    return df.select(*out)


def trusted(minimum: float | None) -> Column:
    """The confidence gate: no threshold, or none given on the edge, passes."""
    return F.lit(True) if minimum is None else F.col("confidence").isNull() | (F.col("confidence") >= minimum)


def related(relations) -> Column:
    """The relation filter: None is all; a comma list is split and trimmed."""
    if relations is None:
        return F.lit(True)
    names = [r.strip() for r in relations.split(",")] if isinstance(relations, str) else list(relations)
    return F.col("relation").isin([r for r in names if r])


def layer_of(source: Column) -> Column:
    return F.when(source == "extract", "code").when(source.isNull() | source.isin("project", "manual"), "project").when(source == "infer", "inferred").otherwise("other")


def metadata_of(nodes: DataFrame, key: str) -> Column:
    """A scalar of the nodes' metadata: a map of JSON values, or one JSON object."""
    if "metadata" not in nodes.columns:
        return F.lit(None).cast("string")
    if isinstance(nodes.schema["metadata"].dataType, T.MapType):
        return F.get_json_object(F.concat(F.lit('{"v":'), F.col("metadata")[key], F.lit("}")), "$.v")
    return F.get_json_object("metadata", f"$.{key}")
