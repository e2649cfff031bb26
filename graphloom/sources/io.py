"""Sources and sinks: YAML, SQLite, Parquet, JSON lines, snapshots, Markdown artifacts, source trees, renderings."""

from __future__ import annotations

import json
import os
import sqlite3
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.text import ignored
from graphloom.graph import EDGE, NODE, Graph, fill
from graphloom.operators.scans import first_by_order

#: Snapshots kept; older ones are deleted.
KEEP = 50
EVENT = (
    "event string, ts timestamp, task_id string, layer int, turns int, tokens long, duration_s long, verify string, reason string, command string, result string, "
    "new_tasks array<string>, total_tasks long, layers long, tasks_done long, tasks_remaining long, passed boolean, score short, issues long, total_turns int, total_tokens long, failed long"
)
# What a source scan passes over, and the file types it reads.
SKIP_DIRS = ("node_modules", "target", "build", "dist", "__pycache__", "venv", ".venv", "vendor")
EXTENSIONS = ("rs", "ts", "tsx", "js", "jsx", "py")


def _from_rows(spark: SparkSession, nodes: list[dict], edges: list[dict], project=None) -> Graph:
    def frame(rows: list[dict], names: dict[str, str], schema: str) -> DataFrame:
        lines = [json.dumps({names.get(k, k): (json.dumps(v) if k == "metadata" and schema is EDGE and not isinstance(v, str) else v) for k, v in r.items()} | {"ord": i}) for i, r in enumerate(rows)]
        raw = spark.createDataFrame([(x,) for x in lines], "line string")
        return fill(raw.select(F.from_json("line", schema).alias("x")).select("x.*"), schema)

    def plain(r: dict) -> dict:
        m = r.get("metadata")
        return r | ({"metadata": {k: v if isinstance(v, str) else json.dumps(v) for k, v in m.items()}} if isinstance(m, dict) else {})

    n = frame([plain(r) for r in nodes], {"type": "node_type"}, NODE)
    e = frame(edges, {"from": "src", "to": "dst"}, EDGE)
    e = e.withColumn("edge_source", F.coalesce("edge_source", F.get_json_object("metadata", "$.source")))
    name = project if isinstance(project, str) or project is None else project.get("name")
    return Graph(n, first_by_order(e, ["src", "dst", "relation"]), name)


def load_yaml(spark: SparkSession, path: str) -> Graph:
    """A graph from one YAML file of nodes and edges; missing fields take their defaults."""
    import yaml

    with open(path) as f:
        data = yaml.safe_load(f) or {}
    return _from_rows(spark, data.get("nodes") or [], data.get("edges") or [], data.get("project"))


def save_yaml(g: Graph, path: str) -> None:
    """A graph as one YAML file; YAML is for small graphs, Parquet for all."""
    import yaml

    def rows(df: DataFrame, names: dict[str, str]) -> list[dict]:
        return [{names.get(k, k): v for k, v in json.loads(x[0]).items() if k != "ord"} for x in df.orderBy("ord").select(F.to_json(F.struct(*df.columns))).collect()]

    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w") as f:
        yaml.safe_dump({"project": {"name": g.project}, "nodes": rows(g.nodes, {"node_type": "type"}), "edges": rows(g.edges, {"src": "from", "dst": "to"})}, f, sort_keys=False, allow_unicode=True)


def load_parquet(spark: SparkSession, path: str) -> Graph:
    return Graph(spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges"))


def save_parquet(g: Graph, path: str) -> None:
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.write.mode("overwrite").parquet(f"{path}/edges")


# The tables of a SQLite graph. Tags, metadata and knowledge have tables of their own; edges carry, beside the
# columns that others read, those that only this library has.
SQLITE_NODE = (
    "id TEXT NOT NULL, title TEXT, status TEXT, description TEXT, node_type TEXT, file_path TEXT, lang TEXT, start_line INTEGER, end_line INTEGER, signature TEXT, visibility TEXT, doc_comment TEXT, "
    "body_hash TEXT, node_kind TEXT, owner TEXT, source TEXT, repo TEXT, priority INTEGER, assigned_to TEXT, parent_id TEXT, depth INTEGER, complexity REAL, is_public INTEGER, body TEXT, created_at TEXT, "
    "updated_at TEXT, doc_path TEXT"
)
SQLITE_EDGE = "from_node TEXT NOT NULL, to_node TEXT NOT NULL, relation TEXT NOT NULL, weight REAL, confidence REAL, metadata TEXT, edge_source TEXT, call_count INTEGER, in_error_path INTEGER"
KNOWLEDGE = ("findings", "file_cache", "tool_history")


def load_sqlite(spark: SparkSession, path: str) -> Graph:
    """A graph from a SQLite file with tables nodes, edges and, where present, node_tags, node_metadata, knowledge and config."""
    con = sqlite3.connect(path)
    con.row_factory = sqlite3.Row
    tables = {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
    nodes = [{k: v for k, v in dict(r).items() if v is not None} for r in con.execute("SELECT * FROM nodes ORDER BY rowid")]
    edges = [{k: v for k, v in dict(r).items() if v is not None} for r in con.execute("SELECT * FROM edges ORDER BY rowid")]
    by_id = {n["id"]: n for n in nodes}
    if "node_tags" in tables:
        for r in con.execute("SELECT node_id, tag FROM node_tags ORDER BY rowid"):
            by_id[r[0]].setdefault("tags", []).append(r[1])
    if "node_metadata" in tables:
        for r in con.execute("SELECT node_id, key, value FROM node_metadata ORDER BY rowid"):
            by_id[r[0]].setdefault("metadata", {})[r[1]] = r[2]
    if "knowledge" in tables:
        for r in con.execute("SELECT * FROM knowledge"):
            by_id[r["node_id"]]["knowledge"] = {k: json.loads(r[k]) for k in KNOWLEDGE if r[k]}
    project = dict(con.execute("SELECT key, value FROM config")).get("project") if "config" in tables else None
    con.close()
    for n in nodes:
        if "is_public" in n:
            n["is_public"] = bool(n["is_public"])
    for e in edges:
        for a, b in (("from_node", "from"), ("to_node", "to")):
            if a in e:
                e[b] = e.pop(a)
        if isinstance(e.get("metadata"), str):
            e["metadata"] = json.loads(e["metadata"])
        if "in_error_path" in e:
            e["in_error_path"] = bool(e["in_error_path"])
    return _from_rows(spark, nodes, edges, project)


def save_sqlite(g: Graph, path: str) -> None:
    """A graph as a SQLite file with all that nodes and edges have; it takes its name once it is whole. Rows come partition by
    partition, in order, so the driver holds one partition at a time."""

    def rows(df: DataFrame, ddl: str, *names: str):
        """The columns of a frame, those that it lacks as nulls."""
        whole = fill(df, ddl)
        return (tuple(r) for r in whole.orderBy("ord").select(*names).toLocalIterator())

    def insert(table: str, n: int, values) -> None:
        con.executemany(f"INSERT INTO {table} VALUES ({','.join('?' * n)})", values)

    aside = f"{path}.{uuid.uuid4().hex}"
    con = sqlite3.connect(aside)
    try:
        with con:
            con.execute(f"CREATE TABLE nodes ({SQLITE_NODE})")
            con.execute(f"CREATE TABLE edges ({SQLITE_EDGE})")
            con.execute("CREATE TABLE node_tags (node_id TEXT NOT NULL, tag TEXT NOT NULL)")
            con.execute("CREATE TABLE node_metadata (node_id TEXT NOT NULL, key TEXT NOT NULL, value TEXT)")
            con.execute("CREATE TABLE knowledge (node_id TEXT NOT NULL, findings TEXT, file_cache TEXT, tool_history TEXT)")
            con.execute("CREATE TABLE config (key TEXT PRIMARY KEY NOT NULL, value TEXT NOT NULL)")
            plain = [c.split()[0] for c in SQLITE_NODE.split(", ")]
            insert("nodes", len(plain), rows(g.nodes, NODE, *plain))
            insert("node_tags", 2, ((i, t) for i, tags in rows(g.nodes, NODE, "id", "tags") for t in tags))
            insert("node_metadata", 3, ((i, k, v) for i, m in rows(g.nodes, NODE, "id", "metadata") for k, v in (m or {}).items()))
            known = ((i, k.asDict(True)) for i, k in rows(g.nodes, NODE, "id", "knowledge") if k is not None)
            insert("knowledge", 4, ((i, *(None if k[c] is None else json.dumps(k[c]) for c in KNOWLEDGE)) for i, k in known))
            ends = ["src", "dst", *(c.split()[0] for c in SQLITE_EDGE.split(", ")[2:])]
            insert("edges", len(ends), rows(g.edges, EDGE, *ends))
            if g.project:
                con.execute("INSERT INTO config VALUES ('project', ?)", (g.project,))
        con.close()
        os.replace(aside, path)
    finally:
        con.close()
        if os.path.exists(aside):
            os.remove(aside)


def detect_backend(folder: str) -> str:
    """sqlite if graph.db is there or nothing is; else yaml."""
    return "yaml" if os.path.exists(f"{folder}/graph.yml") and not os.path.exists(f"{folder}/graph.db") else "sqlite"


def load_auto(spark: SparkSession, folder: str) -> Graph:
    """The graph of a folder; an empty one if it has none."""
    if os.path.exists(f"{folder}/graph.db"):
        return load_sqlite(spark, f"{folder}/graph.db")
    if os.path.exists(f"{folder}/graph.yml"):
        return load_yaml(spark, f"{folder}/graph.yml")
    if os.path.isdir(f"{folder}/nodes"):
        return load_parquet(spark, folder)
    return _from_rows(spark, [], [])


def read_events(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """An execution log of JSON lines; lines that cannot be read are passed over."""
    raw = spark.read.schema(EVENT + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    log = raw.where("_corrupt_record is null and event is not null").drop("_corrupt_record")
    return log if since is None else log.where(F.col("ts") >= F.lit(since).cast("timestamp"))


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def save_snapshot(g: Graph, folder: str) -> str:
    """A versioned copy under folder; only the newest KEEP stay."""
    name = time.strftime("%Y%m%dT%H%M%S", time.gmtime()) + "-" + uuid.uuid4().hex[:6]
    save_parquet(g, f"{folder}/{name}")
    import shutil

    for old in list_snapshots(folder)[KEEP:]:
        shutil.rmtree(f"{folder}/{old}")
    return name


def list_snapshots(folder: str) -> list[str]:
    """Names of snapshots, newest first."""
    return sorted((x for x in os.listdir(folder) if os.path.isdir(f"{folder}/{x}/nodes")), reverse=True) if os.path.isdir(folder) else []


def restore_snapshot(spark: SparkSession, current: Graph, folder: str, name: str) -> Graph:
    """A snapshot again, after one of the current graph."""
    save_snapshot(current, folder)
    return load_parquet(spark, f"{folder}/{name}")


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(path, kind, front_matter, body) of the Markdown files under root, kind told by where they lie."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    kind = F.when(F.col("path").rlike("/issues/[^/]+/issue\\.md$"), "issue").when(F.col("path").rlike("/features/[^/]+/[^/]+\\.md$"), "feature").when(F.col("path").rlike("/reviews/"), "review").otherwise("note")
    head = F.regexp_extract("value", "(?s)^---\\n(.*?)\\n---\\n", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike("^[A-Za-z_]+:"))
    front = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, ":", 1), F.filter(F.transform(F.split(F.regexp_replace(F.regexp_replace(x, "^[^:]*:\\s*", ""), "[\\[\\]\"']", ""), ","), F.trim), lambda v: v != ""))))
    return raw.select("path", kind.alias("kind"), F.when(F.size(pairs) > 0, front).alias("front_matter"), F.regexp_replace("value", "(?s)^---\\n.*?\\n---\\n", "").alias("body")).orderBy("path")


def scan_sources(spark: SparkSession, root: str, ignore: list[str] | None = None) -> DataFrame:
    """(path, lang extension, content, content_hash) of the source files under root."""
    raw = spark.read.option("recursiveFileLookup", True).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("uri"), F.col("value").alias("content"))
    base = root.rstrip("/").removeprefix("file://")
    path = F.regexp_replace(F.regexp_replace("uri", "^file:/+", "/"), f"^{base}/", "")
    found = raw.select(path.alias("path"), "content").withColumn("ext", F.lower(F.regexp_extract("path", "\\.([A-Za-z]+)$", 1)))
    skip = "(^|/)(" + "|".join(x.replace(".", "\\.") for x in SKIP_DIRS) + "|\\.[^/]+)/"
    found = found.where(F.col("ext").isin(list(EXTENSIONS)) & ~F.col("path").rlike(skip))
    if ignore:
        found = found.where(~ignored(F.col("path"), ignore))
    return found.withColumn("content_hash", F.sha2("content", 256))


STATUS_COLOURS = {"done": "green", "in_progress": "yellow", "blocked": "red", "todo": "white"}


def render(g: Graph, form: str = "ascii") -> DataFrame:
    """(ord, line): a graph as ascii, dot or mermaid text, one row a line; join them in order for the whole."""
    if form == "ascii":
        return g.edges.select("ord", F.concat_ws("", "src", F.lit(" --"), "relation", F.lit("--> "), "dst").alias("line"))
    colour = F.create_map(*[F.lit(x) for kv in STATUS_COLOURS.items() for x in kv])
    style = F.when(F.col("relation") == "implements", "dashed").when(F.col("relation") == "contains", "dotted").otherwise("solid")
    quote = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    if form == "dot":
        n = g.nodes.select("ord", F.concat(F.lit("  "), quote("id"), F.lit(" [label="), quote("title"), F.lit(", fillcolor="), F.coalesce(colour[F.col("status")], F.lit("gray")), F.lit("];")).alias("line"))
        return n.unionByName(g.edges.select("ord", F.concat(F.lit("  "), quote("src"), F.lit(" -> "), quote("dst"), F.lit(" [style="), style, F.lit("];")).alias("line")))
    safe = lambda c: F.regexp_replace(F.col(c), "[^A-Za-z0-9_]", "_")
    n = g.nodes.select("ord", F.concat(F.lit("  "), safe("id"), F.lit("["), quote("title"), F.lit("]")).alias("line"))
    arrow = F.when(style == "solid", "-->").otherwise("-.->")
    return n.unionByName(g.edges.select("ord", F.concat_ws(" ", F.lit(" "), safe("src"), arrow, safe("dst")).alias("line")))


def validate_for_migration(g: Graph, types: list[str], relations: list[str]) -> DataFrame:
    """(severity, what): unknown types and relations are errors; danglers and duplicates are warnings."""
    from graphloom.operators.integrity import duplicate_nodes, missing_refs

    bad = g.nodes.where("node_type is not null").where(~F.col("node_type").isin(types)).select(F.lit("error").alias("severity"), F.concat_ws(" ", F.lit("type"), "node_type", "id").alias("what"))
    bad = bad.unionByName(g.edges.where(~F.col("relation").isin(relations)).select(F.lit("error").alias("severity"), F.concat_ws(" ", F.lit("relation"), "relation").alias("what")))
    bad = bad.unionByName(missing_refs(g).select(F.lit("warning").alias("severity"), F.concat_ws(" ", F.lit("missing"), "missing").alias("what")))
    return bad.unionByName(duplicate_nodes(g).select(F.lit("warning").alias("severity"), F.concat_ws(" ", F.lit("duplicate"), "id").alias("what")))
