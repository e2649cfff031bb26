"""Rollups over graphs and event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, layer_of, metadata_of
from graphloom.operators.schedule import ready_tasks

STATUS_COLUMNS = ("todo", "in_progress", "done", "blocked", "cancelled", "failed", "needs_resolution")
# How much each relation weighs when files are related to each other.
RELATION_WEIGHTS = {
    "calls": 1.0, "imports": 0.8, "type_reference": 0.5, "inherits": 0.5, "implements": 0.5, "uses": 0.5, "overrides": 0.5,
    "defined_in": 0.2, "contains": 0.2, "belongs_to": 0.2, "depends_on": 0.4, "tests_for": 0.3,
}


def summary(g: Graph) -> DataFrame:
    """Counts by status over project nodes, edges over all, ready tasks."""
    project = g.nodes.where(layer_of(F.col("source")) == "project")
    by_status = project.agg(F.count(F.lit(1)).alias("total_nodes"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUS_COLUMNS])
    edges = g.edges.agg(F.count(F.lit(1)).alias("total_edges"))
    ready = ready_tasks(g).agg(F.count(F.lit(1)).alias("ready"))
    return by_status.join(F.broadcast(edges)).join(F.broadcast(ready))  # three frames of one row


def summary_text(g: Graph) -> DataFrame:
    """One line with the buckets that are not empty."""
    s = summary(g)
    parts = [F.when(F.col(c) > 0, F.concat_ws(" ", F.col(c).cast("string"), F.lit(c))) for c in (*STATUS_COLUMNS, "ready")]
    return s.select(F.concat_ws(", ", F.concat(F.col("total_nodes").cast("string"), F.lit(" nodes")), F.concat(F.col("total_edges").cast("string"), F.lit(" edges")), *parts).alias("text"))


def health(g: Graph) -> DataFrame:
    """0.4 progress + 0.3 flow + 0.1 density + 0.2 (1 - blocked), within 0 and 1.

    Flow is the share of ready tasks among those to do and in progress: 1 if there are none, 0 if some are to do and none is
    ready. Density is the share of edges among all that n nodes of any layer could have; a single node has 1. 0 for no
    nodes, NaN for nodes none of which is a project node.
    """
    s = summary(g).join(F.broadcast(g.nodes.agg(F.count(F.lit(1)).alias("all_nodes"))))  # frames of one row
    n, every = F.col("total_nodes").cast("double"), F.col("all_nodes").cast("double")
    remaining = (F.col("todo") + F.col("in_progress")).cast("double")
    progress, blocked = F.col("done") / n, F.col("blocked") / n
    flow = F.when(remaining == 0, F.lit(1.0)).when((F.col("ready") == 0) & (F.col("todo") > 0), F.lit(0.0)).otherwise(F.col("ready") / remaining)
    density = F.when(every > 1, F.least(F.lit(1.0), F.col("total_edges") / (every * (every - 1)))).otherwise(F.lit(1.0))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.4 * progress + 0.3 * flow + 0.1 * density + 0.2 * (1 - blocked)))
    return s.select(F.when(F.col("all_nodes") == 0, F.lit(0.0)).when(F.col("total_nodes") == 0, F.lit(float("nan"))).otherwise(score).alias("health"))


def fan_metrics(g: Graph, relation: str = "depends_on") -> DataFrame:
    """id, fan_in, fan_out by one relation; repeated edges count each time."""
    e = g.edges.where(F.col("relation") == relation)
    both = e.select(F.col("dst").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(e.select("src", F.lit(0), F.lit(1)))
    return both.groupBy("id").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def edge_weight(relation: Column, call_count: Column, in_error_path: Column, confidence: Column) -> Column:
    """0.7, or for calls by how often, on which path and how surely; an error path weighs more."""
    calls = 0.4 * F.least(call_count / 10.0, F.lit(1.0)) + 0.3 * F.when(in_error_path, 0.8).otherwise(0.5) + 0.3 * confidence
    return F.when(relation == "calls", calls).otherwise(F.lit(0.7))


def fold_call_edges(edges: DataFrame) -> DataFrame:
    """One calls edge for each pair: number, highest confidence, any error path; other edges as they are; then weights."""
    folded = edges.where("relation = 'calls'").groupBy("src", "dst").agg(
        F.first("relation").alias("relation"), F.max("confidence").alias("confidence"), F.sum("call_count").cast("int").alias("call_count"), F.bool_or("in_error_path").alias("in_error_path")
    )
    rest = edges.where("relation <> 'calls'").select(folded.columns)
    both = folded.unionByName(rest)
    return both.withColumn("weight", edge_weight(F.col("relation"), F.col("call_count"), F.col("in_error_path"), F.coalesce("confidence", F.lit(1.0))))


def relation_weight(relation: Column, overrides: dict[str, float] | None = None) -> Column:
    table = F.create_map(*[F.lit(x) for kv in (RELATION_WEIGHTS | (overrides or {})).items() for x in kv])
    return F.coalesce(table[relation], F.lit(0.0))


def caller_counts(g: Graph) -> DataFrame:
    """Every node with its number of calls edges in and out."""
    e = g.edges.where("relation = 'calls'")
    into = e.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("callers"))
    out = e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("callees"))
    return g.nodes.select("id", "title", "node_type", "node_kind", "file_path", "ord").join(into, "id", "left").join(out, "id", "left").fillna(0, ["callers", "callees"])


def risk_level(callers: Column) -> Column:
    return F.when(callers <= 5, "low").when(callers <= 20, "medium").when(callers <= 50, "high").otherwise("critical")


def high_risk_change(total: Column, most: Column) -> Column:
    return (total > 10) | (most > 5)


def touch_summary(g: Graph, nodes: DataFrame, top: int = 10, hub: int = 10) -> DataFrame:
    """Most and all callers over some functions, methods and classes of the code layer that are no tests (all summed before
    cutting), the top ones, and the hubs among those. Only calls of the code layer count."""
    is_test = F.coalesce(metadata_of(g.nodes, "is_test") == "true", F.lit(False))
    code = Graph(g.nodes.where((F.col("source") == "extract") & ~is_test), g.edges.where("edge_source = 'extract'"), g.project)
    found = caller_counts(code).join(nodes.select("id").distinct(), "id", "left_semi").where(F.col("node_kind").isin("Function", "Method", "Class"))
    whole = found.agg(F.max("callers").alias("max_callers"), F.sum("callers").alias("total_callers"), F.count(F.lit(1)).alias("n_nodes"))
    best = found.orderBy(F.desc("callers"), "id").limit(top).agg(F.array_join(F.sort_array(F.collect_list("id")), ",").alias("top_nodes"), F.count_if(F.col("callers") >= hub).alias("hubs"))
    return whole.join(F.broadcast(best)).withColumn("risk", risk_level(F.coalesce("total_callers", F.lit(0))))


def complexity(g: Graph, nodes: DataFrame, tests: int = 0) -> DataFrame:
    """Counts over a relevance set and the class simple, medium or complex; edges count that touch the set with either end."""
    ids = nodes.select("id").distinct()
    n = g.nodes.join(ids, "id", "left_semi").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.countDistinct("file_path").alias("n_files"), F.count_if(F.col("node_kind") == "Class").alias("n_classes")
    )
    marked = ids.withColumn("in_set", F.lit(True))
    e = g.edges.where("relation in ('inherits', 'imports')").select("src", "dst", "relation")
    e = e.join(marked.withColumnsRenamed({"id": "src", "in_set": "a"}), "src", "left").join(marked.withColumnsRenamed({"id": "dst", "in_set": "b"}), "dst", "left").where("a or b")
    e = e.agg(F.count_if(F.col("relation") == "inherits").alias("n_inherits"), F.count_if(F.col("relation") == "imports").alias("n_imports"), F.lit(tests).cast("long").alias("n_tests"))
    simple = (F.col("n_nodes") <= 2) & (F.col("n_files") <= 1) & (F.col("n_classes") == 0) & (F.col("n_tests") <= 1)
    hard = (F.col("n_nodes") >= 6) | (F.col("n_files") >= 3) | (F.col("n_inherits") >= 2) | (F.col("n_imports") >= 4) | (F.col("n_tests") > 3)
    return n.join(F.broadcast(e)).withColumn("complexity", F.when(simple, "simple").when(hard, "complex").otherwise("medium"))  # frames of one row


def feature_dependencies(edges: DataFrame, members: DataFrame, least: int = 2) -> DataFrame:
    """(feature, needs, weight): how many edges cross from the members of one feature to those of another."""
    a = members.select(F.col("id").alias("src"), F.col("feature").alias("feature"))
    b = members.select(F.col("id").alias("dst"), F.col("feature").alias("needs"))
    crossing = edges.join(a, "src").join(b, "dst").where("feature <> needs")
    return crossing.groupBy("feature", "needs").agg(F.count(F.lit(1)).alias("weight")).where(F.col("weight") >= least)


def edge_classes(g: Graph) -> DataFrame:
    """Numbers of code, task and cross edges by their ends: code nodes have an id code:... or are files, classes or functions."""
    is_code = F.col("id").startswith("code:") | F.coalesce(F.col("node_type").isin("file", "class", "function"), F.lit(False))
    side = g.nodes.where(is_code).select("id").distinct().withColumn("code", F.lit(True))
    e = g.edges.select("src", "dst").join(side.withColumnsRenamed({"id": "src", "code": "a"}), "src", "left").join(side.withColumnsRenamed({"id": "dst", "code": "b"}), "dst", "left")
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return e.agg(F.count_if(a & b).alias("code_edges"), F.count_if(~a & ~b).alias("task_edges"), F.count_if(a != b).alias("cross_edges"))


def schema_report(g: Graph) -> DataFrame:
    n = g.nodes.groupBy(F.lit("node_kind").alias("what"), F.col("node_kind").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return n.unionByName(g.edges.groupBy(F.lit("relation").alias("what"), F.col("relation").alias("name")).agg(F.count(F.lit(1)).alias("n")))


# Directories, and ends of paths, that name an architectural layer; the first layer that matches wins.
LAYER_RULES = (
    ("interface", "commands cmd api routes controllers handlers web ui views pages components", ""),
    ("application", "services usecases use_cases orchestrators workflows ai llm", ""),
    ("domain", "core domain entities models types lib", "types.ts types.rs"),
    ("infrastructure", "infrastructure db database repositories adapters clients extractors parsers config", ""),
)


def heuristic_layer(path: Column) -> Column:
    """The layer that a directory within a path names; null for none."""
    low = F.lower(path)
    out = F.lit(None).cast("string")
    for layer, folders, ends in reversed(LAYER_RULES):
        found = low.rlike(f"/({'|'.join(folders.split())})/")
        for end in ends.split():
            found = found | low.endswith(end)
        out = F.when(found, layer).otherwise(out)
    return out


def next_sequence(ids: DataFrame, prefix: str, width: int = 4) -> DataFrame:
    """The id after the highest numbered one, padded with zeros."""
    number = F.regexp_extract("id", f"^{prefix}([0-9]+)$", 1)
    top = ids.agg(F.max(F.when(number != "", number.cast("int"))).alias("top"))
    return top.select(F.concat(F.lit(prefix), F.lpad((F.coalesce("top", F.lit(0)) + 1).cast("string"), width, "0")).alias("next_id"))


def telemetry(events: DataFrame) -> DataFrame:
    """Rollup of an execution log: done and failed tasks, turns, tokens; the last Complete event overrides the duration."""
    done, failed = F.col("event") == "task_done", F.col("event") == "task_failed"
    out = events.agg(
        F.count_if(done).alias("completed"),
        F.count_if(failed).alias("failed"),
        F.coalesce(F.sum(F.when(done | failed, F.col("turns"))), F.lit(0)).cast("long").alias("turns"),
        F.coalesce(F.sum(F.when(done, F.col("turns"))), F.lit(0)).cast("long").alias("done_turns"),
        F.coalesce(F.sum(F.when(done, F.col("tokens"))), F.lit(0)).cast("long").alias("tokens"),
        F.coalesce(F.max_by("duration_s", F.when(F.col("event") == "complete", F.col("ord"))), F.sum(F.when(done, F.col("duration_s"))), F.lit(0)).cast("long").alias("duration_s"),
        F.max(F.when(F.col("event") == "plan", F.col("total_tasks"))).alias("total_tasks"),
    )
    ended = F.col("completed") + F.col("failed")
    return out.withColumn("success_rate", F.when(ended > 0, F.round(100.0 * F.col("completed") / ended, 2)).otherwise(0.0)).withColumn(
        "turns_per_task", F.when(F.col("completed") > 0, F.round(F.col("done_turns") / F.col("completed"), 2)).otherwise(0.0)
    )


def events_as_log(events: DataFrame) -> DataFrame:
    """The driver's event table read as an execution log."""
    kind = F.when(F.col("event_type") == "purchase", "task_done").when(F.col("event_type") == "error", "task_failed").otherwise(F.col("event_type"))
    return events.select(kind.alias("event"), F.col("ts"), F.col("user_id").cast("string").alias("task_id"), (F.col("event_id") % 7 + 1).alias("turns"), F.floor(F.col("value")).cast("long").alias("tokens"), (F.col("event_id") % 60).alias("duration_s"), F.lit(None).cast("long").alias("total_tasks"), F.col("event_id").alias("ord"))


def keep_first(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))).where("_rank = 1").drop("_rank")
