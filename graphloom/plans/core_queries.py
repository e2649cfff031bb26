"""Queries over the graph view: scans, filters, integrity, traversal, scheduling, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.graph import layer_of
from graphloom.operators import aggregates as A
from graphloom.operators import integrity as V
from graphloom.operators import scans as S
from graphloom.operators import schedule as H
from graphloom.operators import traverse as G
from graphloom.sources.graph_view import CTE, build_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(graph) under a name, with the rest of its oracle after the graph's CTE."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(build_graph(spark, sf_dir))
        if sql:
            SQL[name] = f"{CTE} {sql}"
        return fn

    return add


ID = ["id", "title", "status", "node_type"]

query("s06_point_lookup", "SELECT id, title, status, node_type FROM n WHERE id = 'part:7'")(lambda g: S.get_node(g, "part:7").select(ID))
query("s07_filtered_scan", "SELECT id, title, status, node_type FROM n WHERE node_type = 'function' AND status = 'todo' AND file_path LIKE 'pro%'")(lambda g: S.query_nodes(g, node_type="function", status="todo", path_prefix="pro").select(ID))
query("t07_limit_offset", "SELECT id, title, status, node_type FROM n WHERE node_type = 'task' ORDER BY id, ord LIMIT 25 OFFSET 10")(lambda g: S.query_nodes(g, node_type="task", limit=25, offset=10).select(ID))
query("s08_incident_edges", "SELECT src, dst, relation FROM e WHERE src = 'supp:3' OR dst = 'supp:3'")(lambda g: S.get_edges(g, "supp:3").select("src", "dst", "relation"))
query("p08_edges_from", "SELECT src, dst, relation FROM e WHERE src = 'order:5'")(lambda g: S.edges_from(g, "order:5").select("src", "dst", "relation"))
query("p08_edges_to", "SELECT src, dst, relation FROM e WHERE dst = 'part:5'")(lambda g: S.edges_to(g, "part:5").select("src", "dst", "relation"))
query("s09_counts", "SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e")(S.counts)
query("s22_schema_report", "SELECT 'node_kind' AS what, node_kind AS name, count(*) AS n FROM n GROUP BY node_kind UNION ALL SELECT 'relation', relation, count(*) FROM e GROUP BY relation")(A.schema_report)
_LAYER = "CASE WHEN source = 'extract' THEN 'code' WHEN source IS NULL OR source IN ('project', 'manual') THEN 'project' WHEN source = 'infer' THEN 'inferred' ELSE 'other' END"
query("p01_layer_filter", f", k AS (SELECT DISTINCT id FROM n WHERE {_LAYER} = 'code') SELECT relation, count(*) AS n FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) GROUP BY relation")(
    lambda g: S.layer_filter(g, "code").edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
)
query("p02_nodes_by_layer", f"SELECT {_LAYER} AS layer, count(*) AS n FROM n GROUP BY 1")(lambda g: g.nodes.groupBy(layer_of(F.col("source")).alias("layer")).agg(F.count(F.lit(1)).alias("n")))
query("p03_project_edges", "SELECT src, dst, relation FROM e WHERE coalesce(edge_source, '') NOT IN ('extract', 'auto-bridge')")(lambda g: S.edges_of_layer(g, "project").select("src", "dst", "relation"))
query("p03_code_edges", "SELECT relation, count(*) AS n FROM e WHERE edge_source = 'extract' GROUP BY relation")(lambda g: S.edges_of_layer(g, "code").groupBy("relation").agg(F.count(F.lit(1)).alias("n")))
query("p04_confidence_gate", "SELECT relation, count(*) AS n FROM e WHERE confidence IS NULL OR confidence >= 0.8 GROUP BY relation")(lambda g: g.edges.where(G.trusted(0.8)).groupBy("relation").agg(F.count(F.lit(1)).alias("n")))
query("p05_relation_filter", "SELECT relation, count(*) AS n FROM e WHERE relation IN ('calls', 'uses') GROUP BY relation")(lambda g: g.edges.where(G.related("calls, uses")).groupBy("relation").agg(F.count(F.lit(1)).alias("n")))
query("p07_tasks_by_status", "SELECT status, count(*) AS n FROM n WHERE node_type = 'task' GROUP BY status")(lambda g: g.nodes.where("node_type = 'task'").groupBy("status").agg(F.count(F.lit(1)).alias("n")))
query("p10_infer_node_type", "SELECT id, CASE split_part(id, ':', 1) WHEN 'file' THEN 'file' END AS inferred FROM n WHERE node_type = 'component'")(lambda g: g.nodes.where("node_type = 'component'").select("id", S.infer_node_type(F.col("id")).alias("inferred")))
query("p15_known_relation", "SELECT relation, relation IN ('depends_on','blocks','subtask_of','relates_to','implements','contains','tests_for','calls','imports','defined_in','belongs_to','maps_to','overrides','inherits','documents','extends','specifies','used_by') AS known, count(*) AS n FROM e GROUP BY 1, 2")(
    lambda g: g.edges.groupBy("relation", S.known_relation(F.col("relation")).alias("known")).agg(F.count(F.lit(1)).alias("n"))
)
query(
    "p09_resolve_node",
    "SELECT 'ORDER 12' AS ref, id, 2 AS tier FROM n WHERE lower(title) = 'order 12' UNION ALL SELECT 'comp:alone', id, 1 FROM n WHERE id = 'comp:alone' AND ord = (SELECT min(ord) FROM n WHERE id = 'comp:alone') "
    "UNION ALL SELECT 'main.rs', id, 2 FROM n WHERE lower(title) = 'main.rs' UNION ALL SELECT 'Auth', id, 3 FROM n WHERE list_contains(regexp_split_to_array(lower(id), '[:/-]'), 'auth') OR list_contains(regexp_split_to_array(lower(title), '[:/-]'), 'auth') "
    "UNION ALL SELECT 'port', id, 4 FROM n WHERE list_contains(string_split(lower(id), '_'), 'port') OR list_contains(string_split(lower(title), '_'), 'port') UNION ALL SELECT 'DB/Poo', id, 5 FROM n WHERE contains(lower(file_path), 'db/poo') "
    "UNION ALL SELECT 'ation feat', id, 6 FROM n WHERE contains(lower(title), 'ation feat') UNION ALL SELECT 'ASK:LOG', id, 7 FROM n WHERE contains(lower(id), 'ask:log')",
)(lambda g: _resolved(g, "ORDER 12", "comp:alone", "main.rs", "Auth", "port", "DB/Poo", "ation feat", "ASK:LOG"))



def _resolved(g, *refs):
    out = None
    for ref in refs:
        found = S.resolve_node(g, ref).select(F.lit(ref).alias("ref"), "id", "tier")
        out = found if out is None else out.unionByName(found)
    return out


_REACH = "SELECT DISTINCT id, title, status, node_type FROM n WHERE id IN (SELECT id FROM r)"
query("g01_impact_filtered", f", r AS (SELECT 'supp:7' AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id WHERE e.relation IN ('calls', 'belongs_to') AND (e.confidence IS NULL OR e.confidence >= 0.8)) {_REACH} AND id <> 'supp:7'")(
    lambda g: G.impact(g, "supp:7", "calls,belongs_to", 0.8).select(ID)
)
query("g01_hidden_edges", ", r AS (SELECT 'supp:7' AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id WHERE e.relation IN ('calls', 'belongs_to') AND (e.confidence IS NULL OR e.confidence >= 0.8)) SELECT count(*) AS hidden FROM e WHERE relation IN ('calls', 'belongs_to') AND confidence < 0.8 AND dst IN (SELECT id FROM r)")(
    lambda g: G.hidden_edges(g, "supp:7", "calls,belongs_to", 0.8)
)
query("g01_impact_depends_on", f", r AS (SELECT 'order:50' AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id WHERE e.relation = 'depends_on') {_REACH} AND id <> 'order:50'")(lambda g: G.impact(g, "order:50", "depends_on").select(ID))
query("g01_impact_nation", f", r AS (SELECT 'nation:3' AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id WHERE e.relation = 'belongs_to' AND (e.confidence IS NULL OR e.confidence >= 0.8)) {_REACH} AND id <> 'nation:3'")(lambda g: G.impact(g, "nation:3", "belongs_to").select(ID))
query("p06_type_filter_on_result", f", r AS (SELECT 'nation:3' AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id WHERE e.confidence IS NULL OR e.confidence >= 0.8) {_REACH} AND id <> 'nation:3' AND node_type = 'function'")(
    lambda g: G.impact(g, "nation:3").where("node_type = 'function'").select(ID)
)
query("g02_deps_transitive", f", r AS (SELECT 'order:50' AS id UNION SELECT e.dst FROM r JOIN e ON e.src = r.id WHERE e.confidence IS NULL OR e.confidence >= 0.8) {_REACH} AND id <> 'order:50'")(lambda g: G.deps(g, "order:50").select(ID))
query("g02_deps_direct", "SELECT DISTINCT id, title, status, node_type FROM n WHERE id IN (SELECT dst FROM e WHERE src = 'task:x1' AND (confidence IS NULL OR confidence >= 0.8))")(lambda g: G.deps(g, "task:x1", transitive=False).select(ID))
query(
    "g03_path",
    ", x AS (SELECT src AS a, dst AS b, ord FROM e UNION ALL SELECT dst, src, ord FROM e), r(id, hop) AS (SELECT 'part:3', 0 UNION SELECT x.b, r.hop + 1 FROM r JOIN x ON x.a = r.id WHERE r.hop < 4), d AS (SELECT id, min(hop) AS hop FROM r GROUP BY id), "
    "up AS (SELECT c.id, arg_min(p.id, x.ord) AS parent FROM d c JOIN x ON x.b = c.id JOIN d p ON p.id = x.a AND p.hop = c.hop - 1 GROUP BY c.id), w(position, id) AS (SELECT hop, id FROM d WHERE id = 'region:1' UNION ALL SELECT w.position - 1, up.parent FROM w JOIN up ON up.id = w.id) SELECT CAST(position AS INT) AS position, id FROM w",
)(lambda g: G.path(g, "part:3", "region:1"))
query("g06_would_create_cycle", "SELECT 'task:x1' AS src, 'task:x3' AS dst, true AS cycle UNION ALL SELECT 'cust:1', 'cust:2', false")(
    lambda g: g.nodes.sparkSession.createDataFrame([(a, b, G.would_create_cycle(g, a, b)) for a, b in (("task:x1", "task:x3"), ("cust:1", "cust:2"))], "src string, dst string, cycle boolean")
)
query("g07_neighbors_3", f", r(id, hop) AS (SELECT 'region:1', 0 UNION SELECT e.src, r.hop + 1 FROM r JOIN e ON e.dst = r.id WHERE r.hop < 3) {_REACH}")(lambda g: G.neighbors(g, "region:1", 3, "in").select(ID).distinct())
query("g07_neighbors_both", f", r(id, hop) AS (SELECT 'order:77', 0 UNION SELECT x.b, r.hop + 1 FROM r JOIN (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e) x ON x.a = r.id WHERE r.hop < 2) {_REACH}")(lambda g: G.neighbors(g, "order:77", 2).select(ID).distinct())
query("u01_common_cause", ", r(seed, id) AS (SELECT * FROM (VALUES ('part:1', 'part:1'), ('part:2', 'part:2')) v(seed, id) UNION SELECT r.seed, e.dst FROM r JOIN e ON e.src = r.id) SELECT DISTINCT id, title, status, node_type FROM n WHERE id IN (SELECT id FROM r WHERE id <> seed GROUP BY id HAVING count(DISTINCT seed) = 2)")(
    lambda g: G.common_cause(g, "part:1", "part:2").select(ID)
)
query("j18_callers", "SELECT e.src AS id, e.call_count FROM e JOIN n ON n.id = e.src WHERE e.dst = 'supp:1' AND e.relation = 'calls'")(lambda g: G.callers(g, "supp:1").select("id", "call_count"))
query("j18_callees", "SELECT e.dst AS id, e.call_count FROM e JOIN n ON n.id = e.dst WHERE e.src = 'part:9' AND e.relation = 'calls'")(lambda g: G.callees(g, "part:9").select("id", "call_count"))
query("g28_blocked_chains", ", r(seed, id) AS (SELECT id, id FROM n WHERE status = 'blocked' UNION SELECT r.seed, e.src FROM r JOIN e ON e.dst = r.id WHERE e.relation = 'depends_on') SELECT seed AS blocked, count(*) AS n_waiting FROM r JOIN n ON n.id = r.id WHERE r.id <> seed AND n.status IN ('todo', 'in_progress') GROUP BY seed")(
    lambda g: G.impact_of_many(g, g.nodes.where("status = 'blocked'").select("id"), "depends_on", None)
    .join(g.nodes.where("status IN ('todo', 'in_progress')").select("id"), "id")
    .groupBy(F.col("seed").alias("blocked"))
    .agg(F.count(F.lit(1)).alias("n_waiting"))
)

query("j01_missing_refs", "SELECT src, dst, relation, 'src' AS side, src AS missing FROM e WHERE src NOT IN (SELECT id FROM n) UNION ALL SELECT src, dst, relation, 'dst', dst FROM e WHERE dst NOT IN (SELECT id FROM n)")(lambda g: V.missing_refs(g).select("src", "dst", "relation", "side", "missing"))
query("j02_orphan_nodes", "SELECT id, ord FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)")(lambda g: V.orphan_nodes(g).select("id", "ord"))
query("a04_duplicate_nodes", "SELECT id, ord, CAST(copy AS INT) AS copy FROM (SELECT id, ord, row_number() OVER (PARTITION BY id ORDER BY ord) - 1 AS copy FROM n) WHERE copy > 0")(V.duplicate_nodes)
query("a05_duplicate_edges", "SELECT src, dst, relation, CAST(copy AS INT) AS copy FROM (SELECT src, dst, relation, row_number() OVER (PARTITION BY src, dst, relation ORDER BY ord) - 1 AS copy FROM e) WHERE copy > 0")(lambda g: V.duplicate_edges(g).select("src", "dst", "relation", "copy"))
query("v_self_edges", "SELECT src, dst, relation FROM e WHERE src = dst")(lambda g: V.self_edges(g).select("src", "dst", "relation"))
query("w01_first_writer_edges", "SELECT src, dst, relation, weight FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, relation ORDER BY ord) AS k FROM e WHERE relation = 'belongs_to') WHERE k = 1")(
    lambda g: S.first_by_order(g.edges.where("relation = 'belongs_to'"), ["src", "dst", "relation"]).select("src", "dst", "relation", "weight")
)
query("w02_last_writer_nodes", "SELECT id, title FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS k FROM n WHERE node_type = 'component') WHERE k = 1")(lambda g: S.first_by_order(g.nodes.where("node_type = 'component'"), ["id"], last=True).select("id", "title"))
query("g05_cycles", ", c AS (SELECT src, dst FROM e WHERE relation = 'depends_on' AND src LIKE 'task:%'), r(a, b) AS (SELECT src, dst FROM c UNION SELECT r.a, c.dst FROM r JOIN c ON c.src = r.b) SELECT 'task:x1' AS component, a AS id FROM r WHERE a = b")(lambda g: V.cycles(g))
query("m08_repair_plan", "SELECT 'duplicate_node' AS kind, count(*) AS n FROM (SELECT row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM n) WHERE k > 1 UNION ALL SELECT 'duplicate_edge', count(*) FROM (SELECT row_number() OVER (PARTITION BY src, dst, relation ORDER BY ord) AS k FROM e) WHERE k > 1 UNION ALL SELECT 'self_edge', count(*) FROM e WHERE src = dst UNION ALL SELECT 'orphan_edge', count(*) FROM (SELECT DISTINCT src, dst, relation FROM e WHERE src <> dst) WHERE src NOT IN (SELECT id FROM n) OR dst NOT IN (SELECT id FROM n) UNION ALL SELECT 'orphan_node', count(*) FROM (SELECT DISTINCT id FROM n) WHERE id NOT IN (SELECT src FROM e WHERE dst IN (SELECT id FROM n) AND src <> dst UNION SELECT dst FROM e WHERE src IN (SELECT id FROM n) AND src <> dst)")(
    lambda g: V.repair(g)[1].groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
)

_READY = f"SELECT * FROM n WHERE status = 'todo' AND {_LAYER} = 'project' AND id NOT IN (SELECT e.src FROM e JOIN n m ON m.id = e.dst WHERE e.relation = 'depends_on' AND m.status <> 'done')"
query("g26_ready_tasks", f"SELECT id, title, status, node_type FROM ({_READY}) WHERE node_type = 'task'")(lambda g: H.ready_tasks(g).where("node_type = 'task'").select(ID))
query("u12_newly_ready", ", nxt AS (SELECT e.src AS id FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.relation = 'depends_on' AND e.dst = 'task:y1' AND a.status = 'todo' AND b.status <> 'done' AND a.id NOT IN (SELECT f.src FROM e f JOIN n m ON m.id = f.dst WHERE f.relation = 'depends_on' AND m.status <> 'done' AND m.id <> 'task:y1')) SELECT id FROM nxt")(
    lambda g: H.newly_ready(g, "task:y1").select("id")
)
query("g25_orphan_tasks", "SELECT id, title, status, node_type FROM n WHERE node_type = 'task' AND id NOT IN (SELECT src FROM e WHERE relation IN ('depends_on', 'implements') UNION SELECT dst FROM e WHERE relation = 'depends_on')")(lambda g: H.orphan_tasks(g).select(ID))
_CHAIN = ", d AS (SELECT src, dst FROM e WHERE relation = 'depends_on' AND src LIKE 'order:%'), r(id, depth) AS (SELECT id, 0 FROM n WHERE id LIKE 'order:%' AND id NOT IN (SELECT src FROM d) UNION ALL SELECT 'order:ghost', 0 UNION ALL SELECT d.src, r.depth + 1 FROM r JOIN d ON d.dst = r.id)"
query("g27_chain_depths", f"{_CHAIN} SELECT id, CAST(max(depth) AS INT) AS depth FROM r WHERE id <> 'order:ghost' GROUP BY id")(lambda g: H.chain_depths(g).where("id LIKE 'order:%'").select("id", F.col("depth").cast("int").alias("depth")))
_CLOSED = "cy(a, b) AS (SELECT src, dst FROM d UNION SELECT cy.a, d.dst FROM cy JOIN d ON d.src = cy.b)"
query(
    "g04_topological_ranks",
    f", d AS (SELECT DISTINCT src, dst FROM e WHERE relation = 'depends_on'), {_CLOSED}, bad(id) AS (SELECT a FROM cy WHERE a = b UNION SELECT src FROM d WHERE dst NOT IN (SELECT id FROM n) UNION SELECT d.src FROM bad JOIN d ON d.dst = bad.id), "
    "r(id, k) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT src FROM d) UNION SELECT d.src, r.k + 1 FROM r JOIN d ON d.dst = r.id WHERE d.src NOT IN (SELECT id FROM bad)) "
    "SELECT n.id, CAST(max(r.k) AS INT) AS rank FROM (SELECT DISTINCT id FROM n) n LEFT JOIN r ON r.id = n.id AND n.id NOT IN (SELECT id FROM bad) GROUP BY n.id",
)(H.topological_ranks)
query(
    "g22_execution_layers",
    ", t AS (SELECT DISTINCT id FROM n WHERE node_type = 'task' AND status NOT IN ('done', 'cancelled')), x AS (SELECT DISTINCT src, dst FROM e WHERE relation = 'depends_on' AND src IN (SELECT id FROM t)), "
    "z AS (SELECT id FROM t WHERE id NOT IN (SELECT src FROM x WHERE dst IN (SELECT id FROM t))), "
    f"d AS (SELECT src, dst FROM x WHERE src NOT IN (SELECT id FROM z) AND dst IN (SELECT id FROM n WHERE status <> 'done')), {_CLOSED}, "
    "bad(id) AS (SELECT a FROM cy WHERE a = b UNION SELECT src FROM d WHERE dst NOT IN (SELECT id FROM t) UNION SELECT d.src FROM bad JOIN d ON d.dst = bad.id), "
    "r(id, k) AS (SELECT id, 0 FROM z UNION SELECT d.src, r.k + 1 FROM r JOIN d ON d.dst = r.id WHERE d.src NOT IN (SELECT id FROM bad)) SELECT t.id, CAST(max(r.k) AS INT) AS layer FROM t LEFT JOIN r ON r.id = t.id GROUP BY t.id",
)(H.execution_layers)
query(
    "g23_critical_path",
    ", t AS (SELECT DISTINCT id FROM n WHERE node_type = 'task' AND status NOT IN ('done', 'cancelled')), d AS (SELECT DISTINCT src, dst FROM e WHERE relation = 'depends_on' AND src <> dst AND src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)), "
    f"{_CLOSED}, bad(id) AS (SELECT a FROM cy WHERE a = b UNION SELECT d.src FROM bad JOIN d ON d.dst = bad.id), r(id, k) AS (SELECT id, 0 FROM t WHERE id NOT IN (SELECT src FROM d) UNION SELECT d.src, r.k + 1 FROM r JOIN d ON d.dst = r.id WHERE d.src NOT IN (SELECT id FROM bad)), "
    "k AS (SELECT id, max(k) AS k FROM r GROUP BY id), nx AS (SELECT d.src, min(d.dst) AS dst FROM d JOIN k a ON a.id = d.src JOIN k b ON b.id = d.dst AND b.k = a.k - 1 GROUP BY d.src), "
    "w(position, id) AS (SELECT * FROM (SELECT k, id FROM k ORDER BY k DESC, id LIMIT 1) UNION ALL SELECT w.position - 1, nx.dst FROM w JOIN nx ON nx.src = w.id) SELECT CAST(position AS INT) AS position, id FROM w",
)(H.critical_path)

query("a01_summary", f"SELECT (SELECT count(*) FROM n WHERE {_LAYER} = 'project') AS total_nodes, " + ", ".join(f"(SELECT count(*) FROM n WHERE {_LAYER} = 'project' AND status = '{s}') AS {s}" for s in A.STATUS_COLUMNS) + f", (SELECT count(*) FROM e) AS total_edges, (SELECT count(*) FROM ({_READY})) AS ready")(A.summary)
query("a02_health", f", s AS (SELECT CAST((SELECT count(*) FROM n) AS DOUBLE) AS a, (SELECT count(*) FROM n WHERE {_LAYER} = 'project' AND status = 'in_progress') AS i, CAST((SELECT count(*) FROM n WHERE {_LAYER} = 'project') AS DOUBLE) AS t, (SELECT count(*) FROM n WHERE {_LAYER} = 'project' AND status = 'done') AS d, (SELECT count(*) FROM n WHERE {_LAYER} = 'project' AND status = 'todo') AS o, (SELECT count(*) FROM n WHERE {_LAYER} = 'project' AND status = 'blocked') AS b, (SELECT count(*) FROM e) AS m, (SELECT count(*) FROM ({_READY})) AS k) SELECT round(0.4 * d / t + 0.3 * CASE WHEN o + i = 0 THEN 1.0 WHEN k = 0 AND o > 0 THEN 0.0 ELSE CAST(k AS DOUBLE) / (o + i) END + 0.1 * least(1.0, m / (a * (a - 1))) + 0.2 * (1 - b / t), 9) AS health FROM s")(
    lambda g: A.health(g).select(F.round("health", 9).alias("health"))
)
query(
    "d36_summary_text",
    f"SELECT concat_ws(', ', (SELECT count(*) FROM n WHERE {_LAYER} = 'project') || ' nodes', (SELECT count(*) FROM e) || ' edges', "
    + ", ".join(f"(SELECT CASE WHEN count(*) > 0 THEN count(*) || ' {s}' END FROM n WHERE {_LAYER} = 'project' AND status = '{s}')" for s in A.STATUS_COLUMNS)
    + f", (SELECT CASE WHEN count(*) > 0 THEN count(*) || ' ready' END FROM ({_READY}))) AS text",
)(A.summary_text)
query("a03_fan_metrics", "SELECT id, CAST(sum(i) AS BIGINT) AS fan_in, CAST(sum(o) AS BIGINT) AS fan_out FROM (SELECT dst AS id, 1 AS i, 0 AS o FROM e WHERE relation = 'depends_on' UNION ALL SELECT src, 0, 1 FROM e WHERE relation = 'depends_on') GROUP BY id")(A.fan_metrics)
query("a06_fold_call_edges", "SELECT src, dst, CAST(sum(call_count) AS INT) AS call_count, max(confidence) AS confidence, bool_or(in_error_path) AS in_error_path, round(0.4 * least(CAST(sum(call_count) AS DOUBLE) / 10.0, 1.0) + 0.3 * CASE WHEN bool_or(in_error_path) THEN 0.8 ELSE 0.5 END + 0.3 * coalesce(max(confidence), 1.0), 6) AS weight FROM e WHERE relation = 'calls' GROUP BY src, dst")(
    lambda g: A.fold_call_edges(g.edges).where("relation = 'calls'").select("src", "dst", "call_count", "confidence", "in_error_path", F.round("weight", 6).alias("weight"))
)
query("a07_edge_weight", "SELECT relation, count(*) AS n, round(sum(CASE WHEN relation = 'calls' THEN 0.4 * least(call_count / 10.0, 1.0) + 0.3 * CASE WHEN in_error_path THEN 0.8 ELSE 0.5 END + 0.3 * coalesce(confidence, 1.0) ELSE 0.7 END), 3) AS total FROM e GROUP BY relation")(
    lambda g: g.edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(A.edge_weight(F.col("relation"), F.col("call_count"), F.col("in_error_path"), F.coalesce("confidence", F.lit(1.0)))), 3).alias("total"))
)
query("a09_relation_weights", "SELECT relation, CASE WHEN relation = 'calls' THEN 1.0 WHEN relation = 'imports' THEN 0.8 WHEN relation IN ('type_reference', 'inherits', 'implements', 'uses', 'overrides') THEN 0.5 WHEN relation IN ('defined_in', 'contains', 'belongs_to') THEN 0.2 WHEN relation = 'depends_on' THEN 0.4 WHEN relation = 'tests_for' THEN 0.3 ELSE 0.0 END::DOUBLE AS w, count(*) AS n FROM e GROUP BY 1, 2")(
    lambda g: g.edges.groupBy("relation", A.relation_weight(F.col("relation")).alias("w")).agg(F.count(F.lit(1)).alias("n"))
)
query("a17_caller_counts", "SELECT n.id, n.ord, (SELECT count(*) FROM e WHERE e.dst = n.id AND relation = 'calls') AS callers, (SELECT count(*) FROM e WHERE e.src = n.id AND relation = 'calls') AS callees FROM n WHERE node_kind IN ('Class', 'Function')")(
    lambda g: A.caller_counts(g).where("node_kind IN ('Class', 'Function')").select("id", "ord", "callers", "callees")
)
_CALLERS = "SELECT n.id, (SELECT count(*) FROM e WHERE e.dst = n.id AND relation = 'calls') AS callers FROM n WHERE id LIKE 'supp:%'"
_TOUCHED = "SELECT n.id, (SELECT count(*) FROM e WHERE e.dst = n.id AND relation = 'calls' AND edge_source = 'extract' AND NOT in_error_path) AS callers FROM n WHERE id LIKE 'supp:%' AND id NOT LIKE '%3'"


def _marked_tests(g):
    """The graph with every tenth supplier marked as a test and calls in error paths taken out of the code layer."""
    nodes = g.nodes.withColumn("metadata", F.when(F.col("id").rlike("^supp:.*3$"), '{"is_test":true}').otherwise(F.col("metadata")))
    return g.with_nodes(nodes).with_edges(g.edges.withColumn("edge_source", F.when(~F.col("in_error_path"), F.col("edge_source"))))


query("a18_touch_summary", f", c AS ({_CALLERS}), t AS (SELECT * FROM c ORDER BY callers DESC, id LIMIT 10) SELECT (SELECT max(callers) FROM c) AS max_callers, (SELECT CAST(sum(callers) AS BIGINT) FROM c) AS total_callers, (SELECT count(*) FROM c) AS n_nodes, (SELECT string_agg(id, ',' ORDER BY id) FROM t) AS top_nodes, (SELECT count(*) FROM t WHERE callers >= 10) AS hubs, 'critical' AS risk")(
    lambda g: A.touch_summary(g, g.nodes.where("id LIKE 'supp:%'"))
)
query("a18_touch_summary_marked", f", c AS ({_TOUCHED}), t AS (SELECT * FROM c ORDER BY callers DESC, id LIMIT 10) SELECT (SELECT max(callers) FROM c) AS max_callers, (SELECT CAST(sum(callers) AS BIGINT) FROM c) AS total_callers, (SELECT count(*) FROM c) AS n_nodes, (SELECT string_agg(id, ',' ORDER BY id) FROM t) AS top_nodes, (SELECT count(*) FROM t WHERE callers >= 10) AS hubs, 'critical' AS risk")(
    lambda g: A.touch_summary(_marked_tests(g), g.nodes.where("id LIKE 'supp:%'"))
)
query("a20_risk_level", f", c AS ({_CALLERS}) SELECT CASE WHEN callers <= 5 THEN 'low' WHEN callers <= 20 THEN 'medium' WHEN callers <= 50 THEN 'high' ELSE 'critical' END AS risk, count(*) AS n FROM c GROUP BY 1")(
    lambda g: A.caller_counts(g).where("id LIKE 'supp:%'").groupBy(A.risk_level(F.col("callers")).alias("risk")).agg(F.count(F.lit(1)).alias("n"))
)
query("a21_high_risk_change", f", c AS ({_CALLERS}) SELECT sum(callers) > 10 OR max(callers) > 5 AS high_risk FROM c WHERE id IN ('supp:1', 'supp:2')")(
    lambda g: A.caller_counts(g).where("id IN ('supp:1', 'supp:2')").agg(A.high_risk_change(F.sum("callers"), F.max("callers")).alias("high_risk"))
)
_SETS = {"simple": ("region:1",), "medium": ("class:src/db/pool.rs:Pool", "task:login"), "files": ("file:src/main.rs", "file:src/auth/login.rs"), "parts": tuple(f"part:{k}" for k in range(1, 8))}
_QUOTED = {k: ", ".join(f"'{i}'" for i in ids) for k, ids in _SETS.items()}
query(
    "a19_complexity",
    ", c AS ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS set_name, (SELECT count(*) FROM n WHERE id IN ({i})) AS n_nodes, (SELECT count(DISTINCT file_path) FROM n WHERE id IN ({i})) AS n_files, (SELECT count(*) FROM n WHERE id IN ({i}) AND node_kind = 'Class') AS n_classes, "
        f"(SELECT count(*) FROM e WHERE relation = 'inherits' AND (src IN ({i}) OR dst IN ({i}))) AS n_inherits, (SELECT count(*) FROM e WHERE relation = 'imports' AND (src IN ({i}) OR dst IN ({i}))) AS n_imports, {t}::BIGINT AS n_tests"
        for (k, i), t in zip(_QUOTED.items(), (1, 2, 0, 0))
    )
    + ") SELECT *, CASE WHEN n_nodes <= 2 AND n_files <= 1 AND n_classes = 0 AND n_tests <= 1 THEN 'simple' WHEN n_nodes >= 6 OR n_files >= 3 OR n_inherits >= 2 OR n_imports >= 4 OR n_tests > 3 THEN 'complex' ELSE 'medium' END AS complexity FROM c",
)(lambda g: _complexities(g, (1, 2, 0, 0)))


def _complexities(g, tests):
    out = None
    for (name, ids), t in zip(_SETS.items(), tests):
        found = A.complexity(g, g.nodes.where(F.col("id").isin(*ids)), t).withColumn("set_name", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


query("a22_feature_dependencies", ", m AS (SELECT id, CASE WHEN id LIKE 'order:%' THEN 'orders' WHEN id LIKE 'part:%' THEN 'parts' WHEN id LIKE 'supp:%' THEN 'suppliers' END AS feature FROM n WHERE id LIKE 'order:%' OR id LIKE 'part:%' OR id LIKE 'supp:%') SELECT a.feature, b.feature AS needs, count(*) AS weight FROM e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.feature <> b.feature GROUP BY 1, 2 HAVING count(*) >= 2")(
    lambda g: A.feature_dependencies(g.edges, g.nodes.select("id", F.when(F.col("id").like("order:%"), "orders").when(F.col("id").like("part:%"), "parts").when(F.col("id").like("supp:%"), "suppliers").alias("feature")).where("feature is not null"))
)
query("a23_edge_classes", ", s AS (SELECT DISTINCT id FROM n WHERE id LIKE 'code:%' OR node_type IN ('file', 'class', 'function')), k AS (SELECT src IN (SELECT id FROM s) AS a, dst IN (SELECT id FROM s) AS b FROM e) SELECT count(*) FILTER (a AND b) AS code_edges, count(*) FILTER (NOT a AND NOT b) AS task_edges, count(*) FILTER (a <> b) AS cross_edges FROM k")(A.edge_classes)
query("a26_next_sequence", "SELECT 'order:' || lpad(CAST(max(CAST(regexp_extract(id, '^order:([0-9]+)$', 1) AS INT)) + 1 AS VARCHAR), 8, '0') AS next_id FROM n WHERE regexp_matches(id, '^order:[0-9]+$')")(lambda g: A.next_sequence(g.nodes, "order:", 8))
