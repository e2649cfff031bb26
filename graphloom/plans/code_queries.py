"""Queries: advice, context, communities, extraction, analysis, streams."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import functions as F

from graphloom.graph import Graph
from graphloom.lineage import forget, shared_folder
from graphloom.operators import advise as A
from graphloom.operators import analysis as Y
from graphloom.operators import community as I
from graphloom.operators import components as N
from graphloom.operators import context as C
from graphloom.operators import extract as X
from graphloom.operators import mutate as M
from graphloom.operators import projection as P
from graphloom.operators import setops as U
from graphloom.operators.setops import file_delta
from graphloom.sources.graph_view import CTE, build_graph
from graphloom.streaming import events as E

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(build_graph(spark, sf_dir))
        if sql:
            SQL[name] = f"{CTE} {sql}"
        return fn

    return add


def plain(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


_RANK = "CASE WHEN {0} IN ('interface', 'presentation') THEN 4 WHEN {0} IN ('application', 'service') THEN 3 WHEN {0} IN ('domain', 'business') THEN 2 WHEN {0} IN ('infrastructure', 'data') THEN 1 END"
_VIOLATIONS = f"SELECT e.src, e.dst FROM e JOIN (SELECT id, {_RANK.format("coalesce(json_extract_string(metadata, '$.layer'), node_type)")} AS r FROM n) a ON a.id = e.src JOIN (SELECT id, {_RANK.format("coalesce(json_extract_string(metadata, '$.layer'), node_type)")} AS r FROM n) b ON b.id = e.dst WHERE e.relation = 'depends_on' AND a.r < b.r"
query("g29_layer_violations", _VIOLATIONS)(A.layer_violations)
_DEAD = """dp AS (SELECT src AS id, min_by(dst, ord) AS parent FROM e WHERE relation = 'defined_in' GROUP BY src),
dm AS (SELECT id FROM dp WHERE parent IN (SELECT src FROM e WHERE relation = 'inherits' UNION SELECT dst FROM e WHERE relation = 'inherits' UNION SELECT id FROM n WHERE signature LIKE '%trait %')
UNION SELECT dst FROM e WHERE relation = 'overrides' UNION SELECT dp.id FROM dp JOIN e ON relation = 'overrides' AND starts_with(e.src, string_split(parent, '_')[-1] || '.')
UNION SELECT dp.id FROM dp JOIN n ON n.id = dp.id WHERE title IN ('fmt', 'clone', 'default', 'eq', 'ne', 'hash', 'cmp', 'partial_cmp', 'drop', 'deref', 'deref_mut', 'from', 'into', 'try_from', 'try_into', 'as_ref', 'as_mut', 'to_owned', 'to_string', 'next', 'size_hint', 'serialize', 'deserialize', 'poll', 'wake')),
dead AS (SELECT id, title, coalesce(file_path, 'unknown') AS file FROM n WHERE node_type = 'function' AND id NOT IN (SELECT dst FROM e WHERE relation = 'calls') AND id NOT IN (SELECT id FROM dm)
AND title NOT IN ('main', 'lib', 'mod', 'index', 'app', 'run', 'start', 'init', 'setup', '__main__', 'ready', 'message', 'interaction_create', 'guild_member_addition')
AND NOT regexp_matches(coalesce(file_path, ''), '(main[.]rs|lib[.]rs|index[.]ts|index[.]js|main[.]ts|main[.]js|__main__[.]py)$')
AND NOT regexp_matches(title, '^(cmd_|command_|handle_|get_|post_|put_|delete_|patch_|test_|Test|default_)') AND NOT regexp_matches(title, '(_handler|_callback|_hook|_middleware|_listener)$')
AND NOT regexp_matches(title, '^__.*__$') AND NOT regexp_matches(coalesce(file_path, ''), '/test|_test[.]|[.]test[.]|[.]spec[.]') AND NOT regexp_matches(id, 'tests__|_tests_')
AND NOT regexp_matches(coalesce(signature, ''), '^pub |^pub[(]|^export |#[[]test[]]|#[[]tokio::test[]]|#[[]no_mangle[]]|extern'))"""
query("m17_dead_code", f", {_DEAD} SELECT id FROM dead")(lambda g: A.dead_code(g).select("id"))
query("m17_dead_code_by_file", f", {_DEAD}, k AS (SELECT d.file, d.title, row_number() OVER (PARTITION BY d.file ORDER BY n.ord) AS k FROM dead d JOIN n ON n.id = d.id) SELECT file, count(*) AS n, string_agg(title, ', ' ORDER BY k) FILTER (k <= 10) AS names FROM k GROUP BY file")(A.dead_code_by_file)
_CODE = "(id LIKE 'code\\_%' ESCAPE '\\' OR id LIKE 'const\\_%' ESCAPE '\\' OR id LIKE 'method\\_%' ESCAPE '\\' OR coalesce(node_type IN ('file', 'class', 'function', 'module'), false))"
_ADVICE = f""", {_DEAD}, cy(a, b) AS (SELECT src, dst FROM e WHERE relation = 'depends_on' AND src <> dst UNION SELECT cy.a, e.dst FROM cy JOIN e ON e.src = cy.b AND e.relation = 'depends_on'),
scc AS (SELECT x.a, min(x.b) AS least FROM cy x JOIN cy y ON y.a = x.b AND y.b = x.a GROUP BY x.a HAVING count(DISTINCT x.b) > 1),
ch(id, depth) AS (SELECT id, 0 FROM n WHERE id NOT IN (SELECT src FROM e WHERE relation = 'depends_on') UNION SELECT dst, 0 FROM e WHERE relation = 'depends_on' AND dst NOT IN (SELECT id FROM n) UNION SELECT e.src, ch.depth + 1 FROM ch JOIN e ON e.dst = ch.id AND e.relation = 'depends_on' AND e.src NOT IN (SELECT a FROM scc)),
bl(seed, id) AS (SELECT id, id FROM n WHERE status = 'blocked' UNION SELECT bl.seed, e.src FROM bl JOIN e ON e.dst = bl.id),
found AS (SELECT 'cycle' AS kind, 'error' AS severity, (SELECT count(DISTINCT least) FROM scc) AS n
UNION ALL SELECT 'missing_reference', 'error', (SELECT count(*) FROM e WHERE src NOT IN (SELECT id FROM n)) + (SELECT count(*) FROM e WHERE dst NOT IN (SELECT id FROM n))
UNION ALL SELECT 'duplicate_node', 'error', (SELECT count(*) - count(DISTINCT id) FROM n)
UNION ALL SELECT 'orphan', 'warning', (SELECT count(*) FROM n WHERE id NOT IN (SELECT src FROM e UNION SELECT dst FROM e) AND NOT {_CODE})
UNION ALL SELECT 'high_fan_in', 'warning', (SELECT count(*) FROM (SELECT dst FROM e WHERE relation = 'depends_on' GROUP BY dst HAVING count(*) >= 5))
UNION ALL SELECT 'high_fan_out', 'warning', (SELECT count(*) FROM (SELECT src FROM e WHERE relation = 'depends_on' GROUP BY src HAVING count(*) >= 5))
UNION ALL SELECT 'missing_description', 'info', (SELECT count(*) FROM n WHERE description IS NULL AND NOT {_CODE})
UNION ALL SELECT 'deep_chain', 'info', (SELECT count(*) FROM (SELECT id FROM ch WHERE id IN (SELECT id FROM n) GROUP BY id HAVING max(depth) >= 5))
UNION ALL SELECT 'layer_violation', 'warning', (SELECT count(*) FROM ({_VIOLATIONS}))
UNION ALL SELECT 'blocked_chain', 'warning', (SELECT count(DISTINCT seed) FROM bl WHERE id <> seed AND id IN (SELECT id FROM n WHERE status IN ('todo', 'in_progress')))
UNION ALL SELECT 'dead_code', 'info', (SELECT count(DISTINCT file) FROM dead) UNION ALL SELECT 'module_suggestion', 'info', 1)"""
query("m16_advice", f"{_ADVICE} SELECT * FROM found WHERE n > 0")(lambda g: A.findings(g).groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n")))
query("m16_score", f"{_ADVICE}, t AS (SELECT CAST(sum(n) FILTER (severity = 'error') AS BIGINT) AS error, CAST(sum(n) FILTER (severity = 'warning') AS BIGINT) AS warning, CAST(sum(n) FILTER (severity = 'info') AS BIGINT) AS info FROM found WHERE kind NOT IN ('dead_code', 'module_suggestion')) SELECT error, warning, info, greatest(0, least(100, 100 - 25 * error - 10 * warning - 2 * least(info, 10)))::BIGINT AS score, error = 0 AS passed FROM t")(
    lambda g: A.score(A.findings(g))
)
query("g30_gather_dependencies", ", r(id, hop) AS (SELECT 'order:5', 0 UNION SELECT e.dst, r.hop + 1 FROM r JOIN e ON e.src = r.id WHERE r.hop < 2 AND e.dst IN (SELECT id FROM n)) SELECT id, CAST(min(hop) AS INT) AS hop FROM r WHERE id <> 'order:5' GROUP BY id")(lambda g: C.gather_dependencies(g, ["order:5"]).select("id", "hop"))
query("g31_gather_callers", "SELECT DISTINCT src AS id, 'caller' AS category FROM e WHERE dst = 'supp:2' AND src <> 'supp:2' AND src IN (SELECT id FROM n)")(lambda g: C.gather_callers(g, ["supp:2"]).select("id", "category"))
query("r02_candidate_score", ", f AS (SELECT src, min_by(relation, ord) AS relation FROM e WHERE dst IN ('supp:2', 'nation:1', 'file:src/auth/login.rs', 'class:src/auth/login.rs:Login') GROUP BY src) SELECT src AS id, CAST(round(0.6 * CASE WHEN relation IN ('calls', 'imports') THEN 1.0 WHEN relation IN ('type_reference', 'inherits', 'implements', 'uses') THEN 0.8 WHEN relation IN ('contains', 'defined_in') THEN 0.6 WHEN relation IN ('depends_on', 'part_of', 'blocks', 'tests_for') THEN 0.4 ELSE 0.2 END + 0.3 + 0.1, 6) AS DOUBLE) AS score FROM f WHERE src IN (SELECT id FROM n)")(
    lambda g: C.gather_callers(g, ["supp:2", "nation:1", "file:src/auth/login.rs", "class:src/auth/login.rs:Login"]).select("id", F.round(C.candidate_score(F.col("relation"), F.col("hop")), 6).alias("score"))
)
query("r06_assemble_context")(lambda g: C.assemble_context(g, ["order:5"], budget=300))
query("d25_render_context")(lambda g: C.render_context(g, C.assemble_context(g, ["order:5"], budget=300)))


def _network(g: Graph):
    """Suppliers and the directories of parts, by all call edges."""
    owners = g.nodes.where("id like 'supp:%' or id like 'part:%'").select("id", F.when(F.col("id").startswith("part:"), F.concat(F.lit("file:"), F.substring_index("file_path", "/", 2))).otherwise(F.concat(F.lit("file:"), "id")).alias("file"))
    return P.file_network(g.edges.where("relation = 'calls'"), owners)


query("i02_label_propagation")(lambda g: I.label_propagation(_network(g)))
query("i02_communities")(lambda g: I.communities(_network(g).where("weight >= 2"), trials=2))
query("i01_cluster")(lambda g: N.cluster(g)[1].select("src", "dst", "relation"))
query("i01_component_nodes")(lambda g: N.cluster(g)[0].select("id", "title", "node_type", "source"))


def _members(g: Graph):
    k = F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long")
    return g.nodes.where("id like 'part:%'").select(F.concat(F.lit("file:"), "file_path", F.lit("/"), "id").alias("file"), F.when(k % 5 == 0, F.lit(100) + k % 40).otherwise(k % 3).cast("long").alias("cluster"))


_MEMBERS = "m AS (SELECT 'file:' || file_path || '/' || id AS file, CASE WHEN k % 5 = 0 THEN 100 + k % 40 ELSE k % 3 END AS cluster FROM (SELECT *, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS k FROM n WHERE id LIKE 'part:%'))"
query(
    "i05_directory_split",
    f", {_MEMBERS}, d AS (SELECT *, regexp_replace(substr(file, 6), '/[^/]*$', '') AS dir, count(*) OVER (PARTITION BY cluster) AS c FROM m), k AS (SELECT cluster, count(DISTINCT dir) AS dirs FROM d GROUP BY cluster) SELECT d.cluster, CASE WHEN c > 60 AND dirs > 1 THEN dir ELSE '' END AS part, count(*) AS n FROM d JOIN k USING (cluster) GROUP BY 1, 2",
)(lambda g: N.split_by_directory(_members(g), 60).groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("n")))
query("i06_components", f", {_MEMBERS} SELECT 'infer:component:' || cluster AS id, 'component' AS node_type, 'infer' AS source, count(*) AS n FROM m GROUP BY cluster")(
    lambda g: (lambda c: c[0].select("id", "node_type", "source").join(N.component_sizes(c[1]).withColumnRenamed("component", "id"), "id"))(N.to_components(_members(g).withColumn("community", F.col("cluster").cast("int"))))
)
query("d30_infrastructure", f", {_MEMBERS} SELECT 'infer:component:infrastructure' AS src, file AS dst, 'contains' AS relation FROM m WHERE cluster = 1")(
    lambda g: N.to_components(_members(g).where("cluster <> 1").withColumn("community", F.col("cluster").cast("int")), _members(g).where("cluster = 1").select("file"))[1].where("src = 'infer:component:infrastructure'").select("src", "dst", "relation")
)
query("i13_infer", "SELECT CASE WHEN source = 'infer' THEN 'infer' ELSE 'other' END AS layer, count(*) AS n FROM n WHERE source IS DISTINCT FROM 'infer' GROUP BY 1 UNION ALL SELECT 'infer', 2")(
    lambda g: N.infer(g, "b7").nodes.groupBy(F.when(F.col("source") == "infer", "infer").otherwise("other").alias("layer")).agg(F.count(F.lit(1)).alias("n"))
)
query("d19_rename_preview", "SELECT 'node' AS what, 'nation:3' AS id, 'nation:3' AS was, 'nation:three' AS becomes UNION ALL SELECT 'edge', src || ' ' || relation || ' ' || dst, src || ' ' || relation || ' ' || dst, replace(src || ' ' || relation || ' ' || dst || ' ', 'nation:3 ', 'nation:three ')[:-2] FROM e WHERE 'nation:3' IN (src, dst)")(
    lambda g: M.rename_preview(g, "nation:3", "nation:three")
)
query(
    "t03_low_risk",
    ", f AS (SELECT n.id, n.ord, (SELECT count(*) FROM e WHERE e.dst = n.id AND relation = 'calls' AND edge_source = 'extract') AS callers, (SELECT count(*) FROM e WHERE e.src = n.id AND relation = 'calls' AND edge_source = 'extract') AS callees FROM n WHERE source = 'extract' AND node_kind = 'Function' AND (file_path LIKE 'src/auth%' OR file_path LIKE 'src/db%') AND file_path NOT IN ('src/auth/session.rs', 'src/db/none.rs')) SELECT id, callers, callees FROM f WHERE callers <= 1 ORDER BY callers, ord LIMIT 5",
)(lambda g: Y.low_risk_alternatives(g, ["src/auth/session.rs", "src/db/none.rs"], 1))
query(
    "g19_file_impact",
    ", c AS (SELECT id, node_kind FROM n WHERE source = 'extract' AND file_path IN ('src/auth/session.rs', 'src/db/pool.rs')), r(seed, id) AS (SELECT DISTINCT id, id FROM c UNION SELECT r.seed, e.src FROM r JOIN e ON e.dst = r.id WHERE e.edge_source = 'extract'), "
    "k AS (SELECT max(x) AS m FROM (SELECT (SELECT count(*) FROM e WHERE e.dst = c.id AND relation = 'calls' AND edge_source = 'extract') AS x FROM c WHERE node_kind IN ('Function', 'Method', 'Class'))) "
    "SELECT DISTINCT n.id, 'source' AS part, (SELECT CASE WHEN m <= 5 THEN 'low' WHEN m <= 20 THEN 'medium' WHEN m <= 50 THEN 'high' ELSE 'critical' END FROM k) AS risk, 0::BIGINT AS hidden FROM n WHERE id IN (SELECT src FROM e WHERE edge_source = 'extract' AND dst IN (SELECT id FROM r))",
)(lambda g: Y.file_impact(g, ["src/auth/session.rs", "src/db/pool.rs"]))
_TESTS = ("tests/test_login.py::test_check", "test_login.py::Login::heck", "nowhere.py::clone", "x::test_nothing", "render")
query(
    "g16_resolve_tests",
    "SELECT test, id, rule FROM (SELECT *, row_number() OVER (PARTITION BY test ORDER BY rule, ord) AS k FROM (SELECT t.test, n.id, n.ord, CASE WHEN title = name AND file <> '' AND suffix(file_path, file) THEN 1 WHEN suffix(title, name) AND file <> '' AND suffix(file_path, file) THEN 2 WHEN title = name THEN 3 WHEN suffix(title, name) THEN 4 END::INT AS rule FROM n, "
    "(VALUES ('tests/test_login.py::test_check', 'tests/test_login.py', 'test_check'), ('test_login.py::Login::heck', 'test_login.py', 'heck'), ('nowhere.py::clone', 'nowhere.py', 'clone'), ('x::test_nothing', 'x', 'test_nothing'), ('render', '', 'render')) t(test, file, name)) WHERE rule IS NOT NULL) WHERE k = 1",
)(lambda g: Y.resolve_tests(g, list(_TESTS)))
_PROBLEM = 'It breaks.\n  File "x.py", line 3, in check\nand `unused` with BadLogin or the class SessionBase; "Base" is quoted too'
query(
    "g15_symptom_nodes",
    "SELECT DISTINCT id, CASE WHEN node_kind = 'Function' AND suffix(title, 'test_check') THEN 'test' WHEN node_kind = 'Function' AND title = 'check' THEN 'traceback' ELSE 'quoted' END AS why FROM n WHERE (node_kind = 'Function' AND (suffix(title, 'test_check') OR title IN ('check', 'unused'))) OR (node_kind = 'Class' AND title IN ('Base', 'unused'))",
)(lambda g: Y.symptom_nodes(g, _PROBLEM, '["tests/test_login.py::T::test_check"]'))
query("g15_symptom_words", "SELECT DISTINCT id, 'keyword' AS why FROM n WHERE contains(lower(title), 'event') AND contains(lower(title), 'hook')")(lambda g: Y.symptom_nodes(g, "nothing known", "test_event_hook_zz"))
query("j19_shares_import", "SELECT 'file:src/main.rs' AS test, EXISTS (SELECT 1 FROM e JOIN n ON e.dst IN (n.id, 'file:' || n.file_path) WHERE e.src = 'file:src/main.rs' AND relation = 'imports' AND n.id = 'class:src/auth/login.rs:Login') AS shares UNION ALL SELECT 'file:src/db/pool.rs', false")(
    lambda g: g.nodes.sparkSession.createDataFrame([(t, Y.shares_import(g, t, ["class:src/auth/login.rs:Login"])) for t in ("file:src/main.rs", "file:src/db/pool.rs")], "test string, shares boolean")
)
_PLAN = [{"title": "Write login"}, {"title": "Test it!", "deps": ["Write login", "nothing"], "status": "done"}, {"title": "Test it", "deps": ["Test it!"]}]
query(
    "m05_add_feature",
    "SELECT 'node' AS what, 'feat-user-login' AS a, 'User Login' AS b, 'todo' AS c UNION ALL SELECT 'node', 'task-user-login-write-login', 'Write login', 'todo' UNION ALL SELECT 'node', 'task-user-login-test-it', 'Test it!', 'done' UNION ALL SELECT 'node', 'task-user-login-test-it-2', 'Test it', 'todo' "
    "UNION ALL SELECT 'edge', 'task-user-login-write-login', 'feat-user-login', 'implements' UNION ALL SELECT 'edge', 'task-user-login-test-it', 'feat-user-login', 'implements' UNION ALL SELECT 'edge', 'task-user-login-test-it-2', 'feat-user-login', 'implements' "
    "UNION ALL SELECT 'edge', 'task-user-login-test-it', 'task-user-login-write-login', 'depends_on' UNION ALL SELECT 'edge', 'task-user-login-test-it-2', 'task-user-login-test-it', 'depends_on'",
)(lambda g: _added(M.add_feature(g, "User Login", _PLAN)))


def _added(g: Graph):
    nodes = g.nodes.where("id like 'feat-%' or id like 'task-%'").select(F.lit("node").alias("what"), F.col("id").alias("a"), F.col("title").alias("b"), F.col("status").alias("c"))
    return nodes.unionByName(g.edges.where("src like 'task-%'").select(F.lit("edge").alias("what"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("relation").alias("c")))


query("u08_graph_to_code", "SELECT 'node' AS what, CASE WHEN node_kind IN ('File', 'Class', 'Function', 'Module', 'Constant', 'Interface', 'Enum', 'TypeAlias', 'Trait') THEN node_kind ELSE 'File' END AS kind, count(*) AS n FROM n WHERE source = 'extract' GROUP BY 2 UNION ALL SELECT 'edge', relation, count(*) FROM e WHERE edge_source = 'extract' AND relation IN ('imports', 'inherits', 'defined_in', 'calls', 'tests_for', 'overrides', 'implements', 'belongs_to', 'type_reference') GROUP BY 2")(
    lambda g: (lambda c: c[0].groupBy(F.lit("node").alias("what"), "kind").agg(F.count(F.lit(1)).alias("n")).unionByName(c[1].groupBy(F.lit("edge").alias("what"), F.col("relation").alias("kind")).agg(F.count(F.lit(1)).alias("n"))))(U.graph_to_code(g))
)
query("u07_code_to_graph", "SELECT relation AS what, count(*) AS n, count(*) FILTER (call_count > 1) AS counted, count(*) FILTER (in_error_path) AS in_errors FROM e WHERE edge_source = 'extract' AND relation IN ('imports', 'inherits', 'defined_in', 'calls', 'tests_for', 'overrides', 'belongs_to') GROUP BY 1 UNION ALL SELECT node_kind, count(*), 0, 0 FROM n WHERE source = 'extract' GROUP BY 1")(
    lambda g: (
        lambda h: h.edges.groupBy(F.col("relation").alias("what"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.get_json_object("metadata", "$.call_count").isNotNull()).alias("counted"), F.count_if(F.get_json_object("metadata", "$.in_error_path") == "true").alias("in_errors"))
        .unionByName(h.nodes.where("status = 'done' and node_type = 'code'").groupBy(F.col("node_kind").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("counted"), F.lit(0).cast("long").alias("in_errors")))
    )(U.code_to_graph(*U.graph_to_code(g)))
)
query("d10_folded_kinds", "SELECT CASE WHEN node_kind = 'File' THEN 'file' WHEN node_kind IN ('Class', 'Interface', 'Enum', 'TypeAlias', 'Trait') THEN 'class' WHEN node_kind IN ('Function', 'Constant', 'Method') THEN 'function' WHEN node_kind = 'Module' THEN 'module' ELSE 'unknown' END AS kind, count(*) AS n FROM n GROUP BY 1")(
    lambda g: g.nodes.groupBy(U.fold_kind(F.col("node_kind")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))
)
query("j03_phantoms", "SELECT (SELECT count(*) FROM n WHERE NOT (node_type = 'file' AND file_path LIKE 'src/db/%')) AS nodes, (SELECT count(*) FROM e WHERE src IN (SELECT id FROM n WHERE NOT (node_type = 'file' AND file_path LIKE 'src/db/%')) AND dst IN (SELECT id FROM n WHERE NOT (node_type = 'file' AND file_path LIKE 'src/db/%'))) AS edges")(
    lambda g: (lambda c: c[0].agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(c[1].agg(F.count(F.lit(1)).alias("edges")))))(X.remove_phantoms(g.nodes, g.edges, g.nodes.where("node_type = 'file' and file_path not like 'src/db/%'").select(F.col("file_path").alias("path"))))
)


def _refs(g: Graph):
    """Edges to names of parts' brands as classes, functions and modules, some of which nothing has."""
    k = F.regexp_extract("id", "([0-9]+)$", 1).try_cast("long")
    base = g.nodes.where("id like 'part:%'").select("id", k.alias("k"))
    to = F.when(F.col("k") % 4 == 0, F.concat(F.lit("class_ref:Class"), (F.col("k") % 7).cast("string"))).when(F.col("k") % 4 == 1, F.concat(F.lit("func_ref:fn"), (F.col("k") % 7).cast("string"))).when(F.col("k") % 4 == 2, F.concat(F.lit("module_ref:m"), (F.col("k") % 7).cast("string"))).otherwise(F.lit("class:gone/x.rs:Class2"))
    edges = base.select(F.col("id").alias("src"), to.alias("dst"), F.when(F.col("k") % 4 == 3, "defined_in").otherwise("uses").alias("relation"))
    rows = [(f"class:{f}:Class{i}", f"Class{i}", "class", 10 * j + i) for j, f in enumerate(("a", "b")) for i in range(5)] + [(f"func:{f}:fn{i}", f"fn{i}", "function", 100 + 10 * j + i) for j, f in enumerate(("a", "b")) for i in range(4)]
    defs = g.nodes.sparkSession.createDataFrame(rows, "id string, title string, node_type string, ord int")
    modules = g.nodes.sparkSession.createDataFrame([(f"m{i}", f"file:m{i}") for i in range(6)], "module string, id string")
    return X.remap_impls(X.resolve_references(edges, defs, modules), defs)


query(
    "j09_references",
    ", p AS (SELECT id, CAST(regexp_extract(id, '([0-9]+)$', 1) AS BIGINT) AS k FROM n WHERE id LIKE 'part:%') SELECT dst, relation, count(*) AS n FROM (SELECT CASE WHEN k % 4 = 0 AND k % 7 < 5 THEN 'class:b:Class' || k % 7 WHEN k % 4 = 1 AND k % 7 < 4 THEN 'func:a:fn' || k % 7 WHEN k % 4 = 2 AND k % 7 < 6 THEN 'file:m' || k % 7 WHEN k % 4 = 3 THEN 'class:a:Class2' END AS dst, CASE WHEN k % 4 = 3 THEN 'defined_in' ELSE 'uses' END AS relation FROM p) WHERE dst IS NOT NULL GROUP BY 1, 2",
)(lambda g: _refs(g).groupBy("dst", "relation").agg(F.count(F.lit(1)).alias("n")))
query("g09_impact_report", ", r AS (SELECT 'supp:7' AS id UNION SELECT e.src FROM r JOIN e ON e.dst = r.id WHERE e.relation IN ('calls')) SELECT DISTINCT id, 'code' AS part FROM n WHERE id IN (SELECT id FROM r) AND id <> 'supp:7'")(lambda g: Y.impact_report(g, ["supp:7"], "calls"))


def _weighted_uses(g):
    """The graph with orders calling their parts and weights in eighths."""
    e = g.edges.withColumn("relation", F.when(F.col("relation") == "uses", "calls").otherwise(F.col("relation"))).withColumn("weight", (F.col("ord") % 8 + 1) / F.lit(8.0))
    return g.with_edges(e)


query(
    "g12_causal_chains",
    ", x AS (SELECT src, dst, ord, (ord % 8 + 1) / 8.0::DOUBLE AS w FROM e WHERE relation IN ('calls', 'uses')), s(id, k) AS (VALUES ('supp:3', 0), ('supp:5', 1)), "
    "a AS (SELECT s.id AS symptom, s.k, x.src AS id, arg_min(w, ord) AS w, min(ord) AS ord FROM s JOIN x ON x.dst = s.id WHERE x.src IN (SELECT id FROM n) GROUP BY 1, 2, 3), "
    "y AS (SELECT src, dst, arg_min(w, ord) AS w, min(ord) AS ord FROM x GROUP BY 1, 2), "
    "b AS (SELECT symptom, k, y.src AS id, arg_min(a.id, {'w': -a.w, 'id': a.id}) AS up, arg_min(a.w * y.w, {'w': -a.w, 'id': a.id}) AS w, arg_min({'w': -a.w, 'id': a.id, 'ord': y.ord}, {'w': -a.w, 'id': a.id}) AS place FROM a JOIN y ON y.dst = a.id WHERE y.src IN (SELECT id FROM n) GROUP BY 1, 2, 3), "
    "c AS (SELECT symptom, symptom || ' > ' || id AS chain, 'called_by' AS links, w AS weight, 2 AS length, k, -1.0::DOUBLE AS pw, '' AS pid, ord, id FROM a WHERE (symptom, id) NOT IN (SELECT (symptom, up) FROM b) "
    "UNION ALL SELECT symptom, symptom || ' > ' || up || ' > ' || id, 'called_by > called_by', w, 3, k, place.w, place.id, place.ord, id FROM b) "
    "SELECT symptom, chain, links, round(weight, 6) AS weight, (row_number() OVER (ORDER BY length, k, pw, pid, ord, id))::INT AS rank FROM c",
)(lambda g: Y.causal_chains(_weighted_uses(g), ["supp:3", "supp:5"], depth=3, most=1_000_000))
_FIRST = ["task:login", "order:5", "class:src/auth/login.rs:Login", "func:src/auth/session.rs:render"]
query(
    "g30_first_relation",
    ", t AS (SELECT id, row_number() OVER () - 1 AS k FROM (VALUES " + ", ".join(f"('{x}')" for x in _FIRST) + ") AS t(id)), "
    "a AS (SELECT e.dst AS id, min([t.k, e.ord]) AS key, arg_min(relation, [t.k, e.ord]) AS relation FROM t JOIN e ON e.src = t.id WHERE e.dst IN (SELECT id FROM n) AND e.dst NOT IN (SELECT id FROM t) GROUP BY 1), "
    "b AS (SELECT e.dst AS id, arg_min(e.relation, list_append(a.key, e.ord)) AS relation FROM a JOIN e ON e.src = a.id WHERE e.dst IN (SELECT id FROM n) AND e.dst NOT IN (SELECT id FROM t) AND e.dst NOT IN (SELECT id FROM a) GROUP BY 1) "
    "SELECT id, 1::INT AS hop, relation FROM a UNION ALL SELECT id, 2, relation FROM b",
)(lambda g: C.gather_dependencies(g, _FIRST))


def _calls_of_suppliers(g):
    """The graph with suppliers calling their nations, so that calls have two hops."""
    return g.with_edges(g.edges.withColumn("relation", F.when(F.col("src").startswith("supp:"), "calls").otherwise(F.col("relation"))))


_CHANGED = ["supp:1", "supp:2", "nation:3", "func:src/auth/login.rs:check", "func:src/auth/session.rs:render"]
_FAILED_TESTS = ["tests/test_login.py::test_check", "test_login.py::Suite::_check", "src/main.rs::helper", "test_check", "nowhere.py::zzz", "login.rs::unused"]
query(
    "g14_failure_analysis",
    ", c AS (SELECT * FROM n WHERE id IN (" + ", ".join(f"'{x}'" for x in _CHANGED) + ")), x AS (SELECT src, dst, ord FROM (SELECT src, dst, ord, CASE WHEN src LIKE 'supp:%' THEN 'calls' ELSE relation END AS relation FROM e) WHERE relation = 'calls' AND dst IN (SELECT id FROM n)), "
    "t AS (SELECT test, string_split(test, '::')[-1] AS short, CASE WHEN contains(test, '::') THEN string_split(test, '::')[1] ELSE '' END AS file FROM (SELECT DISTINCT p_brand || '/' || p_name || '::' || p_name AS test FROM part UNION SELECT unnest([" + ", ".join(f"'{x}'" for x in _FAILED_TESTS) + "]))), "
    "m AS (SELECT test, id, ord, CASE WHEN file <> '' AND ends_with(coalesce(file_path, ''), file) THEN CASE WHEN title = short THEN 1 ELSE 2 END WHEN title = short THEN 3 ELSE 4 END AS rule FROM t JOIN n ON ends_with(title, short)), "
    "k AS (SELECT test, arg_min(id, [rule, ord]) AS node FROM m GROUP BY test), h AS (SELECT id FROM n WHERE title IN (SELECT title FROM c) OR id IN (SELECT id FROM c)), "
    "d AS (SELECT DISTINCT test, node, dst AS changed FROM k JOIN x ON x.src = node WHERE dst IN (SELECT id FROM h)), "
    "i AS (SELECT test, arg_min(node, [a.ord, b.ord]) AS node, arg_min(b.src, [a.ord, b.ord]) AS via, arg_min(b.dst, [a.ord, b.ord]) AS changed FROM k JOIN x a ON a.src = node JOIN x b ON b.src = a.dst WHERE b.dst IN (SELECT id FROM h) AND test NOT IN (SELECT test FROM d) GROUP BY test), "
    "f AS (SELECT test, arg_min(node, e.ord) AS node, arg_min(e.dst, e.ord) AS changed FROM k JOIN n w ON w.id = k.node JOIN e ON e.src = 'file:' || w.file_path AND e.relation = 'tests_for' JOIN n z ON z.id = e.dst WHERE z.file_path IN (SELECT file_path FROM c) AND test NOT IN (SELECT test FROM d UNION SELECT test FROM i) GROUP BY test) "
    "SELECT test, node, CAST(NULL AS VARCHAR) AS via, changed, 'direct' AS link FROM d UNION ALL SELECT test, node, via, changed, 'indirect' FROM i UNION ALL SELECT test, node, NULL, changed, 'file' FROM f "
    "UNION ALL SELECT test, node, NULL, NULL, CASE WHEN node IS NULL THEN 'unknown' ELSE 'none' END FROM t LEFT JOIN k USING (test) WHERE test NOT IN (SELECT test FROM d UNION SELECT test FROM i UNION SELECT test FROM f)",
)(lambda g: Y.failure_analysis(_calls_of_suppliers(g), _CHANGED, _test_names(g)))


def _test_names(g):
    """A test identifier for each brand and name of a part, and a few of the fixed files."""
    parts = g.nodes.where("id like 'part:%'").select(F.concat(F.element_at(F.split("file_path", "/"), -2), F.lit("/"), "title", F.lit("::"), "title").alias("test"))
    return parts.unionByName(g.nodes.sparkSession.createDataFrame([(x,) for x in _FAILED_TESTS], "test string"))




def _sources(spark, sf_dir):
    """Small Python files made from the part table: one class and two functions each, calling into the file before."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey > 0").select("p_partkey")
    k = F.col("p_partkey").cast("string")
    before = (F.col("p_partkey") - 1).cast("string")
    text = F.concat(F.lit("from f"), before, F.lit(" import run_"), before, F.lit("\n\nclass C"), k, F.lit("(Base):\n    def go(self):\n        return helper_"), k, F.lit("()\n\ndef helper_"), k, F.lit("():\n    try:\n        return run_"), before, F.lit("()\n    except Exception:\n        raise\n\ndef run_"), k, F.lit("():\n    return helper_"), k, F.lit("()\n"))
    return p.select(F.concat(F.lit("src/m"), (F.col("p_partkey") % 5).cast("string"), F.lit("/f"), k, F.lit(".py")).alias("path"), text.alias("content"))


plain("x03_extract_nodes", "SELECT node_type, n FROM (SELECT 'file' AS node_type, (SELECT count(*) FROM part WHERE p_partkey > 0) AS n UNION ALL SELECT 'class', (SELECT count(*) FROM part WHERE p_partkey > 0) UNION ALL SELECT 'method', (SELECT count(*) FROM part WHERE p_partkey > 0) UNION ALL SELECT 'function', (SELECT 2 * count(*) FROM part WHERE p_partkey > 0) UNION ALL SELECT 'module', 6)")(
    lambda spark, d: X.extract_nodes(_sources(spark, d)).groupBy("node_type").agg(F.count(F.lit(1)).alias("n"))
)
plain("x06_call_edges", "SELECT 'method:src/m' || p_partkey % 5 || '/f' || p_partkey || '.py:C' || p_partkey || '.go' AS src, 'func:src/m' || p_partkey % 5 || '/f' || p_partkey || '.py:helper_' || p_partkey AS dst, 0.8::DOUBLE AS confidence FROM part WHERE p_partkey > 0 UNION ALL SELECT 'func:src/m' || p_partkey % 5 || '/f' || p_partkey || '.py:run_' || p_partkey, 'func:src/m' || p_partkey % 5 || '/f' || p_partkey || '.py:helper_' || p_partkey, 0.8 FROM part WHERE p_partkey > 0 UNION ALL SELECT 'func:src/m' || p_partkey % 5 || '/f' || p_partkey || '.py:helper_' || p_partkey, 'func:src/m' || (p_partkey - 1) % 5 || '/f' || (p_partkey - 1) || '.py:run_' || (p_partkey - 1), 0.75 FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part WHERE p_partkey > 0)")(
    lambda spark, d: X.extract(_sources(spark, d))[1].where("relation = 'calls'").select("src", "dst", F.col("confidence").cast("double").alias("confidence"))
)


def _rust_sources(spark, sf_dir):
    """Small Rust files made from the part table: a type with two methods, two functions, calls by every tier."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").where("p_partkey > 0").select("p_partkey")
    k = F.col("p_partkey").cast("string")
    before = (F.col("p_partkey") - 1).cast("string")
    lines = ("use crate::f{b}::run_{b};\n\npub struct S{k};\n\nimpl S{k} {{\n    pub fn go_{k}(&self) -> i32 {{ self.help(); lone_{k}() }}\n    fn help(&self) -> i32 {{ 1 }}\n}}\n\nfn lone_{k}() -> i32 {{\n    run_{b}();\n    S{k}::go_{k}(&S{k})\n}}\n\npub fn run_{k}() -> i32 {{ 0 }}\n").format(k="{k}", b="{b}")
    text = F.replace(F.replace(F.lit(lines), F.lit("{k}"), k), F.lit("{b}"), before)
    return p.select(F.concat(F.lit("src/m"), (F.col("p_partkey") % 5).cast("string"), F.lit("/f"), k, F.lit(".rs")).alias("path"), text.alias("content"))


_AT = "'src/m' || p_partkey % 5 || '/f' || p_partkey || '.rs:'"
plain(
    "x06_rust_calls",
    f"SELECT 'method:' || {_AT} || 'S' || p_partkey || '.go_' || p_partkey AS src, 'method:' || {_AT} || 'S' || p_partkey || '.help' AS dst, 0.9::DOUBLE AS confidence FROM part WHERE p_partkey > 0 UNION ALL SELECT 'method:' || {_AT} || 'S' || p_partkey || '.go_' || p_partkey, 'func:' || {_AT} || 'lone_' || p_partkey, 0.9 FROM part WHERE p_partkey > 0 "
    f"UNION ALL SELECT 'func:' || {_AT} || 'lone_' || p_partkey, 'method:' || {_AT} || 'S' || p_partkey || '.go_' || p_partkey, 0.95 FROM part WHERE p_partkey > 0 UNION ALL SELECT 'func:' || {_AT} || 'lone_' || p_partkey, 'func:src/m' || (p_partkey - 1) % 5 || '/f' || (p_partkey - 1) || '.rs:run_' || (p_partkey - 1), 0.8 FROM part WHERE p_partkey - 1 IN (SELECT p_partkey FROM part WHERE p_partkey > 0)",
)(lambda spark, d: X.extract(_rust_sources(spark, d))[1].where("relation = 'calls'").select("src", "dst", F.col("confidence").cast("double").alias("confidence")))
plain("x12_grep", "SELECT 'helper_' || p_partkey AS name, 'src/m' || p_partkey % 5 || '/f' || p_partkey || '.py' AS path, 7 AS line, 'function' AS kind FROM part WHERE p_partkey IN (3, 8) UNION ALL SELECT 'C5', 'src/m0/f5.py', 3, 'class'")(
    lambda spark, d: X.grep_identifiers(_sources(spark, d), build_graph(spark, d).nodes, ["helper_3", "helper_8", "C5", "nowhere", "Login"])
)
plain("x07_module_nodes", "SELECT 'module:src' AS id UNION ALL SELECT 'module:src/m' || k FROM range(5) t(k)")(lambda spark, d: X.extract_nodes(_sources(spark, d)).where("node_type = 'module'").select("id"))
plain("x02_file_delta", "SELECT change, n FROM (SELECT 'unchanged' AS change, (SELECT count(*) FROM part WHERE p_partkey % 10 > 1) AS n UNION ALL SELECT 'modified', (SELECT count(*) FROM part WHERE p_partkey % 10 = 1) UNION ALL SELECT 'deleted', (SELECT count(*) FROM part WHERE p_partkey > 0 AND p_partkey % 10 = 0)) WHERE n > 0")(
    lambda spark, d: file_delta(_sources(spark, d).select("path", F.sha2("content", 256).alias("content_hash")), _sources(spark, d).where("not path like '%0.py'").select("path", F.when(F.col("path").like("%1.py"), F.lit("new")).otherwise(F.sha2("content", 256)).alias("content_hash"))).groupBy("change").agg(F.count(F.lit(1)).alias("n"))
)


def _streamed(spark, sf_dir, make, mode):
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex[:8]}"
    atexit.register(forget, spark, folder)
    return E.run_to_table(make(E.table_stream(spark, sf_dir)), f"{folder}/out", f"{folder}/state", mode)


plain("st_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")(
    lambda spark, d: _streamed(spark, d, lambda s: E.daily_counts(s).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "kind", "n"), "complete")
)
plain(
    "st_sessions",
    "WITH s AS (SELECT user_id AS user, ts, coalesce(ts > lag(ts) OVER w + INTERVAL 30 MINUTE, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), k AS (SELECT *, sum(new) OVER (PARTITION BY user ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) "
    "SELECT user, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS \"end\", count(*) AS n FROM k GROUP BY user, k",
)(lambda spark, d: _streamed(spark, d, lambda s: E.sessions(s).select("user", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("end"), "n"), "complete"))
