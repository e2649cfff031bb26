"""A deterministic graph view of the star-schema tables, as one SQL text for Spark and for the oracle alike."""

from __future__ import annotations

from pyspark.sql import SparkSession

from graphloom.graph import Graph
from graphloom.lineage import cut, measured_joins, small_tasks

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "conversations")

NODES = """
SELECT base.*,
CASE WHEN id LIKE 'region:%' OR id LIKE 'nation:1%' OR id = 'feat:auth' THEN 'About ' || title END AS description,
CASE id WHEN 'lay:mixed' THEN '{"layer":"infrastructure"}' WHEN 'lay:late' THEN '{"layer":"data"}' WHEN 'feat:auth' THEN '{"code_paths":["src/db/pool.rs","src/none.rs"],"design_doc":"auth"}' WHEN 'task:login' THEN '{"design_ref":"3.2","satisfies":["GOAL-1.1","GOAL-9","GOAL-2"],"verify":"make test","estimated_turns":7}' WHEN 'task:y2' THEN '{"design_ref":"1","satisfies":["GOAL-7"]}' END AS metadata,
CASE id WHEN 'func:src/db/pool.rs:open' THEN 'pub fn open()' WHEN 'class:src/auth/session.rs:Base' THEN 'trait Base' WHEN 'func:src/auth/login.rs:check' THEN 'fn check()' END AS signature
FROM (
SELECT 'region:' || r_regionkey AS id, r_name AS title, 'todo' AS status, 'component' AS node_type, 'Module' AS node_kind, CAST(NULL AS VARCHAR(10)) AS source, CAST(NULL AS VARCHAR(10)) AS file_path, CAST(r_regionkey AS BIGINT) AS ord FROM region
UNION ALL SELECT 'nation:' || n_nationkey, n_name, 'todo', 'component', 'Module', NULL, NULL, 1000000000 + CAST(n_nationkey AS BIGINT) FROM nation
UNION ALL SELECT 'cust:' || c_custkey, c_name, 'todo', 'component', 'Class', NULL, NULL, 2000000000 + c_custkey FROM customer
UNION ALL SELECT 'supp:' || s_suppkey, s_name, 'todo', 'component', 'Class', 'extract', NULL, 3000000000 + s_suppkey FROM supplier
UNION ALL SELECT 'part:' || p_partkey, p_name, 'todo', 'function', 'Function', 'extract', lower(p_type) || '/' || p_brand || '/' || p_name, 4000000000 + p_partkey FROM part
UNION ALL SELECT 'order:' || o_orderkey, 'Order ' || o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'todo' WHEN o_orderpriority = '5-LOW' THEN 'blocked' ELSE 'in_progress' END, 'task', 'Constant', NULL, NULL, 5000000000 + o_orderkey FROM orders
UNION ALL SELECT * FROM (VALUES
('task:x1', 'Cycle one', 'todo', 'task', 'Constant', NULL, NULL, 9000000001),
('task:x2', 'Cycle two', 'todo', 'task', 'Constant', NULL, NULL, 9000000002),
('task:x3', 'Cycle three', 'todo', 'task', 'Constant', NULL, NULL, 9000000003),
('comp:alone', 'Alone', 'todo', 'component', 'Module', NULL, NULL, 9000000004),
('comp:alone', 'Alone again', 'done', 'component', 'Module', 'infer', NULL, 9000000005),
('lay:ui', 'Screens', 'todo', 'presentation', 'Module', NULL, NULL, 9000000100),
('lay:api', 'Endpoints', 'in_progress', 'service', 'Module', NULL, NULL, 9000000101),
('lay:rules', 'Rules', 'todo', 'business', 'Module', NULL, NULL, 9000000102),
('lay:store', 'Store', 'blocked', 'data', 'Module', NULL, NULL, 9000000103),
('lay:mixed', 'Mixed', 'todo', 'component', 'Module', NULL, NULL, 9000000104),
('lay:late', 'Late', 'todo', 'domain', 'Module', NULL, NULL, 9000000105),
('task:y1', 'First step', 'in_progress', 'task', 'Constant', NULL, NULL, 9000000106),
('task:y2', 'Second step', 'todo', 'task', 'Constant', NULL, NULL, 9000000107),
('task:login', 'Write login', 'todo', 'task', 'Constant', NULL, NULL, 9000000108),
('feat:auth', 'Authentication Feature', 'todo', 'feature', 'Module', NULL, NULL, 9000000109),
('file:src/main.rs', 'main.rs', 'done', 'file', 'File', 'extract', 'src/main.rs', 9000000110),
('file:src/auth/login.rs', 'login.rs', 'done', 'file', 'File', 'extract', 'src/auth/login.rs', 9000000111),
('file:src/auth/session.rs', 'session.rs', 'done', 'file', 'File', 'extract', 'src/auth/session.rs', 9000000112),
('file:src/db/pool.rs', 'pool.rs', 'done', 'file', 'File', 'extract', 'src/db/pool.rs', 9000000113),
('file:src/db/query.rs', 'query.rs', 'done', 'file', 'File', 'extract', 'src/db/query.rs', 9000000114),
('file:tests/test_login.py', 'test_login.py', 'done', 'file', 'File', 'extract', 'tests/test_login.py', 9000000115),
('class:src/auth/login.rs:Login', 'Login', 'done', 'class', 'Class', 'extract', 'src/auth/login.rs', 9000000116),
('class:src/auth/session.rs:Base', 'Base', 'done', 'class', 'Class', 'extract', 'src/auth/session.rs', 9000000117),
('class:src/db/pool.rs:Pool', 'Pool', 'done', 'class', 'Class', 'extract', 'src/db/pool.rs', 9000000118),
('func:src/main.rs:helper', 'helper', 'done', 'function', 'Function', 'extract', 'src/main.rs', 9000000119),
('func:src/auth/login.rs:check', 'check', 'done', 'function', 'Function', 'extract', 'src/auth/login.rs', 9000000120),
('func:src/auth/login.rs:unused', 'unused', 'done', 'function', 'Function', 'extract', 'src/auth/login.rs', 9000000121),
('func:src/auth/login.rs:render', 'render', 'done', 'function', 'Function', 'extract', 'src/auth/login.rs', 9000000122),
('func:src/auth/session.rs:render', 'render', 'done', 'function', 'Function', 'extract', 'src/auth/session.rs', 9000000123),
('func:src/db/pool.rs:cmd_run', 'cmd_run', 'done', 'function', 'Function', 'extract', 'src/db/pool.rs', 9000000124),
('func:src/db/pool.rs:on_event_hook', 'on_event_hook', 'done', 'function', 'Function', 'extract', 'src/db/pool.rs', 9000000125),
('func:src/db/pool.rs:default_port', 'default_port', 'done', 'function', 'Function', 'extract', 'src/db/pool.rs', 9000000126),
('func:src/db/pool.rs:__repr__', '__repr__', 'done', 'function', 'Function', 'extract', 'src/db/pool.rs', 9000000127),
('func:src/db/pool.rs:clone', 'clone', 'done', 'function', 'Function', 'extract', 'src/db/pool.rs', 9000000128),
('func:src/db/pool.rs:open', 'open', 'done', 'function', 'Function', 'extract', 'src/db/pool.rs', 9000000129),
('func:src/db/query.rs:lost', 'lost', 'done', 'function', 'Function', 'extract', 'src/db/query.rs', 9000000130),
('func:src/db/query.rs:clone', 'clone', 'done', 'function', 'Function', 'extract', 'src/db/query.rs', 9000000131),
('func:tests/test_login.py:test_check', 'test_check', 'done', 'function', 'Function', 'extract', 'tests/test_login.py', 9000000132),
('method:src/db/pool.rs:Pool.take', 'take', 'done', 'method', 'Function', 'extract', 'src/db/pool.rs', 9000000133)
) AS fixed(id, title, status, node_type, node_kind, source, file_path, ord)
) AS base
"""
EDGES = """
SELECT 'nation:' || n_nationkey AS src, 'region:' || n_regionkey AS dst, 'belongs_to' AS relation, CAST(1.0 AS DOUBLE) AS weight, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR(12)) AS edge_source, 1 AS call_count, false AS in_error_path, CAST(n_nationkey AS BIGINT) AS ord FROM nation
UNION ALL SELECT 'cust:' || c_custkey, 'nation:' || c_nationkey, 'belongs_to', 1.0, NULL, NULL, 1, false, 1000000000 + c_custkey FROM customer
UNION ALL SELECT 'supp:' || s_suppkey, 'nation:' || s_nationkey, 'belongs_to', 1.0, NULL, 'extract', 1, false, 2000000000 + s_suppkey FROM supplier
UNION ALL SELECT 'part:' || l_partkey, 'supp:' || l_suppkey, 'calls', 1.0, CASE max(l_returnflag) WHEN 'A' THEN 0.9 WHEN 'R' THEN 0.6 END, 'extract', CAST(count(*) AS INT), max(l_linestatus) = 'O', 3000000000000 + l_partkey * 1000000 + l_suppkey FROM lineitem GROUP BY l_partkey, l_suppkey
UNION ALL SELECT DISTINCT 'order:' || l_orderkey, 'part:' || l_partkey, 'uses', CAST(1.0 AS DOUBLE), CAST(NULL AS DOUBLE), 'auto-bridge', 1, false, 4000000000000000 + l_orderkey * 10000000 + l_partkey FROM lineitem
UNION ALL SELECT 'order:' || o_orderkey, 'order:' || before_, 'depends_on', 1.0, NULL, NULL, 1, false, 5000000000 + o_orderkey FROM (SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before_ FROM orders) AS chained WHERE before_ IS NOT NULL
UNION ALL SELECT 'nation:1', 'region:' || n_regionkey, 'belongs_to', 0.5, 0.7, NULL, 1, false, 9000000007 FROM nation WHERE n_nationkey = 1
UNION ALL SELECT * FROM (VALUES
('task:x1', 'task:x2', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000001),
('task:x2', 'task:x3', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000002),
('task:x3', 'task:x1', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000003),
('order:1', 'order:ghost', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000004),
('ghost:part', 'supp:1', 'calls', 1.0, 0.95, 'extract', 1, false, 9000000005),
('task:x1', 'task:x1', 'uses', 1.0, NULL, NULL, 1, false, 9000000006),
('lay:store', 'lay:ui', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000100),
('lay:rules', 'lay:api', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000101),
('lay:ui', 'lay:api', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000102),
('lay:mixed', 'lay:rules', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000103),
('lay:late', 'lay:store', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000104),
('lay:late', 'lay:mixed', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000105),
('task:y2', 'task:y1', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000106),
('task:login', 'feat:auth', 'implements', 1.0, NULL, NULL, 1, false, 9000000107),
('class:src/auth/login.rs:Login', 'class:src/auth/session.rs:Base', 'inherits', 1.0, NULL, 'extract', 1, false, 9000000108),
('class:src/db/pool.rs:Pool', 'class:src/auth/session.rs:Base', 'inherits', 1.0, NULL, 'extract', 1, false, 9000000109),
('func:src/auth/login.rs:check', 'class:src/auth/login.rs:Login', 'defined_in', 1.0, NULL, 'extract', 1, false, 9000000110),
('func:src/auth/login.rs:render', 'class:src/auth/login.rs:Login', 'defined_in', 1.0, NULL, 'extract', 1, false, 9000000111),
('func:src/auth/session.rs:render', 'class:src/auth/session.rs:Base', 'defined_in', 1.0, NULL, 'extract', 1, false, 9000000112),
('func:src/auth/login.rs:unused', 'file:src/auth/login.rs', 'defined_in', 1.0, NULL, 'extract', 1, false, 9000000113),
('func:src/db/pool.rs:clone', 'file:src/db/pool.rs', 'defined_in', 1.0, NULL, 'extract', 1, false, 9000000114),
('method:src/db/pool.rs:Pool.take', 'class:src/db/pool.rs:Pool', 'defined_in', 1.0, NULL, 'extract', 1, false, 9000000115),
('func:src/auth/session.rs:render', 'func:src/auth/login.rs:render', 'overrides', 1.0, NULL, 'extract', 1, false, 9000000116),
('func:tests/test_login.py:test_check', 'func:src/auth/login.rs:check', 'calls', 1.0, NULL, 'extract', 1, false, 9000000117),
('func:src/main.rs:helper', 'func:src/db/pool.rs:open', 'calls', 1.0, NULL, 'extract', 1, false, 9000000118),
('file:src/main.rs', 'file:src/auth/login.rs', 'imports', 1.0, NULL, 'extract', 1, false, 9000000119),
('file:src/main.rs', 'file:src/auth/session.rs', 'imports', 1.0, NULL, 'extract', 1, false, 9000000120),
('file:src/auth/login.rs', 'file:src/auth/session.rs', 'imports', 1.0, NULL, 'extract', 1, false, 9000000121),
('file:src/auth/session.rs', 'file:src/auth/login.rs', 'imports', 1.0, NULL, 'extract', 1, false, 9000000122),
('file:src/db/pool.rs', 'file:src/db/query.rs', 'imports', 1.0, NULL, 'extract', 1, false, 9000000123),
('file:src/db/query.rs', 'file:src/db/pool.rs', 'imports', 1.0, NULL, 'extract', 1, false, 9000000124),
('file:tests/test_login.py', 'file:src/auth/login.rs', 'tests_for', 1.0, NULL, 'extract', 1, false, 9000000125),
('task:login', 'feat:auth', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000126),
('task:login', 'lay:late', 'depends_on', 1.0, NULL, NULL, 1, false, 9000000127)
) AS fixed(src, dst, relation, weight, confidence, edge_source, call_count, in_error_path, ord)
"""
#: Prefix of every oracle.
CTE = f"WITH RECURSIVE n AS ({NODES}), e AS ({EDGES})"


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for t in names or TABLES:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


_BUILT: dict[tuple[str, str], tuple[tuple, Graph]] = {}


def _stamp(spark: SparkSession, paths: list[str]) -> tuple:
    """Name, size and time of every file below some paths, on whatever file system they are."""
    found = []
    for path in paths:
        root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(root, True)
        while files.hasNext():
            f = files.next()
            found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


def build_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of a folder's tables, written to the shared folder once for each application, so that no traversal works out
    its edges anew in every hop; anew if a file of the tables has changed since."""
    measured_joins(spark)
    small_tasks(spark)
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
    key, stamp = (spark.sparkContext.applicationId, sf_dir), _stamp(spark, [f"{sf_dir}/{t}.parquet" for t in names])
    if key not in _BUILT or _BUILT[key][0] != stamp:
        views(spark, sf_dir, *names)
        _BUILT[key] = stamp, Graph(cut(spark.sql(NODES), "nodes"), cut(spark.sql(EDGES), "edges"))
    return _BUILT[key][1]
