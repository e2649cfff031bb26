"""Queries: set operations, mutations, projection, search, text functions, event logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphloom.functions import text as X
from graphloom.graph import Graph
from graphloom.operators import aggregates as A
from graphloom.operators import mutate as M
from graphloom.operators import projection as P
from graphloom.operators import scans as S
from graphloom.operators import search as R
from graphloom.operators.reports import key_traceback
from graphloom.operators import setops as U
from graphloom.operators import traverse as G
from graphloom.sources.graph_view import CTE, build_graph

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(build_graph(spark, sf_dir))
        if sql:
            SQL[name] = f"{CTE} {sql}"
        return fn

    return add


def on(table: str, name: str, sql: str | None = None):
    """Registers fn(frame) over one of the driver's tables."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
        if sql:
            SQL[name] = sql
        return fn

    return add


def _later(g: Graph) -> Graph:
    """A second snapshot: order 3 gone, order 4 done, regions renamed, one edge gone."""
    nodes = g.nodes.where("id <> 'order:3'").withColumn("status", F.when(F.col("id") == "order:4", "done").otherwise(F.col("status")))
    nodes = nodes.withColumn("title", F.when(F.col("id").startswith("region:"), F.concat(F.lit("The "), "title")).otherwise(F.col("title"))).where("id <> 'comp:alone'")
    return Graph(nodes, g.edges.where("not (src = 'task:x1' and dst = 'task:x2')"))


_OLD = "o AS (SELECT * FROM n WHERE id <> 'comp:alone'), w AS (SELECT id, CASE WHEN id LIKE 'region:%' THEN 'The ' || title ELSE title END AS title, CASE WHEN id = 'order:4' THEN 'done' ELSE status END AS status FROM o WHERE id <> 'order:3')"
query("u02_snapshot_diff", f", {_OLD} SELECT CASE WHEN o.id IS NULL THEN 'node_added' WHEN w.id IS NULL THEN 'node_removed' ELSE 'node_modified' END AS kind, coalesce(o.id, w.id) AS what FROM o FULL OUTER JOIN w ON o.id = w.id WHERE o.id IS NULL OR w.id IS NULL OR o.title IS DISTINCT FROM w.title OR o.status IS DISTINCT FROM w.status UNION ALL SELECT 'edge_removed', 'task:x1 depends_on task:x2'")(
    lambda g: U.diff(Graph(g.nodes.where("id <> 'comp:alone'"), g.edges), _later(g))
)
on("documents", "u03_file_delta", "WITH a AS (SELECT 'doc/' || doc_id AS path, md5(text) AS h FROM documents WHERE doc_id % 10 <> 0), b AS (SELECT 'doc/' || doc_id AS path, CASE WHEN doc_id % 7 = 0 THEN md5(upper(lang)) ELSE md5(text) END AS h FROM documents WHERE doc_id % 10 <> 1) SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'deleted' WHEN a.h IS NOT DISTINCT FROM b.h THEN 'unchanged' ELSE 'modified' END AS change FROM a FULL OUTER JOIN b ON a.path = b.path")(
    lambda d: U.file_delta(
        d.where("doc_id % 10 <> 0").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.md5("text").alias("content_hash")),
        d.where("doc_id % 10 <> 1").select(F.concat(F.lit("doc/"), "doc_id").alias("path"), F.when(F.col("doc_id") % 7 == 0, F.md5(F.upper("lang"))).otherwise(F.md5("text")).alias("content_hash")),
    )
)
query("u05_replace_code_layer", ", k AS (SELECT id FROM n WHERE source IS DISTINCT FROM 'extract' UNION ALL SELECT 'supp:1' UNION ALL SELECT 'supp:2') SELECT relation, count(*) AS n FROM e WHERE coalesce(edge_source, '') NOT IN ('extract', 'auto-bridge') GROUP BY relation")(
    lambda g: U.replace_code_layer(g, g.nodes.where("id in ('supp:1', 'supp:2')"), g.edges.limit(0)).edges.groupBy("relation").agg(F.count(F.lit(1)).alias("n"))
)
query("u06_replace_project_layer", "SELECT coalesce(source, 'project') AS source, count(*) AS n FROM n WHERE source = 'extract' OR id LIKE 'region:%' GROUP BY 1")(
    lambda g: U.replace_project_layer(g, g.nodes.where("id like 'region:%'"), g.edges.limit(0)).nodes.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
)
query("u10_merge_inference", "SELECT 'b1' AS infer_batch, 1::BIGINT AS n UNION ALL SELECT NULL, count(*) FROM n WHERE source IS DISTINCT FROM 'infer'")(
    lambda g: U.merge_inference(g, g.nodes.where("id = 'region:1'").withColumn("id", F.lit("infer:1")), g.edges.limit(0), "b1").nodes.groupBy("infer_batch").agg(F.count(F.lit(1)).alias("n"))
)
query("u11_rollback_batch", "SELECT count(*) AS n FROM n WHERE source IS DISTINCT FROM 'infer'")(
    lambda g: U.rollback_batch(U.merge_inference(g, g.nodes.where("id = 'region:1'").withColumn("id", F.lit("infer:1")), g.edges.limit(0), "b1"), "b1").nodes.agg(F.count(F.lit(1)).alias("n"))
)
query(
    "j12_bridge_edges",
    ", x AS (SELECT DISTINCT p.id AS src, c.id AS dst FROM n p JOIN n c ON c.source = 'extract' AND list_contains(CAST(json_extract(p.metadata, '$.code_paths') AS VARCHAR[]), c.file_path) WHERE p.source IS NULL), "
    "s AS (SELECT DISTINCT dst, lower(split_part(part, '.', 1)) AS seg FROM (SELECT id AS dst, unnest(string_split(CASE WHEN contains(id, ':') THEN split_part(id, ':', 2) ELSE id END, '/')) AS part FROM n WHERE source = 'extract' AND id NOT IN (SELECT dst FROM x)) "
    "WHERE part NOT IN ('src', 'lib', 'mod.rs', 'index.ts', 'index.js') AND split_part(part, '.', 1) NOT IN ('', 'main', 'mod', 'index')), "
    "u AS (SELECT DISTINCT seg FROM s), m AS (SELECT u.seg, p.id AS src FROM u JOIN (SELECT DISTINCT id FROM n WHERE source IS NULL) p ON contains(lower(p.id), u.seg)), "
    "b AS (SELECT src, dst, 1.0::DOUBLE AS confidence FROM x UNION SELECT DISTINCT m.src, s.dst, 0.8 FROM s JOIN m USING (seg)) SELECT dst, confidence, count(*) AS n, min(src) AS first_src, max(src) AS last_src FROM b GROUP BY dst, confidence",
)(lambda g: U.bridge_edges(g).groupBy("dst", "confidence").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("first_src"), F.max("src").alias("last_src")))

_E3 = ["src", "dst", "relation"]
query("m02_remove_node", "SELECT (SELECT count(*) FROM n WHERE id <> 'nation:2') AS n_nodes, (SELECT count(*) FROM e WHERE src <> 'nation:2' AND dst <> 'nation:2') AS n_edges")(
    lambda g: (lambda h: h.nodes.agg(F.count(F.lit(1)).alias("n_nodes")).join(F.broadcast(h.edges.agg(F.count(F.lit(1)).alias("n_edges")))))(M.remove_node(g, "nation:2"))
)
query("m01_add_node", "SELECT id, title FROM n WHERE id LIKE 'region:%' UNION ALL SELECT 'region:new', 'New'")(lambda g: M.add_node(M.add_node(g, id="region:new", title="New", ord=1), id="region:1", title="Ignored", ord=2).nodes.where("id like 'region:%'").select("id", "title"))
query("m03_edges", "SELECT src, dst, relation FROM e WHERE src LIKE 'task:%' AND NOT (src = 'task:x1' AND dst = 'task:x2') UNION ALL SELECT 'task:x1', 'region:1', 'blocks'")(
    lambda g: M.remove_edge(M.add_edge(g, src="task:x1", dst="region:1", relation="blocks", ord=7), "task:x1", "task:x2").edges.where("src like 'task:%'").select(_E3)
)
query("m04_update_status", "SELECT CASE WHEN id = 'order:9' THEN 'done' ELSE status END AS status, count(*) AS n FROM n GROUP BY 1")(lambda g: M.update_status(g, "order:9", "done").nodes.groupBy("status").agg(F.count(F.lit(1)).alias("n")))
query("m07_upsert", "SELECT id, CASE WHEN id = 'region:2' THEN 'Second' ELSE title END AS title FROM n WHERE id LIKE 'region:%'")(
    lambda g: M.upsert_nodes(g, g.nodes.where("id = 'region:2'").withColumn("title", F.lit("Second"))).nodes.where("id like 'region:%'").select("id", "title")
)
query("m09_rename", "SELECT src, CASE WHEN dst = 'nation:3' THEN 'nation:three' ELSE dst END AS dst, relation FROM e WHERE relation = 'belongs_to' AND src <> 'nation:3' UNION ALL SELECT 'nation:three', dst, relation FROM e WHERE src = 'nation:3'")(
    lambda g: M.rename(g, "nation:3", "nation:three").edges.where("relation = 'belongs_to'").select(_E3)
)
query("m10_merge", ", t AS (SELECT CASE WHEN src IN ('nation:4', 'nation:5') THEN 'nation:45' ELSE src END AS src, CASE WHEN dst IN ('nation:4', 'nation:5') THEN 'nation:45' ELSE dst END AS dst, relation FROM e) SELECT DISTINCT src, dst, relation FROM t WHERE src <> dst AND 'nation:45' IN (src, dst)")(
    lambda g: M.merge(g, "nation:4", "nation:5", "nation:45").edges.where("src = 'nation:45' or dst = 'nation:45'").select(_E3)
)
query("m10_merged_node", ", p AS (SELECT n.*, (s_suppkey % 2)::INT AS second, s_suppkey // 2 AS pair FROM n JOIN supplier ON id = 'supp:' || s_suppkey WHERE s_suppkey IN (6, 7)) SELECT 'task-both' AS id, string_agg(title, ' + ' ORDER BY second) AS title, string_agg('On ' || title, chr(10) || chr(10) ORDER BY second) AS description, 'in_progress' AS status, array_to_string(list_sort(list_distinct(['b', 'z'] || list(title))), ',') AS tags, CAST(NULL AS VARCHAR) AS file_path FROM p")(
    lambda g: M.merge(g.with_nodes(g.nodes.withColumns({"description": F.concat(F.lit("On "), "title"), "tags": F.array(F.lit("z"), "title", F.lit("b")), "status": F.when(F.col("id") == "supp:7", "in_progress").otherwise(F.col("status"))})), "supp:6", "supp:7", "task-both")
    .nodes.where("id = 'task-both'")
    .select("id", "title", "description", "status", F.array_join("tags", ",").alias("tags"), "file_path")
)
query("m11_split", "SELECT 'region:1a' AS id, title FROM n WHERE id = 'region:1' UNION ALL SELECT 'region:1b', title FROM n WHERE id = 'region:1'")(lambda g: M.split(g, "region:1", ["region:1a", "region:1b"]).nodes.where("id like 'region:1_'").select("id", "title"))
query("m12_extract_parent", "SELECT 'mod:top' AS src, 'region:0' AS dst, 'contains' AS relation UNION ALL SELECT 'mod:top', 'region:1', 'contains'")(lambda g: M.extract_parent(g, "mod:top", "Top", ["region:0", "region:1"]).edges.where("relation = 'contains'").select(_E3))
query("m06_batch_edit", "SELECT status, count(*) AS n FROM n WHERE id <> 'region:0' GROUP BY status UNION ALL SELECT 'blocked!', 1")(
    lambda g: M.apply_edits(g, [{"op": "remove_node", "node_id": "region:0"}, {"op": "add_node", "id": "task:new", "status": "blocked!", "ord": 5}]).nodes.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
)

_OWN = "w AS (SELECT id, CASE WHEN id LIKE 'part:%' THEN 'file:' || split_part(file_path, '/', 1) || '/' || split_part(file_path, '/', 2) WHEN id LIKE 'supp:%' THEN 'file:' || id WHEN id LIKE 'nation:%' THEN 'file:' || id END AS file FROM n WHERE id LIKE 'part:%' OR id LIKE 'supp:%' OR id LIKE 'nation:%')"


def _owners(g: Graph):
    part = F.concat(F.lit("file:"), F.substring_index("file_path", "/", 2))
    return g.nodes.select("id", F.when(F.col("id").startswith("part:"), part).when(F.col("id").startswith("supp:") | F.col("id").startswith("nation:"), F.concat(F.lit("file:"), "id")).alias("file")).where("file is not null")


query("j04_entity_files", "SELECT DISTINCT id, 'file:' || file_path AS file FROM n WHERE file_path IS NOT NULL")(P.entity_files)
query("a08_file_network", f", {_OWN} SELECT a.file AS a, b.file AS b, round(sum(CASE relation WHEN 'calls' THEN 1.0 WHEN 'belongs_to' THEN 0.2 WHEN 'uses' THEN 0.5 ELSE 0.4 END * least(greatest(coalesce(confidence, 1.0), 0.0), 1.0)), 6) AS weight FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst WHERE a.file <> b.file GROUP BY 1, 2")(
    lambda g: P.file_network(g.edges, _owners(g)).select("a", "b", F.round("weight", 6).alias("weight"))
)
query("a10_co_citation", f""", {_OWN}, f AS (SELECT a.file AS a, b.file AS b, relation, least(greatest(coalesce(confidence, 1.0), 0.0), 1.0) AS c FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst WHERE a.file <> b.file),
c AS (SELECT a AS citer, b AS dst, max(c) AS c FROM f WHERE relation IN ('imports', 'calls', 'uses', 'type_reference', 'depends_on') AND c >= 0.7 GROUP BY 1, 2),
p AS (SELECT x.dst AS a, y.dst AS b, count(*) AS citers, avg(sqrt(x.c * y.c)) AS t FROM c x JOIN c y ON x.citer = y.citer AND x.dst < y.dst GROUP BY 1, 2 HAVING count(*) >= 2),
k AS (SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b FROM f WHERE relation IN ('calls', 'imports', 'uses', 'type_reference') AND c >= 0.9)
SELECT a, b, citers, round(least(2.0, 0.4 * citers * t), 6) AS weight FROM p WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.a = p.a AND k.b = p.b)""")(
    lambda g: P.co_citation(g.edges, _owners(g)).select("a", "b", "citers", F.round("weight", 6).alias("weight"))
)
query("a13_hubs", f", {_OWN}, d AS (SELECT b.file, count(*) AS degree FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst WHERE a.file <> b.file GROUP BY 1) SELECT file, degree FROM d WHERE degree > greatest(ceil((SELECT count(DISTINCT file) FROM w) * 0.05), 10)")(lambda g: P.hubs(g.edges, _owners(g)))
query("i03_hub_removal", f", {_OWN}, d AS (SELECT b.file, count(*) AS degree FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst WHERE a.file <> b.file GROUP BY 1), h AS (SELECT file FROM d WHERE degree > greatest(ceil((SELECT count(DISTINCT file) FROM w) * 3.0), 10)) SELECT DISTINCT a.file AS a, b.file AS b FROM e JOIN w a ON a.id = e.src JOIN w b ON b.id = e.dst WHERE a.file <> b.file AND a.file NOT IN (SELECT file FROM h) AND b.file NOT IN (SELECT file FROM h)")(
    lambda g: P.without(P.file_network(g.edges, _owners(g)), P.hubs(g.edges, _owners(g), share=3.0)).select("a", "b")
)
_BY_PATH = "f AS (SELECT DISTINCT id, 'file:' || file_path AS file FROM n WHERE file_path IS NOT NULL), net AS (SELECT DISTINCT a.file AS a, b.file AS b FROM e JOIN f a ON a.id = e.src JOIN f b ON b.id = e.dst WHERE a.file <> b.file)"
query("a12_co_location", f", {_BY_PATH}, g AS (SELECT DISTINCT file, regexp_replace(substr(file, 6), '/[^/]*$', '') AS dir FROM f WHERE file NOT IN (SELECT a FROM net UNION SELECT b FROM net)) SELECT a.file AS a, b.file AS b, 0.3::DOUBLE AS weight FROM g a JOIN g b ON a.dir = b.dir AND a.file < b.file")(
    lambda g: P.co_location(P.entity_files(g), P.file_network(g.edges, P.entity_files(g)))
)
on("part", "a11_token_similarity", "WITH k AS (SELECT p_partkey::VARCHAR AS owner, unnest(list_distinct(list_filter(string_split('part' || (p_partkey // 7) || '_kind' || (p_partkey // 11) || '_' || replace(p_name, ' ', '_') || '_get_new_request', '_'), lambda x: x NOT IN ('get', 'new', 'request')))) AS token FROM part), t AS (SELECT owner, count(*) AS n FROM k GROUP BY owner), r AS (SELECT token FROM k GROUP BY token HAVING count(*) <= 200), p AS (SELECT a.owner AS a, b.owner AS b, count(*) AS shared FROM k a JOIN k b ON a.token = b.token AND a.owner < b.owner WHERE a.token IN (SELECT token FROM r) GROUP BY 1, 2 HAVING count(*) >= 2), u AS (SELECT a.owner AS a, b.owner AS b, count(*) AS every FROM k a JOIN k b ON a.token = b.token AND a.owner < b.owner GROUP BY 1, 2) SELECT p.a, p.b, shared, round(0.5 * shared / (x.n + y.n - every), 6) AS weight FROM p JOIN u ON u.a = p.a AND u.b = p.b JOIN t x ON x.owner = p.a JOIN t y ON y.owner = p.b WHERE shared / (x.n + y.n - every) >= 0.15")(
    lambda d: P.token_similarity(d.select(F.col("p_partkey").cast("string").alias("owner"), F.concat(F.lit("part"), F.floor(F.col("p_partkey") / 7).cast("string"), F.lit("_kind"), F.floor(F.col("p_partkey") / 11).cast("string"), F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_getNewRequest")).alias("name"))).select("a", "b", "shared", F.round("weight", 6).alias("weight"))
)

on("documents", "r01_search", "WITH w AS (SELECT doc_id AS key, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents), h AS (SELECT key, len(w) AS length, len(list_filter(range(1, len(w)), lambda i: w[i] = 'and' AND w[i + 1] = 'the')) AS hits FROM w), s AS (SELECT count(*) AS n_docs, avg(length) AS mean, count(*) FILTER (hits > 0) AS df FROM h) SELECT key, hits, round(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * hits * 2.2 / (hits + 1.2 * (0.25 + 0.75 * length / mean)), 4) AS score FROM h, s WHERE hits > 0")(
    lambda d: R.search(d, "doc_id", "and the", "text").select("key", "hits", F.round("score", 4).alias("score"))
)
on("documents", "r01_postings", "SELECT term, count(*) AS n FROM (SELECT unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM documents) GROUP BY term")(lambda d: R.postings(d, "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("n")))
_WORDS = ("order 1", "cycle", "login", "querying")
_HAS = [f"(contains(lower(id), '{w}') OR contains(t, '{w}') OR contains(lower(coalesce(file_path, '')), '{w}') OR (length(t) >= 5 AND contains('{w}', regexp_replace(t, '^_+', ''))))" for w in _WORDS]
_LIKE = " OR ".join(f"contains(t, '{w}') OR contains('{w}', t)" for w in _WORDS)
query(
    "g17_relevant_nodes",
    f""", v AS (SELECT *, lower(coalesce(title, '')) AS t FROM n), m AS (SELECT id, ({' + '.join(f'{h}::INT' for h in _HAS)})::INT AS score FROM v WHERE {' OR '.join(_HAS)}),
f1 AS (SELECT DISTINCT file_path AS p FROM n WHERE id IN (SELECT id FROM m) AND file_path IS NOT NULL), a1 AS (SELECT DISTINCT id FROM n WHERE file_path IN (SELECT p FROM f1) AND id NOT IN (SELECT id FROM m)),
s1 AS (SELECT id FROM m UNION SELECT id FROM a1), cl AS (SELECT DISTINCT id FROM n WHERE id IN (SELECT id FROM s1) AND (coalesce(lower(node_kind) = 'class', false) OR coalesce(node_type = 'class', false))),
up AS (SELECT src, arg_min(dst, ord) AS dst FROM e WHERE relation = 'inherits' GROUP BY src), ab(id, hop) AS (SELECT id, 0 FROM cl UNION SELECT up.dst, ab.hop + 1 FROM ab JOIN up ON up.src = ab.id WHERE ab.hop < 10),
kin AS (SELECT id FROM (SELECT id FROM ab UNION SELECT src FROM e WHERE relation = 'inherits' AND dst IN (SELECT id FROM cl)) WHERE id NOT IN (SELECT id FROM s1)),
a2 AS (SELECT DISTINCT id FROM n WHERE id NOT IN (SELECT id FROM s1) AND (id IN (SELECT id FROM kin) OR file_path IN (SELECT file_path FROM n WHERE id IN (SELECT id FROM kin)))), s2 AS (SELECT id FROM s1 UNION SELECT id FROM a2),
fl AS (SELECT id, file_path FROM n WHERE coalesce(lower(node_kind) = 'file', false) OR coalesce(node_type = 'file', false)),
im AS (SELECT id, file_path FROM fl WHERE id IN (SELECT dst FROM e WHERE relation = 'imports' AND src IN (SELECT id FROM fl WHERE id IN (SELECT id FROM s2))) AND id NOT IN (SELECT id FROM s2) AND file_path IN (SELECT file_path FROM v WHERE id NOT IN (SELECT id FROM fl) AND ({_LIKE}))),
a3 AS (SELECT DISTINCT id FROM n WHERE id NOT IN (SELECT id FROM s2) AND (id IN (SELECT id FROM im) OR file_path IN (SELECT file_path FROM im)))
SELECT id, score, 'match' AS why FROM m UNION ALL SELECT id, 0, 'same_file' FROM a1 UNION ALL SELECT id, 0, 'inheritance' FROM a2 UNION ALL SELECT id, 0, 'import' FROM a3""",
)(lambda g: R.relevant_nodes(g, list(_WORDS)))

on("part", "f01_slugify", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM part")(lambda d: d.select("p_partkey", X.slugify(F.concat_ws(" ", "p_name", "p_type")).alias("slug")))
on("part", "f02_parent_dir", "SELECT p_partkey, lower(p_type) || '/' || p_brand AS dir FROM part")(lambda d: d.select("p_partkey", X.parent_dir(F.concat(F.lit("file:"), F.lower("p_type"), F.lit("/"), "p_brand", F.lit("/"), "p_name")).alias("dir")))
on("part", "f03_common_prefix", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#1' THEN strlen('x/') + strlen(p_brand) + 1 ELSE 2 END::INT AS n FROM part")(
    lambda d: d.select("p_partkey", X.common_prefix_len(F.concat(F.lit("x/"), "p_brand", F.lit("/a")), F.lit("x/Brand#1/b")).cast("int").alias("n"))
)
_SNAKE = "array_to_string(list_transform(range(1, len(x) + 1), lambda i: CASE WHEN x[i] BETWEEN 'A' AND 'Z' THEN CASE WHEN i > 1 AND NOT x[i - 1] BETWEEN 'A' AND 'Z' THEN '_' ELSE '' END || lower(x[i]) WHEN x[i] IN ('-', ' ') THEN '_' ELSE x[i] END), '')"
on("part", "f11_snake_case", f"SELECT p_partkey, {_SNAKE} AS name FROM (SELECT p_partkey, p_brand || '  ' || p_type || 'Server-' || p_name || '-My' || p_type AS x FROM part)")(
    lambda d: d.select("p_partkey", X.to_snake_case(F.concat("p_brand", F.lit("  "), "p_type", F.lit("Server-"), "p_name", F.lit("-My"), "p_type")).alias("name"))
)
on("documents", "f20_hashes", "SELECT doc_id, sha256(text) AS sha, md5(text) AS md FROM documents")(lambda d: d.select("doc_id", F.sha2("text", 256).alias("sha"), F.md5("text").alias("md")))
on("events", "f21_dates", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-10' GROUP BY 1")(lambda d: d.where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("n")))
on("events", "f22_json_metadata", "SELECT CAST(json_extract_string(props, '$.k') AS INT) AS k, count(*) AS n FROM events GROUP BY 1")(lambda d: d.groupBy(X.metadata_value(F.col("props"), "k").cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n")))
on("documents", "t08_keywords", "SELECT doc_id, 'AuthManager,auth_token,x.y,Zürich' || doc_id || ',a_b,c_d,a_b' AS words FROM documents")(
    lambda d: d.select("doc_id", F.array_join(X.keywords(F.concat(F.lit("the bug in AuthManager: auth_token auth_token of x.y and Fix Issue Zürich"), F.col("doc_id").cast("string"), F.lit(" (a_b, c_d) zz Ab a_b"))), ",").alias("words"))
)
on("documents", "f05_key_traceback", "SELECT doc_id % 4 AS k, count(*) AS n, CASE doc_id % 4 WHEN 0 THEN 'Traceback (most recent call last):' || chr(10) || '  a' WHEN 1 THEN 'x ERROR: bad' WHEN 2 THEN 'tail' ELSE 'Traceback (most recent call last) b' END AS text FROM documents GROUP BY 1, 3")(
    lambda d: d.groupBy((F.col("doc_id") % 4).alias("k"), key_traceback(F.element_at(F.array(F.lit("start Traceback (most recent call last):\n  a\n\nmore"), F.lit("x ERROR: bad"), F.lit("tail"), F.lit("Traceback (most recent call last) b\nFAILED c")), (F.col("doc_id") % 4 + 1).cast("int"))).alias("text")).agg(F.count(F.lit(1)).alias("n"))
)
on("documents", "r04_estimate_tokens", "SELECT doc_id, greatest(1, (strlen(coalesce(text, '')) + 30) // 4)::INT AS tokens FROM documents")(lambda d: d.select("doc_id", X.estimate_tokens(F.col("text")).alias("tokens")))
on("pages", "f17_escape_html", "SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS h FROM pages")(lambda d: d.select("page_id", F.md5(X.escape_html(F.col("html"))).alias("h")))
on("documents", "f04_classify_error", "SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'syntax' WHEN 1 THEN 'import' WHEN 2 THEN 'attribute' WHEN 3 THEN 'assertion' WHEN 4 THEN 'type' WHEN 5 THEN 'timeout' ELSE 'unknown' END AS class FROM documents")(
    lambda d: d.select("doc_id", X.classify_error(F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("doc_id") % 7 + 1).cast("int"))).alias("class"))
)
on("customer", "f09_parse_status", "SELECT c_custkey, CASE c_nationkey % 7 WHEN 0 THEN 'in_progress' WHEN 1 THEN 'done' WHEN 3 THEN 'in_progress' WHEN 5 THEN 'cancelled' END AS status FROM customer")(
    lambda d: d.select("c_custkey", X.parse_status(F.element_at(F.array(F.lit(" WIP "), F.lit("Closed"), F.lit("?"), F.lit("doing"), F.lit("in progress"), F.lit("canceled"), F.lit("new")), (F.col("c_nationkey") % 7 + 1).cast("int"))).alias("status"))
)
on("pages", "f10_normalize_relative", "SELECT page_id, 'a/' || page_id || '/c.md' AS path FROM pages")(lambda d: d.select("page_id", X.normalize_relative(F.concat(F.lit("./a/b/../"), F.col("page_id").cast("string"), F.lit("//c.md"))).alias("path")))
on("pages", "f12_markdown_links", "SELECT page_id, 'notes/' || page_id || '.md' AS link FROM pages")(lambda d: d.select("page_id", F.explode(X.markdown_links(F.concat(F.lit("see [a](notes/"), F.col("page_id").cast("string"), F.lit(".md) and [b](http://x.org/y.md) [c](z.txt)")))).alias("link")))
on("documents", "s11_ignore_rules", "SELECT doc_id % 4 AS k, count(*) AS n FROM documents WHERE doc_id % 4 IN (0, 3) GROUP BY 1")(
    lambda d: d.select((F.col("doc_id") % 4).alias("k")).withColumn("path", F.element_at(F.array(F.lit("src/a.py"), F.lit("target/x.rs"), F.lit("a/b.log"), F.lit("keep.log")), (F.col("k") + 1).cast("int"))).where(~X.ignored(F.col("path"), ["*.log", "target/", "!keep.log"])).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
)
_ERRORS = (
    "TypeError: a\nTypeError: b\nSyntaxError: c", "ModuleNotFoundError: x\nE assert 1", "AttributeError: x has no y\nTypeError: z", "assert a == b\nAssertionError: no\nTypeError: z", "TypeError: a\nNameError: b\nTypeError: c", "it timed out, TIMEOUT", "import error, timeout and AttributeError",
)
_LOG = "l AS (SELECT CASE event_type WHEN 'purchase' THEN 'task_done' WHEN 'error' THEN 'task_failed' ELSE event_type END AS event, event_id % 7 + 1 AS turns, CAST(floor(value) AS BIGINT) AS tokens, event_id % 60 AS d FROM events)"
on("events", "a14_telemetry", f"WITH {_LOG}, t AS (SELECT count(*) FILTER (event = 'task_done') AS completed, count(*) FILTER (event = 'task_failed') AS failed, CAST(coalesce(sum(turns) FILTER (event IN ('task_done', 'task_failed')), 0) AS BIGINT) AS turns, CAST(coalesce(sum(turns) FILTER (event = 'task_done'), 0) AS BIGINT) AS done_turns, CAST(coalesce(sum(tokens) FILTER (event = 'task_done'), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(d) FILTER (event = 'task_done'), 0) AS BIGINT) AS duration_s, CAST(NULL AS BIGINT) AS total_tasks FROM l) SELECT *, CASE WHEN completed + failed > 0 THEN round(100.0 * completed / (completed + failed), 2) ELSE 0.0 END AS success_rate, CASE WHEN completed > 0 THEN round(done_turns / completed, 2) ELSE 0.0 END AS turns_per_task FROM t")(
    lambda d: A.telemetry(A.events_as_log(d))
)
on("events", "s15_events_since", "SELECT event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1")(lambda d: d.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")))
on("events", "a15_task_summary", f"WITH {_LOG}, u AS (SELECT CAST(user_id AS VARCHAR) AS task_id, CASE event_type WHEN 'purchase' THEN 'task_done' WHEN 'error' THEN 'task_failed' END AS event, event_id % 7 + 1 AS turns FROM events) SELECT task_id, count(*) FILTER (event = 'task_done') AS done, count(*) FILTER (event = 'task_failed') AS failed, CAST(sum(turns) AS BIGINT) AS turns FROM u WHERE event IS NOT NULL GROUP BY 1")(
    lambda d: A.events_as_log(d).where("event in ('task_done', 'task_failed')").groupBy("task_id").agg(F.count_if(F.col("event") == "task_done").alias("done"), F.count_if(F.col("event") == "task_failed").alias("failed"), F.sum("turns").alias("turns"))
)
del S, G
