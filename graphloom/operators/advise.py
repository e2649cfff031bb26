"""Advice: rules over a graph as rows, and a score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.graph import Graph, metadata_of
from graphloom.lineage import cut
from graphloom.operators import integrity as V
from graphloom.operators import schedule as H
from graphloom.operators.aggregates import fan_metrics
from graphloom.operators.traverse import closure, impact_of_many, steps_of

# Layers from low to high, each with its other name; thresholds; types of code nodes; weights of findings.
LAYERS = (("infrastructure", "data"), ("domain", "business"), ("application", "service"), ("interface", "presentation"))
HIGH_FAN, DEEP_CHAIN = 5, 5
CODE_TYPES = ("file", "class", "function", "module")
SEVERITY = {"error": 25, "warning": 10, "info": 2}
#: Findings of these kinds inform and cost nothing.
FREE = ("dead_code", "module_suggestion")
# Names and files of functions that nothing in the code has to call.
ENTRY_NAMES = "main lib mod index app run start init setup __main__ ready message interaction_create guild_member_addition".split()
ENTRY_FILES = "main.rs lib.rs index.ts index.js main.ts main.js __main__.py".split()
ENTRY_PREFIXES = "cmd_ command_ handle_ get_ post_ put_ delete_ patch_".split()
ENTRY_SUFFIXES = "_handler _callback _hook _middleware _listener".split()
ENTRY_MARKS = ("#[no_mangle]", "extern")
TEST_PATHS = ("/test", "_test.", ".test.", ".spec.")
TEST_PREFIXES = ("test_", "Test")
TEST_IDS = ("tests__", "_tests_")
TEST_MARKS = ("#[test]", "#[tokio::test]")
TRAIT_METHODS = (
    "fmt clone default eq ne hash cmp partial_cmp drop deref deref_mut from into try_from try_into as_ref as_mut to_owned to_string next size_hint serialize deserialize poll wake"
).split()


def _any(tests) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return F.coalesce(out, F.lit(False))


def layer_violations(g: Graph) -> DataFrame:
    """(src, dst) of depends_on edges from a lower to a higher layer: that of the metadata, else that which the type names."""
    layer = F.coalesce(metadata_of(g.nodes, "layer"), F.col("node_type"))
    rank = F.lit(None).cast("int")
    for k, names in enumerate(LAYERS):
        rank = F.when(layer.isin(*names), k + 1).otherwise(rank)
    ranks = g.nodes.select("id", "ord", rank.alias("rank")).groupBy("id").agg(F.max_by("rank", "ord").alias("rank")).where("rank is not null")
    e = g.edges.where("relation = 'depends_on'").select("src", "dst")
    e = e.join(ranks.select(F.col("id").alias("src"), F.col("rank").alias("a")), "src").join(ranks.select(F.col("id").alias("dst"), F.col("rank").alias("b")), "dst")
    return e.where("a < b").select("src", "dst")


def blocked_chains(g: Graph) -> DataFrame:
    """(blocked, waiting): open nodes that a blocked one holds up, by any relation."""
    met = impact_of_many(g, g.nodes.where("status = 'blocked'").select("id").distinct(), None, None)
    return met.join(g.nodes.where("status in ('todo', 'in_progress')").select("id").distinct(), "id").select(F.col("seed").alias("blocked"), F.col("id").alias("waiting"))


def blocking(g: Graph) -> DataFrame:
    """(blocked): the nodes that blocked_chains() names, without whom they hold up: blocked nodes that open ones lead to."""
    open_ = g.nodes.where("status in ('todo', 'in_progress')").select("id").distinct()
    blocked = g.nodes.where("status = 'blocked'").select("id").distinct()
    # one that is open too, in another row of its id, holds itself up only over a way back to it
    starts = steps_of(g.edges, "out").join(open_.withColumnRenamed("id", "at"), "at", "left_semi").where("at <> to").select(F.col("to").alias("id"))
    return closure(steps_of(g.edges, "out"), starts).join(blocked, "id", "left_semi").select(F.col("id").alias("blocked"))


def entry_point(name: Column, path: Column, signature: Column) -> Column:
    return _any(
        [name.isin(ENTRY_NAMES), *[path.endswith(x) for x in ENTRY_FILES], *[name.startswith(x) for x in ENTRY_PREFIXES], *[name.endswith(x) for x in ENTRY_SUFFIXES], *[signature.contains(x) for x in ENTRY_MARKS]]
    )


def test_function(node_id: Column, name: Column, path: Column, signature: Column) -> Column:
    return _any([*[path.contains(x) for x in TEST_PATHS], *[name.startswith(x) for x in TEST_PREFIXES], *[node_id.contains(x) for x in TEST_IDS], *[signature.contains(x) for x in TEST_MARKS]])


def public_code(signature: Column) -> Column:
    return _any([signature.startswith(x) for x in ("pub ", "pub(", "export ")])


def dunder(name: Column) -> Column:
    return name.startswith("__") & name.endswith("__")


def first_parents(g: Graph) -> DataFrame:
    """(id, parent) by the first defined_in edge of each node."""
    return g.edges.where("relation = 'defined_in'").groupBy(F.col("src").alias("id")).agg(F.min_by("dst", "ord").alias("parent"))


def trait_methods(g: Graph) -> DataFrame:
    """Ids that are called by dispatch: targets of overrides; members of a class that inherits, of one that others inherit, or
    whose signature says trait; members that bear the name of a common trait method; members of a parent whose short name
    begins the source of an overrides edge."""
    overridden = g.edges.where("relation = 'overrides'")
    inherits = g.edges.where("relation = 'inherits'")
    parents = first_parents(g)
    by_edge = inherits.select(F.explode(F.array("src", "dst")).alias("parent")).distinct()
    says = g.nodes.where(F.contains(_column(g.nodes, "signature"), F.lit("trait "))).select(F.col("id").alias("parent")).distinct()
    short = F.element_at(F.split("parent", "_"), -1)
    sources = overridden.where(F.instr("src", ".") > 0).select(F.substring_index("src", ".", 1).alias("short")).distinct()
    named = parents.withColumn("short", F.substring_index(short, ".", 1)).where(F.instr(short, ".") == 0).join(sources, "short", "left_semi").select("id")
    common = g.nodes.where(F.col("title").isin(TRAIT_METHODS)).select("id").distinct().join(parents.select("id"), "id", "left_semi")
    members = parents.join(by_edge.unionByName(says).distinct(), "parent", "left_semi").select("id")
    return overridden.select(F.col("dst").alias("id")).unionByName(members).unionByName(named).unionByName(common).distinct()


def _column(nodes: DataFrame, name: str) -> Column:
    """A column of the nodes, or the metadata of that name."""
    own = F.col(name) if name in nodes.columns else F.lit(None).cast("string")
    return F.coalesce(metadata_of(nodes, name), own)


def dead_code(g: Graph, kinds=("function",)) -> DataFrame:
    """Functions that nothing calls and that are no entry point, test, public, special, default or dispatched one."""
    called = g.edges.where("relation = 'calls'").select(F.col("dst").alias("id")).distinct()
    name, path, signature = F.col("title"), F.coalesce(_column(g.nodes, "file_path"), F.lit("")), F.coalesce(_column(g.nodes, "signature"), F.lit(""))
    spare = entry_point(name, path, signature) | test_function(F.col("id"), name, path, signature) | public_code(signature) | dunder(name) | name.startswith("default_")
    return g.nodes.where(F.col("node_type").isin(*kinds) & ~F.coalesce(spare, F.lit(False))).join(called, "id", "left_anti").join(trait_methods(g), "id", "left_anti")


def dead_code_by_file(g: Graph, most: int = 10) -> DataFrame:
    """(file, n, names): the dead functions of each file, the first `most` by order named."""
    found = dead_code(g).select(F.coalesce(_column(g.nodes, "file_path"), F.lit("unknown")).alias("file"), "title", "ord")
    rank = F.row_number().over(_by("file", "ord"))
    return found.withColumn("rank", rank).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "title")))), lambda x: x["title"]), ", ").alias("names"))


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


def code_like(node_id: Column, node_type: Column, prefixes=("code_", "const_", "method_")) -> Column:
    return _any([*[node_id.startswith(p) for p in prefixes], *([F.coalesce(node_type.isin(*CODE_TYPES), F.lit(False))] if node_type is not None else [])])


def module_suggestions(g: Graph, least_files: int = 4) -> DataFrame:
    """(what): communities of files that span directories; without such, one row if there are two communities at least.

    A network of more links than the optimiser takes gives one row that says so, and the rest of the advice stands.
    """
    from graphloom.functions.text import parent_dir
    from graphloom.operators import community
    from graphloom.operators.projection import entity_files

    files = g.nodes.where("node_type = 'file'").select("id", F.coalesce(_column(g.nodes, "file_path"), F.col("title")).alias("path"))
    spark = g.nodes.sparkSession
    nothing = spark.createDataFrame([], "what string")
    if files.limit(least_files).count() < least_files:
        return nothing
    owners = entity_files(g).join(files.select(F.col("id").alias("file")), "file", "left_semi").select("id", "file")
    e = g.edges.where("relation in ('calls', 'imports', 'depends_on', 'inherits', 'implements')").select("src", "dst", F.coalesce("weight", F.lit(1.0)).alias("weight"))
    e = e.join(owners.withColumnsRenamed({"id": "src", "file": "a"}), "src").join(owners.withColumnsRenamed({"id": "dst", "file": "b"}), "dst").where("a <> b")
    network = cut(e.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "network")
    if network.limit(community.MOST_EDGES + 1).count() > community.MOST_EDGES:
        return spark.createDataFrame([(f"not looked at: more than {community.MOST_EDGES} links between files, see label_propagation",)], "what string")
    found = community.communities(network, trials=5)
    members = found.join(files, found["file"] == files["id"]).select("community", "path", parent_dir(F.col("path")).alias("dir"))
    groups = members.groupBy("community").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("dir").alias("n_dirs"), F.array_join(F.slice(F.array_sort(F.collect_list("path")), 1, 8), ", ").alias("files")).where("n > 1")
    counts = groups.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_dirs") > 1).alias("spread")).first()
    if found.select("community").distinct().limit(2).count() < 2 or not counts["n"]:
        return nothing
    if counts["spread"]:
        return groups.where("n_dirs > 1").select("files").withColumnRenamed("files", "what")
    return spark.createDataFrame([(f"{counts['n']} modules",)] if counts["n"] > 1 else [], "what string")


def findings(g: Graph, modules: bool = True) -> DataFrame:
    """(kind, severity, what): one row for each finding."""

    def rows(df: DataFrame, kind: str, severity: str, what) -> DataFrame:
        return df.select(F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), what.alias("what"))

    fans = fan_metrics(g).where(~code_like(F.col("id"), None, ("code_", "const_")))
    types = g.nodes.groupBy("id").agg(F.min_by("node_type", "ord").alias("node_type"))
    orphans = V.orphan_nodes(g).select("id").join(types, "id").where(~code_like(F.col("id"), F.col("node_type")))
    described = F.col("description").isNull() if "description" in g.nodes.columns else F.lit(True)
    depths = cut(H.chain_depths(g), "depths")
    # cycles lie among the nodes that have no depth
    knots = Graph(*(cut(df, "knots") for df in (lambda k: (k.nodes, k.edges))(g.with_edges(g.edges.where("relation = 'depends_on'")).induced(g.nodes.join(depths.where("depth is null").select("id"), "id", "left_semi")))))
    kinds = [
        rows(V.cycles(knots).groupBy("component").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids")).where("instr(ids, ',') > 0"), "cycle", "error", F.col("ids")),
        rows(V.missing_refs(g), "missing_reference", "error", F.concat_ws(" ", "src", "relation", "dst")),
        rows(V.duplicate_nodes(g), "duplicate_node", "error", F.col("id")),
        rows(orphans, "orphan", "warning", F.col("id")),
        rows(fans.where(F.col("fan_in") >= HIGH_FAN), "high_fan_in", "warning", F.col("id")),
        rows(fans.where(F.col("fan_out") >= HIGH_FAN), "high_fan_out", "warning", F.col("id")),
        rows(g.nodes.where(described & ~code_like(F.col("id"), F.col("node_type"))), "missing_description", "info", F.col("id")),
        rows(depths.where(F.col("depth") >= DEEP_CHAIN), "deep_chain", "info", F.col("id")),
        rows(layer_violations(g), "layer_violation", "warning", F.concat_ws(" ", "src", "dst")),
        rows(blocking(g), "blocked_chain", "warning", F.col("blocked")),
        rows(suggested_order(g, depths), "suggested_order", "info", F.col("ids")),
        rows(dead_code_by_file(g), "dead_code", "info", F.col("file")),
    ]
    if modules:
        kinds.append(rows(module_suggestions(g), "module_suggestion", "info", F.col("what")))
    out = kinds[0]
    for df in kinds[1:]:
        out = out.unionByName(df)
    return out


def suggested_order(g: Graph, depths: DataFrame, most: int = 10) -> DataFrame:
    """(ids): the first nodes to do, dependencies first, ids ascending within a depth. None if fewer than two are to do, or if
    an order of all nodes fails: for a cycle, a self-loop, a repeated id, or a dependency that is no node."""
    first = depths.join(g.nodes.where("status = 'todo'").select("id").distinct(), "id").orderBy("depth", "id").limit(most)
    found = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("depth", "id"))), lambda x: x["id"]), ",").alias("ids")).where("instr(ids, ',') > 0")
    lost = H.depends_on(g).join(g.nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("dst")
    wrong = depths.where("depth is null").select("id").unionAll(H.depends_on(g).where("src = dst").select("src")).unionAll(lost).unionAll(V.duplicate_nodes(g).select("id"))
    return found.join(F.broadcast(wrong.agg(F.count(F.lit(1)).alias("wrong")))).where("wrong = 0").select("ids")  # frames of one row


def ordered(found: DataFrame) -> DataFrame:
    """Findings with their place: errors first, then warnings, then what only informs; by kind and text within."""
    from pyspark.sql import Window

    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("severity"))
    return found.withColumn("place", F.row_number().over(Window.partitionBy("severity").orderBy("kind", "what"))).withColumn("severity_rank", rank)


def score(found: DataFrame) -> DataFrame:
    """100 less 25 for an error, 10 for a warning and 2 for an info (ten infos at most, those of FREE kinds not counted), within
    0 and 100; passed without errors."""
    n = found.where(~F.col("kind").isin(*FREE)).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITY])
    total = 100 - 25 * F.col("error") - 10 * F.col("warning") - 2 * F.least(F.col("info"), F.lit(10))
    return n.select("error", "warning", "info", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("long").alias("score"), (F.col("error") == 0).alias("passed"))
