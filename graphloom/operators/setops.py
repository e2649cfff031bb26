"""Diffs and merges of graphs and of file states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.graph import EDGE, NODE, Graph, fill, layer_of, metadata_of
from graphloom.lineage import FEW_ROWS, cut
from graphloom.operators.scans import first_by_order


def diff(old: Graph, new: Graph) -> DataFrame:
    """(kind, what): nodes added, removed or modified (status, title or description differ), edges added or removed by triple."""
    cols = [c for c in ("status", "title", "description") if c in old.nodes.columns and c in new.nodes.columns]
    a = old.nodes.select("id", F.struct(*cols).alias("a"))
    b = new.nodes.select("id", F.struct(*cols).alias("b"))
    both = a.join(b, "id", "full_outer")
    kind = F.when(F.col("a").isNull(), "node_added").when(F.col("b").isNull(), "node_removed").when(~F.col("a").eqNullSafe(F.col("b")), "node_modified")
    triple = F.concat_ws(" ", "src", "relation", "dst").alias("what")
    e1, e2 = old.edges.select(triple).distinct(), new.edges.select(triple).distinct()
    return (
        both.select(kind.alias("kind"), F.col("id").alias("what")).where("kind is not null")
        .unionByName(e2.exceptAll(e1).select(F.lit("edge_added").alias("kind"), "what"))
        .unionByName(e1.exceptAll(e2).select(F.lit("edge_removed").alias("kind"), "what"))
    )


def file_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change): added, modified, deleted or unchanged; the hash decides, not the time."""
    both = old.select("path", F.col("content_hash").alias("h1"), F.lit(1).alias("in1")).join(new.select("path", F.col("content_hash").alias("h2"), F.lit(1).alias("in2")), "path", "full_outer")
    change = F.when(F.col("in1").isNull(), "added").when(F.col("in2").isNull(), "deleted").when(F.col("h1").eqNullSafe(F.col("h2")), "unchanged").otherwise("modified")
    return both.select("path", change.alias("change"))


def replace_code_layer(g: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """The code layer anew: extracted nodes, extracted and bridge edges go, the new ones come, danglers are pruned.

    Edges of the project layer survive with a missing end, unless that end is an id of the old code layer (code_).
    """
    kept = g.nodes.where(~F.coalesce(F.col("source") == "extract", F.lit(False))).unionByName(nodes)
    rest = g.edges.where(~F.coalesce("edge_source", F.lit("")).isin("extract", "auto-bridge"))
    ids = kept.select("id").distinct()

    def alive(e: DataFrame, end: str) -> DataFrame:
        there = e.join(ids.withColumnRenamed("id", end), end, "left_semi")
        gone = e.join(ids.withColumnRenamed("id", end), end, "left_anti").where(~F.col(end).startswith("code_"))
        return there.unionByName(gone)

    return Graph(kept, alive(alive(rest, "src"), "dst").unionByName(edges), g.project)


def replace_project_layer(g: Graph, nodes: DataFrame, edges: DataFrame) -> Graph:
    """The project layer anew: of the old graph only extracted nodes and edges stay; new nodes without a source are project."""
    new = nodes.withColumn("source", F.coalesce("source", F.lit("project")))
    return Graph(g.nodes.where("source = 'extract'").unionByName(new), g.edges.where(F.coalesce("edge_source", F.lit("")).isin("extract", "auto-bridge")).unionByName(edges), g.project)


def replace_feature_tasks(g: Graph, feature: str, nodes: DataFrame, edges: DataFrame) -> Graph:
    """Tasks that implement a feature go with all their edges; the new ones come with an implements edge each."""
    old = g.edges.where((F.col("relation") == "implements") & (F.col("dst") == feature)).select(F.col("src").alias("id")).distinct()
    kept = g.nodes.join(old, "id", "left_anti").select(g.nodes.columns)
    rest = g.edges.join(old.withColumnRenamed("id", "src"), "src", "left_anti").join(old.withColumnRenamed("id", "dst"), "dst", "left_anti").select(g.edges.columns)
    links = nodes.select("id", "ord")
    made = links.select(*[{"src": F.col("id"), "dst": F.lit(feature), "relation": F.lit("implements"), "ord": F.col("ord")}.get(c, F.lit(None).cast(g.edges.schema[c].dataType)).alias(c) for c in g.edges.columns])
    return Graph(kept.unionByName(nodes), rest.unionByName(edges).unionByName(made), g.project)


def merge_inference(g: Graph, nodes: DataFrame, edges: DataFrame, batch: str) -> Graph:
    """Inferred nodes anew, stamped with a batch; nodes of users are never overwritten."""
    kept = g.nodes.where(~F.coalesce(F.col("source") == "infer", F.lit(False)))
    fresh = nodes.join(kept.select("id"), "id", "left_anti").select(nodes.columns).withColumn("source", F.lit("infer"))
    rest = g.edges.where(F.coalesce("edge_source", F.lit("")) != "infer")
    stamp = lambda df, v: df.withColumn("infer_batch", F.lit(v).cast("string")) if "infer_batch" not in df.columns or v else df
    return Graph(stamp(kept, None).unionByName(stamp(fresh, batch)), rest.unionByName(edges.withColumn("edge_source", F.lit("infer"))), g.project)


def rollback_batch(g: Graph, batch: str) -> Graph:
    gone = g.nodes.where(F.col("infer_batch") == batch).select("id")
    rest = g.edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").select(g.edges.columns)
    return Graph(g.nodes.where(~F.coalesce(F.col("infer_batch") == batch, F.lit(False))), rest, g.project)


# Parts of a path that name nothing.
PLAIN_FOLDERS, PLAIN_STEMS = ("src", "lib", "mod.rs", "index.ts", "index.js"), ("", "main", "mod", "index")


def bridge_edges(g: Graph) -> DataFrame:
    """(src, dst, confidence): project nodes to code nodes. A path among the code_paths of a project node gives 1.0; code nodes
    without such a match meet, with 0.8, the project nodes whose id contains a segment of theirs.

    Containment is made equality: an id is cut into the pieces that begin like a segment (by its first HEAD letters) and are as long as
    one that does, each piece where it first occurs; pieces then meet segments by what they are, and no two meet that do not match.
    """
    code = g.nodes.where("source = 'extract'").select(F.col("id").alias("dst"), "file_path").distinct()
    project = g.nodes.where(layer_of(F.col("source")) == "project")
    paths = F.col("code_paths") if "code_paths" in project.columns else F.from_json(_array_of(project, "code_paths"), "array<string>")
    exact = project.select(F.col("id").alias("src"), F.explode(paths).alias("file_path")).join(code, "file_path").select("src", "dst", F.lit(1.0).alias("confidence")).distinct()
    rest = code.join(exact.select("dst"), "dst", "left_anti")
    own = F.when(F.instr("dst", ":") > 0, F.get(F.split("dst", ":"), F.lit(1))).otherwise(F.col("dst"))
    named = F.filter(F.split(own, "/"), lambda x: ~x.isin(*PLAIN_FOLDERS))
    stems = F.filter(F.transform(named, lambda x: F.substring_index(x, ".", 1)), lambda x: ~x.isin(*PLAIN_STEMS))
    parts = rest.select("dst").distinct().withColumn("parts", F.array_distinct(F.transform(stems, F.lower)))
    parts = cut(parts.select("dst", F.explode("parts").alias("part"), (F.size("parts") > 1).alias("several")), "parts")
    ids = project.select("id").distinct().select(F.col("id").alias("src"), F.lower("id").alias("low"))
    long = parts.where(F.length("part") >= HEAD)
    heads = _few(cut(long.groupBy(F.substring("part", 1, HEAD).alias("head")).agg(F.collect_set(F.length("part")).alias("sizes")), "heads"))
    at = ids.where(F.length("low") >= HEAD).select("src", "low", F.explode(F.sequence(F.lit(1), F.length("low") - (HEAD - 1))).alias("at"))
    at = at.withColumn("head", F.substring(F.col("low"), F.col("at"), F.lit(HEAD))).join(heads, "head").select("src", "low", "at", F.explode("sizes").alias("size"))
    at = at.where(F.col("at") + F.col("size") - 1 <= F.length("low")).withColumn("part", F.substring(F.col("low"), F.col("at"), F.col("size")))
    pieces = at.where(F.instr(F.col("low"), F.col("part")) == F.col("at")).select("src", "part")
    short = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1))), lambda i: F.array(*[F.substring(F.col("low"), i, F.lit(n)) for n in range(1, HEAD)])))
    pieces_short = ids.select("src", F.explode(F.array_distinct(short)).alias("part"))
    met = pieces.join(_few(long), "part").unionByName(pieces_short.join(_few(cut(parts.where(F.length("part") < HEAD), "short")), "part")).select("src", "dst", "several")
    # a code node of one segment meets an id once
    loose = met.where("not several").select("src", "dst").unionByName(met.where("several").select("src", "dst").distinct())
    return exact.unionByName(loose.withColumn("confidence", F.lit(0.8)))


#: First letters of a segment by which an id is cut into pieces.
HEAD = 3


def _few(df: DataFrame) -> DataFrame:
    """df, broadcast if it is known to have few rows."""
    return F.broadcast(df) if df.limit(FEW_ROWS + 1).count() <= FEW_ROWS else df


def _array_of(nodes: DataFrame, key: str):
    """A JSON array of the nodes' metadata, as text."""
    if "metadata" not in nodes.columns:
        return F.lit(None).cast("string")
    return F.col("metadata")[key] if dict(nodes.dtypes)["metadata"].startswith("map") else F.get_json_object("metadata", f"$.{key}")


def merge_lists(a, b):
    """Union of two arrays in order."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def union_graphs(a: Graph, b: Graph) -> Graph:
    """Both graphs; of equal ids and triples those of the first."""
    n = first_by_order(a.nodes.withColumn("_side", F.lit(0)).unionByName(b.nodes.withColumn("_side", F.lit(1))).withColumn("ord", F.col("_side") * F.lit(1 << 60) + F.col("ord")), ["id"])
    e = first_by_order(a.edges.withColumn("_side", F.lit(0)).unionByName(b.edges.withColumn("_side", F.lit(1))).withColumn("ord", F.col("_side") * F.lit(1 << 60) + F.col("ord")), ["src", "dst", "relation"])
    return Graph(n.drop("_side"), e.drop("_side"), a.project)


# Kinds and relations of code graphs; kinds as reports fold them.
CODE_KINDS = ("File", "Class", "Function", "Module", "Constant", "Interface", "Enum", "TypeAlias", "Trait")
CODE_RELATIONS = ("imports", "inherits", "defined_in", "calls", "tests_for", "overrides", "implements", "belongs_to", "type_reference")
FOLDED_KINDS = {"File": "file", "Class": "class", "Interface": "class", "Enum": "class", "TypeAlias": "class", "Trait": "class", "Function": "function", "Constant": "function", "Method": "function", "Module": "module"}


def fold_kind(kind):
    """The kind of a node as reports show it."""
    table = F.create_map(*[F.lit(x) for kv in FOLDED_KINDS.items() for x in kv])
    return F.coalesce(table[kind], F.lit("unknown"))


def code_to_graph(nodes: DataFrame, edges: DataFrame) -> Graph:
    """The layer of extracted code as graph rows. nodes: id, name, kind, file_path, and what else a code node has; edges: src,
    dst, relation, weight, confidence, call_count, in_error_path. Every node is done and of type code; what has no column of
    its own goes into the metadata, as JSON."""
    have = lambda c, t="string": F.col(c).cast(t) if c in nodes.columns else F.lit(None).cast(t)
    meta = F.map_filter(
        F.create_map(
            F.lit("is_test"), F.when(have("is_test", "boolean"), "true"),
            F.lit("line_count"), F.when(have("line_count", "long") > 0, have("line_count", "long").cast("string")),
            F.lit("decorators"), F.when(F.size(have("decorators", "array<string>")) > 0, F.to_json(have("decorators", "array<string>"))),
        ),
        lambda _, v: v.isNotNull(),
    )
    made = nodes.select(
        "id", F.col("name").alias("title"), F.lit("done").alias("status"), F.lit("code").alias("node_type"), F.col("kind").alias("node_kind"), F.lit("extract").alias("source"), "file_path",
        have("line", "long").alias("start_line"), have("end_line", "long").alias("end_line"), have("signature").alias("signature"), have("docstring").alias("doc_comment"), have("visibility").alias("visibility"),
        have("lang").alias("lang"), have("body_hash").alias("body_hash"), have("visibility").isin("pub", "export").alias("is_public"), meta.alias("metadata"), have("ord", "long").alias("ord"),
    )
    parts = F.concat_ws(",", F.lit('"source":"extract"'), F.when(F.col("call_count") > 1, F.concat(F.lit('"call_count":'), F.col("call_count").cast("string"))), F.when(F.col("in_error_path"), '"in_error_path":true'))
    return Graph(fill(made, NODE), fill(edges.withColumn("metadata", F.concat(F.lit("{"), parts, F.lit("}"))).withColumn("edge_source", F.lit("extract")), EDGE))


def graph_to_code(g: Graph) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, name, kind, file_path, is_test) and edges of the layer of extracted code: methods are functions, unknown
    kinds files; edges of other relations go; a weight that is missing is 0.5, a confidence 1."""
    kind = F.when(F.col("node_kind") == "Method", "Function").when(F.col("node_kind").isin(*CODE_KINDS), F.col("node_kind")).otherwise("File")
    is_test = F.coalesce(metadata_of(g.nodes, "is_test"), F.lit("false")) == "true"
    nodes = g.nodes.where("source = 'extract'").select("id", F.col("title").alias("name"), kind.alias("kind"), F.coalesce("file_path", F.lit("")).alias("file_path"), is_test.alias("is_test"), "ord")
    edges = g.edges.where((F.col("edge_source") == "extract") & F.col("relation").isin(*CODE_RELATIONS))
    return nodes, edges.select("src", "dst", "relation", F.coalesce("weight", F.lit(0.5)).alias("weight"), F.coalesce("call_count", F.lit(1)).alias("call_count"), F.coalesce("in_error_path", F.lit(False)).alias("in_error_path"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "ord")


#: Characters by which texts and names are brought together.
GRAM = 4
#: Names that a text meets at once.
MET = 10_000


def mentioned(texts: DataFrame, names: DataFrame) -> DataFrame:
    """(key, name) of texts(key, text) that contain a name of names(name) anywhere, upper and lower case told apart.

    Each name waits at one of its grams of GRAM characters, the one that fewest names have; a text meets the names that wait at
    its grams, and the text itself decides. Shorter names wait at grams of their own length. Empty names are contained in nothing.
    A text is read once for each length of gram and meets its names in lists of about MET of them, not one by one.
    """

    def grams(c, n: int):
        return F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))  # one pass; substrings count from the start each

    names = cut(names.select("name").where("name <> ''").distinct(), "names")
    n_names, found = names.count(), None
    for n in range(1, GRAM + 1):
        size = F.length("name")
        own = names.where(size >= n if n == GRAM else size == n)
        each = own.select("name", F.explode(F.array_distinct(grams(F.col("name"), n))).alias("gram"))
        common = each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        waiting = each.join(common, "gram").groupBy("name").agg(F.min(F.struct("n", "gram")).alias("x")).select("name", "x.gram")
        waiting = F.broadcast(waiting) if n_names <= FEW_ROWS else waiting.hint("merge")  # never the grams of the texts
        has = texts.where(F.length("text") >= n).select("key", F.explode(F.array_distinct(grams(F.col("text"), n))).alias("gram"))
        met = has.join(waiting, "gram").select("key", "name")
        found = met if found is None else found.unionByName(met)
    share = F.pmod(F.xxhash64("name"), F.lit(n_names // MET + 1))
    lists = found.groupBy("key", share.alias("share")).agg(F.collect_set("name").alias("names"))
    own = texts.select(F.col("key").alias("own"), "text")
    held = lists.hint("merge").join(own, F.col("key").eqNullSafe(F.col("own"))).select("key", F.explode(F.filter("names", lambda x: F.contains(F.col("text"), x))).alias("name"))
    return held.distinct()


def link_tasks_to_code(tasks: Graph, files: DataFrame) -> DataFrame:
    """(src, dst, relation) of the edges that tasks lack to files(file_path) whose name their title or description mentions."""
    text = F.concat("title", F.lit(" "), F.coalesce("description", F.lit("")) if "description" in tasks.nodes.columns else F.lit(""))
    named = files.select("file_path", F.element_at(F.split("file_path", "/"), -1).alias("name")).distinct()
    met = mentioned(tasks.nodes.select(F.col("id").alias("key"), text.alias("text")), named).join(named, "name")
    dst = F.regexp_replace(F.concat(F.lit("code:"), "file_path"), "[/:]", "_")
    return met.select(F.col("key").alias("src"), dst.alias("dst"), F.lit("relates_to").alias("relation")).distinct().join(tasks.edges.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", "relation")
