"""From a code graph to inferred components: the file network and its added edges, communities, and what becomes of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import common_prefix_len, parent_dir
from graphloom.graph import EDGE, NODE, Graph, fill
from graphloom.lineage import Rounds, cut
from graphloom.operators import projection as P
from graphloom.operators.community import auto_config, bounded_network, most_members, name_communities, optimise, split_large
from graphloom.operators.setops import merge_inference


@dataclass(frozen=True)
class Config:
    """The defaults of the clustering."""

    tau: float = 0.05
    trials: int = 10
    min_size: int = 2
    max_size: int | None = None
    co_citation: float = 0.4
    co_citation_shared: int = 2
    co_location: float = 0.3
    similarity: float = 0.5
    similar_tokens: int = 2
    similar_jaccard: float = 0.15
    hub_share: float = 0.05
    hub_degree: int = 10
    seed: int = 42


def network(g: Graph, config: Config = Config()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(network, files, hubs): a, b, weight of the files without hubs, with edges by co-citation, by names and by place; the
    files of the network; the hubs."""
    owners = cut(P.entity_files(g).join(g.nodes.where("node_type = 'file' or (node_type = 'code' and node_kind = 'File')").select(F.col("id").alias("file")).distinct(), "file", "left_semi").select("id", "file"), "owners")
    hubs = cut(P.hubs(g.edges, owners, config.hub_share, config.hub_degree).select("file"), "hubs")
    kept = owners.join(hubs, "file", "left_anti").select("id", "file")
    net = P.file_network(g.edges, kept)
    cited = P.co_citation(g.edges, kept, config.co_citation, config.co_citation_shared)
    symbols = g.nodes.where("node_kind in ('Function', 'Class', 'Method', 'Module')").select("id", F.col("title").alias("name")).join(kept, "id").where("id <> file")
    alike = P.token_similarity(symbols.select(F.col("file").alias("owner"), "name"), config.similarity, config.similar_tokens, config.similar_jaccard)
    added = cited.select("a", "b", "weight").unionByName(alike.select("a", "b", "weight"))
    net = cut(net.unionByName(added).unionByName(added.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")), "network")
    files = kept.select("file").distinct()
    near = P.co_location(files, net, config.co_location) if config.co_location > 0 else net.limit(0)
    net = net.unionByName(near).unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))
    return net.groupBy("a", "b").agg(F.sum("weight").alias("weight")), files, hubs


def reassign_orphans(members: DataFrame, net: DataFrame, least: int, most_rounds: int = 100) -> DataFrame:
    """(file, cluster) with no cluster below `least` where there is a way round it.

    Files of smaller clusters join, round by round, the cluster that they have the heaviest edges with, in either
    direction; then, by directory, new clusters of `least` files or more; then the cluster with the longest path in
    common. What is left stays alone. Ties go to the smallest cluster.
    """
    spark = members.sparkSession
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    large = members.join(size.where(F.col("size") >= least), "cluster", "left_semi").select("file", "cluster")
    orphans = cut(members.join(large, "file", "left_anti").select("file"), "orphans")
    found = Rounds(spark, "file string, cluster long")
    found.add(large.select("file", F.col("cluster").cast("long").alias("cluster")))
    both = cut(net.select("a", "b", "weight").unionByName(net.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).join(orphans.withColumnRenamed("file", "a"), "a", "left_semi"), "near")
    for _ in range(most_rounds):
        placed = found.all()
        left = orphans.join(placed, "file", "left_anti")
        pulls = both.join(left.withColumnRenamed("file", "a"), "a", "left_semi").join(placed.withColumnRenamed("file", "b"), "b").groupBy(F.col("a").alias("file"), "cluster").agg(F.sum("weight").alias("w"))
        if not found.add(pulls.groupBy("file").agg(F.min(F.struct((-F.col("w")).alias("w"), "cluster")).alias("x")).select("file", F.col("x.cluster").alias("cluster"))):
            break
    placed = found.all()
    left = cut(orphans.join(placed, "file", "left_anti").withColumn("dir", parent_dir(F.col("file"))), "left")
    base = (placed.agg(F.max("cluster")).first()[0] or 0) + 1
    dirs = left.groupBy("dir").agg(F.count(F.lit(1)).alias("n"))
    fresh = dirs.where(F.col("n") >= least).withColumn("cluster", F.row_number().over(Window.orderBy("dir")).cast("long") + F.lit(base))  # directories, not files
    grouped = left.join(fresh, "dir").select("file", "cluster")
    rest = left.join(grouped, "file", "left_anti")
    # clusters by the directories of their members, and by every directory above those: the longest in common wins
    held = placed.unionByName(grouped).select("cluster", parent_dir(F.col("file")).alias("dir")).distinct()
    above = lambda c: F.transform(F.sequence(F.lit(1), F.size(F.split(c, "/"))), lambda k: F.array_join(F.slice(F.split(c, "/"), 1, k), "/"))
    ups = held.select(F.explode(above(F.col("dir"))).alias("up"), "cluster").groupBy("up").agg(F.min("cluster").alias("cluster"))
    near = rest.select("file", F.col("dir"), F.explode(above(F.col("dir"))).alias("up")).join(ups, "up").withColumn("common", common_prefix_len(F.col("dir"), F.col("up")))
    joined = near.groupBy("file").agg(F.min(F.struct((-F.col("common")).alias("c"), "cluster")).alias("x")).select("file", F.col("x.cluster").alias("cluster"))
    top = base + dirs.count() + 1
    alone = rest.join(joined, "file", "left_anti").select("file", (F.row_number().over(Window.orderBy("file")).cast("long") + F.lit(top)).alias("cluster"))
    return placed.unionByName(grouped).unionByName(joined).unionByName(alone)


def split_by_directory(members: DataFrame, most: int) -> DataFrame:
    """(file, cluster, part): clusters of more than `most` files cut by the directory of their files, where they have several."""
    w = Window.partitionBy("cluster")
    sized = members.withColumn("dir", parent_dir(F.col("file"))).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("lo", F.min("dir").over(w)).withColumn("hi", F.max("dir").over(w))
    return sized.select("file", "cluster", F.when((F.col("n") > most) & (F.col("lo") != F.col("hi")), F.col("dir")).otherwise("").alias("part"))


def to_components(members: DataFrame, hubs: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Component nodes and contains edges of members(file, community); hubs make the component of infrastructure."""
    members = members.select("file", "community")
    names = name_communities(members)
    sizes = members.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    own = F.concat(F.lit("infer:component:"), F.col("community").cast("string"))
    meta = lambda c: F.create_map(F.lit("size"), c.cast("string"))
    nodes = names.join(sizes, "community").select(own.alias("id"), F.col("name").alias("title"), F.lit("component").alias("node_type"), F.lit("infer").alias("source"), meta(F.col("size")).alias("metadata"))
    edges = members.select(own.alias("src"), F.col("file").alias("dst"))
    if hubs is not None:
        n = hubs.agg(F.count(F.lit(1)).alias("size")).where("size > 0")
        infra = n.select(F.lit("infer:component:infrastructure").alias("id"), F.lit("Infrastructure & Shared Utilities").alias("title"), F.lit("component").alias("node_type"), F.lit("infer").alias("source"), meta(F.col("size")).alias("metadata"))
        nodes = nodes.unionByName(infra)
        edges = edges.unionByName(hubs.select(F.lit("infer:component:infrastructure").alias("src"), F.col("file").alias("dst")))
    return fill(nodes, NODE), fill(edges.withColumn("relation", F.lit("contains")).withColumn("edge_source", F.lit("infer")), EDGE)


def cluster(g: Graph, config: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Component nodes and contains edges of a code graph: network, communities, orphans, splits, names, infrastructure."""
    spark = g.nodes.sparkSession
    net, files, hubs = network(g, config)
    net = cut(net, "whole-network")
    names, links = bounded_network(net)
    if len(names) < 2:
        return spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE)
    module, _ = optimise(len(names), links, config.tau, config.trials, config.seed)
    first = spark.createDataFrame(list(zip(names, module)), "file string, cluster long")
    alone = files.join(first, "file", "left_anti").select("file", (F.row_number().over(Window.orderBy("file")) + F.lit(len(names))).cast("long").alias("cluster"))  # files, not entities
    members = cut(reassign_orphans(first.unionByName(alone), net, config.min_size), "members")
    most = config.max_size or most_members(files.count())
    place = {x: i for i, x in enumerate(names)}
    groups: dict[int, list[int]] = {}
    for row in members.orderBy("file").collect():  # files of a network of bounded size
        groups.setdefault(row["cluster"], []).append(place.setdefault(row["file"], len(place)))
    by_place = {i: x for x, i in place.items()}
    parts = split_large([groups[k] for k in sorted(groups)], links, most, config.tau, config.trials, config.seed)
    split = spark.createDataFrame([(by_place[i], k) for k, part in enumerate(parts) for i in part], "file string, cluster long")
    final = split_by_directory(split, most).withColumn("community", (F.dense_rank().over(Window.orderBy("cluster", "part")) - 1).cast("int"))
    return to_components(final, hubs)


def component_sizes(edges: DataFrame) -> DataFrame:
    """(component, n): how many files each inferred component contains."""
    return edges.where("relation = 'contains' and src like 'infer:component:%'").groupBy(F.col("src").alias("component")).agg(F.count(F.lit(1)).alias("n"))


def infer(g: Graph, batch: str, config: Config | None = None) -> Graph:
    """The graph with inferred components in place of those that were inferred before, stamped with a batch. Without a config,
    the smallest size and the teleportation follow the size and the density of the file network."""
    if config is None:
        net, files, _ = network(g)
        n, links = files.count(), net.count()
        auto = auto_config(n, links / n if n else 0.0)
        config = Config(tau=auto["tau"], min_size=auto["min_size"])
    nodes, edges = cluster(g, config)
    return merge_inference(g, _like(nodes, g.nodes), _like(edges, g.edges), batch)


def _like(df: DataFrame, like: DataFrame) -> DataFrame:
    """df in the columns of another frame; a map that is text there becomes JSON."""
    types = dict(df.dtypes)

    def column(name: str, kind: str):
        if name not in types:
            return F.lit(None)
        return F.to_json(name) if types[name].startswith("map") and kind == "string" else F.col(name)

    return df.select(*[column(n, k).cast(k).alias(n) for n, k in like.dtypes])


def hierarchy(contains: DataFrame) -> DataFrame:
    """(id, path, depth, children, descendants) of a forest of contains(parent, child, ord): dotted places like 0.1.3, roots
    numbered from 0 by id, children within their parent by ord and id.

    Each id is led to its root by doubling pointers, which gather the places on the way, so a forest of depth d takes log d
    rounds. A child of two parents belongs to the first; a ring has no root and its nodes have no place. An id's descendants are
    counted from the places that begin with its own.
    """
    first = contains.where("parent <> child").groupBy(F.col("child").alias("id")).agg(F.min(F.struct("ord", "parent")).alias("x")).select("id", F.col("x.parent").alias("parent"), F.col("x.ord").alias("ord"))
    first = cut(first, "parents")
    number = F.row_number().over(Window.partitionBy("parent").orderBy("ord", "id")) - 1
    roots = contains.select(F.col("parent").alias("id")).distinct().join(first.select("id"), "id", "left_anti")
    # the places of roots: sorted ranges, each row numbered within, and the sizes of the ranges before
    ranges = cut(roots.repartitionByRange("id").withColumn("part", F.spark_partition_id()), "roots")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    bases = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    root = ranges.join(F.broadcast(bases), "part").select("id", (F.col("base") + F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1).cast("int").alias("place"))
    root = cut(root, "places")
    # (id, up, places): the places from below `up` down to id
    ways = cut(first.select("id", F.col("parent").alias("up"), F.array(number).alias("places")), "ways")
    is_root = root.select(F.col("id").alias("up"), F.lit(True).alias("done"))
    while True:
        marked = ways.join(is_root, "up", "left")
        on = ways.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("places").alias("more"))
        moved = marked.where("done is null").join(on, "up").select("id", F.col("up2").alias("up"), F.concat("more", "places").alias("places"))
        moved = cut(moved.join(is_root, "up", "left").select("id", "up", "places", "done"), "moved")
        ready = moved.where("done").count()
        ways = cut(marked.where("done").select("id", "up", "places").unionByName(moved.select("id", "up", "places")), "ways")
        if not ready:  # what is left goes round in rings
            break
    whole = ways.join(root.select(F.col("id").alias("up"), "place"), "up").select("id", F.concat(F.array("place"), "places").alias("places")).unionByName(root.select("id", F.array("place").alias("places")))
    whole = cut(whole, "whole")
    above = whole.where(F.size("places") > 1).select(F.size("places").alias("own"), F.explode(F.transform(F.sequence(F.lit(1), F.size("places") - 1), lambda n: F.slice("places", 1, n))).alias("places"))
    counts = above.groupBy("places").agg(F.count(F.lit(1)).alias("descendants"), F.count_if(F.col("own") == F.size("places") + 1).alias("children"))
    return whole.join(counts, "places", "left").select("id", F.array_join("places", ".").alias("path"), F.size("places").alias("depth"), F.coalesce("children", F.lit(0)).alias("children"), F.coalesce("descendants", F.lit(0)).alias("descendants"))


# Kinds of code nodes that a label's context names, and how much of a file's comment it quotes.
CLASS_KINDS = ("struct", "enum", "trait", "class", "interface", "type", "typedef", "impl", "impl_block")
FUNCTION_KINDS = ("function", "method", "fn", "async_fn")
CLASS_TYPES = ("class", "struct", "enum", "trait")
FUNCTION_TYPES = ("function", "method")
BRIEF = 200


def label_contexts(g: Graph, inferred: Graph, functions: int = 20, briefs: int = 10, names: int = 1000) -> DataFrame:
    """(id, title, n_files, n_classes, files, classes, functions, briefs, children) of each node of inferred, whose contains edges
    say its members in g: what a name for it can be drawn from.

    Of signatures (titles without one) and comments of files the first few count, by the order of the contains edges and, in a
    file, of the edges of what it holds; of paths and class names the first `names` by name, and how many there are. A component
    without files names the components that it contains. Ranks are cut before rows come together, so a component of any size
    is a few lists.
    """
    first = g.nodes.groupBy("id").agg(F.min_by(F.struct("title", "node_type", F.lower("node_kind").alias("kind"), "file_path", _text(g.nodes, "signature").alias("signature"), _text(g.nodes, "doc_comment").alias("doc")), "ord").alias("x")).select("id", "x.*")
    first = cut(first, "nodes")
    held = inferred.edges.where("relation = 'contains'").join(inferred.nodes.select(F.col("id").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("component"), F.col("dst").alias("id"), "ord")
    members = cut(held.join(first, "id"), "members")
    path = F.coalesce("file_path", F.when(F.col("id").startswith("file:"), F.substring("id", 6, 1 << 30)))
    inside = g.edges.where("relation = 'defined_in'").select(F.col("dst").alias("file"), F.col("src").alias("id"), F.col("ord").alias("at"))
    below = g.edges.where("relation = 'contains'").join(first.where("node_type = 'file'").select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("file"), F.col("dst").alias("id"), F.col("ord").alias("at"))
    is_file = F.coalesce(F.col("node_type") == "file", F.lit(False))
    children = members.where(is_file).select("component", "ord", F.col("id").alias("file")).join(inside.unionByName(below), "file").join(first, "id")
    code = members.where(~is_file).withColumn("at", F.lit(0).cast("long")).unionByName(children, allowMissingColumns=True).select("component", "ord", "at", "title", "kind", F.coalesce("signature", "title").alias("signature"), "node_type", F.col("signature").isNotNull().alias("signed"))
    known = F.coalesce(F.col("kind").isin(*CLASS_KINDS, *FUNCTION_KINDS), F.lit(False))
    role = F.when(F.col("kind").isin(*CLASS_KINDS) | (~known & F.col("node_type").isin(*CLASS_TYPES)), "class").when(F.col("kind").isin(*FUNCTION_KINDS) | (~known & F.col("node_type").isin(*FUNCTION_TYPES)), "function").when(~known & F.col("signed"), "function")
    code = cut(code.withColumn("role", role), "code")

    def ranked(df: DataFrame, what: str, most: int) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("component").orderBy("key", "value"))
        return df.withColumn("rank", rank).where(F.col("rank") <= most).select("component", F.lit(what).alias("what"), "value")

    files = members.withColumn("value", path).where("value is not null").select("component", "value", F.lit(0).alias("key"))
    classes = code.where("role = 'class'").select("component", F.col("title").alias("value"), F.lit(0).alias("key")).distinct()
    found = code.where("role = 'function'").groupBy("component", F.col("signature").alias("value")).agg(F.min(F.struct("ord", "at")).alias("key"))
    brief = F.trim("doc")
    said = members.where(is_file & (brief != "")).select("component", F.concat(F.coalesce(path, "id"), F.lit(": "), brief_of(F.col("doc"))).alias("value"), F.col("ord").alias("key"))
    titles = inferred.nodes.groupBy("id").agg(F.min_by("title", "ord").alias("title"))
    lists = ranked(files, "files", names).unionByName(ranked(classes, "classes", names)).unionByName(ranked(found, "functions", functions)).unionByName(ranked(said, "briefs", briefs))
    parts = held.where(F.col("id").startswith("infer:component:")).join(titles, "id").select("component", F.col("title").alias("value"), F.lit(0).alias("key"))
    lists = lists.unionByName(ranked(parts.join(files.select("component"), "component", "left_anti"), "children", names))
    kinds = ("files", "classes", "functions", "briefs", "children")
    told = lists.groupBy("component").agg(*[F.sort_array(F.collect_list(F.when(F.col("what") == k, F.col("value")))).alias(k) for k in kinds])
    counts = files.groupBy("component").agg(F.count(F.lit(1)).alias("n_files")).join(classes.groupBy("component").agg(F.count(F.lit(1)).alias("n_classes")), "component", "full")
    none = F.array().cast("array<string>")
    out = titles.withColumnRenamed("id", "component").join(counts, "component", "left").join(told, "component", "left")
    return out.select(F.col("component").alias("id"), "title", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_files", "n_classes")], *[F.coalesce(k, none).alias(k) for k in kinds])


def _text(nodes: DataFrame, name: str):
    return F.col(name) if name in nodes.columns else F.lit(None).cast("string")


def brief_of(doc):
    """A comment of at most BRIEF characters; a longer one up to its last white space among these and one more, and an ellipsis."""
    head = F.substring(doc, 1, BRIEF + 1)
    cut_ = F.when(head.rlike("[ \\n\\t]"), F.regexp_replace(head, "(?s)[ \\n\\t][^ \\n\\t]*$", "")).otherwise(F.substring(doc, 1, BRIEF))
    return F.when(F.length(doc) > BRIEF, F.concat(F.rtrim(cut_), F.lit("\u2026"))).otherwise(doc)
