"""Context assembly: candidates around a node, scored, packed into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.text import estimate_tokens
from graphloom.graph import Graph
from graphloom.lineage import Rounds, cut

# How relevant what is reached over a relation is, and the order of categories.
RELATION_SCORES = {
    "calls": 1.0, "imports": 1.0, "type_reference": 0.8, "inherits": 0.8, "implements": 0.8, "uses": 0.8, "contains": 0.6, "defined_in": 0.6,
    "depends_on": 0.4, "part_of": 0.4, "blocks": 0.4, "tests_for": 0.4,
}
CATEGORIES = ("target", "direct", "caller", "test", "transitive")
SMALLEST = 32


def relation_score(relation: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in RELATION_SCORES.items() for x in kv])
    return F.coalesce(table[relation], F.lit(0.2))


def candidate_score(relation: Column, hop: Column) -> Column:
    """(0.6 relation + 0.3 / hop + 0.1), a fifth less beyond the first hop."""
    base = 0.6 * relation_score(relation) + 0.3 / F.greatest(hop, F.lit(1)) + 0.1
    return base * F.when(hop > 1, 0.8).otherwise(1.0)


def gather_dependencies(g: Graph, targets: list[str], depth: int = 2) -> DataFrame:
    """(id, hop, relation): existing nodes that the targets lead to; a missing node ends its branch.

    A node's relation is that of the edge that discovers it first: targets in their order, edges in theirs, hop by hop. The
    orders along a way make its key, so that of all ways of one length the smallest key is the first discovery.
    """
    spark = g.nodes.sparkSession
    steps = cut(g.edges.join(g.nodes.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst", "relation", "ord"), "steps")
    seen = spark.createDataFrame([(t, 0, None, [k]) for k, t in enumerate(targets)], "id string, hop int, relation string, key array<long>")
    frontier, found = seen, Rounds(spark, "id string, hop int, relation string, key array<long>")
    found.add(seen)
    for hop in range(1, depth + 1):
        met = frontier.select(F.col("id").alias("src"), "key").join(steps, "src").groupBy(F.col("dst").alias("id"))
        met = met.agg(F.min(F.struct(F.concat("key", F.array("ord")).alias("key"), "relation")).alias("x")).join(found.all().select("id"), "id", "left_anti")
        if not found.add(met.select("id", F.lit(hop).alias("hop"), F.col("x.relation").alias("relation"), F.col("x.key").alias("key"))):
            break
        frontier = found.last()
    return found.all().where("hop > 0").select("id", "hop", "relation")


def gather_callers(g: Graph, targets: list[str]) -> DataFrame:
    """(id, hop, relation, category): sources of edges into the targets; the first edge of each decides between caller and test."""
    first = g.edges.where(F.col("dst").isin(targets)).groupBy(F.col("src").alias("id")).agg(F.min_by("relation", "ord").alias("relation"))
    first = first.where(~F.col("id").isin(targets)).join(g.nodes.select("id"), "id", "left_semi")
    return first.select("id", F.lit(1).alias("hop"), "relation", F.when(F.col("relation") == "tests_for", "test").otherwise("caller").alias("category"))


def candidates(g: Graph, targets: list[str], depth: int = 2) -> DataFrame:
    """(id, hop, relation, category, score, tokens) of everything that may go into the context."""
    spark = g.nodes.sparkSession
    own = spark.createDataFrame([(t,) for t in targets], "id string").select("id", F.lit(0).alias("hop"), F.lit("implements").alias("relation"), F.lit("target").alias("category"))
    deps = gather_dependencies(g, targets, depth).withColumn("category", F.when(F.col("hop") == 1, "direct").otherwise("transitive"))
    callers = gather_callers(g, targets).join(deps.select("id"), "id", "left_anti")
    every = own.unionByName(deps).unionByName(callers)
    text = F.concat_ws("\n", *[c for c in ("title", "signature", "description", "doc_comment", "body") if c in g.nodes.columns])
    nodes = g.nodes.groupBy("id").agg(F.min_by(estimate_tokens(text), "ord").alias("tokens"), F.min("ord").alias("ord"))
    return every.join(nodes, "id").withColumn("score", candidate_score(F.col("relation"), F.col("hop")))


def fit_budget(found: DataFrame, budget: int = 8000) -> DataFrame:
    """(id, category, tokens, state) by category, hop, score and order: targets are always included; of the rest what fits is
    included, what does not is cut to what is left if that is SMALLEST tokens at least, and smaller ones after it may still fit.

    Every item costs a token at least, so beyond the first `budget` items nothing is left: only those are gathered, however
    many callers a hub has; the others are dropped where they are.
    """
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    ranked = found.select(rank.cast("int").alias("rank"), F.col("hop").cast("int").alias("hop"), (-F.col("score")).alias("s"), "ord", "id", "category", F.greatest(F.lit(1), F.col("tokens")).cast("int").alias("tokens"))
    order = ["rank", "hop", "s", "ord", "id"]
    first = ranked.orderBy(*order).limit(budget + 1)
    items = F.array_sort(F.collect_list(F.struct(*order, "category", "tokens")))
    start = F.struct(F.lit(budget).alias("left"), F.array().cast("array<struct<id:string,category:string,tokens:int,state:string>>").alias("out"))

    def step(acc, x):
        target, fits, cut = x["rank"] == 1, x["tokens"] <= acc["left"], acc["left"] >= SMALLEST
        used = F.when(target | fits, x["tokens"]).when(cut, acc["left"]).otherwise(0)
        state = F.when(target | fits, "included").when(cut, "truncated").otherwise("dropped")
        one = F.struct(x["id"].alias("id"), x["category"].alias("category"), used.cast("int").alias("tokens"), state.alias("state"))
        return F.struct(F.greatest(F.lit(0), acc["left"] - used).cast("int").alias("left"), F.concat(acc["out"], F.array(one)).alias("out"))

    kept = first.agg(items.alias("items")).select(F.explode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("x")).select("x.*")
    rest = ranked.join(F.broadcast(kept.select("id", "category")), ["id", "category"], "left_anti")  # budget + 1 rows at most
    rest = rest.select("id", "category", F.when(F.col("rank") == 1, F.col("tokens")).otherwise(0).cast("int").alias("tokens"), F.when(F.col("rank") == 1, "included").otherwise("dropped").alias("state"))
    return kept.unionByName(rest)


def assemble_context(g: Graph, targets: list[str], budget: int = 8000, depth: int = 2) -> DataFrame:
    return fit_budget(candidates(g, targets, depth), budget)


def render_context(g: Graph, packed: DataFrame) -> DataFrame:
    """One Markdown text with a section for each category."""
    titles = g.nodes.groupBy("id").agg(F.min_by("title", "ord").alias("title"))
    rank = F.array_position(F.array(*map(F.lit, CATEGORIES)), F.col("category"))
    lines = packed.where("state <> 'dropped'").join(titles, "id").groupBy("category").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("- "), "id", F.lit(": "), "title"))), "\n").alias("body"))
    sections = lines.select(rank.alias("rank"), F.concat(F.lit("## "), "category", F.lit("\n"), "body").alias("section"))
    return sections.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "section"))), lambda x: x["section"]), "\n\n").alias("text"))


def passes_filters(node_id: Column, node_type: Column, path: Column, exclude: list[str], include: list[str]) -> Column:
    """Not excluded, and, if there are patterns, of a type (type:x) or under a path glob that one of them names."""
    from graphloom.functions.text import glob_to_regex

    ok = ~node_id.isin(exclude) if exclude else F.lit(True)
    if include:
        some = F.lit(False)
        for p in include:
            some = some | (F.coalesce(node_type == p[5:], F.lit(False)) if p.startswith("type:") else F.coalesce(path.rlike(glob_to_regex(p)), F.lit(False)))
        ok = ok & some
    return ok
