"""Reports and small decisions: drift between graph and documents, backfill plans, working memory, replanning, names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import infer_doc_path, parse_status
from graphloom.graph import Graph

# The categories of findings in their order.
CATEGORY_ORDER = ("missing_node", "dangling_doc_pointer", "status_drift")


def canonical_paths(nodes: DataFrame) -> DataFrame:
    """(node_id, path, node_status): the document of each node, as stated or as its type and id say."""
    stated = F.regexp_replace("doc_path", "\\\\", "/")
    path = F.coalesce(stated, infer_doc_path(F.col("id"), F.col("node_type")))
    return nodes.select(F.col("id").alias("node_id"), path.alias("path"), F.col("status").alias("node_status"), "ord").where("path is not null")


def drift(nodes: DataFrame, artifacts: DataFrame, ignore: tuple[str, ...] = ()) -> DataFrame:
    """(category, severity, node_id, path, auto_fixable): documents that no node points to (warning), nodes whose document is
    missing (error), documents that state another status than their node, or one that is unknown (warning; only the first
    kind can be mended by itself). artifacts: path, status. Of nodes with one path the last inserted counts for the status."""
    linked = canonical_paths(nodes)
    wanted = linked.where(~F.col("node_id").isin(*ignore)) if ignore else linked
    parent = F.element_at(F.split("path", "/"), -2)
    orphan = artifacts.join(linked, "path", "left_anti")
    orphan = orphan.where(~F.coalesce(parent.isin(*ignore), F.lit(False))) if ignore else orphan
    orphan = orphan.select(F.lit("missing_node").alias("category"), F.lit("warning").alias("severity"), F.lit(None).cast("string").alias("node_id"), "path", F.lit(False).alias("auto_fixable"))
    missing = wanted.join(artifacts, "path", "left_anti").select(F.lit("dangling_doc_pointer").alias("category"), F.lit("error").alias("severity"), "node_id", "path", F.lit(False).alias("auto_fixable"))
    last = linked.groupBy("path").agg(F.max_by(F.struct("node_id", "node_status"), "ord").alias("n")).select("path", "n.*")
    last = last.where(~F.col("node_id").isin(*ignore)) if ignore else last
    stated = parse_status(F.col("status"))
    differing = last.join(artifacts.where("status is not null"), "path").where(stated.isNull() | (stated != F.col("node_status")))
    differing = differing.select(F.lit("status_drift").alias("category"), F.lit("warning").alias("severity"), "node_id", "path", stated.isNotNull().alias("auto_fixable"))
    return orphan.unionByName(missing).unionByName(differing)


def drift_order(found: DataFrame) -> DataFrame:
    """Findings by category, errors first, then node and path, nulls first."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category"))
    return found.orderBy(rank, F.col("severity") != "error", F.asc_nulls_first("node_id"), "path")


def drift_places(found: DataFrame) -> DataFrame:
    """Findings with their place in that order, from 0: a place within each category and how many come in categories before."""
    rank = F.array_position(F.array(*map(F.lit, CATEGORY_ORDER)), F.col("category"))
    own = F.row_number().over(Window.partitionBy("category").orderBy(F.col("severity") != "error", F.asc_nulls_first("node_id"), "path")) - 1
    sizes = found.groupBy(rank.alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("rank", (F.sum("n").over(Window.orderBy("rank")) - F.col("n")).alias("before"))  # a row for each category
    return found.withColumn("rank", rank).withColumn("own", own).join(F.broadcast(before), "rank").withColumn("place", (F.col("before") + F.col("own")).cast("long")).drop("rank", "own", "before")


def drift_summary(found: DataFrame) -> DataFrame:
    """(category, severity, n, any_error)."""
    counts = found.groupBy("category", "severity").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("any_error", F.bool_or(F.col("severity") == "error").over(Window.partitionBy()))


def plan_backfill(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, outcome): set, already_set, not_applicable or file_missing for the document path of each node."""
    guess = infer_doc_path(F.col("id"), F.col("node_type"))
    there = files.select(F.col("path").alias("guess")).distinct().withColumn("there", F.lit(True))
    found = nodes.withColumn("guess", guess).join(there, "guess", "left")
    outcome = F.when(F.col("doc_path").isNotNull(), "already_set").when(F.col("guess").isNull(), "not_applicable").when(F.col("there"), "set").otherwise("file_missing")
    return found.select("id", F.coalesce("doc_path", "guess").alias("path"), outcome.alias("outcome"))


def attempt_score(primary_passed: Column, secondary_passed: Column, regressions: Column) -> Column:
    """A thousand for each primary test that passes, if nothing else broke, and one for each other test."""
    return primary_passed * 1000 * F.when(regressions == 0, 1).otherwise(0) + secondary_passed


def best_attempts(log: DataFrame) -> DataFrame:
    """(task, best_round, best_score): the first round with the highest score. log: task, round, score."""
    return log.groupBy("task").agg(F.min(F.struct((-F.col("score")).alias("s"), "round")).alias("x")).select("task", F.col("x.round").alias("best_round"), (-F.col("x.s")).alias("best_score"))


def touched(log: DataFrame) -> DataFrame:
    """(name, tried, failed): how often each name was changed and how often that failed. log: names, passed."""
    return log.select(F.explode("names").alias("name"), "passed").groupBy("name").agg(F.count(F.lit(1)).alias("tried"), F.count_if(~F.col("passed")).alias("failed"))


def replan(count: Column, limit: int, blocker: Column, retries: Column, most_retries: int = 2) -> Column:
    """escalate at the limit of plans and for a blocker; else retry while retries are left, with or without output; else escalate."""
    return F.when((count >= limit) | blocker, "escalate").when(retries < most_retries, "retry").otherwise("escalate")


def unique_ids(df: DataFrame) -> DataFrame:
    """id made unique in order: the second gets -2 and so on, from the thousandth on -overflow."""
    k = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    return df.withColumn("id", F.when(k == 1, F.col("id")).when(k <= 999, F.concat_ws("-", "id", k.cast("string"))).otherwise(F.concat(F.col("id"), F.lit("-overflow"))))


def unique_titles(df: DataFrame) -> DataFrame:
    """title with the end of the id where several have it."""
    twice = F.count(F.lit(1)).over(Window.partitionBy("title")) > 1
    return df.withColumn("title", F.when(twice, F.concat_ws("-", "title", F.element_at(F.split("id", "[:-]"), -1))).otherwise(F.col("title")))


def snippets(sources: DataFrame, nodes: DataFrame, most: int = 40) -> DataFrame:
    """(id, snippet): the lines of each node, cut at `most`. sources: path, content."""
    n = F.least(F.col("end_line") - F.col("start_line") + 1, F.lit(most))
    met = nodes.where("start_line is not null").join(sources, nodes["file_path"] == sources["path"])
    return met.select("id", F.array_join(F.slice(F.split("content", "\n"), F.col("start_line"), n), "\n").alias("snippet"))


def key_traceback(text: Column, most: int = 600) -> Column:
    """The traceback of a text up to an empty line, a ruler or a verdict; else the surroundings of a verdict; else the text's end."""
    found = F.instr(text, "Traceback (most recent call last)")
    chunk = F.substring(text, found, F.length(text))
    end = F.lit(None).cast("int")
    for mark in ("\nFAILED", "\n=====", "\n\n"):
        end = F.when(F.instr(chunk, mark) > 0, F.instr(chunk, mark) - 1).otherwise(end)
    out = F.substring(text, F.greatest(F.length(text) - most + 1, F.lit(1)), F.lit(most))
    for mark in ("FAILED ", "ERROR:", "FAIL:"):
        at = F.instr(text, mark)
        start = F.greatest(at - 1 - 200, F.lit(0))
        out = F.when(at > 0, F.substring(text, start + 1, F.least(at - 1 + most, F.length(text)) - start)).otherwise(out)
    return F.when(found > 0, F.substring(chunk, F.lit(1), F.least(F.coalesce(end, F.length(chunk)), F.lit(most)))).otherwise(out)


def tool_history(g: Graph, node: str) -> DataFrame:
    """(hop, ord, tool_name, times): tool records of a node and of all that lead to it, the farthest first. times is how often a
    record comes up when every way is told, as one that leads there on two ways is told twice; null behind a cycle."""
    from graphloom.operators.traverse import path_counts, reach, seed_frame, steps_of

    met = reach(steps_of(g.edges, "in"), seed_frame(g, node)).select("id", "hop").join(path_counts(g, node), "id")
    return g.nodes.join(met, "id").select("hop", "ord", "times", F.explode("knowledge.tool_history").alias("t")).select("hop", "ord", "t.tool_name", "times").orderBy(F.desc("hop"), "ord")


def should_sync(path: Column, ignore: list[str]) -> Column:
    """Whether a change of this path asks for a sync: a source file that is neither hidden nor ignored."""
    from graphloom.functions.text import ignored
    from graphloom.sources.io import EXTENSIONS

    kind = F.lower(F.regexp_extract(path, "\\.([A-Za-z]+)$", 1)).isin(list(EXTENSIONS))
    return kind & ~path.rlike("(^|/)\\.(git|graph)/") & ~ignored(path, ignore)
