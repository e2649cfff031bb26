"""Analysis of code graphs: related tests, causal chains, failure traces."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.graph import Graph, metadata_of, related, trusted
from graphloom.lineage import Rounds, cut
from graphloom.operators.aggregates import caller_counts, risk_level
from graphloom.operators.traverse import bounded_path, impact_of_many, reach, steps_of

FORWARD = ("calls", "inherits", "imports", "overrides", "tests_for")
BACKWARD = ("calls", "imports", "overrides")
TEST_PATH = "(^|/)tests?/|(^|/)test_"


def impact_report(g: Graph, seeds: list[str], relations=None, minimum: float | None = None) -> DataFrame:
    """(id, part): what the seeds affect, split into code and tests, and the tests related to them."""
    frame = g.nodes.sparkSession.createDataFrame([(s,) for s in seeds], "id string")
    met = impact_of_many(g, frame, relations, minimum).select("id").distinct().where(~F.col("id").isin(seeds))
    found = g.nodes.join(met, "id").select("id", F.when(F.coalesce(F.col("file_path").rlike(TEST_PATH), F.lit(False)), "test").otherwise("code").alias("part"))
    return found.unionByName(related_tests(g, seeds).select("id", F.lit("test").alias("part"))).distinct()


def related_tests(g: Graph, seeds: list[str]) -> DataFrame:
    """(id): test files for the files of the seeds with all that is in them, and tests that call a seed."""
    files = g.nodes.where(F.col("id").isin(seeds)).select(F.concat(F.lit("file:"), "file_path").alias("dst")).distinct()
    tests = g.edges.where("relation = 'tests_for'").join(files, "dst", "left_semi").select(F.col("src").alias("id"))
    inside = g.edges.where("relation = 'defined_in'").join(tests.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    callers = g.edges.where((F.col("relation") == "calls") & F.col("dst").isin(seeds)).select(F.col("src").alias("id")).join(g.nodes.where(F.col("file_path").rlike(TEST_PATH)).select("id"), "id", "left_semi")
    return tests.unionByName(inside).unionByName(callers).distinct()


# How a chain names its links, forwards and backwards.
LINKS = {"f": {"calls": "calls", "inherits": "inherits", "imports": "imports", "overrides": "overrides", "tests_for": "tests"}, "b": {"calls": "called_by", "imports": "imported_by", "overrides": "overridden_by"}}
CHAINS = "symptom string, way string, id string, chain array<string>, links array<string>, weight double, sources int, place struct<k:int,back:boolean,weight:double,length:int,parent:string,ord:long>"


def best_first(steps: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """The chains (see CHAINS) by which a best-first search from each start meets nodes, of `depth` nodes at most.

    The search visits nodes by the product of weights along their chains, heaviest first (then short chains, then by id), and a
    node belongs to the first visited one that has a step to it, even where another step would be heavier. So the chain of a
    node follows from those of the nodes before it: each round gives every node the chain that the heaviest of its
    neighbours in the round before yields, and as chains are paths of bounded length, rounds come to rest.
    """
    now = cut(start, "chains")
    while True:
        ways = now.where(F.size("chain") < depth).select("symptom", "way", F.col("id").alias("at"), "chain", "links", "weight", "sources", F.col("place.k").alias("k"))
        met = ways.join(steps, ["way", "at"]).where(~F.array_contains("chain", F.col("to")))
        first = F.struct((-F.col("weight")).alias("heavy"), F.size("chain").alias("length"), "at", "ord", "chain", "links", "weight", "w", "link", "sources", "source", "k")
        best = met.groupBy("symptom", "way", F.col("to").alias("id")).agg(F.min(first).alias("x"))
        x = F.col("x")
        place = F.struct(x["k"].alias("k"), (F.col("way") == "b").alias("back"), x["heavy"].alias("weight"), x["length"].alias("length"), x["at"].alias("parent"), x["ord"].alias("ord"))
        new = start.unionByName(
            best.select(
                "symptom", "way", "id", F.concat(x["chain"], F.array("id")).alias("chain"), F.concat(x["links"], F.array(x["link"])).alias("links"),
                (x["weight"] * x["w"]).alias("weight"), (x["sources"] + x["source"]).alias("sources"), place.alias("place"),
            )
        )
        new, before = cut(new, "chains"), now
        now, key = new, ["symptom", "way", "chain"]
        if new.join(before, key, "left_anti").isEmpty() and before.join(new, key, "left_anti").isEmpty():
            return now


def _steps_near(steps: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """The steps(at, to, ...) that chains of `depth` nodes from the starts can take: those from what is at most depth - 2 steps off.
    All other steps are only read, never written or shuffled where what is near has few rows."""
    near = Rounds(steps.sparkSession, "at string")
    near.add(starts.select(F.col("id").alias("at")).distinct())
    taken = []
    for hop in range(max(0, depth - 1)):
        taken.append(cut(steps.join(near.last(), "at"), "taken"))
        if hop < depth - 2 and not near.add(taken[-1].select(F.col("to").alias("at")).distinct().join(near.all(), "at", "left_anti")):
            break
    out = taken[0] if taken else steps.limit(0)
    for more in taken[1:]:
        out = out.unionByName(more)
    return out.select(steps.columns)


def causal_chains(g: Graph, symptoms: list[str], depth: int = 4, most: int = 10) -> DataFrame:
    """(symptom, chain, links, weight, rank): best-first chains of at most `depth` nodes from each symptom, along calls, bases,
    imports, overrides and tests, and backwards along calls, imports and overrides, where tests are passed over.

    Chains that only begin another are left out; of the rest the `most` first ones of all symptoms stay: short ones first, then
    those with more nodes that are no tests, then in the order of the search.
    """
    spark = g.nodes.sparkSession
    path = F.coalesce("file_path", F.lit(""))
    is_test = F.contains(path, F.lit("/tests/")) | F.contains(path, F.lit("/test_"))
    w = F.coalesce(F.col("weight").cast("double"), F.lit(0.7))
    named = spark.createDataFrame([(s, k) for k, s in enumerate(dict.fromkeys(symptoms))], "id string, k int")
    steps = None
    for way, at, to in (("f", "src", "dst"), ("b", "dst", "src")):
        link = F.create_map(*[F.lit(v) for kv in LINKS[way].items() for v in kv])[F.col("relation")]
        one = g.edges.where(F.col("relation").isin(*LINKS[way])).select(F.lit(way).alias("way"), F.col(at).alias("at"), F.col(to).alias("to"), "ord", w.alias("w"), link.alias("link"))
        one = _steps_near(one, named.select("id"), depth)
        steps = one if steps is None else steps.unionByName(one)
    steps = cut(steps.groupBy("way", "at", "to").agg(F.min(F.struct("ord", "w", "link")).alias("x")).select("way", "at", "to", "x.ord", "x.w", "x.link"), "near")
    asked = steps.select(F.col("to").alias("id")).unionByName(named.select("id")).distinct()
    there = cut(g.nodes.join(asked, "id", "left_semi").groupBy("id").agg(F.min_by((~is_test).cast("int"), "ord").alias("source")), "sources")
    steps = cut(steps.join(there.withColumnRenamed("id", "to"), "to").where("way = 'f' or source = 1"), "steps")
    seeds = there.join(named, "id").withColumn("way", F.explode(F.array(F.lit("f"), F.lit("b"))))
    place = F.struct(F.col("k").alias("k"), (F.col("way") == "b").alias("back"), F.lit(-1.0).alias("weight"), F.lit(0).alias("length"), F.lit("").alias("parent"), F.lit(0).cast("long").alias("ord"))
    start = seeds.select(F.col("id").alias("symptom"), "way", "id", F.array("id").alias("chain"), F.array().cast("array<string>").alias("links"), F.lit(1.0).alias("weight"), F.col("source").alias("sources"), place.alias("place"))
    chains = best_first(steps, cut(start, "symptoms"), depth).where(F.size("chain") > 1)
    # a chain that another begins with is the chain of that one's parent, in the same way or in the other
    longer = chains.where(F.size("chain") > 2).select("symptom", F.explode(F.transform(F.sequence(F.lit(2), F.size("chain") - 1), lambda n: F.slice("chain", 1, n))).alias("chain")).distinct()
    order = [F.size("chain"), F.desc("sources"), "place", "id"]
    ends = chains.join(longer, ["symptom", "chain"], "left_anti").orderBy(*order).limit(most)
    rank = F.row_number().over(Window.orderBy(*order))  # at most `most` rows
    return ends.select("symptom", F.array_join("chain", " > ").alias("chain"), F.array_join("links", " > ").alias("links"), F.round("weight", 6).alias("weight"), rank.alias("rank"))


def _by_suffix(names: DataFrame, column: str, wanted: DataFrame, key: str) -> DataFrame:
    """names joined with wanted where the column ends with the key, by equality of suffixes of the lengths that keys have."""
    lengths = wanted.agg(F.collect_set(F.length(key)).alias("lengths"))  # one row; as many as keys have lengths
    ends = names.join(F.broadcast(lengths)).withColumn("length", F.explode(F.filter("lengths", lambda n: (n > 0) & (n <= F.length(column)))))
    return ends.withColumn(key, F.substring(F.col(column), F.length(column) - F.col("length") + 1, F.col("length"))).drop("lengths", "length").join(wanted, key)


def resolve_tests(g: Graph, tests: list[str] | DataFrame) -> DataFrame:
    """(test, id, rule): the node of each test identifier (file::class::name, or a name alone) .

    Rules in order: 1 the name and a path that ends with the file, 2 the end of a name and the file, 3 the name anywhere, 4 the
    end of a name anywhere, 5 any test node of the file; within a rule the first node. Tests without a node are left out.
    """
    tests = g.nodes.sparkSession.createDataFrame([(t,) for t in tests], "test string") if isinstance(tests, list) else tests
    t = tests.select("test", F.element_at(F.split("test", "::"), -1).alias("short"), F.when(F.contains("test", F.lit("::")), F.split("test", "::")[0]).otherwise("").alias("file")).distinct()
    is_test = F.coalesce(metadata_of(g.nodes, "is_test") == "true", F.lit(False))
    n = g.nodes.select("id", "title", F.coalesce("file_path", F.lit("")).alias("file_path"), "ord", is_test.alias("is_test"))
    in_file = (F.col("file") != "") & F.endswith("file_path", F.col("file"))
    exact = F.col("title") == F.col("short")
    by_name = _by_suffix(n, "title", t, "short").withColumn("rule", F.when(in_file & exact, 1).when(in_file, 2).when(exact, 3).otherwise(4))
    by_file = _by_suffix(n.where("is_test"), "file_path", t.where("file <> ''"), "file").withColumn("rule", F.lit(5))
    met = by_name.select("test", "rule", "ord", "id").unionByName(by_file.select("test", "rule", "ord", "id"))
    return met.groupBy("test").agg(F.min(F.struct("rule", "ord", "id")).alias("x")).select("test", "x.id", "x.rule")


def failure_analysis(g: Graph, changed: list[str], tests: list[str] | DataFrame) -> DataFrame:
    """(test, node, via, changed, link): how each failing test is linked to what changed.

    link is direct (the test calls a changed node, or one of a changed name; a row for each), indirect (one node between, the
    first that leads there), file (the test's file tests the file of a changed node), none, or unknown for tests without a
    node. Only calls count, and a weaker link only where there is no stronger one.
    """
    spark = g.nodes.sparkSession
    t = spark.createDataFrame([(x,) for x in tests], "test string") if isinstance(tests, list) else tests.select("test").distinct()
    known = cut(resolve_tests(g, t).select("test", F.col("id").alias("node")), "tests")
    c = g.nodes.where(F.col("id").isin(changed))
    names = c.select("title").distinct()
    hit = cut(g.nodes.join(names, "title", "left_semi").select("id").unionByName(c.select("id")).distinct(), "changed")
    there = g.nodes.select("id").distinct()
    calls = g.edges.where("relation = 'calls'").join(there.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst", "ord")
    first = known.join(calls, known["node"] == calls["src"]).select("test", "node", F.col("dst").alias("via"), F.col("ord").alias("first"))
    first = cut(first, "callees")
    direct = first.join(hit.withColumnRenamed("id", "via"), "via", "left_semi").select("test", "node", F.lit(None).cast("string").alias("via"), F.col("via").alias("changed"), F.lit("direct").alias("link")).distinct()
    into = calls.join(hit.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("via"), F.col("dst").alias("changed"), F.col("ord").alias("second"))
    second = first.join(direct.select("test"), "test", "left_anti").join(into, "via").groupBy("test", "node").agg(F.min(F.struct("first", "second", "via", "changed")).alias("x"))
    second = second.select("test", "node", "x.via", "x.changed", F.lit("indirect").alias("link"))
    done = cut(direct.unionByName(second), "links")
    paths = g.nodes.select(F.col("id").alias("node"), "file_path")
    left = known.join(done.select("test"), "test", "left_anti").join(paths, "node").select("test", "node", F.concat(F.lit("file:"), "file_path").alias("src"))
    files = g.nodes.join(c.select("file_path").distinct(), "file_path", "left_semi").select(F.col("id").alias("dst"))
    tested = g.edges.where("relation = 'tests_for'").join(files, "dst", "left_semi").select("src", "dst", "ord")
    by_file = left.join(tested, "src").groupBy("test", "node").agg(F.min(F.struct("ord", "dst")).alias("x")).select("test", "node", F.lit(None).cast("string").alias("via"), F.col("x.dst").alias("changed"), F.lit("file").alias("link"))
    linked = done.unionByName(by_file)
    rest = t.join(linked.select("test"), "test", "left_anti").join(known, "test", "left")
    nothing = F.lit(None).cast("string")
    return linked.unionByName(rest.select("test", "node", nothing.alias("via"), nothing.alias("changed"), F.when(F.col("node").isNull(), "unknown").otherwise("none").alias("link")))


def failure_trace(g: Graph, changed: str, test: str, most: int = 5) -> DataFrame:
    """(position, id): the way from what changed to the test."""
    path = bounded_path(g, test, changed, most)
    return path.select((F.max("position").over(Window.partitionBy()) - F.col("position")).alias("position"), "id")


def closest_node(nodes: DataFrame, sites: DataFrame, tolerance: int = 3) -> DataFrame:
    """(site, id): the node of the same file whose start line is nearest to a site's line, within a tolerance."""
    met = sites.join(nodes.select("id", "file_path", "start_line"), "file_path").withColumn("far", F.abs(F.col("start_line") - F.col("line"))).where(F.col("far") <= tolerance)
    return met.groupBy("site").agg(F.min_by("id", F.struct("far", "id")).alias("id"))


def code_layer(g: Graph) -> Graph:
    """Extracted nodes and edges alone."""
    return Graph(g.nodes.where("source = 'extract'"), g.edges.where("edge_source = 'extract'"), g.project)


def low_risk_alternatives(g: Graph, failed_files: list[str], most_callers: int, most: int = 5) -> DataFrame:
    """(id, callers, callees): functions in or below the directories of files that failed, but in other files, with few
    callers; the fewest first, then in order. Tests are left out."""
    folders = sorted({f.rpartition("/")[0] for f in failed_files if "/" in f})
    path, near = F.coalesce("file_path", F.lit("")), F.lit(False)
    for folder in folders:
        near = near | path.startswith(folder)
    code = code_layer(g)
    wanted = code.nodes.where((F.col("node_kind") == "Function") & near & ~path.isin(failed_files) & (F.coalesce(metadata_of(g.nodes, "is_test"), F.lit("false")) != "true"))
    found = caller_counts(code).join(wanted.select("id", "ord"), ["id", "ord"], "left_semi").where(F.col("callers") <= most_callers)
    return found.orderBy("callers", "ord").limit(most).select("id", "callers", "callees")


def file_impact(g: Graph, files: list[str], relations=None, minimum: float | None = None) -> DataFrame:
    """(id, part, risk, hidden): code that leads to what is in some files, itself included where it is on a cycle; test or
    source; how risky the change is by the most callers of what the files hold; and how many edges below the confidence the
    walks from each of the files' nodes passed by, counted for each of them."""
    code = code_layer(g)
    eligible = code.edges.where(related(relations) & trusted(minimum))
    changed = code.nodes.where(F.col("file_path").isin(files))
    met = cut(reach(steps_of(eligible, "in"), changed.select(F.col("id").alias("seed")).distinct()).select("seed", "id"), "met")
    up = eligible.join(met.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("id")).distinct()
    is_test = F.coalesce(metadata_of(g.nodes, "is_test"), F.lit("false")) == "true"
    found = g.nodes.join(up, "id", "left_semi").select("id", F.when(is_test, "test").otherwise("source").alias("part")).distinct()
    low = code.edges.where(related(relations) & ~trusted(minimum)).select("src", F.col("dst").alias("id"))
    hidden = met.join(low, "id").agg(F.count(F.lit(1)).alias("hidden"))
    counts = caller_counts(code).join(changed.where(F.col("node_kind").isin("Function", "Method", "Class") & ~is_test).select("id").distinct(), "id", "left_semi")
    risk = counts.agg(risk_level(F.coalesce(F.max("callers"), F.lit(0))).alias("risk"))
    return found.join(F.broadcast(risk)).join(F.broadcast(hidden))  # frames of one row


def _short_name(test: str) -> str:
    return test.rpartition("::")[2] if "::" in test else test.split(" (")[0].strip()


def _test_names(text: str) -> list[str]:
    """Test names of a JSON list, else one a line."""
    try:
        found = json.loads(text)
        if isinstance(found, list) and all(isinstance(x, str) for x in found):
            return found
    except ValueError:
        pass
    return [x.strip() for x in text.splitlines() if x.strip()]


def symptom_nodes(g: Graph, problem: str, tests: str) -> DataFrame:
    """(id, why): code that a problem names: its tests; functions after ", in " of a traceback; quoted names; names in camel
    case of classes. Without any, code whose names hold two words of a test's name (or its only one), and what the file of
    the test's class tests."""
    names = _test_names(tests)
    title, path = F.col("title"), F.coalesce("file_path", F.lit(""))
    beside_tests = F.contains(path, F.lit("/tests/")) | F.contains(path, F.lit("/test_"))
    function, class_ = F.col("node_kind") == "Function", F.col("node_kind") == "Class"
    ident = re.compile(r"\w+\Z")
    framed, quoted, camel = set(), set(), set()
    for line in map(str.strip, problem.splitlines()):
        if ", in " in line:
            name = line.rpartition(", in ")[2].strip().lstrip("<").rstrip(">")
            framed |= {name} if len(name) >= 3 and ident.match(name) else set()
        for mark in "'\"`":
            quoted |= {w for x in line.split(mark)[1::2] if 3 <= len(w := x.strip()) <= 60 and ident.match(w)}
    for word in re.split(r"[\s,()'\"`]", problem):
        word = word.strip(".:;")
        if len(word) >= 4 and ident.match(word) and sum(c.isupper() for c in word) >= 2 and any(c.islower() for c in word):
            camel.add(word)
    is_test = F.lit(False)
    for name in {_short_name(t) for t in names}:
        is_test = is_test | F.endswith(title, F.lit(name))
    why = (
        F.when(function & is_test & (beside_tests | title.startswith("test_")), "test")
        .when(function & title.isin(sorted(framed)), "traceback")
        .when((function | class_) & title.isin(sorted(quoted)), "quoted")
        .when(class_ & title.isin(sorted(camel)), "class")
    )
    found = g.nodes.select("id", why.alias("why")).where("why is not null").distinct()
    if not found.isEmpty():
        return found
    hit, low = F.lit(False), F.lower("title")
    for t in names:
        words = [w.lower() for w in _short_name(t).split("_") if len(w) >= 3 and w not in ("test", "tests")]
        if words:
            n = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
            hit = hit | (n >= (1 if len(words) == 1 else 2))
    by_word = g.nodes.where(hit & ~beside_tests).select("id", F.lit("keyword").alias("why"))
    classes = sorted({t.split(" (")[1].rstrip(")").rpartition(".")[2] for t in names if " (" in t})
    tested = g.nodes.where(class_ & title.isin(classes)).select(F.concat(F.lit("file:"), path).alias("src")).distinct()
    to = g.edges.where("relation = 'tests_for'").join(tested, "src", "left_semi").select("dst").distinct()
    held = g.nodes.where("node_kind <> 'File'").withColumn("dst", F.explode(F.array("id", F.concat(F.lit("file:"), path)))).join(to, "dst", "left_semi").select("id", F.lit("tested").alias("why"))
    return by_word.unionByName(held.join(by_word, "id", "left_anti")).distinct()


def shares_import(g: Graph, test: str, changed: list[str]) -> bool:
    """Whether a test imports a changed node or its file."""
    ends = g.nodes.where(F.col("id").isin(changed)).select(F.explode(F.array("id", F.concat(F.lit("file:"), F.coalesce("file_path", F.lit(""))))).alias("dst"))
    return not g.edges.where((F.col("src") == test) & (F.col("relation") == "imports")).join(ends, "dst", "left_semi").isEmpty()
