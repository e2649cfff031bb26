"""Extraction: source text to nodes and edges. Python is parsed with the ast module; Rust and TypeScript by patterns.

Parsing runs per file inside mapInPandas-like Arrow batches; resolving names is joins.
"""

from __future__ import annotations

import ast
import re
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import language_of
from graphloom.lineage import cut, measured_joins, small_tasks

# Executors need no copy of this package: the parsers travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FACT = "path string, kind string, name string, scope string, line int, end_line int, target string, in_error_path boolean, signature string, doc string"
RUST = (
    ("function", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(\w+)")),
    ("class", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)")),
    ("enum", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)")),
    ("trait", re.compile(r"^\s*(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(\w+)")),
    ("impl", re.compile(r"^\s*(?:unsafe\s+)?impl(?:\s*<[^{]*?>)?\s+(?:([\w:]+)(?:<[^{]*?>)?\s+for\s+)?(?:[\w]+::)*(\w+)")),
    ("module", re.compile(r"^\s*(?:pub\s+)?mod\s+(\w+)\s*[{;]")),
)
TYPESCRIPT = (
    ("function", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*(\w+)")),
    ("function", re.compile(r"^\s*(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s*)?\([^)]*\)\s*(?::[^=]+)?=>")),
    ("class", re.compile(r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([\w.]+))?")),
    ("interface", re.compile(r"^\s*(?:export\s+)?interface\s+(\w+)(?:<[^{]*?>)?(?:\s+extends\s+([\w.]+))?")),
    ("enum", re.compile(r"^\s*(?:export\s+)?(?:const\s+)?enum\s+(\w+)")),
)
MEMBER = re.compile(r"^\s*(?:(?:public|private|protected|static|readonly|async|override|get|set)\s+)*(\w+)\s*(?:<[^(]*>)?\([^)]*\)\s*(?::[^{;]+)?\{")
CALL = re.compile(r"(?<![\w.])((?:\w+(?:\.|::))*)(\w+)\s*\(")
STRINGS = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)'|`[^`]*`")
KEYWORDS = frozenset("if for while match return fn let function switch catch class new await async loop else super typeof instanceof".split())
#: Raise with every change of what the parsers find: facts kept by content are those of one version.
PARSERS = 1
CONTAINERS = ("class", "trait", "interface", "impl", "enum")


def python_facts(path: str, text: str) -> list[tuple]:
    """Classes, methods, functions, imports, bases and calls of a Python file; none if it cannot be parsed."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError):
        return []
    out: list[tuple] = []

    def fact(kind, name, scope, node, target=None, error=False, signature=None, doc=None):
        out.append((path, kind, name, scope, getattr(node, "lineno", 1), getattr(node, "end_lineno", None) or 1, target, error, signature, doc))

    def dotted(node) -> str:
        return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""

    def calls(node, scope: str, error: bool):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            return
        error = error or isinstance(node, (ast.ExceptHandler, ast.Raise))
        if isinstance(node, ast.Call) and dotted(node.func):
            fact("call", dotted(node.func).split(".")[-1], scope, node, dotted(node.func), error)
        for child in ast.iter_child_nodes(node):
            calls(child, scope, error)

    def body(nodes, scope: str, in_class: bool):
        for node in nodes:
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = f"{scope}.{node.name}" if scope else node.name
                fact("method" if in_class else "function", node.name, own, node, scope or None, signature=f"def {node.name}({ast.unparse(node.args)})", doc=ast.get_docstring(node))
                for child in node.body:
                    calls(child, own, False)
                body(node.body, own, False)
            elif isinstance(node, ast.ClassDef):
                own = f"{scope}.{node.name}" if scope else node.name
                fact("class", node.name, own, node, scope or None, signature=f"class {node.name}", doc=ast.get_docstring(node))
                for b in node.bases:
                    if dotted(b):
                        fact("inherits", dotted(b).split(".")[-1], own, node, dotted(b))
                body(node.body, own, True)
            elif isinstance(node, ast.Import):
                for a in node.names:
                    fact("import", (a.asname or a.name).split(".")[0], scope, node, a.name)
            elif isinstance(node, ast.ImportFrom):
                for a in node.names:
                    fact("import", a.asname or a.name, scope, node, "." * node.level + (node.module or ""))
            else:
                if not scope:
                    calls(node, "", False)
                for child in ast.iter_child_nodes(node):
                    body([child], scope, in_class) if isinstance(child, ast.stmt) else None

    body(tree.body, "", False)
    return out


def pattern_facts(path: str, text: str, rules) -> list[tuple]:
    """Definitions, imports, bases and calls of a Rust or TypeScript file, line by line; braces tell what holds what."""
    out: list[list] = []
    held: list[tuple[str, str, int, list | None]] = []  # (kind, name, depth of its body, fact)
    depth, rust = 0, rules is RUST

    def fact(kind, name, scope, line, target=None, error=False, signature=None):
        out.append([path, kind, name, scope, line, line, target, error, signature, None])
        return out[-1]

    for i, line in enumerate(text.split("\n"), 1):
        code = STRINGS.sub('""', line.split("//")[0])
        scope = next((f[3] for k, _, _, f in reversed(held) if k in ("function", "method")), "")
        owner = next((n for k, n, _, _ in reversed(held) if k in CONTAINERS), None)
        opened, body = None, code
        found = next(((k, m) for k, rule in rules if (m := rule.match(code))), None)
        member = MEMBER.match(code) if not rust and found is None and owner and not scope else None
        if found or (member and member[1] not in KEYWORDS):
            kind, m = found or ("function", member)
            name = m[2] if kind == "impl" else m[1]
            signature = line.split("//")[0].strip().rstrip("{").strip()
            if kind == "impl":
                if m[1]:
                    fact("inherits", re.split("::", m[1])[-1], name, i, m[1])
                opened = (kind, name, depth, None)
            else:
                method = kind == "function" and owner is not None and not scope
                own = f"{owner}.{name}" if method else name
                opened = ("method" if method else kind, name, depth, fact("method" if method else kind, name, own, i, owner if method else None, False, signature))
                if kind in ("class", "interface") and m.re.groups > 1 and m[2]:
                    fact("inherits", m[2].split(".")[-1], own, i, m[2])
                scope = own if kind == "function" else scope
                body = code.partition("{")[2] if kind == "function" else ""
        else:
            m = re.match(r"\s*(?:pub\s+)?use\s+([\w:]+)(?:::\{([^}]*)\})?", code) if rust else re.match(r"\s*import\s+(.*?)\s*from\s+['\"]([^'\"]+)", line)
            if m:
                target = m[1] if rust else m[2]
                names = (m[2] or re.split("::", m[1])[-1]) if rust else m[1]
                for n in re.findall(r"\w+", re.sub(r"\w+\s+as\s+", "", names)):
                    fact("import", n, "", i, target)
                body = ""
        if scope and body:
            out += [[path, "call", c, scope, i, i, q + c, "Err(" in code or "catch" in code or "throw" in code, None, None] for q, c in CALL.findall(body) if c not in KEYWORDS]
        if opened and "{" in code:
            held.append(opened)
        depth += code.count("{") - code.count("}")
        while held and depth <= held[-1][2]:
            done = held.pop()
            if done[3]:
                done[3][5] = i
    return [tuple(f) for f in out]


def spread(sources: DataFrame) -> DataFrame:
    """sources dealt evenly by path to some tasks for each core, for parsing takes far longer than reading: a file of a few MB, that
    one task reads, may hold a million texts."""
    spark = sources.sparkSession
    return sources.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "path")


def facts(sources: DataFrame) -> DataFrame:
    """One row for each definition, import, base and call of sources(path, content)."""

    def run(batches):
        for batch in batches:
            rows = []
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ext = (path or "").rpartition(".")[2].lower()
                if ext == "py":
                    rows += python_facts(path, text or "")
                elif ext in ("rs", "ts", "tsx", "js", "jsx"):
                    rows += pattern_facts(path, text or "", RUST if ext == "rs" else TYPESCRIPT)
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.string(), pa.string()]
            names = [x.split()[0] for x in FACT.split(", ")]
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return spread(sources.select("path", "content")).mapInArrow(run, FACT)


def node_id(kind, path, scope):
    return F.concat(F.when(kind == "method", "method:").when(kind == "class", "class:").when(kind == "function", "func:").otherwise(F.concat(kind, F.lit(":"))), path, F.lit(":"), scope)


def definitions(found: DataFrame) -> DataFrame:
    """(id, title, node_type, file_path, scope, start_line, end_line, signature, doc_comment) of definitions and files."""
    defs = found.where(~F.col("kind").isin("import", "call", "inherits"))
    own = defs.select(node_id(F.col("kind"), F.col("path"), F.col("scope")).alias("id"), F.col("name").alias("title"), F.col("kind").alias("node_type"), F.col("path").alias("file_path"), "scope", F.col("line").alias("start_line"), "end_line", "signature", F.col("doc").alias("doc_comment"))
    files = found.select("path").distinct().select(F.concat(F.lit("file:"), "path").alias("id"), F.element_at(F.split("path", "/"), -1).alias("title"), F.lit("file").alias("node_type"), F.col("path").alias("file_path"), F.lit("").alias("scope"), *[F.lit(None).cast(t).alias(c) for c, t in (("start_line", "int"), ("end_line", "int"), ("signature", "string"), ("doc_comment", "string"))])
    return files.unionByName(own).dropDuplicates(["id"])


# How sure a call is by what decided, and to how many definitions of a name anywhere it may lead, by language:
# same file, imported, same package, anywhere; most candidates for plain names and for members.
CALL_TIERS = {"python": (0.8, 0.75, 0.7, 0.5), "rust": (0.9, 0.8, 0.7, 0.5), "typescript": (0.9, 0.8, 0.7, 0.5)}
CALL_LIMITS = {"python": (3, 20), "rust": (3, 10), "typescript": (3, 15)}
CONSTRUCTOR_TIERS = (0.8, 0.7, 0.6, 0.5)
PYTHON_MEMBER, OWN_METHOD, OWN_FILE, TYPED_RECEIVER = 0.3, 0.9, 0.6, 0.95


def _of_language(values: dict, k: int):
    return F.when(F.col("lang") == "rust", values["rust"][k]).when(F.col("lang") == "typescript", values["typescript"][k]).otherwise(values["python"][k])


def call_sites(found: DataFrame, defs: DataFrame) -> DataFrame:
    """(site, src, path, dir, lang, class, name, receiver, member, in_error_path, line) of the calls within known functions."""
    callers = defs.where("node_type in ('function', 'method')").select(F.col("id").alias("src"), "node_type", F.col("file_path").alias("path"), "scope")
    calls = found.where("kind = 'call'").select("path", "scope", "name", "target", "line", "in_error_path").join(callers, ["path", "scope"])
    receiver = F.regexp_extract("target", r"(\w+)(?:\.|::)\w+$", 1)
    class_ = F.when(F.col("node_type") == "method", F.regexp_replace("scope", "\\.[^.]*$", ""))
    site = F.xxhash64("path", "scope", "line", "target", F.row_number().over(Window.partitionBy("path", "scope", "line", "target").orderBy("name")))
    return calls.select(
        site.alias("site"), "src", "path", F.regexp_replace("path", "/?[^/]*$", "").alias("dir"), language_of(F.col("path")).alias("lang"), class_.alias("class"), "name",
        F.when(receiver != "", receiver).alias("receiver"), (receiver != "").alias("member"), "in_error_path", "line",
    )


def _best(met: DataFrame) -> DataFrame:
    """Of candidates with a tier, those of each site's best one."""
    w = Window.partitionBy("site")
    return met.withColumn("best", F.min("tier").over(w)).where("tier = best").withColumn("n", F.count(F.lit(1)).over(w))


def call_edges(found: DataFrame, defs: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence, in_error_path, line): calls to functions and methods of that name.

    A member of self resolves within the own class and its direct bases, where there are any; a member of a named type to
    that type's methods; all else by the best tier that has any definition: same file, imported, same package, anywhere if
    there are few. A capitalised name that no function has is a constructor.
    """
    calls = call_sites(found, defs)
    targets = defs.where("node_type in ('function', 'method')").select(
        F.col("id").alias("dst"), F.col("title").alias("name"), F.col("file_path").alias("there"), F.when(F.col("node_type") == "method", F.regexp_replace("scope", "\\.[^.]*$", "")).alias("owner")
    )
    known = targets.groupBy("name").agg(F.count(F.lit(1)).alias("every"))
    imported = found.where("kind = 'import'").select("path", "name").distinct().withColumn("imported", F.lit(True))
    calls = cut(calls.join(imported, ["path", "name"], "left").join(known, "name", "left"), "calls")
    own = F.coalesce(F.col("receiver").isin("self", "this", "cls", "Self"), F.lit(False))
    same_file, same_dir = F.col("path") == F.col("there"), F.col("dir") == F.regexp_replace("there", "/?[^/]*$", "")
    # each tier is a join of its own, so that calls of a name that every file has do not meet the definitions of all files
    resolved = calls.where("every is not null")
    in_file = targets.withColumn("path", F.col("there"))

    mine = resolved.where(own)
    bases = found.where("kind = 'inherits'").select("path", F.col("scope").alias("class"), F.col("name").alias("owner")).distinct()
    by_file = mine.join(in_file, ["path", "name"]).withColumn("tier", F.when(F.col("class").isNull(), 4).when(F.col("owner") == F.col("class"), 1).otherwise(3))
    by_base = mine.join(bases, ["path", "class"]).join(targets, ["name", "owner"]).where(~(same_file & (F.col("owner") == F.col("class")))).withColumn("tier", F.lit(1))
    by_few = mine.where("class is not null and every <= 3").join(targets, "name").withColumn("tier", F.lit(2))
    selves = _best(by_file.unionByName(by_base).unionByName(by_few)).withColumn("confidence", F.when(F.col("tier") == 4, OWN_FILE).otherwise(OWN_METHOD))

    others = resolved.where(~own)
    typed = others.where("lang = 'rust'").withColumn("owner", F.col("receiver")).join(targets, ["name", "owner"]).withColumn("tier", F.lit(0))
    near = cut(typed.unionByName(others.join(in_file, ["path", "name"]).withColumn("tier", F.lit(1))), "near")
    left = others.join(near.select("site").distinct(), "site", "left_anti")
    by_import, rest = left.where("imported").join(targets, "name").withColumn("tier", F.lit(2)), left.where("imported is null")
    in_dir = targets.withColumn("dir", F.regexp_replace("there", "/?[^/]*$", ""))
    by_dir = rest.join(in_dir, ["dir", "name"]).withColumn("tier", F.lit(3))
    few = F.col("every") <= F.when(F.col("member") & ~F.col("name").rlike("^__.*__$"), _of_language(CALL_LIMITS, 1)).otherwise(_of_language(CALL_LIMITS, 0))
    chosen = _best(near.unionByName(by_import).unionByName(by_dir).unionByName(rest.where(few).join(targets, "name").withColumn("tier", F.lit(4))))
    sure = F.when(F.col("tier") == 0, TYPED_RECEIVER).when((F.col("tier") == 4) & (F.col("lang") == "python") & F.col("member"), PYTHON_MEMBER)
    for k in range(4):
        sure = sure.when(F.col("tier") == k + 1, _of_language(CALL_TIERS, k))
    plain = chosen.withColumn("confidence", sure)

    makers = defs.where("node_type = 'method' and title = '__init__'").select(F.col("id").alias("dst"), F.element_at(F.split("scope", "\\."), -2).alias("name"), F.col("file_path").alias("there"))
    counts = makers.groupBy("name").agg(F.count(F.lit(1)).alias("makers"))
    made = calls.where((F.col("lang") == "python") & F.col("every").isNull() & F.col("name").rlike("^\\p{Lu}")).join(makers, "name").join(counts, "name")
    made = made.withColumn("tier", F.when(same_file, 1).when(F.col("imported"), 2).when(same_dir, 3).when(F.col("makers") <= 3, 4))
    made = _best(made.where("tier is not null")).withColumn("confidence", F.element_at(F.array(*map(F.lit, CONSTRUCTOR_TIERS)), F.col("tier")))

    columns = ["src", "dst", F.lit("calls").alias("relation"), F.col("confidence").cast("double").alias("confidence"), "in_error_path", "line"]
    return plain.select(columns).unionByName(selves.select(columns)).unionByName(made.select(columns)).where("src <> dst")


def remove_phantoms(nodes: DataFrame, edges: DataFrame, paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without file nodes whose path is not there; only if there are such, edges without an end go too."""
    gone = nodes.where("node_type = 'file'").join(paths.select(F.col("path").alias("file_path")), "file_path", "left_anti").select("id")
    kept = nodes.join(gone, "id", "left_anti").select(nodes.columns)
    ids = kept.select("id").distinct().withColumn("there", F.lit(True))
    some = gone.agg((F.count(F.lit(1)) > 0).alias("some"))  # one row
    e = edges.join(ids.withColumnsRenamed({"id": "src", "there": "a"}), "src", "left").join(ids.withColumnsRenamed({"id": "dst", "there": "b"}), "dst", "left").join(F.broadcast(some))
    return kept, e.where("not some or (a and b)").select(edges.columns)


def resolve_references(edges: DataFrame, defs: DataFrame, modules: DataFrame) -> DataFrame:
    """edges with class_ref:, module_ref: and func_ref: ends replaced by what they name; those that name nothing go.

    Of classes of one name the last inserted counts, of functions the first; modules: (module, id).
    """
    kind, name = F.regexp_extract("dst", "^(class|module|func)_ref:", 1), F.regexp_replace("dst", "^(class|module|func)_ref:", "")
    classes = defs.where("node_type = 'class'").groupBy(F.col("title").alias("ref")).agg(F.max_by("id", "ord").alias("found")).withColumn("kind", F.lit("class"))
    functions = defs.where("node_type in ('function', 'method')").groupBy(F.col("title").alias("ref")).agg(F.min_by("id", "ord").alias("found")).withColumn("kind", F.lit("func"))
    table = classes.unionByName(functions).unionByName(modules.select(F.col("module").alias("ref"), F.col("id").alias("found"), F.lit("module").alias("kind")))
    e = edges.withColumn("kind", kind).withColumn("ref", name).join(table, ["kind", "ref"], "left")
    return e.where("kind = '' or found is not null").withColumn("dst", F.coalesce("found", "dst")).select(edges.columns)


def remap_impls(edges: DataFrame, defs: DataFrame) -> DataFrame:
    """edges whose defined_in leads to a class that is not there led to the first class of that short name, if there is one."""
    classes = defs.where("node_type = 'class'").select("id", "ord", F.element_at(F.split("id", ":"), -1).alias("short"))
    first = classes.groupBy("short").agg(F.min_by("id", "ord").alias("real"))
    there = defs.select(F.col("id").alias("dst")).distinct().withColumn("there", F.lit(True))
    lost = (F.col("relation") == "defined_in") & F.col("dst").startswith("class:") & F.col("there").isNull()
    e = edges.join(there, "dst", "left").withColumn("short", F.when(lost, F.element_at(F.split("dst", ":"), -1))).join(first, "short", "left")
    return e.withColumn("dst", F.coalesce("real", "dst")).select(edges.columns)


def text_edges(found: DataFrame, defs: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence, made_by): inherits and imports, with the path of the file that says so; names that
    resolve to nothing are dropped."""
    classes = defs.where("node_type in ('class', 'interface', 'trait')").select(F.col("id").alias("dst"), F.col("title").alias("name"), F.col("file_path").alias("there"))
    kinds = ("class", "interface", "enum")
    own = defs.where(F.col("node_type").isin(*kinds)).select(F.col("id").alias("own"), F.col("file_path").alias("path"), "scope")
    far = defs.where(F.col("node_type").isin(*kinds)).groupBy("scope").agg(F.min("id").alias("far"))
    bases = found.where("kind = 'inherits'").join(own, ["path", "scope"], "left").join(far, "scope", "left").withColumn("src", F.coalesce("own", "far")).where("src is not null").join(classes, "name")
    near = bases.withColumn("rank", F.row_number().over(Window.partitionBy("path", "src", "name").orderBy((F.col("path") != F.col("there")), "dst"))).where("rank = 1")
    inherits = near.where("src <> dst").select("src", "dst", F.lit("inherits").alias("relation"), F.lit(0.9).alias("confidence"), F.col("path").alias("made_by")).distinct()
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), "\\.[a-z]+$", "")
    files = defs.where("node_type = 'file'").select(F.col("id").alias("dst"), stem.alias("stem"))
    imports = found.where("kind = 'import'").select(F.concat(F.lit("file:"), "path").alias("src"), F.col("path").alias("made_by"), F.explode(F.array_distinct(F.array(F.element_at(F.split(F.regexp_replace("target", "^\\.+", ""), "[./:]+"), -1), F.col("name")))).alias("stem"))
    imports = imports.join(files, "stem").where("src <> dst").select("src", "dst", F.lit("imports").alias("relation"), F.lit(0.9).alias("confidence"), "made_by").distinct()
    return inherits.unionByName(imports)


def place_edges(defs: DataFrame, inherits: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence): defined_in, and overrides along inherits edges; both follow from the definitions."""
    inside = defs.where("node_type <> 'file'").select(F.col("id").alias("src"), "file_path", F.regexp_replace("scope", "\\.?[^.]*$", "").alias("outer"))
    scopes = defs.where("node_type <> 'file'").select(F.col("id").alias("parent"), "file_path", F.col("scope").alias("outer"))
    # members of a type that another file defines belong to the first type of that name
    elsewhere = defs.where("node_type = 'class'").groupBy(F.col("title").alias("outer")).agg(F.min("id").alias("far"))
    up = inside.join(scopes, ["file_path", "outer"], "left").join(elsewhere, "outer", "left")
    placed = up.select("src", F.coalesce("parent", "far", F.concat(F.lit("file:"), "file_path")).alias("dst"), F.lit("defined_in").alias("relation"), F.lit(1.0).alias("confidence"))
    method = defs.where("node_type = 'method'").select("id", "title", "file_path", F.regexp_replace("scope", "\\.[^.]*$", "").alias("scope"))
    class_ = defs.where("node_type in ('class', 'trait', 'interface')").select(F.col("id").alias("class"), "file_path", "scope")
    by_name = defs.where("node_type = 'class'").groupBy("scope").agg(F.min("id").alias("far"))
    members = method.join(class_, ["file_path", "scope"], "left").join(by_name, "scope", "left").select("id", "title", F.coalesce("class", "far").alias("class")).where("class is not null")
    sub = members.select(F.col("id").alias("dst"), "title", F.col("class").alias("sub"))
    base = members.select(F.col("id").alias("src"), "title", F.col("class").alias("base"))
    pairs = inherits.select(F.col("src").alias("sub"), F.col("dst").alias("base")).distinct()
    overrides = pairs.join(sub, "sub").join(base, ["base", "title"]).select("src", "dst", F.lit("overrides").alias("relation"), F.lit(0.6).alias("confidence"))
    return placed.unionByName(overrides)


def module_nodes(defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Module nodes for every ancestor directory of a file, and belongs_to edges up the tree."""
    parts = F.split("file_path", "/")
    dirs = defs.where("node_type = 'file'").select(F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda k: F.array_join(F.slice(parts, 1, k), "/"))).otherwise(F.array().cast("array<string>"))).alias("dir")).distinct()
    nodes = dirs.select(F.concat(F.lit("module:"), "dir").alias("id"), F.element_at(F.split("dir", "/"), -1).alias("title"), F.lit("module").alias("node_type"), F.col("dir").alias("file_path"))
    up = dirs.where(F.instr("dir", "/") > 0).select(F.concat(F.lit("module:"), "dir").alias("src"), F.concat(F.lit("module:"), F.regexp_replace("dir", "/[^/]*$", "")).alias("dst"))
    files = defs.where("node_type = 'file' and instr(file_path, '/') > 0").select(F.col("id").alias("src"), F.concat(F.lit("module:"), F.regexp_replace("file_path", "/[^/]*$", "")).alias("dst"))
    return nodes, up.unionByName(files).withColumn("relation", F.lit("belongs_to"))


def test_edges(defs: DataFrame) -> DataFrame:
    """(src, dst, relation, confidence): test files to the files whose stem theirs names."""
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), "\\.[a-z]+$", "")
    files = defs.where("node_type = 'file'").select("id", "file_path", stem.alias("stem"))
    is_test = F.col("stem").rlike("^test_|_test$|\\.test$|\\.spec$") | F.col("file_path").rlike("(^|/)tests?/")
    tests = files.where(is_test).select(F.col("id").alias("src"), F.regexp_replace("stem", "^test_|_test$|\\.test$|\\.spec$", "").alias("stem"))
    code = files.where(~is_test).select(F.col("id").alias("dst"), "stem")
    return tests.join(code, "stem").select("src", "dst", F.lit("tests_for").alias("relation"), F.lit(0.8).alias("confidence"))


def folded_calls(found: DataFrame, defs: DataFrame) -> DataFrame:
    """Call edges of one caller and callee as one, with their number and the caller's file."""
    files = defs.select(F.col("id").alias("src"), F.col("file_path").alias("made_by"))
    calls = call_edges(found, defs).groupBy("src", "dst", "relation").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).cast("int").alias("call_count"), F.bool_or("in_error_path").alias("in_error_path"))
    return calls.join(files, "src")


def _nodes(defs: DataFrame) -> DataFrame:
    return defs.drop("scope").unionByName(module_nodes(defs)[0], allowMissingColumns=True)


def _assembled(defs: DataFrame, text: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from definitions, what files say of bases and imports, and calls."""
    belongs = module_nodes(defs)[1]
    derived = place_edges(defs, text.where("relation = 'inherits'")).unionByName(test_edges(defs)).unionByName(belongs.withColumn("confidence", F.lit(1.0)))
    edges = derived.withColumn("made_by", F.lit(None).cast("string")).unionByName(text.select("src", "dst", "relation", "confidence", "made_by"))
    edges = edges.withColumn("call_count", F.lit(1)).withColumn("in_error_path", F.lit(False)).unionByName(calls.select("src", "dst", "relation", "confidence", "made_by", "call_count", "in_error_path"))
    return _nodes(defs), edges


def _defined(sources: DataFrame, store) -> tuple[DataFrame, DataFrame]:
    """What parsing finds, and the definitions."""
    measured_joins(sources.sparkSession)  # names of definitions compress as well as ids of a graph
    small_tasks(sources.sparkSession)
    found = store.facts(sources) if store else cut(facts(sources), "facts")
    return found, cut(definitions(found), "definitions")


def extract_nodes(sources: DataFrame, store=None) -> DataFrame:
    """The nodes that extract() gives, without resolving what the files call, import and inherit."""
    return _nodes(_defined(sources, store)[1])


def extract(sources: DataFrame, store=None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of sources(path, content). Each file is parsed once; with a store of facts, each content once ever.

    made_by is the file whose text makes an edge, null for edges that follow from the definitions alone.
    """
    found, defs = _defined(sources, store)
    return _assembled(defs, cut(text_edges(found, defs), "text"), folded_calls(found, defs))


def extract_incremental(old_nodes: DataFrame, old_edges: DataFrame, old_files: DataFrame, sources: DataFrame, store=None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after a change, from those that extract() gave before: only changed and new files are parsed.

    Names in them are resolved against all definitions, those of unchanged files being the old nodes. Calls, bases and
    imports that unchanged files say stay while both ends are there; what follows from definitions alone is worked out anew.
    So the result is that of extract() on all sources if the names that are defined, and where, stay what they were, but
    for files that are new or gone; names that come up elsewhere change calls of unchanged files only once these are parsed
    again. extract() with a store of facts parses as little and has no such limit.
    """
    from graphloom.operators.setops import file_delta

    measured_joins(sources.sparkSession)
    small_tasks(sources.sparkSession)
    delta = cut(file_delta(old_files, sources), "delta")
    stale = delta.where("change in ('modified', 'deleted')").select("path")
    fresh = sources.join(delta.where("change in ('modified', 'added')").select("path"), "path", "left_semi")
    found = store.facts(fresh) if store else cut(facts(fresh), "facts")
    folder = (F.col("node_type") == "module") & (F.col("id") == F.concat(F.lit("module:"), "file_path"))
    kept = old_nodes.where(~folder).join(stale.withColumnRenamed("path", "file_path"), "file_path", "left_anti")
    scope = F.when(F.col("node_type") == "file", "").otherwise(F.substring(F.col("id"), F.instr("id", ":") + F.length("file_path") + 2, F.length("id")))
    made = definitions(found)
    defs = cut(made.unionByName(kept.withColumn("scope", scope).select(made.columns)).dropDuplicates(["id"]), "definitions")
    ids = defs.select("id")
    said = old_edges.where("made_by is not null").join(stale.withColumnRenamed("path", "made_by"), "made_by", "left_anti")
    said = cut(said.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(old_edges.columns), "said")
    text = text_edges(found, defs).unionByName(said.where("relation <> 'calls'").select("src", "dst", "relation", "confidence", "made_by"))
    calls = folded_calls(found, defs)
    return _assembled(defs, cut(text, "text"), calls.unionByName(said.where("relation = 'calls'").select(calls.columns)))


def grep_identifiers(sources: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """(name, path, line, kind) of lines that define one of some names that no node of the graph has."""
    known = {r["title"] for r in nodes.where(F.col("title").isin(names)).select("title").distinct().collect()}  # among the names asked for
    wanted = [n for n in names if n not in known]
    if not wanted:
        return sources.sparkSession.createDataFrame([], "name string, path string, line int, kind string")
    pattern = r"^\s*(?:export\s+|pub(?:\([^)]*\))?\s+|async\s+|abstract\s+|default\s+)*(def|class|fn|function|struct|trait|enum|interface)\s+(" + "|".join(map(re.escape, wanted)) + r")\b"
    lines = sources.where(F.col("content").rlike("(?m)" + pattern)).select("path", F.posexplode(F.split("content", "\n")).alias("k", "text"))
    kind = F.regexp_extract("text", pattern, 1)
    hit = lines.where(F.col("text").rlike(pattern))
    return hit.select(F.regexp_extract("text", pattern, 2).alias("name"), "path", (F.col("k") + 1).alias("line"), F.when(kind.isin("def", "fn", "function"), "function").otherwise("class").alias("kind"))
