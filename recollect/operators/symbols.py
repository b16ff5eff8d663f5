"""Symbols of source files, and the skeleton of a project that fits a token budget.

Python is parsed by the standard library in an Arrow function.  TypeScript and JavaScript
are read by patterns: top-level classes, functions and imports, without types that span
lines, as no parser for them is at hand.
"""

from __future__ import annotations

import ast
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import count_tokens

# Fixed values.
SKIPPED_FOLDERS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "dist", "build", ".tox", ".mypy_cache", ".pytest_cache", "target", ".next")
SUFFIXES = (".py", ".ts", ".tsx", ".js", ".jsx")
ROUTE_VERBS = ("get", "post", "put", "delete", "patch")
MOST_FIELDS, MOST_CLASSES, MOST_METHODS, MOST_FUNCTIONS, MOST_IMPORTS = 10, 5, 5, 10, 8
SKELETON_BUDGET = 800

NODE = pa.struct([(n, pa.string()) for n in ("node_type", "name", "parent_name", "signature", "return_type", "fields")])


def _shown(node: ast.AST | None) -> str:
    return "" if node is None else ast.unparse(node)


def _signature(fn) -> str:
    args = [a for a in (*fn.args.posonlyargs, *fn.args.args, *fn.args.kwonlyargs) if a.arg not in ("self", "cls")]
    return "(" + ", ".join(a.arg + (f":{_shown(a.annotation)}" if a.annotation else "") for a in args) + ")"


def _fields(cls: ast.ClassDef) -> str:
    """Annotated fields of the class, then what the statements of `__init__` put on `self`: types as annotated, never guessed."""
    found = {s.target.id: _shown(s.annotation) for s in cls.body if isinstance(s, ast.AnnAssign) and isinstance(s.target, ast.Name)}
    made = [s for m in cls.body if isinstance(m, (ast.FunctionDef, ast.AsyncFunctionDef)) and m.name == "__init__" for s in m.body]
    for stmt in made:
        typed = isinstance(stmt, ast.AnnAssign)
        for target in [stmt.target] if typed else stmt.targets if isinstance(stmt, ast.Assign) else []:
            if isinstance(target, ast.Attribute) and ast.unparse(target.value) == "self":
                found[target.attr] = _shown(stmt.annotation) if typed else found.get(target.attr, "")
    return ", ".join([f"{name}:{kind}" if kind else name for name, kind in found.items()][:MOST_FIELDS])


def _route(fn) -> tuple[str, str]:
    """`VERB path` and the response model of the first decorator that is a route with a path."""
    for d in (d for d in fn.decorator_list if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr.lower() in ROUTE_VERBS and d.args):
        path = d.args[0].value if isinstance(d.args[0], ast.Constant) else _shown(d.args[0])
        if path:
            return f"{d.func.attr.upper()} {path}", next((_shown(k.value) for k in d.keywords if k.arg == "response_model"), "")
    return "", ""


def python_symbols(source: str) -> tuple[list[tuple], list[str], bool]:
    """Nodes, imported modules, and whether the source could be parsed."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return [], [], False
    nodes, modules = [], []
    functions = (ast.FunctionDef, ast.AsyncFunctionDef)
    for stmt in tree.body:
        if isinstance(stmt, ast.ClassDef):
            nodes.append(("class", stmt.name, "", _shown(stmt.bases[0]) if stmt.bases else "", "", _fields(stmt)))
            nodes += [("method", m.name, stmt.name, _signature(m), _shown(m.returns), "") for m in stmt.body if isinstance(m, functions) and m.name != "__init__"]
        elif isinstance(stmt, functions):
            route, model = _route(stmt)
            nodes.append(("function", stmt.name, "", _signature(stmt), model or _shown(stmt.returns), route))
        elif isinstance(stmt, ast.Import):
            modules += [a.name for a in stmt.names]
        elif isinstance(stmt, ast.ImportFrom) and stmt.module:
            modules.append(stmt.module)
    return nodes, modules, True


_TS_CLASS = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+(\w+)(?:<[^>{]*>)?(?:\s+extends\s+([\w.]+))?[^{\n]*\{", re.M)
_TS_METHOD = re.compile(r"^\s+(?:(?:public|private|protected|static|async|readonly)\s+)*(\w+)\s*(\([^)\n]*\))\s*(?::\s*([^{\n]+?))?\s*\{", re.M)
_TS_FUNCTION = re.compile(r"^(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>(]*>)?(\([^)]*\))\s*(?::\s*([^{\n]+?))?\s*\{", re.M)
_TS_ARROW = re.compile(r"^(?:export\s+)?const\s+(\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(\([^)\n]*\))\s*(?::\s*([^=\n]+?))?\s*=>", re.M)
_TS_IMPORT = re.compile(r"^\s*(?:import|export)\s[^'\"\n]*?from\s+['\"]([^'\"\n]+)['\"]|^\s*import\s+['\"]([^'\"\n]+)['\"]", re.M)
_TS_WORDS = frozenset({"if", "for", "while", "switch", "catch", "constructor", "return", "function"})


def script_symbols(source: str) -> tuple[list[tuple], list[str], bool]:
    nodes = []
    for c in _TS_CLASS.finditer(source):
        depth, end = 1, c.end()
        while end < len(source) and depth:
            depth += {"{": 1, "}": -1}.get(source[end], 0)
            end += 1
        nodes.append(("class", c.group(1), "", c.group(2) or "", "", ""))
        nodes += [("method", m.group(1), c.group(1), m.group(2), (m.group(3) or "").strip(), "") for m in _TS_METHOD.finditer(source, c.end(), end) if m.group(1) not in _TS_WORDS]
    for pattern in (_TS_FUNCTION, _TS_ARROW):
        nodes += [("function", m.group(1), "", m.group(2), (m.group(3) or "").strip(), "") for m in pattern.finditer(source)]
    return nodes, [a or b for a, b in _TS_IMPORT.findall(source)], True


def project_files(files: DataFrame, most: int | None = None) -> DataFrame:
    """files (project_id, path, …) of a project's languages outside generated folders; if asked, the first `most` of each project by language and path."""
    parts = F.split("path", "/")
    rank = F.array_position(F.array(*[F.lit(s) for s in SUFFIXES]), F.concat(F.lit("."), F.element_at(F.split("path", r"\."), -1)))
    own = files.where(~F.arrays_overlap(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(*[F.lit(s) for s in SKIPPED_FOLDERS]))).withColumn("_rank", rank).where("_rank > 0")
    if most is None:
        return own.drop("_rank")
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("_rank", "path"))
    return own.withColumn("_k", place).where(F.col("_k") <= most).drop("_k", "_rank")


def scan_sources(sources: DataFrame) -> DataFrame:
    """project_id, path, ok, nodes, modules of sources (project_id, path, source)."""

    def run(batches):
        for batch in batches:
            found = [(python_symbols if p.endswith(".py") else script_symbols)(s or "") for p, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            names = [f.name for f in NODE]
            nodes = pa.array([[dict(zip(names, n)) for n in x[0]] for x in found], pa.list_(NODE))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([x[2] for x in found]), nodes, pa.array([x[1] for x in found], pa.list_(pa.string()))], names=["project_id", "path", "ok", "nodes", "modules"])

    fields = ", ".join(f"{f.name} string" for f in NODE)
    schema = f"project_id string, path string, ok boolean, nodes array<struct<{fields.replace(' string', ': string')}>>, modules array<string>"
    return sources.select("project_id", "path", "source").mapInArrow(run, schema)


def nodes_of(scanned: DataFrame) -> DataFrame:
    return scanned.select("project_id", "path", F.explode("nodes").alias("n")).select("project_id", "path", "n.*").dropDuplicates(["project_id", "path", "node_type", "name", "parent_name"])


def imports_of(scanned: DataFrame) -> DataFrame:
    """project_id, from_path, module; relative specifiers of scripts are resolved against their folder."""
    each = scanned.select("project_id", F.col("path").alias("from_path"), F.explode("modules").alias("module"))
    return each.where(~F.col("from_path").rlike(r"\.(?:ts|tsx|js|jsx)$"))


def script_edges(scanned: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges of scripts: a relative specifier is one of the project's files, by its name or with one of four suffixes."""
    each = scanned.where(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx)$")).select("project_id", F.col("path").alias("from_path"), F.explode("modules").alias("module")).distinct()
    folder = F.regexp_replace("from_path", r"[^/]+$", "")
    joined = F.concat(folder, F.regexp_replace("module", r"^(?:\./)+", ""))
    for _ in range(8):  # a folder up at a time
        joined = F.regexp_replace(joined, r"(?:^|(?<=/))(?!\.\./)[^/]+/\.\./", "")
    relative = F.col("module").startswith(".")
    places = F.array(joined, *[F.concat(joined, F.lit(s)) for s in SUFFIXES[1:]], *[F.concat(joined, F.lit("/index" + s)) for s in SUFFIXES[1:]])
    found = each.where(relative).select("*", F.posexplode(places).alias("rank", "path")).join(paths.select("project_id", "path").distinct(), ["project_id", "path"])
    best = found.groupBy("project_id", "from_path", "module").agg(F.min_by("path", "rank").alias("to"))
    out = each.join(best, ["project_id", "from_path", "module"], "left")
    return out.select("project_id", "from_path", F.coalesce("to", "module").alias("to_path"), F.lit("imports").alias("edge_type"), F.col("to").isNull().alias("is_external")).distinct()


def file_states(scanned: DataFrame, refreshed_at: int) -> DataFrame:
    failed = ~F.col("ok")
    return scanned.select(
        "project_id", "path", F.lit("fresh").alias("freshness"), F.when(failed, "parse_error").otherwise("scanned").alias("scan_status"), F.size("nodes").alias("symbol_count"),
        F.lit(refreshed_at).alias("refreshed_at"), F.when(failed, "the source can't be parsed").otherwise("").alias("last_error"),
    )


def updated(existing: DataFrame, scanned: DataFrame, fresh: DataFrame, path: str = "path") -> DataFrame:
    """A symbol table after files were scanned again or deleted (scanned: project_id, path): theirs replaced by `fresh`."""
    touched = scanned.select("project_id", F.col("path").alias(path)).distinct()
    return existing.join(touched, ["project_id", path], "left_anti").unionByName(fresh)


def skeleton(nodes: DataFrame, edges: DataFrame, centralities: DataFrame, budget: int = SKELETON_BUDGET, hot: DataFrame | None = None) -> DataFrame:
    """project_id, path, entry, tokens: what files offer, within a budget.

    Up to five classes a file by their size, five methods each (then three, then one, for all
    files at once), ten functions (routes, then public ones), eight imports.  If that doesn't
    fit, the files with the lowest score go: symbols, centrality, recent activity; one stays.
    """
    classes = nodes.where("node_type = 'class'")
    methods = nodes.where("node_type = 'method'")
    per = methods.groupBy("project_id", "path", F.col("parent_name").alias("name")).agg(F.sort_array(F.collect_list(F.struct("name", "signature", "return_type"))).alias("m"))
    n_fields = F.when(F.coalesce("fields", F.lit("")) != "", F.size(F.split("fields", ","))).otherwise(0)
    sized = classes.join(per, ["project_id", "path", "name"], "left").withColumn("size", F.size(F.coalesce("m", F.array().cast("array<struct<name:string,signature:string,return_type:string>>"))) + n_fields)
    big = F.row_number().over(Window.partitionBy("project_id", "path").orderBy(F.desc("size"), "name"))
    top = sized.withColumn("k", big).where(F.col("k") <= MOST_CLASSES)
    top = top.groupBy("project_id", "path").agg(F.sort_array(F.collect_list(F.struct("k", "name", F.col("signature").alias("bases"), "fields", "m"))).alias("classes"))
    functions = nodes.where("node_type = 'function'")
    shown = F.row_number().over(Window.partitionBy("project_id", "path").orderBy((F.coalesce("fields", F.lit("")) == ""), F.col("name").startswith("_"), "name"))
    functions = functions.withColumn("k", shown).where(F.col("k") <= MOST_FUNCTIONS)
    functions = functions.groupBy("project_id", "path").agg(F.sort_array(F.collect_list(F.struct("k", "name", "signature", "return_type", F.col("fields").alias("route")))).alias("functions"))
    local = edges.where(~F.col("is_external")).select("project_id", F.col("from_path").alias("path"), F.element_at(F.split("to_path", "/"), -1).alias("name")).distinct()
    first = F.row_number().over(Window.partitionBy("project_id", "path").orderBy("name"))
    imports = local.withColumn("k", first).where(F.col("k") <= MOST_IMPORTS).groupBy("project_id", "path").agg(F.sort_array(F.collect_list("name")).alias("imports"))
    files = nodes.select("project_id", "path").union(local.select("project_id", "path")).distinct()
    f = files.join(top, ["project_id", "path"], "left").join(functions, ["project_id", "path"], "left").join(imports, ["project_id", "path"], "left")
    typed = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit("->"), c)).otherwise("")

    def entry(limit: int):
        def of_class(c):
            some = F.transform(F.slice(F.coalesce(c["m"], F.array().cast("array<struct<name:string,signature:string,return_type:string>>")), 1, limit), lambda m: F.concat(F.lit("\n    "), m["name"], m["signature"], typed(m["return_type"])))
            bases = F.when(F.coalesce(c["bases"], F.lit("")) != "", F.concat(F.lit("("), c["bases"], F.lit(")"))).otherwise("")
            fields = F.when(F.coalesce(c["fields"], F.lit("")) != "", F.concat(F.lit(" ["), c["fields"], F.lit("]"))).otherwise("")
            return F.concat(F.lit("\n  class "), c["name"], bases, fields, F.array_join(some, ""))

        def of_function(x):
            route = F.when(F.coalesce(x["route"], F.lit("")) != "", F.concat(F.lit(" ["), x["route"], F.lit("]"))).otherwise("")
            return F.concat(F.lit("\n  "), x["name"], x["signature"], typed(x["return_type"]), route)

        needs = F.when(F.size(F.coalesce("imports", F.array().cast("array<string>"))) > 0, F.concat(F.lit(" <- "), F.array_join("imports", ", "))).otherwise("")
        both = [F.coalesce(F.array_join(F.transform(c, g), ""), F.lit("")) for c, g in (("classes", of_class), ("functions", of_function))]
        return F.concat(F.col("path"), needs, *both)

    limits = (MOST_METHODS, 3, 1)
    f = f.select("*", *[entry(n).alias(f"e{n}") for n in limits]).select("*", *[count_tokens(F.col(f"e{n}")).alias(f"t{n}") for n in limits])
    totals = f.groupBy("project_id").agg(*[F.sum(f"t{n}").alias(f"s{n}") for n in limits])
    f = f.join(totals, "project_id")
    chosen = F.when(F.col("s5") <= budget, F.struct(F.col("e5").alias("e"), F.col("t5").alias("t"))).when(F.col("s3") <= budget, F.struct(F.col("e3").alias("e"), F.col("t3").alias("t"))).otherwise(F.struct(F.col("e1").alias("e"), F.col("t1").alias("t")))
    f = f.join(centralities, ["project_id", "path"], "left")
    if hot is not None:
        f = f.join(hot.select("project_id", "path").distinct().withColumn("_hot", F.lit(20)), ["project_id", "path"], "left")
    else:
        f = f.withColumn("_hot", F.lit(0))
    size = lambda c: F.coalesce(F.size(F.col(c)), F.lit(0))
    score = F.greatest(size("classes"), F.lit(0)) * 3 + F.greatest(size("functions"), F.lit(0)) + 1 + F.coalesce("centrality", F.lit(0.0)) * 100 + F.coalesce("_hot", F.lit(0))
    order = Window.partitionBy("project_id").orderBy(F.desc("score"), "path")
    f = f.select("project_id", "path", chosen.alias("c"), score.alias("score")).select("project_id", "path", F.col("c.e").alias("entry"), F.col("c.t").alias("tokens"), "score")
    f = f.withColumn("_sum", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_k", F.row_number().over(order))
    return f.where((F.col("_sum") <= budget) | (F.col("_k") == 1)).select("project_id", "path", "entry", "tokens")


def skeleton_section(entries: DataFrame) -> DataFrame:
    """project_id, section: the entries as text, by path."""
    ordered = F.array_sort(F.collect_list(F.struct("path", "entry")))
    return entries.groupBy("project_id").agg(F.concat(F.lit("### Codebase skeleton\n"), F.array_join(F.transform(ordered, lambda x: x["entry"]), "\n")).alias("section"))
