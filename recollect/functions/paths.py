"""File paths as stored keys, and what a path says about its file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# In order, the first that fits counts.
FOLDER_INTENTS = (
    (("auth", "authentication", "login"), "authentication"),
    (("routes", "router", "api", "endpoints"), "API routes"),
    (("models", "model", "schema", "schemas"), "data model"),
    (("utils", "util", "helpers", "common", "shared"), "utilities"),
    (("tests", "test", "spec", "__tests__"), "tests"),
    (("migrations", "migration"), "database migration"),
    (("middleware", "interceptors"), "middleware"),
    (("config", "settings", "configuration"), "configuration"),
    (("components", "views", "pages"), "UI component"),
    (("services", "service"), "service layer"),
)
STEM_INTENTS = (
    ("middleware", "middleware"), ("router", "routing"), ("handler", "request handler"), ("controller", "controller"), ("service", "service layer"),
    ("repository", "data repository"), ("validator", "validation"), ("serializer", "serialization"), ("migration", "database migration"), ("test", "tests"),
)


def canonical_path(raw: Column, root: Column | None = None) -> Column:
    """A relative path with single forward slashes; empty if it is missing, leaves the root, or is absolute without one."""
    s = F.regexp_replace(F.replace(F.trim(F.coalesce(raw, F.lit(""))), F.lit("\\"), F.lit("/")), "/{2,}", "/")
    absolute = s.startswith("/") | s.rlike("^.:")
    if root is None:
        relative = F.when(absolute, F.lit("")).otherwise(s)
    else:
        base = F.concat(F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), "/+$", ""), F.lit("/"))
        under = F.when(s.startswith(base), F.substring(s, F.char_length(base) + 1, F.char_length(s))).otherwise("")
        relative = F.when(absolute, under).otherwise(s)
    out = F.regexp_replace(F.regexp_replace(relative, r"^(?:\./)+", ""), "/+$", "")
    return F.when(out.isin(".", "..") | out.startswith("../") | out.contains("/../"), F.lit("")).otherwise(out)


def is_bare_name(path: Column) -> Column:
    return (path != "") & ~path.contains("/")


def project_key(path: Column) -> Column:
    """One key for a folder however it is written: drive letters of either system, slashes and case folded."""
    s = F.regexp_replace(F.replace(F.trim(path), F.lit("\\"), F.lit("/")), "/+$", "")
    s = F.regexp_replace(s, r"^/mnt/([A-Za-z])(?=/|$)", "$1:")
    return F.lower(s)


def path_intent(path: Column) -> Column:
    """What a file is for, by its folders, then by its name; else the path itself."""
    parts = F.split(F.replace(F.lower(path), F.lit("\\"), F.lit("/")), "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    out = None
    for words, intent in FOLDER_INTENTS:
        fits = F.arrays_overlap(folders, F.array(*[F.lit(w) for w in words]))
        out = F.when(fits, intent) if out is None else out.when(fits, intent)
    for word, intent in STEM_INTENTS:
        out = out.when(stem.contains(word), intent)
    return out.otherwise(path)


def module_of(path: Column) -> Column:
    """The dotted name of a Python file; a package's own file is the package; empty if it can't be imported."""
    dotted = F.regexp_replace(F.regexp_replace(F.replace(path, F.lit("/"), F.lit(".")), r"\.py$", ""), r"(?:^|\.)__init__$", "")
    return F.when(path.endswith(".py") & dotted.rlike(r"^[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*$"), dotted).otherwise("")
