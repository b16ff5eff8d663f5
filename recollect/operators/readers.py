"""Reads of the memory tables, and the small writes that name rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.text import cache_key, decision_key
from recollect.operators.tables import active

# Fixed values.
FRESHNESS, SCAN_STATUS = ("fresh", "stale"), ("scanned", "parse_error", "ignored", "pending")
CACHE_TTL_MS = 24 * 3600 * 1000


def since(events: DataFrame, after_id: int = 0) -> DataFrame:
    """Active events after an id, in order."""
    return active(events).where(F.col("id") > after_id).orderBy("id")


def of_session(events: DataFrame, project_id: str, session_id: str) -> DataFrame:
    """All events of a session, dead ones too."""
    return events.where((F.col("project_id") == project_id) & (F.col("session_id") == session_id)).orderBy("id")


def of_type(events: DataFrame, project_id: str, event_type: str, include_archived: bool = False) -> DataFrame:
    """Events of a type, replaced ones too, archived ones if asked for."""
    own = events.where((F.col("project_id") == project_id) & (F.col("event_type") == event_type))
    return (own if include_archived else own.where(~F.col("archived"))).orderBy("id")


def heaviest(events: DataFrame, n: int = 50, by: tuple[str, ...] = ("project_id", "event_type")) -> DataFrame:
    """The n heaviest active events of each project and type."""
    order = Window.partitionBy(*by).orderBy(F.desc("weight"), "id")
    return active(events).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= n).drop("_k")


def recent_jobs(jobs: DataFrame, project_id: str, state: str | None = None, n: int = 20) -> DataFrame:
    own = jobs.where(F.col("project_id") == project_id)
    return (own if state is None else own.where(F.col("state") == state)).orderBy(F.desc("updated_at"), F.desc("id")).limit(n)


def of_paths(nodes: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Symbols of the given files (project_id, path), or of all."""
    return nodes if paths is None else nodes.join(paths.select("project_id", "path").distinct(), ["project_id", "path"], "left_semi")


def projects(events: DataFrame) -> DataFrame:
    """Every project with its active events and the addresses of its sections."""
    live = F.count_if(~F.col("archived") & F.col("superseded_by").isNull())
    names = ("state", "constraints", "decisions", "graveyard", "skeleton", "threads")
    uris = F.array(*[F.concat(F.lit("memory://"), F.col("project_id"), F.lit(f"/{n}")) for n in names])
    return events.groupBy("project_id").agg(live.alias("active")).withColumn("uris", uris)


def marked(events: DataFrame, changes: DataFrame) -> DataFrame:
    """events after changes by id (id, superseded_by, archived, weight; null leaves a value): weights never below 0."""
    c = changes.select("id", F.col("superseded_by").alias("_s"), F.col("archived").alias("_a"), F.col("weight").alias("_w"))
    j = events.join(c, "id", "left")
    new = {"superseded_by": F.coalesce("_s", "superseded_by"), "archived": F.coalesce("_a", "archived"), "weight": F.when(F.col("_w").isNotNull(), F.greatest(F.lit(0.0), F.col("_w"))).otherwise(F.col("weight"))}
    return j.select(*[new[x].alias(x) if x in new else F.col(x) for x in events.columns])


def with_keys(events: DataFrame) -> DataFrame:
    """events whose topic wasn't looked for yet (null) with it, empty where there is none."""
    found = decision_key(F.col("event_type"), F.col("subject"), F.col("description"))
    return events.withColumn("decision_key", F.when(F.col("decision_key").isNull(), found).otherwise(F.col("decision_key")))


def validated_files(files: DataFrame) -> DataFrame:
    """Scan states, checked: known values, and a reason wherever parsing failed."""
    known = F.col("freshness").isin(*FRESHNESS) & F.col("scan_status").isin(*SCAN_STATUS)
    said = (F.col("scan_status") != "parse_error") | (F.coalesce("last_error", F.lit("")) != "")
    fault = F.when(F.coalesce(known & said, F.lit(False)), F.lit(None).cast("string")).otherwise(F.raise_error(F.concat(F.lit("bad scan state of "), F.col("path"))).cast("string"))
    return files.withColumn("last_error", F.coalesce(fault, "last_error"))


def cached_searches(cache: DataFrame, asked: DataFrame, now: Column, ttl_ms: int = CACHE_TTL_MS) -> DataFrame:
    """Results of earlier searches (project_id, pattern, path, glob) that are still good."""
    keyed = asked.withColumn("cache_key", cache_key(F.col("pattern"), F.col("path"), F.col("glob")))
    good = cache.where(now - F.col("cached_at") <= ttl_ms).select("project_id", "cache_key", "result_text")
    return keyed.join(good, ["project_id", "cache_key"])


def counted_searches(cache: DataFrame, found: DataFrame) -> DataFrame:
    """The cache after lookups: a hit more for each."""
    hits = found.groupBy("project_id", "cache_key").agg(F.count(F.lit(1)).alias("_n"))
    j = cache.join(hits, ["project_id", "cache_key"], "left")
    return j.select(*[(F.col("hit_count") + F.coalesce("_n", F.lit(0))).alias(c) if c == "hit_count" else F.col(c) for c in cache.columns])


def without(df: DataFrame, gone: DataFrame) -> DataFrame:
    """df without the rows that `gone` names by its columns: a project's reset, a session's end, one row."""
    return df.join(gone.distinct(), gone.columns, "left_anti").select(*df.columns)
