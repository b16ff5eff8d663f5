"""Version-control diffs as file changes, and what they say about events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.paths import path_intent
from recollect.functions.text import content_hash

# Fixed values.
BASE_WEIGHT, LINES_PER_POINT, MOST_CHURN = 0.5, 200.0, 0.4
CORROBORATED, MOST_WEIGHT = 0.2, 2.0


def file_changes(diffs: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """path, change_type, old_path, lines_changed of `--stat --name-status` output (column diff).

    lines_changed counts the plus and minus marks of the stat line, as shown.
    """
    lines = diffs.select(*keys, F.posexplode(F.split("diff", r"\r?\n")).alias("at", "line"))
    status = F.regexp_extract("line", r"^([AMDRC]\d*)\t(.+)$", 1)
    named = F.split(F.regexp_extract("line", r"^([AMDRC]\d*)\t(.+)$", 2), "\t")
    kind = F.when(status.startswith("R"), "renamed").when(status == "A", "added").when(status == "D", "deleted").otherwise("modified")
    changes = lines.where(status != "").select(
        *keys,
        "at",
        F.trim(F.element_at(named, -1)).alias("path"),
        kind.alias("change_type"),
        F.when((kind == "renamed") & (F.size(named) > 1), F.trim(named[0])).otherwise("").alias("old_path"),
    )
    stat = r"^(.+?)\s*\|\s*(\d+)\s*([+\-]*)$"
    counts = lines.where(F.col("line").rlike(stat)).select(
        *keys, "at", F.trim(F.regexp_extract("line", stat, 1)).alias("path"), F.char_length(F.regexp_extract("line", stat, 3)).alias("n")
    )
    counts = counts.groupBy(*keys, "path").agg(F.max_by("n", "at").alias("lines_changed"))
    return changes.join(counts, [*keys, "path"], "left").select(*keys, "at", "path", "change_type", "old_path", F.coalesce("lines_changed", F.lit(0)).alias("lines_changed"))


def change_events(changes: DataFrame) -> DataFrame:
    """A component event per changed file, heavier the more it changed."""
    description = F.format_string("%s %s (%d lines)", "path", "change_type", "lines_changed")
    return changes.select(
        *[c for c in changes.columns if c not in ("at", "old_path")],
        F.lit("COMPONENT_STATUS").alias("event_type"),
        F.lit("in_flux").alias("status"),
        path_intent(F.col("path")).alias("intent"),
        description.alias("description"),
        content_hash(F.lit("COMPONENT_STATUS"), description).alias("content_hash"),
        (BASE_WEIGHT + F.least(F.lit(MOST_CHURN), F.col("lines_changed") / LINES_PER_POINT)).alias("weight"),
    )


def corroborated(events: DataFrame, changes: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """events, the abandoned ones heavier where a word of theirs is part of a changed path of the session."""
    hints = F.array_distinct(F.regexp_extract_all(F.lower("description"), F.lit(r"([a-z][a-z0-9\-]{2,})"), 1))
    paths = changes.groupBy(*keys).agg(F.collect_set(F.lower("path")).alias("_paths"))
    joined = events.join(paths, list(keys), "left")
    hit = F.exists(hints, lambda h: F.exists(F.col("_paths"), lambda p: p.contains(h)))
    own = F.col("event_type").isin("APPROACH_ABANDONED", "APPROACH_ABANDONED_DO_NOT_RETRY") & F.coalesce(hit, F.lit(False))
    weight = F.when(own, F.least(F.lit(MOST_WEIGHT), F.col("weight") + CORROBORATED)).otherwise(F.col("weight"))
    return joined.withColumn("git_corroborated", own).withColumn("weight", weight).drop("_paths")
