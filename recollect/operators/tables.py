"""Upserts of the memory tables as pure functions: existing rows and incoming rows in, the new table out.

Writers put the result beside the old table and swap; nothing is overwritten while it is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
BUMP, MOST_WEIGHT, ARCHIVE_BELOW = 0.15, 5.0, 0.05


def active(events: DataFrame) -> DataFrame:
    return events.where(~F.col("archived") & F.col("superseded_by").isNull())


def latest(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Replace by key: an incoming row (the last by `order`) takes the place of the existing one."""
    new = incoming if order is None else _last(incoming, keys, order)
    return existing.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def _last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, "r.*").select(*df.columns)


def insert_or_ignore(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The incoming rows whose key is neither there already nor earlier among them."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")


def insert_events(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Events by (project, hash): every further statement adds a mention and 0.15 of weight, up to 5."""
    columns = existing.columns
    new = incoming.select(*columns).withColumn("_new", F.lit(True))
    both = existing.withColumn("_new", F.lit(False)).unionByName(new)
    first = F.min_by(F.struct(*columns), F.struct("_new", "created_at", "id")).alias("e")
    merged = both.groupBy("project_id", "content_hash").agg(first, (F.count(F.lit(1)) - 1).alias("again"), F.first("evidence_id", ignorenulls=True).alias("_evidence"))
    e = merged.select("e.*", "again", "_evidence")
    return e.select(
        *[
            (F.col("mention_count") + F.col("again")).alias(c)
            if c == "mention_count"
            else F.when(F.col("again") > 0, F.least(F.col("weight") + F.col("again") * BUMP, F.lit(MOST_WEIGHT))).otherwise(F.col("weight")).alias(c)
            if c == "weight"
            else F.coalesce("evidence_id", "_evidence").alias(c)
            if c == "evidence_id"
            else F.col(c)
            for c in columns
        ]
    )


def store_evidence(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming evidence that the project doesn't hold yet, by the hash of its content."""
    hashed = incoming.withColumn("content_sha256", F.sha2(F.col("content"), 256))
    return insert_or_ignore(existing, hashed, ["project_id", "content_sha256"])


def link_provenance(links: DataFrame) -> DataFrame:
    """One link per (event, evidence): the newest extractor, the first known value of all else."""
    keys = ["event_id", "evidence_id"]
    rest = [c for c in links.columns if c not in (*keys, "extractor_version", "created_at")]
    known = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("created_at"))).alias(c) for c in rest]
    return links.groupBy(*keys).agg(F.max_by("extractor_version", "created_at").alias("extractor_version"), *known, F.min("created_at").alias("created_at"))


def read_cache(reads: DataFrame) -> DataFrame:
    """Reads of each file in each session: first, last, how many, and the last outcome."""
    return reads.groupBy("project_id", "session_id", "file_path").agg(
        F.min("read_at").alias("first_read_at"), F.max("read_at").alias("last_read_at"), F.count(F.lit(1)).alias("read_count"), F.max_by("outcome", "read_at").alias("outcome")
    )


def expired(df: DataFrame, time_column: str, now: Column, ttl_ms: int) -> DataFrame:
    """What is left after rows older than their time to live go."""
    return df.where(now - F.col(time_column) <= ttl_ms)


def invalidated(cache: DataFrame, changed: DataFrame) -> DataFrame:
    """Cached searches that a changed path of their project concerns: no filter, its own path or folder, or a glob that fits.

    changed: project_id, changed_path, null for everything.  Both sides meet by project.
    """
    glob = F.concat(F.lit("^"), F.replace(F.replace(F.regexp_replace("glob_filter", r"([.+^$(){}|\[\]\\])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))
    path, own = F.col("changed_path"), F.coalesce(F.col("path_filter"), F.lit(""))
    unfiltered = (own == "") & (F.coalesce(F.col("glob_filter"), F.lit("")) == "")
    by_path = (own != "") & ((path == own) | path.startswith(F.concat(F.regexp_replace(own, "/+$", ""), F.lit("/"))))
    by_glob = (F.coalesce(F.col("glob_filter"), F.lit("")) != "") & (F.rlike(path, glob) | F.rlike(F.element_at(F.split(path, "/"), -1), glob))
    hit = path.isNull() | unfiltered | by_path | by_glob
    return cache.join(changed, "project_id").where(hit).select(*cache.columns).distinct()


def without_vectors(events: DataFrame, vectors: DataFrame, version: str) -> DataFrame:
    """Active events that have no vector (event_id, model_version) of the model's version yet: what a backfill embeds."""
    own = vectors.where(F.col("model_version") == version).select(F.col("event_id").alias("id"))
    return active(events).join(own, "id", "left_anti")


def without_index(events: DataFrame, indexed: DataFrame) -> DataFrame:
    """Active events that the search index (id) doesn't hold yet."""
    return active(events).join(indexed.select("id"), "id", "left_anti")


def dead_letters(failures: DataFrame, n: int = 10) -> DataFrame:
    """The newest n failures of each project."""
    newest = Window.partitionBy("project_id").orderBy(F.desc("failed_at"), F.desc("id"))
    return failures.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n).drop("k")


def swap(df: DataFrame, folder: str) -> str:
    """df written beside the versions that folder holds; returns the new version's path."""
    path = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path
