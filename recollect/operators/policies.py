"""Decisions about reading files, and the life of extraction jobs, as pure functions of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RETRY_WINDOW_MS, MTIME_MARGIN_MS = 60_000, 1000
FINAL = ("completed", "dead_lettered")


def read_decisions(requests: DataFrame, read: DataFrame, files: DataFrame, denied: DataFrame, policy: str = "strict", retry_window_ms: int = RETRY_WINDOW_MS) -> DataFrame:
    """requests with action and reason: may a session read a file, or does it know it?

    requests: project_id, session_id, path (canonical, empty outside the project), now_ms,
    mtime_ms; read: what the session has read, with its outcome; files: the scan's state;
    denied: earlier refusals with denied_at.  The first rule that applies decides.
    """
    key = ["project_id", "session_id", "path"]
    j = requests.join(read.select(*key, "outcome"), key, "left")
    j = j.join(files.select("project_id", "path", "freshness", "scan_status", "symbol_count", "refreshed_at"), ["project_id", "path"], "left")
    j = j.join(denied.groupBy(*key).agg(F.max("denied_at").alias("denied_at")), key, "left")
    changed = (F.col("refreshed_at") > 0) & (F.col("mtime_ms") > F.col("refreshed_at") + MTIME_MARGIN_MS)
    recent = F.col("denied_at").isNotNull() & (F.col("now_ms") - F.col("denied_at") <= retry_window_ms)
    rules = [
        (F.col("path") == "", "allow", "path_outside_project"),
        (F.col("outcome") == "body_needed_retry", "deny", "rereread_after_body_retry"),
        (F.col("outcome").isNotNull(), "deny", "reread_same_session"),
        (F.lit(policy != "strict"), "allow", "advisory_policy"),
        (F.col("scan_status").isNull(), "allow", "not_in_symbol_files"),
        (F.col("freshness") == "stale", "allow", "symbol_files_stale"),
        (F.col("scan_status") == "parse_error", "allow", "scan_status_parse_error"),
        (F.col("scan_status") == "ignored", "allow", "scan_status_ignored"),
        (F.col("scan_status") == "pending", "allow", "scan_status_pending"),
        (F.col("symbol_count") == 0, "allow", "no_public_symbols"),
        (F.coalesce(changed, F.lit(False)), "allow", "symbol_files_mtime_stale"),
        (recent, "allow", "body_needed_retry_within_window"),
    ]
    decided: Column | None = None
    for condition, action, reason in rules:
        value = F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
        decided = F.when(condition, value) if decided is None else decided.when(condition, value)
    decided = decided.otherwise(F.struct(F.lit("deny").alias("action"), F.lit("skeleton_fresh_first_denial").alias("reason")))
    hint = F.when(F.col("d.reason") == "body_needed_retry_within_window", "body_needed_retry")
    return j.withColumn("d", decided).select(*requests.columns, "d.action", "d.reason", hint.alias("outcome_hint"))


def new_denials(decisions: DataFrame) -> DataFrame:
    """What a batch of decisions adds to the refusals."""
    first = decisions.where("reason = 'skeleton_fresh_first_denial'")
    return first.select("project_id", "session_id", "path", F.col("now_ms").alias("denied_at"), F.lit("skeleton_fresh").alias("reason"))


def enqueue(jobs: DataFrame, requested: DataFrame) -> DataFrame:
    """New jobs of requests that have none: project_id, session_id, evidence_id, category, now_ms."""
    key = ["project_id", "session_id", "evidence_id", "category"]
    new = requested.dropDuplicates(key).join(jobs.select(*key), key, "left_anti")
    return new.select(*key, F.lit("OBSERVED").alias("stage"), F.lit("queued").alias("state"), F.lit(0).alias("attempts"), F.lit(3).alias("max_attempts"), F.lit(None).cast("string").alias("failure_class"), F.col("now_ms").alias("updated_at"))


def next_jobs(jobs: DataFrame) -> DataFrame:
    """The oldest queued job of each project and category."""
    queued = jobs.where("state = 'queued'")
    oldest = queued.groupBy("project_id", "category").agg(F.min_by("id", F.struct("updated_at", "id")).alias("id"))
    return queued.join(oldest, ["project_id", "category", "id"], "left_semi")


def after_failure(jobs: DataFrame, failures: DataFrame, final_classes: tuple[str, ...] = ("POISON", "CORRUPT")) -> DataFrame:
    """jobs after failures (id, failure_class, now_ms): an attempt more, and the end if the class or the count says so."""
    f = failures.select("id", F.col("failure_class").alias("_class"), "now_ms")
    j = jobs.join(f, "id", "left")
    failed = F.col("_class").isNotNull() & ~F.col("state").isin(*FINAL)
    attempts = F.col("attempts") + F.when(failed, 1).otherwise(0)
    ends = F.col("_class").isin(*final_classes) | (attempts >= F.col("max_attempts"))
    state = F.when(failed, F.when(ends, "dead_lettered").otherwise("queued")).otherwise(F.col("state"))
    changes = {"attempts": attempts, "state": state, "failure_class": F.when(failed, F.col("_class")).otherwise(F.col("failure_class")), "updated_at": F.when(failed, F.col("now_ms")).otherwise(F.col("updated_at"))}
    return j.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in jobs.columns])


def after_stage(jobs: DataFrame, acks: DataFrame) -> DataFrame:
    """jobs after acknowledged stages (id, stage, now_ms): the last one counts, COMPLETED ends a job, ended jobs stay."""
    a = acks.groupBy("id").agg(F.max_by("stage", "now_ms").alias("_stage"), F.max("now_ms").alias("_at"))
    j = jobs.join(a, "id", "left")
    moved = F.col("_stage").isNotNull() & ~F.col("state").isin(*FINAL)
    changes = {
        "stage": F.when(moved, F.col("_stage")).otherwise(F.col("stage")),
        "state": F.when(moved, F.when(F.col("_stage") == "COMPLETED", "completed").otherwise("running")).otherwise(F.col("state")),
        "updated_at": F.when(moved, F.col("_at")).otherwise(F.col("updated_at")),
    }
    return j.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in jobs.columns])


def recovered(jobs: DataFrame, now_ms: Column, claimed_ms: int = 600_000, running_ms: int = 300_000, dead_workers: DataFrame | None = None) -> DataFrame:
    """jobs after a sweep: claims too old or of dead workers are queued again, runs too old end as timeouts."""
    j = jobs
    orphan = F.lit(False)
    if dead_workers is not None:
        j = j.join(dead_workers.select("worker").distinct().withColumn("_dead", F.lit(True)), "worker", "left")
        orphan = F.coalesce("_dead", F.lit(False)) & F.col("state").isin("claimed", "running")
    age = now_ms - F.col("updated_at")
    stale = (F.col("state") == "claimed") & (age > claimed_ms)
    stuck = (F.col("state") == "running") & (age > running_ms)
    back = orphan | stale
    changes = {
        "state": F.when(back, "queued").when(stuck, "dead_lettered").otherwise(F.col("state")),
        "failure_class": F.when(stuck & ~back, "TIMEOUT").otherwise(F.col("failure_class")),
        "updated_at": F.when(back | stuck, now_ms).otherwise(F.col("updated_at")),
    }
    return j.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in jobs.columns])


def replayed(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """jobs with the dead letters among ids queued as if new."""
    j = jobs.join(ids.select("id").distinct().withColumn("_again", F.lit(True)), "id", "left")
    again = F.coalesce("_again", F.lit(False)) & (F.col("state") == "dead_lettered")
    changes = {"state": F.when(again, "queued").otherwise(F.col("state")), "attempts": F.when(again, 0).otherwise(F.col("attempts")), "failure_class": F.when(~again, F.col("failure_class"))}
    return j.select(*[changes[c].alias(c) if c in changes else F.col(c) for c in jobs.columns])
