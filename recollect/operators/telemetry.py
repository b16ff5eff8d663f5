"""Usage, cache and tool-call measures of sessions, and the measures of evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.paths import canonical_path

EDITS = ("Edit", "MultiEdit", "NotebookEdit")


def cache_stats(usage: DataFrame) -> DataFrame:
    """Per project: sessions, mean of each session's share of input served from the cache, tokens read and saved."""
    denominator = F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    read = F.sum("cache_read_tokens")
    return usage.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("sessions"),
        F.coalesce(F.avg(F.when(denominator > 0, F.col("cache_read_tokens") / denominator)), F.lit(0.0)).alias("avg_cache_hit_rate"),
        read.alias("total_cache_read_tokens"),
        F.bround(read * 0.9).cast("long").alias("effective_tokens_saved"),
    )


def recent_sessions(usage: DataFrame, n: int = 10) -> DataFrame:
    newest = Window.partitionBy("project_id").orderBy(F.desc("ingested_at"), "session_id")
    return usage.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n)


def rollup(usage: DataFrame) -> DataFrame:
    """Per project: counters, and input as billed (1.25 for cache writes, 0.1 for cache reads)."""
    totals = usage.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("sessions"), *[F.sum(c).alias(c) for c in ("input_tokens", "cache_creation_tokens", "cache_read_tokens", "output_tokens")]
    )
    billed = F.col("input_tokens") + F.bround(F.col("cache_creation_tokens") * 1.25) + F.bround(F.col("cache_read_tokens") * 0.1)
    return totals.withColumn("billed_input_tokens", billed.cast("long"))


def unread_changes(calls: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Per session: changes of files that the session hadn't read before, and their kinds.

    calls: keys, pos, tool, path (canonical).  What a call itself does counts for later ones only.
    """
    before = Window.partitionBy(*keys, "path").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    prior = lambda flag: F.coalesce(F.max(flag).over(before), F.lit(False))
    is_read = F.col("tool") == "Read"
    seen = calls.where(F.col("path") != "").withColumn("_read", prior(is_read)).withColumn("_written", prior(~is_read))
    change = ~is_read
    unread = change & ~F.col("_read")
    out = seen.groupBy(*keys).agg(
        F.count_if(change).alias("modifications"),
        F.count_if(unread).alias("unread_modifications"),
        F.count_if(unread & F.col("tool").isin(*EDITS)).alias("edits_without_read"),
        F.count_if(unread & (F.col("tool") == "Write") & ~F.col("_written")).alias("first_writes"),
        F.count_if(is_read).alias("reads"),
        F.count_distinct(F.when(change, F.col("path"))).alias("files_modified"),
    )
    return out.withColumn("unread_rate", F.when(F.col("modifications") > 0, F.col("unread_modifications") / F.col("modifications")).otherwise(0.0))


def canonical_calls(calls: DataFrame) -> DataFrame:
    """tool_calls with `path`: canonical below cwd, else as written with slashes and case folded."""
    inside = canonical_path(F.col("raw_path"), F.col("cwd"))
    bare = canonical_path(F.col("raw_path"))
    path = F.when(F.coalesce(F.col("cwd"), F.lit("")) != "", inside).otherwise(bare)
    return calls.withColumn("path", F.when(path != "", path).otherwise(F.lower(F.replace(F.col("raw_path"), F.lit("\\"), F.lit("/")))))


def section_tokens(blocks: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Tokens of each `##` or `###` section of a rendered block (column block); sections of one name add up."""
    lines = blocks.select(*keys, F.posexplode(F.split("block", "\n")).alias("at", "line"))
    head = F.regexp_extract("line", r"^#{2,3}\s+(.*)$", 1)
    in_order = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    named = lines.withColumn("section", F.coalesce(F.last(F.nullif(head, F.lit("")), ignorenulls=True).over(in_order), F.lit("(preamble)")))
    named = named.withColumn("part", F.sum(F.when(head != "", 1).otherwise(0)).over(in_order))
    parts = named.groupBy(*keys, "section", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    tokens = F.when(F.trim("text") == "", 0).otherwise(F.greatest(F.lit(1), F.floor(F.char_length("text") / 4)))
    return parts.groupBy(*keys, "section").agg(F.sum(tokens).cast("long").alias("tokens"))


def section_changes(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Sections of either report with the tokens they gained."""
    on = [*keys, "section"]
    both = before.withColumnRenamed("tokens", "before").join(after.withColumnRenamed("tokens", "after"), on, "full_outer")
    return both.select(*on, F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after")).withColumn("delta", F.col("after") - F.col("before"))


def coverage(files: DataFrame) -> DataFrame:
    """Per project: files by the state of their scan."""
    return files.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if((F.col("scan_status") == "scanned") & (F.col("freshness") == "fresh")).alias("fresh"),
        F.count_if((F.col("scan_status") == "scanned") & (F.col("freshness") == "stale")).alias("stale"),
        F.count_if(F.col("scan_status") == "parse_error").alias("parse_errors"),
        F.count_if(F.col("scan_status") == "ignored").alias("ignored"),
        F.max_by("path", F.struct("refreshed_at", "path")).alias("last_refreshed_path"),
        F.max("refreshed_at").alias("last_refreshed_at"),
    )


def evidence_summary(evidence: DataFrame) -> DataFrame:
    """Per project: pieces, bytes, stored bytes, and their ratio (0 if nothing is stored)."""
    out = evidence.groupBy("project_id").agg(F.count(F.lit(1)).alias("pieces"), F.coalesce(F.sum("original_size"), F.lit(0)).alias("original_bytes"), F.coalesce(F.sum("stored_size"), F.lit(0)).alias("stored_bytes"))
    return out.withColumn("ratio", F.when(F.col("stored_bytes") > 0, F.col("original_bytes") / F.col("stored_bytes")).otherwise(0.0))


def store_health(events: DataFrame, failures: DataFrame, jobs: DataFrame) -> DataFrame:
    """Per project: events by state, sessions that any table knows, failures, unfinished jobs."""
    by_event = events.groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.col("archived") & F.col("superseded_by").isNull()).alias("active"),
        F.count_if(F.col("archived")).alias("archived"),
        F.count_if(F.col("superseded_by").isNotNull()).alias("superseded"),
    )
    known = events.select("project_id", "session_id").union(jobs.select("project_id", "session_id")).distinct()
    sessions = known.groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions"))
    failed = failures.groupBy("project_id").agg(F.count(F.lit(1)).alias("failures"))
    waiting = jobs.groupBy("project_id").agg(F.count_if(F.col("state").isin("queued", "claimed", "running")).alias("open_jobs"))
    out = sessions.join(by_event, "project_id", "left").join(failed, "project_id", "left").join(waiting, "project_id", "left")
    return out.na.fill(0)


def ingest_cost(firings: DataFrame) -> DataFrame:
    """Per session: latency range, milliseconds per KB by least squares, and how often bytes were processed again.

    firings: session_id, latency_ms, kilobytes, original_bytes.
    """
    return firings.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("firings"),
        F.min("latency_ms").alias("least_ms"),
        F.max("latency_ms").alias("most_ms"),
        F.regr_slope("latency_ms", "kilobytes").alias("ms_per_kb"),
        F.when(F.max("original_bytes") > 0, F.sum("original_bytes") / F.max("original_bytes")).otherwise(0.0).alias("amplification"),
    )


def confusion(pairs: DataFrame, predicted: str = "predicted", expected: str = "expected", guard: str | None = None) -> DataFrame:
    """Counts, precision, recall and F1 of 0/1 predictions, and false alarms on guard pairs."""
    p, e = F.col(predicted).cast("boolean"), F.col(expected).cast("boolean")
    hit, alarm, miss = F.count_if(p & e), F.count_if(p & ~e), F.count_if(~p & e)
    guarded = F.count_if(p & ~e & F.col(guard)) if guard else F.lit(0).cast("long")
    out = pairs.agg(hit.alias("tp"), alarm.alias("fp"), miss.alias("fn"), F.count_if(~p & ~e).alias("tn"), guarded.alias("guard_fp"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def rank_auc(scored: DataFrame, score: str = "score", label: str = "label", bins: int = 4096) -> DataFrame:
    """Area under the ROC curve, ties a half; 0 if a class is missing.

    Counts per distinct score are ranked inside bins of the score's range, and the bins (a
    bounded number) among themselves, so neither pairs nor all scores meet in one task.
    """
    per = scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))
    ends = per.agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor((F.col("s") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins))).otherwise(0)
    binned = per.crossJoin(F.broadcast(ends)).withColumn("bin", place.cast("int"))  # one row
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    by_bin = binned.groupBy("bin").agg(F.sum("neg").alias("n")).withColumn("lower", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    inside = Window.partitionBy("bin").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(inside), F.lit(0)) + F.col("lower")
    won = binned.join(by_bin, "bin").withColumn("w", F.col("pos") * (below + F.col("neg") / 2.0))
    return won.agg(F.sum("w").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n")).select(F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("w") / (F.col("p") * F.col("n"))).otherwise(0.0).alias("auc"))


def kappa(rated: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters."""
    n = rated.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(a) == F.col(b)).alias("same"))
    left = rated.groupBy(F.col(a).alias("k")).agg(F.count(F.lit(1)).alias("x"))
    right = rated.groupBy(F.col(b).alias("k")).agg(F.count(F.lit(1)).alias("y"))
    chance = left.join(right, "k").agg(F.coalesce(F.sum(F.col("x") * F.col("y")), F.lit(0)).alias("xy"))
    both = n.crossJoin(F.broadcast(chance))  # one row each
    po, pe = F.col("same") / F.col("n"), F.col("xy") / (F.col("n") * F.col("n"))
    return both.select(F.when(F.col("n") == 0, 0.0).when(pe == 1, 1.0).otherwise((po - pe) / (1 - pe)).alias("kappa"))


# Marks of wrong finds.
CUT_SHORT = r"(?U)(?:…|\.\.\.)\s*\.?\s*$"
THREAD_VERB = r"(?iU)\b(open|next session|implement|build|work item|work thread|active work|todo|to-do|create|tackle)\b"
REJECT_VERB = r"(?iU)\b(reject|ruled out|never use|do not use|don't use|avoid|not used|instead of|too heavy|abandon|no\b)"
LEAST_CONTENT_WORDS = 4


def wrong_finds(events: DataFrame, echoes: tuple[str, ...], meta: tuple[str, ...], keys: tuple[str, ...] = ("session_id",), order: str = "id") -> DataFrame:
    """events (event_type, text) with `wrong`: why an event is no find, null for what is one; the first reason counts.

    A text said before in its session, echoes and meta talk by their signatures, texts cut
    short, fragments, threads and dead ends without a verb of their kind.
    """
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))
    said = plain(F.coalesce("text", F.lit("")))
    holds = lambda marks: F.exists(F.array(*[plain(F.lit(m)) for m in marks]).cast("array<string>"), lambda m: F.col("_said").contains(m))
    e = events.withColumn("_said", said)
    again = F.row_number().over(Window.partitionBy(*keys, "_said").orderBy(order)) > 1
    reasons = [
        ("dup", again),
        ("echo", holds(echoes)),
        ("meta", holds(meta)),
        ("truncated", F.col("text").rlike(CUT_SHORT)),
        ("fragment", F.size(F.regexp_extract_all("_said", F.lit("([a-z0-9]{3,})"), 1)) < LEAST_CONTENT_WORDS),
        ("mistyped_thread", F.col("event_type").isin("THREAD_OPEN", "THREAD_CLOSE") & ~F.col("_said").rlike(THREAD_VERB)),
        ("false_graveyard", (F.col("event_type") == "APPROACH_ABANDONED_DO_NOT_RETRY") & ~F.col("_said").rlike(REJECT_VERB)),
    ]
    wrong = F.lit(None).cast("string")
    for name, found in reversed(reasons):
        wrong = F.when(F.coalesce(found, F.lit(False)), name).otherwise(wrong)
    return e.withColumn("wrong", wrong).drop("_said")


def discovered(known: DataFrame, logs: DataFrame) -> DataFrame:
    """Per project of known sessions (project_id, session_id): sessions, those with a log (session_id, of any number of lines) and those skipped without."""
    each = known.select("project_id", "session_id").distinct().join(logs.select("session_id").distinct().withColumn("_log", F.lit(True)), "session_id", "left")
    return each.groupBy("project_id").agg(F.count(F.lit(1)).alias("sessions"), F.count("_log").alias("ingested"), (F.count(F.lit(1)) - F.count("_log")).alias("skipped"))


def job_costs(jobs: DataFrame, acks: DataFrame, evidence: DataFrame) -> DataFrame:
    """Firings (session_id, latency_ms, kilobytes, original_bytes) of finished jobs: from their first acknowledgement (id, stage, at_ms) to the last, over their evidence (id, size)."""
    took = acks.groupBy("id").agg((F.max("at_ms") - F.min("at_ms")).cast("double").alias("latency_ms"))
    done = jobs.where("state = 'completed'").select("id", "session_id", "evidence_id").join(took, "id")
    sized = done.join(evidence.select(F.col("id").alias("evidence_id"), F.col("size").alias("original_bytes")), "evidence_id")
    return sized.select("session_id", "latency_ms", (F.col("original_bytes") / 1024).alias("kilobytes"), "original_bytes")


def fact_presence(events: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts (id, groups: array of arrays of substrings) that some active description holds: any group, whole.

    Facts are a question set; they are matched against all descriptions, which never leave their tasks.
    """
    bounded = facts.limit(10_001).count()
    if bounded > 10_000:
        raise ValueError("a question set holds 10000 facts at most; ask in parts")
    found = events.select(F.lower("description").alias("d")).distinct().join(
        F.broadcast(facts), F.exists("groups", lambda g: F.forall(g, lambda s: F.col("d").contains(F.lower(s))))
    )
    return facts.select("id").join(found.select("id").distinct().withColumn("present", F.lit(True)), "id", "left").na.fill(False)
