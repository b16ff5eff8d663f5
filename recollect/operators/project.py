"""The current state of a project: routed, collapsed, consolidated, weighted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.paths import canonical_path, is_bare_name
from recollect.functions.similarity import jaccard
from recollect.functions.text import normalise_subject, overlap_tokens
from recollect.functions.weights import activity_factor, authority_rank, centrality_factor, composite
from recollect.operators.tables import active
from recollect.plans.checkpoints import cut

# Fixed values.
BUCKETS = {
    "CONSTRAINT_HARD": "hard", "APPROACH_ABANDONED_DO_NOT_RETRY": "graveyard", "COMPONENT_STATUS": "component", "DECISION": "decision",
    "CONSTRAINT_SOFT": "decision", "APPROACH_ABANDONED": "decision", "THREAD_OPEN": "thread",
}
ONE_WORD_JACCARD, SAME_VALUE_JACCARD, LINEAGE_CHARS = 0.3, 0.85, 80
THREAD_ORDER = {"user_stated": 0, "assistant_answer_to_user_question": 1, "llm": 2, "assistant_decided": 3, "inferred_from_code": 4}
CONFIRMING = ("user_stated", "assistant_decided", "llm")


def bucket(event_type: Column) -> Column:
    """Where a type is shown; closed threads are shown nowhere."""
    return F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv])[event_type]


def _canonical(e: str = "") -> Column:
    """Latest wins: the highest authority, then the newest, then the highest id."""
    p = f"{e}." if e else ""
    return F.struct(authority_rank(F.col(f"{p}authority")), F.coalesce(F.col(f"{p}created_at"), F.lit(0)), F.coalesce(F.col(f"{p}id"), F.lit(0)))


def consolidated(events: DataFrame) -> DataFrame:
    """One record per topic (project_id, decision_key): the canonical event, mentions summed, the largest weight.

    Keys of a single word join only what shares enough words with their canonical event.  Up to
    two earlier values that say something else stay visible as lineage.  Events without a key
    pass as they are.
    """
    columns = [c for c in events.columns if c not in ("mention_count", "weight")]
    no_lineage = F.array().cast("array<struct<description:string,session_id:string>>")
    keyed = events.where(F.coalesce("decision_key", F.lit("")) != "")
    loose = events.where(F.coalesce("decision_key", F.lit("")) == "").withColumn("provenance_count", F.lit(1).cast("long")).withColumn("lineage", no_lineage)
    said = F.regexp_replace(F.trim(F.lower(F.coalesce("description", F.lit("")))), r"\s+", " ")
    k = keyed.withColumn("_said", said).withColumn("_tokens", overlap_tokens(F.col("_said"))).withColumn("_order", _canonical())
    head = k.groupBy("project_id", "decision_key").agg(F.max_by(F.struct("id", "_tokens", "_said"), "_order").alias("h"))
    joined = k.join(head, ["project_id", "decision_key"])
    one_word = ~F.col("decision_key").contains(" ")
    belongs = (F.col("id") == F.col("h.id")) | ~one_word | (jaccard(F.col("_tokens"), F.col("h._tokens")) >= ONE_WORD_JACCARD)
    joined = joined.withColumn("_group", F.when(belongs, F.col("h.id")).otherwise(F.col("id")))
    totals = joined.groupBy("project_id", "_group").agg(
        F.sum("mention_count").alias("mention_count"), F.max("weight").alias("weight"), F.count(F.lit(1)).alias("provenance_count"), F.max_by(F.struct(*columns), "_order").alias("c")
    )
    # the latest value that says something else than the canonical one, then the latest that says something else than both
    says_else = lambda said, tokens: (F.col("_said") != said) & (jaccard(F.col("_tokens"), tokens) < SAME_VALUE_JACCARD)
    other = joined.where((F.col("_group") == F.col("h.id")) & (F.col("id") != F.col("h.id")) & says_else(F.col("h._said"), F.col("h._tokens")))
    other = other.select("project_id", "_group", "_order", "_said", "_tokens", F.struct(F.substring(F.coalesce("description", F.lit("")), 1, LINEAGE_CHARS).alias("description"), "session_id").alias("line"))
    latest = lambda rows, name: rows.groupBy("project_id", "_group").agg(F.max_by(F.struct("_order", "_said", "_tokens", "line"), "_order").alias(name))
    first = latest(other, "a")
    further = other.join(first, ["project_id", "_group"]).where((F.col("_order") < F.col("a._order")) & says_else(F.col("a._said"), F.col("a._tokens")))
    second = latest(further, "b")
    both = totals.join(first, ["project_id", "_group"], "left").join(second, ["project_id", "_group"], "left")
    lineage = F.when(F.col("a").isNull(), no_lineage).when(F.col("b").isNull(), F.array(F.col("a.line"))).otherwise(F.array(F.col("a.line"), F.col("b.line")))
    merged = both.select(*[F.col(f"c.{c}").alias(c) for c in columns], "mention_count", "weight", "provenance_count", lineage.alias("lineage"))
    return merged.unionByName(loose.select(*merged.columns))


def component_states(events: DataFrame) -> DataFrame:
    """One component per canonical path: the last event, mentions summed, the largest weight; bare file names are left out."""
    own = events.where("event_type = 'COMPONENT_STATUS'").withColumn("path", canonical_path(F.col("path"))).where((F.col("path") != "") & ~is_bare_name(F.col("path")))
    rest = [c for c in events.columns if c not in ("project_id", "path", "mention_count", "weight")]
    merged = own.groupBy("project_id", "path").agg(F.max_by(F.struct(*rest), "id").alias("e"), F.sum("mention_count").alias("mention_count"), F.max("weight").alias("weight"))
    return merged.select("project_id", "path", "e.*", "mention_count", "weight").select(*events.columns)


def session_ordinals(events: DataFrame) -> DataFrame:
    """project_id, session_id, ordinal: sessions in order of their first event."""
    first = events.groupBy("project_id", "session_id").agg(F.min("id").alias("first_id"))
    return first.select("project_id", "session_id", F.row_number().over(Window.partitionBy("project_id").orderBy("first_id")).alias("ordinal"))


def weighted(records: DataFrame, events: DataFrame, centralities: DataFrame | None = None) -> DataFrame:
    """records with composite weights: sessions since, mentions, the files' centrality and state, the type."""
    ordinals = session_ordinals(events)
    latest = ordinals.groupBy("project_id").agg(F.max("ordinal").alias("_latest"))
    own = F.when(F.col("event_type") == "COMPONENT_STATUS", F.when(F.coalesce("path", F.lit("")) != "", F.array("path")).otherwise(F.array().cast("array<string>"))).otherwise(
        F.coalesce("affected_files", F.array().cast("array<string>"))
    )
    files = records.withColumn("_files", own)
    state = records.where("event_type = 'COMPONENT_STATUS'").groupBy("project_id", "path").agg(F.max_by("status", "id").alias("_status"))
    each = files.select("project_id", "id", F.explode("_files").alias("path")).join(state, ["project_id", "path"], "left")
    if centralities is not None:
        each = each.join(centralities, ["project_id", "path"], "left")
        largest = centralities.groupBy("project_id").agg(F.max("centrality").alias("_largest"))
    else:
        each = each.withColumn("centrality", F.lit(None).cast("double"))
        largest = latest.select("project_id", F.lit(None).cast("double").alias("_largest"))
    about = each.groupBy("project_id", "id").agg(F.collect_list(F.coalesce("_status", F.lit("unknown"))).alias("_statuses"), F.max(F.coalesce("centrality", F.lit(0.0))).alias("_best"))
    j = files.join(about, ["project_id", "id"], "left").join(ordinals, ["project_id", "session_id"], "left").join(latest, "project_id", "left").join(largest, "project_id", "left")
    since = F.col("_latest") - F.coalesce("ordinal", F.lit(0))
    w = composite(F.col("event_type"), since, F.col("mention_count"), centrality_factor(F.col("_best"), F.col("_largest")), activity_factor(F.coalesce("_statuses", F.array().cast("array<string>"))))
    return j.withColumn("weight", w).select(*records.columns)


def projection(events: DataFrame, centralities: DataFrame | None = None) -> DataFrame:
    """The current state of every project: bucket, the record, its composite weight."""
    live = active(events)
    choices = live.where(bucket(F.col("event_type")).isin("hard", "decision"))
    others = live.where(bucket(F.col("event_type")).isin("graveyard", "thread"))
    records = consolidated(choices)
    extra = others.unionByName(component_states(live)).withColumn("provenance_count", F.lit(1).cast("long")).withColumn("lineage", F.array().cast("array<struct<description:string,session_id:string>>"))
    records = records.unionByName(extra.select(*records.columns))
    return weighted(cut(records), live, centralities).withColumn("bucket", bucket(F.col("event_type")))


def is_stale(events: DataFrame, built: DataFrame) -> DataFrame:
    """project_id, stale: projects whose projection (project_id, high_water) is missing or older than their last event."""
    last = events.groupBy("project_id").agg(F.max("id").alias("last"))
    return last.join(built, "project_id", "left").select("project_id", (F.col("high_water").isNull() | (F.col("last") > F.col("high_water"))).alias("stale"))


def hot_files(events: DataFrame, least: int = 2) -> DataFrame:
    """project_id, path, mentions, intent of components mentioned often."""
    own = events.where("event_type = 'COMPONENT_STATUS'")
    stated = F.when((F.coalesce("intent", F.lit("")) != "") & (F.col("intent") != F.col("path")), F.col("intent"))
    out = own.groupBy("project_id", "path").agg(F.sum("mention_count").alias("mentions"), F.min_by(stated, F.when(stated.isNotNull(), F.col("id"))).alias("intent"))
    return out.where(F.col("mentions") >= least).select("project_id", "path", "mentions", F.coalesce("intent", F.lit("")).alias("intent"))


def sections(records: DataFrame) -> DataFrame:
    """records with `section` and `place`: answers that nobody confirmed are pending, confirmed ones go, threads are ordered."""
    subject = normalise_subject(F.coalesce(F.nullif("subject", F.lit("")), F.col("path"), F.lit("")))
    own = records.withColumn("_subject", subject)
    confirmed = own.where(F.col("authority").isin(*CONFIRMING) & (F.col("_subject") != "")).select("project_id", "_subject").distinct().withColumn("_confirmed", F.lit(True))
    own = own.join(confirmed, ["project_id", "_subject"], "left")
    pending = F.coalesce(F.col("authority") == "assistant_answer_to_user_question", F.lit(False))
    section = F.when(pending, F.when(F.col("_confirmed"), F.lit(None)).otherwise("pending")).when((bucket(F.col("event_type")) == "component") & is_bare_name(F.coalesce("path", F.lit(""))), None).otherwise(bucket(F.col("event_type")))
    thread = F.coalesce(F.create_map(*[F.lit(x) for kv in THREAD_ORDER.items() for x in kv])[F.coalesce("authority", F.lit(""))], F.lit(5))
    kept = own.withColumn("section", section).where("section is not null").drop("_confirmed", "_subject")
    order = Window.partitionBy("project_id", "section").orderBy(F.when(F.col("section") == "thread", thread).otherwise(0), F.desc("weight"), "id")
    return kept.withColumn("place", F.row_number().over(order))
