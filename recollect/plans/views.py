"""Memory tables made of the driver's tables, for the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import content_hash, overlap_tokens
from recollect.schemas import EVENT_TYPES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(column: str) -> Column:
    """Epoch milliseconds of a time without zone, whatever the session's zone."""
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', cast({column} AS timestamp_ntz))")


def memory_events(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """conversations as events: a turn each, its conversation the session and the evidence, five projects.

    The topic of a choice is its two alphabetically first content words.  dealt: rows are spread
    over tasks before any text is worked on, as a table in one file is read by few.
    """
    c = table(spark, sf_dir, "conversations")
    if dealt:
        c = c.repartition("conv_id", "turn")
    kind = F.element_at(F.array(*[F.lit(t) for t in EVENT_TYPES]), ((F.col("conv_id") + F.col("turn")) % len(EVENT_TYPES) + 1).cast("int"))
    key = F.array_join(F.slice(F.array_sort(overlap_tokens(F.col("text"))), 1, 2), " ")
    ident = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(
        ident.alias("id"),
        F.concat(F.lit("p"), (F.col("conv_id") % 5).cast("string")).alias("project_id"),
        F.concat(F.lit("s"), F.col("conv_id").cast("string")).alias("session_id"),
        ident.alias("created_at"),
        kind.alias("event_type"),
        F.col("text").alias("description"),
        F.lit("").alias("rationale"),
        F.lit("").alias("subject"),
        F.when(F.col("role") == "user", "user_stated").when(F.col("role") == "assistant", "assistant_decided").otherwise("inferred_from_code").alias("authority"),
        F.concat(F.lit("src/m"), (F.col("conv_id") % 17).cast("string"), F.lit(".py")).alias("path"),
        F.element_at(F.array(F.lit("in_flux"), F.lit("stable"), F.lit("blocked")), (F.col("turn") % 3 + 1).cast("int")).alias("status"),
        F.lit("").alias("intent"),
        F.array().cast("array<string>").alias("affected_files"),
        F.array().cast("array<string>").alias("dependencies"),
        content_hash(kind, F.col("text")).alias("content_hash"),
        (1.0 + (F.col("turn") % 3) * 0.5).alias("weight"),
        F.lit(1).cast("long").alias("mention_count"),
        F.lit(None).cast("long").alias("superseded_by"),
        ((F.col("conv_id") + F.col("turn")) % 11 == 0).alias("archived"),
        F.col("conv_id").alias("evidence_id"),
        F.when(kind.isin("CONSTRAINT_HARD", "CONSTRAINT_SOFT", "DECISION"), key).otherwise("").alias("decision_key"),
    )


def nation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import graph: the nation of each order's customer to the nation of each line's supplier."""
    lines, orders = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers, suppliers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.select(
        F.lit("world").alias("project_id"), F.col("c_nationkey").cast("string").alias("from_path"), F.col("s_nationkey").cast("string").alias("to_path"), F.lit("imports").alias("edge_type"), F.lit(False).alias("is_external")
    )


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counters of sessions: a user's events, weighed by type."""
    e = table(spark, sf_dir, "events")
    weigh = lambda kind, by: F.sum(F.when(F.col("event_type") == kind, F.floor(F.col("value") * by)).otherwise(0)).cast("long")
    return e.groupBy((F.col("user_id") % 7).cast("string").alias("project_id"), F.col("user_id").cast("string").alias("session_id")).agg(
        weigh("click", 10).alias("input_tokens"), weigh("view", 10).alias("cache_creation_tokens"), weigh("error", 10).alias("cache_read_tokens"), weigh("signup", 10).alias("output_tokens"), F.max(millis("ts")).alias("ingested_at")
    )


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of sessions: a user's views read, clicks edit and purchases write the file of the event."""
    e = table(spark, sf_dir, "events")
    tool = F.when(F.col("event_type") == "view", "Read").when(F.col("event_type") == "click", "Edit").when(F.col("event_type") == "purchase", "Write")
    path = F.concat(F.lit("src/f"), F.get_json_object("props", "$.k"), F.lit(".py"))
    return e.select(F.col("user_id").cast("string").alias("session_id"), F.col("event_id").alias("pos"), tool.alias("tool"), path.alias("path"), millis("ts").alias("now_ms")).where("tool is not null")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as chained evidence: each turn continues the one before."""
    c = table(spark, sf_dir, "conversations")
    ident = F.col("conv_id") * 1000 + F.col("turn")
    return c.select(ident.alias("id"), F.when(F.col("turn") > 0, ident - 1).alias("prev_evidence_id"), F.col("text").alias("content"))


def agent_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as agent logs: a JSON line per turn, blocks for the assistant, a meta line first."""
    c = table(spark, sf_dir, "conversations")
    plain = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.col("text").alias("content")).alias("message")))
    blocks = F.to_json(F.struct(F.col("role").alias("type"), F.struct(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("tool_use").alias("type"), F.lit("").alias("text"))).alias("content")).alias("message")))
    line = F.when(F.col("role") == "assistant", blocks).otherwise(plain)
    lines = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    meta = '{"type": "user", "isMeta": true, "message": {"content": "caveat"}}\nnot json\n\n'
    return c.groupBy("conv_id").agg(F.concat(F.lit(meta), F.array_join(F.transform(lines, lambda x: x["line"]), "\n")).alias("text"))
