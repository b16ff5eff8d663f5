"""Extraction with a learned classifier of sentences, where one is at hand.

A head is a function from a text column to a struct (label, confidence): a pandas UDF around
any model.  No model comes with this library; without a head, extraction goes by lexicon and
patterns alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import sanitize
from recollect.functions import statements as st
from recollect.functions.text import content_hash, head_input, normalise_description

# Fixed values.
LEAST_WORDS, FACT_CONFIDENCE, META_WEIGHT, ASIDE_WEIGHT = 4, 0.45, 0.15, 0.4
VALUE = r"(?i)\d|\btrue\b|\bfalse\b|\benabled\b|\bdisabled\b|\bnone\b|\balways\b|\bnever\b"
MEMORY_TALK = (
    r"(?i)\b(session[- ]context|injection block|injected (?:session )?context|stop hook|graveyard|pending confirmation|memory confirms|recorded in memory|"
    r"from memory|the recall (?:surfaces|surfaced|returns|returned|results|mentions|shows|tool)|resume directly|do not acknowledge the summary|"
    r"do not recap what was happening|continue the conversation from where it left off|approach_abandoned\w*|constraint_hard|constraint_soft|thread_open|"
    r"component_status|(?:now|explicitly) superseded|rejection is superseded|superseded abandoned|memory (?:shows|says)|recorded decision|decision to record|"
    r"decision log|locked in the project memory|prior decision being overridden|entry recording|call recall\b|missing from the block)\b"
)
CLOSES = r"(?i)\b(?:finished|completed|implemented|merged|shipped|done|resolved|closed|fixed)\b"

Head = Callable[[Column], Column]


def _typed(label: Column, description: Column) -> Column:
    """A head's label as an event type: threads opened or closed by their verb, asides never hard."""
    kind = F.when(label == "THREAD", F.when(description.rlike(CLOSES), "THREAD_CLOSE").otherwise("THREAD_OPEN")).otherwise(label)
    return F.when((kind == "CONSTRAINT_HARD") & st.is_fragment(description), "CONSTRAINT_SOFT").otherwise(kind)


def _discount(description: Column) -> Column:
    return F.when(description.rlike(MEMORY_TALK), META_WEIGHT).otherwise(1.0) * F.when(st.is_fragment(description), ASIDE_WEIGHT).otherwise(1.0)


def sentence_events(sentences: DataFrame, head: Head, keys: tuple[str, ...] = ("session_id",), with_context: bool = False) -> DataFrame:
    """Every sentence of prose that the head doesn't call noise, typed by it; label lines with a value pass as facts."""
    s = sentences.where(~F.col("is_code") & (F.trim("text") != "") & ~st.is_structural_label(F.col("text")))
    s = s.withColumn("said", sanitize.description(F.trim("text"))).where((F.col("said") != "") & (st.content_words(F.col("said")) >= LEAST_WORDS))
    before = F.lag("said").over(Window.partitionBy(*keys).orderBy("idx"))
    s = s.withColumn("asked", head_input(F.col("said"), F.col("role"), before) if with_context else F.col("said"))
    s = s.withColumn("h", head(F.col("asked")))
    noise = F.col("h.label") == "NOISE"
    fact = noise & st.is_label_value(F.col("said")) & F.col("said").rlike(VALUE)
    s = s.where(~noise | fact).withColumn("label", F.when(fact, "DECISION").otherwise(F.col("h.label"))).withColumn("confidence", F.when(fact, FACT_CONFIDENCE).otherwise(F.col("h.confidence")))
    s = s.withColumn("description", normalise_description(F.col("said"))).where("description <> ''")
    s = s.withColumn("event_type", _typed(F.col("label"), F.col("description"))).withColumn("content_hash", content_hash(F.col("event_type"), F.col("description")))
    rest = ["idx", "event_type", "description", "confidence", "role"]
    first = s.groupBy(*keys, "content_hash").agg(F.min_by(F.struct(*rest), "idx").alias("e")).select(*keys, "content_hash", "e.*")
    return first.select(
        *keys, "idx", "content_hash", "event_type", "description", "confidence", F.col("role").alias("source_role"), st.role_authority(F.col("role")).alias("authority"),
        F.lit("HEAD").alias("matched_phrase"), (F.col("confidence") * _discount(F.col("description"))).alias("weight"), st.triple(F.col("event_type"), F.col("description")).alias("triple"),
    )


def retyped(events: DataFrame, head: Head) -> DataFrame:
    """Events of lexicon and patterns that the head doesn't call noise, with its type and confidence."""
    e = events.withColumn("h", head(F.col("description"))).where(F.col("h.label") != "NOISE")
    e = e.withColumn("event_type", _typed(F.col("h.label"), F.col("description"))).withColumn("confidence", F.col("h.confidence"))
    return e.withColumn("weight", F.col("weight") * _discount(F.col("description"))).withColumn("content_hash", content_hash(F.col("event_type"), F.col("description"))).drop("h")
