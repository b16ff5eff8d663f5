"""Ranking weights of events: base x recency x repetition x centrality x activity x type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BASE_WEIGHT = {
    "CONSTRAINT_HARD": 1.0, "APPROACH_ABANDONED_DO_NOT_RETRY": 1.0, "DECISION": 0.7, "CONSTRAINT_SOFT": 0.5,
    "COMPONENT_STATUS": 0.4, "APPROACH_ABANDONED": 0.4, "THREAD_OPEN": 0.6, "THREAD_CLOSE": 0.2,
}
TYPE_MULTIPLIER = {
    "CONSTRAINT_HARD": 1.5, "APPROACH_ABANDONED_DO_NOT_RETRY": 1.4, "DECISION": 1.0, "CONSTRAINT_SOFT": 0.9,
    "COMPONENT_STATUS": 1.1, "APPROACH_ABANDONED": 0.7, "THREAD_OPEN": 1.2, "THREAD_CLOSE": 0.4,
}
ACTIVITY = {"in_flux": 2.0, "blocked": 1.8, "needs_review": 1.5, "new": 1.4, "stable": 0.7, "complete": 0.5, "abandoned": 0.3, "unknown": 1.0}
AUTHORITY = {"user_stated": 3, "assistant_decided": 2, "llm": 2, "assistant_answer_to_user_question": 1, "inferred_from_code": 0}
AUTHORITY_DEFAULT = 2
RECENCY = 0.15
REPETITION = 0.3


def lookup(c: Column, table: dict, default) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(pairs[c], F.lit(default))


def authority_rank(c: Column) -> Column:
    return lookup(F.coalesce(c, F.lit("")), AUTHORITY, AUTHORITY_DEFAULT)


def recency_factor(sessions_since: Column, alpha: float = RECENCY) -> Column:
    return 1.0 / (1.0 + F.lit(alpha) * F.greatest(F.lit(0), sessions_since))


def repetition_factor(mentions: Column) -> Column:
    return 1.0 + F.lit(REPETITION) * F.log(F.greatest(F.lit(1), mentions).cast("double"))


def activity_factor(statuses: Column) -> Column:
    """The largest boost among the statuses of an event's files; 1 without files."""
    boosts = F.transform(statuses, lambda s: lookup(F.coalesce(s, F.lit("unknown")), ACTIVITY, 1.0))
    return F.coalesce(F.array_max(boosts), F.lit(1.0))


def centrality_factor(best: Column, largest: Column) -> Column:
    """0.5 to 1.5 by the most central of an event's files; null or no graph: 1."""
    return F.when(best.isNull() | largest.isNull() | (largest == 0), 1.0).otherwise(0.5 + best / largest)


def composite(event_type: Column, sessions_since: Column, mentions: Column, centrality: Column, activity: Column) -> Column:
    return (
        lookup(event_type, BASE_WEIGHT, 0.5)
        * recency_factor(sessions_since)
        * repetition_factor(mentions)
        * centrality
        * activity
        * lookup(event_type, TYPE_MULTIPLIER, 1.0)
    )
