"""Schemas of the memory tables.  Times are epoch milliseconds, so comparisons are exact."""

from __future__ import annotations

EVENT_TYPES = (
    "CONSTRAINT_HARD",
    "CONSTRAINT_SOFT",
    "DECISION",
    "APPROACH_ABANDONED",
    "APPROACH_ABANDONED_DO_NOT_RETRY",
    "COMPONENT_STATUS",
    "THREAD_OPEN",
    "THREAD_CLOSE",
)
#: Types that compete as values of one topic, and those that may supersede each other.
CHOICE_FAMILY = ("CONSTRAINT_HARD", "CONSTRAINT_SOFT", "DECISION")
SUPERSESSION_TYPES = (*CHOICE_FAMILY, "APPROACH_ABANDONED", "APPROACH_ABANDONED_DO_NOT_RETRY")

PAYLOAD = (
    "struct<description string, rationale string, subject string, authority string, confidence double, source_role string, "
    "matched_phrase string, provenance string, affected_files array<string>, path string, status string, intent string, "
    "dependencies array<string>, cascaded_from long, reason string, triple struct<operator string, subject string, object string>>"
)
EVENTS = (
    "id long, project_id string, session_id string, created_at long, event_type string, description string, rationale string, "
    "subject string, authority string, path string, status string, intent string, affected_files array<string>, dependencies array<string>, "
    "content_hash string, weight double, mention_count long, superseded_by long, archived boolean, evidence_id long, decision_key string"
)
EVIDENCE = "id long, project_id string, session_id string, source_type string, captured_at long, content string, content_sha256 string, prev_evidence_id long"
EDGES = "project_id string, from_path string, to_path string, edge_type string, is_external boolean"
NODES = "project_id string, path string, node_type string, name string, parent_name string, signature string, return_type string, fields string"
FILES = "project_id string, path string, freshness string, scan_status string, symbol_count int, refreshed_at long, last_error string"
CURSORS = "project_id string, session_id string, last_line_count long, anchor_sha256 string"
LEDGER = "project_id string, session_id string, event_id long, channel string, rendered_at long"
USAGE = "project_id string, session_id string, input_tokens long, cache_creation_tokens long, cache_read_tokens long, output_tokens long, ingested_at long"
JOBS = "id long, project_id string, session_id string, evidence_id long, category string, stage string, state string, attempts int, max_attempts int, failure_class string, updated_at long, worker long"
