"""Reads and small writes of the tables."""

import pytest
from pyspark.sql import functions as F

from recollect.operators import readers, tables
from tests.test_operators import events


def store(spark):
    rows = [
        {"description": "Use Kafka for event transport", "weight": 2.0, "decision_key": None},
        {"description": "b", "superseded_by": 1, "session_id": "s2"},
        {"description": "c", "archived": True},
        {"description": "d", "event_type": "THREAD_OPEN", "weight": 3.0, "decision_key": None},
        {"description": "e", "project_id": "q"},
    ]
    return events(spark, rows)


def ids(df):
    return [r.id for r in df.collect()]


def test_reads(spark):
    e = store(spark)
    assert ids(readers.since(e, 1)) == [4, 5] and ids(readers.of_session(e, "p", "s2")) == [2]
    assert ids(readers.of_type(e, "p", "DECISION")) == [1, 2] and ids(readers.of_type(e, "p", "DECISION", True)) == [1, 2, 3]
    assert sorted(ids(readers.heaviest(e, 1, ("project_id",)))) == [4, 5]
    assert {(r.project_id, r.active, len(r.uris)) for r in readers.projects(e).collect()} == {("p", 2, 6), ("q", 1, 6)}
    assert {r.id: r.decision_key for r in readers.with_keys(e).collect()}[1] == "event transport"
    assert {r.id: r.decision_key for r in readers.with_keys(e).collect()}[4] == ""


def test_marks_and_removal(spark):
    e = store(spark)
    changes = spark.createDataFrame([(1, 9, None, -4.0), (3, None, False, None)], "id long, superseded_by long, archived boolean, weight double")
    got = {r.id: (r.superseded_by, r.archived, r.weight) for r in readers.marked(e, changes).collect()}
    assert got[1] == (9, False, 0.0) and got[3] == (None, False, 1.0) and got[2] == (1, False, 1.0)
    assert ids(readers.without(e, spark.createDataFrame([("p",)], "project_id string"))) == [5]


def test_scan_states_are_checked(spark):
    schema = "project_id string, path string, freshness string, scan_status string, symbol_count int, refreshed_at long, last_error string"
    good = spark.createDataFrame([("p", "a.py", "fresh", "scanned", 1, 1, ""), ("p", "b.py", "stale", "parse_error", 0, 1, "bad")], schema)
    assert {r.last_error for r in readers.validated_files(good).collect()} == {"", "bad"}
    for row in (("p", "c.py", "fresh", "parse_error", 0, 1, ""), ("p", "c.py", "odd", "scanned", 0, 1, "")):
        with pytest.raises(Exception, match="bad scan state"):
            readers.validated_files(spark.createDataFrame([row], schema)).collect()


def test_search_cache(spark):
    asked = spark.createDataFrame([("p", "def", "src", ""), ("p", "x", "", "")], "project_id string, pattern string, path string, glob string")
    from recollect.functions.text import cache_key

    cache = asked.where("pattern = 'def'").select("project_id", cache_key(F.col("pattern"), F.col("path"), F.col("glob")).alias("cache_key"), F.lit("hit").alias("result_text"), F.lit(10).cast("long").alias("cached_at"), F.lit(1).cast("long").alias("hit_count"))
    found = readers.cached_searches(cache, asked, F.lit(20))
    assert [r.result_text for r in found.collect()] == ["hit"]
    assert [r.hit_count for r in readers.counted_searches(cache, found).collect()] == [2]
    assert readers.cached_searches(cache, asked, F.lit(10 + readers.CACHE_TTL_MS + 1)).count() == 0
    assert tables.expired(cache, "cached_at", F.lit(1000), 10).count() == 0
