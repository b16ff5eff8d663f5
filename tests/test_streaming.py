"""Streams: cursors over growing logs, and a sink that merges each batch once."""

from pyspark.sql import functions as F

from recollect.schemas import EVENTS
from recollect.streaming.ingest import MemorySink, slices, windowed_activity
from tests.test_operators import BATCH, STATE, events, outcome


def test_slices_of_growing_logs(spark, tmp_path):
    source, checkpoint = tmp_path / "in", tmp_path / "checkpoint"
    source.mkdir()
    grown = ["\n".join(f"l{k}" for k in range(n)) for n in (3, 30, 30, 2)]
    for text in grown:
        spark.createDataFrame([("p", "s", text)], "project_id string, session_id string, text string").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("project_id string, session_id string, text string").json(str(source))
        query = slices(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r.is_delta, r.new_line_count): (len(r.stored.split("\n")), len(r.extracted.split("\n"))) for r in rows}
    # first whole, then what is new (with overlap), nothing for the same log again, whole where it shrank
    assert got == {(False, 3): (3, 3), (True, 30): (27, 30), (False, 2): (2, 2)} and len(rows) == 3


def test_sink_merges_once(spark, tmp_path):
    sink = MemorySink(str(tmp_path / "state"), EVENTS)
    state, batch = events(spark, STATE), events(spark, [b | {"session_id": "s9"} for b in BATCH])
    sink(state, 0)
    first = outcome(sink.current(spark))
    assert set(first) == {1, 2, 3, 4, 5}
    sink(batch, 1)
    merged = outcome(sink.current(spark))
    sink(batch, 1)  # the same batch again
    sink(batch, 2)  # its evidence again
    assert outcome(sink.current(spark)) == merged and merged[1][2] == 101


def test_windows_agree_in_batch(spark):
    rows = [(k, f"2024-01-01 0{k % 3}:10:00", "view" if k % 2 else "click", 1.0) for k in range(12)]
    df = spark.createDataFrame(rows, "user_id int, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    assert {(r.n, r.value) for r in windowed_activity(df).collect()} == {(2, 2.0)}
