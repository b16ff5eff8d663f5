"""The surface end to end: evidence to events, memory, recall, and the block."""

from pyspark.sql.functions import pandas_udf

from recollect.operators import extract, heads, segment
from recollect.plans import memory
from recollect.plans.checkpoints import cut

FIRST = "User: Invoices must never be emailed without encryption. Use Postgres for reports.\nAssistant: We decided on nightly exports because partners ask for them."
SECOND = "User: Use ClickHouse for reports. We ruled out polling the partner API."


def evidence(spark):
    rows = [(1, "p", "s1", "transcript", 10, FIRST, "a", None), (2, "p", "s2", "transcript", 20, SECOND, "b", None)]
    return spark.createDataFrame(rows, "id long, project_id string, session_id string, source_type string, captured_at long, content string, content_sha256 string, prev_evidence_id long")


def test_rebuild_recall_and_render(spark):
    lexicon = extract.signals(spark)
    built = cut(memory.rebuilt(evidence(spark), lexicon))
    said = {r.description: r for r in built.collect()}
    assert said["Use Postgres for reports."].superseded_by == said["Use ClickHouse for reports."].id
    assert any(r.event_type == "CONSTRAINT_HARD" and "Invoices" in d for d, r in said.items())
    asked = spark.createDataFrame([(1, "how are reports stored"), (2, "polling partner")], "query_id int, text string")
    hits = memory.recall(built, asked, 3).collect()
    assert any(r.query_id == 1 and "ClickHouse" in r.description for r in hits) and not any("Postgres" in r.description for r in hits)
    edit = spark.createDataFrame([(7, "def send(): email invoices without encryption")], "query_id int, text string")
    assert ["Invoices" in r.description for r in memory.prohibited(built, edit).collect()] == [True]
    block = memory.rendered(built, spark.createDataFrame([("p", "## Head")], "project_id string, header string")).first().block
    assert "never be emailed" in block and "Use ClickHouse for reports." in block.split("### Key decisions")[1]
    assert not any(line.split(". ", 1)[-1].startswith("Use Postgres") for line in block.split("\n"))


def test_heads(spark):
    @pandas_udf("label string, confidence double")
    def head(texts):
        import pandas as pd

        return pd.DataFrame({"label": ["CONSTRAINT_HARD" if "must" in t else "THREAD" if "billing" in t else "NOISE" for t in texts], "confidence": [0.9] * len(texts)})

    said = "User: Orders must stay encrypted at rest always. The billing work is finished and merged now. Nothing of note was said today.\nRetry limit: 3 attempts per call"
    sentences = segment.segment(spark.createDataFrame([("s", said)], "session_id string, transcript string"))
    got = {r.event_type: (r.weight, r.description) for r in heads.sentence_events(sentences, head).collect()}
    assert set(got) == {"CONSTRAINT_HARD", "THREAD_CLOSE", "DECISION"} and got["DECISION"] == (0.45, "Retry limit: 3 attempts per call.")
    events = spark.createDataFrame([("Orders must only hold.", "DECISION", 1.0), ("chatter", "DECISION", 1.0)], "description string, event_type string, weight double")
    assert [r.event_type for r in heads.retyped(events, head).collect()] == ["CONSTRAINT_HARD"]


def test_rollouts_and_value_changes(spark):
    headers = spark.createDataFrame([("s1", "/mnt/c/Work/App"), ("s2", "/else")], "session_id string, cwd string")
    projects = spark.createDataFrame([("p", "C:\\Work\\App\\")], "project_id string, project_path string")
    assert [(r.session_id, r.project_id) for r in memory.rollouts_of(headers, projects).collect()] == [("s1", "p")]
    rows = [(1, "DECISION", "Retry budget is 3 attempts with backoff", 2), (2, "DECISION", "Timeout for upstream calls became 45 seconds", None)]
    changes = memory.value_changes(spark.createDataFrame(rows, "id long, event_type string, description string, superseded_by long"))
    assert [(r.old_id, r.id) for r in changes.collect()] == [(1, 2)]
