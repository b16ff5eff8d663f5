"""Operators on small fixtures, against plain Python where that is short."""

import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from recollect.functions import text
from recollect.functions.similarity import jaccard
from recollect.functions.weights import authority_rank
from recollect.operators import budget, extract, graph, merge, policies, project, retrieve, segment, similar, symbols, tables, telemetry
from recollect.schemas import CHOICE_FAMILY, EVENTS, SUPERSESSION_TYPES
from recollect.sources import diffs, transcripts

NAMES = [p.split()[0] for p in EVENTS.split(", ")]


def events(spark, rows):
    base = {
        "project_id": "p", "session_id": "s1", "created_at": 1, "event_type": "DECISION", "description": "", "rationale": "", "subject": "", "authority": "user_stated", "path": "", "status": "",
        "intent": "", "affected_files": [], "dependencies": [], "weight": 1.0, "mention_count": 1, "superseded_by": None, "archived": False, "evidence_id": None, "decision_key": "",
    }
    made = []
    for k, r in enumerate(rows):
        e = base | {"id": k + 1} | r
        e["content_hash"] = r.get("content_hash") or hashlib.sha256((e["event_type"] + e["description"]).encode()).hexdigest()
        made.append(tuple(e[n] for n in NAMES))
    return spark.createDataFrame(made, EVENTS)


# --- sources


def test_agent_and_rollout_logs(spark):
    agent = [
        {"type": "user", "message": {"content": " hello "}},
        {"type": "assistant", "message": {"content": [{"type": "text", "text": "a"}, {"type": "tool_use", "text": "x"}, {"type": "text", "text": " b "}]}},
        {"type": "user", "isMeta": True, "message": {"content": "meta"}},
        {"type": "assistant", "message": {"content": "not blocks"}},
        {"type": "user", "message": {"content": [{"type": "tool_result", "text": "r"}]}},
    ]
    rollout = [
        {"type": "session_meta", "payload": {"id": "r1", "cwd": "/w"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment_context> x"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "do it"}},
        {"type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]}},
        {"type": "event_msg", "payload": {"type": "agent_message", "message": "done"}},
    ]
    text = lambda lines: "\n".join(json.dumps(x) for x in lines) + "\n{broken\n\n"
    rows = [(1, "jsonl_transcript", text(agent)), (2, "codex_rollout", text(rollout)), (3, "transcript", "User: as is")]
    df = spark.createDataFrame(rows, "id long, source_type string, content string")
    got = {r.id: r.transcript for r in transcripts.evidence_transcripts(df).collect()}
    assert got == {1: "User:\nhello\n\nAssistant:\na\nb", 2: "User:\ndo it\n\nAssistant:\ndone", 3: "User: as is"}
    lines = transcripts.log_lines(df.where("id = 2").select(F.lit("s").alias("session_id"), F.col("content").alias("text")))
    assert transcripts.session_header(lines).first().cwd == "/w"


def test_read_logs_usage_and_tool_calls(spark, tmp_path):
    use = lambda name, **i: {"type": "tool_use", "name": name, "input": i}
    lines = [
        {"type": "assistant", "cwd": "/w", "message": {"content": [use("Read", file_path="/w/a.py"), use("Edit", file_path="a.py"), use("Bash", command="ls")], "usage": {"input_tokens": 5, "cache_read_input_tokens": 7}}},
        {"type": "assistant", "cwd": "/w", "message": {"content": [use("Write", file_path="b.py"), use("NotebookEdit", notebook_path="n.ipynb")], "usage": {"input_tokens": 2, "output_tokens": 3}}},
    ]
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "s9.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    rows = transcripts.read_logs(spark, str(tmp_path))
    total = transcripts.usage(rows).first()
    assert (total.session_id, total.input_tokens, total.cache_read_tokens, total.output_tokens, total.cache_creation_tokens) == ("s9", 7, 7, 3, 0)
    report = telemetry.unread_changes(telemetry.canonical_calls(transcripts.tool_calls(rows))).first()
    assert (report.modifications, report.unread_modifications, report.edits_without_read, report.first_writes, report.reads, report.files_modified) == (3, 2, 1, 1, 1, 3)


def test_evidence_chains(spark):
    rows = [(1, None, "a\n"), (2, 1, "b"), (3, 2, "c\n"), (4, 3, "d"), (9, None, "alone")]
    df = spark.createDataFrame(rows, "id long, prev_evidence_id long, content string")
    got = {r.leaf_id: (r.n_links, r.content) for r in transcripts.evidence_chains(df).collect()}
    assert got == {4: (4, "a\nb\nc\nd"), 9: (1, "alone")}
    with pytest.raises(ValueError, match="missing"):
        transcripts.evidence_chains(spark.createDataFrame([(2, 1, "b")], "id long, prev_evidence_id long, content string"))
    with pytest.raises(ValueError, match="cycle"):
        transcripts.evidence_chains(spark.createDataFrame([(1, 2, "a"), (2, 1, "b")], "id long, prev_evidence_id long, content string"))


def test_diffs(spark):
    diff = "M\tsrc/a.py\nA\tsrc/services/b.py\nR090\told/c.py\tsrc/c.py\nD\tgone.py\n src/a.py | 12 ++++--\n src/c.py | 3 +++\n"
    changes = diffs.file_changes(spark.createDataFrame([("s", diff)], "session_id string, diff string"))
    got = {r.path: (r.change_type, r.old_path, r.lines_changed) for r in changes.collect()}
    assert got == {"src/a.py": ("modified", "", 6), "src/services/b.py": ("added", "", 0), "src/c.py": ("renamed", "old/c.py", 3), "gone.py": ("deleted", "", 0)}
    e = {r.path: r for r in diffs.change_events(changes).collect()}
    assert e["src/a.py"].weight == pytest.approx(0.53) and e["src/services/b.py"].intent == "service layer"
    old = spark.createDataFrame([("s", "APPROACH_ABANDONED", "we dropped services", 1.9), ("s", "DECISION", "services", 1.0)], "session_id string, event_type string, description string, weight double")
    assert sorted(r.weight for r in diffs.corroborated(old, changes).collect()) == [1.0, 2.0]


# --- extraction


def test_segments_of_the_end_of_a_text(spark):
    """Cut inside a character, whose bytes then stand as U+FFFD; whole where nothing is asked."""
    df = spark.createDataFrame([("s", "First words. " + "\u20ac" * 10 + " End.")], "session_id string, transcript string")
    assert [r.text for r in segment.segment(df, most_bytes=9).collect()] == ["\ufffd\u20ac End."]
    assert segment.segment(df).first().text == "First words. " + "\u20ac" * 10 + " End."


def test_segments(spark):
    said = (
        "Intro line. Second one.\nAssistant: We agreed, e.g. on this. Fine!\n- first item\n- second item\nPort: 8080\n"
        "```sql\nCREATE TABLE users (\n  id uuid primary key,\n  price numeric,\n  created_at timestamptz\n);\n```\nUser:\nwrapped\nline here. Next?"
    )
    rows = segment.segment(spark.createDataFrame([("s", said), ("none", None)], "session_id string, transcript string")).orderBy("idx").collect()
    assert [(r.role, r.text if not r.is_code else "CODE", r.list_group) for r in rows] == [
        ("user", "Intro line.", -1), ("user", "Second one.", -1), ("assistant", "We agreed, e.g. on this.", -1), ("assistant", "Fine!", -1), ("assistant", "first item", 1), ("assistant", "second item", 1),
        ("assistant", "Port: 8080", -1), ("assistant", "CODE", -1), ("user", "wrapped line here.", -1), ("user", "Next?", -1),
    ]
    got = {r.subject: r.description for r in extract.schema_events(spark.createDataFrame(rows)).collect()}
    assert got == {"users primary key type": "Primary key type (users): UUID", "users price money type": "Money column type (users.price): NUMERIC", "users timestamp type": "Timestamp column type (users): TIMESTAMPTZ"}


def test_extraction(spark):
    said = (
        "User: Orders must never be deleted in production. No Docker, no Kubernetes. Could we avoid cron?\n"
        "Assistant: We decided on soft deletes because audits need history. I updated src/api/orders.py for that.\n"
        "User: Use Postgres for reports. This only matters if the cache is cold and never warms."
    )
    sentences = segment.segment(spark.createDataFrame([("s", said)], "session_id string, transcript string"))
    hits = extract.scan(sentences, extract.signals(spark)).collect()
    assert {(r.idx, r.phrase) for r in hits} >= {(0, "must never"), (0, "never"), (2, "avoid"), (3, "decided")}
    found = extract.extract_session(sentences, extract.signals(spark)).collect()
    kinds = {(r.event_type, r.matched_phrase, r.subject) for r in found}
    assert ("CONSTRAINT_HARD", "NO_MULTI", "Docker") in kinds or ("CONSTRAINT_HARD", "NO_MULTI", "Kubernetes") in kinds
    assert any(r.event_type == "CONSTRAINT_HARD" and r.description == "Orders must never be deleted in production." for r in found)
    assert any(r.event_type == "DECISION" and r.matched_phrase in ("USE_X", "decided") for r in found)
    assert any(r.authority == "assistant_answer_to_user_question" for r in found)
    assert all(r.event_type != "CONSTRAINT_HARD" for r in found if r.description.startswith("This only matters"))
    assert len({r.content_hash for r in found}) == len(found)
    files = extract.file_events(sentences).collect()
    assert [(r.path, r.status, r.weight) for r in files] == [("src/api/orders.py", "modified", 0.6)]
    assert extract.scan(sentences, extract.signals(spark).limit(0)).count() == 0


def test_window_reach(spark):
    rows = [("s", k, "user", t, c, False) for k, (t, c) in enumerate([("a", False), ("it is so because", False), ("one.", False), ("two.", False), ("mid.", False), ("x = 1", True), ("y = 2", True), ("z = 3", True), ("end.", False)])]
    df = spark.createDataFrame(rows, "session_id string, idx int, role string, text string, is_code boolean, list_item boolean")
    around = {r.idx: r.around for r in extract.windows(df).collect()}
    assert around[4] == ["a", "it is so because", "one.", "two.", "x = 1", "y = 2", "z = 3"] and around[8] == ["x = 1", "y = 2", "z = 3"]


# --- merging


def test_insert_events_counts_every_restatement(spark):
    e = events(spark, [{"description": "a", "evidence_id": None}, {"description": "a", "evidence_id": 7}, {"description": "b"}, {"description": "a"}])
    once = tables.insert_events(e.limit(0), e)
    got = {r.description: (r.id, r.mention_count, round(r.weight, 2), r.evidence_id) for r in once.collect()}
    assert got == {"a": (1, 3, 1.3, 7), "b": (3, 1, 1.0, None)}


STATE = [
    {"description": "Use Redis for the session cache", "evidence_id": 1, "session_id": "s0"},
    {"description": "Never use floats for money", "event_type": "CONSTRAINT_HARD", "evidence_id": 1, "session_id": "s0"},
    {"description": "Sessions live in signed cookies only", "evidence_id": 1, "session_id": "s0", "archived": True},
    {"description": "Polling the export queue was too slow for dashboards", "event_type": "APPROACH_ABANDONED", "evidence_id": 1, "session_id": "s0"},
    {"description": "Deploy from main every Friday afternoon", "evidence_id": 1, "session_id": "s0", "authority": "user_stated"},
]
BATCH = [
    {"id": 101, "description": "Use Memcached for the session cache", "evidence_id": 2, "created_at": 5},
    {"id": 102, "description": "Never use floats for money", "event_type": "CONSTRAINT_HARD", "evidence_id": 2, "created_at": 5},
    {"id": 103, "description": "Sessions live in signed cookies only", "evidence_id": 2, "created_at": 5},
    {"id": 104, "description": "Polling the export queue was too slow for our dashboards", "event_type": "APPROACH_ABANDONED_DO_NOT_RETRY", "evidence_id": 2, "created_at": 5},
    {"id": 105, "description": "Deploy from main on every Friday afternoon please", "evidence_id": 2, "created_at": 5, "authority": "inferred_from_code"},
    {"id": 106, "description": "Something else entirely about logging levels", "evidence_id": 2, "created_at": 5},
]


def outcome(df):
    return {r.id: (r.mention_count, round(r.weight, 3), r.superseded_by, r.archived) for r in df.collect()}


def test_merge_as_sets_and_in_order_agree(spark):
    state, batch = events(spark, STATE), events(spark, [b | {"session_id": "s9"} for b in BATCH])
    sets, order = outcome(merge.merge_sets(state, batch)), outcome(merge.merge_in_order(state, batch))
    assert sets == order
    assert sets[1][2] == 101  # one topic, a newer choice
    assert sets[2] == (2, 1.15, None, False)  # said again elsewhere
    assert sets[3][3] is False  # said again: no longer archived
    assert sets[4][2] == 104  # the stronger prohibition stays
    assert 105 not in sets or sets[5][2] is None  # less authority replaces nothing
    again = merge.unmerged(batch, spark.createDataFrame([(2,)], "raw_evidence_id long"))
    assert again.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_merges_agree_on_drawn_batches(spark, seed):
    rng = random.Random(seed)
    words = ["cache", "redis", "orders", "export", "token", "queue", "limit", "audit", "schema", "index", "retry", "panel"]
    say = lambda: " ".join(rng.sample(words, rng.randint(3, 6)))
    kinds = ["DECISION", "CONSTRAINT_HARD", "APPROACH_ABANDONED", "THREAD_OPEN"]
    state = [{"description": say(), "event_type": rng.choice(kinds), "evidence_id": 1, "session_id": "s0", "weight": rng.random()} for _ in range(25)]
    batch, seen = [], []
    for k in range(8):
        d = rng.choice(state)["description"] if rng.random() < 0.3 else say()
        # the sets form asks that candidates of a batch don't restate one another
        if all(len(set(d.split()) & set(x.split())) / len(set(d.split()) | set(x.split())) < 0.3 for x in seen):
            seen.append(d)
            batch.append({"id": 500 + k, "description": d, "event_type": rng.choice(kinds[:2]), "evidence_id": 2, "session_id": "s9", "created_at": 9})
    a, b = events(spark, state), events(spark, batch)
    assert outcome(merge.merge_sets(a, b)) == outcome(merge.merge_in_order(a, b))


def test_similar_pairs_match_brute_force(spark):
    rng = random.Random(4)
    words = ["w%02d" % k for k in range(40)]
    texts = [" ".join(rng.sample(words, rng.randint(1, 14))) for _ in range(80)]
    texts += [t.rsplit(" ", 1)[0] for t in texts[:30] if " " in t] + texts[:5] + ["", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    members, classes = similar.token_classes(df, "id", "text")
    sets = {r.class_id: set(r.tokens) for r in classes.collect()}
    assert len(sets) == len({frozenset(s) for s in sets.values()})
    for least in (0.6, 0.85):
        brute = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least}
        rows = similar.similar_pairs(classes, least).collect()
        assert {(r.a, r.b) for r in rows} == brute and len(rows) == len(brute)
    assert {r.id for r in members.where("class_id is null").collect()} == {len(texts) - 2, len(texts) - 1}
    best = {r.id: round(r.best, 9) for r in similar.best_matches(df, df.where("id < 10").select(F.col("id").alias("item_id"), "text"), 0.6).collect()}
    token = lambda t: {x for x in t.split() if len(x) > 2}
    for k, t in enumerate(texts):
        scores = [len(token(t) & token(u)) / len(token(t) | token(u)) for u in texts[:10] if token(t) | token(u)]
        top = max([s for s in scores if s >= 0.6], default=0.0)
        assert best[k] == round(top, 9)


def test_similar_pairs_of_long_sets_match_brute_force_and_sketches_rule_out_the_rest(spark, monkeypatch):
    rng = random.Random(7)
    words = ["w%05d" % k for k in range(3000)]
    base = [rng.sample(words, rng.choice((100, 300, 900))) for _ in range(12)]
    texts = []
    for text in base:
        texts.append(text)
        for share in (0.02, 0.05, 0.07, 0.08, 0.09, 0.15):
            fresh = iter(rng.sample(words, len(text)))
            texts.append([next(fresh) if rng.random() < share else t for t in text])
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows + [(500 + k, t) for k, t in rows[:9]], "id int, text string")
    sets = [set(t) for t in texts]
    brute = {(a, b) for a in range(len(sets)) for b in range(a) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.85}
    assert len(brute) > 40
    links = {k: sum(k in p for p in brute) for k in range(len(sets))}
    monkeypatch.setattr(similar, "ROUND", 0.7)  # several rounds
    monkeypatch.setattr(similar, "PAIRS_AT_ONCE", 50)
    found = {r.id: (r.class_id, r.n_links) for r in similar.near_duplicates(df, "id", "text", 0.85).collect()}
    assert found == {k: (k, links[k]) for k in links} | {500 + k: (k, links[k]) for k in range(9)}
    _, classes = similar.token_classes(df, "id", "text")
    classes = classes.select(F.col("class_id").cast("long").alias("node"), "tokens")
    met = {(r.x, r.y) for r in similar._candidates(classes, 0.85).collect()}
    assert {(b, a) for a, b in brute} <= met and all(a // 7 == b // 7 for a, b in met if len(sets[a]) < 800)


# --- state and selection


def test_consolidation(spark):
    rows = [
        {"description": "Limit is ten per minute", "decision_key": "limit rate", "created_at": 1, "session_id": "s1"},
        {"description": "Limit is twenty per minute", "decision_key": "limit rate", "created_at": 3, "session_id": "s2", "weight": 2.0},
        {"description": "limit is TEN per minute", "decision_key": "limit rate", "created_at": 2, "session_id": "s3"},
        {"description": "Inferred limits", "decision_key": "limit rate", "created_at": 9, "authority": "inferred_from_code"},
        {"description": "One word about keys", "decision_key": "keys"},
        {"description": "Entirely different matter", "decision_key": "keys", "created_at": 4},
        {"description": "No key"},
    ]
    got = {r.description: r for r in project.consolidated(events(spark, rows)).collect()}
    top = got["Limit is twenty per minute"]
    assert (top.mention_count, top.weight, top.provenance_count) == (4, 2.0, 4)
    assert [x.description for x in top.lineage] == ["limit is TEN per minute", "Inferred limits"]
    assert set(got) == {"Limit is twenty per minute", "One word about keys", "Entirely different matter", "No key"}


def brute_fill(rows, limit):
    used, kept = 0, []
    for weight, ident, cost in sorted(rows, key=lambda r: (-r[0], r[1])):
        if used + cost <= limit:
            kept.append(ident)
            used += cost
    return kept, used


@pytest.mark.parametrize("seed", range(3))
def test_greedy_fill(spark, seed):
    rng = random.Random(seed)
    rows = [{"description": "d" * rng.randint(1, 300), "event_type": rng.choice(["DECISION", "THREAD_OPEN"]), "weight": rng.randint(1, 40) / 8, "authority": "assistant_decided"} for _ in range(120)]
    df = events(spark, rows)
    got = {r.id for r in budget.greedy_fill(df, 300).collect()}
    cost = [max(1, len(f"{r['event_type']} | {r['description']}") // 4) for r in rows]
    assert got == set(brute_fill([(r["weight"], k + 1, cost[k]) for k, r in enumerate(rows)], 300)[0])


def test_greedy_fill_phases(spark):
    rows = [{"event_type": "CONSTRAINT_HARD", "description": "x" * 3000, "weight": 1.0, "authority": "llm"}, {"event_type": "CONSTRAINT_HARD", "description": "y" * 2500, "weight": 2.0, "authority": "llm"}]
    rows += [{"event_type": "COMPONENT_STATUS", "path": f"a/{k % 7}", "description": "c", "weight": float(k), "authority": "llm"} for k in range(14)]
    kept = {(r.id, r.phase) for r in budget.greedy_fill(events(spark, rows), 900).collect()}
    assert (2, "mandatory") in kept and not any(i == 1 for i, _ in kept)  # neither fits: the heavier stays whole
    assert {i for i, p in kept if p == "component"} == {12, 13, 14, 15, 16}


def test_sections_and_block(spark):
    rows = [
        {"event_type": "CONSTRAINT_HARD", "description": "Never log cards", "rationale": "rules"},
        {"event_type": "THREAD_OPEN", "description": "migrate billing", "authority": "assistant_decided"},
        {"event_type": "THREAD_OPEN", "description": "tidy docs", "authority": "user_stated"},
        {"event_type": "CONSTRAINT_SOFT", "description": "Cookies, I think", "authority": "assistant_answer_to_user_question", "subject": "The session"},
        {"event_type": "DECISION", "description": "Session is a cookie", "subject": "session"},
        {"event_type": "COMPONENT_STATUS", "description": "x", "path": "src/a.py", "status": "in_flux", "authority": "inferred_from_code"},
        {"event_type": "APPROACH_ABANDONED_DO_NOT_RETRY", "description": "Polling", "rationale": "slow"},
    ]
    state = project.projection(events(spark, rows))
    block = budget.rendered(project.sections(state), spark.createDataFrame([("p", "## Head")], "project_id string, header string")).first().block
    parts = block.split("\n\n")
    assert parts[0] == "## Head" and parts[1] == "### Hard constraints — never violate\n- Never log cards — rules"
    assert parts[2] == "### Active thread\nWorking on: tidy docs" and "Pending" not in block and "- Polling -> slow" in block
    assert parts[-1] == "### Summary\nPython project. Currently tidy docs. Do not ship until src/a.py is stable."
    tokens = {r.section: r.tokens for r in telemetry.section_tokens(spark.createDataFrame([("p", block)], "project_id string, block string")).collect()}
    assert tokens["Active thread"] >= 5 and set(tokens) >= {"Head", "Summary", "Key decisions"}
    caps = budget.section_caps({"decisions": 150, "hot": 1}, 750)
    assert caps == {"decisions": 75, "hot": 1}


def test_component_states_and_hot_files(spark):
    rows = [{"event_type": "COMPONENT_STATUS", "path": p, "status": s, "mention_count": 2, "weight": w, "intent": i} for p, s, w, i in [("./a/b.py", "new", 3.0, ""), ("a/b.py", "stable", 1.0, "tests"), ("b.py", "new", 1.0, "x")]]
    got = project.component_states(events(spark, rows)).collect()
    assert [(r.path, r.status, r.mention_count, r.weight) for r in got] == [("a/b.py", "stable", 4, 3.0)]
    assert {(r.path, r.mentions, r.intent) for r in project.hot_files(events(spark, rows)).collect()} == {("./a/b.py", 2, ""), ("a/b.py", 2, "tests"), ("b.py", 2, "x")}


# --- retrieval


def test_gates_and_budget(spark):
    rows = [
        (1, 10, 1, 1, 0.7, 1, "billing retries queue", "retries queue limits"),
        (1, 11, 6, 2, 0.9, 2, "billing retries queue", "billing queue"),
        (2, 12, None, 1, None, 1, "alpha beta gamma delta", "alpha beta gamma omega sigma"),
        (2, 13, None, 3, None, 2, "alpha beta gamma delta", "alpha beta gamma"),
        (3, 14, 1, None, 0.61, 1, "one thing", "unlike"),
        (3, 15, 2, None, 0.5, 2, "one thing", "unlike"),
    ]
    hits = spark.createDataFrame(rows, "query_id int, id int, dense_rank int, bm25_rank int, cosine double, rank int, prompt string, description string")
    assert {r.id for r in retrieve.evidence_gate(hits).collect()} == {10, 12, 14}
    assert {r.id for r in retrieve.without_echoes(hits).collect()} == {10, 12, 14, 15}
    lines = spark.createDataFrame([(1, 1, "x" * 10), (1, 2, "y" * 30), (1, 3, "z")], "query_id int, rank int, line string")
    assert [r.rank for r in retrieve.within_budget(lines, 40, 5).collect()] == [1]


def test_prohibitions(spark):
    rows = [
        (1, 1, "CONSTRAINT_HARD", "save amount as float value column", "", "Never save amount values as float", "user_stated", None),
        (1, 2, "CONSTRAINT_HARD", "save amount as float value column", "", "Amounts are float value columns saved", "user_stated", None),
        (1, 3, "APPROACH_ABANDONED_DO_NOT_RETRY", "save amount as float value column", "", "float amount columns across workers", "llm", None),
        (1, 4, "APPROACH_ABANDONED_DO_NOT_RETRY", "save amount as float value column", "", "unrelated amount", "llm", 0.7),
    ]
    hits = spark.createDataFrame(rows, "query_id int, id int, event_type string, diff string, subject string, description string, authority string, cosine double")
    assert [r.id for r in retrieve.prohibitions(hits, most=4).orderBy("rank").collect()] == [1, 3, 4]


def test_related_and_fusion(spark):
    seeds = spark.createDataFrame([(1, 1, ["a.py"])], "query_id int, id int, files array<string>")
    all_events = spark.createDataFrame([(1, ["a.py"]), (2, ["b.py"]), (3, ["z.py"]), (4, ["c.py"])], "id int, files array<string>")
    edges = spark.createDataFrame([("p", "a.py", "b.py", False), ("p", "c.py", "a.py", False), ("p", "a.py", "lib", True)], "project_id string, from_path string, to_path string, is_external boolean")
    close = spark.createDataFrame([(1, 3, 0.9), (1, 2, 0.65), (1, 4, 0.1)], "query_id int, id int, score double")
    got = {r.id: (r.score, r.why) for r in retrieve.related(all_events, seeds, close, edges).collect()}
    assert got == {3: (0.9, "semantic"), 2: (0.75, "semantic+structural"), 4: (0.5, "structural")}
    d = spark.createDataFrame([(1, 5, 1, 0.9), (1, 6, 2, 0.8)], "query_id int, id int, rank int, score double")
    b = spark.createDataFrame([(1, 6, 1, 3.0)], "query_id int, id int, rank int, score double")
    assert [(r.id, r.score) for r in retrieve.fuse(d, b, 8).orderBy("rank").collect()] == [(6, round((1 / 62 + 1 / 61) / (2 / 61), 4)), (5, 0.5)]
    only = retrieve.fuse(d, b.limit(0), 8).orderBy("rank").collect()
    assert [r.id for r in only] == [5, 6]


# --- graphs and symbols


def test_centrality_matches_plain_iteration(spark):
    links = [("a", "b"), ("a", "b"), ("a", "c"), ("b", "c"), ("d", "a")]
    df = spark.createDataFrame([("p", *x) for x in links], "project_id string, from_path string, to_path string")
    nodes = sorted({n for x in links for n in x})
    rank = dict.fromkeys(nodes, 1 / 4)
    for _ in range(20):
        new = dict.fromkeys(nodes, 0.15 / 4)
        for s, t in links:
            new[t] += 0.85 * rank[s] / sum(x[0] == s for x in links)
        rank = new
    got = {r.path: r.centrality for r in graph.centrality(df).collect()}
    assert got == pytest.approx(rank)


def test_components_of_a_long_chain(spark):
    links = [(k, k + 1) for k in range(60)] + [(100, 101)]
    rng = random.Random(1)
    rng.shuffle(links)
    got = {r.node: r.label for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def test_cascade(spark):
    parts = events(spark, [{"event_type": "COMPONENT_STATUS", "path": "b.py", "dependencies": ["a.py", "a.py"]}, {"event_type": "COMPONENT_STATUS", "path": "c.py", "dependencies": ["z.py"]}, {"event_type": "COMPONENT_STATUS", "path": "a.py", "dependencies": ["a.py"]}])
    rows = [(9, "p", "s", "a.py", "blocked", None, 3), (10, "p", "s", "z.py", "blocked", 9, 3), (11, "p", "s", "z.py", "stable", None, 3)]
    status = spark.createDataFrame(rows, "id long, project_id string, session_id string, path string, status string, cascaded_from long, evidence_id long")
    assert [(r.path, r.cascaded_from, r.reason) for r in graph.cascade(status, parts).collect()] == [("b.py", 9, "depends on a.py which is blocked")]


def test_symbols(spark):
    nodes, modules, ok = symbols.python_symbols("import os, a.b\nfrom .x import y\nfrom c import d\nclass A(B, C):\n    n: int = 1\n    def __init__(self, z: str):\n        self.z = z\n    async def go(self, k: int = 2, *, w) -> 'A':\n        pass\n@app.post('/x', response_model=M)\ndef f(q):\n    pass\n")
    assert ok and modules == ["os", "a.b", "x", "c"]
    assert nodes == [("class", "A", "", "B", "", "n:int, z"), ("method", "go", "A", "(k:int, w)", "'A'", ""), ("function", "f", "", "(q)", "M", "POST /x")]
    # types as they are written, and only where they are; a route has a path and one of five verbs
    source = "class D:\n    def __init__(self, a: int):\n        self.m: Dict[str, int] = {}\n        if a:\n            self.later = a\n        self.m = {}\n@app.options('/o')\ndef g(x: Dict[str, int]): pass\n@app.get()\n@app.GET(prefix + '/h')\ndef h(): pass\n"
    assert symbols.python_symbols(source)[0] == [("class", "D", "", "", "", "m:Dict[str, int]"), ("function", "g", "", "(x:Dict[str, int])", "", ""), ("function", "h", "", "()", "", "GET prefix + '/h'")]
    assert symbols.python_symbols("def (") == ([], [], False)
    sources = spark.createDataFrame([("p", "a/m.py", "import b.n\nimport gone.x\n"), ("p", "src/b/n.py", ""), ("p", "node_modules/q.js", ""), ("p", "w/i.ts", "import x from '../w/k'\n"), ("p", "w/k.ts", "")], "project_id string, path string, source string")
    files = symbols.project_files(sources)
    assert "node_modules/q.js" not in {r.path for r in files.collect()}
    assert [r.path for r in symbols.project_files(sources, most=1).collect()] == ["a/m.py"] and files.count() == 4
    scanned = symbols.scan_sources(files)
    edges = {(r.from_path, r.to_path, r.is_external) for r in graph.resolve_imports(symbols.imports_of(scanned), sources).unionByName(symbols.script_edges(scanned, sources)).collect()}
    assert edges == {("a/m.py", "src/b/n.py", False), ("a/m.py", "gone.x", True), ("w/i.ts", "w/k.ts", False)}


# --- policies


def test_job_life(spark):
    schema = "id long, project_id string, category string, stage string, state string, attempts int, max_attempts int, failure_class string, updated_at long, worker long"
    jobs = spark.createDataFrame([(k, "p", "c", "OBSERVED", s, a, 3, None, t, w) for k, s, a, t, w in [(1, "queued", 0, 5, None), (2, "queued", 0, 3, None), (3, "running", 2, 0, 7), (4, "claimed", 0, 0, 8), (5, "completed", 0, 0, None)]], schema)
    assert [r.id for r in policies.next_jobs(jobs).collect()] == [2]
    failed = spark.createDataFrame([(3, "TRANSIENT", 9), (4, "POISON", 9), (5, "TRANSIENT", 9)], "id long, failure_class string, now_ms long")
    assert {r.id: (r.state, r.attempts) for r in policies.after_failure(jobs, failed).collect() if r.id > 2} == {3: ("dead_lettered", 3), 4: ("dead_lettered", 1), 5: ("completed", 0)}
    acks = spark.createDataFrame([(1, "EXTRACTED", 1), (1, "COMPLETED", 2), (5, "EXTRACTED", 3)], "id long, stage string, now_ms long")
    assert {r.id: r.state for r in policies.after_stage(jobs, acks).collect()} == {1: "completed", 2: "queued", 3: "running", 4: "claimed", 5: "completed"}
    swept = policies.recovered(jobs, F.lit(700_000), dead_workers=spark.createDataFrame([(7,)], "worker long"))
    assert {r.id: (r.state, r.failure_class) for r in swept.collect()} == {1: ("queued", None), 2: ("queued", None), 3: ("queued", None), 4: ("queued", None), 5: ("completed", None)}
    dead = policies.after_failure(jobs, failed)
    assert {r.state for r in policies.replayed(dead, spark.createDataFrame([(4,)], "id long")).where("id = 4").collect()} == {"queued"}


def test_cache_invalidation(spark):
    cache = spark.createDataFrame([(1, "p", "", ""), (2, "p", "src", ""), (3, "p", "", "*.py"), (4, "p", "docs", "*.md"), (5, "q", "", "")], "id int, project_id string, path_filter string, glob_filter string")
    changed = spark.createDataFrame([("p", "src/a.py")], "project_id string, changed_path string")
    assert {r.id for r in tables.invalidated(cache, changed).collect()} == {1, 2, 3}


def test_measures(spark):
    rng = random.Random(2)
    rows = [(rng.choice([1.0, 2.0, 3.5, rng.random() * 4]), rng.randint(0, 1)) for _ in range(200)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))
    assert telemetry.rank_auc(spark.createDataFrame(rows, "score double, label int")).first().auc == pytest.approx(auc)
    assert telemetry.rank_auc(spark.createDataFrame([(1.0, 1)], "score double, label int")).first().auc == 0.0
    facts = spark.createDataFrame([(1, [["redis", "cache"], ["memcached"]]), (2, [["absent"]])], "id int, groups array<array<string>>")
    said = spark.createDataFrame([("Use Redis as a cache",)], "description string")
    assert {r.id: r.present for r in telemetry.fact_presence(said, facts).collect()} == {1: True, 2: False}


def _said_often(spark, seed=5):
    """Events of few texts and many rows, some of them without a time or evidence."""
    rng = random.Random(seed)
    texts = [f"Never use {a} {b} with {c} boxes" for a in ("large", "hot", "blue") for b in ("ring", "bolt") for c in ("small", "economy")] + ["ab", None, "We will use tin for caching because it is cheap", "We will use zinc for caching because it is dear"]
    rows = []
    for k in range(400):
        kind = rng.choice(("APPROACH_ABANDONED_DO_NOT_RETRY", "CONSTRAINT_HARD", "APPROACH_ABANDONED", "DECISION"))
        rows.append((k, rng.choice("pq"), rng.choice((None, rng.randint(0, 50))), kind, rng.choice(texts), rng.choice(("user_stated", "assistant_decided")), rng.choice((None, rng.randint(0, 3)))))
    df = spark.createDataFrame(rows, "id long, project_id string, created_at long, event_type string, description string, authority string, evidence_id long")
    return merge.comparable(df.withColumn("content_hash", text.content_hash(F.col("event_type"), F.col("description"))).withColumn("superseded_by", F.lit(None).cast("long")).withColumn("archived", F.lit(False)))


def _all_pairs(df, new, old):
    return df.where(new).alias("n").join(df.where(old).alias("o"), F.col("n.project_id") == F.col("o.project_id")).where("n.id <> o.id")


def test_outranked_of_texts_said_often(spark):
    df = _said_often(spark).cache()
    rank = lambda side: F.create_map(*[F.lit(x) for kv in merge.PRIORITY.items() for x in kv])[F.col(f"{side}.event_type")]
    met = _all_pairs(df, "true", "true").where((rank("n") < rank("o")) & merge.similar("n", "o"))
    plain = met.groupBy("o.id").agg(F.min_by("n.id", F.struct(rank("n"), F.col("n.id"))))
    assert sorted(map(tuple, merge.duplicates_across_types(df).collect())) == sorted(map(tuple, plain.collect()))
    # what meets is texts, however often they are said
    texts = merge._texts(df)
    assert merge._candidates(texts, texts).count() <= df.select("project_id", "description").distinct().count() ** 2


def test_echoes_of_texts_said_often(spark):
    df = _said_often(spark).withColumn("content_hash", F.concat("content_hash", (F.col("id") % 2).cast("string"))).cache()
    j = jaccard(F.col("n.tokens"), F.col("o.tokens"))
    met = _all_pairs(df, "id % 3 = 0", "id % 3 > 0").where((F.col("n.event_type") == F.col("o.event_type")) & (F.col("n.content_hash") != F.col("o.content_hash")) & (j >= 0.85))
    plain = met.groupBy("n.id").agg(F.max_by("o.id", F.struct(j, F.col("o.id"))))
    found = merge.echoes(df.where("id % 3 = 0"), df.where("id % 3 > 0"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_superseded_of_texts_said_often(spark):
    """Against all pairs: times and evidence missing or shared."""
    df = _said_often(spark).cache()
    n, o = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
    gates = (n("content_hash") != o("content_hash")) & ~F.coalesce(n("evidence_id") == o("evidence_id"), F.lit(False)) & F.coalesce(o("created_at") <= n("created_at"), F.lit(True)) & (authority_rank(n("authority")) >= authority_rank(o("authority")))
    one_topic = (n("topic") != "") & (n("topic") == o("topic")) & (jaccard(n("tokens"), o("tokens")) >= 0.3)
    family = n("event_type").isin(*CHOICE_FAMILY) & o("event_type").isin(*CHOICE_FAMILY)
    hit = F.when(n("event_type") == o("event_type"), merge.similar("n", "o")).otherwise(family & one_topic)
    plain = _all_pairs(df, "id % 3 = 0", "id % 3 > 0").where(n("event_type").isin(*SUPERSESSION_TYPES) & gates & hit).groupBy("o.id").agg(F.min("n.id"))
    found = merge.superseded(df.where("id % 3 = 0"), df.where("id % 3 > 0"))
    assert found.count() > 50 and sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


def test_related_reads_few_of_a_file_that_many_events_touch(spark):
    """One file of 5000 events: the lowest ids, past those with a vector's score, and the scores of those that have one."""
    e = spark.range(5000).select("id", F.array(F.lit("f")).alias("files"))
    seeds = spark.createDataFrame([(0, 0, ["f"]), (3, 3, ["g"])], "query_id long, id long, files array<string>")
    semantic = spark.createDataFrame([(0, k, 0.9) for k in (1, 2, 4900)] + [(3, 4999, 0.9)], "query_id long, id long, score double")
    edges = spark.createDataFrame([("g", "f", False)], "from_path string, to_path string, is_external boolean")
    out = retrieve.related(e, seeds, semantic, edges, 5)
    found = {q: [r.id for r in sorted(out.where(F.col("query_id") == q).collect(), key=lambda r: r.rank)] for q in (0, 3)}
    assert found == {0: [1, 2, 4900, 3, 4], 3: [4999, 0, 1, 2, 4]}
    assert "WindowGroupLimit [path" in out._jdf.queryExecution().executedPlan().toString()  # before the seeds meet the events of a file


def test_texts_of_common_letters_meet_in_tasks_and_few_are_passed_on(spark):
    """Long and short texts of few letters, some with edits around the bound: what is alike is what all pairs say, and little else is compared."""

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(5)
    say = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.choice((3, 12, 40, 150)))).strip()
    texts = [say() for _ in range(150)]
    for t in texts[:60]:
        out = list(t)
        for _ in range(rng.randint(0, max(1, len(t) // 5))):
            at = rng.randrange(len(out) + 1)
            out[at : at + rng.randint(0, 1)] = rng.choice(("", "x", "é"))
        texts.append("".join(out).strip())
    df = merge._texts(merge.comparable(spark.createDataFrame([(k, "p", t) for k, t in enumerate(dict.fromkeys(texts))], "id long, project_id string, description string")))
    met = merge._candidates(df, df)
    tokens = {r.description: set(r.tokens) for r in df.collect()}
    j = lambda a, b: len(tokens[a] & tokens[b]) / len(tokens[a] | tokens[b]) if tokens[a] and tokens[b] else 0.0
    brute = {(a, b) for a in tokens for b in tokens if j(a, b) >= 0.6 or edits(a, b) <= int(max(len(a), len(b)) * 0.15)}
    found = merge._alike(met).where("alike").select("new_text", "old_text").collect()
    assert {tuple(r) for r in found} == brute and len(found) == len(brute) > len(tokens) + 20
    assert met.count() < len(tokens) ** 2 / 10


def test_components_leave_no_links_behind(spark):
    """Components of drawn links, self links among them, and what is left in the shared folder: no more rows than nodes of all rounds."""
    rng = random.Random(8)
    links = [(rng.randint(0, 60), 1000 + k) for k in range(150) for _ in range(20)] + [(7000, 7000)]
    label = {x: x for link in links for x in link}
    for _ in range(8):
        for x, y in links:
            label[x] = label[y] = min(label[x], label[y])
    before = set(os.listdir(_shared(spark)))
    found = graph.components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.label for r in found.collect()} == label and found.count() == len(label)
    left = [f"{_shared(spark)}/{x}" for x in set(os.listdir(_shared(spark))) - before]
    assert sum(spark.read.parquet(x).count() for x in left) < 2 * len(label) < len(set(links))


def _shared(spark):
    from recollect.plans import checkpoints

    return checkpoints.folder(spark).removeprefix("file:")


def test_echoes_join_sets_of_tokens_not_texts(spark, monkeypatch):
    """Texts that differ in short words alone are one set, and the highest id of another hash is found."""
    seen, posted = [], merge._posted
    monkeypatch.setattr(merge, "_posted", lambda sets, least: posted(seen.append(sets) or sets, least))
    rows = [(k, "p", "DECISION", f"Storage limit: {k % 90} boxes of hot ring") for k in range(300)]
    df = spark.createDataFrame(rows, "id long, project_id string, event_type string, description string").withColumn("content_hash", text.content_hash(F.col("event_type"), F.col("description")))
    df = df.withColumn("superseded_by", F.lit(None).cast("long")).withColumn("archived", F.lit(False))
    found = {r.id: r.echo_id for r in merge.echoes(df.where("id % 2 = 1"), df.where("id % 2 = 0 or id = 299")).collect()}
    assert found == {k: 298 if k % 90 == 299 % 90 else 299 for k in range(1, 300, 2)} and seen[0].count() == 1


def test_texts_meet_by_type_and_by_topic_of_choice(spark):
    """Texts of one type each: only pairs that a type or a topic of choice asks for are passed on, each once, and none is missing."""
    rng = random.Random(11)
    kinds = ("DECISION", "CONSTRAINT_HARD", "CONSTRAINT_SOFT", "APPROACH_ABANDONED", "THREAD_OPEN", "OTHER")
    say = lambda k: rng.choice(("We will use {0} for caching of {1}", "Never use {0} with {1} boxes", "{0} {1} {0} again")).format(f"tin{k % 7}", f"ring{k % 5}") + f" case{k}"
    rows = [(k, "p", k % 50, rng.choice(kinds), say(k), "user_stated", k % 9) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, project_id string, created_at long, event_type string, description string, authority string, evidence_id long")
    df = merge.comparable(df.withColumn("content_hash", text.content_hash(F.col("event_type"), F.col("description"))).withColumn("superseded_by", F.lit(None).cast("long")).withColumn("archived", F.lit(False))).cache()
    n, o = (lambda c: F.col(f"n.{c}")), (lambda c: F.col(f"o.{c}"))
    one_topic = (n("topic") != "") & (n("topic") == o("topic")) & (jaccard(n("tokens"), o("tokens")) >= 0.3)
    family = n("event_type").isin(*CHOICE_FAMILY) & o("event_type").isin(*CHOICE_FAMILY)
    hit = F.when(n("event_type") == o("event_type"), merge.similar("n", "o")).otherwise(family & one_topic)
    plain = _all_pairs(df, "id % 2 = 0", "id % 2 = 1").where(hit).select("n.description", "o.description")
    met = merge._met(merge._texts(df.where("id % 2 = 0")), merge._texts(df.where("id % 2 = 1")))
    found = [tuple(r) for r in met.select("new_text", "old_text").collect()]
    assert len(found) > 100 and sorted(found) == sorted(map(tuple, plain.collect()))


def test_long_texts_of_common_words_are_seldom_compared_letter_by_letter(monkeypatch):
    """Drawn texts of few syllables share most short grams; long grams rule them out, and edited ones are found."""
    import pyarrow as pa

    rng = random.Random(12)
    parts = ("th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "nt", "ea", "ti", "to", "it", "st", "io", "le", "is", "ou", "ar", "as", "de", "rt", "ve", "ing", "ion", "ble", "ly", "wh", "sh")
    texts = [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(170)) for _ in range(60)]
    edited = []
    for t in texts[:8]:
        out = list(t)
        for _ in range(len(t) // 10):
            out[rng.randrange(len(out))] = rng.choice("xyz")
        edited.append("".join(out))
    all_texts, compared, at_most = texts + edited, [], merge._at_most

    def counted(text):
        holds = at_most(text)
        return lambda other, bound: compared.append(other) or holds(other, bound)

    monkeypatch.setattr(merge, "_at_most", counted)
    k = len(all_texts)
    block = pa.table({"project_id": ["p"] * k, "place": pa.array([merge.ALL] * k, pa.int32()), "said": [t.encode() for t in all_texts], "description": all_texts, "plain": all_texts, "tokens": pa.array([[t] for t in all_texts], pa.list_(pa.string())), "topic": [""] * k, "mask": pa.array([0] * k, pa.int32()), "fresh": [x >= len(texts) for x in range(k)]})
    found = {(r["new_text"], r["old_text"]) for b in merge._meet(iter(block.to_batches())) for r in b.to_pylist()}
    assert found == set(zip(edited, texts)) and len(compared) <= 2 * len(edited)
