"""The surface: memory as frames in, frames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.functions.paths import project_key
from recollect.functions.text import decision_key
from recollect.operators import budget, extract, graph, merge, project, retrieve, segment, symbols
from recollect.operators.tables import active
from recollect.plans.checkpoints import cut
from recollect.schemas import EVENTS
from recollect.sources import transcripts

KEYS = ("project_id", "session_id", "evidence_id", "captured_at")


def extracted(evidence: DataFrame, lexicon: DataFrame) -> DataFrame:
    """The events of raw evidence, as rows of the event table, ids by evidence and place."""
    prose = transcripts.evidence_transcripts(evidence)
    about = evidence.select("id", "project_id", "session_id", F.col("id").alias("evidence_id"), "captured_at")
    sentences = cut(segment.segment(prose.join(about, "id"), KEYS))  # read by every kind of extraction
    found = extract.extract_session(sentences, lexicon, KEYS)
    files = extract.file_events(sentences, KEYS)
    both = found.unionByName(files, allowMissingColumns=True)
    filled = {"rationale": "", "subject": "", "path": "", "status": "", "intent": ""}
    e = both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in filled.items()})
    ident = F.pmod(F.xxhash64("project_id", "evidence_id", "content_hash"), F.lit(1 << 62))
    rows = {
        "id": ident, "created_at": F.col("captured_at"), "affected_files": F.array().cast("array<string>"), "dependencies": F.array().cast("array<string>"), "mention_count": F.lit(1).cast("long"),
        "superseded_by": F.lit(None).cast("long"), "archived": F.lit(False), "decision_key": decision_key(F.col("event_type"), F.col("subject"), F.col("description"), F.col("triple")),
    }
    names = [p.split()[0] for p in EVENTS.split(", ")]
    return e.withColumns(rows).select(*names)


def rebuilt(evidence: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Memory from nothing but evidence: chains put together, then extracted and merged in order of capture.

    Types, hashes and texts are those that the evidence gave the first time.
    """
    chained = transcripts.evidence_chains(evidence.select("id", "prev_evidence_id", "content"))
    whole = evidence.join(chained.select(F.col("leaf_id").alias("id"), F.col("content").alias("_whole")), "id").withColumn("content", F.col("_whole")).drop("_whole")
    new = cut(extracted(whole, lexicon))
    # ids follow capture, so that merging in order of id is merging in order of time
    rank = F.struct("created_at", "evidence_id", "id")
    placed = new.groupBy("project_id").agg(F.array_sort(F.collect_list(rank)).alias("order"))
    new = cut(new.join(placed, "project_id").withColumn("id", F.array_position("order", rank).cast("long")).drop("order"))
    return merge.merge_in_order(new.limit(0), new)


def rollouts_of(headers: DataFrame, projects: DataFrame) -> DataFrame:
    """Sessions whose header's folder is a project's, however either is written (projects: project_id, project_path)."""
    p = projects.select("project_id", project_key(F.col("project_path")).alias("key"))
    return headers.withColumn("key", project_key(F.col("cwd"))).join(p, "key").drop("key")


def recall(events: DataFrame, queries: DataFrame, k: int = 8, vectors: DataFrame | None = None, query_vectors: DataFrame | None = None) -> DataFrame:
    """The k best active events of each query by words, and by vectors where both have them; else by shared words."""
    live = active(events)
    docs = events.select("id", F.concat_ws(" ", "description", "subject").alias("text"))  # statistics of all, dead ones too
    lexical = retrieve.top(retrieve.bm25(docs, queries).join(live.select("id"), "id", "left_semi"), 20)
    if vectors is None or query_vectors is None:
        near = lexical.limit(0).select("query_id", "id", "score", "rank")
    else:
        near = retrieve.dense(vectors.join(live.select("id"), "id", "left_semi"), query_vectors, 20)
    hits = retrieve.fuse(near, lexical, k)
    plain = retrieve.token_overlap(live.select("id", F.col("description").alias("text")), queries, k)
    missed = plain.join(hits.select("query_id").distinct(), "query_id", "left_anti").withColumns({"dense_rank": F.lit(None).cast("int"), "bm25_rank": F.lit(None).cast("int"), "cosine": F.lit(None).cast("double")})
    found = hits.select("query_id", "id", "score", "rank", "dense_rank", "bm25_rank", "cosine").unionByName(missed.select("query_id", "id", "score", "rank", "dense_rank", "bm25_rank", "cosine"))
    shown = found.join(events.select("id", "event_type", "subject", "description"), "id")
    return shown.withColumn("line", retrieve.hit_line(F.col("event_type"), F.col("score"), F.col("subject"), F.col("description")))


def prohibited(events: DataFrame, edits: DataFrame, pool: int = 12, most: int = 1) -> DataFrame:
    """What edits (query_id, text) would go against among hard constraints and dead ends."""
    docs = events.select("id", F.concat_ws(" ", "description", "subject").alias("text"))
    own = active(events).where(F.col("event_type").isin("CONSTRAINT_HARD", "APPROACH_ABANDONED_DO_NOT_RETRY"))
    best = retrieve.top(retrieve.bm25(docs, edits).join(own.select("id"), "id", "left_semi"), pool).drop("rank", "score")
    hits = best.join(own.select("id", "event_type", "subject", "description", "authority", "rationale", "decision_key"), "id").join(edits.select("query_id", F.col("text").alias("diff")), "query_id")
    return retrieve.prohibitions(hits.withColumn("cosine", F.lit(None).cast("double")), most=most)


def rendered(events: DataFrame, headers: DataFrame, token_budget: int = 3500, edges: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """project_id, block: each project's state within the budget, and the skeleton of its code where that is given."""
    central = graph.centrality(edges.where(~F.col("is_external"))) if edges is not None else None
    state = project.projection(events, central).withColumn("archived", F.lit(False))
    kept = budget.greedy_fill(state, token_budget)
    block = budget.rendered(project.sections(state.join(kept.select("project_id", "id"), ["project_id", "id"], "left_semi")), headers)
    if nodes is None or edges is None:
        return block
    outline = symbols.skeleton_section(symbols.skeleton(nodes, edges, central))
    return block.join(outline, "project_id", "left").select("project_id", F.concat_ws("\n\n", "block", "section").alias("block"))


def value_changes(events: DataFrame, most: int = 50) -> DataFrame:
    """Pairs of a replaced statement and what replaced it that say different things about a value, the least alike first."""
    from recollect.functions.similarity import jaccard
    from recollect.functions.statements import NARRATION
    from recollect.functions.text import overlap_tokens

    usable = (F.char_length("description") >= 30) & F.col("event_type").isin("DECISION", "CONSTRAINT_HARD", "CONSTRAINT_SOFT") & ~F.col("description").rlike(NARRATION) & F.col("description").rlike(r"\d|_|[A-Z]{2,}")
    old = events.where(usable & F.col("superseded_by").isNotNull()).select(F.col("superseded_by").alias("id"), F.col("id").alias("old_id"), F.col("description").alias("stale"))
    new = events.where(usable).select("id", F.col("description").alias("fact"))
    both = old.join(new, "id").withColumn("similarity", jaccard(overlap_tokens(F.col("stale")), overlap_tokens(F.col("fact"))))
    return both.where("similarity < 0.6").orderBy("similarity", "id", "old_id").limit(most)
