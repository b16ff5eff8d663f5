"""Retrieval: BM25, token overlap, vectors, rank fusion, and the gates before anything is shown.

Queries are rows, so a batch of questions is one plan.  Statistics are those of everything
indexed, dead rows included; liveness filters what is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.similarity import jaccard
from recollect.functions.statements import PROHIBITION, prohibition_priority
from recollect.functions.text import fold_stems, overlap_tokens, query_terms
from recollect.plans.checkpoints import cut

# Fixed values.
K1, B = 1.2, 0.75
LEAST_IDF = 1e-6
RRF_K = 60
STRUCTURAL, STRUCTURAL_BOOST, RELATED_COSINE = 0.5, 0.1, 0.6
ECHO_JACCARD, ECHO_CONTAINED = 0.6, 0.8
RESCUE_COSINE = 0.60


def index_terms(c: Column) -> Column:
    """Search terms of a text: lower case, accents off, letters, digits, `_` and `-`."""
    return F.regexp_extract_all(strip_accents(F.lower(F.coalesce(c, F.lit("")))), F.lit(r"(?U)([\p{L}\p{N}_\-]+)"), 1)


def strip_accents(c: Column) -> Column:
    return F.translate(c, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score (higher is better) of docs (id, text) for queries (query_id, text), terms OR-ed.

    Terms that no query has go before anything is counted, and what is left is written once,
    as both frequencies and scores read it; lengths take a pass of their own.
    """
    asked = queries.select("query_id", F.explode(query_terms(F.col("text"))).alias("term")).distinct()
    lengths = docs.select(F.size(index_terms(F.col("text"))).alias("length"))
    stats = lengths.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("avgdl"))
    wanted = asked.select("term").distinct()
    terms = docs.select("id", index_terms(F.col("text")).alias("terms"))
    each = terms.select("id", F.size("terms").alias("length"), F.explode("terms").alias("term"))
    held = each.join(F.broadcast(wanted) if few(wanted) else wanted, "term", "left_semi")
    hits = cut(held.groupBy("id", "length", "term").agg(F.count(F.lit(1)).alias("tf")))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("holding"))
    idf = F.log((F.col("docs") - F.col("holding") + 0.5) / (F.col("holding") + 0.5))
    rated = df.crossJoin(F.broadcast(stats)).withColumn("idf", F.when(idf > 0, idf).otherwise(LEAST_IDF))  # one row of statistics
    scored = hits.join(rated, "term").withColumn("s", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("avgdl"))))
    return scored.join(asked, "term").groupBy("query_id", "id").agg(F.sum("s").alias("score"))


def few(df: DataFrame, most: int = 100_000, most_bytes: int = 16 << 20) -> bool:
    """Whether df has so few rows, of so few bytes in its texts, that each task may hold them."""
    texts = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    size = sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in texts), F.lit(0))
    rows, n_bytes = df.limit(most + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return rows <= most and n_bytes <= most_bytes


def top(scored: DataFrame, n: int, score: str = "score", by: str = "query_id") -> DataFrame:
    """The n best of each query with their rank, ties by id."""
    best = Window.partitionBy(by).orderBy(F.desc(score), F.asc("id"))
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)


def token_overlap(docs: DataFrame, queries: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """query_id, id, score, rank: the k largest Jaccard similarities of content words, above 0, of docs (id, text) for queries (query_id, text).

    Queries are taken in blocks of a fixed number, whose words tasks multiply their batches'
    words with, as in `dense`: pairs never leave a task but for its own best.
    """
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), overlap_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    chosen = docs.select(F.col("id").cast("long").alias("id"), overlap_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    n_blocks = max(1, -(-q.count() // block))
    sc, found = docs.sparkSession.sparkContext, None
    for n in range(n_blocks):
        rows = (q.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == n) if n_blocks > 1 else q).toArrow()
        if not rows.num_rows:
            continue
        shared = sc.broadcast((rows.column("query_id").to_numpy(), rows.column("tokens").combine_chunks()))
        part = chosen.mapInArrow(lambda batches, b=shared: _best_overlaps(batches, b.value, k), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return chosen.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return top(found, k)


def _best_overlaps(batches, queries, k: int):
    ids, tokens = queries
    words = tokens.flatten().unique()
    n_words = np.diff(tokens.offsets.to_numpy())
    holds = np.zeros((len(words), len(ids)), dtype=np.float32)  # word by query
    holds[pa.compute.index_in(tokens.flatten(), words).to_numpy(), np.repeat(np.arange(len(ids)), n_words)] = 1
    for batch in batches:
        own, lists = batch.column(0).to_numpy(), batch.column(1)
        for a in range(0, len(own), 256):
            part = lists.slice(a, 256)
            size = pa.compute.list_value_length(part).to_numpy()
            at = pa.compute.index_in(part.flatten(), words)
            row = np.repeat(np.arange(len(part)), size)[at.is_valid().to_numpy(zero_copy_only=False)]
            held = np.zeros((len(part), len(words)), dtype=np.float32)
            held[row, at.drop_null().to_numpy()] = 1
            both = np.rint(held @ holds).astype(np.int64).T  # query by document
            scores = both / (n_words[:, None] + size[None, :] - both)
            yield _kept(ids, own[a : a + 256], scores, k, np.nextafter(0.0, 1.0))


def _kept(ids: np.ndarray, own: np.ndarray, scores: np.ndarray, k: int, least: float) -> pa.RecordBatch:
    """The k best of each query, and whatever ties with the last of them: which of these stays is decided by id, over all batches."""
    bound = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(ids), -np.inf)
    q, v = np.nonzero((scores >= bound[:, None]) & (scores >= least))
    return pa.record_batch([pa.array(ids[q]), pa.array(own[v]), pa.array(scores[q, v])], names=["query_id", "id", "score"])


def dense(vectors: DataFrame, queries: DataFrame, k: int, least: float = 0.0, block: int = 4096) -> DataFrame:
    """query_id, id, score, rank: the k largest inner products of vectors (id, vector) with queries (query_id, vector).

    Queries are taken in blocks of a fixed number, each one matrix that tasks multiply their
    batches with; a batch passes on its own k best of each query, so what is shuffled doesn't
    grow with the corpus times the queries.
    """
    asked = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    n_blocks = max(1, -(-asked.count() // block))
    sc, found = vectors.sparkSession.sparkContext, None
    chosen = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
    for n in range(n_blocks):
        rows = (asked.where(F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == n) if n_blocks > 1 else asked).toArrow()
        if not rows.num_rows:
            continue
        matrix = np.array(rows.column("vector").to_pylist(), dtype=np.float64)
        shared = sc.broadcast((rows.column("query_id").to_numpy(), matrix))
        part = chosen.mapInArrow(lambda batches, q=shared: _best_of_batches(batches, q.value, k, least), "query_id long, id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return chosen.limit(0).select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    return top(found, k)


def _best_of_batches(batches, queries, k: int, least: float):
    ids, matrix = queries
    for batch in batches:
        own = batch.column(0).to_numpy()
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1) if len(own) else np.zeros((0, matrix.shape[1]))
        for a in range(0, len(own), 4096):
            yield _kept(ids, own[a : a + 4096], matrix @ flat[a : a + 4096].T, k, least)


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, id, rank), the best k; one list may be empty.

    score is the sum of 1 / (60 + rank) over its largest value, to four places.
    """
    d = dense_hits.select("query_id", "id", F.col("rank").alias("dense_rank"), F.col("score").alias("cosine"))
    b = lexical_hits.select("query_id", "id", F.col("rank").alias("bm25_rank"))
    part = lambda c: F.coalesce(1.0 / (RRF_K + F.col(c)), F.lit(0.0))
    fused = d.join(b, ["query_id", "id"], "full_outer").withColumn("rrf", part("dense_rank") + part("bm25_rank"))
    return top(fused, k, "rrf").withColumn("score", F.round(F.col("rrf") / (2.0 / (RRF_K + 1)), 4)).drop("rrf")


def without_echoes(hits: DataFrame) -> DataFrame:
    """Hits (… prompt, description) that don't merely say the prompt again."""
    q, d = overlap_tokens(F.col("prompt")), overlap_tokens(F.col("description"))
    contained = F.when(F.size(d) > 0, F.size(F.array_intersect(q, d)) / F.size(d)).otherwise(0.0)
    return hits.where((F.size(q) == 0) | ~((jaccard(q, d) >= ECHO_JACCARD) | (contained >= ECHO_CONTAINED)))


def unseen(hits: DataFrame, ledger: DataFrame) -> DataFrame:
    """Hits whose event the session hasn't been shown on any channel."""
    return hits.join(ledger.select("session_id", F.col("event_id").alias("id")), ["session_id", "id"], "left_anti")


def evidence_gate(hits: DataFrame, rank_most: int = 5, anchor_terms: int = 2, overlap_terms: int = 3, most: int = 2) -> DataFrame:
    """The few hits of each query with enough evidence.

    Both axes answered: both ranks within rank_most and anchor_terms shared.  Text alone: rank
    1 or 2 and overlap_terms shared.  Vectors alone: rank 1 or 2 and cosine 0.60.
    """
    whole = Window.partitionBy("query_id")
    has_dense, has_text = F.max(F.col("dense_rank").isNotNull()).over(whole), F.max(F.col("bm25_rank").isNotNull()).over(whole)
    shared = F.size(F.array_intersect(overlap_tokens(F.col("prompt")), overlap_tokens(F.col("description"))))
    both = (F.col("dense_rank") <= rank_most) & (F.col("bm25_rank") <= rank_most) & (shared >= anchor_terms)
    text = (F.col("bm25_rank") <= 2) & (shared >= overlap_terms)
    vector = (F.col("dense_rank") <= 2) & (F.col("cosine") >= 0.60)
    ok = F.when(has_dense & has_text, both).when(has_text, text).when(has_dense, vector).otherwise(False)
    passed = hits.withColumn("_ok", F.coalesce(ok, F.lit(False))).where("_ok").drop("_ok")
    return passed.withColumn("_k", F.row_number().over(whole.orderBy("rank"))).where(F.col("_k") <= most).drop("_k")


def within_budget(lines: DataFrame, most_chars: int, header_chars: int, by: str = "query_id") -> DataFrame:
    """Lines in order up to the first that would pass the budget, a line feed each."""
    order = Window.partitionBy(by).orderBy("rank")
    used = F.sum(F.char_length("line") + 1).over(order.rowsBetween(Window.unboundedPreceding, 0)) + header_chars
    stop = lines.withColumn("_used", used)
    return stop.where(F.col("_used") <= most_chars).drop("_used")  # lengths only add up, so nothing after a miss fits


def hit_line(event_type: Column, score: Column, subject: Column, description: Column) -> Column:
    tag = F.when(F.coalesce(subject, F.lit("")) != "", F.concat(F.lit("["), subject, F.lit("] "))).otherwise("")
    return F.concat(F.lit("- ("), event_type, F.lit(" · "), F.format_string("%.2f", score), F.lit(") "), tag, F.substring(F.coalesce(description, F.lit("")), 1, 140))


def prohibitions(hits: DataFrame, least_terms: int = 3, most: int = 1) -> DataFrame:
    """What an edit would go against: hits (query_id, id, event_type, diff, subject, description, authority, cosine).

    A hard constraint counts only if it forbids.  Enough shared stems make a candidate; one
    shared stem does with cosine 0.60, after all others.  Then authority and scope, shared
    stems, one per topic, the first `most`.
    """
    about = F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("description", F.lit("")))
    shared = F.size(F.array_intersect(fold_stems(overlap_tokens(F.col("diff"))), fold_stems(overlap_tokens(about))))
    tier = F.when(F.col("shared") >= least_terms, 0).when((F.col("shared") >= 1) & (F.coalesce("cosine", F.lit(0.0)) >= RESCUE_COSINE), 1)
    forbids = (F.col("event_type") != "CONSTRAINT_HARD") | F.lower("description").rlike(PROHIBITION)
    topic_of = F.array_join(F.slice(F.array_sort(overlap_tokens(F.coalesce(F.nullif("subject", F.lit("")), "description"))), 1, 3), " ")
    topic = F.coalesce(F.nullif("decision_key", F.lit("")), topic_of) if "decision_key" in hits.columns else topic_of
    rated = hits.where(forbids).withColumn("shared", shared).withColumn("tier", tier).where("tier is not null")
    rated = rated.withColumn("priority", prohibition_priority(F.col("event_type"), F.col("authority"), F.col("subject"), F.col("description"))).withColumn("topic", topic)
    order = [F.asc("tier"), F.desc("priority"), F.desc("shared"), F.asc("id")]
    per_topic = F.row_number().over(Window.partitionBy("query_id", F.when(F.col("topic") != "", F.col("topic")).otherwise(F.col("id").cast("string"))).orderBy(*order))
    single = rated.withColumn("_t", per_topic).where("_t = 1").drop("_t")
    return single.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= most)


def related(events: DataFrame, seeds: DataFrame, semantic: DataFrame, edges: DataFrame, k: int = 8) -> DataFrame:
    """Events related to seeds by vectors (semantic: query_id, id, score) or by files that import each other.

    events: id, files; seeds: query_id, id, files; edges: from_path, to_path, is_external.
    """
    local = edges.where(~F.col("is_external"))
    own = seeds.select("query_id", F.explode("files").alias("path"))
    out = own.join(local, own["path"] == local["from_path"]).select("query_id", F.col("to_path").alias("path"))
    into = own.join(local, own["path"] == local["to_path"]).select("query_id", F.col("from_path").alias("path"))
    near = own.union(out).union(into).distinct()
    held = events.select("id", F.explode(F.array_distinct("files")).alias("path"))
    close = semantic.where(F.col("score") >= RELATED_COSINE).join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti")
    # what files alone relate all scores the same, so the lowest ids are enough: k of each path, and as many as may fall away
    # because they are the seed's own or have a vector's score
    away = close.groupBy("query_id").agg(F.count_distinct("id").alias("n")).join(seeds.groupBy("query_id").agg(F.count_distinct("id").alias("own")), "query_id", "full_outer")
    needed = away.agg(F.max(F.coalesce("n", F.lit(0)) + F.coalesce("own", F.lit(0)) + k)).first()[0] or 0
    lowest = held.withColumn("at", F.row_number().over(Window.partitionBy("path").orderBy("id"))).where(F.col("at") <= needed)
    listed = near.join(lowest, "path").select("query_id", "id")
    known = close.select("query_id", "id").join(held, "id").join(near, ["query_id", "path"]).select("query_id", "id")
    touched = listed.union(known).distinct()
    touched = touched.join(seeds.select("query_id", "id"), ["query_id", "id"], "left_anti").withColumn("structural", F.lit(True))
    both = close.join(touched, ["query_id", "id"], "full_outer")
    score = F.when(F.col("score").isNull(), STRUCTURAL).otherwise(F.col("score") + F.when(F.col("structural"), STRUCTURAL_BOOST).otherwise(0.0))
    why = F.when(F.col("score").isNull(), "structural").when(F.col("structural"), "semantic+structural").otherwise("semantic")
    return top(both.select("query_id", "id", why.alias("why"), score.alias("score")), k).withColumn("score", F.round("score", 4))
