"""Registered queries of single operators, over statements and states that are made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions import paths, sanitize, similarity
from recollect.functions import statements as st
from recollect.functions import text as tx
from recollect.operators import graph, merge, policies, project, readers, retrieve, segment, symbols, tables, telemetry
from recollect.plans import views
from recollect.plans.queries import _EVENTS, _STOP, _hash, _tokens, _words
from recollect.plans.registry import query
from recollect.plans.views import millis, table
from recollect.schemas import CHOICE_FAMILY, SUPERSESSION_TYPES
from recollect.sources import diffs, transcripts

#: What is said of a part, by its key: kind of event, and a sentence with its columns.  Invented.
SAYINGS = (
    ("DECISION", "We will use {name} for the {type} shelf because it is cheap."),
    ("CONSTRAINT_HARD", "Never use {name} in production."),
    ("APPROACH_ABANDONED_DO_NOT_RETRY", "{name} - too slow for {type}"),
    ("DECISION", "Use {name} for {type}."),
    ("CONSTRAINT_HARD", "We must not ship the {brand}, it is shared across workers."),
    ("CONSTRAINT_SOFT", "Maybe we could prefer {name}?"),
    ("THREAD_OPEN", "**{brand}:**"),
    ("COMPONENT_STATUS", "Storage limit: {size} boxes of {name}"),
    ("DECISION", "Cache {type} uses {name} via {brand}"),
    ("THREAD_OPEN", "## {name}"),
    ("DECISION", "Switch the queue to {name} since {brand} is heavy."),
    ("CONSTRAINT_SOFT", "This only matters if {name} is cold."),
    ("APPROACH_ABANDONED", "`{name}`"),
)
_FIELDS = {"{name}": "p_name", "{type}": "lower(p_type)", "{brand}": "p_brand", "{size}": "CAST(p_size AS VARCHAR)"}


def sayings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as statements: id, project_id, event_type, role, text."""
    own = (F.col("p_partkey") % len(SAYINGS) + 1).cast("int")
    said = F.element_at(F.array(*[F.lit(t) for _, t in SAYINGS]), own)
    for field, column in _FIELDS.items():
        said = F.replace(said, F.lit(field), F.expr(column.replace("VARCHAR", "STRING")))
    kind = F.element_at(F.array(*[F.lit(k) for k, _ in SAYINGS]), own)
    role = F.when(F.col("p_partkey") % 3 == 0, "user").when(F.col("p_partkey") % 3 == 1, "assistant").otherwise("tool")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project_id"), kind.alias("event_type"), role.alias("role"), said.alias("text"), "p_size")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _said_sql() -> str:
    said = "[" + ", ".join(_quoted(t) for _, t in SAYINGS) + f"][p_partkey % {len(SAYINGS)} + 1]"
    for field, column in _FIELDS.items():
        said = f"replace({said}, '{field}', {column})"
    kind = "[" + ", ".join(_quoted(k) for k, _ in SAYINGS) + f"][p_partkey % {len(SAYINGS)} + 1]"
    return f"SELECT p_partkey AS id, p_brand AS project_id, {kind} AS event_type, CASE p_partkey % 3 WHEN 0 THEN 'user' WHEN 1 THEN 'assistant' ELSE 'tool' END AS role, {said} AS text, p_size FROM part"


_SAID = _said_sql()
_FAMILY_SQL = "(" + ", ".join(_quoted(t) for t in CHOICE_FAMILY) + ")"


def _re(pattern: str) -> str:
    """A pattern of the JVM's as the checking engine reads it: ASCII words, no Unicode flag."""
    return _quoted(pattern.replace("(?iU)", "(?i)").replace("(?isU)", "(?is)").replace("(?U)", ""))


def _content(c: str) -> str:
    return f"[t FOR t IN {_words(c)} IF length(t) > 2 AND t NOT IN {_STOP}]"


# --- topics and structure of statements


def _topic_sql(c: str) -> str:
    s = f"string_split(regexp_replace(array_to_string({_words(c)}, ' '), {_re('^' + tx.ARTICLES + chr(92) + 's+')}, ''), ' ')"
    return f"array_to_string([t FOR t IN {s} IF length(t) > 2 AND t NOT IN {_STOP}], ' ')"


def _subject_sql(c: str) -> str:
    tail = rf"([a-z0-9][\w +./-]*?)\s*{tx.TOPIC_END}"
    purpose = _topic_sql(f"regexp_extract({c}, {_re(rf'(?i)\b(?:for|as)\s+{tail}')}, 1)")
    target = _topic_sql(f"regexp_extract({c}, {_re(rf'(?i)\b{tx.CHOICE_VERB}\b[' + chr(92) + 'w ' + chr(39) + './+-]*?' + rf'\b(?:to|in)\s+{tail}')}, 1)")
    thing = _topic_sql(f"regexp_extract({c}, {_re(rf'(?i){tx.REJECTED_THING}')}, 1)")
    chosen = f"CASE WHEN regexp_matches({c}, {_re(rf'(?i)\b{tx.CHOICE_VERB}\b')}) THEN coalesce(nullif({purpose}, ''), {target}) ELSE '' END"
    return f"coalesce(nullif({chosen}, ''), {thing})"


def _key_sql(c: str) -> str:
    single = "CASE WHEN length(t) > 4 AND regexp_matches(t, 's$') AND NOT regexp_matches(t, '(?:ss|us|is|as|os)$') THEN t[:-2] ELSE t END"
    return f"array_to_string(list_slice(list_sort(list_distinct([{single} FOR t IN {_words(c)} IF length(t) > 2 AND t NOT IN {_STOP}])), 1, 4), ' ')"


_LABEL_STOP = "(" + ", ".join(_quoted(w) for w in tx.LABEL_STOPWORDS) + ")"
_LABEL = r"trim(regexp_extract(trim(text), '^([A-Za-z_][\w .()/+-]{0,40}?)\s*[:—]\s+\S', 1))"
_LABEL_SQL = rf"CASE WHEN len(regexp_split_to_array({_LABEL}, '\s+')) <= 4 AND regexp_replace(lower(regexp_split_to_array({_LABEL}, '\s+')[1]), '^[.,]+|[.,]+$', '', 'g') NOT IN {_LABEL_STOP} THEN {_LABEL} ELSE '' END"


def _fold_sql(t: str) -> str:
    cases = " ".join(f"WHEN ends_with({t}, '{s}') AND length({t}) - {len(s)} + {len(into)} >= 4 THEN left({t}, length({t}) - {len(s)}) || '{into}'" for s, into in tx.STEM_FOLDS)
    return f"CASE WHEN length({t}) > 4 THEN CASE {cases} ELSE {t} END ELSE {t} END"


@query(rf"""
WITH s AS ({_SAID}), d AS (SELECT *, {_subject_sql("text")} AS derived, {_LABEL_SQL} AS label FROM s)
SELECT id, regexp_replace(array_to_string({_words("text")}, ' '), '^(?:{tx.ARTICLES}\s+)+', '') AS subject, derived, label,
  CASE WHEN event_type IN {_FAMILY_SQL} THEN {_key_sql("coalesce(nullif(derived, ''), nullif(label, ''), '')")} ELSE '' END AS decision_key,
  array_to_string(list_sort(list_distinct([{_fold_sql("t")} FOR t IN {_content("text")}])), ' ') AS stems,
  array_to_string([t FOR t, i IN (regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]*')) IF (length(t) > 2 OR regexp_full_match(t, '\d+')) AND t NOT IN {_STOP} AND list_position(regexp_extract_all(lower(text), '[a-z0-9_][a-z0-9_\-]*'), t) = i], ' ') AS terms
FROM d
""")
def statement_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What statements of parts are about: subject, wording's topic, label, key, stems, search terms."""
    t = F.col("text")
    return sayings(spark, sf_dir).select(
        "id",
        tx.normalise_subject(t).alias("subject"),
        tx.derive_subject(t).alias("derived"),
        tx.label_prefix(t).alias("label"),
        tx.decision_key(F.col("event_type"), F.lit(""), t).alias("decision_key"),
        F.array_join(F.array_sort(tx.fold_stems(tx.overlap_tokens(t))), " ").alias("stems"),
        F.array_join(tx.query_terms(t), " ").alias("terms"),
    )


def _compact_sql(c: str, most: int) -> str:
    s = rf"regexp_replace(regexp_replace(regexp_replace(trim({c}), '\*{{1,3}}([^*]+)\*{{1,3}}', '\1', 'g'), '`([^`]+)`', '\1', 'g'), '^\*+', '')"
    s = rf"trim(regexp_replace(regexp_replace({s}, '(?i)^\s*(?:a|an|the)\s+', ''), '(?s)\s*(?:—|-{{2,}}|,|;|\.\s).*$', ''))"
    return f"rtrim(left({s}, {most}))"


_BARE = r"regexp_replace(text, '(?i)^(?:(?:we|you|this|it|the\s+[\w-]+|our\s+[\w-]+)\s+)?(?:(?:will|should|must|always|need\s+to|have\s+to)\s+)?', '')"
_USE = rf"(?i)^(?:use\s+|utilize\s+){st._NAME}"
_VERB = r"\b(?:uses?\s+|via\s+|implements?\s+|relies?\s+on\s+)"


@query(rf"""
WITH s AS ({_SAID}), p AS (SELECT *,
  {_compact_sql(rf"regexp_extract({_BARE}, '(?is)^(?:never|not|do\s+not|don''t|must\s+not|cannot|can''t|avoid\s+(?:using?\s+)?|no)\s+(.*)$', 1)", 35)} AS prohibited,
  {_compact_sql(f"regexp_extract(text, {_re(_USE + r'\s+for\s+(.+?)$')}, 1)", 25)} AS source, {_compact_sql(f"regexp_extract(text, {_re(_USE + r'\s+for\s+(.+?)$')}, 2)", 35)} AS target,
  {_compact_sql(f"regexp_extract(text, {_re(_USE)}, 1)", 25)} AS plain,
  {_compact_sql(f"regexp_extract(text, {_re('(?is)^' + st._NAME + r'\s+(?:.*?\s)??' + _VERB)}, 1)", 25)} AS who, {_compact_sql(f"regexp_extract(text, {_re('(?is)^.*?' + _VERB + '(.*)$')}, 1)", 35)} AS used,
  {_compact_sql("CASE WHEN contains(text, ' — ') THEN split_part(text, ' — ', 1) WHEN contains(text, ' - ') THEN split_part(text, ' - ', 1) ELSE '' END", 25)} AS dashed FROM s),
t AS (SELECT *, CASE WHEN dashed <> '' THEN dashed WHEN length(text) <= 50 THEN {_compact_sql("text", 25)} ELSE '' END AS dead FROM p),
u AS (SELECT *, CASE WHEN event_type = 'CONSTRAINT_HARD' AND prohibited <> '' THEN ['¬', '', prohibited] WHEN event_type = 'DECISION' AND source <> '' THEN ['→', source, target]
  WHEN event_type = 'DECISION' AND plain <> '' THEN ['→', plain, ''] WHEN event_type = 'DECISION' AND who <> '' THEN ['→', who, used]
  WHEN event_type IN ('APPROACH_ABANDONED', 'APPROACH_ABANDONED_DO_NOT_RETRY') AND dead <> '' THEN ['∅', dead, ''] END AS t FROM t)
SELECT id, t[1] AS operator, t[2] AS subject, t[3] AS object,
  event_type || ': ' || CASE WHEN t IS NULL THEN rtrim(left(text, 100)) ELSE concat_ws(' ', nullif(t[2], ''), t[1], nullif(t[3], '')) END || '  # ' || role AS line FROM u
""")
def statement_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of parts as triples, and as compact lines."""
    made = st.triple(F.col("event_type"), F.col("text"))
    said = sayings(spark, sf_dir).withColumn("t", made)
    line = st.compact_line(F.col("event_type"), F.col("text"), F.col("role"), F.col("t"))
    return said.select("id", F.col("t.operator").alias("operator"), F.col("t.subject").alias("subject"), F.col("t.object").alias("object"), line.alias("line"))


_LABEL_FIRST = "(" + ", ".join(_quoted(w) for w in st.LABEL_FIRST) + ")"
_STRUCT = r"trim(regexp_replace(CASE WHEN regexp_extract(trim(text), '^#{1,6}\s+(.+)$', 1) <> '' THEN regexp_extract(trim(text), '^#{1,6}\s+(.+)$', 1) WHEN regexp_extract(trim(text), '^\*\*(.+?)\*\*\s*:?\s*$', 1) <> '' THEN regexp_extract(trim(text), '^\*\*(.+?)\*\*\s*:?\s*$', 1) WHEN ends_with(trim(text), ':') THEN trim(text) ELSE '' END, '[:\s]+$', ''))"


@query(rf"""
WITH s AS ({_SAID})
SELECT id, {_STRUCT} <> '' AND len(regexp_split_to_array({_STRUCT}, '\s+')) <= 10 AS structural,
  regexp_matches(trim(text), '^[A-Z][A-Za-z0-9 _/()\-]{{0,48}}:\s+\S') AND len(regexp_split_to_array(trim(split_part(trim(text), ':', 1)), '\s+')) <= 4
    AND lower(regexp_split_to_array(trim(split_part(trim(text), ':', 1)), '\s+')[1]) NOT IN {_LABEL_FIRST} AND NOT ends_with(trim(text), ',') AS label_value,
  CASE role WHEN 'user' THEN 'user_stated' ELSE 'assistant_decided' END AS authority,
  CAST(CASE role WHEN 'user' THEN 3.0 ELSE 2.0 END + CASE WHEN event_type = 'APPROACH_ABANDONED_DO_NOT_RETRY' THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(' ' || text, {_re(st.ARCHITECTURE)}) THEN 1.0 ELSE 0 END AS DOUBLE) AS priority
FROM s
""")
def statement_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of parts: headings, fact lines, whose word it is, and how much a prohibition weighs."""
    t, authority = F.col("text"), st.role_authority(F.col("role"))
    priority = st.prohibition_priority(F.col("event_type"), authority, F.lit(""), t)
    return sayings(spark, sf_dir).select("id", st.is_structural_label(t).alias("structural"), st.is_label_value(t).alias("label_value"), authority.alias("authority"), priority.alias("priority"))


_LAST_STOP = r"length(regexp_extract(left(text, {n}), '(?s)^(.*[.!?])', 1))"


@query(rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, lang FROM documents)
SELECT doc_id,
  sha256(CASE WHEN length(text) <= 120 THEN text WHEN {_LAST_STOP.format(n=120)} - 1 >= 60 THEN left(text, {_LAST_STOP.format(n=120)})
    WHEN regexp_extract(left(text, 120), '(?s)^(.+) ', 1) <> '' THEN rtrim(regexp_extract(left(text, 120), '(?s)^(.+) ', 1), ' ') || '…' ELSE left(text, 119) || '…' END) AS truncated_sha256,
  sha256(CASE WHEN length(text) > 600 AND {_LAST_STOP.format(n=600)} > 1 THEN left(text, {_LAST_STOP.format(n=600)}) ELSE text END) AS whole_sha256,
  sha256(CASE WHEN lang = 'en' THEN '[user] ' ELSE '' END || 'before || ' || trim(text, ' ')) AS head_input_sha256,
  sha256(array_to_string({_tokens("text")}, ' ')) AS signature_sha256,
  left(sha256(text || chr(0) || lang || chr(0)), 24) AS cache_key,
  sha256(concat_ws(': ', 'topic', nullif(trim(text, ' '), ''))) AS embedding_input_sha256,
  CAST(greatest(1, length(concat_ws(' | ', 'DECISION', nullif(text, ''), lang)) // 4) AS INT) AS tokens
FROM d
""")
def text_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to sentences, as input of heads and vectors, as signatures and keys."""
    t, none, lang = F.coalesce("text", F.lit("")), F.lit(""), F.col("lang")
    role = F.when(lang == "en", "user").otherwise("tool")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.sha2(tx.smart_truncate(t, 120), 256).alias("truncated_sha256"),
        F.sha2(tx.keep_whole(t, 600), 256).alias("whole_sha256"),
        F.sha2(tx.head_input(t, role, F.lit("before")), 256).alias("head_input_sha256"),
        F.sha2(tx.near_dup_signature(t), 256).alias("signature_sha256"),
        tx.cache_key(t, lang, none).alias("cache_key"),
        F.sha2(tx.embedding_input(F.lit("DECISION"), F.lit("topic"), t, none, none, none), 256).alias("embedding_input_sha256"),
        tx.event_tokens(F.lit("DECISION"), t, none, lang, F.array().cast("array<string>")).alias("tokens"),
    )


_FOLDERS = ("src/auth", "./src//api", "app/models", "lib\\utils", "../tests", "migrations", "", "/work/p/config", "C:/x/services", "/mnt/c/Work/P")
_FILES = ("order_router.py", "list handler.ts", "__init__.py", "data.txt", "user_service.py")


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.element_at(F.array(*[F.lit(x) for x in _FOLDERS]), (F.col("p_partkey") % len(_FOLDERS) + 1).cast("int"))
    name = F.element_at(F.array(*[F.lit(x) for x in _FILES]), (F.floor(F.col("p_partkey") / len(_FOLDERS)) % len(_FILES) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name)).alias("raw"))


def _list(values) -> str:
    return "[" + ", ".join(_quoted(v) for v in values) + "]"


_SLASHED = r"regexp_replace(replace(trim(raw), '\', '/'), '/{2,}', '/', 'g')"
_INTENTS = " ".join(f"WHEN len(list_intersect(folders, {_list(words)})) > 0 THEN {_quoted(intent)}" for words, intent in paths.FOLDER_INTENTS) + " " + " ".join(f"WHEN contains(stem, '{w}') THEN {_quoted(i)}" for w, i in paths.STEM_INTENTS)


@query(rf"""
WITH f AS (SELECT p_partkey, {_list(_FOLDERS)}[p_partkey % {len(_FOLDERS)} + 1] AS folder, {_list(_FILES)}[p_partkey // {len(_FOLDERS)} % {len(_FILES)} + 1] AS name FROM part),
r AS (SELECT p_partkey, CASE WHEN folder = '' THEN name ELSE folder || '/' || name END AS raw FROM f),
s AS (SELECT *, {_SLASHED} AS s FROM r),
c AS (SELECT *, CASE WHEN starts_with(s, '/') OR regexp_matches(s, '^.:') THEN CASE WHEN starts_with(s, '/work/p/') THEN s[9:] ELSE '' END ELSE s END AS rel FROM s),
d AS (SELECT *, regexp_replace(regexp_replace(rel, '^(?:\./)+', ''), '/+$', '') AS o FROM c),
e AS (SELECT *, CASE WHEN o IN ('.', '..') OR starts_with(o, '../') OR contains(o, '/../') THEN '' ELSE o END AS path, string_split(replace(lower(raw), '\', '/'), '/') AS parts FROM d),
g AS (SELECT *, list_slice(parts, 1, -2) AS folders, regexp_replace(parts[-1], '\.[^.]*$', '') AS stem, regexp_replace(regexp_replace(replace(path, '/', '.'), '\.py$', ''), '(?:^|\.)__init__$', '') AS dotted FROM e)
SELECT p_partkey, path, path <> '' AND NOT contains(path, '/') AS bare, lower(regexp_replace(regexp_replace(replace(trim(raw), '\', '/'), '/+$', ''), '^/mnt/([A-Za-z])(/|$)', '\1:\2')) AS project_key,
  CASE {_INTENTS} ELSE raw END AS intent, CASE WHEN ends_with(path, '.py') AND regexp_full_match(dotted, '[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*') THEN dotted ELSE '' END AS module
FROM g
""")
def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of files as they are written in logs: stored form, key of the project, intent, module."""
    raw = F.col("raw")
    path = paths.canonical_path(raw, F.lit("/work/p"))
    return _paths(spark, sf_dir).select(
        "p_partkey", path.alias("path"), paths.is_bare_name(path).alias("bare"), paths.project_key(raw).alias("project_key"), paths.path_intent(raw).alias("intent"), paths.module_of(path).alias("module")
    )


_JACCARD = "(CASE WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END)"
_EDITS = "(CASE WHEN la = lb THEN 0.0 WHEN la = '' OR lb = '' THEN 1.0 ELSE levenshtein(la, lb) / greatest(length(la), length(lb)) END)"


@query(rf"""
WITH s AS ({_SAID}), p AS (SELECT a.id, a.text AS a, b.text AS b, lower(trim(a.text)) AS la, lower(trim(b.text)) AS lb FROM s a JOIN s b ON b.id = a.id + {len(SAYINGS)}),
t AS (SELECT *, {_tokens("a")} AS x, {_tokens("b")} AS y, {_subject_sql("a")} AS sa, {_subject_sql("b")} AS sb FROM p),
u AS (SELECT *, {_JACCARD} >= 0.6 OR {_EDITS} <= 0.15 AS overlap, sa <> '' AND sa = sb AND {_JACCARD} >= 0.3 AS same_subject FROM t)
SELECT id, round({_JACCARD}, 9) AS jaccard, round({_EDITS}, 9) AS edits, overlap, same_subject, overlap OR same_subject AS supersedes FROM u
""")
def statement_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each statement of a part against the next of its kind: likeness, and whether one replaces the other."""
    s = sayings(spark, sf_dir).select("id", "text")
    later = s.select((F.col("id") - len(SAYINGS)).alias("id"), F.col("text").alias("b"))
    a, b = F.col("text"), F.col("b")
    return s.join(later, "id").select(
        "id",
        F.round(similarity.jaccard(tx.overlap_tokens(a), tx.overlap_tokens(b)), 9).alias("jaccard"),
        F.round(similarity.edit_distance(a, b), 9).alias("edits"),
        similarity.overlap(a, b).alias("overlap"),
        similarity.same_subject(a, b).alias("same_subject"),
        similarity.supersedes(a, b).alias("supersedes"),
    )


# --- stored state: reads, jobs, upserts


@query(f"""
WITH e AS ({_EVENTS}), live AS (SELECT * FROM e WHERE NOT archived)
SELECT 'since' AS read, id FROM live WHERE id > 20000 UNION ALL SELECT 'session', id FROM e WHERE project_id = 'p1' AND session_id = 's6'
UNION ALL SELECT 'type', id FROM e WHERE project_id = 'p2' AND event_type = 'DECISION' AND NOT archived UNION ALL SELECT 'type_all', id FROM e WHERE project_id = 'p2' AND event_type = 'DECISION'
UNION ALL SELECT 'heaviest', id FROM live QUALIFY row_number() OVER (PARTITION BY project_id, event_type ORDER BY weight DESC, id) <= 3 UNION ALL SELECT 'last', max(id) FROM live
""")
def event_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the readers of events give: after an id, of a session, of a type, the heaviest, the last."""
    e = views.memory_events(spark, sf_dir)
    found = {
        "since": readers.since(e, 20000),
        "session": readers.of_session(e, "p1", "s6"),
        "type": readers.of_type(e, "p2", "DECISION"),
        "type_all": readers.of_type(e, "p2", "DECISION", True),
        "heaviest": readers.heaviest(e, 3),
        "last": readers.since(e).agg(F.max("id").alias("id")),
    }
    out = None
    for name, df in found.items():
        part = df.select(F.lit(name).alias("read"), "id")
        out = part if out is None else out.unionByName(part)
    return out


@query(f"""
WITH e AS ({_EVENTS}) SELECT project_id, count(*) FILTER (NOT archived) AS active, 'memory://' || project_id || '/state memory://' || project_id || '/threads' AS uris FROM e GROUP BY project_id
""")
def project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = readers.projects(views.memory_events(spark, sf_dir))
    return p.select("project_id", "active", F.concat_ws(" ", F.element_at("uris", 1), F.element_at("uris", -1)).alias("uris"))


_JOBS = """
j AS (SELECT o_orderkey AS id, 'p' || (o_custkey % 5) AS project_id, 's' || o_custkey AS session_id, o_orderkey AS evidence_id, o_orderpriority AS category, 'OBSERVED' AS stage,
  ['queued', 'claimed', 'running', 'dead_lettered', 'completed'][o_orderkey % 5 + 1] AS state, CAST(o_orderkey % 4 AS INT) AS attempts, 3 AS max_attempts, NULL AS failure_class, epoch_us(o_orderdate) // 1000 AS updated_at, 'w' || (o_custkey % 7) AS worker FROM orders)
"""


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as jobs."""
    states = F.array(*[F.lit(s) for s in ("queued", "claimed", "running", "dead_lettered", "completed")])
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("p"), (F.col("o_custkey") % 5).cast("string")).alias("project_id"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("session_id"),
        F.col("o_orderkey").alias("evidence_id"), F.col("o_orderpriority").alias("category"), F.lit("OBSERVED").alias("stage"), F.element_at(states, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("state"),
        (F.col("o_orderkey") % 4).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.lit(None).cast("string").alias("failure_class"), millis("o_orderdate").alias("updated_at"), F.concat(F.lit("w"), (F.col("o_custkey") % 7).cast("string")).alias("worker"),
    )


@query(f"""
WITH {_JOBS}, f AS (SELECT *, CASE id % 3 WHEN 0 THEN 'TRANSIENT' WHEN 1 THEN 'POISON' END AS c FROM j WHERE id % 3 < 2)
SELECT j.id, CASE WHEN f.id IS NULL OR j.state IN ('completed', 'dead_lettered') THEN j.state WHEN f.c = 'POISON' OR j.attempts + 1 >= 3 THEN 'dead_lettered' ELSE 'queued' END AS state,
  CAST(j.attempts + CASE WHEN f.id IS NULL OR j.state IN ('completed', 'dead_lettered') THEN 0 ELSE 1 END AS INT) AS attempts,
  CASE WHEN f.id IS NOT NULL AND j.state NOT IN ('completed', 'dead_lettered') THEN f.c END AS failure_class FROM j LEFT JOIN f USING (id)
""")
def failed_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after failures of two classes: tried again, or ended."""
    j = _jobs(spark, sf_dir)
    failures = j.where("id % 3 < 2").select("id", F.when(F.col("id") % 3 == 0, "TRANSIENT").otherwise("POISON").alias("failure_class"), (F.col("updated_at") + 1).alias("now_ms"))
    return policies.after_failure(j, failures).select("id", "state", "attempts", "failure_class")


@query(f"""
WITH {_JOBS}, a AS (SELECT l_orderkey AS id, ['EXTRACTED', 'MERGED', 'COMPLETED', 'PROJECTED'][arg_max(l_partkey, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey) % 4 + 1] AS s FROM lineitem GROUP BY l_orderkey)
SELECT id, CASE WHEN s IS NULL OR state IN ('completed', 'dead_lettered') THEN stage ELSE s END AS stage, CASE WHEN s IS NULL OR state IN ('completed', 'dead_lettered') THEN state WHEN s = 'COMPLETED' THEN 'completed' ELSE 'running' END AS state FROM j LEFT JOIN a USING (id)
""")
def staged_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after their lines have acknowledged stages; the last line counts."""
    stages = F.array(*[F.lit(s) for s in ("EXTRACTED", "MERGED", "COMPLETED", "PROJECTED")])
    acks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.element_at(stages, (F.col("l_partkey") % 4 + 1).cast("int")).alias("stage"), (F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey")).alias("now_ms"))
    return policies.after_stage(_jobs(spark, sf_dir), acks).select("id", "stage", "state")


@query(f"""
WITH {_JOBS}, q AS (SELECT project_id, category, arg_min(id, (updated_at, id)) AS next FROM j WHERE state = 'queued' GROUP BY ALL)
SELECT id, id IN (SELECT next FROM q) AS claimed, CASE WHEN worker IN ('w0', 'w3') AND state IN ('claimed', 'running') THEN 'queued' ELSE state END AS after_sweep,
  CASE WHEN state = 'dead_lettered' AND id % 2 = 1 THEN 'queued' ELSE state END AS after_replay, CAST(CASE WHEN state = 'dead_lettered' AND id % 2 = 1 THEN 0 ELSE attempts END AS INT) AS attempts_after_replay FROM j
""")
def job_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which jobs come next, what is free again when workers die, what dead letters are replayed."""
    j = _jobs(spark, sf_dir)
    dead = j.where(F.col("worker").isin("w0", "w3")).select("worker")
    swept = policies.recovered(j, F.col("updated_at"), dead_workers=dead).select("id", F.col("state").alias("after_sweep"))
    again = policies.replayed(j, j.where("id % 2 = 1")).select("id", F.col("state").alias("after_replay"), F.col("attempts").alias("attempts_after_replay"))
    claimed = policies.next_jobs(j).select("id", F.lit(True).alias("claimed"))
    return j.select("id").join(claimed, "id", "left").join(swept, "id").join(again, "id").select("id", F.coalesce("claimed", F.lit(False)).alias("claimed"), "after_sweep", "after_replay", "attempts_after_replay")


@query(f"""
WITH {_JOBS}, r AS (SELECT DISTINCT project_id, session_id, evidence_id // 2 AS evidence_id, category FROM j), known AS (SELECT project_id, session_id, evidence_id, category FROM j WHERE id % 2 = 0)
SELECT project_id, category, count(*) AS n FROM (SELECT * FROM r EXCEPT SELECT * FROM known) GROUP BY ALL
""")
def enqueued_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New jobs of requests that have none yet."""
    j = _jobs(spark, sf_dir)
    asked = j.select("project_id", "session_id", F.floor(F.col("evidence_id") / 2).cast("long").alias("evidence_id"), "category", F.col("updated_at").alias("now_ms"))
    return policies.enqueue(j.where("id % 2 = 0"), asked).where("state = 'queued' and attempts = 0").groupBy("project_id", "category").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH {_JOBS}, k AS (SELECT * FROM j WHERE project_id = 'p1' AND state = 'queued') SELECT id, state FROM k ORDER BY updated_at DESC, id DESC LIMIT 20
""")
def recent_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty jobs of a project in a state, as its list shows them."""
    return readers.recent_jobs(_jobs(spark, sf_dir), "p1", "queued").select("id", "state")


@query(f"""
WITH {_JOBS} SELECT project_id, id FROM j WHERE state = 'dead_lettered' QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY updated_at DESC, id DESC) <= 10
""")
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest ten failures of each project."""
    failures = _jobs(spark, sf_dir).where("state = 'dead_lettered'").withColumn("failed_at", F.col("updated_at"))
    return tables.dead_letters(failures).select("project_id", "id")


@query("""
WITH a AS (SELECT user_id, json_extract_string(props, '$.k') AS k, event_id, event_type FROM events), old AS (SELECT user_id, k, arg_max(event_type, event_id) AS v FROM a WHERE event_id % 2 = 0 GROUP BY ALL),
new AS (SELECT user_id, k, arg_max(event_type, event_id) AS v FROM a WHERE event_id % 2 = 1 GROUP BY ALL)
SELECT user_id, k, coalesce(new.v, old.v) AS v FROM old FULL JOIN new USING (user_id, k)
""")
def latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert by key: the last of the incoming rows takes the place of what was there."""
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").alias("k"), "event_id", F.col("event_type").alias("v"))
    old = tables.latest(e.limit(0), e.where("event_id % 2 = 0"), ["user_id", "k"], "event_id")
    return tables.latest(old, e.where("event_id % 2 = 1"), ["user_id", "k"], "event_id").select("user_id", "k", "v")


@query("""
WITH e AS (SELECT 'p' || (doc_id % 5) AS project_id, doc_id, coalesce(text, '') AS content FROM documents), old AS (SELECT DISTINCT project_id, sha256(content) AS h FROM e WHERE doc_id % 3 = 0)
SELECT DISTINCT project_id, sha256(content) AS content_sha256 FROM e WHERE doc_id % 3 <> 0 AND (project_id, sha256(content)) NOT IN (SELECT (project_id, h) FROM old)
""")
def new_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a project doesn't hold as evidence yet."""
    e = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string")).alias("project_id"), F.coalesce("text", F.lit("")).alias("content"))
    held = e.where("doc_id % 3 = 0").withColumn("content_sha256", F.sha2("content", 256))
    return tables.store_evidence(held, e.where("doc_id % 3 <> 0")).select("project_id", "content_sha256")


@query("""
SELECT l_partkey AS event_id, l_suppkey AS evidence_id, arg_max(CAST(l_linenumber AS VARCHAR), l_orderkey * 10 + l_linenumber) AS extractor_version, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) FILTER (l_quantity > 25) AS span, min(l_orderkey * 10 + l_linenumber) AS created_at FROM lineitem GROUP BY ALL
""")
def provenance_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One link of event and evidence: the newest extractor, the first known span."""
    at = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("event_id"), F.col("l_suppkey").alias("evidence_id"), F.col("l_linenumber").cast("string").alias("extractor_version"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("span"), at.alias("created_at"))
    return tables.link_provenance(links)


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) // 1000 AS t FROM events), now AS (SELECT max(t) AS t FROM e)
SELECT event_id FROM e, now WHERE now.t - e.t <= 86400000 AND user_id NOT IN (3, 5)
""")
def kept_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads of the last day, those of two ended sessions aside."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", millis("ts").alias("t"))
    now = e.agg(F.max("t")).first()[0] or 0
    return readers.without(tables.expired(e, "t", F.lit(now), 86_400_000), spark.createDataFrame([(3,), (5,)], "user_id long")).select("event_id")


@query(f"""
WITH e AS ({_EVENTS}) SELECT id, CASE WHEN id % 5 = 0 THEN id + 1 END AS superseded_by, CASE WHEN id % 7 = 0 THEN true ELSE archived END AS archived, CASE WHEN id % 3 = 0 THEN greatest(0.0, weight - 1.2) ELSE weight END AS weight FROM e
""")
def marked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events after being replaced, archived and weighed anew, by id."""
    e = views.memory_events(spark, sf_dir)
    i = F.col("id")
    changes = e.select("id", F.when(i % 5 == 0, i + 1).alias("superseded_by"), F.when(i % 7 == 0, True).alias("archived"), F.when(i % 3 == 0, F.col("weight") - 1.2).alias("weight"))
    return readers.marked(e, changes).select("id", "superseded_by", "archived", "weight")


@query(f"""
WITH s AS ({_SAID}), d AS (SELECT *, {_subject_sql("text")} AS derived, {_LABEL_SQL} AS label FROM s)
SELECT id, CASE WHEN id % 2 = 0 THEN 'kept' WHEN event_type IN {_FAMILY_SQL} THEN {_key_sql("coalesce(nullif(derived, ''), nullif(label, ''), '')")} ELSE '' END AS decision_key FROM d
""")
def keyed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose topic wasn't looked for yet, with it."""
    e = sayings(spark, sf_dir).select("id", "event_type", F.lit("").alias("subject"), F.col("text").alias("description"), F.when(F.col("id") % 2 == 0, "kept").alias("decision_key"))
    return readers.with_keys(e).select("id", "decision_key")


_CACHE = """c AS (SELECT p_partkey AS id, 'p' || (p_partkey % 3) AS project_id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'src/' || lower(p_type) WHEN 2 THEN '' ELSE 'src' END AS path_filter, CASE WHEN p_partkey % 4 = 2 THEN '*.' || ['py', 'ts', 'md'][p_size % 3 + 1] ELSE '' END AS glob_filter, p_size FROM part)"""


def _searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    endings = F.element_at(F.array(F.lit("py"), F.lit("ts"), F.lit("md")), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("p"), (F.col("p_partkey") % 3).cast("string")).alias("project_id"),
        F.when(k == 1, F.concat(F.lit("src/"), F.lower("p_type"))).when(k == 3, "src").otherwise("").alias("path_filter"), F.when(k == 2, F.concat(F.lit("*."), endings)).otherwise("").alias("glob_filter"), "p_size",
    )


@query(f"""
WITH {_CACHE} SELECT id FROM c WHERE (project_id = 'p1' AND ((path_filter = '' AND glob_filter = '') OR path_filter IN ('src', 'src/economy') OR glob_filter = '*.py')) OR project_id = 'p2'
""")
def invalidated_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached searches that a changed file of one project concerns, and all of another that changed throughout."""
    changed = spark.createDataFrame([("p1", "src/economy/box.py"), ("p2", None)], "project_id string, changed_path string")
    return tables.invalidated(_searches(spark, sf_dir), changed).select("id")


@query("""
WITH c AS (SELECT 'p' || (p_partkey % 3) AS project_id, left(sha256(p_name || chr(0) || p_type || chr(0) || '*.py'), 24) AS k, p_partkey, p_size FROM part), good AS (SELECT * FROM c WHERE 60 - p_size <= 30),
asked AS (SELECT DISTINCT 'p' || (p_partkey % 3) AS project_id, left(sha256(p_name || chr(0) || p_type || chr(0) || '*.py'), 24) AS k FROM part WHERE p_partkey % 10 = 0)
SELECT p_partkey AS result FROM good JOIN asked USING (project_id, k)
""")
def cached_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of earlier searches that are still good for those asked again."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("p"), (F.col("p_partkey") % 3).cast("string")).alias("project_id"), F.col("p_name").alias("pattern"), F.col("p_type").alias("path"), F.lit("*.py").alias("glob"), "p_size")
    cache = p.select("project_id", tx.cache_key(F.col("pattern"), F.col("path"), F.col("glob")).alias("cache_key"), F.col("p_size").cast("long").alias("cached_at"), F.col("p_partkey").alias("result_text"))
    asked = p.where("p_partkey % 10 = 0").select("project_id", "pattern", "path", "glob").distinct()
    return readers.cached_searches(cache, asked, F.lit(60), ttl_ms=30).select(F.col("result_text").alias("result"))


@query(f"""
WITH e AS ({_EVENTS}), l AS (SELECT project_id, max(id) AS last FROM e GROUP BY project_id), b AS (SELECT 'p0' AS project_id, (SELECT last FROM l WHERE project_id = 'p0') AS high UNION ALL SELECT 'p1', 5)
SELECT project_id, high IS NULL OR last > high AS stale FROM l LEFT JOIN b USING (project_id)
""")
def stale_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects whose projection is missing or older than their last event."""
    e = views.memory_events(spark, sf_dir)
    built = e.where("project_id = 'p0'").groupBy("project_id").agg(F.max("id").alias("high_water")).unionByName(spark.createDataFrame([("p1", 5)], "project_id string, high_water long"))
    return project.is_stale(e, built)


# --- reports


@query("""
SELECT 'p' || (doc_id % 7) AS project_id, count(*) AS pieces, CAST(sum(n_chars) AS BIGINT) AS original_bytes, CAST(sum(n_chars // 3) AS BIGINT) AS stored_bytes, round(CASE WHEN sum(n_chars // 3) > 0 THEN sum(n_chars) / sum(n_chars // 3) ELSE 0.0 END, 9) AS ratio FROM documents GROUP BY ALL
""")
def evidence_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence by project: pieces, bytes, stored bytes, their ratio."""
    n = F.col("n_chars").cast("long")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), (F.col("doc_id") % 7).cast("string")).alias("project_id"), n.alias("original_size"), F.floor(n / 3).cast("long").alias("stored_size"))
    return telemetry.evidence_summary(d).withColumn("ratio", F.round("ratio", 9))


@query(f"""
WITH {_JOBS}, e AS ({_EVENTS}), s AS (SELECT project_id, session_id FROM e UNION SELECT project_id, session_id FROM j), n AS (SELECT project_id, count(*) AS sessions FROM s GROUP BY project_id),
ev AS (SELECT project_id, count(*) AS total, count(*) FILTER (NOT archived) AS active, count(*) FILTER (archived) AS archived FROM e GROUP BY project_id),
jj AS (SELECT project_id, count(*) FILTER (state = 'dead_lettered') AS failures, count(*) FILTER (state IN ('queued', 'claimed', 'running')) AS open_jobs FROM j GROUP BY project_id)
SELECT project_id, sessions, total, active, archived, CAST(0 AS BIGINT) AS superseded, failures, open_jobs FROM n JOIN ev USING (project_id) JOIN jj USING (project_id)
""")
def store_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by state, sessions, failures and unfinished jobs of every project."""
    j = _jobs(spark, sf_dir)
    out = telemetry.store_health(views.memory_events(spark, sf_dir), j.where("state = 'dead_lettered'"), j)
    return out.select("project_id", "sessions", "total", "active", "archived", "superseded", "failures", "open_jobs")


def _blocks(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """A rendered block per brand: its parts' names under three headings, after a line of preamble."""
    name = F.element_at(F.array(F.lit("Decisions"), F.lit("Threads"), F.lit("Files")), (F.col("p_partkey") % 3 + 1).cast("int"))
    p = table(spark, sf_dir, "part").where(F.col("p_size") <= most).groupBy("p_brand", name.alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "\n").alias("body"))
    parts = F.array_sort(F.collect_list(F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.col("body"))))
    return p.groupBy(F.col("p_brand").alias("project_id")).agg(F.concat(F.lit("project\n"), F.array_join(parts, "\n")).alias("block"))


def _tokens_sql(most: int) -> str:
    return f"""SELECT project_id, section, sum(t) AS tokens FROM (
      SELECT p_brand AS project_id, ['Decisions', 'Threads', 'Files'][p_partkey % 3 + 1] AS section, greatest(1, length('## ' || ['Decisions', 'Threads', 'Files'][any_value(p_partkey) % 3 + 1] || chr(10) || string_agg(p_name, chr(10) ORDER BY p_partkey)) // 4) AS t
      FROM part WHERE p_size <= {most} GROUP BY p_brand, p_partkey % 3 UNION ALL SELECT DISTINCT p_brand, '(preamble)', 1 FROM part WHERE p_size <= {most}) GROUP BY ALL"""


@query(f"""
WITH a AS ({_tokens_sql(30)}), b AS ({_tokens_sql(60)})
SELECT project_id, section, CAST(coalesce(a.tokens, 0) AS BIGINT) AS before, CAST(coalesce(b.tokens, 0) AS BIGINT) AS after, CAST(coalesce(b.tokens, 0) - coalesce(a.tokens, 0) AS BIGINT) AS delta FROM a FULL JOIN b USING (project_id, section)
""")
def section_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each section of rendered blocks, before and after they were given more parts."""
    return telemetry.section_changes(telemetry.section_tokens(_blocks(spark, sf_dir, 30)), telemetry.section_tokens(_blocks(spark, sf_dir, 60)))


@query("""
WITH f AS (SELECT p_partkey AS id, lower(p_name) AS a, lower(p_type) AS b FROM part), s AS (SELECT DISTINCT lower('Prefer the ' || p_name || ' made as ' || p_type) AS d FROM part WHERE p_size < 20)
SELECT id, bool_or(contains(d, a) AND contains(d, b)) OR bool_or(contains(d, 'never said') ) AS present FROM f, s WHERE id < 400 GROUP BY id
""")
def fact_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which facts of a fixed set of questions some description holds."""
    p = table(spark, sf_dir, "part")
    said = p.where("p_size < 20").select(F.concat(F.lit("Prefer the "), F.col("p_name"), F.lit(" made as "), F.col("p_type")).alias("description"))
    facts = p.where("p_partkey < 400").select(F.col("p_partkey").alias("id"), F.array(F.array("p_name", "p_type"), F.array(F.lit("never said"))).alias("groups"))
    return telemetry.fact_presence(said, facts)


# --- logs


@query("""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '' AND NOT (role = 'user' AND starts_with(lower(left(ltrim(text), 40)), '<environment_context')))
SELECT conv_id, sha256(string_agg(upper(role[1]) || role[2:] || ':' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY turn)) AS transcript_sha256, 'r' || conv_id AS rollout_id, '/work/' || (conv_id % 5) AS cwd FROM t GROUP BY conv_id
""")
def rollout_transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as rollout logs, read back as prose with their header."""
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "output_text").otherwise("input_text")
    item = F.struct(F.lit("message").alias("type"), F.col("role").alias("role"), F.array(F.struct(kind.alias("type"), F.col("text").alias("text"))).alias("content"))
    line = F.to_json(F.struct(F.lit("response_item").alias("type"), item.alias("payload")))
    injected = F.lit('{"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment_context> x"}]}}')
    meta = F.to_json(F.struct(F.lit("session_meta").alias("type"), F.struct(F.concat(F.lit("r"), F.col("conv_id").cast("string")).alias("id"), F.concat(F.lit("/work/"), (F.col("conv_id") % 5).cast("string")).alias("cwd")).alias("payload")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n")
    logs = c.groupBy("conv_id").agg(body.alias("body")).select(F.col("conv_id").alias("id"), F.lit("codex_rollout").alias("source_type"), F.concat_ws("\n", meta, injected, "body").alias("content"), F.col("conv_id"))
    header = transcripts.session_header(transcripts.log_lines(logs.select("conv_id", F.col("content").alias("text"))), ("conv_id",))
    prose = transcripts.evidence_transcripts(logs.select("id", "source_type", "content")).where("transcript <> ''")
    return prose.select(F.col("id").alias("conv_id"), F.sha2("transcript", 256).alias("transcript_sha256")).join(header, "conv_id")


@query("""
WITH e AS (SELECT user_id, event_id, event_type, CAST(floor(value) AS BIGINT) AS v, json_extract_string(props, '$.k') AS k FROM events), u AS (SELECT user_id, CAST(sum(v) FILTER (event_type = 'view') AS BIGINT) AS input_tokens, CAST(sum(v * 2) FILTER (event_type = 'view') AS BIGINT) AS output_tokens FROM e GROUP BY user_id),
c AS (SELECT user_id, count(*) AS calls, sha256(string_agg(CASE WHEN v % 2 = 0 THEN 'Read' ELSE 'NotebookEdit' END || ' /w/f' || k, ',' ORDER BY event_id)) AS calls_sha256 FROM e WHERE event_type = 'view' GROUP BY user_id)
SELECT user_id, coalesce(input_tokens, 0) AS input_tokens, coalesce(output_tokens, 0) AS output_tokens, calls, calls_sha256 FROM u JOIN c USING (user_id)
""")
def session_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as agent logs: token counters and tool calls read from their JSON."""
    v = F.floor("value").cast("long")
    read = v % 2 == 0
    path = F.concat(F.lit("/w/f"), F.get_json_object("props", "$.k"))
    call = F.struct(F.lit("tool_use").alias("type"), F.when(read, "Read").otherwise("NotebookEdit").alias("name"), F.struct(F.when(read, path).alias("file_path"), F.when(~read, path).alias("notebook_path")).alias("input"))
    usage = F.struct(v.alias("input_tokens"), (v * 2).alias("output_tokens"))
    kind = F.when(F.col("event_type") == "view", "assistant").otherwise("system")
    line = F.to_json(F.struct(kind.alias("type"), F.lit("/w").alias("cwd"), F.struct(usage.alias("usage"), F.array(call).alias("content")).alias("message")))
    # a line of each event; logs that have no turn of an agent's have no calls
    lines = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("line_no"), line.alias("line"))
    calls = transcripts.tool_calls(lines, ("user_id",))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.concat_ws(" ", "tool", "raw_path").alias("s")))), lambda x: x["s"]), ",")
    counted = calls.groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sha2(listed, 256).alias("calls_sha256"))
    return transcripts.usage(lines, ("user_id",)).join(counted, "user_id").select("user_id", "input_tokens", "output_tokens", "calls", "calls_sha256")


@query(f"""
WITH s AS ({_SAID}), c AS (SELECT p_brand AS project_id, 'src/' || split_part(p_name, ' ', 2) || '.py' AS path FROM part WHERE p_size > 40), g AS (SELECT project_id, list(DISTINCT path) AS ps FROM c GROUP BY ALL),
h AS (SELECT s.*, ps, list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-]{{2,}}')) AS hints FROM s LEFT JOIN g USING (project_id)),
k AS (SELECT *, event_type IN ('APPROACH_ABANDONED', 'APPROACH_ABANDONED_DO_NOT_RETRY') AND ps IS NOT NULL AND len([x FOR x IN hints IF len([p FOR p IN ps IF contains(p, x)]) > 0]) > 0 AS hit FROM h)
SELECT id, hit AS git_corroborated, CASE WHEN hit THEN least(2.0, 1.0 + p_size / 40 + 0.2) ELSE 1.0 + p_size / 40 END AS weight FROM k
""")
def corroborated_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Abandoned approaches that the session's changed paths speak for."""
    e = sayings(spark, sf_dir).withColumn("description", F.col("text")).withColumn("weight", 1.0 + F.col("p_size") / 40)
    noun = F.element_at(F.split("p_name", " "), 2)
    changed = table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_brand").alias("project_id"), F.concat(F.lit("src/"), noun, F.lit(".py")).alias("path"))
    return diffs.corroborated(e, changed, ("project_id",)).select("id", "git_corroborated", "weight")


@query("""
WITH n AS (SELECT p_partkey AS id, p_brand AS project_id, 'm' || (p_size % 10) || '.py' AS path, ['blocked', 'abandoned', 'stable'][p_partkey % 3 + 1] AS status FROM part),
d AS (SELECT project_id, path, 'm' || ((p_size * 7) % 10) || '.py' AS target FROM n JOIN part ON id = p_partkey)
SELECT c.project_id, d.path, c.id AS cascaded_from, 'depends on ' || d.target || ' which is ' || c.status AS reason, count(*) AS n FROM n c JOIN d ON c.project_id = d.project_id AND c.path = d.target WHERE c.status <> 'stable' AND c.id % 5 > 0 AND d.path <> d.target GROUP BY ALL
""")
def cascades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of what depends on blocked or abandoned files."""
    p = table(spark, sf_dir, "part")
    name = lambda c: F.concat(F.lit("m"), (c % 10).cast("string"), F.lit(".py"))
    status = F.element_at(F.array(F.lit("blocked"), F.lit("abandoned"), F.lit("stable")), (F.col("p_partkey") % 3 + 1).cast("int"))
    statuses = p.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("project_id"), F.lit("s").alias("session_id"), name(F.col("p_size")).alias("path"), status.alias("status"), F.when(F.col("p_partkey") % 5 == 0, F.lit(1)).alias("cascaded_from"), F.lit(0).cast("long").alias("evidence_id"))
    events = p.select(F.col("p_brand").alias("project_id"), F.lit("COMPONENT_STATUS").alias("event_type"), name(F.col("p_size")).alias("path"), F.array(name(F.col("p_size") * 7)).alias("dependencies"))
    found = graph.cascade(statuses, events)
    return found.groupBy("project_id", "path", "cascaded_from", "reason").agg(F.count(F.lit(1)).alias("n"))


# --- prompts


@query(f"""
WITH s AS ({_SAID}), l AS (SELECT id, '- (' || event_type || ' · ' || printf('%.2f', p_size / 50) || ') ' || CASE WHEN role = 'user' THEN '[' || project_id || '] ' ELSE '' END || left(text, 140) AS line, project_id, row_number() OVER (PARTITION BY project_id ORDER BY p_size DESC, id) AS rank FROM s WHERE id % 4 <> 1),
u AS (SELECT *, 20 + sum(length(line) + 1) OVER (PARTITION BY project_id ORDER BY rank) AS used FROM l)
SELECT project_id, rank, line FROM u WHERE used <= 400
""")
def prompt_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as lines of a prompt, those already shown aside, within a budget of characters."""
    s = sayings(spark, sf_dir).withColumn("query_id", F.col("project_id")).withColumn("session_id", F.lit("s")).withColumn("score", F.col("p_size") / 50)
    shown = s.where("id % 4 = 1").select("session_id", F.col("id").alias("event_id"))
    hits = retrieve.top(retrieve.unseen(s, shown).drop("rank"), 1_000_000)
    line = retrieve.hit_line(F.col("event_type"), F.col("score"), F.when(F.col("role") == "user", F.col("project_id")), F.col("text"))
    out = retrieve.within_budget(hits.withColumn("line", line), 400, 20)
    return out.select("project_id", F.col("rank").cast("long").alias("rank"), "line")


@query(f"""
WITH s AS ({_SAID}), q AS (SELECT p_partkey AS query_id, 'Add ' || p_name || ' and ' || p_brand || ' workers to production' AS diff FROM part WHERE p_partkey % 20 = 0),
h AS (SELECT q.*, s.*, CASE role WHEN 'user' THEN 'user_stated' ELSE 'assistant_decided' END AS authority, (id * 37 + query_id) % 100 / 100 AS cosine FROM q, s WHERE event_type IN ('CONSTRAINT_HARD', 'APPROACH_ABANDONED_DO_NOT_RETRY')),
t AS (SELECT *, len(list_intersect(list_distinct([{_fold_sql("t")} FOR t IN {_content("diff")}]), list_distinct([{_fold_sql("t")} FOR t IN {_content("text")}]))) AS shared, array_to_string(list_slice({_tokens("text")}, 1, 3), ' ') AS topic FROM h
  WHERE event_type <> 'CONSTRAINT_HARD' OR regexp_matches(lower(text), {_re(st.PROHIBITION)})),
r AS (SELECT *, CASE WHEN shared >= 3 THEN 0 WHEN shared >= 1 AND cosine >= 0.60 THEN 1 END AS tier,
  CASE authority WHEN 'user_stated' THEN 3.0 ELSE 2.0 END + CASE WHEN event_type = 'APPROACH_ABANDONED_DO_NOT_RETRY' THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(' ' || text, {_re(st.ARCHITECTURE)}) THEN 1.0 ELSE 0 END AS priority FROM t),
o AS (SELECT * FROM r WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id, CASE WHEN topic <> '' THEN topic ELSE CAST(id AS VARCHAR) END ORDER BY tier, priority DESC, shared DESC, id) = 1)
SELECT query_id, id, shared, tier, CAST(row_number() OVER (PARTITION BY query_id ORDER BY tier, priority DESC, shared DESC, id) AS INT) AS rank FROM o QUALIFY rank <= 3
""")
def edit_prohibitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What edits about every twentieth part would go against, of all that is forbidden or given up."""
    s = sayings(spark, sf_dir).where(F.col("event_type").isin("CONSTRAINT_HARD", "APPROACH_ABANDONED_DO_NOT_RETRY"))
    asked = table(spark, sf_dir, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.lit("Add "), F.col("p_name"), F.lit(" and "), F.col("p_brand"), F.lit(" workers to production")).alias("diff"))
    # candidates share a stem; others have no tier whatever their cosine
    stems = lambda c: F.explode(tx.fold_stems(tx.overlap_tokens(F.col(c)))).alias("stem")
    near = asked.select("query_id", stems("diff")).join(s.select("id", stems("text")), "stem").select("query_id", "id").distinct()
    hits = near.join(asked, "query_id").join(s, "id").withColumn("subject", F.lit("")).withColumn("description", F.col("text")).withColumn("authority", st.role_authority(F.col("role")))
    hits = hits.withColumn("cosine", (F.col("id") * 37 + F.col("query_id")) % 100 / 100)
    return retrieve.prohibitions(hits, most=3).select("query_id", "id", F.col("shared").cast("long").alias("shared"), "tier", "rank")


@query("""
WITH v AS (SELECT vec_id AS id, label, 'f' || (vec_id % 40) AS file, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT id AS query_id, e, file FROM v WHERE id % 20 = 0),
sem AS (SELECT query_id, v.id, round(list_dot_product(q.e, v.e), 9) AS score FROM q, v WHERE v.id <> query_id QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, v.id) <= 20),
ed AS (SELECT 'f' || (label * 3 % 40) AS a, 'f' || (vec_id % 40) AS b FROM embeddings WHERE vec_id % 9 = 0), near AS (SELECT query_id, file AS p FROM q UNION SELECT query_id, b FROM q JOIN ed ON a = file UNION SELECT query_id, a FROM q JOIN ed ON b = file),
st AS (SELECT DISTINCT query_id, id FROM near JOIN v ON v.file = p WHERE id <> query_id), c AS (SELECT * FROM sem WHERE score >= 0.30),
j AS (SELECT query_id, id, c.score AS s, st.id IS NOT NULL AS x FROM c FULL JOIN st USING (query_id, id))
SELECT query_id, id, CASE WHEN s IS NULL THEN 'structural' WHEN x THEN 'semantic+structural' ELSE 'semantic' END AS why, CASE WHEN s IS NULL THEN {structural} ELSE s + CASE WHEN x THEN {boost} ELSE 0 END END AS sc,
  CAST(row_number() OVER (PARTITION BY query_id ORDER BY sc DESC, id) AS INT) AS rank FROM j QUALIFY rank <= 8
""".replace("{structural}", repr(retrieve.STRUCTURAL)).replace("{boost}", repr(retrieve.STRUCTURAL_BOOST)).replace("0.30", repr(retrieve.RELATED_COSINE)).replace("SELECT query_id, id, CASE WHEN s IS NULL THEN 'structural'", "SELECT query_id, id, rank, why, round(sc, 4) AS score FROM (SELECT query_id, id, CASE WHEN s IS NULL THEN 'structural'").rstrip() + ")")
def related_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is related to every twentieth vector, by vectors or by files that import each other."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label", F.concat(F.lit("f"), (F.col("vec_id") % 40).cast("string")).alias("file"))
    seeds = v.where("id % 20 = 0").select(F.col("id").alias("query_id"), "id", F.array("file").alias("files"), "vector")
    near = retrieve.dense(v, seeds.select("query_id", "vector"), 21, least=-2.0).withColumn("score", F.round("score", 9)).where("id <> query_id").drop("rank")
    edges = v.where("id % 9 = 0").select(F.concat(F.lit("f"), (F.col("label") * 3 % 40).cast("string")).alias("from_path"), F.col("file").alias("to_path"), F.lit(False).alias("is_external"))
    found = retrieve.related(v.select("id", F.array("file").alias("files")), seeds, retrieve.top(near, 20).drop("rank"), edges)
    return found.select("query_id", "id", "rank", "why", "score")


# --- evaluations and backfills

_ECHOES, _META = ("could prefer", "red widget"), ("storage limit",)


@query(f"""
WITH s AS ({_SAID}), t AS (SELECT *, CASE WHEN id % 7 = 0 THEN text || ' ...' ELSE text END AS said FROM s), n AS (SELECT *, lower(trim(regexp_replace(said, '\\s+', ' ', 'g'))) AS p FROM t),
d AS (SELECT *, row_number() OVER (PARTITION BY project_id, p ORDER BY id) > 1 AS again FROM n)
SELECT id, CASE WHEN again THEN 'dup' WHEN {" OR ".join(f"contains(p, '{x}')" for x in _ECHOES)} THEN 'echo' WHEN {" OR ".join(f"contains(p, '{x}')" for x in _META)} THEN 'meta' WHEN regexp_matches(said, {_re(telemetry.CUT_SHORT)}) THEN 'truncated'
  WHEN len(regexp_extract_all(p, '[a-z0-9]{{3,}}')) < 4 THEN 'fragment' WHEN event_type IN ('THREAD_OPEN', 'THREAD_CLOSE') AND NOT regexp_matches(p, {_re(telemetry.THREAD_VERB)}) THEN 'mistyped_thread'
  WHEN event_type = 'APPROACH_ABANDONED_DO_NOT_RETRY' AND NOT regexp_matches(p, {_re(telemetry.REJECT_VERB)}) THEN 'false_graveyard' END AS wrong FROM d
""")
def wrong_finds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why statements of parts would be wrong finds of an extraction."""
    text = F.when(F.col("id") % 7 == 0, F.concat("text", F.lit(" ..."))).otherwise(F.col("text"))
    return telemetry.wrong_finds(sayings(spark, sf_dir).withColumn("text", text), _ECHOES, _META, ("project_id",)).select("id", "wrong")


@query(f"""
WITH e AS ({_EVENTS}), v AS (SELECT vec_id * 7 AS id, 'v' || (label % 2) AS version FROM embeddings), i AS (SELECT vec_id * 3 AS id FROM embeddings)
SELECT id, id NOT IN (SELECT id FROM v WHERE version = 'v1') AS to_embed, id NOT IN (SELECT id FROM i) AS to_index FROM e WHERE NOT archived
""")
def backfills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active events that the vectors of a model's version, or the search index, don't hold yet."""
    e, v = views.memory_events(spark, sf_dir), table(spark, sf_dir, "embeddings")
    vectors = v.select((F.col("vec_id") * 7).alias("event_id"), F.concat(F.lit("v"), (F.col("label") % 2).cast("string")).alias("model_version"))
    embed = tables.without_vectors(e, vectors, "v1").select("id", F.lit(True).alias("to_embed"))
    index = tables.without_index(e, v.select((F.col("vec_id") * 3).alias("id"))).select("id", F.lit(True).alias("to_index"))
    out = tables.active(e).select("id").join(embed, "id", "left").join(index, "id", "left")
    return out.select("id", F.coalesce("to_embed", F.lit(False)).alias("to_embed"), F.coalesce("to_index", F.lit(False)).alias("to_index"))


@query(f"""
WITH e AS ({_EVENTS}), k AS (SELECT DISTINCT project_id, session_id FROM e), l AS (SELECT DISTINCT 's' || user_id AS session_id FROM events)
SELECT project_id, count(*) AS sessions, count(l.session_id) AS ingested, count(*) - count(l.session_id) AS skipped FROM k LEFT JOIN l USING (session_id) GROUP BY project_id
""")
def discovered_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known sessions by whether a log of theirs was found."""
    logs = table(spark, sf_dir, "events").select(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"))
    return telemetry.discovered(views.memory_events(spark, sf_dir), logs)


@query(f"""
WITH {_JOBS}, a AS (SELECT l_orderkey AS id, max(l_partkey) - min(l_partkey) AS took FROM lineitem GROUP BY l_orderkey), f AS (SELECT session_id, CAST(took AS DOUBLE) AS latency_ms, c_custkey * 10 + 100 AS size FROM j JOIN a USING (id) JOIN customer ON c_custkey = evidence_id // 20 WHERE state = 'completed')
SELECT session_id, count(*) AS firings, min(latency_ms) AS least_ms, max(latency_ms) AS most_ms, round(sum(size) / max(size), 6) AS amplification FROM f GROUP BY session_id
""")
def job_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What finished jobs took, by their acknowledgements, over the size of their evidence."""
    j = _jobs(spark, sf_dir).withColumn("evidence_id", F.floor(F.col("evidence_id") / 20).cast("long"))
    acks = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("EXTRACTED").alias("stage"), F.col("l_partkey").alias("at_ms"))
    sizes = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") * 10 + 100).alias("size"))
    out = telemetry.ingest_cost(telemetry.job_costs(j, acks, sizes))
    return out.select("session_id", "firings", "least_ms", "most_ms", F.round("amplification", 6).alias("amplification"))


# --- markup, sentences, symbols


@query("""
SELECT p_partkey AS id, 'Use ' || p_name || ' from docs here ' || p_brand || ' tail [code: python] str | ' || lower(p_type) || ' stays Every ' || lower(p_type) || ' transition logs ' || CAST(p_size AS VARCHAR) || '00 rows' AS description FROM part
""")
def clean_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Markup around the columns of parts, taken off again."""
    parts = [
        "User: > ## **Use** `{name}` from [docs](http://x/{brand}) _here_\n- {brand} ~~tail~~\n",
        "```python\nhidden({name})\n```\n| # | Rule |\n|---|---|\nstr | {type} stays\n",
        "| # | Rule | |---|---| | S1 | Every {type} transition logs {size}00 rows",
    ]
    said = F.lit("".join(parts))
    for field, column in _FIELDS.items():
        said = F.replace(said, F.lit(field), F.expr(column.replace("VARCHAR", "STRING")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), sanitize.description(said).alias("description"))


_SENTENCES = (
    # role, text, whether it is code, whether it is of a list
    ("user", "First use {name} e.g. for {type} things.", False, False),
    ("user", "Then {brand} is tried again.", False, False),
    ("user", "keep {name}", False, True),
    ("user", "drop {brand}", False, True),
    ("user", "Limit: {size} boxes", False, False),
    ("assistant", "I see {name}!", False, False),
    ("assistant", "```\nrun {brand}. Now.\n```", True, False),
    ("assistant", "Done with {size}? yes.", False, False),
)
_TRANSCRIPT = (
    "User: First use {name} e.g. for\n{type} things. Then {brand} is\ntried again.\n- keep {name}\n2. drop {brand}\nLimit: {size} boxes\n\n"
    "Assistant: I see {name}!\n```\nrun {brand}. Now.\n```\nDone with {size}? yes.\n"
)


def _filled(template: str) -> str:
    out = _quoted(template).replace("\n", "' || chr(10) || '")
    for field, column in _FIELDS.items():
        out = f"replace({out}, '{field}', {column})"
    return out


@query(
    "\nUNION ALL\n".join(
        f"SELECT p_partkey AS id, {k} AS idx, '{role}' AS role, {_filled(text)} AS text, {str(code).lower()} AS is_code, {str(item).lower()} AS list_item, {1 if item else -1} AS list_group FROM part"
        for k, (role, text, code, item) in enumerate(_SENTENCES)
    )
)
def transcript_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcripts made of the columns of parts, cut into sentences."""
    said = F.lit(_TRANSCRIPT)
    for field, column in _FIELDS.items():
        said = F.replace(said, F.lit(field), F.expr(column.replace("VARCHAR", "STRING")))
    made = segment.segment(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), said.alias("transcript")), ("id",))
    return made.select("id", "idx", "role", "text", "is_code", "list_item", "list_group")


_PYTHON = """import os, app.{noun}
from app.{noun} import Thing
class C{key}(Base, Mixin):
    id: Dict[str, int]
    def __init__(self, a: str):
        self.a = a
        self.b: list[int] = []
    def find(self, key: str, *, most=1) -> bool:
        pass
@router.get('/{noun}/{key}', response_model=List[Thing])
async def f{key}(limit: int = 10) -> dict:
    pass
"""


def _python_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.replace(F.replace(F.lit(_PYTHON), F.lit("{key}"), F.col("p_partkey").cast("string")), F.lit("{noun}"), F.element_at(F.split("p_name", " "), 2))
    broken = F.when(F.col("p_partkey") % 10 == 9, F.lit("def (:\n")).otherwise(source)
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("project_id"), F.concat(F.lit("src/f"), F.col("p_partkey").cast("string"), F.lit(".py")).alias("path"), broken.alias("source"))


@query("""
WITH p AS (SELECT p_brand AS project_id, 'src/f' || p_partkey || '.py' AS path, CAST(p_partkey AS VARCHAR) AS k, split_part(p_name, ' ', 2) AS noun FROM part WHERE p_partkey % 10 <> 9)
SELECT project_id, path, 'class' AS node_type, 'C' || k AS name, '' AS parent_name, 'Base' AS signature, '' AS return_type, 'id:Dict[str, int], a, b:list[int]' AS fields FROM p
UNION ALL SELECT project_id, path, 'method', 'find', 'C' || k, '(key:str, most)', 'bool', '' FROM p
UNION ALL SELECT project_id, path, 'function', 'f' || k, '', '(limit:int)', 'List[Thing]', 'GET /' || noun || '/' || k FROM p
""")
def symbol_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes, methods and routes of Python files made of parts; some can't be parsed."""
    return symbols.nodes_of(symbols.scan_sources(symbols.project_files(_python_files(spark, sf_dir))))


@query("""
WITH p AS (SELECT p_brand AS project_id, 'src/f' || p_partkey || '.py' AS path, split_part(p_name, ' ', 2) AS noun FROM part WHERE p_partkey % 10 <> 9), m AS (SELECT project_id, path, 'os' AS module, noun FROM p UNION ALL SELECT project_id, path, 'app.' || noun, noun FROM p),
files AS (SELECT DISTINCT p_brand AS project_id, 'src/app/' || split_part(p_name, ' ', 2) || '.py' AS path FROM part WHERE p_size > 25)
SELECT DISTINCT project_id, m.path AS from_path, coalesce(files.path, module) AS to_path, files.path IS NULL AS is_external FROM m LEFT JOIN files ON files.project_id = m.project_id AND files.path = 'src/app/' || noun || '.py' AND module <> 'os'
""".replace("SELECT DISTINCT project_id, m.path", "SELECT DISTINCT m.project_id, m.path"))
def import_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imports of the same files, resolved to those of the project that are there."""
    own = _python_files(spark, sf_dir)
    noun = F.element_at(F.split("p_name", " "), 2)
    there = table(spark, sf_dir, "part").where("p_size > 25").select(F.col("p_brand").alias("project_id"), F.concat(F.lit("src/app/"), noun, F.lit(".py")).alias("path")).distinct()
    found = graph.resolve_imports(symbols.imports_of(symbols.scan_sources(own)), there.unionByName(own.select("project_id", "path")))
    return found.select("project_id", "from_path", "to_path", "is_external")


# --- replacing and echoing


def _said_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of parts as stored events, an evidence each."""
    s = sayings(spark, sf_dir)
    return s.select(
        "id", "project_id", F.concat(F.lit("s"), F.col("p_size").cast("string")).alias("session_id"), F.col("id").alias("created_at"), "event_type", F.col("text").alias("description"), F.lit("").alias("rationale"), F.lit("").alias("subject"),
        st.role_authority(F.col("role")).alias("authority"), F.lit("").alias("path"), F.lit("").alias("status"), F.lit("").alias("intent"), F.array().cast("array<string>").alias("affected_files"), F.array().cast("array<string>").alias("dependencies"),
        tx.content_hash(F.col("event_type"), F.col("text")).alias("content_hash"), F.lit(1.0).alias("weight"), F.lit(1).cast("long").alias("mention_count"), F.lit(None).cast("long").alias("superseded_by"), F.lit(False).alias("archived"),
        F.col("id").alias("evidence_id"), F.lit("").alias("decision_key"),
    )


def _pairs_sql(said: str) -> str:
    """rated: pairs of statements of one project, with how alike they are."""
    return f"""
s AS ({said}), c AS (SELECT *, {_tokens("text")} AS tokens, {_subject_sql("text")} AS topic, {_hash("event_type", "text")} AS h, CASE role WHEN 'user' THEN 3 ELSE 2 END AS rank FROM s),
pairs AS (SELECT n.id AS new_id, o.id AS old_id, n.event_type AS nt, o.event_type AS ot, n.rank AS nr, o.rank AS orank, n.tokens AS x, o.tokens AS y, n.h <> o.h AS differ, n.topic <> '' AND n.topic = o.topic AS one_topic, lower(trim(n.text)) AS la, lower(trim(o.text)) AS lb
  FROM c n JOIN c o ON n.project_id = o.project_id AND n.id <> o.id),
rated AS (SELECT *, {_JACCARD} AS j, {_JACCARD} >= 0.6 OR (one_topic AND {_JACCARD} >= 0.3) OR {_EDITS} <= 0.15 AS alike FROM pairs)
"""


_PAIRS = _pairs_sql(_SAID)


@query(f"""
WITH {_PAIRS} SELECT old_id, min(new_id) AS superseded_by FROM rated WHERE new_id % 2 = 1 AND old_id % 2 = 0 AND nt IN ({", ".join(_quoted(t) for t in SUPERSESSION_TYPES)}) AND differ AND old_id <= new_id AND nr >= orank
  AND CASE WHEN nt = ot THEN alike ELSE nt IN {_FAMILY_SQL} AND ot IN {_FAMILY_SQL} AND one_topic AND j >= 0.3 END GROUP BY old_id
""")
def superseded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements of even parts those of odd ones replace."""
    e = _said_events(spark, sf_dir)
    return merge.superseded(e.where("id % 2 = 1"), e.where("id % 2 = 0"))


@query(f"""
WITH {_PAIRS} SELECT new_id AS id, arg_max(old_id, (j, old_id)) AS echo_id FROM rated WHERE new_id % 2 = 1 AND old_id % 2 = 0 AND nt = ot AND differ AND j >= 0.85 GROUP BY new_id
""")
def echoed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which statements of even parts those of odd ones merely say again."""
    e = merge.comparable(_said_events(spark, sf_dir))
    return merge.echoes(e.where("id % 2 = 1"), e.where("id % 2 = 0"))


_PRIORITY_SQL = "MAP {" + ", ".join(f"'{k}': {v}" for k, v in merge.PRIORITY.items()) + "}"
_FORBIDDEN = f"SELECT p_partkey AS id, p_brand AS project_id, {_list(merge.PRIORITY)}[p_partkey % 3 + 1] AS event_type, 'user' AS role, 'Never use ' || p_name || ' with ' || lower(p_type) || ' boxes' AS text, p_size FROM part"


@query(f"""
WITH {_pairs_sql(_FORBIDDEN)} SELECT old_id, arg_min(new_id, (({_PRIORITY_SQL})[nt], new_id)) AS superseded_by FROM rated WHERE ({_PRIORITY_SQL})[nt] < ({_PRIORITY_SQL})[ot] AND alike GROUP BY old_id
""")
def outranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prohibitions that one of a higher type says, too."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", F.lower("p_type").alias("p_type"))
    kind = F.element_at(F.array(*[F.lit(k) for k in merge.PRIORITY]), (F.col("id") % 3 + 1).cast("int"))
    said = F.concat(F.lit("Never use "), F.col("p_name"), F.lit(" with "), F.col("p_type"), F.lit(" boxes"))
    e = _said_events(spark, sf_dir).join(p, "id").withColumn("event_type", kind).withColumn("description", said)
    return merge.duplicates_across_types(e.drop("p_name", "p_type"))
