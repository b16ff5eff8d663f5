"""Events from sentences: a lexicon, patterns with captures, answers, file mentions, table definitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import sanitize
from recollect.functions import statements as st
from recollect.functions.paths import canonical_path, is_bare_name, path_intent
from recollect.functions.text import content_hash, normalise_description

# Phrases that signal a type, with their confidence.
SIGNALS = {
    "DECISION": {
        "decided": 1.0, "chose": 1.0, "went with": 0.9, "going with": 0.9, "settled on": 0.9, "switched to": 0.85, "switching from": 0.85, "we'll use": 0.8,
        "we will use": 0.8, "let's use": 0.8, "instead of": 0.7, "rather than": 0.7, "moved to": 0.7, "opted for": 0.8, "replacing": 0.75, "stick with": 0.85,
        "default to": 0.7, "going to use": 0.8, "we'll go with": 0.85, "we're going with": 0.85,
    },
    "CONSTRAINT_HARD": {
        "must not": 1.0, "must never": 1.0, "cannot": 1.0, "can't": 0.9, "never": 0.9, "not allowed": 0.9, "forbidden": 0.9, "blocked by": 0.8,
        "requirement": 0.9, "required": 0.7, "mandatory": 1.0, "lock in": 0.8, "from day one": 0.75, "strictly": 0.85, "naming convention": 0.8, "casing convention": 0.8,
    },
    "CONSTRAINT_SOFT": {"should not": 0.7, "prefer": 0.6, "avoid": 0.7, "try not to": 0.6, "ideally": 0.5, "better to": 0.6, "where possible": 0.5},
    "APPROACH_ABANDONED": {
        "didn't work": 0.9, "doesn't work": 0.9, "does not work": 0.9, "reverted": 1.0, "rolled back": 1.0, "tried but": 0.8, "abandoned": 1.0, "gave up on": 0.9,
    },
    "APPROACH_ABANDONED_DO_NOT_RETRY": {
        "do not try": 1.0, "don't try": 0.9, "never again": 0.9, "do not use": 0.85, "don't use": 0.8, "failed completely": 0.8, "explicitly abandoned": 1.0,
        "will never revisit": 1.0, "ruled out": 0.85, "won't use": 0.8, "not going with": 0.75,
    },
    "THREAD_OPEN": {
        "todo": 0.7, "to do": 0.7, "next step": 0.8, "still need to": 0.8, "in progress": 0.7, "working on": 0.6, "will implement": 0.7, "need to": 0.5,
        "work thread": 0.9, "active work item": 0.9, "next session": 0.7, "pick up": 0.6, "will need to": 0.6, "come back to": 0.6,
    },
    "THREAD_CLOSE": {"finished": 0.8, "completed": 0.8, "implemented": 0.7, "merged": 0.8, "shipped": 0.9, "done": 0.7, "resolved": 0.8},
}
CONNECTIVES = ("because", "since", "so that", "given that", "as a result")
DEFAULT_REACH, MOST_REACH = 2, 5
ANSWER_SENTENCES = 2

# Patterns with a captured subject: name, pattern, groups, type, confidence, roles, shape.
_NOT_IN = r"(?!(?:in|for|with|at|by|on|to|of|from|into|via|under)\b)"
_TERM = r"[A-Za-z][\w./+-]*"
_STACK = (
    "component\\s+library|ui\\s+library|ui\\s+components?|framework|database|orm|migrations?|state\\s+management|styling|http\\s+client|server\\s+state|"
    "client\\s+state|forms?|build\\s+tool|password\\s+hashing|background\\s+tasks?|url\\s+prefix|api\\s+prefix|token\\s+store|caching|pagination|jwt\\s+secret"
)
PATTERNS = (
    ("USE_X", rf"(?iU)^\s*(?:(?:we'll|we will|let's|let us)\s+)?use\s+([A-Za-z][\w.+/-]*(?:\s+[A-Za-z][\w.+/-]*){{0,2}})", (1,), "DECISION", 0.6, ("user", "assistant"), None),
    ("NO_MULTI", rf"(?iU)\bno\s+({_TERM}(?:\s+{_NOT_IN}{_TERM})?)\s*,\s*no\s+({_TERM}(?:\s+{_NOT_IN}{_TERM})?)", (1, 2), "CONSTRAINT_HARD", 0.85, ("user",), "statement"),
    ("NO_SINGLE", rf"(?iU)^\s*no\s+({_TERM}(?:\s+{_TERM})?)", (1,), "CONSTRAINT_HARD", 0.5, ("user",), "statement"),
    ("PAREN_NOT", rf"(?iU)\(\s*not\s+({_TERM}(?:\s+{_TERM})?)\s*\)", (1,), "CONSTRAINT_HARD", 0.7, ("user",), "parenthesis"),
    ("ONLY_X", rf"(?iU)^\s*only\s+({_TERM}(?:\s+{_TERM}){{0,2}})", (1,), "CONSTRAINT_HARD", 0.7, ("user",), None),
    (
        "URL_PREFIX",
        r"(?i)\b(?:url\s+prefix|api\s+prefix|route\s+prefix|prefix(?:ed)?|versioned\s+under|(?:routes?|endpoints?)\s+(?:\w+\s+){0,2}under|"
        r"mount(?:ed)?\s+(?:under|at)|namespaced?\s+under)\b[^A-Za-z0-9/\n]{0,8}(/[A-Za-z0-9][\w./-]*)",
        (1,), "CONSTRAINT_SOFT", 0.7, ("user", "assistant"), "statement",
    ),
    (
        "URL_PREFIX_REV",
        r"(?i)(/[A-Za-z0-9][\w./-]*)[^A-Za-z0-9\n]{0,4}(?:as\s+(?:a\s+|the\s+)?)?(?:mount\s+|url\s+|route\s+|api\s+)?prefix\b",
        (1,), "CONSTRAINT_SOFT", 0.7, ("user", "assistant"), "statement",
    ),
    ("CASING", r"(?i)\b(snake_case|camelCase|PascalCase|kebab-case|SCREAMING_SNAKE_CASE)\b", (1,), "CONSTRAINT_SOFT", 0.65, ("user", "assistant"), "statement"),
    (
        "CONFIG_LINE",
        rf"(?i)^\s*[-*|]?\s*\*{{0,2}}\s*(?:{_STACK})\s*\*{{0,2}}\s*:\s*\*{{0,2}}\s*([A-Za-z0-9/][^\n|]{{0,48}}?)\s*(?:[.|]\s*|$)",
        (1,), "DECISION", 0.6, ("user", "assistant"), "statement",
    ),
)
EMPTY_SUBJECTS = (
    "the", "a", "an", "of", "for", "to", "and", "or", "with", "by", "this", "that", "these", "those", "it", "them", "us", "way", "ways", "time", "times", "thing", "things",
)

FILE = (
    r"(?<![a-zA-Z0-9_./\\])((?:[a-zA-Z0-9_][a-zA-Z0-9_/.-]*/)*[a-zA-Z0-9_][a-zA-Z0-9_.-]*\."
    r"(?:py|ts|tsx|js|jsx|mjs|json|yaml|yml|sql|md|toml|env|cfg|ini|go|rs|java|cs))(?![a-zA-Z0-9_])"
)
WRITES = r"(?i)\b(?:edit(?:ed|ing)?|writ(?:e|ing|ten)|wrote|modif(?:y|ied|ying)|creat(?:e|ed|ing)|updat(?:e|ed|ing)|chang(?:e|ed|ing)|add(?:ed|ing)?)\b"
READS = r"(?i)\b(?:read(?:ing)?|check(?:ed|ing)?|look(?:ed|ing)?\s+at|review(?:ed|ing)?|found\s+in|defined\s+in|located\s+in|see(?:ing)?|scan(?:ned|ning)?)\b"


def signals(spark: SparkSession) -> DataFrame:
    """phrase, event_type, confidence."""
    return spark.createDataFrame([(p, t, c) for t, entries in SIGNALS.items() for p, c in entries.items()], "phrase string, event_type string, confidence double")


def scan(sentences: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """keys, idx, phrase, event_type, confidence, hits: whole phrases of the lexicon in sentences that aren't code.

    One alternation turns away sentences that hold no phrase; the rest are held against each
    phrase, so that phrases inside others are found too.  A lexicon has at most 10000 phrases.
    """
    entries = lexicon.select("phrase", "event_type", "confidence").limit(10_001).collect()
    if len(entries) > 10_000:
        raise ValueError("a lexicon holds 10000 phrases at most; scan with parts of it")
    if not entries:
        return sentences.limit(0).select(*keys, "idx", F.lit("").alias("phrase"), F.lit("").alias("event_type"), F.lit(0.0).alias("confidence"), F.lit(0).alias("hits"))
    whole = lambda p: rf"(?<![\p{{L}}\p{{N}}_]){_quoted(p)}(?![\p{{L}}\p{{N}}_])"
    any_phrase = rf"(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(_quoted(e.phrase.lower()) for e in entries)})(?![\p{{L}}\p{{N}}_])"
    low = sentences.where(~F.col("is_code")).select(*keys, "idx", F.lower("text").alias("_low")).where(F.col("_low").rlike(any_phrase))
    table = F.array(*[F.struct(F.lit(e.phrase).alias("phrase"), F.lit(e.event_type).alias("event_type"), F.lit(float(e.confidence)).alias("confidence"), F.lit(whole(e.phrase.lower())).alias("p")) for e in entries])
    met = low.select(*keys, "idx", "_low", F.explode(F.filter(table, lambda e: F.contains(F.col("_low"), F.lower(e["phrase"])))).alias("e"))
    hits = F.regexp_count("_low", F.col("e.p"))
    return met.select(*keys, "idx", "e.phrase", "e.event_type", "e.confidence", hits.alias("hits")).where("hits > 0")


def _quoted(phrase: str) -> str:
    return re.sub(r"([^\w\s])", r"\\\1", phrase)


def windows(sentences: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """sentences with `around`: the texts of the sentences about each, itself left out.

    Two before and after; further back, to five, through what leads into the sentence or is
    unfinished; further on, to five, through code.
    """
    order = Window.partitionBy(*keys).orderBy("idx")
    near = F.collect_list(F.struct("idx", "text", "is_code")).over(order.rowsBetween(-MOST_REACH, MOST_REACH))
    s = sentences.withColumn("_near", near)
    before = F.filter("_near", lambda x: x["idx"] < F.col("idx"))
    after = F.filter("_near", lambda x: x["idx"] > F.col("idx"))

    def leads(text: Column) -> Column:
        low = F.regexp_replace(F.lower(text), r"[ .!?,;:]+$", "")
        out = ~F.rtrim(text).rlike(r"[.!?:]$")
        for c in CONNECTIVES:
            out = out | low.endswith(c)
        return out

    # how far the chain of leading sentences goes, counted from the third before
    back = F.aggregate(F.reverse(before), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & ((a["n"] < DEFAULT_REACH) | leads(x["text"])), 1).otherwise(0)).alias("n"), (a["on"] & ((a["n"] < DEFAULT_REACH) | leads(x["text"]))).alias("on")))
    on = F.aggregate(after, F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct((a["n"] + F.when(a["on"] & ((a["n"] < DEFAULT_REACH) | (x["is_code"] & (a["n"] < MOST_REACH - 1))), 1).otherwise(0)).alias("n"), (a["on"] & ((a["n"] < DEFAULT_REACH) | x["is_code"])).alias("on")))
    kept = F.concat(F.slice(before, F.size(before) - back["n"] + 1, F.greatest(back["n"], F.lit(0))), F.slice(after, F.lit(1), on["n"]))
    return s.withColumn("around", F.filter(F.transform(kept, lambda x: F.trim(x["text"])), lambda t: t != "")).drop("_near")


def signal_events(sentences: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Events of lexicon matches: cleaned, noise left out, questions and descriptions of behaviour not taken as rules."""
    w = windows(sentences, keys)
    m = matches.join(w, [*keys, "idx"])
    alone = (F.col("event_type") == "CONSTRAINT_HARD") & F.col("list_item")
    m = m.where(~st.is_structural_label(F.col("text"))).withColumn("around", F.when(alone, F.array().cast("array<string>")).otherwise(F.col("around")))
    m = m.withColumn("description", sanitize.description(F.trim("text"))).withColumn("rationale", sanitize.rationale(F.array_join("around", " ")))
    d = F.col("description")
    m = m.where((d != "") & ~st.is_noise(d))
    hard = F.col("event_type") == "CONSTRAINT_HARD"
    soften = hard & (st.is_question(d) | ((F.col("phrase") == "never") & d.rlike(st.DESCRIPTIVE_NEVER)))
    echo = (F.col("event_type") == "DECISION") & (d.rlike(st.PROMPT_ECHO) | st.is_question(d))
    thin = F.col("event_type").isin("THREAD_OPEN", "THREAD_CLOSE") & (st.content_words(d) < 2)
    m = m.where(~echo & ~thin)
    confidence = F.when(soften, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence"))
    return m.select(
        *keys, "idx", F.when(soften, "CONSTRAINT_SOFT").otherwise(F.col("event_type")).alias("event_type"), "description", "rationale", confidence.alias("confidence"),
        F.lit("").alias("subject"), F.col("role").alias("source_role"), F.col("phrase").alias("matched_phrase"), st.role_authority(F.col("role")).alias("authority"), F.lit("trie").alias("provenance"),
    )


def _hit(name: str, kind: str, confidence: float):
    return lambda subject: F.struct(F.lit(name).alias("matched_phrase"), F.lit(kind).alias("event_type"), F.lit(confidence).alias("confidence"), subject.alias("subject"))


def pattern_events(sentences: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Events of patterns that capture what they are about; a list of rejections isn't read as one rejection too."""
    text, role = F.col("text"), F.col("role")
    low = F.lower(F.ltrim(text))
    shapes = {None: F.lit(True), "statement": ~F.rtrim(text).endswith("?"), "parenthesis": F.lower(text).contains("(not ")}
    found = []
    for name, pattern, groups, kind, confidence, roles, shape in PATTERNS:
        subjects = F.concat(*[F.regexp_extract_all(text, F.lit(pattern), g) for g in groups])
        clean = F.transform(subjects, lambda s: F.trim(F.regexp_replace(F.trim(s), r"[.,;:!?*`]+$", "")))
        meant = F.filter(clean, lambda s: (s != "") & ~F.lower(s).isin(*EMPTY_SUBJECTS))
        rows = F.transform(meant, _hit(name, kind, confidence))
        ok = role.isin(*roles) & shapes[shape]
        found.append((name, F.when(ok, rows)))
    listed = dict(found)["NO_MULTI"]
    parts = [F.when(F.size(F.coalesce(listed, F.array())) > 0, F.lit(None)).otherwise(c) if name == "NO_SINGLE" else c for name, c in found]
    empty = F.array().cast("array<struct<matched_phrase:string,event_type:string,confidence:double,subject:string>>")
    all_rows = F.concat(*[F.coalesce(c, empty) for c in parts])
    each = sentences.where(~F.col("is_code") & (F.trim(text) != "")).select(*keys, "idx", "role", F.trim(text).alias("description"), F.explode(all_rows).alias("m"))
    return each.select(
        *keys, "idx", "m.event_type", "description", F.lit("").alias("rationale"), "m.confidence", "m.subject", F.col("role").alias("source_role"), "m.matched_phrase",
        st.role_authority(F.col("role")).alias("authority"), F.lit("pattern").alias("provenance"),
    )


def answer_events(sentences: DataFrame, matches: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """What the assistant answered to a user's matched sentence: its next one or two sentences of prose, once per answer."""
    order = Window.partitionBy(*keys).orderBy("idx")
    after = order.rowsBetween(1, Window.unboundedFollowing)
    prose = (F.col("role") == "assistant") & ~F.col("is_code")
    s = sentences.withColumn("_answer", F.min(F.when(prose, F.col("idx"))).over(after))
    # another sentence of the user in between, but for the very next one, ends the exchange
    user_later = F.min(F.when(F.col("role") == "user", F.col("idx"))).over(order.rowsBetween(2, Window.unboundedFollowing))
    s = s.withColumn("_stop", user_later)
    turn = F.sum(F.coalesce((F.lag("role").over(order) != F.col("role")).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_turn", turn)
    asked = s.join(matches.select(*keys, "idx").distinct(), [*keys, "idx"], "left_semi").where("role = 'user'")
    asked = asked.where(F.col("_answer").isNotNull() & (F.col("_stop").isNull() | (F.col("_stop") > F.col("_answer"))))
    per_answer = asked.groupBy(*keys, "_answer").agg(F.min("idx").alias("answers_idx"))
    replies = s.where(prose & (F.trim("text") != "")).select(*keys, "idx", "text", "_turn")
    first = replies.select(*keys, F.col("idx").alias("_answer"), "_turn")
    said = per_answer.join(first, [*keys, "_answer"]).join(replies, [*keys, "_turn"]).where("idx >= _answer")
    place = F.row_number().over(Window.partitionBy(*keys, "_answer").orderBy("idx"))
    said = said.withColumn("_k", place).where(F.col("_k") <= ANSWER_SENTENCES)
    joined = said.groupBy(*keys, "_answer", "answers_idx").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda x: F.trim(x["text"])), " ").alias("said"))
    out = joined.withColumn("description", sanitize.description(F.col("said"))).where((F.col("description") != "") & ~st.is_noise(F.col("description")))
    return out.select(
        *keys, F.col("_answer").alias("idx"), F.lit("CONSTRAINT_SOFT").alias("event_type"), "description", F.lit("").alias("rationale"), F.lit(0.5).alias("confidence"), F.lit("").alias("subject"),
        F.lit("assistant").alias("source_role"), F.lit("CO_CAPTURE").alias("matched_phrase"), F.lit("assistant_answer_to_user_question").alias("authority"), F.lit("co_capture").alias("provenance"),
    )


def file_events(sentences: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Files that the assistant names near a verb of reading or writing, once per session and path."""
    order = Window.partitionBy(*keys).orderBy("idx")
    near = F.concat_ws(" ", "text", F.lag("text").over(order), F.lead("text").over(order))
    s = sentences.withColumn("_near", near).where((F.col("role") == "assistant") & ~F.col("is_code"))
    each = s.select(*keys, "idx", "_near", F.posexplode(F.regexp_extract_all("text", F.lit(FILE), 1)).alias("k", "raw"))
    each = each.withColumn("path", canonical_path(F.col("raw"))).where((F.col("path") != "") & ~is_bare_name(F.col("path")))
    writes = F.col("_near").rlike(WRITES)
    each = each.where(writes | F.col("_near").rlike(READS))
    first = each.groupBy(*keys, "path").agg(F.min_by(F.struct("idx", writes.alias("w")), F.struct("idx", "k")).alias("f"))
    status = F.when(F.col("f.w"), "modified").otherwise("referenced")
    said = F.concat("path", F.lit(" "), status, F.lit(" (transcript mention)"))
    return first.select(
        *keys, F.col("f.idx").alias("idx"), F.lit("COMPONENT_STATUS").alias("event_type"), "path", status.alias("status"), path_intent(F.col("path")).alias("intent"), said.alias("description"),
        F.when(F.col("f.w"), 0.6).otherwise(0.4).alias("weight"), content_hash(F.lit("COMPONENT_STATUS"), said).alias("content_hash"), F.lit("inferred_from_code").alias("authority"), F.lit("file_mention").alias("provenance"),
    )


# Column types of table definitions.
TYPE_NAMES = {
    "int": "INTEGER", "integer": "INTEGER", "biginteger": "BIGINT", "bigint": "BIGINT", "serial": "SERIAL", "bigserial": "BIGSERIAL", "uuid": "UUID", "numeric": "NUMERIC",
    "decimal": "DECIMAL", "float": "FLOAT", "real": "REAL", "timestamptz": "TIMESTAMPTZ", "timestamp": "TIMESTAMP", "date": "DATE", "datetime": "TIMESTAMP",
}
KEY_TYPES = ("uuid", "serial", "bigserial", "int", "integer", "bigint", "biginteger")
MONEY_TYPES = ("numeric", "decimal", "int", "integer", "bigint", "float", "real")
TIME_TYPES = ("timestamptz", "timestamp", "date", "datetime")
TIME_COLUMNS = ("created_at", "updated_at", "due_date", "deleted_at")
SKETCH = r"(?i)\b(could be|for example|e\.?g\.?|let'?s start simple|hypothetical|placeholder|something like|roughly|pseudo)\b"


def schema_events(sentences: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Decisions in table definitions inside code: of each table, the first key, money and time column types."""
    code = sentences.where(F.col("is_code") & F.col("text").rlike(r"(?i)create\s+table|primary\s+key") & ~F.col("text").rlike(SKETCH))
    lines = code.select(*keys, "idx", "role", F.posexplode(F.split("text", r"\r?\n")).alias("at", "line"))
    created = F.lower(F.regexp_extract("line", r'(?i)create\s+table(?:\s+if\s+not\s+exists)?\s+"?(\w+)"?', 1))
    in_block = Window.partitionBy(*keys, "idx").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("table", F.coalesce(F.last(F.nullif(created, F.lit("")), ignorenulls=True).over(in_block), F.lit("table")))
    lines = lines.withColumn("part", F.sum((created != "").cast("int")).over(in_block))
    column = r'^\s*"?(\w+)"?\s+([A-Za-z]\w*)\b(.*)$'
    name, kind, rest = (F.lower(F.regexp_extract("line", column, k)) for k in (1, 2, 3))
    c = lines.withColumn("name", name).withColumn("type", kind).withColumn("rest", rest)
    c = c.where(~F.col("name").isin("", "create", "constraint", "primary", "foreign", "unique", "check") & F.col("type").isin(*TYPE_NAMES))
    what = (
        F.when(F.col("rest").rlike(r"primary\s+key") & F.col("type").isin(*KEY_TYPES), "key")
        .when(F.col("name").rlike("amount|price|balance|total|cost|cents|currency") & F.col("type").isin(*MONEY_TYPES), "money")
        .when(F.col("name").isin(*TIME_COLUMNS) & F.col("type").isin(*TIME_TYPES), "time")
    )
    c = c.withColumn("what", what).where("what is not null")
    first = c.groupBy(*keys, "idx", "part", "table", "what").agg(F.min_by(F.struct("name", "type", "role"), "at").alias("f"))
    shown = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])[F.col("f.type")]
    said = (
        F.when(F.col("what") == "key", F.format_string("Primary key type (%s): %s", "table", shown))
        .when(F.col("what") == "money", F.format_string("Money column type (%s.%s): %s", "table", "f.name", shown))
        .otherwise(F.format_string("Timestamp column type (%s): %s", "table", shown))
    )
    about = (
        F.when(F.col("what") == "key", F.format_string("%s primary key type", "table")).when(F.col("what") == "money", F.format_string("%s %s money type", "table", "f.name")).otherwise(F.format_string("%s timestamp type", "table"))
    )
    out = first.select(
        *keys, "idx", F.lit("DECISION").alias("event_type"), said.alias("description"), F.lit("").alias("rationale"), F.lit(0.75).alias("confidence"), about.alias("subject"), F.col("f.role").alias("source_role"),
        F.lit("DDL").alias("matched_phrase"), st.role_authority(F.col("f.role")).alias("authority"), F.lit("schema_ddl").alias("provenance"),
    )
    return out.dropDuplicates([*keys, "description"])


def extract_session(sentences: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """All events that sentences hold, classified, normalised, hashed, one per hash and session."""
    matches = scan(sentences, lexicon, keys)
    found = schema_events(sentences, keys).unionByName(signal_events(sentences, matches, keys)).unionByName(pattern_events(sentences, keys)).unionByName(answer_events(sentences, matches, keys))
    choice = F.col("event_type").isin("CONSTRAINT_HARD", "CONSTRAINT_SOFT")
    strict = st.constraint_class(F.col("confidence"), F.col("source_role"), F.col("description"))
    e = found.withColumn("event_type", F.when(choice, strict).otherwise(F.col("event_type")))
    aside = st.is_fragment(F.col("description"))
    e = e.withColumn("event_type", F.when(aside & (F.col("event_type") == "CONSTRAINT_HARD"), "CONSTRAINT_SOFT").otherwise(F.col("event_type")))
    e = e.withColumn("weight", F.col("confidence") * F.when(aside, 0.4).otherwise(1.0)).withColumn("description", normalise_description(F.col("description")))
    e = e.where("description <> ''").withColumn("content_hash", content_hash(F.col("event_type"), F.col("description"))).withColumn("triple", st.triple(F.col("event_type"), F.col("description")))
    rest = [c for c in e.columns if c not in (*keys, "content_hash")]
    first = e.groupBy(*keys, "content_hash").agg(F.min_by(F.struct(*rest), F.struct("idx", "provenance", "matched_phrase")).alias("e"))
    return first.select(*keys, "content_hash", "e.*")


