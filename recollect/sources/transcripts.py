"""Session logs as rows and prose: JSON lines of two agents, plain transcripts, evidence chains.

Logs are read as text, one row per line with its number, and parsed tolerantly: what isn't
JSON, or isn't a turn of either speaker, is left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.plans.checkpoints import cut

# Fixed values.
INJECTED_PREFIXES = ("<environment_context>", "<permissions", "<user_instructions>")
OVERLAP_LINES, ANCHOR_LINES = 20, 5
SESSION = ("project_id", "session_id")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """session_id (the file's name), line_no, line of every `.jsonl` below path.

    Whole files are read, as a line's number is its place in its file; sessions are files, so
    a task holds one at a time.
    """
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path, wholetext=True)
    session = F.regexp_extract(F.input_file_name(), r"([^/]+)\.jsonl$", 1)
    return log_lines(files.select(session.alias("session_id"), F.col("value").alias("text")))


def log_lines(logs: DataFrame) -> DataFrame:
    """The lines of logs (…, text) that aren't blank, numbered from 0."""
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    keep = [c for c in logs.columns if c != "text"]
    return logs.select(*keep, F.posexplode(lines).alias("line_no", "line"))


def _blocks(content: Column, kinds: tuple[str, ...]) -> Column:
    """The texts of an array of blocks, trimmed, one per line."""
    parsed = F.from_json(content, "array<struct<type string, text string>>")
    texts = F.transform(F.filter(parsed, lambda b: b["type"].isin(*kinds)), lambda b: F.trim(b["text"]))
    return F.array_join(F.filter(texts, lambda t: t.isNotNull() & (t != "")), "\n")


def _content_text(content: Column, kinds: tuple[str, ...], plain: bool) -> Column:
    """Text of a content that is an array of blocks, or (where plain) a string."""
    blocks = content.startswith("[")
    return F.when(blocks, _blocks(content, kinds)).otherwise(F.trim(content) if plain else F.lit(""))


def agent_turns(lines: DataFrame) -> DataFrame:
    """Turns (role, text) of a log whose lines are `{type, isMeta, message: {content}}`; meta lines aside."""
    kind = F.get_json_object("line", "$.type")
    content = F.coalesce(F.get_json_object("line", "$.message.content"), F.lit(""))
    text = F.when(kind == "user", _content_text(content, ("text",), True)).when(kind == "assistant", _content_text(content, ("text",), False))
    meta = (kind == "user") & F.coalesce(F.get_json_object("line", "$.isMeta"), F.lit("false")).isin("true", "1")
    out = lines.withColumn("role", kind).withColumn("text", text).where(kind.isin("user", "assistant") & ~meta & (text != ""))
    return out.drop("line")


def rollout_turns(lines: DataFrame) -> DataFrame:
    """Turns of a log whose lines are `{type: response_item, payload: {type: message, role, content}}`; injected context aside."""
    role = F.get_json_object("line", "$.payload.role")
    content = F.coalesce(F.get_json_object("line", "$.payload.content"), F.lit(""))
    text = _content_text(content, ("input_text", "output_text"), True)
    head = F.lower(F.substring(F.ltrim(text), 1, 40))
    injected = F.lit(False)
    for prefix in INJECTED_PREFIXES:
        injected = injected | head.startswith(prefix)
    message = (F.get_json_object("line", "$.type") == "response_item") & (F.get_json_object("line", "$.payload.type") == "message")
    turns = lines.withColumn("role", role).withColumn("text", text)
    return turns.where(message & role.isin("user", "assistant") & (text != "") & ~((role == "user") & injected)).drop("line")


def transcripts(turns: DataFrame, keys: tuple[str, ...] = ("session_id",), order: str = "line_no") -> DataFrame:
    """One prose transcript per key: `User:` and `Assistant:` sections in order, a blank line between."""
    section = F.concat(F.initcap("role"), F.lit(":\n"), F.col("text"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), section.alias("s"))))
    return turns.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["s"]), "\n\n").alias("transcript"))


def evidence_transcripts(evidence: DataFrame) -> DataFrame:
    """id, transcript of raw evidence by its source_type; unknown types pass as they are."""
    logs = evidence.where(F.col("source_type").isin("jsonl_transcript", "codex_rollout"))
    lines = log_lines(logs.select("id", "source_type", F.col("content").alias("text")))
    agent = agent_turns(lines.where("source_type = 'jsonl_transcript'"))
    rollout = rollout_turns(lines.where("source_type = 'codex_rollout'"))
    prose = transcripts(agent.unionByName(rollout), ("id",))
    rest = evidence.where("source_type not in ('jsonl_transcript', 'codex_rollout')").select("id", F.col("content").alias("transcript"))
    return evidence.select("id").join(prose.unionByName(rest), "id", "left").select("id", F.coalesce("transcript", F.lit("")).alias("transcript"))


def session_header(lines: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """The `session_meta` payload (id, cwd) of a rollout, looked for in its first five lines."""
    meta = lines.where((F.col("line_no") < 5) & (F.get_json_object("line", "$.type") == "session_meta"))
    found = F.min_by(F.struct(F.get_json_object("line", "$.payload.id").alias("id"), F.get_json_object("line", "$.payload.cwd").alias("cwd")), "line_no")
    return meta.groupBy(*keys).agg(found.alias("h")).select(*keys, F.col("h.id").alias("rollout_id"), F.col("h.cwd").alias("cwd"))


def evidence_chains(evidence: DataFrame) -> DataFrame:
    """leaf_id, n_links, content: every piece that nothing continues, with all that it continues, oldest first.

    Ancestors are found by pointer doubling, so a chain of n links takes log2(n) joins.  A
    link to evidence that isn't there, or a cycle, is an error.
    """
    links = evidence.select("id", F.col("prev_evidence_id").alias("up"))
    missing = links.where("up is not null").join(links.select(F.col("id").alias("up")), "up", "left_anti")
    if missing.limit(1).count():
        raise ValueError("evidence continues evidence that is missing")
    leaves = links.select("id").join(links.select(F.col("up").alias("id")).distinct(), "id", "left_anti")
    # reach: a leaf's ancestors nearer than `step`; jump: the ancestor at that distance
    reach = leaves.select(F.col("id").alias("leaf_id"), F.col("id").alias("at"), F.lit(0).cast("long").alias("depth"))
    jump, step, total = cut(links.where("up is not null")), 1, evidence.count()
    while jump.limit(1).count():
        if step > total:
            raise ValueError("evidence chain has a cycle")
        hop = jump.select(F.col("id").alias("at"), F.col("up").alias("higher"))
        reach = cut(reach.unionByName(reach.join(hop, "at").select("leaf_id", F.col("higher").alias("at"), (F.col("depth") + step).alias("depth"))))
        far = jump.select(F.col("id").alias("up"), F.col("up").alias("up2"))
        jump = cut(jump.join(far, "up").select("id", F.col("up2").alias("up")))
        step *= 2
    content = evidence.select(F.col("id").alias("at"), "content")
    parts = F.reverse(F.array_sort(F.collect_list(F.struct("depth", "content"))))
    # a part that lacks its last line feed gets one, so that lines don't run together
    pieces = F.transform(parts, lambda p: F.regexp_replace(p["content"], r"\n$", ""))
    return reach.join(content, "at").groupBy("leaf_id").agg(F.count(F.lit(1)).alias("n_links"), F.array_join(pieces, "\n").alias("content"))


def anchor(lines: Column, up_to: Column) -> Column:
    """SHA-256 of the five lines before `up_to` of an array of lines."""
    start = F.greatest(F.lit(0), up_to - ANCHOR_LINES)
    return F.sha2(F.array_join(F.slice(lines, (start + 1).cast("int"), (up_to - start).cast("int")), "\n"), 256)


def delta_slices(logs: DataFrame, cursors: DataFrame) -> DataFrame:
    """What is new of each growing log (project_id, session_id, text) since its cursor.

    `stored` are the new lines alone, `extracted` those with twenty lines of overlap.  A log
    without a cursor, shorter than it, or with another anchor has been rewritten: all of it
    is new.  new_line_count and new_anchor make the next cursor.
    """
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: F.trim(x) != "")
    n, seen = F.size("lines"), F.coalesce(F.col("last_line_count"), F.lit(0))
    joined = logs.withColumn("lines", lines).join(cursors.select(*SESSION, "last_line_count", "anchor_sha256"), list(SESSION), "left")
    grown = (seen > 0) & (n >= seen) & (anchor(F.col("lines"), seen) == F.col("anchor_sha256"))
    since = lambda start: F.slice(F.col("lines"), (start + 1).cast("int"), F.greatest(n - start, F.lit(0)).cast("int"))
    marked = joined.withColumn("is_delta", F.coalesce(grown, F.lit(False)))
    stored = F.when(F.col("is_delta"), since(seen)).otherwise(F.col("lines"))
    extracted = F.when(F.col("is_delta"), since(F.greatest(F.lit(0), seen - OVERLAP_LINES))).otherwise(F.col("lines"))
    return marked.select(
        *SESSION,
        "is_delta",
        (~F.col("is_delta") | (n > seen)).alias("has_new"),
        F.array_join(stored, "\n").alias("stored"),
        F.array_join(extracted, "\n").alias("extracted"),
        n.cast("long").alias("new_line_count"),
        anchor(F.col("lines"), n).alias("new_anchor"),
    )


def usage(lines: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Token counters of a log, summed over its assistant lines."""
    number = lambda name: F.coalesce(F.get_json_object("line", f"$.message.usage.{name}").try_cast("long"), F.lit(0))
    counters = {
        "input_tokens": "input_tokens",
        "cache_creation_tokens": "cache_creation_input_tokens",
        "cache_read_tokens": "cache_read_input_tokens",
        "output_tokens": "output_tokens",
    }
    own = F.get_json_object("line", "$.type") == "assistant"
    return lines.groupBy(*keys).agg(*[F.sum(F.when(own, number(field)).otherwise(0)).alias(name) for name, field in counters.items()])


def tool_calls(lines: DataFrame, keys: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Reads, edits and writes of a log in order: pos, tool, raw_path, cwd."""
    block = "array<struct<type string, name string, input struct<file_path string, notebook_path string>>>"
    content = F.get_json_object("line", "$.message.content")
    own = lines.where((F.get_json_object("line", "$.type") == "assistant") & content.startswith("["))
    calls = own.select(*keys, "line_no", F.get_json_object("line", "$.cwd").alias("cwd"), F.posexplode(F.from_json(content, block)).alias("k", "b"))
    calls = calls.where((F.col("b.type") == "tool_use") & F.col("b.name").isin("Read", "Edit", "MultiEdit", "NotebookEdit", "Write"))
    path = F.when(F.col("b.name") == "NotebookEdit", F.col("b.input.notebook_path")).otherwise(F.col("b.input.file_path"))
    order = Window.partitionBy(*keys).orderBy("line_no", "k")
    return calls.select(*keys, F.row_number().over(order).alias("pos"), F.col("b.name").alias("tool"), F.trim(F.coalesce(path, F.lit(""))).alias("raw_path"), "cwd")
