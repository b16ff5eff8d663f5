"""The registered queries of the corpus operators, and SQL for those that it can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import bpe, chat, decontaminate, language, quality, rules, secret_scan, simhash, suffix_dedup, superkmer
from recollect.llm._spark import table


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept", "kept_sha256")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"))

    def listed(c: str):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digests(rows.unionByName(chat.control_conversation(spark)))


def op9_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmer.dedup_windows(table(spark, sf_dir, "documents"), digest=True).withColumnRenamed("kept_text", "kept_sha256")


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rules.quality_rules(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_language, op3_substrings, op4_secrets, op5_bpe, op6_simhash, op7_quality, op8_chat, op9_windows, op10_rules)}

_CHAT_SQL = """
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), marked AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS previous FROM turns
), sized AS (
  SELECT *, {escaped} AS safe,
    CASE WHEN previous = role THEN length('<part>')
         ELSE length('<s>[INST]  [/INST] ') + length(role) + length('</s>') END AS around
  FROM marked
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + around) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _escaped_sql(column: str) -> str:
    for plain, safe in chat.ESCAPES:
        column = f"replace({column}, '{plain}', '{safe}')"
    return column


_WINDOWS_SQL = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(w) - 18)) AS i, w FROM words WHERE len(w) >= 20
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 19), ' ')) AS h FROM starts
), ordered AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS k FROM windows
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ordered WHERE k > 1
), listed AS (
  SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string([x FOR x, i IN w IF NOT coalesce(list_contains(ps, i), false)], ' ')) AS kept_sha256
FROM words LEFT JOIN listed USING (doc_id)
"""

_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_CONTAMINATION_SQL = f"""
WITH words AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents
), items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS_SQL} AS w FROM benchmark
), item_starts AS (
  SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0
), item_windows AS (
  SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM item_starts
), lengths AS (SELECT DISTINCT n FROM item_windows
), doc_starts AS (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, lengths WHERE len(w) >= n
), doc_windows AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM doc_starts
), hits AS (
  SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, g)
), hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""

_SUBSTRINGS_SQL = f"""
WITH texts AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents
), starts AS (SELECT doc_id, t, unnest(range(1, octet_length(t) - {suffix_dedup.WINDOW - 2})) AS i FROM texts WHERE octet_length(t) >= {suffix_dedup.WINDOW}
), windows AS (SELECT doc_id, i, md5(array_slice(t, i, i + {suffix_dedup.WINDOW - 1})) AS h FROM starts
), again AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1
), hits AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM windows SEMI JOIN again USING (h)
), runs AS (SELECT doc_id, i, sum(CASE WHEN gap <= {suffix_dedup.WINDOW} THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hits
), spans AS (SELECT doc_id, min(i) AS a, max(i) + {suffix_dedup.WINDOW} AS b FROM runs GROUP BY doc_id, run
), listed AS (SELECT doc_id, count(*) AS n, sum(b - a) AS removed, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends FROM spans GROUP BY doc_id
), cut AS (SELECT doc_id, t, coalesce(n, 0) AS n, coalesce(removed, 0) AS removed, list_prepend(CAST(1 AS BIGINT), coalesce(ends, [])) AS after, list_append(coalesce(starts, []), octet_length(t) + 1) AS before FROM texts LEFT JOIN listed USING (doc_id))
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(removed AS BIGINT) AS n_removed, CAST(n AS BIGINT) AS n_spans,
  sha256(list_reduce([array_slice(t, x, before[k] - 1) FOR x, k IN after], lambda x, y: x || y)) AS kept_sha256 FROM cut
"""


def _rules_sql() -> str:
    """Words, lines and their repeats; coverage of n-grams one length after the other."""
    words = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
    leads = ", ".join(f"lead(word, {k}) OVER o AS w{k}" for k in range(1, max(rules.GRAM_LIMITS)))
    steps = [f"""d AS (SELECT doc_id, coalesce(text, '') AS text, {words} AS w FROM documents),
c AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM d), p AS (SELECT doc_id, i, word AS w0, {leads} FROM c WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN w]), 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM d),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
ll AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY k) AS again FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dl AS (SELECT doc_id, count(*) FILTER (again > 1) AS n_dup_lines, coalesce(sum(length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g'))) FILTER (again > 1), 0) AS dup_chars FROM ll GROUP BY doc_id)"""]
    for n in (3, *rules.GRAM_LIMITS):
        gram = " || ' ' || ".join(f"w{k}" for k in range(n))
        steps.append(f"""g{n} AS (SELECT doc_id, i, md5({gram}) AS g FROM p WHERE w{n - 1} IS NOT NULL),
r{n} AS (SELECT doc_id, g FROM g{n} GROUP BY ALL HAVING count(*) > 1),
h{n} AS (SELECT doc_id, count(*) AS n, sum(length(word)) AS chars FROM (SELECT DISTINCT doc_id, unnest(range(i, i + {n})) AS i FROM g{n} SEMI JOIN r{n} USING (doc_id, g)) JOIN c USING (doc_id, i) GROUP BY doc_id)""")
    within = " AND ".join(f"coalesce(h{n}.chars, 0) <= {limit} * greatest(word_chars, 1)" for n, limit in rules.GRAM_LIMITS.items())
    joins = " ".join(f"LEFT JOIN h{n} USING (doc_id)" for n in (3, *rules.GRAM_LIMITS))
    failed = f"(n_words < {rules.MIN_WORDS} OR 100 * coalesce(h3.n, 0) > {rules.REPEAT_PERCENT} * n_words)"
    return "WITH " + ",\n".join(steps) + f"""
SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(h3.n, 0) AS n_repeat_words, {failed} AS base_failed,
  NOT {failed} AND {within} AND coalesce(dup_chars, 0) <= {rules.LINE_CHARS_LIMIT} * greatest(word_chars, 1) AND n_symbols <= {rules.SYMBOLS_PER_WORD_LIMIT} * n_words AS kept
FROM m LEFT JOIN dl USING (doc_id) {joins}"""


SQL = {
    "op1_decontaminate": _CONTAMINATION_SQL,
    "op3_substrings": _SUBSTRINGS_SQL,
    "op8_chat": _CHAT_SQL.format(escaped=_escaped_sql("text")),
    "op9_windows": _WINDOWS_SQL,
    "op10_rules": _rules_sql(),
}
