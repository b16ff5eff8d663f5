"""What kind of statement a description is: questions, noise, labels, strictness, structure."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and markers.
DECLARATIVE = r"(?iU)\b(is|are|was|were|will|must|should|cannot|never|always|use|choose|decided|chose|switched|set|lock|require|mandate)\b"
STATUS_TALK = r"(?i)^(?:i\s+need\s+to|i\s+can(?:'?t|not)?\b|i'?m\b|i\s+have\b|i'?ve\b|reading\b|already\b|nothing\b|checking\b|looking\b|here'?s\b)"
NARRATION = (
    r"(?i)^(?:now\s+(?:let\s+me|let'?s|i'?ll|implement|update|writ|add|read|check|look)|let\s+me|let'?s|i'?ll\s|i\s+will\s|first[,\s]|"
    r"starting\s+with|next[,\s]|then\s+(?:let|i|we)|going\s+to\s)"
)
META_TALK = r"(?i)\b(?:get_session_state|mcp__|claude\.md|session\s+(?:memory|context)|as\s+required\s+by|per\s+claude\.md|already\s+decided)\b"
REVIEW_TALK = (
    r"(?i)^(?:good\s*[—\-]|note\s+that\b|making\s+all\b|all\s+\d+\s+tests?\s+(?:pass|fail)|the\s+(?:[\w-]+\s+){1,4}(?:is|are|was|were)\s+(?:\w+\s+){0,3}"
    r"(?:handled|done|managed|triggered|implemented|synced|wired|complete|finished|ready))"
)
PROMPT_ECHO = r"(?i)^(?:decide\s+on\b|implement\s+\w|explain\s+your\s+reasoning)"
DESCRIPTIVE_NEVER = (
    r"(?i)(?:it|the\s+\w+|routes?|triggers?|endpoints?|crud(?:\.py)?|schemas?|models?|handlers?|middleware|functions?|queries|columns?|tables?)"
    r"\s+(?:\w+\s+){0,3}never\b"
)
FRAGMENTS = (
    r"(?i)^(?:The|This|That|It|These|Those)\s+\S+(?:\s+\S+)?\s+(?:only|just)\s+(?:matters|applies|works|exists|happens|fires|holds)\b",
    r"(?i)\bonly\s+(?:matters|applies|fires|holds|happens|kicks\s+in)\s+(?:if|when)\b",
    r"(?i)\bwould\s+only\b|\bif\s+\S+(?:\s+\S+){0,4}\s+were\s+\w+",
)
DEONTIC = (
    r"(?U)\b(must|mandatory|required|requirement|non-negotiable|obligatory|always|never|cannot|can't|do not|don't|shall not|must not|"
    r"prohibit\w*|forbid\w*|disallow\w*|no|not)\b"
)
REQUIREMENT_MARKERS = ("requirement", "required", "must", "mandatory", "non-negotiable", "always", "never", "obligatory")
DOMAIN_MARKERS = ("production", "deploy", "security", "auth", "authentication", "compliance", "hipaa", "gdpr", "sox", "pci", "regulatory")
HEDGE_MARKERS = ("probably", "might", "perhaps", "consider", "maybe", "could", "potentially", "possibly", "seems")
HARD_FROM = 0.85
HARD_MARK, SOFT_MARK = "<!-- memory:hard -->", "<!-- memory:soft -->"
LABEL_FIRST = (
    "we", "i", "it", "this", "that", "these", "those", "they", "you", "he", "she", "there", "here", "if", "when", "while", "because",
    "note", "see", "example", "remember", "warning", "however",
)
PROHIBITION = (
    r"\b(never|don't|do not|cannot|can't|must not|shall not|avoid|instead of|rather than|deprecat\w*|forbid\w*|prohibit\w*|"
    r"stop using|migrate away|ruled out|abandon\w*|no longer|not use)\b"
)
ARCHITECTURE = (
    r"(?i)\b(multi-?instance|instances?|shared|distributed|redis|process-local|in-process|\blocal\b|across|cluster|workers?|global state|"
    r"single.?point|per-process|per-request)\b"
)


def content_words(c: Column) -> Column:
    """How many runs of three letters or digits a text has."""
    return F.size(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]{3,})"), 1))


def is_question(c: Column) -> Column:
    s = F.trim(c)
    return s.rlike(r"\?\s*$") & ~s.rlike(DECLARATIVE)


def is_fragment(c: Column) -> Column:
    """An aside that leans on context that isn't there."""
    s = F.trim(c)
    return s.rlike(FRAGMENTS[0]) | s.rlike(FRAGMENTS[1]) | s.rlike(FRAGMENTS[2])


def is_noise(c: Column) -> Column:
    return (content_words(c) == 0) | c.rlike(STATUS_TALK) | c.rlike(NARRATION) | c.rlike(META_TALK) | c.rlike(REVIEW_TALK)


def is_structural_label(c: Column) -> Column:
    """A heading, a bold line or a line ending in a colon, of one to ten words."""
    s = F.trim(c)
    heading = F.regexp_extract(s, r"^#{1,6}\s+(.+)$", 1)
    bold = F.regexp_extract(s, r"^\*\*(.+?)\*\*\s*:?\s*$", 1)
    body = F.when(heading != "", heading).when(bold != "", bold).when(s.endswith(":"), s).otherwise("")
    body = F.trim(F.regexp_replace(body, r"[:\s]+$", ""))
    return (body != "") & (F.size(F.split(body, r"\s+")) <= 10)


def is_label_value(c: Column) -> Column:
    """A fact line `Label: value`, the label one to four words that don't open a clause, the line not broken off."""
    s = F.trim(c)
    label = F.trim(F.substring_index(s, ":", 1))
    parts = F.split(label, r"\s+")
    return s.rlike(r"^[A-Z][A-Za-z0-9 _/()\-]{0,48}:\s+\S") & (F.size(parts) <= 4) & ~F.lower(parts[0]).isin(*LABEL_FIRST) & ~s.endswith(",")


def _any_of(c: Column, markers) -> Column:
    return c.rlike("|".join(rf"\Q{m}\E" for m in markers))


def constraint_class(confidence: Column, role: Column, description: Column, mentions: Column | None = None, marks: tuple[str, str] = (HARD_MARK, SOFT_MARK)) -> Column:
    """Hard or soft, by additive evidence; explicit marks (of hard, of soft) in the text come first."""
    d = F.lower(description)
    score = confidence.cast("double")
    if mentions is not None:
        score = score + F.when(mentions >= 2, 0.3).otherwise(0.0)
    score = score + F.when(role == "user", 0.2).when(role == "assistant", -0.1).otherwise(0.0)
    score = score + F.when(_any_of(d, REQUIREMENT_MARKERS), 0.2).otherwise(0.0)
    score = score + F.when(_any_of(d, DOMAIN_MARKERS), 0.15).otherwise(0.0)
    score = score - F.when(_any_of(d, HEDGE_MARKERS), 0.3).otherwise(0.0)
    capped = (confidence < 1.0) & ((role == "assistant") | ((role == "user") & ~d.rlike(DEONTIC)))
    score = F.when(capped, F.least(score, F.lit(0.80))).otherwise(score)
    scored = F.when(score >= HARD_FROM, "CONSTRAINT_HARD").otherwise("CONSTRAINT_SOFT")
    return F.when(description.contains(marks[0]), "CONSTRAINT_HARD").when(description.contains(marks[1]), "CONSTRAINT_SOFT").otherwise(scored)


def role_authority(role: Column) -> Column:
    return F.when(role == "user", "user_stated").otherwise("assistant_decided")


def prohibition_priority(event_type: Column, authority: Column, subject: Column, description: Column) -> Column:
    """Authority, half a point for what isn't to be retried, one for what concerns the architecture."""
    rank = F.when(authority == "user_stated", 3.0).when(authority == "assistant_decided", 2.0).when(authority == "inferred_from_code", 0.0).otherwise(1.0)
    about = F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(description, F.lit("")))
    return rank + F.when(event_type == "APPROACH_ABANDONED_DO_NOT_RETRY", 0.5).otherwise(0.0) + F.when(about.rlike(ARCHITECTURE), 1.0).otherwise(0.0)


# Structure: prohibitions, implications and dead ends as (operator, subject, object).
_NAME = r"([\w+/.-]+(?:\s+[\w+/.-]+){0,2})"


def compact(c: Column, most: int) -> Column:
    """A short label: no markdown, no article, up to the first break, `most` characters."""
    s = F.regexp_replace(F.trim(c), r"\*{1,3}([^*]+)\*{1,3}", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"`([^`]+)`", "$1"), r"^\*+", "")
    s = F.regexp_replace(s, r"(?i)^\s*(?:a|an|the)\s+", "")
    s = F.trim(F.regexp_replace(s, r"(?s)\s*(?:—|-{2,}|,|;|\.\s).*$", ""))
    return F.rtrim(F.substring(s, 1, most))


def triple(event_type: Column, description: Column) -> Column:
    """struct(operator, subject, object) of a description that has a plain structure, else null."""
    d = F.trim(F.coalesce(description, F.lit("")))

    def made(operator: str, subject: Column, obj: Column) -> Column:
        return F.struct(F.lit(operator).alias("operator"), subject.alias("subject"), obj.alias("object"))

    bare = F.regexp_replace(d, r"(?i)^(?:(?:we|you|this|it|the\s+[\w-]+|our\s+[\w-]+)\s+)?(?:(?:will|should|must|always|need\s+to|have\s+to)\s+)?", "")
    rejected = F.regexp_extract(bare, r"(?is)^(?:never|not|do\s+not|don't|must\s+not|cannot|can't|avoid\s+(?:using?\s+)?|no)\s+(.*)$", 1)
    prohibited = compact(rejected, 35)
    source = compact(F.regexp_extract(d, rf"(?iU)^(?:use\s+|utilize\s+){_NAME}\s+for\s+(.+?)$", 1), 25)
    target = compact(F.regexp_extract(d, rf"(?iU)^(?:use\s+|utilize\s+){_NAME}\s+for\s+(.+?)$", 2), 35)
    plain = compact(F.regexp_extract(d, rf"(?iU)^(?:use\s+|utilize\s+){_NAME}", 1), 25)
    verb = r"\b(?:uses?\s+|via\s+|implements?\s+|relies?\s+on\s+)"
    user = compact(F.regexp_extract(d, rf"(?isU)^{_NAME}\s+(?:.*?\s)??{verb}", 1), 25)
    used = compact(F.regexp_extract(d, rf"(?isU)^.*?{verb}(.*)$", 1), 35)
    before_dash = F.when(d.contains(" — "), F.substring_index(d, " — ", 1)).when(d.contains(" - "), F.substring_index(d, " - ", 1)).otherwise("")
    dead = F.when(compact(before_dash, 25) != "", compact(before_dash, 25)).when(F.char_length(d) <= 50, compact(d, 25)).otherwise("")
    none = F.lit("")
    return (
        F.when((event_type == "CONSTRAINT_HARD") & (prohibited != ""), made("¬", none, prohibited))
        .when((event_type == "DECISION") & (source != ""), made("→", source, target))
        .when((event_type == "DECISION") & (plain != ""), made("→", plain, none))
        .when((event_type == "DECISION") & (user != ""), made("→", user, used))
        .when(event_type.isin("APPROACH_ABANDONED_DO_NOT_RETRY", "APPROACH_ABANDONED") & (dead != ""), made("∅", dead, none))
    )


def compact_line(prefix: Column, description: Column, rationale: Column, structure: Column | None = None, desc_cap: int = 100, rationale_cap: int = 35) -> Column:
    """`PREFIX: text  # reason`, the text a triple where there is one."""
    text = F.rtrim(F.substring(F.coalesce(description, F.lit("")), 1, desc_cap))
    if structure is not None:
        core = F.concat_ws(" ", F.nullif(structure["subject"], F.lit("")), structure["operator"], F.nullif(structure["object"], F.lit("")))
        text = F.when(structure.isNotNull(), core).otherwise(text)
    reason = F.rtrim(F.substring(F.coalesce(rationale, F.lit("")), 1, rationale_cap))
    return F.concat(prefix, F.lit(": "), text, F.when(reason != "", F.concat(F.lit("  # "), reason)).otherwise(""))
