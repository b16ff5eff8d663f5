"""Text normalisation as column expressions, all inside the JVM.

Patterns are Unicode-aware (`(?U)`): words hold letters of any alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.schemas import CHOICE_FAMILY

# Word lists, patterns and limits that results depend on.
STOPWORDS = (
    "a", "an", "the", "is", "it", "in", "on", "at", "to", "for", "of", "and", "or", "but", "not", "we", "our", "can", "will",
    "are", "was", "be", "been", "has", "have", "had", "do", "does", "did", "no", "its", "use", "used", "using", "so", "that",
    "this", "with", "from", "as", "by", "if", "up", "out", "any",
)
CONTRACTIONS = (
    ("we will", "we'll"), ("cannot", "can't"), ("do not", "don't"), ("will not", "won't"), ("is not", "isn't"), ("are not", "aren't"),
    ("does not", "doesn't"), ("did not", "didn't"), ("have not", "haven't"), ("has not", "hasn't"), ("should not", "shouldn't"),
    ("would not", "wouldn't"), ("could not", "couldn't"), ("must not", "mustn't"),
)
PROMPT_PREFIXES = (
    "Open a work thread: ", "Open a thread: ", "Note that ", "Make sure ", "Make sure that ", "Please make sure ", "Please confirm ",
    "Please remember ", "Please note ", "Confirm ", "Establish ", "Record ", "Lock in ", "Decide ", "Reminder: ", "Remember: ", "FYI: ",
)
LABEL_STOPWORDS = (
    "note", "example", "warning", "important", "remember", "see", "however", "result", "summary", "update", "edit", "fix", "todo",
    "caveat", "answer", "question", "step", "output", "input", "error", "before", "after", "now", "new", "old", "change", "changes",
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "first", "second", "third",
)
STEM_FOLDS = (("ations", "ate"), ("ation", "ate"), ("ments", "ment"), ("ings", "ing"), ("ing", ""), ("edly", ""), ("ies", "y"), ("ed", ""), ("es", ""), ("s", ""))
CHOICE_VERB = r"(?:use|using|adopt\w*|choos\w*|chose|switch\w*|stick\w*\s+with|go\w*\s+with|prefer\w*|replac\w*|will\s+use|going\s+to\s+use|we'?ll\s+use)"
TOPIC_END = r"(?:\binstead\b|\brather\b|\bbecause\b|\bsince\b|[.,;:]|$)"
REJECTED_THING = r"\b(?:never\s+use|do\s+not\s+use|don'?t\s+use|avoid|abandon\w*|drop|reject\w*)\s+([a-z0-9][\w./+-]*)"
ARTICLES = r"(?:the|a|an|our|this|that|these|those)"
MAX_QUERY_TERMS = 12
MAX_KEY_TERMS = 4


def lit_list(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def words(c: Column) -> Column:
    """Lower-cased words, punctuation as spaces."""
    return F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")), " ")


def is_content(t: Column) -> Column:
    return (F.char_length(t) > 2) & ~t.isin(*STOPWORDS)


def overlap_tokens(c: Column) -> Column:
    """The set of words over two letters that aren't stopwords, in order of first occurrence."""
    return F.array_distinct(F.filter(words(F.coalesce(c, F.lit(""))), is_content))


def fold_stems(tokens: Column) -> Column:
    """Tokens over four letters with the first matching suffix folded, if four letters are left; distinct."""

    def fold(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for suffix, into in reversed(STEM_FOLDS):
            fits = t.endswith(suffix) & (F.char_length(t) - len(suffix) + len(into) >= 4)
            out = F.when(fits, F.concat(F.substring(t, F.lit(1), F.char_length(t) - len(suffix)), F.lit(into))).otherwise(out)
        return F.when(F.char_length(t) > 4, F.coalesce(out, t)).otherwise(t)

    return F.array_distinct(F.transform(tokens, fold))


def normalise_for_hash(c: Column) -> Column:
    out = F.lower(c)
    for long, short in CONTRACTIONS:
        out = F.replace(out, F.lit(long), F.lit(short))
    out = F.regexp_replace(out, r"""[,.;:!?'"()\[\]{}]""", "")
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def json_string(c: Column) -> Column:
    """c as a JSON string of ASCII alone: what is not goes as \\uXXXX, beyond the first plane as two of them."""
    short = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))

    def ascii_only(run: Column) -> Column:
        wide = F.regexp_replace(F.lower(F.hex(F.encode(run, "UTF-16BE"))), "(.{4})", r"\\u$1")
        return F.when(run.rlike(r"^[\x20-\x7f]"), run).otherwise(wide)

    plain = short.rlike(r"^[\x20-\x7f]*$")
    runs = F.regexp_extract_all(short, F.lit(r"([\x20-\x7f]+|[^\x20-\x7f]+)"), F.lit(1))
    return F.concat(F.lit('"'), F.when(plain, short).otherwise(F.array_join(F.transform(runs, ascii_only), "")), F.lit('"'))


def content_hash(event_type: Column, description: Column) -> Column:
    """SHA-256 of the compact JSON of type and normalised description; restatements share it."""
    key = normalise_for_hash(F.coalesce(description, F.lit("")))
    return F.sha2(F.concat(F.lit('{"event_type":'), json_string(event_type), F.lit(',"key_phrase":'), json_string(key), F.lit("}")), 256)


#: What SQL's trim takes off: Unicode's separators of words.
_BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _capital(letter: Column) -> Column:
    """A character in upper case, one for one: what only several letters could stand for stays, but for the sharp s."""

    def one(ch: Column) -> Column:
        upper, title = F.upper(ch), F.initcap(ch)
        return F.when(ch == "ß", "ẞ").when(F.char_length(upper) == 1, upper).when(F.char_length(title) == 1, title).otherwise(ch)

    return F.get(F.transform(F.array(letter), one), F.lit(0))  # the letter is named often, but evaluated once


def normalise_description(c: Column, spaces: str = r"(?U)\s") -> Column:
    """One prompt-verb prefix off (the longest that fits), first letter capital, white space single, a full stop at the end.

    spaces: the pattern of a character of white space; all of Unicode's unless told otherwise.
    """
    prefixes = "|".join(rf"\Q{p}\E" for p in sorted(PROMPT_PREFIXES, key=len, reverse=True))
    trimmed = lambda s: F.trim(s, F.lit(_BLANKS))
    bare = trimmed(F.regexp_replace(trimmed(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{spaces}+", " ")), rf"(?iu)^(?:{prefixes})", ""))

    def sentence(s: Column) -> Column:
        said = F.concat(_capital(F.substring(s, 1, 1)), F.substring(s, F.lit(2), F.char_length(s)))
        return F.when(s == "", s).when(s.rlike(r"[.!?]\z"), said).otherwise(F.concat(said, F.lit(".")))

    return F.get(F.transform(F.array(bare), sentence), F.lit(0))  # as above


def _last_terminator(window: Column) -> Column:
    """1-based place of the last of `.!?`, 0 if there is none."""
    return F.char_length(F.regexp_extract(window, r"(?s)^(.*[.!?])", 1))


def smart_truncate(c: Column, most: int, ellipsis: str = "…") -> Column:
    """At most `most` characters: to a sentence's end in the back half, else to a word's, else cut."""
    if most < 4:
        return F.substring(c, 1, most)
    stop = _last_terminator(F.substring(c, 1, most))
    body = most - len(ellipsis)
    at_word = F.regexp_extract(F.substring(c, 1, body + 1), r"(?s)^(.+) ", 1)
    return (
        F.when(F.char_length(c) <= most, c)
        .when(stop - 1 >= most // 2, F.substring(c, F.lit(1), stop))
        .when(at_word != "", F.concat(F.rtrim(at_word), F.lit(ellipsis)))
        .otherwise(F.concat(F.substring(c, 1, body), F.lit(ellipsis)))
    )


def keep_whole(c: Column, most: int) -> Column:
    """Never cut inside a sentence: to the last sentence's end within `most`, else whole."""
    stop = _last_terminator(F.substring(c, 1, most))
    return F.when((F.char_length(c) > most) & (stop > 1), F.substring(c, F.lit(1), stop)).otherwise(c)


def normalise_subject(c: Column) -> Column:
    """Lower case, no punctuation, single spaces, no leading articles."""
    s = F.array_join(words(F.coalesce(c, F.lit(""))), " ")
    return F.regexp_replace(s, rf"^(?:{ARTICLES}\s+)+", "")


def _topic(c: Column) -> Column:
    """A topic without its leading article, stopwords and short words."""
    s = F.regexp_replace(F.array_join(words(c), " "), rf"^{ARTICLES}\s+", "")
    return F.array_join(F.filter(F.split(s, " "), is_content), " ")


def derive_subject(c: Column) -> Column:
    """What a choice or prohibition is about, by its wording; empty if that doesn't tell."""
    c = F.coalesce(c, F.lit(""))
    tail = rf"([a-z0-9][\w +./-]*?)\s*{TOPIC_END}"
    purpose = _topic(F.regexp_extract(c, rf"(?iU)\b(?:for|as)\s+{tail}", 1))
    target = _topic(F.regexp_extract(c, rf"(?iU)\b{CHOICE_VERB}\b[\w './+-]*?\b(?:to|in)\s+{tail}", 1))
    thing = _topic(F.regexp_extract(c, rf"(?iU){REJECTED_THING}", 1))
    chosen = F.when(c.rlike(rf"(?iU)\b{CHOICE_VERB}\b"), F.coalesce(F.nullif(purpose, F.lit("")), target)).otherwise("")
    return F.coalesce(F.nullif(chosen, F.lit("")), thing)


def normalise_key(c: Column) -> Column:
    """Up to four content words, plain plurals singular, sorted."""

    def single(t: Column) -> Column:
        plural = (F.char_length(t) > 4) & t.endswith("s") & ~t.rlike("(?:ss|us|is|as|os)$")
        return F.when(plural, F.substring(t, F.lit(1), F.char_length(t) - 1)).otherwise(t)

    kept = F.transform(F.filter(words(F.coalesce(c, F.lit(""))), is_content), single)
    return F.array_join(F.slice(F.array_sort(F.array_distinct(kept)), 1, MAX_KEY_TERMS), " ")


def label_prefix(c: Column) -> Column:
    """A leading label of one to four words before a colon or dash, unless it opens a sentence."""
    label = F.trim(F.regexp_extract(F.trim(F.coalesce(c, F.lit(""))), r"(?U)^([A-Za-z_][\w .()/+-]{0,40}?)\s*[:—]\s+\S", 1))
    parts = F.split(label, r"\s+")
    lead = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"^[.,]+|[.,]+$", "")
    return F.when((F.size(parts) <= 4) & ~lead.isin(*LABEL_STOPWORDS), label).otherwise("")


def decision_key(event_type: Column, subject: Column, description: Column, triple: Column | None = None) -> Column:
    """The topic of a choice: its subject, its triple, its wording or its label, whichever comes first; else empty."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    steps = [blank(subject)]
    if triple is not None:
        steps.append(F.when(triple["operator"] == "¬", F.coalesce(blank(triple["object"]), blank(triple["subject"]))).otherwise(blank(triple["subject"])))
    steps += [blank(derive_subject(description)), blank(label_prefix(description))]
    return F.when(event_type.isin(*CHOICE_FAMILY), normalise_key(F.coalesce(*steps))).otherwise("")


def query_terms(c: Column) -> Column:
    """The first twelve distinct search terms: no stopwords, two letters only where all are digits."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"([a-z0-9_][a-z0-9_\-]*)"), 1)
    useful = F.filter(found, lambda t: ((F.char_length(t) > 2) | t.rlike(r"^\d+$")) & ~t.isin(*STOPWORDS))
    return F.slice(F.array_distinct(useful), 1, MAX_QUERY_TERMS)


def count_tokens(c: Column) -> Column:
    """A quarter of the characters, one at least, none for an empty text."""
    n = F.char_length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def event_tokens(event_type: Column, description: Column, rationale: Column, path: Column, files: Column) -> Column:
    """The tokens of an event's visible fields."""
    blank = lambda c: F.nullif(c, F.lit(""))
    listed = F.when(F.size(F.coalesce(files, F.array().cast("array<string>"))) > 0, F.array_join(F.slice(files, 1, 5), ", "))
    return F.greatest(F.lit(1), count_tokens(F.concat_ws(" | ", event_type, blank(description), blank(rationale), blank(path), listed)))


def embedding_input(event_type: Column, subject: Column, description: Column, path: Column, intent: Column, status: Column) -> Column:
    """The text that stands for an event in vector search."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    component = F.concat_ws(" — ", blank(path), F.coalesce(blank(intent), blank(status)), blank(description))
    return F.when(event_type == "COMPONENT_STATUS", component).otherwise(F.concat_ws(": ", blank(subject), blank(description)))


def cache_key(pattern: Column, path: Column, glob: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\0", F.coalesce(pattern, F.lit("")), F.coalesce(path, F.lit("")), F.coalesce(glob, F.lit(""))), 256), 1, 24)


def head_input(text: Column, role: Column, previous: Column) -> Column:
    """What a classifier of sentences reads: `[role] previous || text`, without what is missing."""
    r = F.trim(F.lower(F.coalesce(role, F.lit(""))))
    p = F.trim(F.coalesce(previous, F.lit("")))
    lead = F.when(r.isin("user", "assistant"), F.concat(F.lit("["), r, F.lit("] "))).otherwise("")
    return F.concat(lead, F.when(p != "", F.concat(p, F.lit(" || "))).otherwise(""), F.trim(F.coalesce(text, F.lit(""))))


def near_dup_signature(c: Column) -> Column:
    """Equal for texts with the same content words."""
    return F.array_join(F.array_sort(overlap_tokens(c)), " ")
