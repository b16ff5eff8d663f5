"""Column functions on statements of our own, and against plain Python on drawn strings."""

import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from recollect.functions import paths, sanitize, similarity, statements, text, weights


def column(spark, values, make, kind="string"):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}").select("k", make(F.col("v")).alias("x")).collect()
    return [r.x for r in sorted(rows)]


def drawn(seed, n=120):
    rng = random.Random(seed)
    words = ["never", "use", "the", "Redis", "caches", "naïve", "a", "orders!", "42", "do not", "cannot", "we will", "it's", "(x)", "\t", "—", "status", "glass"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(n)]


def test_overlap_tokens(spark):
    values = drawn(1)
    plain = [list(dict.fromkeys(t for t in re.sub(r"[^\w\s]", " ", v.lower()).split() if len(t) > 2 and t not in text.STOPWORDS)) for v in values]
    assert column(spark, values, text.overlap_tokens) == plain


def test_content_hash_is_that_of_compact_ascii_json(spark):
    values = [*drawn(2), 'say "naïve" \\ now', "emoji \U0001f600", "We will  not"]

    def key(v):
        v = v.lower()
        for a, b in text.CONTRACTIONS:
            v = v.replace(a, b)
        return re.sub(r"\s+", " ", re.sub(r"""[,.;:!?'"()\[\]{}]""", "", v)).strip()

    plain = [hashlib.sha256(json.dumps({"event_type": "DECISION", "key_phrase": key(v)}, sort_keys=True, separators=(",", ":")).encode()).hexdigest() for v in values]
    assert column(spark, values, lambda c: text.content_hash(F.lit("DECISION"), c)) == plain


@pytest.mark.parametrize(
    "said, expected",
    [
        ("note that  retries are capped", "Retries are capped."),
        ("Make sure that X holds!", "X holds!"),
        ("  ", ""),
        ("FYI: ok?", "Ok?"),
        ("already fine.", "Already fine."),
    ],
)
def test_normalise_description(spark, said, expected):
    once = column(spark, [said], text.normalise_description)
    assert once == [expected] and column(spark, once, text.normalise_description) == once


def test_truncation(spark):
    long = "One two three. Four five six seven eight nine ten."
    assert column(spark, [long, "short", "x" * 50, "aaa bbb ccc ddd eee fff ggg hhh"], lambda c: text.smart_truncate(c, 20)) == ["One two three.", "short", "x" * 19 + "…", "aaa bbb ccc ddd eee…"]
    assert column(spark, [long, "no end here at all " * 3], lambda c: text.keep_whole(c, 20)) == ["One two three.", "no end here at all " * 3]


@pytest.mark.parametrize(
    "said, expected",
    [
        ("Use Redis for the session cache, instead of memory", "session cache"),
        ("We'll use Argon2 as our password hash", "password hash"),
        ("Switch the deploys to the blue cluster.", "blue cluster"),
        ("Never use floats anywhere", "floats"),
        ("The sky is clear", ""),
    ],
)
def test_derive_subject(spark, said, expected):
    assert column(spark, [said], text.derive_subject) == [expected]


def test_keys(spark):
    assert column(spark, ["The default aliases", "alias default", "Retry policies: glass status"], text.normalise_key) == ["aliase default", "alias default", "glass policie retry status"]
    assert column(spark, ["Cost unit: cents", "Note: careful", "One two three four five: x", "Retry — twice"], text.label_prefix) == ["Cost unit", "", "", "Retry"]
    key = lambda c: text.decision_key(F.lit("DECISION"), F.lit(""), c)
    assert column(spark, ["Use Kafka for event transport", "Key format: uuid"], key) == ["event transport", "format key"]
    assert column(spark, ["Use Kafka for event transport"], lambda c: text.decision_key(F.lit("THREAD_OPEN"), F.lit("x"), c)) == [""]


def test_small_pieces(spark):
    assert column(spark, ["the rate-limit and 42 no ab ab12 ab12"], text.query_terms) == [["rate-limit", "42", "ab12"]]
    assert column(spark, ["", "abc", "a" * 41], text.count_tokens) == [0, 1, 10]
    assert column(spark, [["migrations", "settings", "policies", "added", "uses", "bus"]], text.fold_stems, "array<string>") == [["migrate", "setting", "policy", "added", "uses", "bus"]]
    assert column(spark, ["x"], lambda c: text.head_input(c, F.lit("User"), F.lit("before"))) == ["[user] before || x"]
    assert column(spark, ["x"], lambda c: text.head_input(c, F.lit("robot"), F.lit(""))) == ["x"]
    assert column(spark, ["The JWT secret.", "an an item"], text.normalise_subject) == ["jwt secret", "item"]
    assert column(spark, ["p"], lambda c: text.cache_key(c, F.lit("src"), F.lit(None))) == [hashlib.sha256(b"p\0src\0").hexdigest()[:24]]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_similarity_against_plain_python(spark):
    rng, values = random.Random(5), drawn(6, 60)
    pairs = [(v, rng.choice(values)) for v in values] + [(v, v.replace("e", "i", 1)) for v in values]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    rows = df.select("k", similarity.overlap(F.col("a"), F.col("b")).alias("o"), similarity.edit_distance(F.col("a"), F.col("b")).alias("d")).collect()

    def tokens(v):
        return {t for t in re.sub(r"[^\w\s]", " ", v.lower()).split() if len(t) > 2 and t not in text.STOPWORDS}

    for r in rows:
        a, b = pairs[r.k]
        x, y = a.lower().strip(" "), b.lower().strip(" ")
        d = 0.0 if x == y else 1.0 if not x or not y else levenshtein(x, y) / max(len(x), len(y))
        s, t = tokens(a), tokens(b)
        j = len(s & t) / len(s | t) if s and t else 0.0
        assert abs(r.d - d) < 1e-12 and r.o == (j >= 0.6 or d <= 0.15), (a, b)


def test_paths(spark):
    given = [None, " ", "./a//b.py", "a\\b\\", "/etc/x", "C:/x", "../up", "a/../b", ".", "a.py"]
    assert column(spark, given, paths.canonical_path) == ["", "", "a/b.py", "a/b", "", "", "", "", "", "a.py"]
    rooted = lambda c: paths.canonical_path(c, F.lit("/home/me/p/"))
    assert column(spark, ["/home/me/p/src/a.py", "/home/me/other", "src/a.py"], rooted) == ["src/a.py", "", "src/a.py"]
    assert column(spark, ["src/auth/x.py", "lib/order_service.py", "api/tests/x.py", "main.go"], paths.path_intent) == ["authentication", "service layer", "API routes", "main.go"]
    assert column(spark, ["a/b.py", "a/__init__.py", "a-b/c.py", "x.ts"], paths.module_of) == ["a.b", "a", "", ""]
    assert column(spark, ["/mnt/c/Work/P/", "C:\\Work\\P"], paths.project_key) == ["c:/work/p", "c:/work/p"]


def test_statements(spark):
    given = ["## Plan:", "**Storage**:", "A sentence.", "one two three four five six seven eight nine ten eleven:"]
    assert column(spark, given, statements.is_structural_label) == [True, True, False, False]
    assert column(spark, ["Retries: three", "We: agree", "Lower: x", "Port: 80,", "A b c d e: x"], statements.is_label_value) == [True, False, True, False, False]
    hard = lambda c: statements.triple(F.lit("CONSTRAINT_HARD"), c)
    got = column(spark, ["We must never issue SQL DELETE, ever", "All is well"], hard)
    assert (got[0].operator, got[0].subject, got[0].object) == ("¬", "", "issue SQL DELETE") and got[1] is None
    chosen = lambda c: statements.triple(F.lit("DECISION"), c)
    got = column(spark, ["Use Redis for the job queue", "Use Postgres", "Auth relies on signed cookies"], chosen)
    assert [(x.subject, x.object) for x in got] == [("Redis", "job queue"), ("Postgres", ""), ("Auth", "signed cookies")]
    dead = lambda c: statements.triple(F.lit("APPROACH_ABANDONED"), c)
    assert column(spark, ["Polling — latency", "x" * 60], dead)[0].subject == "Polling" and column(spark, ["x" * 60], dead) == [None]
    line = lambda c: statements.compact_line(F.lit("DEC"), c, F.lit("because"))
    assert column(spark, ["Use it"], line) == ["DEC: Use it  # because"]


def test_weights(spark):
    assert column(spark, [0, 1, 10, -3], weights.recency_factor, "int") == pytest.approx([1, 1 / 1.15, 1 / 2.5, 1])
    assert column(spark, [0, 1, 5], weights.repetition_factor, "int") == pytest.approx([1, 1, 1.4828313], rel=1e-6)
    assert column(spark, [[], ["stable", "in_flux"], ["odd", None]], weights.activity_factor, "array<string>") == [1.0, 2.0, 1.0]
    assert column(spark, [None, 0.0, 0.2], lambda c: weights.centrality_factor(c, F.lit(0.4)), "double") == [1.0, 0.5, 1.0]


def test_sanitise(spark):
    given = [
        "User: **Use** `redis` [docs](http://x) _now_",
        "> ## Heading\n- item ~~old~~\n```python\ncode()\n```\nafter",
        "| a | b |\n|---|---|\nkept",
        "S1 | |---|---| | never store card numbers in plain text | why",
        "str | None stays",
        None,
        "\ufeff\ufeffhuman : a**b__c\r\nd\u2028```` x ```\ninside\n| still inside |",
        "snake_case and *args, **kwargs; ***all*** of __it__\n- \n#5 isn't a heading\n\n> > quoted twice",
        "```\nno name\n```\n```\n```\nout | | again",
    ]
    assert column(spark, given, sanitize.description) == [
        "Use redis docs now", "Heading item old [code: python] after", "kept", "never store card numbers in plain text", "str | None stays", "",
        "ab__c d [code: x ```]", "snake_case and *args, kwargs; *all of it #5 isn't a heading quoted twice", "",
    ]
