"""Substring and window dedup against brute force, with frequent keys routed both ways."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from recollect.llm import _packed, suffix_dedup, superkmer
from recollect.llm import suffix_array as suffix_array_module
from recollect.llm.suffix_array import suffix_array

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, row_hash string, spans string"


def corpus(seed):
    """Texts with shared passages, copies, repeats inside a text, nulls, blanks and one long run."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    shared = [" ".join(word() for _ in range(rng.randint(15, 140))) for _ in range(4)]
    rows = []
    for k in range(60):
        parts = [" ".join(word() for _ in range(rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            parts.append(rng.choice(shared))
            parts.append(rng.choice([" ", "\n", "  \t"]).join(word() for _ in range(rng.randint(0, 40))))
        rows.append((k, " ".join(parts)))
    rows += [(100, rows[3][1]), (101, rows[3][1] + " tail"), (102, None), (103, ""), (104, " \n "), (105, "x" * 3000), (106, "y " * 900), (107, "z" * 2000 + "x" * 900)]
    return [(i, t, "en", "clash", "clash") for i, t in rows]


def brute_substrings(rows, window):
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    seen = Counter(t[k : k + window] for _, t in texts for k in range(len(t) - window + 1))
    out = {}
    for i, t in texts:
        gone = np.zeros(len(t) + 1, dtype=bool)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out[i] = (len(t), int(gone.sum()), int((gone[:-1] < gone[1:]).sum() + gone[0]), hashlib.sha256(kept).hexdigest())
    return out


def brute_windows(rows, window):
    first, words = {}, {i: WORD.findall(t or "") for i, t, *_ in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), (i, k))
    out = {}
    for i, ws in words.items():
        gone = set()
        for k in range(len(ws) - window + 1):
            if first[tuple(ws[k : k + window])] < (i, k):
                gone |= set(range(k, k + window))
        kept = " ".join(w for k, w in enumerate(ws) if k not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("frequent, many", [(False, False), (True, False), (True, True)])
@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, monkeypatch, seed, frequent, many):
    rows = corpus(seed)
    if frequent:  # every anchor is, and with `many` groups around the same bytes are split up where they differ
        monkeypatch.setattr(suffix_dedup, "SAMPLE_ONE_IN", 1)
        monkeypatch.setattr(suffix_dedup, "FREQUENT", 1)
        monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 4000)  # blocks of different salts
        if many:
            monkeypatch.setattr(suffix_dedup, "MANY_STRINGS", 2)
    got = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA).repartition(5), digest=True).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept) for r in got} == brute_substrings(rows, 400)
    assert sum(r.n_removed for r in got) > 1000


@pytest.mark.parametrize("frequent", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_windows(spark, monkeypatch, seed, frequent):
    rows = corpus(seed)
    if frequent:
        monkeypatch.setattr(superkmer, "SAMPLE_ONE_IN", 1)
        monkeypatch.setattr(superkmer, "FREQUENT", 1)
        monkeypatch.setattr(superkmer, "BLOCK_BYTES", 4000)
    got = superkmer.dedup_windows(spark.createDataFrame(rows, SCHEMA).repartition(5), digest=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in got} == brute_windows(rows, 20)
    assert sum(r.n_removed for r in got) > 100


def test_repeated_rows_and_nulls(spark):
    text = " ".join(f"w{k}" for k in range(200))
    rows = [(1, text, "", "", ""), (1, text, "", "", ""), (None, text, "", "", ""), (5, "short", "", "", "")]
    windows = superkmer.dedup_windows(spark.createDataFrame(rows, SCHEMA)).collect()
    # the null id comes first; both rows of document 1 come after it and are one document
    assert sorted((str(r.doc_id), r.n_removed) for r in windows) == [("1", 200), ("1", 200), ("5", 0), ("None", 0)]
    found = suffix_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.n_removed) for r in found) == [("1", len(text)), ("1", len(text)), ("5", 0), ("None", len(text))]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.dedup_substrings(none).count() == 0
    assert superkmer.dedup_windows(none).count() == 0


def test_the_number_of_frequent_keys_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(_packed, "MOST_KEYS", 3)
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([9, 9, 9, 40, 50, 1, 2])], "value long, n long")
    assert _packed.frequent_keys(counts, 5).tolist() == [3, 4]
    assert _packed.frequent_keys(counts, 45).tolist() == [4]


@pytest.mark.parametrize("few, short", [(512, 1 << 17), (16, 8), (30, 40), (512, 8)])
def test_suffix_array_matches_sorting(monkeypatch, few, short):
    """With names written in digits, and recursions deeper than they need be."""
    monkeypatch.setattr(suffix_array_module, "FEW_NAMES", few)
    monkeypatch.setattr(suffix_array_module, "SHORT", short)
    rng = random.Random(3)
    for _ in range(60):
        k = rng.choice([1, 2, 3, 30])
        t = np.array([rng.randrange(k) for _ in range(rng.randint(1, 400))] * rng.choice([1, 3]))
        assert suffix_array(t, k).tolist() == sorted(range(len(t)), key=lambda i: t[i:].tolist())


@pytest.mark.parametrize("seed", [1, 2])
def test_shard_of_many_names_with_long_repeated_sentences(seed):
    """Over 1024 names, and suffixes equal far beyond the window: every range of a shard against brute force."""
    rng = random.Random(seed)
    noise = lambda n: bytes(rng.choice(b"abcdef") for _ in range(n))
    strings = [noise(2500) + noise(30) * 60 + noise(2500) for _ in range(25)]
    seen = Counter(s[k : k + 400] for s in strings for k in range(len(s) - 399))
    offs = np.concatenate(([0], np.cumsum([len(s) for s in strings])))
    got = [np.zeros(len(s), dtype=bool) for s in strings]
    for r, low, high in zip(*suffix_dedup._shard_repeats(b"".join(strings), offs, np.arange(len(strings)), 400)):
        got[r][low:high] = True
    for s, found in zip(strings, got):
        gone = np.zeros(len(s), dtype=bool)
        for k in range(len(s) - 399):
            if seen[s[k : k + 400]] > 1:
                gone[k : k + 400] = True
        assert np.array_equal(found, gone)
