"""Similarity of descriptions, and the tests of one replacing another."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import derive_subject, overlap_tokens

# Fixed values.
SAME_JACCARD, SAME_EDITS = 0.6, 0.15
SUBJECT_JACCARD = 0.3
ECHO_JACCARD = 0.85
SAME_COSINE = 0.75


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays without repeats; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def edit_distance(a: Column, b: Column) -> Column:
    """Edits over the longer length, after trimming and lower-casing: 0 equal, 1 if one is empty."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(a == b, 0.0).when((a == "") | (b == ""), 1.0).otherwise(F.levenshtein(a, b) / longest)


def edits_within(a: Column, b: Column, share: float = SAME_EDITS) -> Column:
    """edit_distance <= share, computed only where the lengths allow it."""
    a, b = F.lower(F.trim(a)), F.lower(F.trim(b))
    n, m = F.char_length(a), F.char_length(b)
    longest = F.greatest(n, m)
    bound = F.floor(longest * F.lit(share)).cast("int")
    return F.when(a == b, True).when((n == 0) | (m == 0) | (F.abs(n - m) > bound), False).otherwise(F.levenshtein(a, b) <= bound)


def overlap(desc_a: Column, desc_b: Column, tokens_a: Column | None = None, tokens_b: Column | None = None) -> Column:
    """The same statement in other words: enough shared tokens, else few enough edits."""
    tokens_a = overlap_tokens(desc_a) if tokens_a is None else tokens_a
    tokens_b = overlap_tokens(desc_b) if tokens_b is None else tokens_b
    return F.when(jaccard(tokens_a, tokens_b) >= SAME_JACCARD, True).otherwise(edits_within(desc_a, desc_b))


def same_subject(desc_a: Column, desc_b: Column) -> Column:
    """Both texts tell the same topic and share some tokens."""
    a = derive_subject(desc_a)
    return (a != "") & (a == derive_subject(desc_b)) & (jaccard(overlap_tokens(desc_a), overlap_tokens(desc_b)) >= SUBJECT_JACCARD)


def supersedes(desc_a: Column, desc_b: Column) -> Column:
    return overlap(desc_a, desc_b) | same_subject(desc_a, desc_b)


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors in double precision."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
