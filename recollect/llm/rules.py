"""Quality rules from repetition: characters inside duplicated n-grams and lines.

Word n-grams of several lengths are hashed from rolling hashes of runs of 1, 2, 4 and 8 words
(numpy, one pass per length), and a document's duplicated n-grams are found by sorting the
hashes of its block; n-grams and lines whose hashes agree are compared byte by byte.  An n-gram of five words or more can only be duplicated where its three-word
grams are, so the longer lengths look at those places alone.

Null, empty and blank texts have no words: they fail the base rule and aren't kept.  Long
texts are measured whole.  Repeated rows are measured alike; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text

MIN_WORDS = 50
REPEAT_PERCENT = 50
#: Most of the word characters that may lie in n-grams found twice or more, by n.
GRAM_LIMITS = {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30}
#: Most of the word characters that may lie in lines equal to an earlier line.
LINE_CHARS_LIMIT = 0.30
SYMBOLS = b"#*$%&|<>"
SYMBOLS_PER_WORD_LIMIT = 0.25
_SYMBOL = _text.byte_class(SYMBOLS)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "gram_coverage array<double>, dup_line_coverage double, base_failed boolean, kept boolean"
)


def _duplicated(hashes: np.ndarray, rows: np.ndarray, same) -> np.ndarray:
    """True where a row has the same item more than once; same(items, others) compares their bytes."""
    key = _text.mix(hashes ^ (rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    late, lead = _text.leaders(key, lambda a, b: (rows[a] == rows[b]) & same(a, b))
    out = np.zeros(len(key), dtype=bool)
    out[late] = out[lead] = True
    return out


def _inside(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    return _text.covered(n, starts, starts + width)


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of the rows of one block of bytes."""
    rows = len(offs) - 1
    starts, ends, woffs = _text.word_bounds(buf, offs, _text.NON_SPACE)
    owner = _text.owners(woffs)
    n_words = np.diff(woffs)
    points = np.concatenate(([0], np.cumsum(_text.code_points(buf), dtype=np.int64)))
    chars = points[ends] - points[starts]
    word_chars = _text.per_row_sum(chars, woffs)
    n_symbols = _text.per_row_sum(_SYMBOL[buf], offs)

    # lines with a word: the bytes between the line feeds around a word
    breaks = np.flatnonzero(buf == 0x0A)
    k = np.searchsorted(breaks, starts)
    low = np.maximum(offs[owner], np.where(k > 0, breaks[np.maximum(k - 1, 0)] + 1 if len(breaks) else 0, 0))
    high = np.minimum(offs[owner + 1], np.where(k < len(breaks), breaks[np.minimum(k, len(breaks) - 1)], len(buf)) if len(breaks) else len(buf))
    head = np.ones(len(starts), dtype=bool)
    head[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    head = np.flatnonzero(head)
    line_row, low, high = owner[head], low[head], high[head]
    eights = _text.loads8(_text.padded(buf))

    def equal_bytes(x, y, size, other_size):
        equal = size == other_size
        equal[equal] = _text.same_ranges(eights, x[equal], eights, y[equal], size[equal])
        return equal

    key = _text.mix(_text.byte_hashes(buf, low, high) ^ (line_row.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    late, _ = _text.leaders(key, lambda a, b: (line_row[a] == line_row[b]) & equal_bytes(low[a], low[b], (high - low)[a], (high - low)[b]))
    dup_line = np.zeros(len(head), dtype=bool)
    dup_line[late] = True
    n_dup_lines = np.bincount(line_row[dup_line], minlength=rows)
    line_chars = np.diff(np.append(np.concatenate(([0], np.cumsum(chars)))[head], chars.sum())) if len(head) else np.zeros(0, np.int64)
    dup_line_chars = np.bincount(line_row[dup_line], weights=line_chars[dup_line], minlength=rows)

    word_hash, size = _text.byte_hashes(buf, starts, ends), ends - starts

    def dup_starts(n: int, among: np.ndarray) -> np.ndarray:
        among = among[among + n <= len(word_hash)]
        among = among[owner[among] == owner[among + n - 1]]

        def same(a, b):
            equal, a, b = np.ones(len(a), dtype=bool), among[a], among[b]
            for k in range(n):
                equal &= equal_bytes(starts[a + k], starts[b + k], size[a + k], size[b + k])
            return equal

        return among[_duplicated(_text.gram_hashes(word_hash, n)[among], owner[among], same)]

    threes = dup_starts(3, np.arange(len(word_hash)))
    n_repeat = _text.per_row_sum(_inside(len(word_hash), threes, 3), woffs)
    is_three = np.zeros(len(word_hash) + 1, dtype=bool)
    is_three[threes] = True
    safe = np.maximum(word_chars, 1)
    coverage = []
    for n in GRAM_LIMITS:
        among = threes[threes + n - 3 <= len(word_hash)]
        found = dup_starts(n, among[is_three[among + n - 3]])
        coverage.append(_text.per_row_sum(np.where(_inside(len(word_hash), found, n), chars, 0), woffs) / safe)
    coverage = np.stack(coverage, axis=1)
    line_coverage = dup_line_chars / safe
    base_failed = (n_words < MIN_WORDS) | (100 * n_repeat > REPEAT_PERCENT * n_words)
    verdict = (coverage <= np.array(list(GRAM_LIMITS.values()))).all(axis=1) & (line_coverage <= LINE_CHARS_LIMIT) & (n_symbols <= SYMBOLS_PER_WORD_LIMIT * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
        "gram_coverage": coverage,
        "dup_line_coverage": line_coverage,
        "base_failed": base_failed,
        "kept": ~base_failed & verdict,
    }


def quality_rules(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per row of documents, in the columns of SCHEMA."""

    def run(batches):
        for batch in batches:
            buf, offs = _text.flat(batch.column(1))
            for i, j in _text.slices(offs):
                m = measure(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                coverage = pa.array(m.pop("gram_coverage").tolist(), pa.list_(pa.float64()))
                cols = {k: pa.array(v.astype(np.int64) if v.dtype.kind in "iu" else v) for k, v in m.items()}
                cols = {"doc_id": batch.column(0)[i:j], "gram_coverage": coverage} | cols
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.record_batch([cols[k] for k in names], names=names)

    chosen = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(_text.frugal(run), SCHEMA)
