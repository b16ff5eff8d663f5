"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its parts are short; each part is encoded alone, and neighbours are
joined by encoding a window around the cut again.  The window grows on either side, by
doubling, until its edge is a *stable cut*: a place where white space follows something
else.  With the patterns of `STABLE_PATTERNS` every match ends at a stable cut, whatever else
the text holds: no alternative that takes anything but white space goes on into white space,
and the only look-ahead follows white space.  So tokens outside the window are those of the
whole text.  Other patterns are refused.  Decoding concatenates up the same tree.

Null and empty texts have no tokens.  Very long texts cost a logarithmic factor at worst
(where they hold no white space at all).  Repeated rows have equal tokens, an empty table has
an empty result.  Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text

#: A text of more characters than this is halved.
LEAF_CHARS = 512
FIRST_WINDOW = 32
#: The splitting patterns for which stable cuts are proven above.
STABLE_PATTERNS = (
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
    r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""",
)
#: Narrower than either library's idea of white space, so that both agree on every cut.
_CUT = re.compile(r"(?<=\S)[ \t\n\r]")


class TreeBPE:
    """Encoder and decoder for one rank file; `leaf` is the largest part that is encoded at once."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF_CHARS):
        if pattern not in STABLE_PATTERNS:
            raise ValueError("no proof that tokens stabilise at white space with this pattern")
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.leaf = leaf
        self.token_bytes = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.token_bytes[rank] = len(token)

    def encode(self, text: str) -> np.ndarray:
        if len(text) <= self.leaf:
            return np.array(self.core.encode_ordinary(text), dtype="<u4")
        middle = len(text) // 2
        return self._join(text, middle, self.encode(text[:middle]), self.encode(text[middle:]))

    def _join(self, text: str, middle: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        a, b = _cut_before(text, middle), _cut_after(text, middle)
        if a == b:
            return np.concatenate((left, right))
        keep_left = len(left) - self._tokens_of(left[::-1], len(text[a:middle].encode()))
        drop_right = self._tokens_of(right, len(text[middle:b].encode()))
        window = np.array(self.core.encode_ordinary(text[a:b]), dtype="<u4")
        return np.concatenate((left[:keep_left], window, right[drop_right:]))

    def _tokens_of(self, ids: np.ndarray, n_bytes: int) -> int:
        """How many leading ids make up exactly n_bytes."""
        if not n_bytes:
            return 0
        done = np.cumsum(self.token_bytes[ids[:n_bytes]])
        k = int(np.searchsorted(done, n_bytes))
        if k >= len(done) or done[k] != n_bytes:
            raise AssertionError("a stable cut is inside a token")
        return k + 1

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self.leaf:
            return self.core.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _cut_before(text: str, middle: int) -> int:
    """The last stable cut at or before middle, or 0, looked for in a growing window."""
    width = FIRST_WINDOW
    while True:
        low = max(0, middle - width)
        found = None
        for found in _CUT.finditer(text, low + 1 if low else 0, middle + 1):
            pass
        if found and found.start() > 0:
            return found.start()
        if not low:
            return 0
        width *= 2


def _cut_after(text: str, middle: int) -> int:
    """The first stable cut at or after middle, or the end, looked for in a growing window."""
    width, low = FIRST_WINDOW, middle
    while low < len(text):
        found = _CUT.search(text, low, middle + width)
        if found:
            return found.start()
        low, width = middle + width, 2 * width
    return len(text)


@lru_cache(maxsize=4)
def tokenizer(ranks_path: str, pattern: str, leaf: int = LEAF_CHARS) -> TreeBPE:
    """One encoder per process and rank file."""
    return TreeBPE(ranks_path, pattern, leaf)


def encode_documents(documents: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, ids (array of int), decoded (binary): every row's tokens and what they decode to."""

    def run(batches):
        tree = tokenizer(ranks_path, pattern)
        for batch in batches:
            ids = [tree.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.record_batch(
                [batch.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())), pa.array([tree.decode(x) for x in ids], pa.binary())],
                names=[id_col, "ids", "decoded"],
            )

    chosen = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return chosen.mapInArrow(_text.frugal(run), f"{id_col} long, ids array<int>, decoded binary")


def digests(documents: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, digested where the tokens are made; asked for, the ids themselves too."""

    def run(batches):
        tree = tokenizer(ranks_path, pattern)
        for batch in batches:
            n, of_ids, of_text, all_ids = [], [], [], []
            for text in batch.column(1).to_pylist():
                ids = tree.encode(text or "")
                n.append(len(ids))
                of_ids.append(hashlib.sha256(ids.tobytes()).hexdigest())
                of_text.append(hashlib.sha256(tree.decode(ids)).hexdigest())
                all_ids += [ids.astype(np.int32)] * with_ids
            cols = {id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
            yield pa.record_batch(cols | ({"ids": pa.array(all_ids, pa.list_(pa.int32()))} if with_ids else {}))

    chosen = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return chosen.mapInArrow(_text.frugal(run), f"{id_col} long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
