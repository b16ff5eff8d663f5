"""Substring dedup over word windows, by super-k-mer partitioning.

Each window of 20 words has a minimiser, the smallest hash of its four-word grams.
Consecutive windows of a text with one minimiser travel as one packed string to the bucket
of that minimiser, so equal windows meet.  A bucket sorts its windows, compares the bytes
of those whose hashes agree, and reports every window that isn't the first of its kind in
(doc_id, start) order.  Removed words come back to their document as spans.

Skew.  A task first drops windows that repeat one of its own block: their first occurrence
travels, they are reported as they are.  Minimisers that a sample of documents shows to be
very frequent are routed otherwise: their windows go singly by the whole window's hash, and
meet twice, first those of blocks with the same salt, then the first occurrence of each salt.
So a window that is everywhere sends one record a block to many buckets, and one record a
salt to the last.  The sample decides where windows meet, never whether.

A null doc_id sorts first; rows that repeat a doc_id and text are one document and share a
result; rows that share a doc_id only are told apart by a hash of the text, and neither of
two windows at equal (doc_id, start) is earlier.  Null, empty and blank texts have no words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _packed, _text
from recollect.llm._spark import buckets_for, keyed, with_spans

WINDOW = 20
GRAM = 4
BUCKET_BYTES = 6 << 20
BLOCK_BYTES = 1 << 20
#: One document in so many is looked at for frequent minimisers; as often in the sample makes one frequent.
SAMPLE_ONE_IN, FREQUENT = 64, 64


class Block:
    """Words of some texts, joined by single spaces, one text per line."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.starts, self.ends, self.woffs, self.hash = _text.hashed_words(buf, offs, _text.NON_SPACE)
        self.owner = _text.owners(self.woffs)

    def windows(self, width: int) -> np.ndarray:
        """First words of all windows that lie in one text."""
        i = np.arange(max(0, len(self.owner) - width + 1))
        return i[self.owner[i] == self.owner[i + width - 1]]


def normalised(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with one space between words and a line feed after the last, and their offsets; no byte is looked at twice."""
    parts = [b" ".join(buf[a:b].tobytes().split()) + b"\n" for a, b in zip(offs[:-1].tolist(), offs[1:].tolist())]
    out = np.zeros(len(parts) + 1, dtype=np.int64)
    np.cumsum([len(p) for p in parts], out=out[1:])
    return np.frombuffer(b"".join(parts) + bytes(8), dtype=np.uint8), out


def _late(hashes: np.ndarray, row_id: np.ndarray, start: np.ndarray, eights: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The windows that come strictly after the first window of the same bytes, in (row_id, start) order."""

    def same(a, b):
        equal = length[a] == length[b]
        equal[equal] = _text.same_ranges(eights, at[a[equal]], eights, at[b[equal]], length[a[equal]])
        return equal

    late, lead = _text.leaders(hashes, same, (start, row_id))
    return late[_after(late, lead, row_id, start)]


def _after(a: np.ndarray, b: np.ndarray, row_id: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Where item a comes strictly after item b in (row_id, start) order."""
    return (row_id[a] > row_id[b]) | ((row_id[a] == row_id[b]) & (start[a] > start[b]))


def _minimisers(block: Block, window: int) -> np.ndarray:
    """The minimiser of every window, by first word; windows across texts have one too, to be ignored."""
    return _text.sliding_min(_text.gram_hashes(block.hash, GRAM), window - GRAM + 1)


def _runs(minimiser: np.ndarray, first: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Consecutive windows of one text with one minimiser: first and last window of each run."""
    if not len(first):
        return first, first
    cut = np.ones(len(first), dtype=bool)
    cut[1:] = (first[1:] != first[:-1] + 1) | (minimiser[first[1:]] != minimiser[first[:-1]]) | (owner[first[1:]] != owner[first[:-1]])
    head = np.flatnonzero(cut)
    return first[head], first[np.append(head[1:], len(first)) - 1]


def frequent_minimisers(rows: DataFrame, window: int) -> np.ndarray:
    """Minimisers that a fixed share of documents has often."""

    def count(batches):
        for batch in batches:
            buf, offs = _text.flat(batch.column(0))
            for i, j in _text.slices(offs, BLOCK_BYTES):
                text, at = normalised(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                block = Block(text[: at[-1]], at)
                minimiser = _minimisers(block, window)
                head, _ = _runs(minimiser, block.windows(window), block.owner)
                value, n = np.unique(minimiser[head], return_counts=True)
                yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["value", "n"])

    sample = rows.where(F.pmod(F.xxhash64("row_id", "row_hash"), F.lit(SAMPLE_ONE_IN)) == 0).select("text")
    return _packed.frequent_keys(sample.mapInArrow(_text.frugal(count), "value long, n long"), FREQUENT)


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_id, row_hash, span_blob: words inside windows that start earlier elsewhere."""
    n_buckets = buckets_for(rows, 6, BUCKET_BYTES)
    often = frequent_minimisers(rows, window)
    frequent = rows.sparkSession.sparkContext.broadcast(often)

    def pack(batches):
        packer, often = _packed.Packer(), frequent.value
        for batch in batches:
            row_id, row_hash = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            buf, offs = _text.flat(batch.column(0))
            for i, j in _text.slices(offs, BLOCK_BYTES):
                _pack_block(packer, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], row_id[i:j], row_hash[i:j], n_buckets, often, window)
                if packer.full():
                    yield packer.batch()
        if packer.size:
            yield packer.batch()

    def settle(key: tuple, group: pa.Table) -> pa.Table:
        (kind, row_id, row_hash, start, size), text = _packed.gathered(group.column("payload").to_pylist())
        known = kind == 1
        found = [(row_id[known], row_hash[known], start[known], start[known] + size[known])]
        row_id, row_hash, start = row_id[~known], row_hash[~known], start[~known]
        buf = np.frombuffer(text + bytes(8), dtype=np.uint8)
        offs = np.concatenate(([0], np.flatnonzero(buf == 0x0A) + 1))
        block = Block(buf[: offs[-1]], offs)
        first = block.windows(window)
        record = block.owner[first]
        begin = start[record] + first - block.woffs[record]
        at, end = block.starts[first], block.ends[first + window - 1]
        whole = _text.gram_hashes(block.hash, window)[first]
        late = _late(whole, row_id[record], begin, _text.loads8(buf), at, end - at)
        found.append((row_id[record[late]], row_hash[record[late]], begin[late], begin[late] + window))
        out = _packed.reported(_packed.span_rows(*(np.concatenate(x) for x in zip(*found))))
        if key[0].as_py() >= n_buckets:  # a first meeting: those that aren't late meet again
            own = np.setdiff1d(np.arange(len(first)), late)
            r, packer = record[own], _packed.Packer()
            lines = [text[a:b] + b"\n" for a, b in zip(at[own].tolist(), end[own].tolist())]
            zero = np.zeros(len(own), np.int32)
            packer.add_sorted(_packed.bucket_of(whole[own], n_buckets), (zero.astype(np.int8), row_id[r], row_hash[r], begin[own].astype(np.int32), zero), lines)
            out = pa.concat_tables([out, _packed.passed_on(packer)])
        _text.release()
        return out

    packed = rows.select("text", "row_id", "row_hash").mapInArrow(_text.frugal(pack), "bucket int, payload binary")
    return _packed.met(packed, settle, n_buckets, len(often) > 0)


def _pack_block(packer, buf, offs, row_id, row_hash, n_buckets, often, window) -> None:
    text, at = normalised(buf, offs)
    block = Block(text[: at[-1]], at)
    first = block.windows(window)
    if not len(first):
        return
    whole = _text.gram_hashes(block.hash, window)
    owner = block.owner
    begin = np.arange(len(owner)) - block.woffs[owner]  # word number in its text
    low, high = block.starts[first], block.ends[first + window - 1]
    late = _late(whole[first], row_id[owner[first]], begin[first], _text.loads8(text), low, high - low)
    if len(late):
        f = first[late]
        here = _packed.span_rows(row_id[owner[f]], row_hash[owner[f]], begin[f], begin[f] + window)
        ids, hashes = here.column(0).to_numpy(), here.column(1).to_numpy()
        pairs = [np.frombuffer(b, dtype="<i4").reshape(-1, 2) for b in here.column(2).to_pylist()]
        n = np.array([len(p) for p in pairs])
        pairs = np.concatenate(pairs).astype(np.int32)
        bucket = int(_packed.bucket_of(ids[:1].view(np.uint64), n_buckets)[0])
        packer.add(bucket, (np.ones(len(pairs), np.int8), np.repeat(ids, n), np.repeat(hashes, n), pairs[:, 0], pairs[:, 1] - pairs[:, 0]), b"")
    keep = np.ones(len(first), dtype=bool)
    keep[late] = False
    first = first[keep]
    minimiser = _minimisers(block, window)
    single = np.isin(minimiser[first], often) if len(often) else np.zeros(len(first), dtype=bool)
    a, b = _runs(minimiser, first[~single], owner)
    key = minimiser[a]
    alone = first[single]
    a, b = np.concatenate((a, alone)), np.concatenate((b, alone))
    bucket = np.concatenate((_packed.bucket_of(key, n_buckets), _packed.salted(whole[alone], _packed.salt_of(row_id, row_hash, n_buckets), n_buckets)))
    order = np.argsort(bucket, kind="stable")
    a, b, bucket = a[order], b[order], bucket[order]
    low, high = block.starts[a].tolist(), block.ends[b + window - 1].tolist()
    raw = text.tobytes()
    strings = [raw[x:y] for x, y in zip(low, high)]
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    edges = [0, *cuts.tolist(), len(a)]
    ids, hashes, start = row_id[owner[a]], row_hash[owner[a]], begin[a].astype(np.int32)
    for x, y in zip(edges, edges[1:]):
        if x < y:
            packer.add(int(bucket[x]), (np.zeros(y - x, np.int8), ids[x:y], hashes[x:y], start[x:y], np.zeros(y - x, np.int32)), b"\n".join(strings[x:y]) + b"\n")


SCHEMA = "doc_id long, n_words long, n_removed long, kept_text string"


def dedup_windows(documents: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words joined by spaces (or, digested, their SHA-256) of every row."""

    def finish(batches):
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, blobs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                words = (text or b"").split()
                runs = _packed.merged(blobs, len(words))
                left, at = [], 0
                for a, b in runs.tolist():
                    left += words[at:a]
                    at = b
                left += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                out = b" ".join(left)
                kept.append(hashlib.sha256(out).hexdigest() if digest else out.decode())
            yield pa.record_batch([batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    rows = keyed(documents)
    return with_spans(rows, repeated_spans(rows, window)).mapInArrow(_text.frugal(finish), SCHEMA)
