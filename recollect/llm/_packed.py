"""Packing of records into one compressed cell per bucket, and spans of documents."""

from __future__ import annotations

import math
import pickle
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text
from recollect.llm._spark import cut

#: Bytes of packed strings that a task gathers before it hands them on.
FLUSH_BYTES = 16 << 20
#: What a bucket gives: spans of documents, or records passed on to another bucket.
SETTLED_NAMES = ["row_id", "row_hash", "span_blob", "bucket", "payload"]
SETTLED = "row_id long, row_hash long, span_blob binary, bucket int, payload binary"
#: Counts of keys are looked at in a fixed share of documents; no more keys than this are frequent.
MOST_KEYS = 1 << 21


class Packer:
    """Gathers (arrays, strings) per bucket; `rows` gives one (bucket, payload) row for each."""

    def __init__(self):
        self.held: dict[int, list] = defaultdict(list)
        self.size = 0

    def add(self, bucket: int, arrays: tuple[np.ndarray, ...], strings: bytes) -> None:
        self.held[bucket].append((arrays, strings))
        self.size += len(strings) + sum(a.nbytes for a in arrays)

    def full(self) -> bool:
        return self.size >= FLUSH_BYTES

    def add_sorted(self, bucket: np.ndarray, arrays: tuple[np.ndarray, ...], strings: list[bytes]) -> None:
        """Records dealt to their buckets; a string each."""
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order])) + 1
        for part in np.split(order, cuts) if len(order) else []:
            self.add(int(bucket[part[0]]), tuple(a[part] for a in arrays), b"".join([strings[k] for k in part.tolist()]))

    def batch(self) -> pa.RecordBatch:
        press = zstandard.ZstdCompressor(level=3)
        buckets, payloads = [], []
        for bucket, parts in self.held.items():
            arrays = [np.concatenate(x) for x in zip(*(a for a, _ in parts))]
            payloads.append(press.compress(pickle.dumps(([(a.dtype.str, a.tobytes()) for a in arrays], b"".join(s for _, s in parts)), protocol=5)))
            buckets.append(bucket)
        self.held, self.size = defaultdict(list), 0
        return pa.record_batch([pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], names=["bucket", "payload"])


def unpacked(payloads: Iterable[bytes]) -> Iterator[tuple[list[np.ndarray], bytes]]:
    open_ = zstandard.ZstdDecompressor()
    for p in payloads:
        arrays, strings = pickle.loads(open_.decompress(p))
        yield [np.frombuffer(raw, dtype=kind) for kind, raw in arrays], strings


def gathered(payloads: Iterable[bytes]) -> tuple[list[np.ndarray], bytes]:
    """All records of a bucket: each array and the strings, joined in one order."""
    parts = list(unpacked(payloads))
    return [np.concatenate(x) for x in zip(*(a for a, _ in parts))], b"".join(s for _, s in parts)


def salted(key: np.ndarray, salt: int, n_buckets: int) -> np.ndarray:
    """Buckets beyond n_buckets, where records of a frequent key first meet those of the same salt."""
    return bucket_of(key ^ _text.mix(np.array([salt + 1], dtype=np.uint64)), n_buckets) + n_buckets


def bucket_of(key: np.ndarray, n_buckets: int) -> np.ndarray:
    return (_text.mix(key.copy()) % np.uint64(n_buckets)).astype(np.int64)


def salt_of(row_id: np.ndarray, row_hash: np.ndarray, n_buckets: int) -> int:
    """The salt of a block of rows: as many salts as make both meetings of a frequent key alike in size."""
    first = _text.mix(row_id[:1].astype(np.int64).view(np.uint64) ^ _text.mix(row_hash[:1].astype(np.int64).view(np.uint64).copy()))
    return int(first[0]) % (math.isqrt(n_buckets) + 2)


def passed_on(packer: Packer) -> pa.Table:
    """What a first meeting hands to the second: rows of SETTLED without spans."""
    batch = packer.batch()
    none = pa.nulls(batch.num_rows, pa.int64())
    return pa.table([none, none, pa.nulls(batch.num_rows, pa.binary()), *batch.columns], names=SETTLED_NAMES)


def reported(spans: pa.Table) -> pa.Table:
    """Spans as rows of SETTLED."""
    return pa.table([*spans.columns, pa.nulls(spans.num_rows, pa.int32()), pa.nulls(spans.num_rows, pa.binary())], names=SETTLED_NAMES)


def met(packed: DataFrame, settle, n_buckets: int, frequent: bool) -> DataFrame:
    """row_id, row_hash, span_blob: settle over all buckets; where there are frequent keys, over what salted buckets pass on, too.

    What settled is written once, as both its spans and what is passed on are read.
    """
    spans = "row_id", "row_hash", "span_blob"
    first = packed.groupBy("bucket").applyInArrow(settle, SETTLED)
    if not frequent:
        return first.select(*spans)
    first = cut(first)
    second = first.where("payload is not null").select("bucket", "payload").groupBy("bucket").applyInArrow(settle, SETTLED)
    return first.where("payload is null").select(*spans).unionByName(second.select(*spans))


def span_rows(row_id: np.ndarray, row_hash: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Table:
    """One row per document: its spans as a blob of int32 (start, end), touching ones joined."""
    names = ["row_id", "row_hash", "span_blob"]
    if not len(starts):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], names=names)
    order = np.lexsort((starts, row_hash, row_id))
    row_id, row_hash, starts, ends = row_id[order], row_hash[order], starts[order].astype(np.int64), ends[order].astype(np.int64)
    new_row = np.ones(len(starts), dtype=bool)
    new_row[1:] = (row_id[1:] != row_id[:-1]) | (row_hash[1:] != row_hash[:-1])
    row = np.cumsum(new_row) - 1
    # the furthest end so far within the row
    shift = row * (int(ends.max()) + 1)
    reach = np.maximum.accumulate(ends + shift) - shift
    fresh = new_row.copy()
    fresh[1:] |= starts[1:] > reach[:-1]
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(starts)) - 1
    pairs = np.stack((starts[head], reach[tail]), axis=1).astype("<i4")
    rows_of = row[head]
    cuts = np.flatnonzero(np.diff(rows_of)) + 1
    blobs = [p.tobytes() for p in np.split(pairs, cuts)]
    first = np.flatnonzero(new_row)
    return pa.table([pa.array(row_id[first]), pa.array(row_hash[first]), pa.array(blobs, pa.binary())], names=names)


def merged_blob(starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Spans in order of their starts as a blob of int32 (start, end), touching ones joined."""
    head = np.flatnonzero(np.concatenate(([True], starts[1:] > ends[:-1])))
    return np.stack((starts[head], ends[np.append(head[1:], len(starts)) - 1]), axis=1).astype("<i4").tobytes()


def merged(blobs: list[bytes] | None, n: int) -> np.ndarray:
    """Maximal runs (start, end) of the union of span blobs, within n items."""
    if not blobs:
        return np.zeros((0, 2), dtype=np.int64)
    pairs = np.frombuffer(b"".join(blobs), dtype="<i4").reshape(-1, 2).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs[:, 1])
    head = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] > reach[:-1])))
    return np.stack((pairs[head, 0], reach[np.append(head[1:], len(pairs)) - 1]), axis=1)


def frequent_keys(counts: DataFrame, least: int) -> np.ndarray:
    """Keys (value, of counts value, n) found `least` times or more, sorted; of more than MOST_KEYS in reach, the limit rises with the rows.

    A key that is found `limit` times takes that many of the rows counted, so there are at
    most MOST_KEYS of them; all that a limit leaves out is rarer than one row in so many.
    """
    often = cut(counts.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    rows = often.agg(F.sum("n")).first()[0] or 0
    found = often.where(F.col("n") >= max(least, -(-rows // MOST_KEYS))).select("value").toArrow()
    return np.sort(found.column("value").to_numpy().astype(np.int64).view(np.uint64))
