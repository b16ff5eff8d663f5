"""Byte-substring dedup by suffix arrays over content-defined shards.

Any two equal 400-byte strings choose the same anchor, the smallest hash of their 16-byte
grams.  Consecutive windows of a text with one anchor value travel as one string to the
bucket of that value, so a bucket holds all occurrences of its windows.  There, anchors
seen in one string only are done; strings that are equal throughout are one, known to
repeat; the rest, grouped by anchor into shards of bounded size, are concatenated, sorted by
induced sorting, and every window whose common prefix with a neighbour in the suffix array
reaches 400 bytes is a repeat.  Covered bytes come back to their document as spans.

Skew.  A task sends equal strings of one block once, and reports their windows as they are.
Anchors that a sample of documents shows to be very frequent are routed otherwise: their
windows are cut at fixed distances from the anchor into short groups, which go by the bytes
that all windows of the group share; where the sample shows very many different strings
around the same bytes, as behind a passage that everyone has, windows go singly.  Both meet
twice, first those of blocks with the same salt, then one of each different string, which
knows whether it has been seen more than once.  The sample decides where windows meet, never
whether.

Rows are judged one by one: a repeated row repeats every byte of its text.  Null and empty
texts have no bytes, and texts under 400 bytes no windows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _packed, _text
from recollect.llm._spark import buckets_for, keyed, with_spans
from recollect.llm.suffix_array import permuted_common_prefixes, suffix_array

WINDOW = 400
GRAM = 16
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 6 << 20
SHARD_BYTES = 1 << 19
#: Windows in a group of a frequent anchor.
GROUP_WINDOWS = 32
#: One document in so many is looked at for frequent anchors; as often in the sample makes one
#: frequent, and so many different strings around the same bytes are split up.
SAMPLE_ONE_IN, FREQUENT, MANY_STRINGS = 64, 64, 4096
#: Between strings of a shard; no byte of UTF-8.
SEPARATOR = 0xFF


def anchors(buf: np.ndarray, window: int) -> np.ndarray:
    """The anchor value of the window at every byte, row boundaries ignored."""
    if len(buf) < window:
        return np.zeros(0, np.uint64)
    return _text.sliding_min(_gram_hashes(_text.loads8(np.ascontiguousarray(buf)), 0, len(buf)), window - GRAM + 1)


def _gram_hashes(eights: np.ndarray, low: int, high: int) -> np.ndarray:
    """Hashes of all grams inside [low, high), from 8-byte loads."""
    h = eights[low : high - GRAM + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += eights[low + GRAM - 8 : high - 7]
    return _text.mix(h)


def _window_runs(value: np.ndarray, offs: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs [a, b] of window starts with one anchor value inside one row, and the row."""
    if not len(value):
        z = np.zeros(0, np.int64)
        return z, z, z
    cut = np.ones(len(value), dtype=bool)
    cut[1:] = value[1:] != value[:-1]
    low, high = offs[:-1], offs[1:] - window  # first and last start of a row
    some = high >= low
    cut[low[some]] = True
    past = high[some] + 1
    cut[past[past < len(value)]] = True
    a = np.flatnonzero(cut)
    b = np.append(a[1:], len(value)) - 1
    row = np.searchsorted(offs, a, side="right") - 1
    whole = a + window <= offs[row + 1]
    return a[whole], b[whole], row[whole]


def frequent_anchors(rows: DataFrame, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchors that a fixed share of documents has often; and, of their groups, those with many different strings."""

    def count(batches):
        for part, offs, value in _sampled(batches, window):
            a, _, _ = _window_runs(value, offs, window)
            found, n = np.unique(value[a], return_counts=True)
            yield pa.record_batch([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["value", "n"])

    sample = rows.where(F.pmod(F.xxhash64("row_id", "row_hash"), F.lit(SAMPLE_ONE_IN)) == 0).select("text")
    often = _packed.frequent_keys(sample.mapInArrow(_text.frugal(count), "value long, n long"), FREQUENT)
    if not len(often):
        return often, often
    shared = rows.sparkSession.sparkContext.broadcast(often)

    def strings(batches):
        for part, offs, value in _sampled(batches, window):
            a, b, row = _window_runs(value, offs, window)
            hot = np.isin(value[a], shared.value)
            if hot.any():
                ga, gb, _, key = _grouped(part, value, a[hot], b[hot], row[hot], window)
                own = _text.byte_hashes(part, ga, gb + window)
                yield pa.record_batch([pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], names=["value", "own"])

    different = sample.mapInArrow(_text.frugal(strings), "value long, own long").distinct()
    return often, _packed.frequent_keys(different.select("value", F.lit(1).cast("long").alias("n")), MANY_STRINGS)


def _sampled(batches, window: int):
    """(bytes, offsets, anchors) of the blocks of texts."""
    for batch in batches:
        buf, offs = _text.flat(batch.column(0))
        for i, j in _text.slices(offs, BLOCK_BYTES):
            part = buf[offs[i] : offs[j]]
            yield part, offs[i : j + 1] - offs[i], anchors(part, window)


def _grouped(buf: np.ndarray, value: np.ndarray, a: np.ndarray, b: np.ndarray, row: np.ndarray, window: int):
    """Runs of frequent anchors cut into groups, keyed by the bytes that a group's windows share.

    A window's own place of its anchor is the leftmost, so equal windows have it at the same
    distance, belong to groups of the same distances, and share the same core.
    """
    eights = _text.loads8(np.concatenate((buf, np.zeros(8, np.uint8))))
    out_a, out_b, out_row, key = [], [], [], []
    for x, y, r in zip(a.tolist(), b.tolist(), row.tolist()):
        places = np.flatnonzero(_gram_hashes(eights, x, y + window) == value[x]) + x
        start = np.arange(x, y + 1)
        place = places[np.searchsorted(places, start)]
        group = (place - start) // GROUP_WINDOWS
        head = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (group[1:] != group[:-1]))))
        last = place[head] - group[head] * GROUP_WINDOWS  # of the whole group's starts, whether or not the run has it
        out_a.append(start[head])
        out_b.append(np.append(start[head[1:]] - 1, y))
        out_row.append(np.full(len(head), r))
        key.append(_text.byte_hashes(buf[x : y + window], last - x, last - GROUP_WINDOWS + 1 + window - x))
    return tuple(np.concatenate(c) for c in (out_a, out_b, out_row, key))


def repeated_spans(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """row_id, row_hash, span_blob: bytes inside windows that start anywhere else too."""
    n_buckets = buckets_for(rows, 6, BUCKET_BYTES)
    often = frequent_anchors(rows, window)
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
        (kind, row_id, row_hash, start, size, value), strings = _packed.gathered(group.column("payload").to_pylist())
        if key[0].as_py() >= n_buckets:
            return _first_meeting(kind, row_id, row_hash, start, size, value, strings, n_buckets)
        known = kind == 1
        found = [(row_id[known], row_hash[known], start[known].astype(np.int64), start[known].astype(np.int64) + size[known])]
        sent = ~known
        for record, low, high in repeats(strings, size[sent], value[sent], kind[sent] == 2, window):
            found.append((row_id[sent][record], row_hash[sent][record], start[sent][record] + low, start[sent][record] + high))
        out = _packed.reported(_packed.span_rows(*(np.concatenate(x) for x in zip(*found))))
        _text.release()
        return out

    packed = rows.select("text", "row_id", "row_hash").mapInArrow(_text.frugal(pack), "bucket int, payload binary")
    return _packed.met(packed, settle, n_buckets, len(often[0]) > 0)


def _first_meeting(kind, row_id, row_hash, start, size, value, strings: bytes, n_buckets: int) -> pa.Table:
    """Reports strings that occur twice or more, and passes on one of each."""
    edges = np.concatenate(([0], np.cumsum(size, dtype=np.int64))).tolist()
    each = [strings[a:b] for a, b in zip(edges, edges[1:])]
    first_of: dict[tuple[int, bytes], int] = {}
    lead = np.array([first_of.setdefault((v, s), k) for k, (v, s) in enumerate(zip(value.tolist(), each))], dtype=np.int64)
    twice = kind == 2
    twice[lead[lead != np.arange(len(lead))]] = True
    again = np.flatnonzero(twice[lead])
    out = _packed.reported(_packed.span_rows(row_id[again], row_hash[again], start[again], start[again] + size[again]))
    own = np.unique(lead)
    packer = _packed.Packer()
    records = (np.where(twice[own], 2, 0).astype(np.int8), row_id[own], row_hash[own], start[own], size[own], value[own])
    packer.add_sorted(_packed.bucket_of(value[own], n_buckets), records, [each[k] for k in own.tolist()])
    return pa.concat_tables([out, _packed.passed_on(packer)])


def _pack_block(packer, buf, offs, row_id, row_hash, n_buckets, often, window) -> None:
    value = anchors(buf, window)
    a, b, row = _window_runs(value, offs, window)
    if not len(a):
        return
    key, (anchors_often, groups_often) = value[a], often
    hot = np.isin(key, anchors_often)
    if hot.any():
        ga, gb, grow, gkey = _grouped(buf, value, a[hot], b[hot], row[hot], window)
        many = np.isin(gkey, groups_often)
        if many.any():  # each window by itself
            n = (gb - ga + 1)[many]
            single = np.repeat(ga[many], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            ones = (single, single, np.repeat(grow[many], n), _text.byte_hashes(buf, single, single + window))
            ga, gb, grow, gkey = (np.concatenate((x[~many], y)) for x, y in zip((ga, gb, grow, gkey), ones))
        a, b, row, key = (np.concatenate((x[~hot], y)) for x, y in ((a, ga), (b, gb), (row, grow), (key, gkey)))
        hot = np.arange(len(a)) >= np.count_nonzero(~hot)
    raw = buf.tobytes()
    strings = [raw[x:y] for x, y in zip(a.tolist(), (b + window).tolist())]
    first_of: dict[bytes, int] = {}
    lead = np.array([first_of.setdefault(s, k) for k, s in enumerate(strings)])
    own = lead == np.arange(len(lead))
    twice = np.zeros(len(lead), dtype=bool)
    twice[lead[~own]] = True
    start, size = (a - offs[row]).astype(np.int32), (b + window - a).astype(np.int32)
    bucket = _packed.bucket_of(key, n_buckets)
    ids, hashes = row_id[row], row_hash[row]
    extra = np.flatnonzero(~own)
    if len(extra):
        # kind 1: nothing is left to find out; these meet their document wherever they are sent
        here = _packed.span_rows(ids[extra], hashes[extra], start[extra], start[extra] + size[extra])
        pairs = [np.frombuffer(x, dtype="<i4").reshape(-1, 2) for x in here.column(2).to_pylist()]
        n = np.array([len(p) for p in pairs])
        flat = np.concatenate(pairs).astype(np.int32)
        packer.add(int(bucket[extra[0]]), (np.ones(len(flat), np.int8), np.repeat(here.column(0).to_numpy(), n), np.repeat(here.column(1).to_numpy(), n), flat[:, 0], flat[:, 1] - flat[:, 0], np.zeros(len(flat), np.uint64)), b"")
    kind = np.where(twice, 2, 0).astype(np.int8)
    bucket[hot] = _packed.salted(key[hot], _packed.salt_of(row_id, row_hash, n_buckets), n_buckets)
    sent = np.flatnonzero(own)
    packer.add_sorted(bucket[sent], (kind[sent], ids[sent], hashes[sent], start[sent], size[sent], key[sent]), [strings[k] for k in sent.tolist()])


def repeats(strings: bytes, size: np.ndarray, value: np.ndarray, twice: np.ndarray, window: int):
    """Yields (record, low, high): byte ranges of the records' strings that repeat elsewhere in the bucket.

    twice: records that stand for more than one equal string already.
    """
    if not len(size):
        return
    offs = np.concatenate(([0], np.cumsum(size, dtype=np.int64)))
    order = np.argsort(value, kind="stable")
    cuts = [0, *(np.flatnonzero(np.diff(value[order])) + 1).tolist(), len(order)]
    inner = _may_repeat_inside(strings, offs, value)
    full, shard, shard_size = [], [], 0
    for x, y in zip(cuts, cuts[1:]):
        members = order[x:y].tolist()
        if len(members) == 1 and not inner[members[0]]:
            full += [members[0]] if twice[members[0]] else []
            continue
        first_of: dict[bytes, int] = {}
        again = set()
        for k in members:
            lead = first_of.setdefault(strings[offs[k] : offs[k + 1]], k)
            if lead != k:
                again.add(lead)
                full.append(k)
        full += [k for k in first_of.values() if k in again or twice[k]]
        if len(first_of) > 1 or inner[members[0]]:
            shard += first_of.values()
            shard_size += sum(map(len, first_of))
        if shard_size >= SHARD_BYTES:
            yield _shard_repeats(strings, offs, np.array(shard), window)
            shard, shard_size = [], 0
    if shard:
        yield _shard_repeats(strings, offs, np.array(shard), window)
    full = np.array(full, dtype=np.int64)
    yield full, np.zeros(len(full), np.int64), offs[full + 1] - offs[full]


def _may_repeat_inside(strings: bytes, offs: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Records whose string holds its anchor at two places or more; no other can hold a window twice.

    A key that isn't an anchor value (of a group of a frequent anchor) says nothing, so such
    records may repeat wherever their string is longer than one window.
    """
    places = np.zeros(len(value), dtype=np.int64)
    for i, j in _text.slices(offs):
        buf = np.frombuffer(strings, dtype=np.uint8, count=int(offs[j] - offs[i]), offset=int(offs[i]))
        if len(buf) < GRAM:
            continue
        h = _gram_hashes(_text.loads8(buf), 0, len(buf))
        size = offs[i + 1 : j + 1] - offs[i:j]
        hit = np.flatnonzero(h == np.repeat(value[i:j], size)[: len(h)])
        places[i:j] = np.bincount(np.searchsorted(offs[i : j + 1] - offs[i], hit, side="right") - 1, minlength=j - i)
    return places != 1


def _shard_repeats(strings: bytes, offs: np.ndarray, records: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges covered by windows of the records' strings that occur twice or more among them."""
    mark = bytes([SEPARATOR])
    text = mark.join([strings[offs[k] : offs[k + 1]] for k in records.tolist()]) + mark
    n = len(text)
    padded = np.frombuffer(text + mark * (window + 16), dtype=np.uint8)
    symbols = np.unique(padded[:n], return_inverse=True)
    order = suffix_array(symbols[1].astype(np.int64), len(symbols[0]))
    shared = permuted_common_prefixes(padded, _text.loads8(padded), order, window)
    hit = shared >= window
    later = shared[order[1:]] >= window
    hit[order[:-1][later]] = True
    starts = np.flatnonzero(hit)
    edges = np.concatenate(([0], np.cumsum(offs[records + 1] - offs[records] + 1)))
    inside = np.searchsorted(edges, starts, side="right") - 1
    whole = starts + window < edges[inside + 1]  # no separator among the shared bytes
    starts, inside = starts[whole], inside[whole]
    fresh = np.ones(len(starts), dtype=bool)
    fresh[1:] = (starts[1:] != starts[:-1] + 1) | (inside[1:] != inside[:-1])
    head = np.flatnonzero(fresh)
    tail = np.append(head[1:], len(starts)) - 1 if len(head) else head
    own = inside[head]
    return records[own], starts[head] - edges[own], starts[tail] + window - edges[own]


SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept {kind}"


def dedup_substrings(documents: DataFrame, window: int = WINDOW, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the kept bytes (or, digested, their SHA-256) of every row."""

    def finish(batches):
        for batch in batches:
            sizes, removed, spans, kept = [], [], [], []
            for text, blobs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()):
                raw = text or b""
                runs = _packed.merged(blobs, len(raw)).tolist()
                left, at = [], 0
                for a, b in runs:
                    left.append(raw[at:a])
                    at = b
                out = b"".join([*left, raw[at:]])
                sizes.append(len(raw))
                removed.append(len(raw) - len(out))
                spans.append(len(runs))
                kept.append(hashlib.sha256(out).hexdigest() if digest else out)
            yield pa.record_batch(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.string() if digest else pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    rows = keyed(documents)
    return with_spans(rows, repeated_spans(rows, window)).mapInArrow(_text.frugal(finish), SCHEMA.format(kind="string" if digest else "binary"))
