"""Vectorised scanning of Arrow string columns, shared by the corpus operators.

Texts are handled as the UTF-8 bytes that Arrow already holds: a column is one byte
array plus row offsets, and words, lines and hashes are found with numpy over slices of
at most ``CHUNK`` bytes (a longer text is a slice of its own).  Nothing here is per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash

CHUNK = 1 << 20
#: Ranges of at most so many bytes are hashed together, eight bytes a step.
_CHAINED = 32
_KEY = np.uint64(0x9E3779B97F4A7C15)
#: Masks of the lowest 0 to 8 bytes.
_LOW = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def release() -> None:
    """Hand freed memory back to the system: an idle worker holds no more than it needs."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def frugal(run: Callable) -> Callable:
    """A function of batches that releases what it has freed when its partition ends."""

    @wraps(run)
    def whole(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def byte_class(pattern_bytes) -> np.ndarray:
    """Boolean table of 256 entries that is true for the given byte values."""
    lut = np.zeros(256, dtype=bool)
    lut[list(pattern_bytes)] = True
    return lut


#: Bytes of words `[^\x20\x09-\x0D]+`: anything but ASCII white space.
NON_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: Bytes of lower-cased words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`.
ALNUM_WORD = ~byte_class([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the n + 1 offsets of its rows (null: empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    wide = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = column.cast(wide)
    if column.null_count:
        column = column.fill_null("" if wide == pa.large_string() else b"")
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, dtype=np.int64, count=n + 1 + column.offset)[column.offset :] if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def slices(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def padded(buf: np.ndarray) -> np.ndarray:
    """The bytes with eight spare ones behind them, as `loads8` needs."""
    return np.concatenate((buf, np.zeros(8, np.uint8)))


def loads8(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from every position on, as integers; buf must end with eight spare bytes."""
    return np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buf[s:e] for every range: eight bytes after eight through a mixer, longer ranges by XXH3.

    No polynomial: such sums collide on texts that anyone can write down.  Hashes propose;
    where a result hangs on equality, `leaders` and `same_ranges` compare the bytes.
    """
    size = (ends - starts).astype(np.int64)
    h = size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) ^ _KEY
    eights = loads8(padded(buf))
    for k in range(0, _CHAINED, 8):
        live = np.flatnonzero((size > k) & (size <= _CHAINED))
        if not len(live):
            break
        h[live] = mix(h[live] ^ (eights[starts[live] + k] & _LOW[np.minimum(size[live] - k, 8)]))
    digest = xxhash.xxh3_64_intdigest
    for i in np.flatnonzero(size > _CHAINED).tolist():
        h[i] = digest(buf[starts[i] : ends[i]], 42)
    return h


def same_ranges(eights: np.ndarray, a: np.ndarray, others: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ranges of `length` bytes from a (in the bytes of `eights`) and from b (of `others`) are equal."""
    same = np.ones(len(a), dtype=bool)
    live, at = np.flatnonzero(length > 0), 0
    while len(live):
        unlike = (eights[a[live] + at] ^ others[b[live] + at]) & _LOW[np.minimum(length[live] - at, 8)]
        equal = unlike == 0
        same[live[~equal]] = False
        at += 8
        live = live[equal & (length[live] > at)]
    return same


def leaders(hashes: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray], order_key: tuple[np.ndarray, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """(item, its leader) for the items that aren't the first of the items equal to them.

    Hashes propose, same(items, others) decides.  order_key: least significant first, as for
    lexsort; without one, items come in the order they are given.
    """
    plain = np.argsort(hashes, kind="stable")
    twin = hashes[plain][1:] == hashes[plain][:-1]
    some = np.zeros(len(hashes), dtype=bool)
    some[plain[1:][twin]] = True
    some[plain[:-1][twin]] = True
    idx = np.flatnonzero(some) if order_key else plain[some[plain]]
    out = [np.zeros((0, 2), dtype=np.int64)]
    while len(idx):
        order = idx[np.lexsort((*(k[idx] for k in order_key), hashes[idx]))] if order_key else idx
        head = np.concatenate(([True], hashes[order][1:] != hashes[order][:-1]))
        first = order[np.flatnonzero(head)[np.cumsum(head) - 1]]
        rest, lead = order[~head], first[~head]
        equal = same(rest, lead)
        out.append(np.stack((rest[equal], lead[equal]), axis=1))
        idx = rest[~equal]  # a hash shared by different items: look among those that are left
    found = np.concatenate(out)
    return found[:, 0], found[:, 1]


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring runs from theirs."""
    return mix(a * np.uint64(0xD1342543DE82EF95) + b)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes, boundaries of rows ignored; runs of 1, 2, 4, ... words are joined."""
    total = len(words) - n + 1
    if total <= 0:
        return np.zeros(0, np.uint64)
    run, width, done, out = words, 1, 0, None
    while True:
        if n & width:
            part = run[done : done + total]
            out = part if out is None else _joined(out, part)
            done += width
        if done == n:
            return out
        run = _joined(run[:-width], run[width:])
        width *= 2


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values, by doubling."""
    if len(values) < width:
        return values[:0]
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[:-done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def word_bounds(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of all words, and the n + 1 word offsets of the rows; words end with their row."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = member[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    heads = offsets[:-1][offsets[:-1] < len(buf)]
    first[heads] = inside[heads]
    tails = offsets[1:][offsets[1:] > 0] - 1
    last[tails] = inside[tails]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def hashed_words(buf: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """word_bounds and the hashes of the words, found in slices so that arrays per byte stay small."""
    starts, ends, counts, hashes = [], [], [], []
    for i, j in slices(offsets):
        part = buf[offsets[i] : offsets[j]]
        a, b, w = word_bounds(part, offsets[i : j + 1] - offsets[i], member)
        hashes.append(byte_hashes(part, a, b))
        starts.append(a + offsets[i])
        ends.append(b + offsets[i])
        counts.append(np.diff(w))
    if not starts:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(1, np.int64), np.zeros(0, np.uint64)
    woffs = np.concatenate(([0], np.cumsum(np.concatenate(counts))))
    return np.concatenate(starts), np.concatenate(ends), woffs, np.concatenate(hashes)


def owners(offsets: np.ndarray) -> np.ndarray:
    """The row of every item, from item offsets."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def per_row_sum(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values over the item ranges of rows; an empty range sums to 0."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Boolean array of n items that is true inside any [start, end)."""
    d = np.zeros(n + 1, dtype=np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:-1]) > 0


def code_points(buf: np.ndarray) -> np.ndarray:
    """True at every byte that begins a code point."""
    return (buf & 0xC0) != 0x80
