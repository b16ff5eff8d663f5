"""Benchmark decontamination by winnowing.

Every text, of either side, keeps the five-word grams whose hash is the smallest of some six
consecutive ones.  A window of ten words holds six grams, so any ten words that two texts
share hold a kept gram at the same place in both.  Kept grams of documents are joined with
those of the benchmark, and each hit is extended to the six windows of ten words that hold
it; those that are a window of an item, compared byte by byte, are contaminated.  Items
under ten words are one window, found by its own hash.  A window of a document meets one
window of the benchmark, however many items or places have it, so repeated grams on both
sides make no pairs: items that share windows are a set, and sets are united by document.

The benchmark is measured first.  Up to `NEAR_BYTES` it is broadcast and documents are
screened in place, without a shuffle.  Beyond, kept grams mark a table of bits of fixed size,
which is broadcast; windows of documents around marked grams are shuffled by their text and
joined with those of the items.

Null, empty and wordless texts and items match nothing.  Equal items each count.  A null
item_id is written as an empty string.  Repeated rows have equal results.
"""

from __future__ import annotations

import hashlib
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _packed, _text
from recollect.llm._spark import key_columns, keyed

WINDOW = 10
GRAM = 5
NEAR_BYTES = 8 << 20
_TABLE_BITS = 22
_FAR_TABLE_BITS = 26


class Words:
    """The lower-cased words of some texts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf = _text.padded(_text.LOWER[buf])
        self.starts, self.ends, self.woffs, self.hash = _text.hashed_words(self.buf[:-8], offs, _text.ALNUM_WORD)
        self.owner = _text.owners(self.woffs)
        self.eights = _text.loads8(self.buf)

    def whole(self, first: np.ndarray, n: int) -> np.ndarray:
        """Those of `first` from which n words lie in one text."""
        first = first[(first >= 0) & (first + n <= len(self.owner))]
        return first[self.owner[first] == self.owner[first + n - 1]]

    def kept_grams(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of every gram that winnowing keeps; of equal smallest ones, all."""
        grams = _text.gram_hashes(self.hash, GRAM)
        width = WINDOW - GRAM + 1
        if len(grams) < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = _text.sliding_min(grams, width)
        inside = np.zeros(len(least), dtype=bool)
        inside[self.whole(np.arange(len(least)), WINDOW)] = True
        # a gram is kept if it equals the minimum of one of the windows that hold it
        kept = np.zeros(len(grams), dtype=bool)
        for k in range(width):
            kept[k : k + len(least)] |= inside & (grams[k : k + len(least)] == least)
        first = np.flatnonzero(kept)
        return first, grams[first]

    def around(self, grams: np.ndarray) -> np.ndarray:
        """First words of the windows that hold one of the grams (by first word), each once."""
        near = np.zeros(len(self.owner) + 1, dtype=bool)
        for k in range(WINDOW - GRAM + 1):
            near[np.maximum(grams - k, 0)] = True  # the first window holds whatever gram it is taken for
        return self.whole(np.flatnonzero(near), WINDOW)

    def item_windows(self):
        """(n, first words) of the texts' windows by their length: all ten-word ones, and texts of fewer words whole."""
        size = np.diff(self.woffs)
        for n in np.unique(np.minimum(size[size > 0], WINDOW)).tolist():
            yield n, self.whole(np.arange(len(self.owner)), WINDOW) if n == WINDOW else self.woffs[:-1][size == n]

    def same_words(self, a: np.ndarray, other: Words, b: np.ndarray, n: int) -> np.ndarray:
        """Whether the n words from a are those of `other` from b, byte by byte."""
        live = np.arange(len(a))
        for k in range(n):
            x, y = a[live] + k, b[live] + k
            size = self.ends[x] - self.starts[x]
            equal = size == other.ends[y] - other.starts[y]
            equal[equal] = _text.same_ranges(self.eights, self.starts[x[equal]], other.eights, other.starts[y[equal]], size[equal])
            live = live[equal]
        out = np.zeros(len(a), dtype=bool)
        out[live] = True
        return out

    def texts_of(self, first: np.ndarray, n: int) -> list[str]:
        """The n words from each of `first`, joined by spaces."""
        raw, starts, ends = self.buf.tobytes(), self.starts, self.ends
        return [b" ".join([raw[x:y] for x, y in zip(starts[a : a + n].tolist(), ends[a : a + n].tolist())]).decode() for a in first.tolist()]


class Windows:
    """The different windows of n words of the benchmark, and the set of items of each."""

    def __init__(self, words: Words, n: int, first: np.ndarray, name_of: np.ndarray, sets: dict[bytes, int]):
        hashes = _text.gram_hashes(words.hash, n)[first]
        lead = np.arange(len(first))
        late, its = _text.leaders(hashes, lambda a, b: words.same_words(first[a], words, first[b], n))
        lead[late] = its
        pairs = np.unique(np.stack((lead, name_of[words.owner[first]]), axis=1), axis=0)
        head = np.flatnonzero(np.concatenate(([True], pairs[1:, 0] != pairs[:-1, 0])))
        own, count = pairs[head, 0], np.diff(np.append(head, len(pairs)))
        set_of = pairs[head, 1].copy()  # the set of one item has its number
        for k in np.flatnonzero(count > 1).tolist():
            set_of[k] = sets.setdefault(pairs[head[k] : head[k] + count[k], 1].tobytes(), -1 - len(sets))
        order = np.argsort(hashes[own], kind="stable")
        self.words, self.n = words, n
        self.hashes, self.first, self.sets = hashes[own][order], first[own][order], set_of[order]

    def join(self, docs: Words, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the documents' windows that are among these, and their sets."""
        h = _text.gram_hashes(docs.hash, self.n)[first]
        at = np.searchsorted(self.hashes, h)
        found = np.full(len(first), -1)
        live = np.arange(len(first))
        while len(live):  # a second round only where a hash is shared by different windows
            live = live[at[live] < len(self.hashes)]
            live = live[self.hashes[at[live]] == h[live]]
            same = docs.same_words(first[live], self.words, self.first[at[live]], self.n)
            found[live[same]] = at[live[same]]
            live = live[~same]
            at[live] += 1
        hit = np.flatnonzero(found >= 0)
        return first[hit], self.sets[found[hit]]


class Benchmark:
    """Items and the indexes of their windows, built where they are first used."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids, self.texts = ids, texts

    def __getstate__(self):
        return {"ids": self.ids, "texts": self.texts}

    @cached_property
    def names(self) -> list[str]:
        return sorted(set(self.ids))

    @cached_property
    def index(self) -> tuple[Bits, list[Windows], list[np.ndarray]]:
        """The kept grams, the windows by length, and the names (by number) of each set of items."""
        words = Words(*_text.flat(pa.array(self.texts, pa.large_string())))
        place = {name: k for k, name in enumerate(self.names)}
        name_of = np.array([place[i] for i in self.ids], dtype=np.int64)
        sets: dict[bytes, int] = {}
        windows = [Windows(words, n, first, name_of, sets) for n, first in words.item_windows()]
        return Bits(words.kept_grams()[1]), windows, [np.frombuffer(x, dtype=np.int64) for x in sets]

    def hits(self, docs: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end, set of items) of all windows of docs that an item has."""
        kept, windows, _ = self.index
        first, grams = docs.kept_grams()
        out = [np.zeros((0, 3), dtype=np.int64)]
        for w in windows:
            if w.n == WINDOW:
                chosen = docs.around(first[kept.holds(grams)])
            else:
                chosen = docs.whole(np.arange(len(docs.owner)), w.n)
            at, sets = w.join(docs, chosen)
            out.append(np.stack((at, at + w.n, sets), axis=1))
        found = np.concatenate(out)
        return found[:, 0], found[:, 1], found[:, 2]

    def items_of(self, rows: np.ndarray, sets: np.ndarray, n_rows: int) -> list[list[str]]:
        """The names of the items in each row's sets, in order."""
        out: list[list[str]] = [[] for _ in range(n_rows)]
        pairs = np.unique(np.stack((rows, sets), axis=1), axis=0)
        cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
        for part in np.split(pairs, cuts) if len(pairs) else []:
            own = part[:, 1]
            names = np.unique(np.concatenate([own[own >= 0], *(self.index[2][-1 - s] for s in own[own < 0].tolist())]))
            out[part[0, 0]] = [self.names[k] for k in names.tolist()]
        return out


class Bits:
    """Sorted hashes behind a table of bits that turns most lookups away."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = np.unique(hashes)
        self.table = np.zeros(1 << _TABLE_BITS, dtype=bool)
        self.table[self.hashes >> np.uint64(64 - _TABLE_BITS)] = True

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = self.table[hashes >> np.uint64(64 - _TABLE_BITS)]
        some = np.flatnonzero(out)
        at = np.searchsorted(self.hashes, hashes[some])
        out[some] = at < len(self.hashes)
        some, at = some[at < len(self.hashes)], at[at < len(self.hashes)]
        out[some] = self.hashes[at] == hashes[some]
        return out


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")


def _near(items: DataFrame) -> Benchmark | None:
    """The benchmark, if it is small enough to be broadcast."""
    n_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text") + F.octet_length("item_id") + 16), F.lit(0))).first()[0]
    if n_bytes > NEAR_BYTES:
        return None
    rows = items.toArrow()
    return Benchmark(rows.column("item_id").to_pylist(), rows.column("text").to_pylist())


SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean"


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of documents, in the columns of SCHEMA; items in string order."""
    items = _items(benchmark)
    near = _near(items)
    if near is not None:
        shared = documents.sparkSession.sparkContext.broadcast(near)
        chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        return chosen.mapInArrow(_text.frugal(lambda batches: _screen(batches, shared.value)), SCHEMA)
    rows = keyed(documents)
    windows, sets = _far_items(items)
    met = _far_windows(rows, items).join(windows, "gram")
    spans = met.groupBy("row_id", "row_hash").agg(F.collect_list("span_blob").alias("spans"))
    named = met.select("row_id", "row_hash", "set_a", "set_b").distinct().join(sets, ["set_a", "set_b"]).select("row_id", "row_hash", "item_id").distinct()
    named = named.groupBy("row_id", "row_hash").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = rows.join(spans, ["row_id", "row_hash"], "left").join(named, ["row_id", "row_hash"], "left")
    return found.select("doc_id", "text", "spans", "items").mapInArrow(_text.frugal(_measure), SCHEMA)


def uncontaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of documents, all columns, that hold no window of the benchmark."""
    items = _items(benchmark)
    near = _near(items)
    if near is None:
        windows, _ = _far_items(items)
        hit = _far_windows(keyed(documents), items).join(windows, "gram", "left_semi").select("row_id", "row_hash").distinct()
        row_id, row_hash, _ = key_columns(documents)
        rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), row_id.alias("row_id"), row_hash.alias("row_hash"))
        return rows.join(hit, ["row_id", "row_hash"], "left_anti").select("row.*")
    shared, at = documents.sparkSession.sparkContext.broadcast(near), documents.columns.index("text")

    def run(batches):
        for batch in batches:
            clean = np.ones(batch.num_rows, dtype=bool)
            for i, _, docs in _blocks_of(batch, at):
                clean[i + docs.owner[shared.value.hits(docs)[0]]] = False
            yield batch.filter(pa.array(clean))

    return documents.mapInArrow(_text.frugal(run), documents.schema)


def _blocks_of(batch: pa.RecordBatch, column: int = 1):
    buf, offs = _text.flat(batch.column(column))
    for i, j in _text.slices(offs):
        yield i, j, Words(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])


def _screen(batches, benchmark: Benchmark):
    for batch in batches:
        for i, j, docs in _blocks_of(batch):
            first, end, sets = benchmark.hits(docs)
            n_hit = _text.per_row_sum(_text.covered(len(docs.owner), first, end), docs.woffs)
            yield _result(batch.column(0)[i:j], np.diff(docs.woffs), n_hit, benchmark.items_of(docs.owner[first], sets, j - i))


# A benchmark that isn't broadcast


def _slots(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - _FAR_TABLE_BITS)).astype(np.int64)


def _far_items(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """gram, set_a, set_b: the different windows and the sets of their items; and set_a, set_b, item_id."""

    def run(batches):
        for batch in batches:
            for i, j, words in _blocks_of(batch):
                ids = batch.column(0)[i:j].to_pylist()
                for n, first in words.item_windows():
                    yield pa.record_batch([pa.array(words.texts_of(first, n), pa.string()), pa.array([ids[k] for k in words.owner[first].tolist()], pa.string())], names=["gram", "item_id"])

    each = items.mapInArrow(_text.frugal(run), "gram string, item_id string").distinct()
    windows = each.groupBy("gram").agg(F.bit_xor(F.xxhash64("item_id")).alias("set_a"), F.bit_xor(F.xxhash64(F.lit(1), "item_id")).alias("set_b"))
    return windows, each.join(windows, "gram").select("set_a", "set_b", "item_id").distinct()


def _far_windows(rows: DataFrame, items: DataFrame) -> DataFrame:
    """gram, row_id, row_hash, span_blob: the windows of keyed rows around grams that the items' bits hold, each once a row and block."""

    def mark(batches):
        for batch in batches:
            for _, _, words in _blocks_of(batch):
                slot = np.unique(_slots(words.kept_grams()[1]))
                bits = np.left_shift(np.uint64(1), (slot & 63).astype(np.uint64)).view(np.int64)
                short = [n for n, _ in words.item_windows() if n < WINDOW]
                yield pa.record_batch([pa.array(np.append(slot >> 6, -np.array(short, dtype=np.int64))), pa.array(np.append(bits, np.zeros(len(short), np.int64)))], names=["word", "bits"])

    # at most 2 ** _FAR_TABLE_BITS bits, whatever the benchmark holds
    marked = items.mapInArrow(_text.frugal(mark), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    word, bits = marked.column("word").to_numpy(), marked.column("bits").to_numpy().view(np.uint64)
    table = np.zeros(1 << (_FAR_TABLE_BITS - 6), dtype=np.uint64)
    table[word[word >= 0]] = bits[word >= 0]
    shared = rows.sparkSession.sparkContext.broadcast((table, sorted((-word[word < 0]).tolist())))

    def run(batches):
        table, short = shared.value
        for batch in batches:
            row_id, row_hash = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            for i, _, docs in _blocks_of(batch):
                first, grams = docs.kept_grams()
                slot = _slots(grams)
                some = (table[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0
                for n, chosen in [(WINDOW, docs.around(first[some])), *((n, docs.whole(np.arange(len(docs.owner)), n)) for n in short)]:
                    row = docs.owner[chosen]
                    places: dict[tuple[int, str], list[int]] = {}
                    for r, gram, at in zip(row.tolist(), docs.texts_of(chosen, n), (chosen - docs.woffs[row]).tolist()):
                        places.setdefault((r, gram), []).append(at)
                    own = np.array([r for r, _ in places], dtype=np.int64)
                    blobs = [_packed.merged_blob(np.array(x), np.array(x) + n) for x in places.values()]
                    yield pa.record_batch(
                        [pa.array([g for _, g in places], pa.string()), pa.array(row_id[i + own]), pa.array(row_hash[i + own]), pa.array(blobs, pa.binary())],
                        names=["gram", "row_id", "row_hash", "span_blob"],
                    )

    return rows.mapInArrow(_text.frugal(run), "gram string, row_id long, row_hash long, span_blob binary")


def _measure(batches):
    for batch in batches:
        for i, j, docs in _blocks_of(batch):
            spans, items = batch.column(2)[i:j].to_pylist(), batch.column(3)[i:j].to_pylist()
            n_words = np.diff(docs.woffs)
            n_hit = np.array([int((r[:, 1] - r[:, 0]).sum()) for r in (_packed.merged(s, n) for s, n in zip(spans, n_words))], dtype=np.int64)
            yield _result(batch.column(0)[i:j], n_words, n_hit, [x or [] for x in items])


def _result(doc_id, n_words, n_hit, items) -> pa.RecordBatch:
    cols = [doc_id.cast(pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(n_hit > 0)]
    return pa.record_batch(cols, names=["doc_id", "n_words", "n_hit", "n_items", "items", "contaminated"])


def items_digest(items: list[str]) -> str:
    """The digest of op1's contract, for tests."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
