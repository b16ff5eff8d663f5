"""Merging of new events into memory: duplicates, echoes, supersession, priorities, decay.

Two forms of one semantics.  `merge_in_order` folds a project's candidates one by one, as
their order asks, in one task per project and batch; it is the reference for small batches.
`merge_sets` states the same steps as joins, for batches whose candidates come from one piece
of evidence each and don't restate one another: then order can't matter, and nothing but
matching rows meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions.similarity import ECHO_JACCARD, SAME_EDITS, SAME_JACCARD, SUBJECT_JACCARD, edits_within, jaccard
from recollect.functions.text import derive_subject, overlap_tokens
from recollect.functions.weights import authority_rank
from recollect.operators.tables import ARCHIVE_BELOW, BUMP, MOST_WEIGHT, active
from recollect.plans.checkpoints import cut
from recollect.schemas import CHOICE_FAMILY, EVENT_TYPES, EVENTS, SUPERSESSION_TYPES

# Fixed values.
DECAY = 0.92
PROTECTED = ("CONSTRAINT_HARD", "APPROACH_ABANDONED_DO_NOT_RETRY")
PRIORITY = {"APPROACH_ABANDONED_DO_NOT_RETRY": 1, "CONSTRAINT_HARD": 2, "APPROACH_ABANDONED": 3}


def unmerged(batch: DataFrame, provenance: DataFrame) -> DataFrame:
    """The batch without events of evidence that has been merged before: a replay changes nothing."""
    done = provenance.select(F.col("raw_evidence_id").alias("evidence_id")).distinct()
    return batch.join(done, "evidence_id", "left_anti")


def comparable(events: DataFrame) -> DataFrame:
    """events or texts with what comparisons need: tokens and derived subject."""
    return events.withColumn("tokens", overlap_tokens(F.col("description"))).withColumn("topic", derive_subject(F.col("description")))


def _name(project: str, digest: Column) -> Column:
    """Half of a digest of a project and a digest."""
    return F.unhex(F.substring(F.sha2(F.concat_ws("\0", F.col(project).cast("string"), digest), 256), 1, 32))


def _texts(events: DataFrame) -> DataFrame:
    """events with `said`: one name for the equal descriptions of a project."""
    return events.withColumn("said", _name("project_id", F.coalesce(F.sha2("description", 256), F.lit(""))))


def _once(new: DataFrame, old: DataFrame, kinds: tuple[Column, Column] | None = None) -> DataFrame:
    """project_id, said, description, is_new, is_old: the texts of both sides, `_texts`, each once; they are taken apart only after this.

    kinds: bits of rows, new and old; asked and own are those of a text's rows.
    """
    asked, own = kinds or (F.lit(0), F.lit(0))
    rows = lambda df, fresh: df.where("project_id is not null").select("project_id", "said", "description", F.lit(fresh).alias("fresh"), (asked if fresh else F.lit(0)).alias("asked"), (F.lit(0) if fresh else own).alias("own"))
    bits = [F.bit_or(c).alias(c) for c in ("asked", "own")] if kinds else []
    return rows(new, True).union(rows(old, False)).groupBy("project_id", "said").agg(F.first("description").alias("description"), F.bool_or("fresh").alias("is_new"), (~F.bool_and("fresh")).alias("is_old"), *bits)


#: Texts of a block and their characters at most; a block of new texts meets one of old ones in a task.
BLOCK, LEAST_BLOCK, BLOCK_CHARS = 2048, 256, 4 << 20
#: Letters of a gram, those of texts under so many letters, and the buckets of grams.
GRAM, SHORT_GRAM, SHORT, BUCKETS = 5, 3, 48, 1 << 20
#: Letters of the grams of short texts that must be found near their places, too, and the pairs that are passed on together.
PLACED_GRAM, PASSED = 4, 1 << 16
#: Letters from which on edits are counted where texts meet, not after.
LONG = 128
#: New texts that are multiplied at once, half as many from so many letters on, and cells and columns of a matrix.
STRIP, HALF_STRIP_FROM, CELLS, COLUMNS = 256, 1024, 1 << 21, 1 << 15
#: Where texts meet: all of a project, those of a type (from 0), those of like topics (from TOPICS); and texts with a topic that share such a place.
ALL, TOPICS, TOLD = -1, 64, 512
#: Types and one for all others.
MOST_KINDS = len(EVENT_TYPES) + 1


def _bits(types: tuple[str, ...]) -> Column:
    """A bit for each type, one more for all others."""
    return F.coalesce(*[F.when(F.col("event_type") == t, F.lit(1 << k)) for k, t in enumerate(types)], F.when(F.col("event_type").isNotNull(), F.lit(1 << len(types))), F.lit(0))


def _candidates(new: DataFrame, old: DataFrame, kinds: tuple[Column, Column] | None = None, family: int = 0) -> DataFrame:
    """Pairs of texts of a project that may be alike: none that is alike is missing.

    Both sides are `_texts`.  Rows with equal texts are one before anything meets, so what is
    said often costs what is said once.  With new_said and old_said go project_id, both
    descriptions, their Jaccard similarity `shared`, and whether they tell one topic.  Blocks of
    texts meet, not texts: a task bounds what each pair has in common by products of matrices
    and passes a pair on if its tokens or topic say that it is alike, or its grams that the edit
    bound may hold.

    kinds: bits of new and old rows; only pairs with a bit in common are asked for, and pairs of
    one topic that both have a bit of `family`.  Texts then meet by bit, and by topic, unless so
    many have several bits that meeting at once is less work.
    """
    sides = F.explode(F.array_compact(F.array(F.when(F.col("is_new"), True), F.when(F.col("is_old"), False)))).alias("fresh")
    both = cut(comparable(_once(new, old, kinds)).withColumn("plain", F.lower(F.trim("description"))))
    mask = F.when(F.col("fresh"), F.col("asked")).otherwise(F.col("own")) if kinds else F.lit(0)
    both = both.select("*", sides).withColumn("mask", mask).drop("is_new", "is_old", "asked", "own")
    places = [F.lit(ALL)]
    if kinds:
        has = lambda bits: F.col("mask").bitwiseAND(F.lit(bits)) != 0
        told = (F.col("topic") != "") & has(family)
        both = both.join(both.groupBy("project_id").agg(F.greatest(F.lit(1), F.ceil(F.count_if(told) / TOLD)).alias("buckets")), "project_id")
        places += [F.when(has(1 << k), F.lit(k)) for k in range(MOST_KINDS)] + [F.when(told, F.lit(TOPICS) + F.pmod(F.xxhash64("topic"), F.col("buckets")).cast("int"))]
    both = both.withColumn("place", F.explode(F.array_compact(F.array(*places)))).drop("buckets")
    side = lambda fresh, c: F.coalesce(F.sum(F.when(F.col("fresh") == fresh, c)), F.lit(0))
    block = F.greatest(F.lit(LEAST_BLOCK), F.least(F.lit(BLOCK), F.lit(both.where(F.col("place") == ALL).count() // 32)))
    n_blocks = lambda fresh: F.greatest(F.ceil(side(fresh, F.lit(1)) / block), F.ceil(side(fresh, F.char_length("description")) / BLOCK_CHARS)).cast("int")
    work = (side(True, F.lit(1)) * side(False, F.lit(1))).alias("work")
    sizes = cut(both.groupBy("project_id", "place").agg(n_blocks(True).alias("nb"), n_blocks(False).alias("ob"), work).where("nb > 0 and ob > 0"))
    if kinds:
        least = sizes.groupBy("project_id").agg((F.sum(F.when(F.col("place") == ALL, F.col("work"))) <= F.coalesce(F.sum(F.when(F.col("place") != ALL, F.col("work"))), F.lit(0))).alias("at_once"))
        sizes = sizes.join(least, "project_id").where((F.col("place") == ALL) == F.col("at_once"))
    n_tasks = sizes.agg(F.sum(F.col("nb") * F.col("ob"))).first()[0] or 1
    own = F.pmod(F.xxhash64("said"), F.when(F.col("fresh"), F.col("nb")).otherwise(F.col("ob"))).cast("int")
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("fresh"), F.col("ob")).otherwise(F.col("nb")) - 1))
    placed = both.join(sizes, ["project_id", "place"]).withColumn("own", own).withColumn("across", across)
    placed = placed.withColumn("i", F.when(F.col("fresh"), F.col("own")).otherwise(F.col("across"))).withColumn("j", F.when(F.col("fresh"), F.col("across")).otherwise(F.col("own")))
    keys = ["project_id", "place", "i", "j"]
    placed = placed.select(*keys, "said", "description", "plain", "tokens", "topic", "mask", "fresh").repartition(min(4 * n_tasks, 8192), *keys)
    kind = both.schema["project_id"].dataType.simpleString()
    return placed.groupBy(*keys).applyInArrow(_meet, f"project_id {kind}, new_said binary, old_said binary, new_text string, old_text string, shared double, one_topic boolean")


def _alike(met: DataFrame) -> DataFrame:
    """`_candidates` with `alike`: one of the two texts replaces the other."""
    return met.withColumn("alike", (F.col("shared") >= SAME_JACCARD) | F.col("one_topic") | F.coalesce(edits_within(F.col("new_text"), F.col("old_text")), F.lit(False)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`_candidates` of one block of new texts and one of old ones."""
    texts = pa.Table.from_batches(batches).combine_chunks()
    length = pa.compute.fill_null(pa.compute.utf8_length(texts.column("plain")), -1).to_numpy()
    texts, length = texts.take(pa.array(by := np.argsort(length, kind="stable"))), length[by]  # texts of like length are neighbours
    fresh = texts.column("fresh").to_numpy()
    new, old = np.flatnonzero(fresh), np.flatnonzero(~fresh)
    if not len(new) or not len(old):
        return
    place, mask = texts.column("place")[0].as_py(), texts.column("mask").to_numpy()
    lists = texts.column("tokens").combine_chunks()
    size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy().astype(np.int64)
    codes = lists.flatten().dictionary_encode()
    tokens = _Items(codes.indices.to_numpy().astype(np.int64), size)
    marked, buckets = np.zeros(len(codes.dictionary), dtype=bool), np.zeros(BUCKETS, dtype=bool)
    plain = texts.column("plain").to_pylist()
    letters = np.frombuffer("".join(t or "" for t in plain).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    few = int(np.searchsorted(length, SHORT / (1 - SAME_EDITS) + 2))  # what short texts may be alike with
    grams = {k: _Items(*_grams(letters[: int(n.sum())], n, k)) for k, n in ((SHORT_GRAM, np.maximum(length[:few], 0)), (GRAM, np.maximum(length, 0)))} if place < TOPICS else {}
    placed = {SHORT_GRAM: _Placed(letters[: int(np.maximum(length[:few], 0).sum())], np.maximum(length[:few], 0), PLACED_GRAM), GRAM: _Placed(letters, np.maximum(length, 0), GRAM)} if grams else {}
    topic = pa.compute.fill_null(texts.column("topic"), "").combine_chunks().dictionary_encode()
    topic, untold = topic.indices.to_numpy(), topic.dictionary.index("").as_py()
    columns = [texts.column(c).combine_chunks() for c in ("project_id", "said", "description")]
    at, m, s = length[old], size[old], topic[old]
    held, n_held = [], 0

    def passed() -> pa.RecordBatch:
        i, j, shared, one_topic = (np.concatenate(x) for x in zip(*held))
        ends = [c.take(pa.array(k)) for c in columns[1:] for k in (i, j)]
        return pa.record_batch([columns[0].take(pa.array(i)), *ends, pa.array(shared), pa.array(one_topic)], names=["project_id", "new_said", "old_said", "new_text", "old_text", "shared", "one_topic"])

    def by_words(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs (row, old one) as numbers whose tokens or topic may make them alike."""
        a, t, width = size[rows][:, None], topic[rows][:, None], _width(4 * int(size[rows].max()))
        mine, told = tokens.counted(rows, width), (t != untold).any()
        for low in range(0, len(old), step := CELLS // width):
            part = slice(low, low + step)
            most = mine @ tokens.counted(old[part], width).T * 1.01  # more than rounding takes
            some = (most >= SAME_JACCARD / (1 + SAME_JACCARD) * (a + m[part])) & (most > 0) if place < TOPICS else np.zeros(most.shape, dtype=bool)
            if told:
                some |= (t == s[part]) & (t != untold) & (most >= SUBJECT_JACCARD / (1 + SUBJECT_JACCARD) * (a + m[part]))
            r, c = np.nonzero(some)
            yield r * len(old) + low + c

    gram_of = lambda i: SHORT_GRAM if length[i] < SHORT else GRAM

    def by_letters(rows: np.ndarray) -> Iterator[np.ndarray]:
        """Pairs (row, old one) as numbers that the edit bound may hold: an edit touches so many grams as one has letters."""
        n, k = length[rows][:, None], gram_of(rows[0])
        first = max(np.searchsorted(at, n[0, 0] - int(n[0, 0] * SAME_EDITS) - 1), np.searchsorted(at, 0))
        last = np.searchsorted(at, n[-1, 0] / (1 - SAME_EDITS) + 1, side="right")
        width = _width(16 * int(n[-1, 0]))
        mine = grams[k].counted(rows, width)
        for low in range(first, last, step := CELLS // width):
            part = slice(low, min(low + step, last))
            most = mine @ grams[k].counted(old[part], width).T * 1.01
            longest = np.maximum(at[part], n)
            bound = np.floor(longest * SAME_EDITS)
            r, c = np.nonzero((np.abs(at[part] - n) <= bound) & (most >= longest - k + 1 - k * bound))
            yield r * len(old) + low + c

    for rows in _strips(new, length):
        words = np.concatenate(list(by_words(rows)))
        edits = np.concatenate([words[:0], *by_letters(rows)]) if place < TOPICS and length[rows[0]] >= 0 else words[:0]
        pairs = np.union1d(words, edits)
        r, c = pairs // len(old), pairs % len(old)
        if place != ALL:  # a pair of several types meets once, by the first
            common = mask[rows[r]] & mask[old[c]]
            kept = common & -common == 1 << place if place < TOPICS else common == 0
            pairs, r, c = pairs[kept], r[kept], c[kept]
        few_edits = np.isin(pairs, edits, assume_unique=True)
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        for low, high in zip(starts.tolist(), [*starts[1:].tolist(), len(r)]):
            i, j = rows[r[low]], c[low:high]
            both = tokens.common(i, old[j], marked)
            shared = both / np.maximum(size[i] + m[j] - both, 1)
            one_topic = (s[j] == topic[i]) & (topic[i] != untold) & (shared >= SUBJECT_JACCARD)
            some = (shared >= SAME_JACCARD) | one_topic if place < TOPICS else one_topic
            near = np.flatnonzero(few_edits[low:high] & ~some)
            if len(near):
                k, longest = gram_of(i), np.maximum(at[j], length[i])
                bound = np.floor(longest * SAME_EDITS).astype(np.int64)
                near = near[grams[k].common(i, old[j[near]], buckets) >= (longest - k + 1 - k * bound)[near]]
                near = near[placed[k].enough(i, old[j[near]], bound[near])]
                if length[i] > LONG and len(near):  # a pair of long texts costs more to compare than all before
                    holds = _at_most(plain[i])
                    near = near[[holds(plain[old[j[x]]], int(bound[x])) for x in near.tolist()]]
                some[near] = True
            hit = np.flatnonzero(some)
            while len(hit):
                part, hit = hit[:PASSED], hit[PASSED:]
                held.append((np.full(len(part), i), old[j[part]], shared[part], one_topic[part]))
                n_held += len(part)
                if n_held >= PASSED:
                    yield passed()
                    held, n_held = [], 0
    if held:
        yield passed()


def _strips(rows: np.ndarray, length: np.ndarray) -> Iterator[np.ndarray]:
    """Rows by length, so many that are multiplied at once: without a text, short, and others."""
    ends = np.searchsorted(length[rows], (0, SHORT))
    for part in np.split(rows, ends):
        while len(part):
            step = STRIP if length[part[:STRIP][-1]] < HALF_STRIP_FROM else STRIP // 2
            yield part[:step]
            part = part[step:]


def _width(n: int) -> int:
    """Columns that n items are dealt to: a power of two."""
    return min(max(128, 1 << max(n - 1, 0).bit_length()), COLUMNS)


class _Items:
    """Items (small integers, those of a row side by side) of rows."""

    def __init__(self, items: np.ndarray, size: np.ndarray):
        self.items, self.size, self.start = items, size, np.cumsum(size) - size

    def _of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = self.size[rows]
        ends = np.cumsum(n)
        return self.items[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[rows] - (ends - n), n)], n

    def counted(self, rows: np.ndarray, width: int) -> np.ndarray:
        """How many items of each row fall into each of `width` columns: products of two rows are no less than what they share."""
        items, n = self._of(rows)
        return np.bincount(np.repeat(np.arange(len(rows)) * width, n) + (items & (width - 1)), minlength=len(rows) * width).reshape(len(rows), width).astype(np.float32)

    def common(self, i: int, rows: np.ndarray, marked: np.ndarray) -> np.ndarray:
        """How many items row i shares with each of the rows; marked: a false for each item there is."""
        own = self.items[self.start[i] : self.start[i] + self.size[i]]
        marked[own] = True
        items, n = self._of(rows)
        found, ends = np.concatenate(([0], np.cumsum(marked[items]))), np.cumsum(n)
        marked[own] = False
        return found[ends] - found[ends - n]


def _at_most(text: str) -> Callable[[str, int], bool]:
    """Whether a text is within so many edits of this one: columns of the table as bits, left once too many edits are certain."""
    letters, m = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32), len(text)
    where = {chr(x): int.from_bytes(np.packbits(letters == x, bitorder="little").tobytes(), "little") for x in np.unique(letters).tolist()}
    full, top = (1 << m) - 1, 1 << (m - 1)

    def holds(other: str, bound: int) -> bool:
        up, down, score, left = full, 0, m, len(other)
        for letter in other:
            same = where.get(letter, 0)
            across = ((((same & up) + up) ^ up) | same) & full
            rise, fall = down | (full & ~(across | up)), up & across
            score, left = score + bool(rise & top) - bool(fall & top), left - 1
            if score - left > bound:
                return False
            rise, either = (rise << 1) | 1, same | down
            up, down = ((fall << 1) | ~(either | rise)) & full, rise & either & full
        return score <= bound

    return holds


def _mixed(x: np.ndarray) -> np.ndarray:
    """Buckets of hashes."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def _in_order(letters: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the k-letter grams of texts, their places, and how many each text has."""
    n = np.maximum(length - k + 1, 0)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at, gram = place + np.repeat(np.cumsum(length) - length, n), np.zeros(len(place), dtype=np.uint64)
    for step in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + letters[at + step]
    return gram, place, n


def _grams(letters: np.ndarray, length: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of each text's k-letter grams, the second occurrence of a gram unlike the first, and how many a text has."""
    gram, _, n = _in_order(letters, length, k)
    bits = np.uint64(max(1, len(n).bit_length()))
    gram = (gram ^ (gram >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)  # the last letters count in high bits, too
    gram = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << (np.uint64(64) - bits)) | (gram >> bits)
    gram.sort()  # within each text
    place, first = np.arange(len(gram)), np.ones(len(gram), dtype=bool)
    first[1:] = gram[1:] != gram[:-1]
    again = place - np.maximum.accumulate(np.where(first, place, 0))
    return _mixed((gram << bits) + again.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)), n


class _Placed:
    """Grams of texts with their places: those that edits leave are found again, moved by no more than there are edits."""

    def __init__(self, letters: np.ndarray, length: np.ndarray, k: int):
        self.gram, self.place, self.n = _in_order(letters, length, k)
        self.k, self.start, self.marked = k, np.cumsum(self.n) - self.n, np.zeros(BUCKETS, dtype=bool)

    def enough(self, i: int, row: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether the rows hold so many grams of row i that `bound` edits may part them."""
        if not len(row):
            return np.zeros(0, dtype=bool)
        width = max(1, (int(bound.max()) + 1) // 2)
        salt = np.uint64(0xD6E8FEB86659FD93)
        own = slice(self.start[i], self.start[i] + self.n[i])
        for step in range(-2, 3):
            self.marked[_mixed(self.gram[own] + (self.place[own] // width + step).astype(np.uint64) * salt)] = True
        n = self.n[row]
        ends = np.cumsum(n)
        at = np.arange(ends[-1]) + np.repeat(self.start[row] - (ends - n), n)
        found = np.concatenate(([0], np.cumsum(self.marked[_mixed(self.gram[at] + (self.place[at] // width).astype(np.uint64) * salt)])))
        self.marked[:] = False
        return found[ends] - found[ends - n] >= n - self.k * bound


def _posted(sets: DataFrame, least: float) -> DataFrame:
    """said, project_id, key: the rarest tokens of each set, enough of them for any pair with Jaccard `least` to meet."""
    tokens = sets.select("said", "project_id", F.explode("tokens").alias("key"))
    return cut(_rarest(tokens, lambda size: size - F.ceil(size * F.lit(least) - F.lit(1e-9)).cast("int") + 1))


def _rarest(keys: DataFrame, most: Callable[[Column], Column]) -> DataFrame:
    """said, project_id, key: of each text's keys so many (most of their number) that the fewest texts have."""
    frequency = keys.groupBy("key").agg(F.count(F.lit(1)).alias("df"))
    ranked = keys.join(frequency, "key").groupBy("said", "project_id").agg(F.array_sort(F.collect_list(F.struct("df", "key"))).alias("r"), most(F.count(F.lit(1))).alias("n"))
    return ranked.select("said", "project_id", F.explode(F.slice("r", F.lit(1), F.col("n").cast("int"))).alias("k")).select("said", "project_id", F.col("k.key").alias("key"))


def similar(a: str, b: str) -> Column:
    """One statement replaces another: enough shared tokens, few edits, or one topic and some shared tokens."""
    shared = jaccard(F.col(f"{a}.tokens"), F.col(f"{b}.tokens"))
    topic = (F.col(f"{a}.topic") != "") & (F.col(f"{a}.topic") == F.col(f"{b}.topic")) & (shared >= 0.3)
    return (shared >= 0.6) | topic | edits_within(F.col(f"{a}.description"), F.col(f"{b}.description"))


def echoes(new: DataFrame, old: DataFrame) -> DataFrame:
    """id, echo_id: the active event of the same type that a new one restates, by the most shared tokens, then the highest id.

    Equal hashes are duplicates, not echoes.  Sets of tokens meet,
    however many texts have them: of the old events of a set and type only the highest id can be
    the answer, or the highest of another hash than that one's.
    """
    heard = lambda df: _texts(df.where("project_id is not null and content_hash is not null").select("id", "project_id", "description", "event_type", "content_hash"))
    n, o = heard(new), heard(active(old))
    texts = _once(n, o).withColumn("tokens", F.array_sort(overlap_tokens(F.col("description")))).drop("description")
    texts = cut(texts.withColumn("set", _name("project_id", F.sha2(F.array_join("tokens", " "), 256))))
    of_set = texts.select(F.col("said").alias("text"), "set")
    n, o = (df.withColumnRenamed("said", "text").join(of_set, "text").drop("text", "description").withColumnRenamed("set", "said") for df in (n, o))
    one = lambda flag: texts.where(flag).groupBy("project_id", F.col("set").alias("said")).agg(F.first("tokens").alias("tokens"))
    ns, os = cut(one("is_new")), cut(one("is_old"))
    posted = _posted(ns.union(os).dropDuplicates(["said"]), ECHO_JACCARD)
    left = ns.select("said").join(posted, "said").withColumnRenamed("said", "new_said")
    right = os.select("said").join(posted, "said").withColumnRenamed("said", "old_said")
    met = left.join(right, ["project_id", "key"]).select("new_said", "old_said").distinct()
    whole = met.join(ns.select(F.col("said").alias("new_said"), F.col("tokens").alias("x")), "new_said").join(os.select(F.col("said").alias("old_said"), F.col("tokens").alias("y")), "old_said")
    met = whole.select("new_said", "old_said", jaccard(F.col("x"), F.col("y")).alias("j")).where(F.col("j") >= ECHO_JACCARD)
    return _restated(n, o, met)


def _restated(n: DataFrame, o: DataFrame, met: DataFrame) -> DataFrame:
    """`echoes` of events with `said` by the pairs met (new_said, old_said, j)."""
    asked = n.select(F.col("said").alias("new_said"), "event_type", F.col("content_hash").alias("hn")).distinct()
    last = o.groupBy(F.col("said").alias("old_said"), "event_type", F.col("content_hash").alias("ho")).agg(F.max("id").alias("echo_id"))
    last = last.withColumn("place", F.row_number().over(Window.partitionBy("old_said", "event_type").orderBy(F.desc("echo_id"), "ho"))).where("place <= 2")
    best = asked.join(met, "new_said").join(last, ["old_said", "event_type"]).where("hn <> ho").groupBy("new_said", "event_type", "hn").agg(F.max_by("echo_id", F.struct("j", "echo_id")).alias("echo_id"))
    ids = n.select("id", F.col("said").alias("new_said"), "event_type", F.col("content_hash").alias("hn"))
    return ids.join(best, ["new_said", "event_type", "hn"]).select("id", "echo_id")


def _met(new: DataFrame, old: DataFrame) -> DataFrame:
    """`_candidates` of `_texts` that are alike: of events of one type, or of one topic and two types of choice."""
    bits = _bits(EVENT_TYPES)
    return _alike(_candidates(new, old, (bits, bits), sum(1 << EVENT_TYPES.index(t) for t in CHOICE_FAMILY))).where("alike")


def superseded(new: DataFrame, old: DataFrame, judge: Callable[[Column, Column], Column] | None = None, threshold: float = 0.5, met: DataFrame | None = None) -> DataFrame:
    """old_id, superseded_by: active events that new ones replace, each by the first new one (by id).

    met: `_met` of these texts or more, if it is at hand.

    judge: any pandas UDF or expression of two descriptions (new, old) that says how likely
    one replaces the other; what is alike must then also reach the threshold.

    A replacement comes from other evidence, isn't older, and has at least the authority.  Of
    its own type it needs similarity; of another type of choice, the same topic.
    """
    kinds = ["said", "event_type", "content_hash", "rank"]
    ranked = lambda df: _texts(df).withColumn("rank", authority_rank(F.col("authority")))
    n, o = ranked(new.where(F.col("event_type").isin(*SUPERSESSION_TYPES))), ranked(active(old))
    met = _met(n, o) if met is None else met
    if judge is not None:  # after everything cheaper
        met = met.where(judge(F.col("new_text"), F.col("old_text")) >= threshold)
    met = met.select("new_said", "old_said", "project_id", "alike", "one_topic")
    # kinds of events, by what the gates read besides time and evidence
    nk = n.select(*kinds).distinct().select(F.col("said").alias("new_said"), F.struct(*kinds).alias("nk"))
    ok = o.select(*kinds).distinct().select(F.col("said").alias("old_said"), F.struct(*kinds).alias("ok"))
    family = F.col("nk.event_type").isin(*CHOICE_FAMILY) & F.col("ok.event_type").isin(*CHOICE_FAMILY)
    hit = F.when(F.col("nk.event_type") == F.col("ok.event_type"), F.col("alike")).otherwise(family & F.col("one_topic"))
    name = lambda c: F.xxhash64(f"{c}.said", f"{c}.event_type", f"{c}.content_hash", f"{c}.rank")
    links = met.join(nk, "new_said").join(ok, "old_said").where((F.col("nk.content_hash") != F.col("ok.content_hash")) & (F.col("nk.rank") >= F.col("ok.rank")) & hit)
    links = links.select("project_id", name("ok").alias("old_kind"), name("nk").alias("new_kind"))
    row = lambda df, fresh: df.select("project_id", F.xxhash64(*kinds).alias("kind"), F.col("id").cast("long").alias("id"), F.col("created_at").cast("long").alias("at"), F.col("evidence_id").cast("long").alias("evidence"), F.lit(fresh).alias("fresh"))
    rows = row(n, True).union(row(o, False))
    return rows.groupBy("project_id").cogroup(links.groupBy("project_id")).applyInArrow(_first_after, "old_id long, superseded_by long")


#: Pairs of an old event and a kind of new ones that are looked at together.
LOOKED_AT = 1 << 20


def _first_after(rows: pa.Table, links: pa.Table) -> pa.Table:
    """old_id, superseded_by: for each old event the least id of its kinds' new ones that aren't older and have other evidence.

    New events of a kind are sorted by time, with the least id from each on, and the least of
    other evidence than that one's; so a kind is looked up, whatever the number of its events.
    """
    few = np.iinfo(np.int64)
    fresh = rows.column("fresh").to_numpy()
    of = lambda name, missing: pa.compute.fill_null(rows.column(name), missing).to_numpy()
    kind, ids = rows.column("kind").to_numpy(), rows.column("id").to_numpy()
    known = pa.compute.is_valid(rows.column("evidence")).to_numpy()
    evidence = of("evidence", 0)
    at = np.where(fresh, of("at", few.max), of("at", few.min))  # without a time, new ones are never older, nor old ones newer
    kinds, place = np.unique(kind, return_inverse=True)
    times, when = np.unique(at, return_inverse=True)
    key = place * (len(times) + 1) + when
    order = np.flatnonzero(fresh)
    order = order[np.argsort(key[order], kind="stable")]
    best, second = np.full((2, len(order) + 1), few.max)
    whose = np.full(len(order) + 1, -1)  # the row of the best
    for k in range(len(order) - 1, -1, -1):
        r = order[k]
        b, w, s = (best[k + 1], whose[k + 1], second[k + 1]) if k + 1 < len(order) and place[order[k + 1]] == place[r] else (few.max, -1, few.max)
        own = w >= 0 and known[r] and known[w] and evidence[r] == evidence[w]
        if ids[r] < b:
            b, w, s = ids[r], r, s if own else b
        elif not own and ids[r] < s:
            s = ids[r]
        best[k], whose[k], second[k] = b, w, s
    sorted_keys = key[order]
    old = np.flatnonzero(~fresh)
    a, b = np.searchsorted(kinds, links.column("old_kind").to_numpy()), np.searchsorted(kinds, links.column("new_kind").to_numpy())
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    low, high = np.searchsorted(a, place[old]), np.searchsorted(a, place[old], side="right")
    found = np.full(len(old), few.max)
    some = np.flatnonzero(high > low)
    ends = np.cumsum(high[some] - low[some])
    at_part = 0
    while at_part < len(some):
        done = ends[at_part - 1] if at_part else 0
        stop = max(at_part + 1, int(np.searchsorted(ends, done + LOOKED_AT, side="right")))
        part = some[at_part:stop]
        n = high[part] - low[part]
        which = np.repeat(part, n)
        link = np.repeat(low[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        spot = np.searchsorted(sorted_keys, b[link] * (len(times) + 1) + when[old[which]])
        inside = spot < len(order)
        inside[inside] = place[order[spot[inside]]] == b[link[inside]]
        which, spot = which[inside], spot[inside]
        w, r = whose[spot], old[which]
        same = known[w] & known[r] & (evidence[w] == evidence[r])
        np.minimum.at(found, which, np.where(same, second[spot], best[spot]))
        at_part = stop
    hit = found < few.max
    return pa.table({"old_id": ids[old[hit]], "superseded_by": found[hit]})


def duplicates_across_types(events: DataFrame) -> DataFrame:
    """old_id, superseded_by: of similar prohibitions of different types, the type of lower priority gives way.

    events: active; of several that outrank one, the highest priority and then the lowest id.
    Of the events of a type that say the same, only the lowest id can be the answer.
    """
    c = _texts(active(events).where(F.col("event_type").isin(*PRIORITY)))
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])[F.col("event_type")]
    own = _bits(tuple(sorted(PRIORITY, key=PRIORITY.get)))
    asked = F.lit((1 << len(PRIORITY)) - 1).bitwiseAND(-F.lit(2) * own)  # all that are outranked
    alike = _alike(_candidates(c, c, (asked, own))).where("alike").select("new_said", "old_said")
    first = c.groupBy("said", rank.alias("rank")).agg(F.min("id").alias("id"))
    n = first.select(F.col("said").alias("new_said"), F.col("rank").alias("nr"), F.col("id").alias("new_id"))
    o = first.select(F.col("said").alias("old_said"), F.col("rank").alias("orank"))
    won = alike.join(n, "new_said").join(o, "old_said").where("nr < orank").groupBy("old_said", "orank").agg(F.min_by("new_id", F.struct("nr", "new_id")).alias("superseded_by"))
    ids = c.select(F.col("id").alias("old_id"), F.col("said").alias("old_said"), rank.alias("orank"))
    return ids.join(won, ["old_said", "orank"]).select("old_id", "superseded_by")


def decayed(events: DataFrame, current: DataFrame, applied: DataFrame | None = None) -> DataFrame:
    """events after one decay for each project's current session (project_id, current_session).

    What other sessions stated loses 8 % of its weight, and what falls below 0.05 is archived
    unless its type is protected.  Sessions in `applied` (project_id, session_id) have had theirs.
    """
    due = current
    if applied is not None:
        due = current.join(applied.select("project_id", F.col("session_id").alias("current_session")), ["project_id", "current_session"], "left_anti")
    joined = events.join(due, "project_id", "left")
    ages = F.col("current_session").isNotNull() & (F.col("session_id") != F.col("current_session")) & ~F.col("archived")
    weight = F.when(ages, F.greatest(F.lit(0.0), F.col("weight") * DECAY)).otherwise(F.col("weight"))
    out = joined.withColumn("weight", weight)
    falls = F.col("current_session").isNotNull() & (F.col("weight") < ARCHIVE_BELOW) & ~F.col("event_type").isin(*PROTECTED)
    return out.withColumn("archived", F.col("archived") | falls).select(*events.columns)


def merge_sets(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state after a batch, as joins: hash duplicates, echoes, inserts, supersession, type priorities.

    The batch has ids above those of the state; candidates of one project that share evidence
    don't replace each other, and none restates another.
    """
    columns = state.columns
    known = state.select("project_id", "content_hash", F.col("id").alias("canon"), F.col("session_id").alias("canon_session"))
    first = F.row_number().over(Window.partitionBy("project_id", "content_hash").orderBy("id"))
    b = batch.withColumn("_n", first)
    again = b.join(known, ["project_id", "content_hash"]).select("canon", (F.col("session_id") != F.col("canon_session")).alias("elsewhere"), F.col("evidence_id").alias("ev"), F.lit(True).alias("revives"))
    fresh = cut(b.where("_n = 1").drop("_n").join(known.select("project_id", "content_hash"), ["project_id", "content_hash"], "left_anti").select(*columns))
    # all that echoes or replaces is found at once; what is archived may be revived
    met = cut(_met(_texts(fresh), _texts(state.where("superseded_by is null"))).select("project_id", "new_said", "old_said", "shared", "alike", "one_topic"))
    heard = lambda df: _texts(df.where("project_id is not null and content_hash is not null"))
    echo = cut(_restated(heard(fresh), heard(active(state)), met.where(F.col("shared") >= ECHO_JACCARD).select("new_said", "old_said", F.col("shared").alias("j"))))
    restated = fresh.join(echo, "id").join(state.select(F.col("id").alias("echo_id"), F.col("session_id").alias("canon_session")), "echo_id")
    folded = restated.select(F.col("echo_id").alias("canon"), (F.col("session_id") != F.col("canon_session")).alias("elsewhere"), F.col("evidence_id").alias("ev"), F.lit(False).alias("revives"))
    bumps = again.unionByName(folded).groupBy("canon").agg(F.count_if("elsewhere").alias("times"), F.first("ev", ignorenulls=True).alias("ev"), F.max("revives").alias("revives"))
    inserted = fresh.join(echo.select("id"), "id", "left_anti").select(*columns)
    bumped = state.join(bumps, state["id"] == bumps["canon"], "left")
    times = F.coalesce("times", F.lit(0))
    bumped = bumped.select(
        *[
            (F.col("mention_count") + times).alias(c)
            if c == "mention_count"
            else F.when(times > 0, F.least(F.col("weight") + times * BUMP, F.lit(MOST_WEIGHT))).otherwise(F.col("weight")).alias(c)
            if c == "weight"
            else (F.col("archived") & ~F.coalesce("revives", F.lit(False))).alias(c)
            if c == "archived"
            else F.coalesce("evidence_id", "ev").alias(c)
            if c == "evidence_id"
            else state[c]
            for c in columns
        ]
    )
    bumped, inserted = cut(bumped), cut(inserted)
    gone = superseded(inserted, bumped, met=met).withColumnRenamed("superseded_by", "_by")
    after = bumped.unionByName(inserted)
    after = after.join(gone, after["id"] == gone["old_id"], "left").withColumn("superseded_by", F.coalesce("superseded_by", "_by")).select(*columns)
    after = cut(after)
    lower = cut(duplicates_across_types(after).withColumnRenamed("superseded_by", "_by"))
    touched = lambda c: lower.join(inserted.select(F.col("id").alias(c)), c, "left_semi").select("old_id", "_by")
    lower = touched("old_id").union(touched("_by")).distinct()  # either end is new
    return after.join(lower, after["id"] == lower["old_id"], "left").withColumn("superseded_by", F.coalesce("superseded_by", "_by")).select(*columns)


def merge_in_order(state: DataFrame, batch: DataFrame) -> DataFrame:
    """state after folding each project's candidates in order of id, one after the other.

    A project's state and batch meet in one task, so this is for projects that fit there; the
    comparisons are made beforehand, as joins, and a task only follows them.
    """
    schema = EVENTS
    names = [part.split()[0] for part in schema.split(", ")]
    new, both = _texts(batch.select(*names)), _texts(state.select(*names).unionByName(batch.select(*names)))
    # what echoes has more than enough tokens in common to be alike
    met = _alike(_candidates(new, both)).where("alike").select("new_said", "old_said", F.col("shared").alias("j"), "alike", F.col("one_topic").alias("same_topic"))
    ids = lambda df, side: df.select("project_id", F.col("said").alias(f"{side}_said"), F.col("id").alias(f"{side}_id"))
    pairs = met.join(ids(new, "new"), "new_said").join(ids(both, "old"), ["old_said", "project_id"]).where("old_id <> new_id").select("project_id", "new_id", "old_id", "j", "alike", "same_topic")
    rank = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    marked = state.select(*names).withColumn("_new", F.lit(False)).unionByName(batch.select(*names).withColumn("_new", F.lit(True)))
    marked = marked.withColumn("_authority", authority_rank(F.col("authority"))).withColumn("_priority", F.coalesce(rank[F.col("event_type")], F.lit(0)))

    def fold(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        return _fold(rows, links)[names]

    return marked.groupBy("project_id").cogroup(pairs.groupBy("project_id")).applyInPandas(fold, schema)


def _fold(rows: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("id").astype(object).where(lambda d: d.notna(), None)
    records = {r["id"]: r for r in rows[~rows["_new"].astype(bool)].to_dict("records")}
    by_hash = {r["content_hash"]: k for k, r in records.items()}
    near: dict[int, list] = {}
    for link in links.itertuples():
        near.setdefault(link.new_id, []).append(link)

    def live(k) -> bool:
        return k in records and not records[k]["archived"] and records[k]["superseded_by"] is None

    def bump(k, event, revive: bool) -> None:
        r = records[k]
        if r["session_id"] != event["session_id"]:
            r["mention_count"] += 1
            r["weight"] = min(r["weight"] + BUMP, MOST_WEIGHT)
        r["evidence_id"] = event["evidence_id"] if r["evidence_id"] is None else r["evidence_id"]
        r["archived"] = False if revive else r["archived"]

    for event in rows[rows["_new"].astype(bool)].to_dict("records"):
        around = [x for x in near.get(event["id"], []) if live(x.old_id)]
        same = [x for x in around if records[x.old_id]["event_type"] == event["event_type"] and records[x.old_id]["content_hash"] != event["content_hash"]]
        restated = max(((x.j, x.old_id) for x in same if x.j >= ECHO_JACCARD), default=None)
        if restated:
            bump(restated[1], event, revive=False)
            continue
        if event["content_hash"] in by_hash:
            k = by_hash[event["content_hash"]]
            bump(k, event, revive=True)
        else:
            k = event["id"]
            records[k], by_hash[event["content_hash"]] = event, k
        if event["event_type"] in SUPERSESSION_TYPES:
            for x in around:
                old = records[x.old_id]
                if x.old_id == k or old["content_hash"] == event["content_hash"]:
                    continue
                if event["evidence_id"] is not None and old["evidence_id"] == event["evidence_id"]:
                    continue
                if None not in (old["created_at"], event["created_at"]) and old["created_at"] > event["created_at"]:
                    continue
                if event["_authority"] < old["_authority"]:
                    continue
                own_type = old["event_type"] == event["event_type"]
                family = event["event_type"] in CHOICE_FAMILY and old["event_type"] in CHOICE_FAMILY
                if (own_type and x.alike) or (not own_type and family and x.same_topic):
                    old["superseded_by"] = k
        if event["_priority"]:
            for x in around:
                old = records[x.old_id]
                if live(x.old_id) and old["_priority"] and old["event_type"] != event["event_type"] and x.alike:
                    loser, winner = (x.old_id, k) if event["_priority"] < old["_priority"] else (k, x.old_id)
                    records[loser]["superseded_by"] = winner
    return pd.DataFrame(list(records.values()), columns=rows.columns)
