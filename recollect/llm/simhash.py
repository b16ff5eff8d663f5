"""SimHash near-duplicates: fingerprints, and self-joins of them as binary tries.

Sorted fingerprints are a binary trie whose nodes are ranges; pairs of nodes are walked
together, a level at a time, adding up differing bits and dropping a pair once they exceed
the budget.  Equal fingerprints are one before anything is joined, so a group of copies is
one row.  There are two joins.

`near_duplicates` links fingerprints that differ in at most two of 64 bits, all of them: they
agree in two of four 16-bit blocks, so each goes, once per choice of two blocks, to the shard
of those 32 bits, where the rest is walked.  A shard passes on a star for each of its own
components, not its pairs, and stars of all shards are joined by `graph.components`.

`similar_groups` links texts whose sets of shingles have a Jaccard similarity of `similarity`
or more, the shingles lower-cased as for fingerprints: all of them, in two rounds.  In the
first, `LANES` fingerprints of every text (256 bits) differ in a known share of bits at that
similarity; a table takes some bits of a lane as its key and walks the tries of equal keys.
There are as many tables as find a pair at the limit with probability `FOUND`, whatever the
number of texts.  Where more than `RUN` texts share a key, each is compared with those next to
it in the order of that table's bits; keys that a sample shows to be very frequent are twice as
long, so that no task holds a large part of all texts.  Of the pairs that 256 bits don't rule
out a shard passes on a spanning forest of the nearest, whose texts are compared exactly
before they link.

The second round finds whatever the first has missed.  Two sets of that similarity share one
of the first n - ceil(similarity * n) + 1 shingles of each, in one order of all shingles; those
that a sample shows to be frequent come last, so lists of texts that share one are short.  Of
a list all pairs that aren't yet in one group meet, so large groups of near copies, which the
first round joins, cost little.  Sizes, places and counts of shingles by their last bits rule
out what can't be similar, and the rest is compared exactly.

Null and empty texts have no words and fingerprint zero, which links like any other.  A
component of which every id is null has the id null.  Repeated rows share a fingerprint.
"""

from __future__ import annotations

import math
from functools import reduce
from itertools import chain, combinations, combinations_with_replacement

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _packed, _text
from recollect.llm._spark import buckets_of, cut, key_columns, let_go, remove, stored
from recollect.llm.graph import components

SEED = 42
BLOCK_BITS = 16
PAIRS_OF_BLOCKS = tuple(combinations(range(64 // BLOCK_BITS), 2))
#: Node pairs that one step of the walk holds at most; larger frontiers are walked in parts.
FRONTIER = 1 << 20
SHARD_BYTES = 8 << 20
#: Of `similar_groups`: fingerprints of a text, the chance that a pair at the limit meets in a
#: table's shard, and how many standard deviations of differing bits are allowed above the mean.
LANES, FOUND, SPREAD = 4, 0.97, 2.0
#: A key of a table that more texts share is walked in runs of so many neighbours, overlapping by half.
RUN = 256
#: One text in so many is looked at for keys that very many share; those found as often are lengthened.
SAMPLE_ONE_IN, FREQUENT = 64, 1024
#: Shingles that so many texts of the sample hold are posted last.
OFTEN = 4
#: Shingles of a text are counted by their last bits, in so many bytes; and pairs of a list that are looked at in one step.
SKETCH, PAIRS_AT_ONCE = 128, 1 << 20
#: Texts of pairs are compared in as many rounds as keep those sent in one below this share of all distinct texts; every pair has its round.
ROUND = 0.5


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the lower-cased shingles of words, repeats included; of fewer words, of all of them."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], dtype=np.uint64)  # zip ends with the last whole shingle


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes set."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The 64-bit SimHash of lower-cased words, over shingles with repeats."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """doc_id, fp: the fingerprint of every row as a signed long."""

    def run(batches):
        for batch in batches:
            buf, offs = _text.flat(batch.column(1))
            raw, at = buf.tobytes(), offs.tolist()
            fps = np.array([fingerprint(raw[a:b], shingle) for a, b in zip(at, at[1:])], dtype=np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    chosen = documents.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return chosen.mapInArrow(_text.frugal(run), f"{id_col} long, fp long")


def trie_roots(sorted_keys: np.ndarray, fixed_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the keys that agree in the top fixed_bits."""
    n = len(sorted_keys)
    top = sorted_keys >> np.uint64(64 - fixed_bits) if fixed_bits else np.zeros(n, np.uint64)
    heads = np.flatnonzero(np.concatenate(([True], top[1:] != top[:-1])))[:n]
    return heads, np.append(heads[1:], n)[: len(heads)]


def trie_pairs(sorted_keys: np.ndarray, fixed_bits: int, budget: int, roots: tuple[np.ndarray, np.ndarray] | None = None):
    """Index pairs (i < j) of sorted distinct uint64 keys that agree in the top fixed_bits and differ in at most budget bits.

    roots: the ranges to look in, if not all that agree.  Yields pairs of index arrays.
    """
    a, b = roots or trie_roots(sorted_keys, fixed_bits)
    many = b - a > 1
    a, b = a[many], b[many]
    # a frontier: level, first node [a, b), second node [c, d), differing bits so far
    stack = [(fixed_bits, a, b, a, b, np.zeros(len(a), np.int64))]
    while stack:
        level, a, b, c, d, off = stack.pop()
        if not len(a):
            continue
        if level == 64:
            apart = a < c
            yield a[apart], c[apart]
            continue
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(level, *(x[:half] for x in (a, b, c, d, off))), (level, *(x[half:] for x in (a, b, c, d, off)))]
            continue
        left, right = _split(sorted_keys, a, b, level), _split(sorted_keys, c, d, level)
        own = (a == c) & (b == d)
        kids = [(a, left, c, right, off), (left, b, right, d, off)]
        over = off < budget
        kids.append((a[over], left[over], right[over], d[over], off[over] + 1))
        cross = over & ~own  # a node with itself has the mirrored pair already
        kids.append((left[cross], b[cross], c[cross], right[cross], off[cross] + 1))
        cols = [np.concatenate(x) for x in zip(*kids)]
        alive = (cols[0] < cols[1]) & (cols[2] < cols[3])
        alive &= ~((cols[0] == cols[2]) & (cols[1] == cols[3]) & (cols[1] - cols[0] == 1))  # a leaf with itself
        stack.append((level + 1, *(x[alive] for x in cols)))


def _split(keys: np.ndarray, lo: np.ndarray, hi: np.ndarray, level: int) -> np.ndarray:
    """Where, in each range of keys that agree above `level`, the bit at `level` turns to one."""
    bit = np.uint64(1) << np.uint64(63 - level)
    want = (keys[lo] & ~(bit | (bit - np.uint64(1)))) | bit
    return np.clip(np.searchsorted(keys, want), lo, hi)


def _stars(n: int, pairs) -> np.ndarray:
    """For each of n items, the smallest item that pairs connect it with."""
    label = np.arange(n)
    for i, j in pairs:
        while True:
            x, y = label[i], label[j]
            apart = x != y
            if not apart.any():
                break
            i, j, x, y = i[apart], j[apart], x[apart], y[apart]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while (flat := label[label]).tobytes() != label.tobytes():
                label = flat
    return label


def _turned(fps: np.ndarray, blocks: tuple[int, int]) -> np.ndarray:
    """Fingerprints with the two chosen blocks at the top."""
    out, order = np.zeros_like(fps), [*blocks, *(b for b in range(64 // BLOCK_BITS) if b not in blocks)]
    for k, block in enumerate(order):
        part = (fps >> np.uint64(BLOCK_BITS * block)) & np.uint64((1 << BLOCK_BITS) - 1)
        out |= part << np.uint64(64 - BLOCK_BITS * (k + 1))
    return out


def links(distinct: DataFrame, budget: int = 2) -> DataFrame:
    """a, b: stars that connect the fingerprints (column fp) as all pairs within the budget would."""
    if budget > 2:
        raise ValueError("two of four blocks agree only for budgets up to 2")

    def join(shard: pa.Table) -> pa.Table:
        out_a, out_b = [], []
        combo = shard.column("combo").to_numpy()
        fps = shard.column("fp").to_numpy().view(np.uint64)
        for k in np.unique(combo):
            own = fps[combo == k]
            turned = _turned(own, PAIRS_OF_BLOCKS[k])
            order = np.argsort(turned)
            own = own[order]
            label = _stars(len(own), trie_pairs(turned[order], 2 * BLOCK_BITS, budget))
            hung = np.flatnonzero(label != np.arange(len(own)))
            out_a.append(own[hung])
            out_b.append(own[label[hung]])
        cols = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (out_a, out_b)]
        return pa.table({"a": cols[0], "b": cols[1]})

    shards = buckets_of(distinct.sparkSession, len(PAIRS_OF_BLOCKS) * 16 * distinct.count(), SHARD_BYTES)
    block = [F.shiftrightunsigned("fp", BLOCK_BITS * i).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for i in range(64 // BLOCK_BITS)]
    keys = F.array(*[F.struct(F.lit(k).alias("combo"), F.xxhash64(F.lit(k), block[i], block[j]).alias("key")) for k, (i, j) in enumerate(PAIRS_OF_BLOCKS)])
    rows = distinct.select("fp", F.explode(keys).alias("k")).select("fp", F.col("k.combo").alias("combo"), F.pmod("k.key", F.lit(shards)).cast("int").alias("shard"))
    return rows.groupBy("shard").applyInArrow(join, "a long, b long")


def near_duplicates(documents: DataFrame, budget: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id for every row: the smallest id among all that links reach."""
    fps = cut(fingerprints(documents, shingle=shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("low")))
    label = components(links(distinct.select("fp"), budget), "a", "b")
    joined = distinct.join(label.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("label", "fp").alias("label"))
    least = joined.groupBy("label").agg(F.min("low").alias("component_id"))
    found = joined.join(least, "label").select("fp", "component_id")
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")


# Similarity of whole texts


def _tables(n: int, similarity: float, found: float = FOUND) -> list[tuple[int, np.ndarray]]:
    """(lane, its bits in order, the key's first) of every table for n texts, and how many bits a key has."""
    agree = 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi  # the share of bits in which texts at the limit agree
    key_bits = max(12, math.ceil(math.log2(max(n, 2))) - 4)
    n_tables = math.ceil(math.log(1 - found) / math.log(1 - agree**key_bits))
    rng = np.random.default_rng(SEED)
    return [(t % LANES, rng.permutation(64)[:key_bits]) for t in range(n_tables)]


def _allowed(bits: int, similarity: float) -> int:
    """Differing bits up to which texts at the limit are looked for."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.floor(bits * apart + SPREAD * math.sqrt(bits * apart * (1 - apart)))


def _bits_first(fps: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Fingerprints with the given bits moved to the top, the others behind them in order."""
    out, order = np.zeros_like(fps), [*bits.tolist(), *(b for b in range(64) if b not in set(bits.tolist()))]
    for k, b in enumerate(order):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(63 - k)
    return out


def _forest(n: int, i: np.ndarray, j: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Places of the pairs that span what all of them connect, nearest first."""
    label, rank = np.arange(n), np.empty(len(i), dtype=np.int64)
    rank[np.argsort(apart, kind="stable")] = np.arange(len(i))
    of_rank, live, chosen = np.argsort(rank), np.arange(len(i)), []
    while True:
        live = live[label[i[live]] != label[j[live]]]
        if not len(live):
            return np.concatenate(chosen) if chosen else live
        best = np.full(n, len(i), dtype=np.int64)  # the nearest pair that leaves each component
        np.minimum.at(best, label[i[live]], rank[live])
        np.minimum.at(best, label[j[live]], rank[live])
        taken = of_rank[np.unique(best[best < len(i)])]
        chosen.append(taken)
        label = _stars(n, [(label[i[taken]], label[j[taken]])])[label]


def _runs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranges cut into runs of at most RUN, which overlap by half."""
    n = np.maximum(-(-2 * (b - a) // RUN) - 1, 1)
    low = np.repeat(a, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * (RUN // 2)
    return low, np.minimum(low + RUN, np.repeat(b, n))


def _near(table_fps: np.ndarray, fine: np.ndarray, bits: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the fingerprints (rows of `fine`) that meet in one table and aren't ruled out."""
    turned = _bits_first(table_fps, bits)
    order = np.argsort(turned, kind="stable")
    keys, first = np.unique(turned[order], return_index=True)
    fine, n = fine[order], len(order)
    budget, fine_budget = _allowed(64, similarity), _allowed(64 * LANES, similarity)
    equal = np.flatnonzero(turned[order][1:] == turned[order][:-1])
    held = (np.zeros(0, np.int64),) * 3
    found = ((first[a], first[b]) for a, b in trie_pairs(keys, len(bits), budget, _runs(*trie_roots(keys, len(bits)))))
    for i, j in chain([(equal, equal + 1)], found):
        apart = np.bitwise_count(fine[i] ^ fine[j]).sum(axis=1, dtype=np.int64)
        some = apart <= fine_budget
        i, j, apart = (np.concatenate(x) for x in zip(held, (i[some], j[some], apart[some])))
        keep = _forest(n, i, j, apart)  # what is held never exceeds n pairs
        held = (i[keep], j[keep], apart[keep])
    return order[held[0]], order[held[1]]


def _candidates(nodes: DataFrame, n: int, similarity: float) -> DataFrame:
    """a, b: pairs of nodes (node, fine) whose texts may be similar, at most a forest of a shard and table."""
    tables = _tables(n, similarity)
    shards = buckets_of(nodes.sparkSession, len(tables) * (16 + 8 * LANES) * n, SHARD_BYTES)

    def join(shard: pa.Table) -> pa.Table:
        kind, node = shard.column("kind").to_numpy(), shard.column("node").to_numpy()
        fine = shard.column("fine").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, LANES)
        out = [(node[:0], node[:0])]
        for t in np.unique(kind).tolist():
            own = np.flatnonzero(kind == t)
            lane, bits = tables[t]
            i, j = _near(fine[own, lane], fine[own], bits, similarity)
            out.append((np.minimum(node[own[i]], node[own[j]]), np.maximum(node[own[i]], node[own[j]])))
        a, b = (np.concatenate(x) for x in zip(*out))
        return pa.table({"a": a, "b": b})

    def key(t: int, lane: int, bits: np.ndarray):
        mask = sum(1 << int(b) for b in bits)
        return F.xxhash64(F.lit(t), F.element_at("fine", lane + 1).bitwiseAND(F.lit(mask - ((mask >> 63) << 64))))

    longer = [(lane, np.concatenate((bits, np.setdiff1d(np.arange(64), bits)[: len(bits)]))) for lane, bits in tables]
    keys = [F.struct(F.lit(t).alias("kind"), key(t, *tables[t]).alias("key"), key(t, *longer[t]).alias("longer")) for t in range(len(tables))]
    each = nodes.select("node", "fine", F.explode(F.array(*keys)).alias("k")).select("node", "fine", "k.*")
    sample = each.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLE_ONE_IN)) == 0)
    often = sample.groupBy("kind", "key").count().where(F.col("count") >= FREQUENT).select("kind", "key", F.lit(True).alias("often"))
    shard = F.pmod(F.when(F.col("often"), F.col("longer")).otherwise(F.col("key")), F.lit(shards)).cast("int")
    rows = each.join(often, ["kind", "key"], "left").select("node", "fine", "kind", shard.alias("shard"))
    return rows.groupBy("shard").applyInArrow(join, "a long, b long").distinct()


def jaccard(a: bytes, b: bytes, shingle: int) -> float:
    x, y = set(shingle_hashes(a, shingle).tolist()), set(shingle_hashes(b, shingle).tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def _hash_sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    buf, offs = _text.flat(column)
    raw, at = buf.tobytes(), offs.tolist()
    return [np.unique(shingle_hashes(raw[x:y], shingle)) for x, y in zip(at, at[1:])]


def _frequent(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample hold, sorted, and how many do: at most `_packed.MOST_KEYS`, as the least number rises with the rows."""

    def run(batches):
        for batch in batches:
            value, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *_hash_sets(batch.column(0), shingle)]), return_counts=True)
            yield pa.record_batch([pa.array(value.view(np.int64)), pa.array(n.astype(np.int64))], names=["value", "n"])

    sample = texts.where(F.pmod(F.xxhash64("row_id"), F.lit(SAMPLE_ONE_IN)) == 0).select("text")
    counts = sample.mapInArrow(_text.frugal(run), "value long, n long")
    often = cut(counts.groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN))
    rows = often.agg(F.sum("n")).first()[0] or 0
    found = often.where(F.col("n") >= max(OFTEN, -(-rows // _packed.MOST_KEYS))).toArrow()
    value = found.column("value").to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(value)
    return value[order], found.column("n").to_numpy().astype(np.int64)[order]


def _sets(texts: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """row_id, row_hash, fine, sig, n, sketch, posted of every text: fingerprints, hash and size of its set of shingles, counts by last bits, and the shingles it is posted under."""
    shared = texts.sparkSession.sparkContext.broadcast(_frequent(texts, shingle))

    def posted(hashes: np.ndarray) -> np.ndarray:
        often, n = shared.value
        few = len(hashes) - math.ceil(len(hashes) * similarity - 1e-9) + 1
        if not len(often) or not len(hashes):
            return hashes[:few]
        at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
        return hashes[np.argsort(np.where(often[at] == hashes, n[at], 0), kind="stable")[:few]]

    def run(batches):
        lanes = np.arange(LANES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            sets = _hash_sets(batch.column(0), shingle)
            fine = np.zeros((len(sets), LANES), dtype=np.uint64)
            sketch = np.zeros((len(sets), SKETCH), dtype=np.uint8)
            for k, hashes in enumerate(sets):
                fine[k] = [majority(_text.mix(hashes + lane)) for lane in lanes] if len(hashes) else 0
                sketch[k] = np.minimum(np.bincount((hashes & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255)
            sig = np.array([_text.mix(h ^ np.uint64(SEED)).sum(dtype=np.uint64) for h in sets], dtype=np.uint64)
            n = np.array([len(h) for h in sets], dtype=np.int64)
            tokens = [posted(h) for h in sets]
            ends = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.uint64), *tokens]).view(np.int64)
            lists = [pa.ListArray.from_arrays(np.arange(0, fine.size + 1, LANES, dtype=np.int32), pa.array(fine.ravel().view(np.int64))), pa.array(sig.view(np.int64)), pa.array(n)]
            lists += [pa.array([x.tobytes() for x in sketch], pa.binary()), pa.ListArray.from_arrays(ends, pa.array(flat))]
            yield pa.record_batch([*batch.columns[1:], *lists], names=["row_id", "row_hash", "fine", "sig", "n", "sketch", "posted"])

    return texts.mapInArrow(_text.frugal(run), "row_id long, row_hash long, fine array<long>, sig long, n long, sketch binary, posted array<long>")


def _least_shared(n: np.ndarray, m: np.ndarray, similarity: float) -> np.ndarray:
    return np.ceil((n + m) * (similarity / (1 + similarity)) - 1e-9)


def _met(token: np.ndarray, node: np.ndarray, label: np.ndarray, n: np.ndarray, at: np.ndarray, similarity: float):
    """Pairs of nodes, smaller first, that share a token, are of different labels, and may be similar by sizes and places; some more than once."""
    order = np.lexsort((node, label, token))
    order = order[np.concatenate(([True], (token[order][1:] != token[order][:-1]) | (node[order][1:] != node[order][:-1])))[: len(order)]]
    token, node, label, n, at = (x[order] for x in (token, node, label, n, at))
    new = token[1:] != token[:-1]
    # each meets those of its list after all of its own label
    end, past = (np.append(np.flatnonzero(x) + 1, len(token)) for x in (new, new | (label[1:] != label[:-1])))
    end, past = (x[np.searchsorted(x, np.arange(len(token)), side="right")] for x in (end, past))
    some = np.flatnonzero(end > past)
    low, count = past[some], (end - past)[some]
    done = np.cumsum(count)
    at_once, start, begun = max(PAIRS_AT_ONCE, 1), 0, 0
    while start < len(some):
        stop = max(int(np.searchsorted(done, begun + at_once, side="right")), start + 1)
        c = count[start:stop]
        i = np.repeat(some[start:stop], c)
        j = np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c) + np.repeat(low[start:stop], c)
        near = np.minimum(n[i] - at[i], n[j] - at[j]) >= _least_shared(n[i], n[j], similarity)
        x, y = node[i[near]], node[j[near]]
        yield np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
        start, begun = stop, done[stop - 1]


def _others(sets: DataFrame, labelled: DataFrame, similarity: float) -> DataFrame:
    """a, b: all pairs of nodes of different labels that may be similar; labelled: node, label, row_id, row_hash."""
    n_posted = sets.agg(F.sum(F.size("posted"))).first()[0] or 0
    shards = buckets_of(sets.sparkSession, 40 * n_posted, SHARD_BYTES)

    def run(batches):
        batches = list(batches)
        if batches:
            rows = pa.Table.from_batches(batches)
            for pairs in _met(*(rows.column(c).to_numpy() for c in ("token", "node", "label", "n", "at")), similarity):
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    own = sets.select("row_id", "row_hash", "n", "posted").join(labelled, ["row_id", "row_hash"])
    posted = own.select("node", "label", F.col("n").cast("int").alias("n"), F.posexplode("posted").alias("at", "token"))
    return posted.repartition(shards, "token").mapInArrow(_text.frugal(run), "a long, b long").distinct()


def _groups(held: int, there: int) -> int:
    """Groups of texts, of which two meet in a round: pairs of two groups, 2 / groups^2 of all, are a round's share."""
    return max(1, math.ceil(math.sqrt(2 * held / max(1.0, there * ROUND)))) if held > there * ROUND else 1


def _links(texts: DataFrame, repeated: bool, nodes: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """a, b of the pairs of nodes whose texts are similar; nodes: node, row, n, sketch.

    Texts are dealt to groups by hash, and two groups meet in a round: so a text is sent once for
    each group, not once for each round.  What is sent for one round is let go before the next,
    so disk doesn't grow with the pairs.
    """

    def bound(batches):
        for batch in batches:
            n, m = (batch.column(k).to_numpy() for k in (2, 3))
            s, t = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, SKETCH) for k in (4, 5))
            both = np.minimum(s, t).astype(np.int64)
            shared = np.where((both == 255).any(axis=1), np.minimum(n, m), both.sum(axis=1))  # 255 stands for any more
            near = np.minimum(shared, np.minimum(n, m)) >= _least_shared(n, m, similarity)
            yield pa.record_batch([*batch.columns[:2], pa.array(n + m)], names=["a", "b", "size"]).filter(pa.array(near))

    def compare(batches):
        for batch in batches:
            texts = zip(batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).cast(pa.binary()).to_pylist())
            alike = [jaccard(x or b"", y or b"", shingle) >= similarity for x, y in texts]
            yield pa.record_batch(batch.columns[:2], names=["a", "b"]).filter(pa.array(alike, pa.bool_()))

    spark = texts.sparkSession
    end = lambda k, n, s: nodes.select(F.col("node").alias(k), F.col("n").alias(n), F.col("sketch").alias(s))
    sized = pairs.join(end("a", "n", "s"), "a").join(end("b", "m", "t"), "b").select("a", "b", "n", "m", "s", "t")
    pairs = cut(sized.mapInArrow(_text.frugal(bound), "a long, b long, size long"))
    del sized
    let_go(spark)
    named = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    said = texts.join(nodes.join(named, "node").select("node", "row.*"), ["row_id", "row_hash"])
    said, folder = stored((said.dropDuplicates(["node"]) if repeated else said).select("node", "text"))
    let_go(spark)
    x, y = (said.select(F.col("node").alias(k), F.col("text").alias(f"text_{k}")) for k in ("a", "b"))
    held, there = pairs.agg(F.sum("size")).first()[0] or 0, nodes.agg(F.sum("n")).first()[0] or 0
    groups, found = _groups(held, there), []
    of = lambda c: F.pmod(F.xxhash64(c), F.lit(groups))
    turned = of("a") > of("b")  # the text of the lower group comes first
    first, second = (F.when(turned, F.col(p)).otherwise(F.col(q)) for p, q in (("b", "a"), ("a", "b")))
    ends = pairs.select(F.col("a").alias("p"), F.col("b").alias("q"), first.alias("a"), second.alias("b"))
    for k, m in combinations_with_replacement(range(groups), 2):
        both = ends.where((of("a") == k) & (of("b") == m)).join(x.where(of("a") == k), "a").join(y.where(of("b") == m), "b").select("p", "q", "text_a", "text_b")
        found.append(cut(both.mapInArrow(_text.frugal(compare), "a long, b long")))
        del both
        let_go(spark)
    remove(spark, folder)
    return reduce(DataFrame.unionByName, found)


def similar_groups(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """row_id, row_hash, kept_id, kept_hash: the key of every row (`_spark.key_columns`), and that of the smallest row of its group."""
    spark = documents.sparkSession
    row_id, row_hash, repeated = key_columns(documents)
    texts = documents.select(F.col("text").cast("string").alias("text"), row_id.alias("row_id"), row_hash.alias("row_hash"))
    sets, folder = stored(_sets(texts, shingle, similarity))
    least = F.min(F.struct("row_id", "row_hash"))
    nodes = cut(sets.groupBy("fine", "sig").agg(least.alias("row"), F.first("n").alias("n"), F.first("sketch").alias("sketch")).withColumn("node", F.monotonically_increasing_id()))
    pairs = cut(_candidates(nodes.select("node", "fine"), nodes.count(), similarity))
    let_go(spark)
    links = _links(texts, repeated, nodes, pairs, shingle, similarity)
    let_go(spark)
    label = components(links, "a", "b")
    labelled = cut(nodes.join(label, "node", "left").select("node", "row.*", F.coalesce("label", "node").alias("label")))
    del pairs, links, label
    pairs = cut(_others(sets, labelled, similarity))
    let_go(spark)
    links = _links(texts, repeated, nodes, pairs, shingle, similarity)
    ends = [labelled.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}")) for k in ("a", "b")]
    over = components(links.join(ends[0], "a").join(ends[1], "b"), "label_a", "label_b").select(F.col("node").alias("label"), F.col("label").alias("lowest"))
    grouped = nodes.join(labelled.select("node", "label").join(over, "label", "left"), "node").select("fine", "sig", "row", F.coalesce("lowest", "label").alias("label"))
    first = grouped.groupBy("label").agg(F.min("row").alias("kept"))
    kept = grouped.join(first, "label").select("fine", "sig", F.col("kept.row_id").alias("kept_id"), F.col("kept.row_hash").alias("kept_hash"))
    found = cut(sets.select("row_id", "row_hash", "fine", "sig").join(kept, ["fine", "sig"]).select("row_id", "row_hash", "kept_id", "kept_hash"))
    del pairs, links, ends, over, grouped, first, kept, nodes, labelled, sets
    remove(spark, folder)
    let_go(spark)
    return found


def one_of_each_group(documents: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of documents, all columns, that are the smallest of their group, by id (null first), then by a hash of the text.

    Rows that repeat an id and its text are one; of those, the smallest by the other columns stays.
    """
    row_id, row_hash, repeated = key_columns(documents)
    groups = similar_groups(documents, shingle, similarity)
    kept = groups.where("row_id = kept_id and row_hash = kept_hash").select("row_id", "row_hash").distinct()
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")
    rows = documents.select(row, row_id.alias("row_id"), row_hash.alias("row_hash")).join(kept, ["row_id", "row_hash"], "left_semi")
    if repeated:  # only then can a key have several rows
        rows = rows.groupBy("row_id", "row_hash").agg(F.min("row").alias("row"))
    return rows.select("row.*")
