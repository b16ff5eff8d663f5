"""Set-similarity joins of descriptions, exact, by prefix filtering.

Texts with the same tokens are one class before anything is joined.  A class is posted under
its rarest tokens only: two sets with Jaccard t share a token among the first
n - ceil(t n) + 1 of each, tokens in one global order from rare to frequent.  Lengths and
sketches prune further, and what is left is verified on the whole sets.  Rare tokens have short lists, so no
list holds a large share of the rows.  Any one order is exact; how frequent the frequent
tokens are is a table of bounded size, and each set is ranked where it is.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  as pa.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.functions.similarity import jaccard
from recollect.functions.text import overlap_tokens
from recollect.operators.retrieve import few
from recollect.plans.checkpoints import cut, dropped, let_go, stored


def _by_tokens(texts: DataFrame, id_col: str, text_col: str, block: tuple[str, ...] = ()) -> DataFrame:
    """id, block, signature, said of every text: its set of words, sorted and joined by spaces, and the hash of that; both null if there are none."""
    said = F.array_join(F.array_sort(overlap_tokens(F.col(text_col))), " ")
    rows = texts.select(F.col(id_col).alias("id"), *block, said.alias("said")).withColumn("said", F.when(F.col("said") != "", F.col("said")))
    return rows.select("id", *block, F.sha2("said", 256).alias("signature"), "said")


def _classed(rows: DataFrame, block: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(members: id, class_id; classes: class_id, block, tokens) of what `_by_tokens` gives."""
    keys = [*block, "signature"]
    some = rows.where("signature is not null")
    members = rows.select("id", *keys).join(some.groupBy(*keys).agg(F.min("id").alias("class_id")), keys, "left").select("id", "class_id")
    classes = some.groupBy(*keys).agg(F.min("id").alias("class_id"), F.first("said").alias("said"))
    return members, classes.select("class_id", *block, F.split("said", " ").alias("tokens"))


def token_classes(texts: DataFrame, id_col: str, text_col: str, block: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(members: id, class_id; classes: class_id, block, tokens): texts by their token set, the smallest id first.

    Texts without tokens are in no class: their class_id is null.
    """
    return _classed(_by_tokens(texts, id_col, text_col, block), block)


#: At most so many tokens have a rank by how frequent they are; all others are rarer, and rank before them.
MOST_RANKED, LEAST_RANKED = 1 << 19, 8
#: Bits of a set's sketch, and bytes of posted tokens that meet in one task.
SKETCH, SHARD_BYTES = 256, 8 << 20
#: Pairs of a list that are looked at in one step.
PAIRS_AT_ONCE = 1 << 20
#: Sets of pairs are compared in as many rounds as keep those sent in one below this share of all sets; every pair has its round.
ROUND = 1.0


def _hashed(tokens: str = "tokens") -> Column:
    """Tokens as hashes.  Two that share one only make candidates, as pairs are verified on the tokens themselves."""
    return F.transform(tokens, lambda t: F.xxhash64(t))


def _frequent(classes: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of tokens of many classes, sorted, and how many hold them; the least number rises with the rows, so the table is bounded."""
    counted = classes.select(F.explode(_hashed()).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") >= LEAST_RANKED)
    counted = cut(counted)
    rows = counted.agg(F.sum("df")).first()[0] or 0
    found = counted.where(F.col("df") >= max(LEAST_RANKED, -(-rows // MOST_RANKED))).toArrow()
    token = found.column("token").to_numpy()
    order = np.argsort(token)
    return token[order], found.column("df").to_numpy()[order]


def _posted(classes: DataFrame, key: str, least: float, frequent: tuple[np.ndarray, np.ndarray], sketched: bool = False) -> DataFrame:
    """key, n, at, token (and the sketch s0 to s3): the hashes of tokens under which classes are posted, their places and the number of all.

    Ranked from rare to frequent where they are, row by row: no token travels but those posted.
    A sketch holds the parity of the number of tokens by the last bits of their hashes, so two
    of them differ in no more bits than the sets do in tokens.
    """
    shared = classes.sparkSession.sparkContext.broadcast(frequent)
    chosen = classes.select(key, _hashed().alias("tokens"))
    words = [f"s{k}" for k in range(SKETCH // 64)] if sketched else []

    def run(batches):
        known, df = shared.value
        for batch in batches:
            lists = batch.column(1)
            flat, n = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy().astype(np.int64)
            often = np.zeros(len(flat), dtype=np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                often = np.where(known[place] == flat, df[place], 0)
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, often, row))
            at = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            few = at < np.repeat(n - np.ceil(n * least - 1e-9).astype(np.int64) + 1, n)
            held = row[few]
            cols = [batch.column(0).take(pa.array(held)), pa.array(n[held].astype(np.int32)), pa.array(at[few].astype(np.int32)), pa.array(flat[order[few]])]
            if sketched:
                odd = np.bincount(row * SKETCH + (flat & (SKETCH - 1)), minlength=len(n) * SKETCH).astype(np.uint8) & 1
                sketch = np.packbits(odd.reshape(-1, SKETCH), axis=1).view(np.int64)
                cols += [pa.array(sketch[held, k]) for k in range(len(words))]
            yield pa.record_batch(cols, names=[key, "n", "at", "token", *words])

    kind = classes.schema[key].dataType.simpleString()
    return chosen.mapInArrow(run, f"`{key}` {kind}, n int, at int, token long" + "".join(f", {w} long" for w in words))


def _met(token: np.ndarray, node: np.ndarray, n: np.ndarray, at: np.ndarray, sketch: np.ndarray, least: float):
    """Pairs of nodes, smaller first, that share a token and may be similar by sizes, places and sketches; those of several tokens more than once."""
    order = np.lexsort((n, token))
    token, node, n, at, sketch = (x[order] for x in (token, node, n, at, sketch))
    # of a list, each meets those after it that aren't too large
    end = np.append(np.flatnonzero(token[1:] != token[:-1]) + 1, len(token))
    end = end[np.searchsorted(end, np.arange(len(token)), side="right")]
    size = n.astype(np.int64) + (np.cumsum(np.concatenate(([0], token[1:] != token[:-1]))) << 32)  # rises along the order
    end = np.minimum(end, np.searchsorted(size, size - n + np.floor(n / least + 1e-6).astype(np.int64), side="right"))
    count = end - np.arange(len(token)) - 1
    some = np.flatnonzero(count > 0)
    done, start, begun = np.cumsum(count[some]), 0, 0
    while start < len(some):
        # one that meets more than fit in a step has it alone
        stop = max(int(np.searchsorted(done, begun + PAIRS_AT_ONCE, side="right")), start + 1)
        c = count[some[start:stop]]
        i = np.repeat(some[start:stop], c)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c)
        need = np.ceil((n[i] + n[j]) * (least / (1 + least)) - 1e-9)
        # a token shared at these places leaves so many to share after it; the first shared one passes this where any does
        near = np.minimum(n[i] - at[i], n[j] - at[j]) >= need
        i, j, need = i[near], j[near], need[near]
        near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= n[i].astype(np.int64) + n[j] - 2 * need
        x, y = node[i[near]], node[j[near]]
        yield np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), axis=1), axis=0)
        start, begun = stop, done[stop - 1]


def _candidates(classes: DataFrame, least: float) -> DataFrame:
    """x, y: pairs of nodes (node, tokens) that may be similar, each once."""
    # rows of 64 bytes travel; a set of n tokens is posted under 1 + (1 - least) n of them
    n_posted = classes.agg(F.sum(F.size("tokens") * (1 - least) + 1)).first()[0] or 0
    shards = int(max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), 64 * n_posted // SHARD_BYTES + 1))
    words = [f"s{k}" for k in range(SKETCH // 64)]

    def run(batches):
        batches = [batch for batch in batches if batch.num_rows]
        if batches:
            rows = pa.Table.from_batches(batches)
            sketch = np.stack([rows.column(w).to_numpy() for w in words], axis=1).view(np.uint64)
            for pairs in _met(*(rows.column(c).to_numpy() for c in ("token", "node", "n", "at")), sketch, least):
                yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["x", "y"])

    posted = _posted(classes, "node", least, _frequent(classes), sketched=True)
    return posted.repartition(shards, "token").mapInArrow(run, "x long, y long").distinct()


def similar_pairs(classes: DataFrame, least: float, block: tuple[str, ...] = ()) -> DataFrame:
    """a, b, similarity of all pairs of classes (a < b) of one block with Jaccard `least` or more.

    Only sizes, places and sketches travel with the posted tokens; whole sets meet for the pairs
    that are left, in rounds.  What is sent for one round is let go before the next, so disk
    doesn't grow with the pairs.
    """
    spark = classes.sparkSession
    said = F.array_join("tokens", " ")  # words, so without spaces; an array of strings takes more room
    classes, folder = stored(classes.where("class_id is not null and size(tokens) > 0").select("class_id", *block, said.alias("said"), F.size("tokens").alias("n")).withColumn("node", F.monotonically_increasing_id()), "zstd")
    let_go(spark)
    pairs = cut(_candidates(classes.select("node", F.split("said", " ").alias("tokens")), least))
    let_go(spark)
    ends = pairs.select(F.explode(F.array("x", "y")).alias("node"))
    named, names = stored(classes.join(ends.distinct(), "node"), "zstd")
    held = ends.join(named.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0
    there = classes.agg(F.sum("n")).first()[0] or 0
    rounds, found = max(1, -(-held // max(1, int(2 * there * ROUND)))), []
    del ends
    dropped(spark, folder)
    x, y = (named.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("class_id", "said", *block)]) for k in ("x", "y"))
    for k in range(rounds):
        both = pairs.where(F.pmod(F.xxhash64("x"), F.lit(rounds)) == k).join(x, "x").join(y, "y")
        for c in block:
            both = both.where(F.col(f"{c}_x") == F.col(f"{c}_y"))
        both = both.where("class_id_x <> class_id_y").withColumn("similarity", jaccard(F.split("said_x", " "), F.split("said_y", " "))).where(F.col("similarity") >= least)
        a, b = F.least("class_id_x", "class_id_y"), F.greatest("class_id_x", "class_id_y")
        found.append(cut(both.select(*[F.col(f"{c}_x").alias(c) for c in block], a.alias("a"), b.alias("b"), "similarity")))
        del both
        let_go(spark)
    dropped(spark, names)
    return reduce(DataFrame.unionByName, found)


def near_duplicates(texts: DataFrame, id_col: str, text_col: str, least: float = 0.85) -> DataFrame:
    """id, class_id, n_links: each text's class, and how many other classes it is similar to."""
    spark = texts.sparkSession
    rows, folder = stored(_by_tokens(texts, id_col, text_col), "zstd")
    members, classes = _classed(rows)
    members = cut(members)
    pairs = similar_pairs(classes, least)
    dropped(spark, folder)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("class_id"))
    links = ends.groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.join(links, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def best_matches(texts: DataFrame, items: DataFrame, least: float = 0.6) -> DataFrame:
    """id, n_items, best of texts (id, text) against items (item_id, text): how many reach the bound, and the best Jaccard.

    A text of n tokens that is similar to an item has least * n tokens of the items'
    vocabulary; the others go before tokens travel.  A similar item shares a token with the
    text's prefix, in the items' order of rarity, so only prefixes are joined.
    """
    t = texts.select("id", F.array_sort(overlap_tokens(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0)
    i = items.select("item_id", F.array_sort(overlap_tokens(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0)
    words = i.select(F.explode("tokens").alias("token")).distinct()
    held = t.select("id", F.size("tokens").alias("n"), F.explode("tokens").alias("token")).join(F.broadcast(words) if few(words, 1 << 20) else words, "token", "left_semi")
    near = cut(held.groupBy("id", "n").agg(F.count(F.lit(1)).alias("known")).where(F.col("known") >= F.col("n") * F.lit(least) - F.lit(1e-9)).select("id"))
    t = t.join(near, "id", "left_semi")
    frequent = _frequent(i)
    left = _posted(t, "id", least, frequent).select("token", "id", F.col("n").alias("na"))
    right = _posted(i, "item_id", least, frequent).select("token", "item_id", F.col("n").alias("nb"))
    fits = (F.col("nb") >= F.col("na") * F.lit(least)) & (F.col("na") >= F.col("nb") * F.lit(least))
    pairs = left.join(right, "token").where(fits).select("id", "item_id").distinct()
    whole = pairs.join(t.withColumnRenamed("tokens", "ta"), "id").join(i.withColumnRenamed("tokens", "tb"), "item_id")
    met = whole.withColumn("s", jaccard(F.col("ta"), F.col("tb"))).where(F.col("s") >= least)
    found = met.groupBy("id").agg(F.count_distinct("item_id").alias("n_items"), F.max("s").alias("best"))
    return texts.select("id").join(found, "id", "left").select("id", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("best", F.lit(0.0)).alias("best"))
