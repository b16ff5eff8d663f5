"""Quality classification from weak labels.

Heuristic labellers that overlap, so that every sort of bad text is seen by two at least, each
vote good, bad or abstain on every text.  How often every pattern of votes occurs, over all
documents, is a table of at most 3**len(LABELLERS) rows; expectation-maximisation on it
estimates how often each labeller complains about bad texts and about good ones, and with
these the posterior of each pattern.  The rate of complaints about good texts has a prior
(`PRIOR_ALARMS`, weighing `PRIOR_WEIGHT` of the documents), which the votes override.  A
hashed linear scorer (character-shape trigrams and measures of repetition) is then trained on
the posteriors of a bounded sample, `TRAIN_ROWS` documents with the smallest hashes of their
ids, and scores every text.

Null, empty and blank texts have no words: the posterior is that of their votes, the score
is 0 and they aren't kept.  Texts are read whole.  Repeated rows have equal scores; extra
columns are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text

TRAIN_ROWS = 4000
DIMENSIONS, BINS = 1024, 10
ROUNDS, STEPS, RATE, DECAY = 200, 400, 2.0, 1e-4
KEEP_FROM = 0.5
PRIOR_ALARMS, PRIOR_WEIGHT = 0.01, 0.02

_SYMBOL = _text.byte_class(b"#*$%&|<>{}~^\\")
_LETTER = _text.byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_UPPER = _text.byte_class(range(0x41, 0x5B))
_STOP = _text.byte_class(b".,;:?")
#: Shapes: white space, letters small and large, digits, stops, and single symbols.
SHAPE = np.full(256, 15, dtype=np.int64)
SHAPE[~_text.NON_SPACE] = 0
SHAPE[0x61:0x7B] = 1
SHAPE[0x80:] = 1
SHAPE[_UPPER] = 2
SHAPE[0x30:0x3A] = 3
SHAPE[_STOP] = 4
for _k, _c in enumerate(b"!|#*$%&\"'-"):
    SHAPE[_c] = 5 + _k

#: Tells equal words of different rows apart.
_ROW = np.uint64(0xA24BAED4963EE407)


def measures(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Per-word rates of each row of one block."""
    rows = len(offs) - 1
    starts, ends, woffs = _text.word_bounds(buf, offs, _text.NON_SPACE)
    owner = _text.owners(woffs)
    n = np.diff(woffs)
    per_word = np.maximum(n, 1)
    letters = _text.per_row_sum(_LETTER[buf], offs)
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[buf], dtype=np.int64)))
    words = _text.byte_hashes(buf, starts, ends)
    _, first, often = np.unique(_text.mix(words ^ (owner.astype(np.uint64) * _ROW)), return_index=True, return_counts=True)
    top = np.zeros(rows, dtype=np.int64)
    np.maximum.at(top, owner[first], often)
    again = np.zeros(len(words), dtype=bool)
    again[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    threes = _text.gram_hashes(words, 3)
    place = np.arange(len(threes))
    place = place[owner[place] == owner[place + 2]] if len(threes) else place
    own = _text.mix(threes[place] ^ (owner[place].astype(np.uint64) * _ROW))
    _, back, count = np.unique(own, return_inverse=True, return_counts=True)
    repeats = np.bincount(owner[place[count[back] > 1]], minlength=rows) if len(place) else np.zeros(rows)
    return {
        "n_words": n,
        "symbols": (symbols[offs[1:]] - symbols[offs[:-1]]) / per_word,
        "symbol_words": _text.per_row_sum(symbols[ends] > symbols[starts], woffs) / per_word,
        "echoes": _text.per_row_sum(again, woffs) / per_word,
        "upper": _text.per_row_sum(_UPPER[buf], offs) / np.maximum(letters, 1),
        "letters": letters,
        "exclaims": _text.per_row_sum(buf == 0x21, offs) / per_word,
        "bars": _text.per_row_sum(buf == 0x7C, offs) / per_word,
        "stops": _text.per_row_sum(_STOP[buf], offs) / per_word,
        "top_word": top / per_word,
        "repeats": repeats / per_word,
        "word_bytes": _text.per_row_sum(ends - starts, woffs) / per_word,
    }


def _rate(name: str, good_to: float, bad_from: float, least: str = "n_words", at_least: int = 1):
    """A labeller that says good up to one rate, bad from another, and abstains between, or on short texts."""

    def vote(m):
        out = np.where(m[name] >= bad_from, 1, np.where(m[name] <= good_to, 2, 0))
        return np.where(m[least] >= at_least, out, 0)

    return vote


#: Votes: 0 abstains, 1 bad, 2 good.
LABELLERS = {
    "symbols": _rate("symbols", 0.05, 0.30),
    "shouting": _rate("upper", 0.20, 0.50, "letters", 12),
    "exclaiming": _rate("exclaims", 0.05, 0.30),
    "barred": _rate("bars", 0.01, 0.25),
    "one_word": _rate("top_word", 0.20, 0.45, "n_words", 12),
    "repeating": _rate("repeats", 0.15, 0.60, "n_words", 20),
    "unstopped": lambda m: np.where(m["n_words"] < 12, 0, np.where(m["stops"] < 0.01, 1, np.where(m["stops"] <= 0.6, 2, 0))),
    "symbol_words": _rate("symbol_words", 0.02, 0.15),
    "echoing": _rate("echoes", 0.05, 0.40, "n_words", 12),
    "wordless": lambda m: np.where((m["n_words"] < 1) | (m["word_bytes"] > 40), 1, 0),
}


def patterns(m: dict[str, np.ndarray]) -> np.ndarray:
    """The votes of all labellers as one number in base 3."""
    code = np.zeros(len(m["n_words"]), dtype=np.int64)
    for vote in LABELLERS.values():
        code = code * 3 + vote(m)
    return code


def _votes(codes: np.ndarray) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in reversed(range(len(LABELLERS)))], axis=1)


def estimate(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good for each pattern, P(bad, good | class) of the votes cast as [labeller, class, vote], and the share of good."""
    votes = _votes(codes)
    posterior = np.where((votes == 1).any(axis=1), 0.05, 0.95)  # where the search begins: any complaint counts
    weight = counts / counts.sum()
    cast = np.eye(3)[votes][:, :, 1:]  # pattern, labeller, bad or good; abstaining says nothing
    for _ in range(ROUNDS):
        share = float(np.clip(weight @ posterior, 1e-6, 1 - 1e-6))
        prior = np.array([[[5e-5, 5e-5], [PRIOR_WEIGHT * PRIOR_ALARMS, PRIOR_WEIGHT * (1 - PRIOR_ALARMS)]]])
        theta = np.stack([np.einsum("p,plv->lv", weight * q, cast) for q in (1 - posterior, posterior)], axis=1) + prior
        theta /= theta.sum(axis=2, keepdims=True)
        likelihood = np.log([1 - share, share]) + np.einsum("plv,lcv->pc", cast, np.log(theta))
        likelihood -= likelihood.max(axis=1, keepdims=True)
        p = np.exp(likelihood)
        posterior = p[:, 1] / p.sum(axis=1)
    return posterior, theta, share


def features(buf: np.ndarray, offs: np.ndarray, m: dict[str, np.ndarray]) -> np.ndarray:
    """Rows by DIMENSIONS hashed shape trigrams (roots of their frequencies) and bins of measures."""
    rows = len(offs) - 1
    shape = SHAPE[buf]
    out = np.zeros((rows, DIMENSIONS + 4 * BINS), dtype=np.float32)
    if len(shape) >= 3:
        code = (shape[:-2] << 8) + (shape[1:-1] << 4) + shape[2:]
        table = (_text.mix(np.arange(1 << 12, dtype=np.uint64) + np.uint64(1)) % np.uint64(DIMENSIONS)).astype(np.int64)
        row = _text.owners(offs)
        whole = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][whole] * DIMENSIONS + table[code[whole]], minlength=rows * DIMENSIONS).reshape(rows, DIMENSIONS)
        out[:, :DIMENSIONS] = np.sqrt(counts / np.maximum(counts.sum(axis=1, keepdims=True), 1))
    for k, name in enumerate(("top_word", "repeats", "upper", "stops")):
        place = np.minimum((np.clip(m[name], 0, 0.999) * BINS).astype(np.int64), BINS - 1)
        out[np.arange(rows), DIMENSIONS + k * BINS + place] = 1
    return out


def train(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels, both classes weighing the same, by accelerated descent."""
    weight = target / max(target.sum(), 1e-9) + (1 - target) / max((1 - target).sum(), 1e-9)
    weight /= weight.sum()
    x, weight, target = x.astype(np.float32), weight.astype(np.float32), target.astype(np.float32)
    w, b, last = np.zeros(x.shape[1], np.float32), 0.0, (np.zeros(x.shape[1], np.float32), 0.0)
    for k in range(STEPS):
        look = w + np.float32(k / (k + 3)) * (w - last[0]), b + k / (k + 3) * (b - last[1])
        error = weight * (1 / (1 + np.exp(-np.clip(x @ look[0] + look[1], -50, 50))) - target)
        last = (w, b)
        w = look[0] - np.float32(RATE) * (error @ x + np.float32(DECAY) * look[0])
        b = look[1] - RATE * float(error.sum())
    return w, float(b)


def _measured(batches):
    """Blocks of (row ids, bytes, offsets, measures) of batches whose first columns are id and text."""
    for batch in batches:
        buf, offs = _text.flat(batch.column(1))
        for i, j in _text.slices(offs):
            part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            yield batch.column(0)[i:j], part, at, measures(part, at)


def fit(documents: DataFrame) -> dict:
    """The label model over all documents and the scorer over the sample; documents: doc_id, text."""

    def count(batches):
        for _, _, _, m in _measured(batches):
            code, n = np.unique(patterns(m), return_counts=True)
            yield pa.record_batch([pa.array(code), pa.array(n.astype(np.int64))], names=["pattern", "n"])

    def sample(batches):
        for _, part, at, m in _measured(batches):
            x = features(part, at, m)
            yield pa.record_batch([pa.array(patterns(m)), pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), x.ravel())], names=["pattern", "x"])

    table = documents.mapInArrow(_text.frugal(count), "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").toArrow()
    codes, counts = table.column("pattern").to_numpy(), table.column("n").to_numpy()
    if not len(codes):
        return {"codes": np.zeros(0, np.int64), "posterior": np.zeros(0), "w": np.zeros(DIMENSIONS + 4 * BINS), "b": 0.0}
    posterior, theta, share = estimate(codes, counts)
    rows = _sampled(documents).mapInArrow(_text.frugal(sample), "pattern long, x array<float>").toArrow()
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, DIMENSIONS + 4 * BINS)
    target = posterior[np.searchsorted(codes, rows.column("pattern").to_numpy())]
    w, b = train(x, target) if len(x) else (np.zeros(DIMENSIONS + 4 * BINS), 0.0)
    return {"codes": codes, "posterior": posterior, "theta": theta, "share": share, "w": w, "b": b}


def _sampled(documents: DataFrame) -> DataFrame:
    """The TRAIN_ROWS rows with the smallest hashes: only ids are sorted, texts are met again by hash."""
    place = F.xxhash64("doc_id")
    last = documents.select(place.alias("place")).orderBy("place").limit(TRAIN_ROWS).agg(F.max("place")).first()[0]
    return documents.where(place <= F.lit(last)).limit(2 * TRAIN_ROWS)


def classify(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, weak_label (posterior of good), score and kept for every row."""
    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shared = chosen.sparkSession.sparkContext.broadcast(fit(chosen))

    def score(batches):
        model = shared.value
        for ids, part, at, m in _measured(batches):
            s = 1 / (1 + np.exp(-np.clip((features(part, at, m) @ model["w"]).astype(np.float64) + model["b"], -50, 50)))
            s[m["n_words"] == 0] = 0.0
            weak = model["posterior"][np.searchsorted(model["codes"], patterns(m))]
            yield pa.record_batch([ids, pa.array(m["n_words"].astype(np.int64)), pa.array(weak), pa.array(s), pa.array(s >= KEEP_FROM)], names=["doc_id", "n_words", "weak_label", "score", "kept"])

    return chosen.mapInArrow(_text.frugal(score), "doc_id long, n_words long, weak_label double, score double, kept boolean")
