"""Language identification by string kernels.

The kernel of two texts counts the n-grams (1 to 4 of 64 byte classes) that both hold,
whatever their number, over the geometric mean of what each holds: the blended-spectrum
presence kernel, normalised.  Nystroem landmarks, some texts of every language, span its
feature space; one-versus-rest ridge regression is solved there on a labelled sample, and
scores of a block of texts are matrix products: presences by landmarks (the kernel rows),
then kernel rows by coefficients.

The fit reads a bounded, deterministic sample: per language about `TRAIN_PER_LANGUAGE`
labelled rows (fewer where that would pass `TRAIN_ROWS` in all), chosen by a hash of the id;
of a text over `TRAIN_CHARS` characters, a slice of so many from a place that the id's hash
chooses.  Every language is learned; more than `MOST_LANGUAGES` raise an error.  Predictions
read whole texts, and nothing but texts.

A score says which language is nearest, not whether a text is in any.  For that, `familiar` is
the share of a text's longer grams (three and four bytes) that landmarks hold: nearly all of
them in a learned language, few of them in another script or of noise.  `identified` drops what
is less familiar than `FAMILIAR` times what 99 in 100 of the training texts reach that are no
landmarks themselves.

Null texts and texts without a letter get `und` with score and familiarity 0, as does
everything where no row is labelled.  Repeated rows and ties get equal predictions (of equal
scores, the language that comes first).  A text of one letter is predicted by that letter; a
text too short for longer grams counts as familiar.  An empty table has an empty result.  Extra
columns, and those with names like the result's, are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text

UNDETERMINED = "und"
TRAIN_PER_LANGUAGE, TRAIN_ROWS = 400, 20_000
MOST_LANGUAGES = 500
TRAIN_CHARS = 8192
LANDMARKS_PER_LANGUAGE, LANDMARKS = 24, 1024
FAMILIAR = 0.6
RIDGE = 1e-2
GRAMS = (1, 2, 3, 4)
#: Codes of grams of three bytes and more begin here.
_LONGER = sum(64**k for k in range(1, 3))
#: Texts scored in one product.
SCORE_ROWS = 64
_LETTER = regex.compile(r"\p{L}")

#: Byte classes: letters by themselves, anything else in ASCII one class, other bytes by their low five bits.
CLASS = np.zeros(256, dtype=np.int64)
CLASS[0x61:0x7B] = CLASS[0x41:0x5B] = np.arange(1, 27)
CLASS[0x80:] = 32 + np.arange(128) % 32


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves remainder 2 by 4."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def presences(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of every n-gram that a row holds, each once, in order of rows."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    symbols = CLASS[buf]
    row = _text.owners(offs)
    found = []
    code = np.zeros(len(buf), dtype=np.int64)
    for n in range(1, max(GRAMS) + 1):
        code = (code[: len(buf) - n + 1] << 6) + symbols[n - 1 :]
        if n in GRAMS:
            whole = row[: len(code)] == row[n - 1 :]
            # grams of each length in a range of their own
            key = (row[: len(code)][whole] << 26) + (code[whole] + sum(64**k for k in range(1, n)))
            key.sort()
            found.append(key[np.concatenate(([True], key[1:] != key[:-1]))] if len(key) else key)
    key = np.sort(np.concatenate(found))
    return key >> 26, key & ((1 << 26) - 1)


class Model:
    """Landmarks and coefficients; `scores` gives one column per language."""

    def __init__(self, languages: list[str], vocabulary: np.ndarray, landmarks: np.ndarray, coefficients: np.ndarray):
        self.languages, self.vocabulary, self.landmarks, self.coefficients = languages, vocabulary, landmarks, coefficients
        self.least_familiar = 0.0

    @classmethod
    def fit(cls, texts: list[bytes], labels: list[str]) -> Model:
        languages = sorted(set(labels))
        each = max(1, min(LANDMARKS_PER_LANGUAGE, LANDMARKS // len(languages)))
        marks = [k for lang in languages for k in [i for i, x in enumerate(labels) if x == lang][:each]]
        buf, offs = _text.flat(pa.array([texts[k] for k in marks], pa.large_binary()))
        row, gram = presences(buf, offs)
        vocabulary = np.unique(gram)
        held = np.zeros((len(marks), len(vocabulary)), dtype=np.float32)
        held[row, np.searchsorted(vocabulary, gram)] = 1
        held /= np.sqrt(np.maximum(held.sum(axis=1, keepdims=True), 1))
        among = (held @ held.T).astype(np.float64)
        values, vectors = np.linalg.eigh(among)
        some = values > 1e-6 * values[-1]
        to_features = vectors[:, some] / np.sqrt(values[some])
        model = cls(languages, vocabulary, held.T.copy(), np.eye(len(marks), dtype=np.float32))
        buf, offs = _text.flat(pa.array(texts, pa.large_binary()))
        found = [model.scores(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in _text.slices(offs)]
        features = np.concatenate([x for x, _ in found]).astype(np.float64) @ to_features
        others = np.setdiff1d(np.arange(len(texts)), marks)
        if len(others):
            model.least_familiar = FAMILIAR * float(np.quantile(np.concatenate([x for _, x in found])[others], 0.01))
        targets = np.where(np.array(labels)[:, None] == np.array(languages)[None, :], 1.0, -1.0)
        weights = 1 / np.array([labels.count(x) for x in labels])  # each language weighs the same
        weights /= weights.mean()
        gram_matrix = features.T @ (features * weights[:, None])
        solved = np.linalg.solve(gram_matrix + RIDGE * len(texts) / len(marks) * np.eye(len(gram_matrix)), features.T @ (targets * weights[:, None]))
        model.coefficients = (to_features @ solved).astype(np.float32)
        return model

    def scores(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores by language, and the familiarity, of each row."""
        rows = len(offs) - 1
        row, gram = presences(buf, offs)
        norm = np.sqrt(np.maximum(np.bincount(row, minlength=rows), 1))
        at = np.minimum(np.searchsorted(self.vocabulary, gram), len(self.vocabulary) - 1)
        known = self.vocabulary[at] == gram
        longer = gram >= _LONGER
        n_longer = np.bincount(row[longer], minlength=rows)
        familiar = np.where(n_longer > 0, np.bincount(row[longer & known], minlength=rows) / np.maximum(n_longer, 1), 1.0)
        row, at = row[known], at[known]
        out = np.zeros((rows, self.coefficients.shape[1]), dtype=np.float32)
        held = np.zeros((min(rows, SCORE_ROWS), len(self.vocabulary)), dtype=np.float32)
        for i in range(0, rows, SCORE_ROWS):
            j = min(rows, i + SCORE_ROWS)
            a, b = np.searchsorted(row, (i, j))
            held[row[a:b] - i, at[a:b]] = 1
            kernel = held[: j - i] @ self.landmarks
            kernel /= norm[i:j, None]
            out[i:j] = kernel @ self.coefficients
            held[row[a:b] - i, at[a:b]] = 0
        return out, familiar


def training_rows(documents: DataFrame) -> DataFrame:
    """text and lang of a bounded number of labelled rows per language, of long texts a slice."""
    usable = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
    counts = usable.groupBy("lang").count().orderBy("lang").limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: they would have too few rows each")
    if not counts:
        return usable.limit(0).select("text", "lang")
    each = min(TRAIN_PER_LANGUAGE, TRAIN_ROWS // len(counts))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1 << 30, int(1.25 * each / r["count"] * (1 << 30)) + 1))])
    chosen = usable.where(place < share[F.col("lang")])
    beyond = F.greatest(F.char_length("text") - TRAIN_CHARS, F.lit(0))
    piece = F.substr("text", F.pmod(F.xxhash64("doc_id", F.lit(1)), beyond + 1).cast("int") + 1, F.lit(TRAIN_CHARS))
    return chosen.select("doc_id", piece.alias("text"), "lang", place.alias("place")).orderBy("place", "doc_id", F.xxhash64("text")).limit(2 * each * len(counts)).select("text", "lang")


def fitted(documents: DataFrame) -> Model | None:
    """The model of a sample of documents (doc_id, text, lang); None where nothing can be learned."""
    rows = training_rows(documents.select("doc_id", "text", "lang")).toArrow()
    taught = [(t.encode(), x) for t, x in zip(rows.column("text").to_pylist(), rows.column("lang").to_pylist()) if _LETTER.search(t)]
    return Model.fit([t for t, _ in taught], [x for _, x in taught]) if taught else None


def predictions(model: Model | None, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Languages, scores and familiarity of a column of texts."""
    buf, offs = _text.flat(texts)
    raw, rows = buf.tobytes(), len(offs) - 1
    lang, score, familiar = np.full(rows, UNDETERMINED, dtype=object), np.zeros(rows), np.zeros(rows)
    for i, j in _text.slices(offs):
        if model is None or offs[i] == offs[j]:
            continue
        scores, familiar[i:j] = model.scores(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        scores = scores.astype(np.float64)
        best = scores.argmax(axis=1)
        lang[i:j] = np.array(model.languages, dtype=object)[best]
        score[i:j] = np.clip((scores[np.arange(j - i), best] + 1) / 2, 0, 1)
    for k, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist())):
        if not _LETTER.search(raw[a:b].decode()):
            lang[k], score[k], familiar[k] = UNDETERMINED, 0.0, 0.0
    return lang, score, familiar


def identify(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, familiar for every row of documents (doc_id, text, lang)."""
    shared = documents.sparkSession.sparkContext.broadcast(fitted(documents))

    def run(batches):
        for batch in batches:
            lang, score, familiar = predictions(shared.value, batch.column(2))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lang, pa.string()), pa.array(score), pa.array(familiar)], names=["doc_id", "held_out", "lang_pred", "score", "familiar"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_text.frugal(run), "doc_id long, held_out boolean, lang_pred string, score double, familiar double")


def identified(documents: DataFrame) -> DataFrame:
    """The rows of documents, all columns, whose text is in a learned language; where nothing can be learned, none."""
    shared = documents.sparkSession.sparkContext.broadcast(fitted(documents))
    at = documents.columns.index("text")

    def run(batches):
        model = shared.value
        for batch in batches:
            lang, _, familiar = predictions(model, batch.column(at))
            yield batch.filter(pa.array((lang != UNDETERMINED) & (familiar >= (model.least_familiar if model else 0))))

    return documents.mapInArrow(_text.frugal(run), documents.schema)
