"""Secret scans: patterns, and a character convolutional network over every candidate.

Base spans are those of three fixed patterns.  Beyond them, every run of 16 or more
characters of `[A-Za-z0-9+/_.=-]` that holds a letter or a digit is a candidate.  The
network reads the whole candidate and `CONTEXT` characters on either side: characters are
embedded, a flag tells candidate from context, one convolution is pooled by maximum and by
mean, and a logistic unit gives a score that Platt scaling calibrates.  Candidates are scored
in batches of like length.  It is trained here, in numpy, on findings that
`labelled_findings` writes by rule (secrets of several kinds, and look-alikes: words, paths,
versions, identifiers, addresses, dates): seven tenths of them; its scaling and its threshold,
the largest that keeps `MIN_RECALL` of the secrets, are set on two tenths, and the last tenth
measures it (`Network.recall`, `Network.false_alarms`).  A candidate that reaches the
threshold, and of which base spans leave a character uncovered, is added whole with the kind
`found`, so it may overlap base spans; those stay as they are, whatever their score.

Null texts are empty and hold nothing; an empty table has an empty result.  Texts are scanned
whole, and candidates of any length scored whole.  Offsets are code points.  Of spans that
begin together the kinds are in the order of `KINDS`.  Repeated rows have equal results; extra
columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm import _text

KINDS = ("assign", "access", "hex", "found")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
_SAYS = re.compile(r"[A-Za-z0-9]")
ASSIGN_LEAST, ACCESS_LEAST, LONG = 12, 18, 16
_MEMBER = _text.byte_class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")

CONTEXT = 24
EMBED, FILTERS, WIDTH = 8, 24, 5
MIN_RECALL = 0.97
TRAIN_FINDINGS, SEED = 8000, 17
#: Characters scored in one product.
SCORE_CHARS = 1 << 15


def base_spans(text: str, raw: bytes, long_run: bool) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the fixed patterns, in order; long_run: whether raw has a run of 16 candidate characters."""
    found = []
    low = raw.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if long_run:
        if b"AKIA" in raw:
            found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found.sort(key=lambda s: (s[0], s[2]))
    return found


def candidates(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CANDIDATE.finditer(text) if _SAYS.search(m.group())]


def _codes(s: str) -> np.ndarray:
    """0 for nothing, 1-95 for printable ASCII, 96 for white space, 97 for the rest."""
    c = np.frombuffer(s.encode("utf-32-le"), dtype="<u4").astype(np.int64)
    return np.where((c > 32) & (c < 127), c - 31, np.where((c <= 32) | (c == 0xA0), 96, 97))


def window_of(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Character codes of a candidate with its context, and where the candidate is; short sides are padded with 0."""
    left, right = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    codes = np.concatenate((np.zeros(CONTEXT - len(left), np.int64), _codes(left + text[start:end] + right), np.zeros(CONTEXT - len(right), np.int64)))
    inside = np.zeros(len(codes), dtype=np.float32)
    inside[CONTEXT : CONTEXT + end - start] = 1
    return codes, inside


class Network:
    """Embedding, one convolution, maximum and mean pooling, a logistic unit; trained by Adam."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.p = {
            "embed": rng.normal(0, 0.5, (98, EMBED)),
            "filters": rng.normal(0, (2 / (WIDTH * (EMBED + 1))) ** 0.5, (WIDTH * (EMBED + 1), FILTERS)),
            "bias": np.zeros(FILTERS),
            "out": rng.normal(0, 0.2, 2 * FILTERS),
            "off": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.scale, self.shift, self.threshold, self.recall, self.false_alarms = 1.0, 0.0, 0.5, 0.0, 0.0

    def _columns(self, codes: np.ndarray, inside: np.ndarray) -> np.ndarray:
        x = np.concatenate((self.p["embed"][codes] * (codes > 0)[..., None], inside[..., None]), axis=-1)
        n = codes.shape[-1] - WIDTH + 1
        return np.concatenate([x[..., k : k + n, :] for k in range(WIDTH)], axis=-1)

    def pooled(self, codes: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        act = np.maximum(self._columns(codes, inside) @ self.p["filters"] + self.p["bias"], 0)
        return act, act.max(axis=-2), act.mean(axis=-2)

    def raw(self, windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Scores of candidates before calibration, in batches of like length; long ones in parts, so memory stays bounded."""
        size = np.array([len(c) for c, _ in windows], dtype=np.int64)
        order, out, at = np.argsort(size, kind="stable"), np.zeros(len(windows), dtype=np.float64), 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * size[order[end]] <= SCORE_CHARS and size[order[end]] <= 2 * size[order[at]]:
                end += 1
            own, at = order[at:end], end
            longest, n = int(size[own[-1]]), size[own] - WIDTH + 1
            codes, inside = (np.stack([np.pad(windows[i][k], (0, longest - size[i])) for i in own]) for k in (0, 1))
            top, total = np.zeros((len(own), FILTERS), np.float32), np.zeros((len(own), FILTERS))
            for a in range(0, longest - WIDTH + 1, SCORE_CHARS):
                act, _, _ = self.pooled(codes[:, a : a + SCORE_CHARS + WIDTH - 1], inside[:, a : a + SCORE_CHARS + WIDTH - 1])
                act *= (a + np.arange(act.shape[1]) < n[:, None])[..., None]  # beyond a shorter candidate's window
                top = np.maximum(top, act.max(axis=1))
                total += act.sum(axis=1)
            out[own] = np.concatenate((top, total / n[:, None]), axis=1) @ self.p["out"] + self.p["off"][0]
        return out

    def probability(self, windows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.raw(windows) + self.shift, -50, 50)))

    def train(self, windows: list, labels: np.ndarray, epochs: int, rng: np.random.Generator, rate: float = 4e-3) -> None:
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        size, step = np.array([len(c) for c, _ in windows]), 0
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            order = order[np.argsort(size[order] // 8, kind="stable")]  # lengths alike in a batch
            batches = np.array_split(order, max(1, len(order) // 64))
            for k in rng.permutation(len(batches)):
                batch = batches[k]
                longest = int(size[batch].max())
                codes = np.stack([np.pad(windows[i][0], (0, longest - size[i])) for i in batch])
                inside = np.stack([np.pad(windows[i][1], (0, longest - size[i])) for i in batch])
                step += 1
                for name, g in self._gradients(codes, inside, labels[batch]).items():
                    m, v = moments[name]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    self.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def _gradients(self, codes, inside, labels) -> dict[str, np.ndarray]:
        columns = self._columns(codes, inside)
        act = np.maximum(columns @ self.p["filters"] + self.p["bias"], 0)
        most, mean = act.max(axis=1), act.mean(axis=1)
        pooled = np.concatenate((most, mean), axis=1)
        score = pooled @ self.p["out"] + self.p["off"]
        error = (1 / (1 + np.exp(-np.clip(score, -50, 50))) - labels) / len(labels)
        d_pool = error[:, None] * self.p["out"]
        d_act = np.broadcast_to(d_pool[:, None, FILTERS:] / act.shape[1], act.shape).copy()
        b, f = np.indices(most.shape)
        d_act[b, act.argmax(axis=1), f] += d_pool[:, :FILTERS]
        d_act *= act > 0
        flat = d_act.reshape(-1, FILTERS)
        d_columns = (flat @ self.p["filters"].T).reshape(*d_act.shape[:2], WIDTH, EMBED + 1)
        d_embed = np.zeros_like(self.p["embed"])
        n = d_act.shape[1]
        for k in range(WIDTH):
            np.add.at(d_embed, codes[:, k : k + n].ravel(), d_columns[:, :, k, :EMBED].reshape(-1, EMBED))
        d_embed[0] = 0
        return {"embed": d_embed, "filters": columns.reshape(-1, columns.shape[-1]).T @ flat, "bias": flat.sum(axis=0), "out": pooled.T @ error, "off": np.array([error.sum()])}

    def calibrate(self, windows: list, labels: np.ndarray) -> None:
        """Platt scaling on held-back findings, then the largest threshold with MIN_RECALL on their secrets."""
        raw = self.raw(windows)
        x = np.stack((raw, np.ones(len(raw))), axis=1)
        smooth = np.where(labels > 0, 1 - 1 / (labels.sum() + 2), 1 / ((1 - labels).sum() + 2))
        w = np.array([1.0, 0.0])
        for _ in range(50):  # Newton steps
            p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
            w -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - smooth))
        self.scale, self.shift = float(w[0]), float(w[1])
        secrets = np.sort(1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))[labels > 0])
        self.threshold = float(secrets[int((1 - MIN_RECALL) * len(secrets))])

    def measure(self, windows: list, labels: np.ndarray) -> None:
        found = self.probability(windows) >= self.threshold
        self.recall, self.false_alarms = float(found[labels > 0].mean()), float(found[labels == 0].mean())


_UPPER, _LOWER_CASE, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"


def labelled_findings(n: int, seed: int) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of n findings: half secrets, half look-alikes, in contexts of either sort."""
    rng = random.Random(seed)

    def chars(alphabet: str, low: int, high: int) -> str:
        return "".join(rng.choice(alphabet) for _ in range(rng.randint(low, high)))

    def word() -> str:
        return chars(_LOWER_CASE, 2, 9)

    def spoken(low: int, high: int) -> str:
        """A word that could be said: consonants and vowels in turn."""
        onsets, vowels = "b c d f g h j k l m n p r s t v w z ch st tr sch br gr th qu".split(), "a e i o u ei ou ie au".split()
        return "".join(rng.choice(onsets) + rng.choice(vowels) + rng.choice(("", "", "n", "r", "s", "t", "ng", "ll")) for _ in range(rng.randint(low, high)))

    def words(low: int, high: int, gap: str = " ") -> str:
        make = rng.choice((word, lambda: spoken(1, 3)))
        return gap.join(make() for _ in range(rng.randint(low, high)))

    def secret() -> str:
        mixed = _UPPER + _LOWER_CASE + _DIGITS
        kind = rng.randrange(7)
        if kind == 6:
            return chars(_UPPER + _LOWER_CASE, 20, 48)
        if kind == 0:
            return chars(_LOWER_CASE, 2, 4) + rng.choice("_-") + chars(mixed, 20, 48)
        if kind == 1:
            return chars(mixed + "+/", 24, 88) + rng.choice(("", "=", "=="))
        if kind == 2:
            return chars(_UPPER, 3, 4) + chars(_UPPER + _DIGITS, 14, 20)
        if kind == 3:
            return ".".join("ey" + chars(mixed + "_-", 16, 60) for _ in range(3))
        if kind == 4:
            return "-".join(chars(mixed, 8, 24) for _ in range(rng.randint(2, 4)))
        return chars(mixed, 20, 64)

    def look_alike() -> str:
        kind = rng.randrange(11)
        if kind == 7:
            return rng.choice((str, str.capitalize, str.upper))(spoken(4, 9))
        if kind == 8:
            return words(3, 6, rng.choice("_-./"))
        if kind == 9:
            return "".join(w.capitalize() for w in words(3, 6).split())
        if kind == 10:
            return spoken(1, 2) + rng.choice("=-._") * rng.randint(12, 60)
        if kind == 0:
            return "/".join([words(1, 2, "_") for _ in range(rng.randint(2, 5))]) + f"/{word()}{rng.randint(0, 99)}.{chars(_LOWER_CASE, 2, 4)}"
        if kind == 1:
            return f"{words(2, 4, '-')}-{rng.randint(0, 40)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}"
        if kind == 2:
            return f"{words(2, 5, '_')}_{rng.randint(0, 9999)}"
        if kind == 3:
            return f"{word()}.{rng.randint(1, 99)}.mail{rng.randint(0, 9)}.{word()}.com"
        if kind == 4:
            return f"{rng.randint(1990, 2030)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}T{rng.randint(0, 23):02}.{rng.randint(0, 59):02}.{rng.randint(0, 59):02}Z"
        if kind == 5:
            return "www." + words(1, 3, ".") + f".org/{word()}/{rng.randint(1, 5000)}"
        return "".join(w.capitalize() for w in words(3, 6).split()) + str(rng.randint(0, 99))

    def piece(make) -> str:
        while True:
            s = make()
            if len(s) >= LONG:
                return s

    out = []
    for k in range(n):
        label = k % 2
        token = piece(secret if label else look_alike)
        named = rng.random() < (0.6 if label else 0.1)
        name = rng.choice(("key", "auth", "credential", "bearer", "access", "private", "signature", "pwd")) if named else word()
        lead = f"{words(0, 6)} {name}{rng.choice((' ', ': ', ' = ', '=' + chr(34), ': ' + chr(34)))}" if rng.random() < 0.7 else words(0, 6) + " "
        tail = rng.choice(("", '"', ".", ",", "\n")) if token[-1] not in "=." else ""
        tail = tail.replace(".", " ") + " " + words(0, 6)
        out.append((lead + token + tail, len(lead), len(lead) + len(token), label))
    return out


@lru_cache(maxsize=2)
def trained(n: int = TRAIN_FINDINGS, seed: int = SEED) -> Network:
    """The network: fitted on seven tenths of the findings, calibrated on two, measured on one."""
    findings = labelled_findings(n, seed)
    windows = [window_of(t, a, b) for t, a, b, _ in findings]
    labels = np.array([x[3] for x in findings], dtype=np.float32)
    fit, end = 7 * n // 10, 9 * n // 10
    network = Network(seed)
    network.train(windows[:fit], labels[:fit], epochs=4, rng=np.random.default_rng(seed))
    network.calibrate(windows[fit:end], labels[fit:end])
    network.measure(windows[end:], labels[end:])
    return network


class _Spans:
    """Base spans in order of their starts, and those of them that touch a range."""

    def __init__(self, spans: list[tuple[int, int, int]]):
        self.spans, self.starts, self.reach = spans, [a for a, _, _ in spans], []
        for _, b, _ in spans:
            self.reach.append(max(b, self.reach[-1]) if self.reach else b)

    def touching(self, start: int, end: int) -> list[tuple[int, int, int]]:
        return [s for s in self.spans[bisect_right(self.reach, start) : bisect_left(self.starts, end)] if s[1] > start]


def _covered(start: int, end: int, spans: list[tuple[int, int, int]]) -> bool:
    """Whether spans, in order of their starts, hold every character of [start, end) between them."""
    for a, b, _ in spans:
        if a > start:
            break
        start = max(start, b)
    return start >= end


def scan_texts(texts: list[str], raws: list[bytes], long_run: list[bool], network: Network):
    """For each text: base spans (start, end, kind), and all spans with the probabilities of those that are candidates (else -1).

    All candidates of the texts are scored together.
    """
    own = [candidates(t) if long else [] for t, long in zip(texts, long_run)]
    p = iter(network.probability([window_of(t, a, b) for t, found in zip(texts, own) for a, b in found]).tolist())
    for text, raw, long, found in zip(texts, raws, long_run, own):
        base = base_spans(text, raw, long)
        index, spans = _Spans(base), {s: -1.0 for s in base}
        for (a, b), score in zip(found, p):
            touching = index.touching(a, b)
            for s in touching:
                spans[s] = max(spans[s], score)
            if score >= network.threshold and not _covered(a, b, touching):
                spans[(a, b, 3)] = score
        yield base, [(*s, score) for s, score in sorted(spans.items(), key=lambda x: (x[0][0], x[0][2]))]


def _long_runs(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Rows with a run of 16 candidate characters or more."""
    out = np.zeros(len(offs) - 1, dtype=bool)
    for i, j in _text.slices(offs):
        part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        starts, ends, runs = _text.word_bounds(part, at, _MEMBER)
        out[i:j] = _text.per_row_sum(ends - starts >= LONG, runs) > 0
    return out


def _each(texts: pa.Array, network: Network):
    buf, offs = _text.flat(texts)
    long_run = _long_runs(buf, offs)
    for i, j in _text.slices(offs):
        own = buf[offs[i] : offs[j]].tobytes()
        raws = [own[a:b] for a, b in zip((offs[i:j] - offs[i]).tolist(), (offs[i + 1 : j + 1] - offs[i]).tolist())]
        whole = [r.decode() for r in raws]
        for text, (base, spans) in zip(whole, scan_texts(whole, raws, long_run[i:j].tolist(), network)):
            yield text, base, spans


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base array<struct<kind string, start long, end long>>, spans array<struct<kind string, start long, end long, score double>>"


def scan(documents: DataFrame) -> DataFrame:
    """One row per row of documents, in the columns of SCHEMA."""
    shared = documents.sparkSession.sparkContext.broadcast(trained())
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    scored = pa.struct([*span, ("score", pa.float64())])

    def run(batches):
        for batch in batches:
            counts, base_out, all_out = [[], [], []], [], []
            for _, base, spans in _each(batch.column(1), shared.value):
                for k in range(3):
                    counts[k].append(sum(s[2] == k for s in base))
                base_out.append([{"kind": KINDS[k], "start": a, "end": b} for a, b, k in base])
                all_out.append([{"kind": KINDS[k], "start": a, "end": b, "score": p} for a, b, k, p in spans])
            cols = [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_out, pa.list_(span)), pa.array(all_out, pa.list_(scored))]
            yield pa.record_batch(cols, names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    chosen = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return chosen.mapInArrow(_text.frugal(run), SCHEMA)


def redact(documents: DataFrame) -> DataFrame:
    """documents, each span of its texts replaced by `[SECRET kind]` (overlapping ones by one, of the first's kind), n_chars (where there is one) counted anew."""
    shared = documents.sparkSession.sparkContext.broadcast(trained())
    at = documents.columns.index("text")

    def run(batches):
        for batch in batches:
            out = []
            for known, (text, _, spans) in zip(batch.column(at).is_valid().to_pylist(), _each(batch.column(at), shared.value)):
                parts, end = [], 0
                for a, b, k, _ in spans:
                    if a >= end:
                        parts += [text[end:a], f"[SECRET {KINDS[k]}]"]
                    end = max(end, b)
                out.append("".join([*parts, text[end:]]) if known else None)
            yield batch.set_column(at, "text", pa.array(out, batch.schema.field(at).type))

    out = documents.mapInArrow(_text.frugal(run), documents.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(documents.schema["n_chars"].dataType)) if "n_chars" in out.columns else out


def digest(spans: list[tuple[str, int, int]]) -> str:
    """The digest of op4's contract, for tests."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
