"""Quality from passages: gated attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words.  Every passage of every
whole text is encoded into a few numbers of its form (shares of character
classes, lengths of words, how often words repeat in the passage, next to each
other and from earlier passages) and of its content (words hashed into
``BUCKETS`` counts).  Passages get a hidden vector; gated attention (tanh times
sigmoid) weighs a bag's vectors into one, and a logistic layer scores that.  All
weights are learned together from document labels alone, by Adam on the summed
cross-entropy, with the gradients written out in numpy.

Fitting uses a bounded sample of whole documents, encoded by Spark tasks: the
``MOST_ROWS`` labelled ones of least hash, or fewer once they have
``MOST_PASSAGES`` passages together.  Scoring covers every passage of every text,
in a streaming softmax that holds one block of passages at a time and the set of
the text's words.

Defined cases: a null or empty text is a bag of one empty passage; a very long text
is scored block by block; null labels
and labels of unknown documents are ignored, and of a document with several the
least counts; with no labels, or labels of one kind, every score is that kind's
share (0.5 without any); repeated rows get equal scores; a null key is scored
and never trained on; columns ``score`` and ``predicted`` of the input are
replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE, BLOCK = 64, 256
MOST_ROWS, MOST_PASSAGES = 4000, 200_000
HIDDEN, ATTENTION, EPOCHS, BATCH, RATE, DECAY = 16, 8, 40, 64, 0.01, 1e-4
THRESHOLD = 0.3

_CLASS = bytearray(b"o" * 256)  # other
for _chars, _name in (
    (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"U"), (b"abcdefghijklmnopqrstuvwxyz", b"l"), (bytes(range(128, 256)), b"h"),
    (b"0123456789", b"d"), (b" \t\n\r\x0b\x0c", b"s"), (b".", b"."), (b",;:", b","), (b"!?", b"!"), (b"#*$%&|<>", b"#"),
    (b"'\"()-", b"q"),
):
    for _c in _chars:
        _CLASS[_c] = _name[0]
_CLASS = bytes(_CLASS)
_COUNTED = [b"U", b"l", b"h", b"d", b".", b",", b"!", b"#", b"q", b"o"]
#: Counts that words are hashed into.
BUCKETS = 32
N_FEATURES = len(_COUNTED) + 9 + BUCKETS


def passages(text: str) -> Iterator[np.ndarray]:
    """Features of the passages of a text in order, in blocks."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen: set[bytes] = set()
    rows: list[list[float]] = []
    crc = zlib.crc32
    for k in range(0, max(1, len(words)), PASSAGE):
        some = words[k : k + PASSAGE]
        n = len(some)
        marks = b" ".join(some).translate(_CLASS)
        size = max(1, len(marks))
        different = set(some)
        lengths = list(map(len, some))
        mean = sum(lengths) / n if n else 0.0
        rows.append([
            *[marks.count(c) / size for c in _COUNTED],
            n / PASSAGE,
            mean / 10,
            (sum(x * x for x in lengths) / n - mean * mean) ** 0.5 / 10 if n else 0.0,
            max(lengths, default=0) / 50,
            len(different) / n if n else 0.0,
            sum(map(bytes.__eq__, some, some[1:])) / n if n else 0.0,
            len(different & seen) / len(different) if different else 0.0,
            lengths.count(1) / n if n else 0.0,
            1.0 if k == 0 else 0.0,
            *(np.bincount([crc(w) % BUCKETS for w in some], minlength=BUCKETS) / max(1, n)).tolist(),
        ])
        seen |= different
        if len(rows) == BLOCK:
            yield np.array(rows)
            rows = []
    if rows:
        yield np.array(rows)


@dataclass
class AttentionModel:
    """Weights of the encoder, the gated attention and the output, and the features' mean and scale."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def score(self, blocks: Iterator[np.ndarray]) -> float:
        if self.constant is not None:
            return self.constant
        w, top, total, bag = self.weights, -np.inf, 0.0, np.zeros(HIDDEN)
        for x in blocks:
            h = np.tanh((x - self.mean) / self.scale @ w["e"] + w["eb"])
            a = (np.tanh(h @ w["v"]) / (1 + np.exp(-(h @ w["u"])))) @ w["a"]
            high = max(top, float(a.max()))
            p, old = np.exp(a - high), np.exp(top - high)
            total, bag, top = total * old + float(p.sum()), bag * old + p @ h, high
        return float(1 / (1 + np.exp(-np.clip(bag / total @ w["c"] + w["cb"][0], -30, 30))))


def fit(bags: list[np.ndarray], labels: np.ndarray, seed: int = 42) -> AttentionModel:
    """Learns from bags of passages and their labels (0 or 1)."""
    if not len(bags) or labels.min() == labels.max():
        return AttentionModel(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, float(labels.mean()) if len(bags) else 0.5)
    every = np.concatenate(bags)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    rng = np.random.default_rng(seed)
    shape = {"e": (N_FEATURES, HIDDEN), "eb": (HIDDEN,), "v": (HIDDEN, ATTENTION), "u": (HIDDEN, ATTENTION), "a": (ATTENTION,), "c": (HIDDEN,), "cb": (1,)}
    w = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if not k.endswith("b") else np.zeros(s) for k, s in shape.items()}
    m, v, t = {k: 0 * x for k, x in w.items()}, {k: 0 * x for k, x in w.items()}, 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), BATCH):
            t += 1
            for name, g in _gradient(w, [bags[i] for i in order[k : k + BATCH]], labels[order[k : k + BATCH]]).items():
                g = g + DECAY * w[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                w[name] = w[name] - RATE * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
    return AttentionModel(mean, scale, w)


def _gradient(w: dict[str, np.ndarray], bags: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy over some bags; all passages of the bags go through in one matrix."""
    x, starts = np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1]
    bag = np.repeat(np.arange(len(bags)), [len(b) for b in bags])
    h = np.tanh(x @ w["e"] + w["eb"])
    g, s = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
    a = (g * s) @ w["a"]
    p = np.exp(a - np.maximum.reduceat(a, starts)[bag])
    p /= np.add.reduceat(p, starts)[bag]
    z = np.add.reduceat(p[:, None] * h, starts)
    d = (1 / (1 + np.exp(-np.clip(z @ w["c"] + w["cb"][0], -30, 30))) - y) / len(bags)
    dz = d[:, None] * w["c"]
    dp = (dz[bag] * h).sum(1)
    da = p * (dp - np.add.reduceat(p * dp, starts)[bag])
    dg, ds = da[:, None] * w["a"] * s * (1 - g * g), da[:, None] * w["a"] * g * s * (1 - s)
    dh = (p[:, None] * dz[bag] + dg @ w["v"].T + ds @ w["u"].T) * (1 - h * h)
    return {"e": x.T @ dh, "eb": dh.sum(0), "v": h.T @ dg, "u": h.T @ ds, "a": (g * s).T @ da, "c": z.T @ d, "cb": np.array([d.sum()])}


def train(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 42
) -> AttentionModel:
    """Fits on the sampled rows of ``labels`` (key, label) and their texts in ``docs``."""
    known = (
        labels.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{label}`").isin(0, 1))
        .groupBy(F.col(f"`{key}`").alias("key"))
        .agg(F.min(f"`{label}`").alias("label"))
    )
    # twice the bound, as labels may belong to documents that are gone; then the bound over those found
    drawn = known.withColumn("h", F.xxhash64(F.col("key").cast("string"), F.lit(seed))).orderBy("h", "key").limit(2 * MOST_ROWS)
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column("text"):
                rows.append(np.concatenate(list(passages(t.as_py() or ""))).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("h"), b.column("label").cast(pa.int32()), pa.array(rows, pa.binary())], ["h", "label", "x"])

    joined = texts.join(F.broadcast(drawn), "key").select("h", "label", "text")  # at most 2 * MOST_ROWS rows
    # of rows that repeat an id one is taken, the same in every run
    once = joined.mapInArrow(run, "h long, label int, x binary").groupBy("h").agg(F.min(F.struct("label", "x")).alias("r"))
    bags, y, size = [], [], 0
    for r in once.orderBy("h").limit(MOST_ROWS).select("r.*").toLocalIterator():
        bags.append(np.frombuffer(bytes(r.x), "<f4").reshape(-1, N_FEATURES).astype(float))
        y.append(r.label)
        size += len(bags[-1])
        if size >= MOST_PASSAGES:
            break
    return fit(bags, np.array(y, float), seed)


def score(docs: DataFrame, model: AttentionModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (by default all) with score and predicted (1 from THRESHOLD on)."""
    kept = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    tag = "_scored_text"
    of = docs.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").alias(tag))
    schema = T.StructType([*of.schema.fields[:-1], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [model.score(passages(t.as_py() or "")) for t in b.column(len(kept))]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], [*b.schema.names[:-1], "score"])

    return of.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
