"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded by the frequencies of
pairs of adjacent character classes and by how much of it repeats; a tanh layer embeds it, gated
attention (Ilse et al. 2018) weighs the passages, and a logistic layer scores the weighted
passage representation. The weights are learned from document labels alone, on a bounded sample of labelled
documents, of each of which every passage counts; scoring reads every passage of every text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructType

from .common import Scratch, batched

PASSAGE = 64
_KINDS = {
    1: b"aeiouy", 2: b"bcdfghjklmnpqrstvwxz", 3: bytes(range(65, 91)), 4: b"0123456789", 5: b" ", 6: b"\t\n\x0b\x0c\r",
    7: b".", 8: b",", 9: b"!?;:", 10: b"\"'()[]{}", 11: b"#$%&*@^+=~", 12: b"|\\/<>_`", 13: b"-", 14: bytes(range(192, 256)), 15: bytes(range(128, 192)),
}
KIND = np.zeros(256, np.int64)
for _k, _chars in _KINDS.items():
    KIND[list(_chars)] = _k
#: Pairs of classes, then: repeated word triples, repeated words, mean word length, share of a full passage.
FEATURES = 256 + 4


def encode(text: str | None) -> np.ndarray:
    """The passages of a text (one of zeros if it has no word), a row each."""
    data = (text or "").encode()
    words = data.split()
    if not words:
        return np.zeros((1, FEATURES), np.float32)
    n, raw = len(words), np.frombuffer(data, np.uint8)
    passages = -(-n // PASSAGE)
    white = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = ~white & np.concatenate([[True], white[:-1]])
    passage = np.maximum(np.cumsum(begins) - 1, 0) // PASSAGE
    kind = KIND[raw]
    out = np.zeros((passages, FEATURES), np.float32)
    pairs = passage[1:] * 256 + kind[:-1] * 16 + kind[1:]
    out[:, :256] = np.bincount(pairs, minlength=passages * 256).reshape(passages, 256)
    out[:, :256] /= np.maximum(out[:, :256].sum(axis=1, keepdims=True), 1)
    hashes = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)  # equal words meet within one text only
    place = np.arange(n) // PASSAGE
    size = np.bincount(place, minlength=passages)
    for column, keys in ((256, hashes[:-2] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[2:] if n > 2 else hashes[:0]), (257, hashes)):
        again = np.ones(len(keys), bool)
        again[np.unique(keys, return_index=True)[1]] = False
        out[:, column] = np.bincount(place[: len(keys)][again], minlength=passages) / size
    out[:, 258] = np.bincount(place, [len(w) for w in words], passages) / size / 8
    out[:, 259] = size / PASSAGE
    return out


@dataclass
class Model:
    """mean, scale: of the features. w, b: passage layer. v, u, a: gated attention. c, d: logistic layer."""

    mean: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    constant: float | None = None

    def score(self, bag: np.ndarray) -> float:
        """0 to 1 for one document; higher is likelier good."""
        if self.constant is not None:
            return self.constant
        logit, _ = _forward(self.weights, (bag - self.mean) / self.scale, np.array([0]))
        return float(1 / (1 + np.exp(-logit[0])))


def _forward(weights: list[np.ndarray], x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, tuple]:
    w, b, v, u, a, c, d = weights
    h = np.tanh(x @ w + b)
    tv, su = np.tanh(h @ v), 1 / (1 + np.exp(-(h @ u)))
    s = (tv * su) @ a
    sizes = np.diff([*starts, len(x)])
    e = np.exp(s - np.repeat(np.maximum.reduceat(s, starts), sizes))
    p = e / np.repeat(np.add.reduceat(e, starts), sizes)
    z = np.add.reduceat(h * p[:, None], starts)
    return z @ c + d[0], (h, tv, su, p, z, sizes)


def _gradients(weights: list[np.ndarray], x: np.ndarray, starts: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
    w, b, v, u, a, c, d = weights
    logit, (h, tv, su, p, z, sizes) = _forward(weights, x, starts)
    g = (1 / (1 + np.exp(-logit)) - y) / len(y)
    gz = np.repeat(g, sizes)[:, None] * c
    gp = (gz * h).sum(axis=1)
    gs = p * (gp - np.repeat(np.add.reduceat(p * gp, starts), sizes))
    ga = (tv * su).T @ gs
    gt, gu = gs[:, None] * a * su * (1 - tv**2), gs[:, None] * a * tv * su * (1 - su)
    gh = gz * p[:, None] + gt @ v.T + gu @ u.T
    gx = gh * (1 - h**2)
    return [x.T @ gx, gx.sum(axis=0), h.T @ gt, h.T @ gu, ga, z.T @ g, np.array([g.sum()])]


def fit(bags: list[np.ndarray], labels: np.ndarray, width: int = 24, gates: int = 12, epochs: int = 25, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> Model:
    """Learns the model by Adam. With no bag the score is always 1, with one class it is that class."""
    mean, scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
    if not len(bags) or len(set(labels.tolist())) < 2:
        return Model(mean, scale, [], float(labels[0]) if len(bags) else 1.0)
    flat = np.concatenate(bags)
    mean, scale = flat.mean(axis=0), flat.std(axis=0) + 1e-3
    flat = (flat - mean) / scale
    ends = np.cumsum([len(b) for b in bags])
    begins = ends - [len(b) for b in bags]
    rng = np.random.default_rng(seed)
    shapes = [(FEATURES, width), (width,), (width, gates), (width, gates), (gates,), (width,), (1,)]
    weights = [(rng.normal(0, 1 / np.sqrt(s[0]), s) if i not in (1, 6) else np.zeros(s)).astype(np.float32) for i, s in enumerate(shapes)]
    m, r = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for k in range(0, len(order), 64):
            own = order[k : k + 64]
            rows = np.concatenate([np.arange(begins[i], ends[i]) for i in own])
            starts = np.cumsum([0, *(ends[i] - begins[i] for i in own[:-1])])
            step += 1
            for i, g in enumerate(_gradients(weights, flat[rows], starts, labels[own])):
                g = g + decay * weights[i]
                m[i] = 0.9 * m[i] + 0.1 * g
                r[i] = 0.999 * r[i] + 0.001 * g * g
                weights[i] = (weights[i] - rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(r[i] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, weights)


def _part(doc_id: Column | None = None) -> Column:
    return F.pmod(F.crc32((F.col("doc_id") if doc_id is None else doc_id).cast("string")), F.lit(4))


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, passages: int = 250_000) -> Model:
    """Fits on a sample of the labelled documents outside the held-out quarter: of at most ``sample``, those of the smallest id hash, as many as have ``passages`` passages together.

    All passages of a document of the sample count (a document with more than ``passages`` is passed over), so the
    driver holds 1 KB for each of ``passages`` at most. labels: doc_id, quality; other columns are ignored. Rows with a null are
    ignored; of several labels of a document the lower counts, of several texts that of the smallest hash. Neither
    repeated rows nor their order change the model.
    """
    rows = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where(_part() != 2)
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [encode(text.as_py()) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("place"), batch.column("quality"), pa.array(map(len, found), pa.int64()), pa.array([f.tobytes() for f in found], pa.binary())], ["place", "quality", "n", "bag"])

    # at most ``sample`` short rows, so their broadcast is bounded; a document's texts meet as the least of each task
    chosen = docs.select("doc_id", "text").join(F.broadcast(rows), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = chosen.select(F.struct(F.xxhash64("doc_id").alias("h"), F.col("doc_id").cast("string").alias("d")).alias("place"), F.col("quality").cast("double").alias("quality"), "text")
    written = Scratch(docs.sparkSession, "bags").write(batched(chosen).mapInArrow(bags, "place struct<h: bigint, d: string>, quality double, n long, bag binary"), sample)
    total, last = 0, None
    for place, n in sorted((tuple(r.place), r.n) for r in written.where(F.col("n") <= passages).select("place", "n").collect()):  # at most ``sample`` rows
        if total + n > passages:
            break
        total, last = total + n, place
    got = written.where(F.col("n") <= passages).where(F.col("place") <= F.struct(F.lit(last[0]).alias("h"), F.lit(last[1]).alias("d"))).sort("place").collect() if last else []
    return fit([np.frombuffer(r.bag, np.float32).reshape(-1, FEATURES) for r in got], np.array([r.quality for r in got], np.float32))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs with its columns renamed to c0, c1, ... and score beside them, so that no name can clash."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand weights
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([shared.value.score(encode(t.as_py())) for t in batch.column(text)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*names, "score"])

    renamed = docs.toDF(*names)
    return batched(renamed).mapInArrow(run, StructType([*renamed.schema.fields]).add("score", DoubleType()))


def score(docs: DataFrame, model: Model, threshold: float = 0.7, keep: bool = False) -> DataFrame:
    """Scores every whole text: doc_id, held_out, score, predicted; with ``keep`` behind all columns of docs but those of these names.

    A null or empty text is one passage of zeros and gets the model's score for that. A null doc_id isn't held out.
    """
    docs = docs if keep else docs.select("doc_id", "text")
    own = {name: F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns) if name not in ("held_out", "score", "predicted")}
    held_out = F.coalesce(_part(F.col(f"c{docs.columns.index('doc_id')}")) == 2, F.lit(False))
    return _scored(docs, model).select(*(own.values() if keep else [own["doc_id"]]), held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def reject_low_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 4000) -> DataFrame:
    """The documents, with their own columns, that the classifier does not reject."""
    marked = _scored(docs, train(docs, labels, sample)).where(F.col("score") >= threshold)
    return marked.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(docs.columns)))
