"""Quality by nearest neighbours: latent-semantic vectors of labelled texts vote, weighted by cosine.

Terms are hashed shapes and trigrams of a whole text, and how its words, lines
and repeats run. A truncated decomposition of the labelled sample's weighted
terms gives the latent space. Every document is compared with every labelled
vector, exactly, in blocks of matrix products; the nearest vote.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import fold_of, least_hashed, text_slices

#: Labelled texts of each class that are fitted on, those with the least hashes; latent dimensions; voters of a document.
SAMPLE, DIMENSIONS, NEIGHBOURS = 3_000, 64, 25
#: Cosines are raised to this power for weights; scores from here on predict label 1.
SHARPNESS, THRESHOLD = 8, 0.3
SHAPES, TRIGRAMS, RUNS = 1024, 512, 16
TERMS = SHAPES + TRIGRAMS + 4 * RUNS

# letters become one of two, digits one; other bytes stay
_SHAPE = bytes(0x61 if 0x61 <= c <= 0x7A or c >= 0x80 else 0x41 if 0x41 <= c <= 0x5A else 0x30 if 0x30 <= c <= 0x39 else c for c in range(256))


def _log_bins(x: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(np.log2(x + 1.0) * 2, RUNS - 1).astype(np.int64), minlength=RUNS)


def terms(text: str | None) -> np.ndarray:
    """Term frequencies of a whole text: four groups that each sum to one, or to zero where nothing is there."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(TERMS)
    if not raw:
        return out
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    s = np.frombuffer(raw.translate(_SHAPE), np.uint8).astype(np.uint32)
    if len(b) >= 4:
        h = (s[:-3] * 31 + s[1:-2] * 961 + s[2:-1] * 29791 + s[3:] * 923521) * np.uint32(2654435761)
        out[:SHAPES] = np.bincount(h >> np.uint32(22), minlength=SHAPES)
        h = (b[:-2] * 31 + b[1:-1] * 961 + b[2:] * 29791) * np.uint32(2654435761)
        out[SHAPES : SHAPES + TRIGRAMS] = np.bincount(h >> np.uint32(23), minlength=TRIGRAMS)
    words = raw.lower().split()
    at = SHAPES + TRIGRAMS
    if words:
        place: dict[bytes, int] = {}
        ids = np.fromiter((place.setdefault(w, len(place)) for w in words), np.int64, len(words))
        out[at : at + RUNS] = _log_bins(np.fromiter(map(len, words), np.int64, len(words)))
        # words since the same word came last; the last bin is for new ones
        order = np.argsort(ids, kind="stable")
        again = ids[order][1:] == ids[order][:-1]
        gaps = np.minimum(np.log2(np.diff(order)[again]), RUNS - 2).astype(np.int64)
        out[at + RUNS : at + 2 * RUNS] = np.bincount(gaps, minlength=RUNS)
        out[at + 2 * RUNS - 1] += len(place)
        lines = np.diff(np.concatenate(([-1], np.flatnonzero(b == 10), [len(b)])))
        stops = np.diff(np.concatenate(([-1], np.flatnonzero(b == 46), [len(b)])))
        out[at + 2 * RUNS : at + 3 * RUNS] = _log_bins(lines)
        out[at + 3 * RUNS :] = _log_bins(stops)
    for a, z in ((0, SHAPES), (SHAPES, at), (at, at + RUNS), (at + RUNS, at + 2 * RUNS), (at + 2 * RUNS, at + 3 * RUNS), (at + 3 * RUNS, TERMS)):
        out[a:z] /= max(out[a:z].sum(), 1)
    return np.sqrt(out)


@dataclass
class Model:
    #: weighted term means, and the projection from weighted terms to the latent space
    centre: np.ndarray
    project: np.ndarray
    #: unit vectors and labels of the labelled texts; prior is the score where no neighbour has a say
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def embed(self, texts: list[str | None]) -> np.ndarray:
        x = np.stack([terms(t) for t in texts]).astype(np.float32) if texts else np.zeros((0, TERMS), np.float32)
        z = (x - self.centre) @ self.project
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str | None], block: int = 512) -> list[float]:
        z, out = self.embed(texts), []
        k = min(NEIGHBOURS, len(self.labels))
        if not k:
            return [self.prior] * len(texts)
        for at in range(0, len(z), block):
            cosine = z[at : at + block] @ self.vectors.T
            near = np.argpartition(cosine, -k, axis=1)[:, -k:]
            w = np.maximum(np.take_along_axis(cosine, near, 1), 0.0).astype(np.float64) ** SHARPNESS
            out += ((w * self.labels[near]).sum(1) + 1e-6 * self.prior).__truediv__(w.sum(1) + 1e-6).tolist()
        return [s if t and t.strip() else self.prior for s, t in zip(out, texts)]


def _sampled_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in text_slices(batch.column("text")):
            x = np.stack([terms(t) for t in texts]).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("h").slice(start, len(texts)), batch.column("label").slice(start, len(texts)), pa.array([r.tobytes() for r in x], pa.binary())], names=["h", "label", "x"])


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 5, sample: int = SAMPLE) -> Model:
    """The model of labelled rows whose fold is not 0: at most ``sample`` ids of each class, so the driver gets
    2 * sample rows of TERMS numbers (38 MB), and the broadcast vectors take 2 * sample * DIMENSIONS (1.5 MB).

    An id that several rows have counts once, with the text of the least terms.
    """
    marked = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    marked = marked.where(fold_of("id", folds) != 0).withColumn("h", F.xxhash64(F.col("id").cast("string"), F.lit(11)))
    marked = least_hashed(marked, "label", sample)
    chosen = [marked.where(F.col("label") == k).distinct().orderBy("h", "id").limit(sample) for k in (0, 1)]
    chosen_ids = chosen[0].unionByName(chosen[1])
    rows = docs.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).join(F.broadcast(chosen_ids), F.col("doc") == F.col("id")).select("h", "label", "text")
    got = rows.mapInArrow(_sampled_terms, "h bigint, label int, x binary").groupBy("h", "label").agg(F.min("x").alias("x")).orderBy("h", "label").toArrow()
    return decompose(np.frombuffer(b"".join(got["x"].to_pylist()), np.float32).reshape(-1, TERMS), np.array(got["label"].to_pylist(), np.float64))


def decompose(x: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
    """Weights terms by how much they vary, and keeps the leading latent directions."""
    if not len(x):
        return Model(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), 0.5)
    centre = x.mean(axis=0)
    idf = np.log1p(len(x) / (1 + (x > 0).sum(axis=0))) / np.log1p(len(x))
    weight = (0.2 + idf).astype(np.float32)
    y = (x - centre) * weight
    values, directions = np.linalg.eigh((y.T @ y).astype(np.float64) / len(x))
    keep = np.argsort(values)[::-1][:dimensions]
    # leading directions are damped, so that one of them does not decide every cosine
    project = (weight[:, None] * directions[:, keep] / np.sqrt(np.sqrt(np.maximum(values[keep], 1e-9)))).astype(np.float32)
    m = Model(centre, project, np.zeros((0, 1), np.float32), labels, float(labels.mean()))
    z = (x - centre) @ project
    m.vectors = (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    return m


def classify(docs: DataFrame, labels: DataFrame, model: Model | None = None, doc_id: str = "doc_id", text: str = "text", folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text, in place, without a shuffle.

    Null, empty and blank texts score the share of label 1 in the fitted
    sample; so does everything if no row is labelled. Neighbours with a cosine
    of zero or less have no say. Rows labelled twice differently vote both
    ways. A null id is in fold 0, and joins no label. Repeated rows stay
    repeated; language, source and id have no part in a score.
    """
    held = docs.sparkSession.sparkContext.broadcast(model or fit(docs, labels, doc_id, text, folds=folds))

    @F.arrow_udf("double")
    def scan(col: pa.Array) -> pa.Array:
        out: list[float] = []
        for _, texts in text_slices(col):
            for at in range(0, len(texts), 2048):
                out += held.value.score(texts[at : at + 2048])
        return pa.array(out, pa.float64())

    scored = docs.select(F.col(doc_id).alias("doc_id"), (fold_of(doc_id, folds) == 0).alias("held_out"), scan(F.col(text)).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
