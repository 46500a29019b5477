"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A document's features are hashed words and hashed word shapes (runs of letters, capitals and digits as one sign each,
other signs as they are), weighted by log counts and inverse document frequency. A truncated singular value
decomposition of a bounded sample of labelled documents (``sample_rows``) gives the latent space; the sample's vectors
are broadcast (sample_rows x ``dims`` numbers), and every document is multiplied with all of them, a block at a time. The
score is the similarity-weighted share of label 1 among the ``neighbours`` nearest. Features, space and vectors are whole
numbers (in steps of 1/STEPS), so products are exact sums, the same in whatever block a document stands: equal texts
have equal scores.

Defined cases: a null or empty text, or one unlike any labelled text, scores the sample's share of label 1; without
labelled rows every score is 0.5; among neighbours of equal likeness the earlier in the sample (in order of features) counts; repeated rows are scored each; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_remainder, labelled_sample
from .hashing import LOWER, run_hashes

WORDS, SHAPES = 1024, 1024
#: of features, of the space, of vectors: sums of products stay far below 2**53
STEPS, SPACE_STEPS, VECTOR_STEPS = 64, 1 << 12, 1 << 12
SCHEMA = "doc_id long, score double"
#: a for lower-case letters and letters beyond ASCII, A for capitals, 0 for digits; the rest stays
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123] = 97
SHAPE[128:] = 97
SHAPE[65:91] = 65
SHAPE[48:58] = 48


def features(text: str | None) -> np.ndarray:
    """Log counts of hashed words and of hashed shapes, WORDS + SHAPES whole numbers in steps of 1/STEPS."""
    data = np.frombuffer((text or "").encode(), np.uint8)
    shape = SHAPE[data]
    if len(shape):
        shape = shape[np.append(True, shape[1:] != shape[:-1])]
    words, shapes = run_hashes(LOWER[data]), run_hashes(shape)
    counts = np.concatenate([
        np.bincount((words % np.uint64(WORDS)).astype(np.int64), minlength=WORDS),
        np.bincount((shapes % np.uint64(SHAPES)).astype(np.int64), minlength=SHAPES),
    ])
    return np.rint(STEPS * np.log1p(counts))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def fit(rows: list[tuple[bytes, int]], dims: int) -> dict:
    """The latent space and the labelled vectors in it."""
    if not rows:
        return {"labels": np.zeros(0), "prior": 0.5}
    x = np.stack([np.frombuffer(f, np.int16) for f, _ in rows]).astype(np.float32)
    labels = np.array([y for _, y in rows], np.float32)
    idf = np.log((1 + len(x)) / (1 + (x > 0).sum(0))).astype(np.float32) + 1
    weighted = unit(x * idf)
    _, vectors = np.linalg.eigh(weighted.T @ weighted)
    space = np.rint(SPACE_STEPS * idf[:, None] * vectors[:, ::-1][:, :dims]).astype(np.float64)
    return {"space": space, "vectors": latent(x.astype(np.float64), space), "labels": labels, "prior": float(labels.mean())}


def latent(x: np.ndarray, space: np.ndarray) -> np.ndarray:
    """Unit vectors of features in the latent space, in whole steps of 1/VECTOR_STEPS."""
    return np.rint(VECTOR_STEPS * unit(x @ space))


def vote(x: np.ndarray, model: dict, neighbours: int) -> np.ndarray:
    """Scores of the rows of ``x`` (features)."""
    labels, k = model["labels"], min(neighbours, len(model["labels"]))
    if not k:
        return np.full(len(x), model["prior"])
    likeness = latent(x, model["space"]) @ model["vectors"].T
    rank = np.arange(len(labels)) - likeness * len(labels)  # whole numbers, no two equal
    best = np.sort(np.argpartition(rank, k - 1, axis=1)[:, :k], axis=1)
    weight = np.clip(np.take_along_axis(likeness, best, 1) / VECTOR_STEPS**2, 0, None) ** 4
    total = weight.sum(1)
    return np.clip(np.where(total > 1e-9, (weight * labels[best]).sum(1) / np.maximum(total, 1e-9), model["prior"]), 0, 1)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, dims: int = 48, folds: int = 5, held_out: int = 0) -> dict:
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t).astype(np.int16).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("label")], ["features", "label"])

    sample = labelled_sample(docs, labels, "quality", folds, held_out, sample_rows)
    rows = sample.mapInArrow(extract, "features binary, label int").collect()
    return fit(sorted((bytes(f), y) for f, y in rows), dims)


def score(docs: DataFrame, model: dict, neighbours: int = 15, block: int = 256) -> DataFrame:
    """doc_id and score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                x = np.stack([features(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(vote(x, shared.value, neighbours), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def judged(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; no label of the held-out fold is read."""
    scored = score(docs, train(docs, labels, folds=folds, held_out=held_out, **options))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
