"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features say which hashed n-grams of 4, 6 and 8 characters (A-Z in lower case, blanks as spaces) a text has. A bounded
sample of labelled documents (``sample_rows``) gives each feature's log-count ratio. Every feature whose classes differ by
``least_apart`` standard errors at least, in ``least_texts`` texts at least, takes part, however many these are; a
logistic regression on the scaled features then gives the weights. The model is broadcast: one float per bucket.

Defined cases: a null or empty text scores by the intercept; without both labels in the sample every score is the
sample's share of label 1, or 0 without rows; n-grams count once a text, so repeats and length alone change nothing;
repeated rows are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import id_remainder, labelled_sample, written
from .hashing import BLANK, LOWER, MULTIPLIER, U64, mix

ORDERS, BITS = (4, 6, 8), 20
#: ASCII with A-Z in lower case and blanks as spaces
PLAIN = np.where(BLANK, 32, LOWER)[:128].astype(U64)


def grams(text: str | None) -> np.ndarray:
    """Buckets of the text's n-grams, repeats included."""
    data = np.frombuffer(f" {text or ''} ".encode("utf-32-le"), np.uint32).astype(U64)
    ascii_ = data < 128
    data[ascii_] = PLAIN[data[ascii_]]
    found, code, width = [np.zeros(0, np.int32)], data, 1
    for n in ORDERS:
        if len(data) < n:
            break
        for k in range(width, n):
            code = code[:-1] * MULTIPLIER + data[k:]
        width = n
        found.append((mix(code + U64(n)) >> U64(64 - BITS)).astype(np.int32))
    return np.concatenate(found)


def logit(text: str | None, weights: np.ndarray, intercept: float) -> float:
    buckets = grams(text)
    return intercept + float(weights[np.unique(buckets[weights[buckets] != 0])].sum())


def regress(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, ridge: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of a logistic regression by accelerated gradient steps; ``rows`` hold the features that a text has."""
    owner, flat = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)])
    value = scale[flat]
    w, b = np.zeros(len(scale)), float(np.log(labels.mean() / (1 - labels.mean())))
    mw, vw, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = np.bincount(owner, value * w[flat], len(rows)) + b
        miss = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(rows)
        gw, gb = np.bincount(flat, value * miss[owner], len(w)) + ridge * w, miss.sum()
        mw, vw, mb, vb = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw, 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.05 * np.sqrt(1 - 0.99**t) / (1 - 0.9**t)
        w, b = w - rate * mw / (np.sqrt(vw) + 1e-8), b - rate * mb / (np.sqrt(vb) + 1e-8)
    return w * scale, b


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, least_apart: float = 4.0, least_texts: int = 5, folds: int = 4, held_out: int = 2, ridge: float = 3e-4, steps: int = 150) -> dict:
    sample = labelled_sample(docs, labels, "toxic", folds, held_out, sample_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, n = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                n[int(y > 0)] += 1
                counts[int(y > 0), np.unique(grams(text))] += 1
        some = np.flatnonzero(counts.sum(0))
        buckets = np.append(some, -1).astype(np.int32)  # -1: the texts themselves
        zeros, ones = np.append(counts[0, some], n[0]), np.append(counts[1, some], n[1])
        yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(zeros), pa.array(ones)], ["bucket", "zeros", "ones"])

    found = sample.mapInArrow(count, "bucket int, zeros long, ones long").groupBy("bucket").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"))
    found = written(found, "toxicity-counts")
    n0, n1 = (found.where("bucket < 0").select("zeros", "ones").first() or (0, 0))
    weights = np.zeros(1 << BITS, np.float32)
    if not n0 or not n1:
        share = n1 / (n0 + n1) if n0 + n1 else 0.0
        return {"weights": weights, "intercept": float(np.log(max(share, 1e-9) / max(1 - share, 1e-9)))}
    p0, p1 = (F.col("zeros") + 1) / (n0 + 2), (F.col("ones") + 1) / (n1 + 2)
    apart = F.abs(p1 - p0) / F.sqrt(p0 * (1 - p0) / n0 + p1 * (1 - p1) / n1)  # of the classes, in standard errors
    usual = found.where((F.col("bucket") >= 0) & (F.col("zeros") + F.col("ones") >= least_texts))
    best = sorted(usual.where(apart >= least_apart).select("bucket", F.log(p1 / p0).alias("ratio")).collect())
    chosen, ratio = np.array([r.bucket for r in best], np.int32), np.array([r.ratio for r in best], np.float64)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                at = place[grams(text)]
                rows.append(np.unique(at[at >= 0]).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column("label")], ["features", "label"])

    rows = sorted((bytes(f), y) for f, y in sample.mapInArrow(extract, "features binary, label int").collect())
    w, b = regress([np.frombuffer(f, np.int32).astype(np.int64) for f, _ in rows], np.array([float(y > 0) for _, y in rows]), ratio, ridge, steps)
    weights[chosen] = w
    return {"weights": weights, "intercept": b}


def score(docs: DataFrame, model: dict, carry: tuple[str, ...] = ("doc_id",), inside: str | None = None) -> DataFrame:
    """The columns ``carry`` and score of every document; ``inside``: the one of them, a struct, that has the text, which then is moved once."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([docs.schema[c] for c in carry]).add("_score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(inside).field("text") if inside else part.column("_text")
                z = np.array([logit(t.as_py(), **shared.value) for t in texts], np.float64)
                scores = pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))), pa.float64())
                yield pa.RecordBatch.from_arrays([*map(part.column, range(len(carry))), scores], [*carry, "_score"])

    read = docs.select(*[F.col(f"`{c}`") for c in carry], *([] if inside else [F.col("text").alias("_text")]))
    return read.mapInArrow(run, schema).withColumn("score", F.col("_score")).drop("_score")


def judged(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; no label of the held-out fold is read."""
    scored = score(docs, train(docs, labels, folds=folds, held_out=held_out, **options))
    return scored.select("doc_id", (id_remainder(F.col("doc_id"), folds) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
