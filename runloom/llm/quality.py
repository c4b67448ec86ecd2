"""Quality classifier by positive-unlabelled learning.

A small network is fitted to trusted positives and unlabelled web text by the
non-negative unbiased risk: the risk of the unlabelled rows as negatives, less the
share that hidden positives contribute, never below zero.  The class prior is
estimated from the labelled rows of the training folds.

Text enters as shares only: bytes, pairs of character classes, repeated words and
lines, word lengths.  They are sums over the whole text, so texts of any length cost
their length.

The fit uses bounded samples (POSITIVES, UNLABELLED and CALIBRATION rows, the first by
a hash of the id); scoring covers every row.

Defined results: a null text is scored like an empty one; without any trusted positive
every score is the prior; an empty table gives no rows; rows repeat as they come;
labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runloom.llm.arrays import chunks, span_hashes, words

POSITIVES = 4000
UNLABELLED = 8000
CALIBRATION = 4000
FOLDS, HELD_OUT = 4, 2
ACCEPT = 0.7
_KINDS = 8
_CLASS = np.full(256, 7, np.uint8)
_CLASS[128:] = 6
_CLASS[[0x20, 0x09, 0x0D]] = 0
_CLASS[0x0A] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[0x41:0x5B] = 3
_CLASS[0x61:0x7B] = 4
_CLASS[[0x2E, 0x2C, 0x3B, 0x3A, 0x27, 0x2D]] = 5


def features(column: pa.Array) -> np.ndarray:
    """One row of shares per text."""
    out = []
    for a, b, flat, offsets in chunks(column):
        n, length = b - a, np.maximum(np.diff(offsets), 1)[:, None]
        row = np.repeat(np.arange(n), np.diff(offsets))
        byte = np.bincount(row * 256 + flat, minlength=n * 256).reshape(n, 256) / length
        kind = _CLASS[flat].astype(np.int64)
        inside = row[1:] == row[:-1]
        pair = row[1:] * _KINDS**2 + kind[:-1] * _KINDS + kind[1:]
        pair = np.bincount(pair[inside], minlength=n * _KINDS**2).reshape(n, _KINDS**2) / length
        start, end, first = words(flat, offsets)
        count = np.diff(first)
        word_row = np.repeat(np.arange(n), count)
        key = span_hashes(flat, start, end)
        per = np.maximum(count, 1)
        again = np.zeros(n)
        for lag in range(1, 9):
            same = (key[lag:] == key[:-lag]) & (word_row[lag:] == word_row[:-lag])
            again = np.maximum(again, np.bincount(word_row[lag:][same], minlength=n) / per)
        adjacent = (key[1:] == key[:-1]) & (word_row[1:] == word_row[:-1])
        adjacent = np.bincount(word_row[1:][adjacent], minlength=n) / per
        mean = np.bincount(word_row, end - start, minlength=n) / per
        rest = np.stack([again, adjacent, mean / 10, np.log1p(count) / 10, np.log1p(length[:, 0]) / 10], 1)
        out.append(np.concatenate([np.sqrt(byte), np.sqrt(pair), rest], 1).astype(np.float32))
    return np.concatenate(out) if out else np.zeros((0, 256 + _KINDS**2 + 5), np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    prior: float
    slope: float = 1.0
    shift: float = 0.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), np.log(self.prior / (1 - self.prior)))
        return _forward(self.layers, (x - self.mean) / self.scale)[-1][:, 0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -40, 40)))


def _forward(layers: list[np.ndarray], x: np.ndarray) -> list[np.ndarray]:
    """Outputs of all layers; the last column of a weight matrix's input is constant."""
    out = [x]
    for k, w in enumerate(layers):
        x = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1) @ w
        if k + 1 < len(layers):
            x = np.maximum(x, 0)
        out.append(x)
    return out


def fit_nnpu(
    positive: np.ndarray, unlabelled: np.ndarray, prior: float, hidden: int = 32, epochs: int = 30, rate: float = 0.003, seed: int = 7
) -> Model:
    """Minimise prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)) with the sigmoid loss,
    by Adam on mini-batches.  Where the bracket is negative, its gradient is reversed."""
    if not len(positive) or not len(unlabelled):
        return Model(np.zeros(1), np.ones(1), [], prior)
    rng = np.random.default_rng(seed)
    both = np.concatenate([positive, unlabelled]).astype(np.float64)
    mean, scale = both.mean(0), both.std(0) + 1e-3
    p, u = (positive - mean) / scale, (unlabelled - mean) / scale
    layers = [rng.normal(0, np.sqrt(2 / p.shape[1]), (p.shape[1] + 1, hidden)), rng.normal(0, 0.1, (hidden + 1, 1))]
    m, v = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers]
    step = 0
    batches = max(1, len(u) // 400)
    for _ in range(epochs):
        for pi, ui in zip(np.array_split(rng.permutation(len(p)), batches), np.array_split(rng.permutation(len(u)), batches)):
            if not len(pi) or not len(ui):
                continue
            step += 1
            x = np.concatenate([p[pi], u[ui]])
            outs = _forward(layers, x)
            z = np.clip(outs[-1][:, 0], -30, 30)
            s = 1 / (1 + np.exp(-z))
            d = s * (1 - s)
            is_p = np.arange(len(x)) < len(pi)
            negative = s[~is_p].mean() - prior * s[is_p].mean()
            grad_negative = np.where(is_p, -prior * d / len(pi), d / len(ui))
            grad = grad_negative + np.where(is_p, -prior * d / len(pi), 0) if negative >= 0 else -grad_negative
            back = grad[:, None]
            for k in (1, 0):
                inputs = np.concatenate([outs[k], np.ones((len(x), 1))], 1)
                g = inputs.T @ back + 1e-4 * layers[k]
                if k:
                    back = (back @ layers[k][:-1].T) * (outs[k] > 0)
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                layers[k] = layers[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Model(mean, scale, layers, prior)


def calibrate(model: Model, x: np.ndarray, y: np.ndarray, accept: float = ACCEPT) -> Model:
    """Put the margin that parts the labelled rows best at the score ``accept``."""
    if not model.layers or not len(y) or y.min() == y.max():
        return model
    margin = model.margin(x)
    order = np.argsort(margin)
    below_positive = np.concatenate([[0], np.cumsum(y[order])])
    above_negative = (1 - y).sum() - np.concatenate([[0], np.cumsum(1 - y[order])])
    wrong = below_positive + above_negative
    best = np.flatnonzero(wrong == wrong.min())
    edges = np.concatenate([[margin[order[0]] - 1], margin[order], [margin[order[-1]] + 1]])
    cut = np.mean([(edges[k] + edges[k + 1]) / 2 for k in best])
    model.slope = 1 / max(0.1, np.abs(margin - cut).mean() / 2)
    model.shift = np.log(accept / (1 - accept)) - model.slope * cut
    return model


def _collected(docs: DataFrame, ids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Features and tags of a bounded list of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r.tobytes() for r in features(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["x", "tag"])

    # the list is bounded by its limits, so a broadcast is safe
    picked = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "tag")
    rows = picked.mapInArrow(run, "x binary, tag int").collect()
    if not rows:
        return features(pa.array([], pa.string())), np.zeros(0, int)
    return np.stack([np.frombuffer(r.x, np.float32) for r in rows]), np.array([r.tag for r in rows])


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, calibration: int = CALIBRATION) -> Model:
    """Fit to the rows outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string")) % FOLDS
    order = F.xxhash64("doc_id", F.lit(1))
    known = labels.where((fold != HELD_OUT) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    share = known.agg(F.avg("quality")).first()[0]
    prior = min(0.99, max(0.01, share if share is not None else 0.5))

    def first(rows: DataFrame, n: int, tag: int) -> DataFrame:
        return rows.orderBy(order, "doc_id").limit(n).select("doc_id", F.lit(tag).alias("tag"))

    ids = (
        first(known.where("quality = 1"), positives, 0)
        .unionByName(first(docs.where(fold != HELD_OUT).select("doc_id").distinct(), unlabelled, 1))
        .unionByName(known.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id").limit(calibration).select("doc_id", (F.col("quality") + 2).alias("tag")))
    )
    x, tag = _collected(docs, ids)
    if not len(x):
        return Model(np.zeros(1), np.ones(1), [], prior)
    model = fit_nnpu(x[tag == 0], x[tag == 1], prior)
    return calibrate(model, x[tag >= 2], tag[tag >= 2] - 2)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with quality_score, every row by its whole text."""
    names = [c for c in docs.columns if c != "quality_score"]
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(features(batch.column(at)).astype(np.float64))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], names=[*names, "quality_score"])

    schema = docs.select(*names).schema.add("quality_score", "double")
    return docs.select(*names).mapInArrow(run, schema)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels))

    return scored.select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_OUT).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= ACCEPT).cast("int").alias("predicted"),
    )
