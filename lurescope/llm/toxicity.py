"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Words are runs of letters, lower-cased (A to Z). Features of a text: its distinct words, their
beginnings of five bytes (words of six bytes and more), word pairs and pairs with one word
between, hashed into ``2**bits`` buckets; each counts once. Per-coordinate learning rates suit
rare features and the L1 term leaves most weights at zero, so the model is a short list of
(bucket, weight), bounded by ``2**bits`` whatever the corpus, and travels as a broadcast.

Defined cases: a null or empty text or one without letters has no feature and gets the
calibrated bias. Null ids are scored but never learnt from. Without labelled rows of both
classes every text gets the share of positive labels (0.5 without any). Repeated rows get
equal scores. Extra columns stay unless they clash with the output's names, which win.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lurescope.llm.handback import giving_back
from lurescope.llm.linear import collect_sparse, labelled_sample, platt, sigmoid
from lurescope.llm.textblocks import _LOWER, Block, blocks, mixed, ngrams, words

#: Bound of the labelled sample, per class.
ROWS_PER_CLASS = 4_000
BITS = 20
PREFIX_BYTES = 5


def toxicity_features(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, 1.0) for each distinct feature of each text."""
    w = words(block, letters=True, lower=True)
    long = w.end - w.start > PREFIX_BYTES
    start = w.start[long]
    packed = np.zeros(len(start), dtype=np.uint64)
    lower = _LOWER[block.data]
    for k in range(PREFIX_BYTES):
        packed = (packed << np.uint64(8)) | lower[start + k]
    grams = [(w.hash, w.text), (mixed(packed ^ np.uint64(0x5DEECE66D1234567)), w.text[long]), ngrams(w, (0, 1)), ngrams(w, (0, 2))]
    text = np.concatenate([t for _, t in grams])
    bucket = (np.concatenate([h for h, _ in grams]) >> np.uint64(64 - bits)).astype(np.int64)
    key = np.unique((text << 32) | bucket)
    return key >> 32, key & 0xFFFFFFFF, np.ones(len(key))


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    buckets: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def table(self) -> np.ndarray:
        dense = np.zeros(1 << self.bits)
        dense[self.buckets] = self.weights
        return dense


def ftrl(
    rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, passes: int = 4
) -> tuple[np.ndarray, float]:
    """Weights and bias after ``passes`` passes of FTRL-proximal, row by row in the given order."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(passes):
        for y, idx, _ in rows:
            zi, ni = z[idx], n[idx]
            wi = weight(zi, ni)
            wb = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            g = float(sigmoid(wi.sum() + wb)) - y
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[idx] = zi + g - sigma * wi
            n[idx] = ni + g * g
            sigma_b = (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha
            bias_z += g - sigma_b * wb
            bias_n += g * g
    return weight(z, n), -bias_z / ((beta + np.sqrt(bias_n)) / alpha)


def train_toxicity(documents: DataFrame, labels: DataFrame, learn_from: Column, rows_per_class: int = ROWS_PER_CLASS, bits: int = BITS) -> ToxicityModel:
    """Fit on a bounded sample of rows for which ``learn_from`` (over doc_id) holds.

    A tenth of the sample is kept from fitting and sets the calibration.
    """
    sample = labelled_sample(documents, labels, "toxic", rows_per_class, learn_from)
    rows = collect_sparse(sample, toxicity_features if bits == BITS else lambda b: toxicity_features(b, bits), weighted=False)
    share = float(np.mean([r[0] for r in rows])) if rows else 0.5
    if not rows or share in (0.0, 1.0):
        flat = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return ToxicityModel(bits, np.zeros(0, np.int64), np.zeros(0), flat, 1.0, 0.0)
    fit, kept = [r for i, r in enumerate(rows) if i % 10], [r for i, r in enumerate(rows) if i % 10 == 0]
    weights, bias = ftrl(fit, bits)
    z = np.array([weights[idx].sum() + bias for _, idx, _ in kept])
    slope, offset = platt(z, np.array([float(r[0]) for r in kept]))
    used = np.flatnonzero(weights)
    return ToxicityModel(bits, used, weights[used], bias, slope, offset)


def _scorer(model: ToxicityModel, dense: list[np.ndarray], texts: pa.Array, n: int) -> np.ndarray:
    """Scores of ``n`` texts; ``dense`` keeps the unpacked weights between batches."""
    if not dense:
        dense.append(model.table())
    scores = np.zeros(n)
    for block in blocks(texts):
        text, bucket, _ = toxicity_features(block, model.bits)
        z = np.bincount(text, weights=dense[0][bucket], minlength=block.count) + model.bias
        scores[block.first : block.first + block.count] = sigmoid(model.slope * z + model.offset)
    return scores


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """``documents`` with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    base = documents.drop("score", "predicted")
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: list[np.ndarray] = []
        for batch in batches:
            scores = _scorer(shared.value, dense, batch.column("text"), batch.num_rows)
            yield pa.record_batch([*batch.columns, pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    return base.mapInArrow(run, StructType([*base.schema.fields, StructField("score", DoubleType()), StructField("predicted", IntegerType())]))


def reject_toxic(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents scored under 0.5, with all their own columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense: list[np.ndarray] = []
        for batch in batches:
            yield batch.filter(pa.array(_scorer(shared.value, dense, batch.column("text"), batch.num_rows) < 0.5))

    return documents.mapInArrow(giving_back(run), documents.schema)
