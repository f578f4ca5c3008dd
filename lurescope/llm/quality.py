"""Quality rules: base rules, then a calibrated logistic regression over hashed n-grams.

Features are the shares of hashed words, word pairs and byte 3- and 4-grams in a text; a text's
score is the mean weight of its n-grams, so it does not grow with the text. The model is fitted
on a bounded sample of labelled rows, calibrated on a part kept from fitting, and applied in
Arrow batches against fixed thresholds.

Defined cases: a null or empty text has no words and fails the base rules (fewer than 50 words).
Without labelled rows of both classes the model passes everything. Repeated rows get equal
results. Extra columns are ignored by the query; the operator returns one row per input row
with its ``doc_id``, null ids included. Line and 3-word repeats are found by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.llm.linear import collect_sparse, labelled_sample, platt, sigmoid
from lurescope.llm.textblocks import Block, Words, blocks, byte_grams, ngrams, words

#: Bound of the labelled sample, per class.
ROWS_PER_CLASS = 1_500
BITS = 18
MIN_WORDS = 50
KEEP_FROM = 0.5

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _grams(block: Block, w: Words, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every n-gram occurrence, kind by kind."""
    shift = np.uint64(64 - bits)
    yield w.text, (w.hash >> shift).astype(np.int64)
    pairs, text = ngrams(w, (0, 1))
    yield text, (pairs >> shift).astype(np.int64)
    text_of = np.repeat(np.arange(block.count), np.diff(block.starts))
    for n in (3, 4):
        grams = byte_grams(block.data, n)
        inside = text_of[: len(grams)] == text_of[n - 1 : n - 1 + len(grams)]
        yield text_of[: len(grams)][inside], (grams[inside] >> shift).astype(np.int64)


def quality_features(block: Block, bits: int = BITS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, share within its kind of n-gram)."""
    parts = []
    for text, bucket in _grams(block, words(block), bits):
        total = np.bincount(text, minlength=block.count)
        parts.append((text, bucket, 1.0 / total[text]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def base_counts(block: Block, w: Words) -> dict[str, np.ndarray]:
    """The contract's counts per text of a block."""
    n = block.count
    text_of = lambda at: np.searchsorted(block.starts, at, side="right") - 1
    first_bytes = (block.data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(first_bytes)))
    chars = points[w.end] - points[w.start]
    return {
        "n_words": np.diff(w.first_word),
        "word_chars": np.bincount(w.text, weights=chars, minlength=n).astype(np.int64),
        "n_symbols": np.bincount(text_of(np.flatnonzero(_SYMBOL[block.data])), minlength=n),
        "n_dup_lines": _repeated_lines(block, w),
        "n_repeat_words": _repeated_words(w, n),
    }


def _repeated_lines(block: Block, w: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    ends = np.union1d(np.flatnonzero(block.data == 10), block.starts[1:] - 1)
    starts = np.concatenate(([0], ends[:-1] + 1))
    with_word = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends = starts[with_word], ends[with_word]
    if not len(starts):
        return np.zeros(block.count, dtype=np.int64)
    text = np.searchsorted(block.starts, starts, side="right") - 1
    raw = block.data.tobytes()
    seen: set[tuple[int, bytes]] = set()
    again = np.zeros(len(starts), dtype=bool)
    for i, key in enumerate(zip(text.tolist(), (raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), strict=True)):
        if key in seen:
            again[i] = True
        else:
            seen.add(key)
    return np.bincount(text[again], minlength=block.count)


def _repeated_words(w: Words, n: int) -> np.ndarray:
    """Words inside a 3-word window that occurs twice or more in its text."""
    size = len(w.hash) - 2
    if size <= 0:
        return np.zeros(n, dtype=np.int64)
    at = np.flatnonzero(w.text[:size] == w.text[2:])
    grams, text = ngrams(w, (0, 1, 2))
    order = np.lexsort((grams, text))
    g, t = grams[order], text[order]
    same = (g[1:] == g[:-1]) & (t[1:] == t[:-1])
    many = np.zeros(len(g), dtype=bool)
    many[1:] |= same
    many[:-1] |= same
    hit = np.zeros(len(w.hash) + 1, dtype=np.int64)
    starts = at[order[many]]
    np.add.at(hit, starts, 1)
    np.add.at(hit, starts + 3, -1)
    covered = np.cumsum(hit)[:-1] > 0
    return np.bincount(w.text[covered], minlength=n)


@dataclass(frozen=True)
class QualityModel:
    bits: int
    weights: np.ndarray
    slope: float
    offset: float


def fit_logistic(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int, steps: int = 120, rate: float = 0.3, l2: float = 1e-6) -> np.ndarray:
    """Full-batch Adam over sparse rows; classes weigh the same."""
    y = np.array([float(r[0]) for r in rows])
    idx = np.concatenate([r[1] for r in rows]).astype(np.int64)
    val = np.concatenate([r[2] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    used, idx = np.unique(idx, return_inverse=True)
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    x, m, v = np.zeros(len(used)), np.zeros(len(used)), np.zeros(len(used))
    for t in range(1, steps + 1):
        r = weight * (sigmoid(np.bincount(row, val * x[idx], minlength=len(y))) - y)
        g = np.bincount(idx, val * r[row], minlength=len(used)) + l2 * x
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    full = np.zeros(1 << bits)
    full[used] = x
    return full


def train_quality(documents: DataFrame, labels: DataFrame, learn_from: Column | None = None, rows_per_class: int = ROWS_PER_CLASS, bits: int = BITS) -> QualityModel:
    sample = labelled_sample(documents, labels, "quality", rows_per_class, F.lit(True) if learn_from is None else learn_from)
    rows = collect_sparse(sample, quality_features if bits == BITS else lambda b: quality_features(b, bits))
    if len({r[0] for r in rows}) < 2:
        return QualityModel(bits, np.zeros(1 << bits), 1.0, 1.0)
    fit, kept = [r for i, r in enumerate(rows) if i % 5], [r for i, r in enumerate(rows) if i % 5 == 0]
    weights = fit_logistic(fit, bits)
    z = np.array([(weights[idx] * val).sum() for _, idx, val in kept])
    slope, offset = platt(z, np.array([float(r[0]) for r in kept]))
    return QualityModel(bits, weights, slope, offset)


def score_quality(documents: DataFrame, model: QualityModel, keep_from: float = KEEP_FROM) -> DataFrame:
    """Counts, base rules, quality probability and verdict of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for block in blocks(batch.column("text")):
                w = words(block)
                counts = base_counts(block, w)
                z = np.zeros(block.count)
                for text, bucket in _grams(block, w, m.bits):
                    total = np.bincount(text, minlength=block.count)
                    z += np.bincount(text, m.weights[bucket], minlength=block.count) / np.maximum(total, 1)
                quality = sigmoid(m.slope * z + m.offset)
                failed = (counts["n_words"] < MIN_WORDS) | (100 * counts["n_repeat_words"] > 50 * counts["n_words"])
                yield pa.record_batch(
                    [
                        batch.column("doc_id").slice(block.first, block.count),
                        *[pa.array(np.asarray(x, dtype=np.int64)) for x in counts.values()],
                        pa.array(failed),
                        pa.array(quality),
                        pa.array(~failed & (quality >= keep_from)),
                    ],
                    ["doc_id", *counts, "base_failed", "quality", "kept"],
                )

    schema = (
        "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
        "n_repeat_words bigint, base_failed boolean, quality double, kept boolean"
    )
    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, schema)
