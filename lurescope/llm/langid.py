"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of three consecutive letters is the
product of the first one's vector rotated twice, the second one's rotated once and the third
one's. A text's vector is the sum over its trigrams (one blank stands for anything between
words), a language's prototype the sum of its unit-length document vectors less the mean over
languages. The language is the one with the largest cosine.

Defined cases: a null text, or one without letters, is ``und`` with score 0. Ties go to the
language that sorts first. Without any labelled row every text is ``und``. Score is the softmax of the
cosines, the chosen language's share. Repeated rows get equal results; ids may be null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the labelled rows per language that prototypes are learnt from.
ROWS_PER_LANGUAGE = 4_000
DIMENSIONS = 1024
SHARES = 32
LETTERS = 256  # codes; letters beyond share codes by a hash
SHARPNESS = 30.0


def letter_vectors(dimensions: int = DIMENSIONS) -> np.ndarray:
    draw = np.random.default_rng(20_240_229)
    return (draw.integers(0, 2, (LETTERS, dimensions), dtype=np.int8) * 2 - 1).astype(np.int8)


def trigram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams (three letter codes packed into one number) and their counts."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = ((points >= 97) & (points <= 122)) | (points >= 0xAA)
    rare = np.flatnonzero(letter & (points >= 0xAA))
    if len(rare):
        distinct, inverse = np.unique(points[rare], return_inverse=True)
        letter[rare] = np.array([chr(p).isalpha() if not 0xD800 <= p < 0xE000 else False for p in distinct], dtype=bool)[inverse]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0)
    code = np.where(letter, np.where(points < 128, points - 96, 32 + (points * np.uint32(2654435761) >> np.uint32(8)) % np.uint32(LETTERS - 32)), 0).astype(np.int64)
    code = np.concatenate(([0], code, [0]))
    code = code[np.concatenate(([True], (code[1:] != 0) | (code[:-1] != 0)))]
    gram = (code[:-2] << 16) | (code[1:-1] << 8) | code[2:] if len(code) > 2 else np.zeros(0, np.int64)
    return np.unique(gram, return_counts=True)


class Encoder:
    """Bundles a text's trigram vectors; rotated letter vectors are made once."""

    def __init__(self, dimensions: int = DIMENSIONS):
        letters = letter_vectors(dimensions)
        self.third, self.second, self.first = letters, np.roll(letters, 1, axis=1), np.roll(letters, 2, axis=1)
        self.dimensions = dimensions

    def vector(self, text: str | None) -> np.ndarray | None:
        """Unit-length vector, or None without letters."""
        gram, count = trigram_counts(text)
        if not len(gram):
            return None
        total = np.zeros(self.dimensions, dtype=np.float32)
        for at in range(0, len(gram), 4096):
            g = gram[at : at + 4096]
            bound = self.first[g >> 16] * self.second[(g >> 8) & 255] * self.third[g & 255]
            total += count[at : at + 4096].astype(np.float32) @ bound.astype(np.float32)
        return total / max(float(np.linalg.norm(total)), 1e-9)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    centre: np.ndarray
    prototypes: np.ndarray  # unit rows, by language

    def predict(self, vector: np.ndarray | None) -> tuple[str, float]:
        if vector is None or not self.languages:
            return "und", 0.0
        moved = vector - self.centre
        cosine = self.prototypes @ moved / max(float(np.linalg.norm(moved)), 1e-9)
        share = np.exp(SHARPNESS / 6 * (cosine - cosine.max()))
        best = int(np.argmax(cosine))
        return self.languages[best], float(share[best] / share.sum())


def train_languages(documents: DataFrame, learn_from: Column, rows_per_language: int = ROWS_PER_LANGUAGE, dimensions: int = DIMENSIONS) -> LanguageModel:
    """Prototypes from a bounded, hash-drawn sample of labelled rows per language.

    Tasks send one partial sum per language; the driver adds at most (languages x tasks) rows.
    """
    labelled = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & learn_from)
    known = labelled.select("doc_id", "lang", F.xxhash64(F.lit(3), "doc_id").alias("draw"))
    # Dealt over shares of the draw, so that a frequent language isn't ranked in one task.
    share = F.pmod("draw", F.lit(SHARES))
    ranked = known.withColumn("rank", F.row_number().over(Window.partitionBy("lang", share).orderBy("draw")))
    chosen = ranked.where(F.col("rank") <= max(1, rows_per_language // SHARES)).select("doc_id", "lang").distinct()
    # The draw is bounded by rows_per_language a language; texts are fetched for it alone.
    sample = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), ["doc_id", "lang"]).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(dimensions), {}
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                v = encoder.vector(text)
                if v is not None:
                    total, n = sums.get(lang, (np.zeros(dimensions), 0))
                    sums[lang] = (total + v, n + 1)
        if sums:
            yield pa.record_batch(
                [pa.array(list(sums)), pa.array([n for _, n in sums.values()], pa.int64()), pa.array([t.tobytes() for t, _ in sums.values()], pa.binary())],
                ["lang", "n", "total"],
            )

    means: dict[str, tuple[np.ndarray, int]] = {}
    for r in sample.mapInArrow(run, "lang string, n bigint, total binary").collect():
        total, n = means.get(r["lang"], (np.zeros(dimensions), 0))
        means[r["lang"]] = (total + np.frombuffer(r["total"]), n + r["n"])
    languages = sorted(means)
    if not languages:
        return LanguageModel([], np.zeros(dimensions), np.zeros((0, dimensions)))
    rows = np.array([means[x][0] / means[x][1] for x in languages])
    centre = rows.mean(axis=0) if len(rows) > 1 else np.zeros(dimensions)
    moved = rows - centre
    return LanguageModel(languages, centre.astype(np.float32), (moved / np.maximum(np.linalg.norm(moved, axis=1, keepdims=True), 1e-9)).astype(np.float32))


def predict_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` of every document; only the text is read for it."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        encoder = Encoder(m.prototypes.shape[1])
        for batch in batches:
            found = [m.predict(encoder.vector(t.as_py())) for t in batch.column("text")]
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double")
