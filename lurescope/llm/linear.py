"""Hashed sparse rows for the linear text classifiers, and a bounded labelled sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescope.llm.textblocks import Block, blocks

#: For a block: (text index, bucket, weight) of every feature occurrence; repeats are summed.
Features = Callable[[Block], tuple[np.ndarray, np.ndarray, np.ndarray]]

SHARES = 32


def held_out(doc_id: Column) -> Column:
    """crc32 of the id's digits is a multiple of five."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, rows_per_class: int, learn_from: Column) -> DataFrame:
    """``(sample_id, text, label)`` of about ``rows_per_class`` rows per label at most, chosen by a hash of the id.

    Null labels and null ids take no part. An id labelled more than once counts once if its
    labels agree and not at all otherwise. Repeated documents of an id are all candidates.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
        .where(learn_from)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("other"))
        .where("label = other")
        .select("doc_id", "label", F.xxhash64(F.lit(17), "doc_id").alias("draw"))
    )
    # Dealt over shares of the draw, so that a frequent label isn't ranked in one task.
    rank = F.row_number().over(Window.partitionBy("label", F.pmod("draw", F.lit(SHARES))).orderBy("draw", "doc_id"))
    chosen = known.withColumn("rank", rank).where(F.col("rank") <= max(1, rows_per_class // SHARES))
    return (
        documents.select("doc_id", "text")
        .join(F.broadcast(chosen.select("doc_id", "label", "draw")), "doc_id")
        .select(F.col("draw").alias("sample_id"), "text", "label")
    )


def sparse_rows(features: Features) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A ``mapInArrow`` function: the sample's rows as packed buckets and weights."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, label = batch.column("sample_id"), batch.column("label")
            for block in blocks(batch.column("text")):
                text, bucket, weight = features(block)
                key = (text.astype(np.int64) << 32) | bucket
                unique, inverse = np.unique(key, return_inverse=True)
                total = np.bincount(inverse, weights=weight, minlength=len(unique)).astype(np.float32)
                cut = np.searchsorted(unique, np.arange(block.count + 1, dtype=np.int64) << 32)
                buckets = (unique & 0xFFFFFFFF).astype(np.uint32)
                yield pa.record_batch(
                    [
                        ids.slice(block.first, block.count),
                        label.slice(block.first, block.count),
                        pa.array([buckets[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                        pa.array([total[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    ],
                    ["sample_id", "label", "buckets", "weights"],
                )

    return run


SPARSE_SCHEMA = "sample_id bigint, label int, buckets binary, weights binary"


def collect_sparse(sample: DataFrame, features: Features, weighted: bool = True) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """The bounded sample's rows (label, buckets, weights) on the driver, in the order of the sample's hash.

    Without ``weighted`` every feature counts once and weights are left out.
    """
    packed = sample.mapInArrow(sparse_rows(features), SPARSE_SCHEMA)
    rows = (packed if weighted else packed.withColumn("weights", F.lit(b""))).toArrow()
    label, draw = rows.column("label").to_pylist(), rows.column("sample_id").to_pylist()
    found = [
        (y, np.frombuffer(b.as_py(), np.uint32), np.frombuffer(w.as_py(), np.float32))
        for y, b, w in zip(label, rows.column("buckets"), rows.column("weights"), strict=True)
    ]
    return [found[i] for i in sorted(range(len(found)), key=lambda i: (draw[i], label[i], found[i][1].tobytes()[:64]))]


def sigmoid(z: np.ndarray | float) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, with smoothed targets (Platt 1999).

    Without both classes: slope 1, offset 0. A negative slope would turn the ranking round and is not used.
    """
    pos, neg = float(y.sum()), float((1 - y).sum())
    if not pos or not neg:
        return 1.0, 0.0
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, float(np.log(pos / neg))
    for _ in range(60):
        p = sigmoid(a * z + b)
        r, v = p - t, p * (1 - p) + 1e-9
        g = np.array([(r * z).sum() + 1e-6 * a, r.sum()])
        h = np.array([[(v * z * z).sum() + 1e-6, (v * z).sum()], [(v * z).sum(), v.sum()]])
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        step *= min(1.0, 5.0 / (1e-12 + np.abs(step).max()))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return (a, b) if a > 0 else (1.0, 0.0)
