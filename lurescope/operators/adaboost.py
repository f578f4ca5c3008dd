"""AdaBoost (SAMME, two classes) over depth-1 trees.

Each round is one pass of :mod:`splits` over the stored rows: exact weights per (feature, value, label), running
sums over the values in range chunks, and one best threshold per feature and chunk to the driver. A feature may have
any number of values. All training sets of a search boost in lockstep, so a round of all of them is one pass. Row
weights are recomputed from the stored rows and the stumps so far. Every ``FOLD_EVERY`` rounds the running
log-weight is stored, which keeps the plan short and survives the loss of executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.operators.ensembles import Ensemble, Tree
from lurescope.operators.splits import GINI, ROWS, Block, batch_arrays, best_splits, chunk_borders, fit_in_tasks, is_small
from lurescope.session import stored

FOLD_EVERY = 10
STUMP_SCHEMA = "round int, feature string, threshold double, left int, right int, alpha double"


@dataclass(frozen=True)
class Stump:
    feature: str
    threshold: float
    left: int
    right: int
    alpha: float

    def vote(self) -> Column:
        return F.when(F.col(self.feature) <= self.threshold, self.left).otherwise(self.right)


def _wrong(stumps: list[Stump], columns: list[str], x: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The weight that the stumps add to each row, as a logarithm."""
    total = np.zeros(len(x))
    for s in stumps:
        vote = np.where(x[:, columns.index(s.feature)] <= s.threshold, s.left, s.right)
        total += s.alpha * (vote != label)
    return total


def fit_adaboost_sets(rows: DataFrame, columns: list[str], sets: list[int], rounds: int, rate: float = 1.0) -> list[list[Stump]]:
    """Boost over (values, label, copies array) for each training set, in lockstep.

    A set stops early on a perfect or a useless stump. Few distinct rows (:func:`splits.is_small`) boost in one task a set.
    """
    state = stored(rows.select("values", "label", "copies", F.array(*[F.lit(0.0)] * len(sets)).alias("log_w")))
    if not is_small(state):
        return _boost(state, columns, sets, rounds, rate, chunk_borders(state, len(columns)))

    def fit(block: Block, m: int) -> pd.DataFrame:
        own = pa.array([[0.0]] * len(block.batch), pa.list_(pa.float64()))
        block = Block(pa.record_batch([*block.batch.columns, own], [*block.batch.schema.names, "log_w"]))
        found = _boost(block, columns, [sets[m]], rounds, rate, [[] for _ in columns])[0]
        names = [c.split()[0] for c in STUMP_SCHEMA.split(", ")]
        frame = pd.DataFrame([(i, s.feature, s.threshold, s.left, s.right, s.alpha) for i, s in enumerate(found)], columns=names)
        return frame.astype({"round": "int32", "left": "int32", "right": "int32", "feature": str, "threshold": float, "alpha": float})

    table = fit_in_tasks(state.drop("log_w"), len(sets), fit, STUMP_SCHEMA).sort_values("round")
    own = [table[table["_model"] == m] for m in range(len(sets))]
    return [[Stump(*r) for r in zip(*(t[c].tolist() for c in ("feature", "threshold", "left", "right", "alpha")), strict=True)] for t in own]


def _boost(
    state: DataFrame | Block, columns: list[str], sets: list[int], rounds: int, rate: float, borders: list[list[float]]
) -> list[list[Stump]]:
    models = range(len(sets))
    stumps: list[list[Stump]] = [[] for _ in models]
    pending: list[list[Stump]] = [[] for _ in models]
    shift = [0.0 for _ in models]
    boosting = list(models)
    for _ in range(rounds):

        def entries(batch: dict[str, np.ndarray], boosting=tuple(boosting), pending=pending, shift=tuple(shift)):
            slots, at, stats = [], [], []
            for slot, m in enumerate(boosting):
                copies = batch["copies"][:, sets[m]]
                row = np.flatnonzero(copies > 0)
                label = batch["label"][row]
                w = copies[row] * np.exp(batch["log_w"][row, m] + _wrong(pending[m], columns, batch["values"][row], label) - shift[m])
                slots.append(np.full(len(row), slot))
                at.append(row)
                stats.append(np.stack([w * (label == 0), w * (label == 1)], axis=1))
            return np.concatenate(slots), np.concatenate(at), np.concatenate(stats)

        found = best_splits(state, ["label", "copies", "log_w"], entries, len(boosting), GINI, borders)
        going = []
        for slot, m in enumerate(boosting):
            total, left = found.totals[slot], found.left[slot]
            if total.sum() <= 0:
                continue
            if found.feature[slot] >= 0 and found.gain[slot] > 1e-12 * total.sum():
                right = total - left
                sides = int(left[1] > left[0]), int(right[1] > right[0])
                error = (left[1 - sides[0]] + right[1 - sides[1]]) / total.sum()
                name, threshold = columns[found.feature[slot]], float(found.threshold[slot])
            else:
                sides = (int(total[1] > total[0]),) * 2
                error, name, threshold = total.min() / total.sum(), columns[0], 0.0
            if error >= 0.5:
                continue
            perfect = error <= 1e-15
            stump = Stump(name, threshold, *sides, 1.0 if perfect else rate * log((1 - error) / error))
            stumps[m].append(stump)
            if not perfect:
                pending[m].append(stump)
                shift[m] += log(max(total.sum(), 1e-300))
                going.append(m)
        boosting = going
        if not boosting:
            break
        if len(pending[boosting[0]]) == FOLD_EVERY:
            state = _weighted_on(state, columns, pending, shift)
            pending, shift = [[] for _ in models], [0.0 for _ in models]
    return stumps


def _weighted_on(state: DataFrame | Block, columns: list[str], pending: list[list[Stump]], shift: list[float]) -> DataFrame | Block:
    """``state`` with the pending stumps in its log-weights, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                a, part = batch_arrays(batch, first, ROWS), batch.slice(first, ROWS)
                added = [_wrong(p, columns, a["values"], a["label"]) - s for p, s in zip(pending, shift, strict=True)]
                weights = pa.array(list(a["log_w"] + np.stack(added, axis=1)), pa.list_(pa.float64()))
                yield pa.record_batch([*part.columns[:3], weights], part.schema.names)

    return state.mapped(run) if isinstance(state, Block) else stored(state.mapInArrow(run, state.schema))


def fit_adaboost(rows: DataFrame, columns: list[str], rounds: int, rate: float = 1.0) -> list[Stump]:
    """Boost over (columns…, label 0/1, copies)."""
    values = F.array(*[F.col(c).cast("double") for c in columns]).alias("values")
    one = rows.select(values, F.col("label").cast("double").alias("label"), F.array(F.col("copies").cast("double")).alias("copies"))
    return fit_adaboost_sets(one, columns, [0], rounds, rate)[0]


def as_ensemble(stumps: list[Stump], columns: list[str]) -> Ensemble:
    """The stumps as trees whose sum gives the same probabilities as :func:`apply_adaboost`."""
    trees = []
    for s in stumps:
        tree = Tree()
        left, right = tree.split(0, columns.index(s.feature), s.threshold)
        tree.value[left], tree.value[right] = ((s.alpha if v == 1 else -s.alpha) for v in (s.left, s.right))
        trees.append(tree)
    total = sum(s.alpha for s in stumps)
    return Ensemble("margin", trees, 2 / total if total > 0 else 2.0)


def _margin(stumps: list[Stump]) -> Column:
    """Sum of the votes times their weights: one step function per feature, so the expression stays small."""
    steps: dict[str, dict[float, float]] = {}
    base = 0.0
    for s in stumps:
        left, right = (s.alpha if v == 1 else -s.alpha for v in (s.left, s.right))
        base += right
        if left != right:
            at = steps.setdefault(s.feature, {})
            at[s.threshold] = at.get(s.threshold, 0.0) + left - right
    value = F.lit(base)
    for feature, at in steps.items():
        thresholds = sorted(at)
        step = F.lit(0.0)
        for k in reversed(range(len(thresholds))):  # up to a threshold, all steps from it on count
            step = F.when(F.col(feature) <= thresholds[k], F.lit(sum(at[t] for t in thresholds[k:]))).otherwise(step)
        value = value + step
    return value


def apply_adaboost(df: DataFrame, stumps: list[Stump]) -> DataFrame:
    """Add ``prediction`` and ``probability`` [P(0), P(1)] from the normalised margin."""
    total = sum(s.alpha for s in stumps)
    margin = _margin(stumps)
    staged = df.withColumn("_margin", margin / total if total > 0 else margin)
    p1 = F.lit(1.0) / (F.lit(1.0) + F.exp(F.col("_margin") * -2))
    return staged.withColumns(
        {
            "prediction": F.when(F.col("_margin") > 0, 1.0).otherwise(0.0),
            "probability": F.array(F.lit(1.0) - p1, p1),
        }
    ).drop("_margin")


def stump_table(spark: SparkSession, stumps: list[Stump]) -> DataFrame:
    rows = [(i, s.feature, s.threshold, s.left, s.right, s.alpha) for i, s in enumerate(stumps)]
    return spark.createDataFrame(rows, STUMP_SCHEMA)


def stumps_from_table(table: DataFrame) -> list[Stump]:
    rows = table.orderBy("round").collect()
    return [Stump(r["feature"], r["threshold"], r["left"], r["right"], r["alpha"]) for r in rows]
