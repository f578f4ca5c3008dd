"""Best splits of many tree nodes at once, from exact sums per (node, feature, value).

Rows carry ``values`` (an array of doubles, one per feature, without nulls) and whatever the statistics are made
from. One pass serves every open node of every model that is being grown: each task sums the statistics of
its own rows per (node, feature, value), a shuffle brings equal cells together, and running sums in the order of the
values give the gain of every threshold. Nothing is binned: thresholds lie midway between neighbouring values that a
node holds.

A feature with many values is cut into range chunks at sketch quantiles, so no task gets a feature whole. Sums of
whole chunks give each chunk its offset (a first, small pass, made only where there is more than one chunk). The
driver gets one row per (node, feature, chunk): the chunk's best threshold. Gains that differ by less than
``TIE`` count as equal; the first feature, then the lowest threshold wins.

Learners that need hundreds of passes one after the other (boosting) pay for the passes, not for the rows, where there are few
distinct ones. Up to ``LOCAL_ROWS`` of them, :func:`fit_in_tasks` gives every model a task of its own, which makes the
same passes over its :class:`Block`; beyond that bound the passes are Spark jobs over all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.session import stored

CHUNK_VALUES = 20_000
MAX_CHUNKS = 1024
SKETCH_ACCURACY = 10000
ROWS = 4096
HELD = 1_000_000
LOCAL_ROWS = 20_000
TIE = 1e-10

# (batch arrays) -> node slot of each entry, its row, and its statistics (one line per entry)
Entries = Callable[[dict[str, np.ndarray]], tuple[np.ndarray, np.ndarray, np.ndarray]]


@dataclass(frozen=True)
class Criterion:
    """What a split gains, in terms of summed statistics of the left side and of the node."""

    name: str
    width: int
    gain: Callable[[np.ndarray, np.ndarray], np.ndarray]
    size: Callable[[np.ndarray], np.ndarray]  # of the node, what ties are measured by
    is_open: Callable[[np.ndarray], bool]  # may a node with these totals be split at all
    least: float = -np.inf


def _share(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b > 0)


def _gini(s: np.ndarray) -> np.ndarray:
    return 2 * _share(s[:, 0] * s[:, 1], s[:, 0] + s[:, 1])


def _entropy(s: np.ndarray) -> np.ndarray:
    total = s[:, 0] + s[:, 1]
    parts = [_share(s[:, k], total) for k in (0, 1)]
    return -total * sum(np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0) for p in parts)


def _impurity(name: str, impurity: Callable[[np.ndarray], np.ndarray]) -> Criterion:
    """Statistics: weight of class 0 and of class 1."""
    return Criterion(
        name, 2, lambda left, node: impurity(node) - impurity(left) - impurity(node - left), impurity, lambda t: t[0] > 0 and t[1] > 0
    )


GINI = _impurity("gini", _gini)
ENTROPY = _impurity("entropy", _entropy)


def _friedman_gain(left: np.ndarray, node: np.ndarray) -> np.ndarray:
    right = node - left
    gap = _share(left[:, 0], left[:, 1]) - _share(right[:, 0], right[:, 1])
    return _share(left[:, 1] * right[:, 1], node[:, 1]) * gap * gap


#: Statistics: sum of residuals, weight, hessian, sum of squared residuals.
FRIEDMAN = Criterion(
    "friedman", 4, _friedman_gain, lambda s: s[:, 3], lambda t: t[3] - t[0] * t[0] / t[1] > 1e-12 * t[1] if t[1] > 0 else False
)


def second_order(regularisation: float = 1.0, min_child: float = 1.0, least: float = 1e-6) -> Criterion:
    """Statistics: gradient and hessian. Sides lighter than ``min_child`` in hessian are no splits."""

    def score(s: np.ndarray) -> np.ndarray:
        return s[:, 0] ** 2 / (s[:, 1] + regularisation)

    def gain(left: np.ndarray, node: np.ndarray) -> np.ndarray:
        right = node - left
        enough = (left[:, 1] >= min_child) & (right[:, 1] >= min_child)
        return np.where(enough, score(left) + score(right) - score(node), -np.inf)

    return Criterion("second_order", 2, gain, lambda s: score(s), lambda t: True, least)


@dataclass
class Splits:
    """Per node slot: totals, and the best split (feature -1: none)."""

    totals: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    gain: np.ndarray


@dataclass
class Block:
    """At most ``LOCAL_ROWS`` distinct rows held by one task."""

    batch: pa.RecordBatch

    def mapped(self, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Block:
        return Block(pa.Table.from_batches(list(run(iter([self.batch])))).combine_chunks().to_batches()[0])


def is_small(rows: DataFrame) -> bool:
    """Whether stored rows fit a :class:`Block` (none at all: nothing to hold)."""
    return 0 < rows.limit(LOCAL_ROWS + 1).count() <= LOCAL_ROWS


def fit_in_tasks(rows: DataFrame, models: int, fit: Callable[[Block, int], pd.DataFrame], schema: str) -> pd.DataFrame:
    """``fit(block of all rows, model)`` for every model, each in a task of its own; the results with ``_model``.

    ``rows`` are small (:func:`is_small`), which bounds the broadcast and what a task holds.
    """
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        model = table.column("_model").to_numpy()
        for m in np.unique(model):
            block = Block(table.filter(pa.array(model == m)).select(names).combine_chunks().to_batches()[0])
            yield pa.RecordBatch.from_pandas(fit(block, int(m)).assign(_model=int(m)), preserve_index=False)

    spark = rows.sparkSession
    each = spark.range(0, models, 1, models).withColumnRenamed("id", "_model").crossJoin(F.broadcast(rows))
    return each.mapInArrow(run, schema + ", _model long").toPandas()


def chunk_borders(rows: DataFrame, width: int, chunk_values: int = CHUNK_VALUES) -> list[list[float]]:
    """Borders per feature: none up to ``chunk_values`` distinct values, else sketch quantiles of them.

    Any borders give the same splits; they only balance the work. At most width x ``MAX_CHUNKS`` numbers.
    """
    pairs = rows.select(F.posexplode("values").alias("feature", "value"))
    sizes = {r["feature"]: r["n"] for r in pairs.groupBy("feature").agg(F.approx_count_distinct("value").alias("n")).collect()}
    borders: list[list[float]] = [[] for _ in range(width)]
    for f, n in sizes.items():
        chunks = min(MAX_CHUNKS, -(-n // chunk_values))
        if chunks > 1:
            probes = [i / chunks for i in range(1, chunks)]
            distinct = pairs.where(F.col("feature") == f).select("value").distinct()
            borders[f] = sorted(set(distinct.agg(F.percentile_approx("value", probes, SKETCH_ACCURACY)).first()[0]))
    return borders


def batch_arrays(batch: pa.RecordBatch, first: int, number: int) -> dict[str, np.ndarray]:
    """Columns of some rows; list columns become matrices."""
    part = batch.slice(first, number)
    arrays = {}
    for name, column in zip(part.schema.names, part.columns, strict=True):
        if pa.types.is_list(column.type):
            flat = column.flatten().to_numpy(zero_copy_only=False)
            arrays[name] = flat.reshape(len(part), -1)
        else:
            arrays[name] = column.to_numpy(zero_copy_only=False)
    return arrays


def _merged(slot: np.ndarray, feature: np.ndarray, value: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells with equal keys summed, in the order of (slot, feature, value). Sums don't depend on the order of arrival."""
    order = np.lexsort((stats[:, -1], stats[:, 0], value, feature, slot))
    slot, feature, value, stats = slot[order], feature[order], value[order], stats[order]
    if not len(slot):
        return slot, feature, value, stats
    new = np.ones(len(slot), dtype=bool)
    new[1:] = (slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return slot[first], feature[first], value[first], np.add.reduceat(stats, first, axis=0)


def _cell_maker(entries: Entries, candidates: np.ndarray | None, borders: list[list[float]], width: int):
    """Task: summed cells of its own rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            slot, feature, value, stats = _merged(*(np.concatenate(c) for c in zip(*held, strict=True)))
            chunk = np.zeros(len(slot), np.int32)
            for f, b in enumerate(borders):
                if b:
                    mine = feature == f
                    chunk[mine] = np.searchsorted(b, value[mine], side="left")
            columns = [slot.astype(np.int32), feature.astype(np.int32), chunk, value, *stats.T.copy()]
            return pa.record_batch([pa.array(c) for c in columns], ["slot", "feature", "chunk", "value", *[f"s{k}" for k in range(width)]])

        for batch in batches:
            for first in range(0, len(batch), ROWS):
                arrays = batch_arrays(batch, first, ROWS)
                slot, row, stats = entries(arrays)
                if not len(slot):
                    continue
                x = arrays["values"]
                for j in range(x.shape[1] if candidates is None else candidates.shape[1]):
                    feature = np.full(len(slot), j) if candidates is None else candidates[slot, j]
                    used = np.flatnonzero(feature >= 0)
                    cells = _merged(slot[used], feature[used], x[row[used], feature[used]], stats[used])
                    held.append(cells)
                    size += len(cells[0])
                if size > HELD:
                    yield emit()
                    held, size = [], 0
        if held:
            yield emit()

    return run


_KEYS = ["slot", "feature", "chunk"]


def _read_cells(batches: Iterator[pa.RecordBatch], width: int):
    """All cells of a partition, merged, with the first cell of every (slot, feature, chunk)."""
    held = list(batches)
    if not held:
        return None
    names = [*_KEYS, "value", *[f"s{k}" for k in range(width)]]
    slot, feature, chunk, value, *stats = [np.concatenate([b.column(c).to_numpy() for b in held]) for c in names]
    stats = np.stack(stats, axis=1)
    # Chunks follow the values, so merging by value keeps them together.
    order = np.lexsort((stats[:, -1], stats[:, 0], value, feature, slot))
    slot, feature, chunk, value, stats = slot[order], feature[order], chunk[order], value[order], stats[order]
    new = np.ones(len(slot), dtype=bool)
    new[1:] = (slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    slot, feature, chunk, value, stats = slot[at], feature[at], chunk[at], value[at], np.add.reduceat(stats, at, axis=0)
    new = np.ones(len(slot), dtype=bool)
    new[1:] = (slot[1:] != slot[:-1]) | (feature[1:] != feature[:-1]) | (chunk[1:] != chunk[:-1])
    return slot, feature, chunk, value, stats, np.flatnonzero(new)


def _chunk_totals(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _read_cells(batches, width)
        if cells is not None:
            slot, feature, chunk, value, stats, first = cells
            sums = np.add.reduceat(stats, first, axis=0)
            columns = [slot[first], feature[first], chunk[first], value[first], *sums.T.copy()]
            yield pa.record_batch([pa.array(c) for c in columns], [*_KEYS, "value", *[f"s{k}" for k in range(width)]])

    return run


def _best_in_chunk(criterion: Criterion, offsets: dict[tuple[int, int, int], tuple] | None):
    """Task: the best threshold of each (slot, feature, chunk) of its partition."""
    width = criterion.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _read_cells(batches, width)
        if cells is None:
            return
        slot, feature, chunk, value, stats, first = cells
        size = np.diff(np.append(first, len(slot)))
        before, total, following = np.zeros((len(first), width)), np.add.reduceat(stats, first, axis=0), np.full(len(first), np.nan)
        if offsets is not None:
            for g, i in enumerate(first):
                before[g], total[g], following[g] = offsets[(int(slot[i]), int(feature[i]), int(chunk[i]))]
        running = np.cumsum(stats, axis=0)
        running -= np.repeat(running[first] - stats[first] - before, size, axis=0)
        after = np.append(value[1:], np.nan)
        after[first + size - 1] = following
        node = np.repeat(total, size, axis=0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where(np.isnan(after), -np.inf, criterion.gain(running, node))
        gain = np.where(np.isnan(gain), -np.inf, gain)
        top = np.maximum.reduceat(gain, first)
        slack = TIE * np.maximum(np.abs(criterion.size(total)), np.where(np.isfinite(top), np.abs(top), 0))
        good = gain >= np.repeat(top - slack, size)
        best = np.minimum.reduceat(np.where(good, np.arange(len(slot)), len(slot) - 1), first)
        best = np.where(np.isfinite(top), best, first)
        columns = [slot[first], feature[first], gain[best], (value[best] + after[best]) / 2, *running[best].T.copy(), *total.T.copy()]
        names = ["slot", "feature", "gain", "threshold", *[f"l{k}" for k in range(width)], *[f"t{k}" for k in range(width)]]
        yield pa.record_batch([pa.array(c) for c in columns], names)

    return run


def _offsets(totals: pa.Table, width: int) -> dict[tuple[int, int, int], tuple]:
    """Sums before each chunk, of its whole (slot, feature), and the first value behind it."""
    slot, feature, chunk, value = (totals.column(c).to_numpy() for c in (*_KEYS, "value"))
    stats = np.stack([totals.column(f"s{k}").to_numpy() for k in range(width)], axis=1)
    order = np.lexsort((chunk, feature, slot))
    found: dict[tuple[int, int, int], tuple] = {}
    first = 0
    for i in range(1, len(order) + 1):
        if i == len(order) or (slot[order[i]], feature[order[i]]) != (slot[order[first]], feature[order[first]]):
            group = order[first:i]
            whole = stats[group].sum(axis=0)
            before = np.cumsum(stats[group], axis=0) - stats[group]
            behind = [*value[group][1:], np.nan]
            for k, g in enumerate(group):
                found[(int(slot[g]), int(feature[g]), int(chunk[g]))] = (before[k], whole, behind[k])
            first = i
    return found


def best_splits(
    rows: DataFrame | Block,
    payload: list[str],
    entries: Entries,
    slots: int,
    criterion: Criterion,
    borders: list[list[float]],
    candidates: np.ndarray | None = None,
    in_order: np.ndarray | None = None,
) -> Splits:
    """The best split of every slot.

    ``candidates``: features a slot looks at (one line per slot; -1: none), else all. Where ``in_order`` is true, a slot
    takes the first of its candidates that splits at all, whatever its gain.
    """
    width = criterion.width
    shape = "slot int, feature int, chunk int, value double, " + ", ".join(f"s{k} double" for k in range(width))
    found_shape = "slot int, feature int, gain double, threshold double, " + ", ".join([f"l{k} double" for k in range(width)] + [f"t{k} double" for k in range(width)])
    make = _cell_maker(entries, candidates, borders, width)
    if isinstance(rows, Block):
        parts = list(_best_in_chunk(criterion, None)(make(iter([rows.batch.select(["values", *payload])]))))
        names = [c.split()[0] for c in found_shape.split(", ")]
        found = pa.Table.from_batches(parts) if parts else pa.table({c: np.zeros(0, np.int32 if c in _KEYS else float) for c in names})
    else:
        cells = rows.select("values", *payload).mapInArrow(make, shape)
        offsets = None
        if any(borders):
            cells = stored(cells)
            placed = cells.repartition(*_KEYS)
            offsets = _offsets(placed.mapInArrow(_chunk_totals(width), shape).toArrow(), width)
        found = cells.repartition(*_KEYS).mapInArrow(_best_in_chunk(criterion, offsets), found_shape).toArrow()
    slot, feature, gain, threshold = (found.column(c).to_numpy() for c in ("slot", "feature", "gain", "threshold"))
    left = np.stack([found.column(f"l{k}").to_numpy() for k in range(width)], axis=1)
    total = np.stack([found.column(f"t{k}").to_numpy() for k in range(width)], axis=1)

    result = Splits(np.zeros((slots, width)), np.full(slots, -1), np.zeros(slots), np.zeros((slots, width)), np.full(slots, -np.inf))
    order = np.lexsort((threshold, feature, slot))
    edges = np.searchsorted(slot[order], np.arange(slots + 1))
    for s in range(slots):
        mine = order[edges[s] : edges[s + 1]]
        if not len(mine):
            continue
        result.totals[s] = total[mine[0]]
        top = gain[mine].max()
        if not np.isfinite(top) or top <= criterion.least:
            continue
        if in_order is not None and in_order[s]:
            splitting = {int(feature[i]) for i in mine if np.isfinite(gain[i])}
            wanted = next(f for f in candidates[s] if f in splitting)
            mine = mine[feature[mine] == wanted]
            top = gain[mine].max()
        slack = TIE * max(abs(float(criterion.size(total[mine[:1]])[0])), abs(top))
        best = next(i for i in mine if gain[i] >= top - slack)
        result.feature[s], result.threshold[s], result.left[s], result.gain[s] = feature[best], threshold[best], left[best], gain[best]
    return result
