"""Trees, forests and boosted trees grown level by level on distinct rows with counts.

Everything that a search fits is grown in lockstep: all folds and the whole data, all trees of a forest, and all
learning rates are models of the same pass, so a level of all of them costs one scan and one shuffle
(:mod:`splits`). Trees have no depth limit unless one is set. The driver keeps the trees, whose size follows their
number of leaves (``MAX_NODES`` at most, beyond which growing ends with an error), never rows.

Rows: ``values array<double>``, ``label`` 0/1, ``copies array<double>``: how often each row counts in each training set.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from math import log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from lurescope.operators.splits import FRIEDMAN, ROWS, Block, Criterion, batch_arrays, best_splits, chunk_borders, fit_in_tasks, is_small, second_order
from lurescope.session import stored

FOLD_EVERY = 10
MAX_NODES = 20_000_000
BUCKET_ROWS = 20_000
NODE_SCHEMA = "tree int, node int, feature int, threshold double, left int, right int, value double"


@dataclass
class Tree:
    """Nodes as arrays; node 0 is the root, a leaf has feature -1."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, feature: int, threshold: float) -> tuple[int, int]:
        left, right = len(self.feature), len(self.feature) + 1
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, left, right
        for values, start in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            values += [start, start]
        return left, right

    def frozen(self) -> FrozenTree:
        return FrozenTree(*(np.array(c) for c in (self.feature, self.threshold, self.left, self.right, self.value)))

    def depth(self) -> int:
        depths = [0] * len(self.feature)
        for i, f in enumerate(self.feature):
            if f >= 0:
                depths[self.left[i]] = depths[self.right[i]] = depths[i] + 1
        return max(depths)


@dataclass
class FrozenTree:
    """The arrays of a tree for tasks."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The node each row ends in."""
        at = np.zeros(len(x), dtype=np.int64)
        moving = np.arange(len(x))
        while True:
            moving = moving[self.feature[at[moving]] >= 0]
            if not len(moving):
                return at
            node = at[moving]
            goes_left = x[moving, self.feature[node]] <= self.threshold[node]
            at[moving] = np.where(goes_left, self.left[node], self.right[node])

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)]


#: Statistics of a batch for one model: (rows that count, one line of statistics each).
Statistics = Callable[[dict[str, np.ndarray], int], tuple[np.ndarray, np.ndarray]]


def grow_trees(
    rows: DataFrame | Block,
    payload: list[str],
    statistics: Statistics,
    models: int,
    criterion: Criterion,
    width: int,
    borders: list[list[float]],
    depth: int | None = None,
    looks_at: int | None = None,
    seed: int = 0,
) -> tuple[list[Tree], list[np.ndarray]]:
    """One tree per model, and the totals of each of its nodes (one line per node).

    ``looks_at``: features a node draws, as forests do; where none of them splits, it goes on to the first
    further one that does. The draw depends on the seed, the model and the node only.
    """
    trees = [Tree() for _ in range(models)]
    totals: list[list[np.ndarray]] = [[np.zeros(criterion.width)] for _ in range(models)]
    opened = [(m, 0, 0, 0) for m in range(models)]  # model, node, level, features looked at before
    roots = True
    while opened:
        frozen = [t.frozen() for t in trees]
        slot_of = [np.full(len(t.feature), -1) for t in trees]
        for s, (m, node, _, _) in enumerate(opened):
            slot_of[m][node] = s
        active = sorted({m for m, _, _, _ in opened})

        def entries(batch: dict[str, np.ndarray], frozen=frozen, slot_of=slot_of, active=active):
            slots, at, stats = [], [], []
            for m in active:
                counted, own = statistics(batch, m)
                slot = slot_of[m][frozen[m].leaves(batch["values"][counted])]
                inside = slot >= 0
                slots.append(slot[inside])
                at.append(counted[inside])
                stats.append(own[inside])
            return np.concatenate(slots), np.concatenate(at), np.concatenate(stats)

        candidates = in_order = None
        if looks_at is not None:
            orders = [np.random.default_rng([seed, m, node]).permutation(width)[seen:] for m, node, _, seen in opened]
            candidates = np.full((len(opened), looks_at), -1)
            for s, order in enumerate(orders):
                candidates[s, : len(order[:looks_at])] = order[:looks_at]
            in_order = np.array([seen > 0 for *_, seen in opened])
        found = best_splits(rows, payload, entries, len(opened), criterion, borders, candidates, in_order)
        following = []
        for s, (m, node, level, seen) in enumerate(opened):
            if roots:
                totals[m][0] = found.totals[s]
                if not criterion.is_open(found.totals[s]) or depth == 0:
                    continue
            if found.feature[s] < 0:
                if looks_at is not None and seen + looks_at < width:
                    following.append((m, node, level, seen + looks_at))
                continue
            sides = trees[m].split(node, int(found.feature[s]), float(found.threshold[s]))
            for child, total in zip(sides, (found.left[s], totals[m][node] - found.left[s]), strict=True):
                totals[m].append(total)
                if (depth is None or level + 1 < depth) and criterion.is_open(total):
                    following.append((m, child, level + 1, 0))
        opened, roots = following, False
        if sum(len(t.feature) for t in trees) > MAX_NODES:
            raise ValueError(f"the trees have more than {MAX_NODES} nodes; set a depth")
    return trees, [np.array(t) for t in totals]


def _weighted(which: list[int], column: str = "copies") -> Statistics:
    """Class weights for each model, whose weights are in that place of ``column``."""

    def statistics(batch: dict[str, np.ndarray], m: int) -> tuple[np.ndarray, np.ndarray]:
        weight = batch[column][:, which[m]].astype(np.float64)
        counted = np.flatnonzero(weight > 0)
        label = batch["label"][counted]
        return counted, np.stack([weight[counted] * (label == 0), weight[counted] * (label == 1)], axis=1)

    return statistics


def _share_of_ones(trees: list[Tree], totals: list[np.ndarray]) -> list[Tree]:
    for tree, total in zip(trees, totals, strict=True):
        whole = total.sum(axis=1)
        tree.value = np.divide(total[:, 1], whole, out=np.zeros(len(whole)), where=whole > 0).tolist()
    return trees


def fit_trees(rows: DataFrame, width: int, sets: list[int], criterion: Criterion, depth: int | None = None) -> list[Tree]:
    """One classification tree per training set."""
    borders = chunk_borders(rows, width)
    return _share_of_ones(*grow_trees(rows, ["label", "copies"], _weighted(sets), len(sets), criterion, width, borders, depth))


# --- forests ----------------------------------------------------------------


def bootstrap_draws(rows: DataFrame, sets: list[int], trees: int, seed: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` with ``draws array<int>``: how often each tree of each set draws the row.

    A tree draws as many rows as its set has copies. The draws are dealt to hash buckets of bounded size first and to
    the rows of a bucket after that, both multinomially, which together is one multinomial draw over all rows. Seeds are
    those of (set, tree, bucket), so the result depends neither on partitions nor on their order.
    """
    buckets = max(1, -(-rows.count() // bucket_rows))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("values", "label"), F.lit(buckets)).cast("int"))
    sums = dealt.groupBy("bucket").agg(*[F.sum(F.get("copies", F.lit(s)).cast("bigint")).alias(f"n{s}") for s in sets]).collect()
    totals = np.zeros((buckets, len(sets)), np.int64)
    for r in sums:
        totals[r["bucket"]] = [r[f"n{s}"] or 0 for s in sets]

    def draw(frame: pd.DataFrame) -> pd.DataFrame:
        bucket = int(frame["bucket"].iloc[0])
        values = np.array(frame["values"].tolist(), dtype=np.float64)
        order = np.lexsort((frame["label"].to_numpy(), *values.T[::-1]))
        copies = np.array(frame["copies"].tolist(), dtype=np.float64)[order][:, sets]
        drawn = np.zeros((len(frame), len(sets) * trees), np.int32)
        for k, s in enumerate(sets):
            n = int(totals[:, k].sum())
            if not n or not copies[:, k].sum():
                continue
            for t in range(trees):
                own = np.random.default_rng([seed, s, t]).multinomial(n, totals[:, k] / n)[bucket]
                drawn[order, k * trees + t] = np.random.default_rng([seed, s, t, bucket]).multinomial(own, copies[:, k] / copies[:, k].sum())
        return frame.drop(columns="bucket").assign(draws=list(drawn))

    shape = StructType([*rows.schema.fields, StructField("draws", ArrayType(DoubleType()))])
    return dealt.groupBy("bucket").applyInPandas(lambda f: draw(f).assign(draws=lambda d: d["draws"].map(lambda x: x.astype(np.float64))), shape)


def fit_forests(rows: DataFrame, width: int, sets: list[int], trees: int, criterion: Criterion, seed: int, depth: int | None = None) -> list[list[Tree]]:
    """One forest per training set: bootstrap draws, and as many features per node as the root of their number."""
    drawn = stored(bootstrap_draws(rows, sets, trees, seed))
    models = len(sets) * trees
    looks_at = max(1, int(width**0.5))
    grown = grow_trees(
        drawn, ["label", "draws"], _weighted(list(range(models)), "draws"), models, criterion, width, chunk_borders(rows, width), depth, looks_at, seed
    )
    flat = _share_of_ones(*grown)
    return [flat[k * trees : (k + 1) * trees] for k in range(len(sets))]


# --- boosting ---------------------------------------------------------------


@dataclass(frozen=True)
class Boosting:
    """How rounds are grown: by residuals with a leaf step, or by gradients and hessians."""

    kind: str  # "residual" or "second_order"
    depth: int
    regularisation: float = 1.0
    min_child: float = 1.0

    def criterion(self) -> Criterion:
        return FRIEDMAN if self.kind == "residual" else second_order(self.regularisation, self.min_child)

    def statistics(self, label: np.ndarray, copies: np.ndarray, margin: np.ndarray) -> np.ndarray:
        p = 1 / (1 + np.exp(-margin))
        if self.kind == "residual":
            r = label - p
            return np.stack([copies * r, copies, copies * p * (1 - p), copies * r * r], axis=1)
        return np.stack([copies * (p - label), copies * p * (1 - p)], axis=1)

    def leaf(self, total: np.ndarray) -> np.ndarray:
        if self.kind == "residual":
            return np.divide(total[:, 0], total[:, 2], out=np.zeros(len(total)), where=total[:, 2] > 1e-150)
        return -total[:, 0] / (total[:, 1] + self.regularisation)


RESIDUAL = Boosting("residual", 3)
SECOND_ORDER = Boosting("second_order", 6)


def fit_boosted(rows: DataFrame, width: int, sets: list[int], rates: list[float], rounds: int, boosting: Boosting) -> dict[tuple[float, int], Ensemble]:
    """One ensemble per (rate, set), all grown in lockstep; its first n trees are the ensemble of n rounds.

    The margins so far are stored every ``FOLD_EVERY`` rounds; later trees are walked again from there. Few distinct rows
    (:func:`splits.is_small`) boost in one task a model, as hundreds of jobs would take far longer than their rows.
    """
    models = [(rate, s) for rate in rates for s in sets]
    ones = rows.agg(*[F.sum(F.get("copies", F.lit(s)) * c).alias(f"{n}{s}") for s in sets for n, c in (("one", F.col("label")), ("all", F.lit(1)))]).first()
    base = []
    for _, s in models:
        share = (ones[f"one{s}"] or 0) / (ones[f"all{s}"] or 1)
        share = min(max(share, np.finfo(np.float32).eps), 1 - np.finfo(np.float32).eps)
        base.append(log(share / (1 - share)) if boosting.kind == "residual" else 0.0)
    state = stored(rows.select("values", "label", "copies", F.array(*[F.lit(float(b)) for b in base]).alias("margin")))
    if is_small(state):

        def fit(block: Block, m: int) -> pd.DataFrame:
            own = pa.array([[base[m]]] * len(block.batch), pa.list_(pa.float64()))
            block = Block(pa.record_batch([*block.batch.columns, own], [*block.batch.schema.names, "margin"]))
            return _node_frame(_boost(block, width, [models[m]], rounds, boosting, [[] for _ in range(width)])[0])

        nodes = fit_in_tasks(state.drop("margin"), len(models), fit, NODE_SCHEMA)
        done = [_trees_of(nodes[nodes["_model"] == m].sort_values(["tree", "node"])) for m in range(len(models))]
    else:
        done = _boost(state, width, models, rounds, boosting, chunk_borders(state, width))
    return {key: Ensemble("margin", done[m], key[0], base[m]) for m, key in enumerate(models)}


def _boost(
    state: DataFrame | Block, width: int, models: list[tuple[float, int]], rounds: int, boosting: Boosting, borders: list[list[float]]
) -> list[list[Tree]]:
    """The trees of every (rate, set), in the order of their rounds."""
    done: list[list[Tree]] = [[] for _ in models]
    pending: list[list[FrozenTree]] = [[] for _ in models]

    for _ in range(rounds):

        def statistics(batch: dict[str, np.ndarray], m: int, pending=pending) -> tuple[np.ndarray, np.ndarray]:
            copies = batch["copies"][:, models[m][1]]
            counted = np.flatnonzero(copies > 0)
            margin = batch["margin"][counted, m] + models[m][0] * sum(t.predict(batch["values"][counted]) for t in pending[m])
            return counted, boosting.statistics(batch["label"][counted], copies[counted], margin)

        trees, totals = grow_trees(
            state, ["label", "copies", "margin"], statistics, len(models), boosting.criterion(), width, borders, boosting.depth
        )
        for m, (tree, total) in enumerate(zip(trees, totals, strict=True)):
            tree.value = boosting.leaf(total).tolist()
            done[m].append(tree)
        pending = [[*p, t.frozen()] for p, t in zip(pending, trees, strict=True)]
        if len(pending[0]) == FOLD_EVERY:
            state = _moved(state, pending, [rate for rate, _ in models])
            pending = [[] for _ in models]
    return done


def _moved(state: DataFrame | Block, pending: list[list[FrozenTree]], rates: list[float]) -> DataFrame | Block:
    """``state`` with the pending trees in its margins, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                a = batch_arrays(batch, first, ROWS)
                margin = a["margin"] + np.stack([r * sum(t.predict(a["values"]) for t in p) for r, p in zip(rates, pending, strict=True)], axis=1)
                part = batch.slice(first, ROWS)
                yield pa.record_batch([*part.columns[:3], pa.array(list(margin), pa.list_(pa.float64()))], part.schema.names)

    return state.mapped(run) if isinstance(state, Block) else stored(state.mapInArrow(run, state.schema))


def _node_frame(trees: list[Tree]) -> pd.DataFrame:
    parts = [
        pd.DataFrame({"tree": k, "node": range(len(t.feature)), "feature": t.feature, "threshold": t.threshold, "left": t.left, "right": t.right, "value": t.value})
        for k, t in enumerate(trees)
    ]
    whole = pd.concat(parts) if parts else pd.DataFrame({c.split()[0]: [] for c in NODE_SCHEMA.split(", ")})
    return whole.astype({c: {"int": "int32", "double": "float64"}[t] for c, t in (f.split() for f in NODE_SCHEMA.split(", "))})


def _trees_of(nodes: pd.DataFrame) -> list[Tree]:
    return [Tree(*(g[c].tolist() for c in ("feature", "threshold", "left", "right", "value"))) for _, g in nodes.groupby("tree")]


# --- fitted ensembles -------------------------------------------------------


@dataclass
class Ensemble:
    """Trees whose values are averaged (``mean``, probabilities) or added to a base with a rate (``margin``)."""

    kind: str
    trees: list[Tree]
    rate: float = 1.0
    base: float = 0.0

    def first(self, n: int) -> Ensemble:
        return Ensemble(self.kind, self.trees[:n], self.rate, self.base)

    def scorer(self) -> Callable[[np.ndarray], np.ndarray]:
        """P(1) of rows of values."""
        frozen, kind, rate, base = [t.frozen() for t in self.trees], self.kind, self.rate, self.base

        def score(x: np.ndarray) -> np.ndarray:
            total = sum((t.predict(x) for t in frozen), np.zeros(len(x)))
            if kind == "mean":
                return total / max(1, len(frozen))
            return 1 / (1 + np.exp(-(base + rate * total)))

        return score

    def apply(self, df: DataFrame, columns: list[str]) -> DataFrame:
        """``df`` with ``prediction`` (1 where P(1) is above a half) and ``probability`` [P(0), P(1)].

        The trees are broadcast: their size is that of the model, at most ``MAX_NODES`` nodes.
        """
        shared = df.sparkSession.sparkContext.broadcast([t.frozen() for t in self.trees])
        kind, rate, base = self.kind, self.rate, self.base
        kept = [c for c in df.columns if c not in ("prediction", "probability")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = Ensemble(kind, [], rate, base)
            model.trees = [_Thawed(t) for t in shared.value]
            score = model.scorer()
            for batch in batches:
                x = batch_arrays(batch.select(["_values"]), 0, len(batch))["_values"] if len(batch) else np.zeros((0, len(columns)))
                p = score(x.astype(np.float64))
                probability = pa.array(list(np.stack([1 - p, p], axis=1)), pa.list_(pa.float64()))
                yield pa.record_batch([*[batch.column(c) for c in kept], pa.array((p > 0.5).astype(np.float64)), probability], [*kept, "prediction", "probability"])

        fields = [f for f in df.schema.fields if f.name in kept]
        shape = StructType([*fields, StructField("prediction", DoubleType()), StructField("probability", ArrayType(DoubleType()))])
        values = F.array(*[F.col(c).cast("double") for c in columns]).alias("_values")
        return df.select(*kept, values).mapInArrow(run, shape)

    def node_table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, threshold, left, right, value)."""
        return spark.createDataFrame(_node_frame(self.trees), NODE_SCHEMA)

    @staticmethod
    def from_table(table: DataFrame, kind: str, rate: float, base: float) -> Ensemble:
        frame = table.orderBy("tree", "node").toPandas()
        return Ensemble(kind, _trees_of(frame), rate, base)


@dataclass
class _Thawed:
    """A shared tree that needs no freezing."""

    tree: FrozenTree

    def frozen(self) -> FrozenTree:
        return self.tree


def fold_accuracy(rows: DataFrame, folds: int, models: dict[tuple[int, int], Ensemble]) -> dict[int, float]:
    """Mean accuracy over the folds of every choice, in one pass.

    ``models``: by (choice, fold). ``rows`` has ``fold_copies array<double>``, how often a row counts in each fold.
    """
    scorers = {k: m.scorer() for k, m in models.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits, seen = dict.fromkeys(scorers, 0.0), dict.fromkeys(scorers, 0.0)
        for batch in batches:
            for first in range(0, len(batch), ROWS):
                a = batch_arrays(batch, first, ROWS)
                for (choice, fold), score in scorers.items():
                    copies = a["fold_copies"][:, fold]
                    held = np.flatnonzero(copies > 0)
                    right = (score(a["values"][held]) > 0.5) == (a["label"][held] == 1)
                    hits[choice, fold] += copies[held][right].sum()
                    seen[choice, fold] += copies[held].sum()
        keys = list(scorers)
        columns = [[c for c, _ in keys], [f for _, f in keys], [hits[k] for k in keys], [seen[k] for k in keys]]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["choice", "fold", "hits", "seen"])

    parts = rows.select("values", "label", "fold_copies").mapInArrow(run, "choice int, fold int, hits double, seen double")
    sums = parts.groupBy("choice", "fold").agg(F.sum("hits").alias("hits"), F.sum("seen").alias("seen")).collect()
    scores: dict[int, float] = {}
    for r in sorted(sums, key=lambda r: (r["choice"], r["fold"])):
        scores[r["choice"]] = scores.get(r["choice"], 0.0) + (r["hits"] / r["seen"] if r["seen"] else 0.0) / folds
    return scores
