"""Splits, trees, forests and boosted trees against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescope.operators import ensembles, splits
from lurescope.operators.ensembles import RESIDUAL, SECOND_ORDER


def table(spark, x, y, copies=None):
    copies = np.ones((len(y), 1)) if copies is None else np.array(copies, dtype=float)
    rows = [(list(map(float, v)), float(l), list(map(float, c))) for v, l, c in zip(x, y, copies, strict=True)]
    return spark.createDataFrame(rows, "values array<double>, label double, copies array<double>").repartition(5)


def plain_tree(x, stats, gain, is_open, least, depth=None, node_rows=None, level=0):
    """Nested (feature, threshold, left, right) or totals, by trying every threshold."""
    rows = np.arange(len(x)) if node_rows is None else node_rows
    total = stats[rows].sum(axis=0)
    if not is_open(total) or level == depth:
        return total
    found = []
    for f in range(x.shape[1]):
        levels = np.unique(x[rows, f])
        for t in (levels[:-1] + levels[1:]) / 2:
            left = stats[rows[x[rows, f] <= t]].sum(axis=0)
            found.append((gain(left[None, :], total[None, :])[0], f, t))
    found = [c for c in found if np.isfinite(c[0])]
    if not found or max(found)[0] <= least:
        return total
    top = max(c[0] for c in found)
    _, f, t = next(c for c in found if c[0] >= top - 1e-9 * max(1, abs(top)))
    go = x[rows, f] <= t
    below = [plain_tree(x, stats, gain, is_open, least, depth, r, level + 1) for r in (rows[go], rows[~go])]
    return (f, t, *below)


def same(tree, node, expected, totals):
    if isinstance(expected, np.ndarray):
        assert tree.feature[node] == -1 and np.allclose(totals[node], expected)
        return
    f, t, left, right = expected
    assert (tree.feature[node], tree.threshold[node]) == (f, pytest.approx(t))
    same(tree, tree.left[node], left, totals)
    same(tree, tree.right[node], right, totals)


def data(n=300, width=4, levels=3, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, levels - 1, (n, width)).astype(float)
    y = ((x @ np.linspace(1, -0.7, width) + rng.normal(0, 0.8, n)) > 0).astype(float)
    return x, y


@pytest.mark.parametrize("criterion", [splits.GINI, splits.ENTROPY])
def test_tree_equals_the_plain_one(spark, criterion):
    x, y = data()
    rows = table(spark, x, y)
    stats = np.stack([y == 0, y == 1], axis=1).astype(float)
    borders = splits.chunk_borders(rows, 4)
    trees, totals = ensembles.grow_trees(rows, ["label", "copies"], ensembles._weighted([0]), 1, criterion, 4, borders)
    same(trees[0], 0, plain_tree(x, stats, criterion.gain, criterion.is_open, criterion.least), totals[0])


def test_thresholds_of_a_feature_with_many_values(spark):
    rng = np.random.default_rng(4)
    x = np.stack([rng.permutation(10_000) / 7, rng.integers(0, 3, 10_000)], axis=1).astype(float)
    y = ((x[:, 0] > 900) ^ (rng.random(10_000) < 0.1)).astype(float)
    rows = table(spark, x, y)
    stats = np.stack([y == 0, y == 1], axis=1).astype(float)
    for size in (500, 20_000):  # twenty chunks, one chunk
        borders = splits.chunk_borders(rows, 2, size)
        assert bool(borders[0]) == (size == 500)
        trees, totals = ensembles.grow_trees(rows, ["label", "copies"], ensembles._weighted([0]), 1, splits.GINI, 2, borders, depth=3)
        same(trees[0], 0, plain_tree(x, stats, splits.GINI.gain, splits.GINI.is_open, -np.inf, 3), totals[0])


def test_trees_have_no_depth_limit(spark):
    n = 40
    x = np.arange(n, dtype=float)[:, None]
    # Weights that double make the best split cut off one end each time.
    y = np.arange(n) % 2
    rows = table(spark, x, y, [[2.0**k] for k in range(n)])
    tree = ensembles.fit_trees(rows, 1, [0], splits.GINI)[0]
    assert tree.depth() > 30
    assert (ensembles.Ensemble("mean", [tree]).scorer()(x) == y).all()


def test_rows_without_a_class_or_a_split(spark):
    same_values = table(spark, np.zeros((4, 2)), [0, 1, 1, 1])
    assert ensembles.fit_trees(same_values, 2, [0], splits.GINI)[0].value == [0.75]
    one_class = table(spark, [[0.0], [1.0]], [1, 1])
    assert ensembles.fit_trees(one_class, 1, [0], splits.GINI)[0].value == [1.0]
    empty = table(spark, [[0.0]], [1]).where("false")
    assert ensembles.fit_trees(empty, 1, [0], splits.GINI)[0].value == [0.0]


def plain_second_order(x, y, copies, rate, rounds, depth):
    criterion = splits.second_order()
    margin, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        stats = np.stack([copies * (p - y), copies * p * (1 - p)], axis=1)
        tree = plain_tree(x, stats, criterion.gain, criterion.is_open, criterion.least, depth)
        trees.append(tree)
        margin = margin + rate * np.array([plain_value(tree, row) for row in x])
    return trees, margin


def plain_value(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return -tree[0] / (tree[1] + 1.0)


def test_second_order_boosting_equals_a_row_wise_version(spark):
    x, y = data(250, seed=7)
    copies = np.random.default_rng(2).integers(0, 6, (250, 2)).astype(float)
    rounds = ensembles.FOLD_EVERY + 2  # across a stored state
    found = ensembles.fit_boosted(table(spark, x, y, copies), 4, [0, 1], [0.1, 0.2], rounds, SECOND_ORDER)
    assert set(found) == {(r, s) for r in (0.1, 0.2) for s in (0, 1)}
    for (rate, s), model in found.items():
        used = copies[:, s] > 0
        trees, margin = plain_second_order(x[used], y[used], copies[used, s], rate, rounds, SECOND_ORDER.depth)
        assert len(model.trees) == rounds
        assert np.allclose(model.scorer()(x[used]), 1 / (1 + np.exp(-margin)), atol=1e-9)
        root = trees[0]
        assert (model.trees[0].feature[0], model.trees[0].threshold[0]) == root[:2]
        shorter = plain_second_order(x[used], y[used], copies[used, s], rate, 3, SECOND_ORDER.depth)[1]
        assert np.allclose(model.first(3).scorer()(x[used]), 1 / (1 + np.exp(-shorter)), atol=1e-9)


def test_residual_boosting_equals_a_row_wise_version(spark):
    x, y = data(200, seed=9)
    model = ensembles.fit_boosted(table(spark, x, y), 4, [0], [0.1], 4, RESIDUAL)[(0.1, 0)]
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(4):
        p = 1 / (1 + np.exp(-margin))
        r = y - p
        stats = np.stack([r, np.ones(len(y)), p * (1 - p), r * r], axis=1)
        tree = plain_tree(x, stats, splits.FRIEDMAN.gain, splits.FRIEDMAN.is_open, -np.inf, 3)

        def value(row, tree=tree):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree[0] / tree[2]

        margin = margin + 0.1 * np.array([value(row) for row in x])
    assert np.allclose(model.scorer()(x), 1 / (1 + np.exp(-margin)), atol=1e-9)


def test_bootstrap_draws(spark):
    rng = np.random.default_rng(3)
    x = rng.permutation(500)[:, None].astype(float)
    copies = np.stack([rng.integers(0, 4, 500), np.where(np.arange(500) == 7, 400, 1), np.zeros(500)], axis=1)
    rows = table(spark, x, np.arange(500) % 2, copies)
    draw = lambda parts: sorted(map(tuple, ensembles.bootstrap_draws(rows.repartition(parts), [0, 1, 2], 6, 11, bucket_rows=60).select("values", "copies", "draws").collect()))
    found = draw(3)
    assert found == draw(8)
    draws = np.array([r[2] for r in found])
    weights = np.array([r[1] for r in found])
    assert (draws.sum(axis=0) == np.repeat(copies.sum(axis=0), 6)).all()
    assert (draws[weights[:, 0] == 0][:, :6] == 0).all()
    heavy = draws[weights[:, 1] == 400][0, 6:12]  # of 899 draws
    assert ((heavy > 340) & (heavy < 460)).all() and len(set(heavy)) > 1


def test_forest(spark):
    x, y = data(400, 6, seed=5)
    rows = table(spark, x, y, np.ones((400, 2)))
    forests = ensembles.fit_forests(rows, 6, [0, 1], 8, splits.GINI, seed=3)
    again = ensembles.fit_forests(rows.repartition(2), 6, [0, 1], 8, splits.GINI, seed=3)
    assert forests == again and len({tuple(t.feature) for t in forests[0]}) == 8
    p = ensembles.Ensemble("mean", forests[0]).scorer()(x)
    assert ((p > 0.5) == (y == 1)).mean() > 0.9
    # Only one feature tells the classes apart: nodes that draw constant ones go on to it.
    lone = np.zeros((40, 9))
    lone[:, 8] = np.arange(40) % 2
    grown = ensembles.fit_forests(table(spark, lone, np.arange(40) % 2), 9, [0], 5, splits.GINI, seed=1)[0]
    assert all(t.feature[0] == 8 and t.depth() == 1 for t in grown)


def test_ensemble_on_a_table_and_stored(spark):
    x, y = data(120, 3)
    trees = ensembles.fit_forests(table(spark, x, y), 3, [0], 3, splits.GINI, seed=1)[0]
    model = ensembles.Ensemble("mean", trees)
    df = spark.createDataFrame([(i, *map(float, v), "own") for i, v in enumerate(x)], "id long, a double, b double, c double, prediction string")
    scored = model.apply(df, ["a", "b", "c"]).orderBy("id")
    assert scored.columns == ["id", "a", "b", "c", "prediction", "probability"]
    p = np.array([r["probability"][1] for r in scored.collect()])
    assert np.allclose(p, model.scorer()(x)) and [r["prediction"] for r in scored.collect()] == (p > 0.5).astype(float).tolist()
    again = ensembles.Ensemble.from_table(model.node_table(spark).repartition(4), "mean", 1.0, 0.0)
    assert again == model
    assert ensembles.Ensemble("mean", []).node_table(spark).count() == 0
    assert model.apply(df.where("false"), ["a", "b", "c"]).count() == 0


def test_accuracy_over_folds(spark):
    rows = [([0.0], 0.0, [1.0, 2.0]), ([1.0], 1.0, [1.0, 0.0]), ([1.0], 0.0, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "values array<double>, label double, fold_copies array<double>")
    tree = ensembles.Tree()
    sides = tree.split(0, 0, 0.5)
    tree.value[sides[1]] = 1.0
    model = ensembles.Ensemble("mean", [tree])
    none = ensembles.Ensemble("mean", [ensembles.Tree()])
    found = ensembles.fold_accuracy(df, 2, {(0, 0): model, (0, 1): model, (1, 0): none, (1, 1): none})
    assert found == {0: pytest.approx((1 + 0.5) / 2), 1: pytest.approx((0.5 + 1) / 2)}
    assert df.where(F.lit(False)).count() == 0


def test_few_rows_boost_in_one_task_a_model(spark, monkeypatch):
    """Rounds of a small table are no jobs of their own, and give the trees and stumps of the passes over all tasks."""
    from lurescope.operators import adaboost

    x, y = data(150, seed=21)
    copies = np.random.default_rng(4).integers(0, 4, (150, 3)).astype(float)
    rows = table(spark, x, y, copies).cache()
    rows.count()
    names = [f"c{i}" for i in range(4)]

    def all_of(group):
        spark.sparkContext.setJobGroup(group, group)
        boosted = [ensembles.fit_boosted(rows, 4, [0, 2], [0.1, 0.2], ensembles.FOLD_EVERY + 1, b) for b in (RESIDUAL, SECOND_ORDER)]
        stumps = adaboost.fit_adaboost_sets(rows, names, [0, 1, 2], adaboost.FOLD_EVERY + 1)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup("rest", "rest")
        return boosted, stumps, jobs

    boosted, stumps, jobs = all_of("few")
    assert jobs < 40
    monkeypatch.setattr(splits, "LOCAL_ROWS", 100)
    wide, wide_stumps, wide_jobs = all_of("many")
    assert wide_jobs > 3 * jobs
    for a, b in zip(boosted, wide, strict=True):
        assert set(a) == set(b)
        for key, model in a.items():
            assert model.base == b[key].base and len(model.trees) == len(b[key].trees)
            assert np.allclose(model.scorer()(x), b[key].scorer()(x), atol=1e-9)
            assert [t.feature for t in model.trees] == [t.feature for t in b[key].trees]
    assert [[(s.feature, s.threshold, s.left, s.right) for s in run] for run in stumps] == [[(s.feature, s.threshold, s.left, s.right) for s in run] for run in wide_stumps]
    rows.unpersist()
