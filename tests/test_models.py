"""Metrics, gates, boosting, grid search and stored models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lurescope.operators import adaboost, gates, training
from lurescope.operators.classify import RiskModel, phishing_probability
from lurescope.operators.metrics import classification_metrics
from lurescope.operators.patterns import distinct_rows, training_sets, with_folds
from lurescope.session import shared_folder


@pytest.fixture(scope="module")
def gate_rows(spark):
    return spark.createDataFrame([(1, 1, 1), (1, 1, 1), (0, 0, 1), (0, 0, 1)], "y int, good int, bad int")


def test_candidate_beats_champion(gate_rows):
    row = gates.champion_gate(gate_rows, "y", "good", "bad", "2").first()
    assert row["accepted"] and row["promoted_version"] == "2" and row["candidate_f1"] == 1.0


def test_worse_candidate_is_rejected(gate_rows):
    row = gates.champion_gate(gate_rows, "y", "bad", "good", "2").first()
    assert not row["accepted"] and row["promoted_version"] is None


def test_first_model_and_tie_are_accepted(gate_rows):
    row = gates.champion_gate(gate_rows, "y", "good", None, "1").first()
    assert row["accepted"] and row["champion_f1"] == -1.0 and row["improvement"] == 1.0
    assert gates.champion_gate(gate_rows, "y", "bad", "bad", "1").first()["accepted"]
    assert not gates.champion_gate(gate_rows, "y", "bad", "bad", "1", 0.01).first()["accepted"]


def test_weighted_metrics_with_an_empty_class(gate_rows):
    m = classification_metrics(gate_rows, "y", "bad").first()
    assert (m["accuracy"], m["precision"], m["recall"]) == (0.5, 0.25, 0.5)
    assert m["f1"] == pytest.approx(1 / 3)
    weighted = gate_rows.withColumn("copies", F.lit(5))
    assert classification_metrics(weighted, "y", "bad", weight="copies").first()["n_rows"] == 20


def test_best_model_prefers_the_first_of_a_tie(spark):
    rows = [("A", 0, 0.99, 0.9), ("B", 1, 0.91, 0.95), ("C", 2, 0.95, 0.95), ("D", 3, 0.5, 0.5)]
    report = spark.createDataFrame(rows, "model string, ordinal int, train_f1 double, test_f1 double")
    best = gates.best_model(report).first()
    assert best["model"] == "B" and best["meets_minimum"] and not best["overfit"]
    poor = gates.best_model(report.where("model = 'D'")).first()
    assert not poor["meets_minimum"]


def test_stored_metric_gate(spark):
    candidates = spark.createDataFrame([(2, 0.9), (3, 0.8)], "version int, test_f1 double")
    champion = lambda tag: spark.createDataFrame([(1, tag)], "version int, test_f1 string")
    promote = lambda c: {r["version"]: r["promote"] for r in gates.stored_metric_gate(candidates, c).collect()}
    assert promote(champion("0.900000")) == {2: True, 3: False}
    assert promote(champion(None)) == {2: True, 3: True}
    assert promote(champion("1.0").limit(0)) == {2: True, 3: True}


def numpy_samme(x, y, rounds):
    """Independent row-wise boosting of depth-1 Gini trees."""
    w, out = np.full(len(y), 1 / len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(x.shape[1]):
            levels = np.unique(x[:, f])
            for t in (levels[:-1] + levels[1:]) / 2:
                left = x[:, f] <= t
                sides, impurity = [], 0.0
                for mask in (left, ~left):
                    a, b = w[mask & (y == 0)].sum(), w[mask & (y == 1)].sum()
                    sides.append(int(b > a))
                    impurity += a * b / (a + b)
                if best is None or impurity < best[0] - 1e-12:
                    best = (impurity, f, t, sides)
        _, f, t, sides = best
        wrong = np.where(x[:, f] <= t, *sides) != y
        error = w[wrong].sum() / w.sum()
        alpha = np.log((1 - error) / error)
        out.append((f, t, *sides, alpha))
        w = w * np.exp(alpha * wrong)
        w /= w.sum()
    return out


def test_adaboost_equals_row_wise_boosting(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, (400, 4)).astype(float)
    y = ((x @ np.array([1.0, -1.0, 0.5, 0.2]) + rng.normal(0, 0.7, 400)) > 0).astype(int)
    rows = [(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)]
    columns = list("abcd")
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y int")
    rounds = adaboost.FOLD_EVERY + 3  # across a checkpoint
    stumps = adaboost.fit_adaboost(distinct_rows(df, columns, "y"), columns, rounds)
    expected = numpy_samme(x, y, rounds)
    assert [(columns.index(s.feature), s.threshold, s.left, s.right) for s in stumps] == [e[:4] for e in expected]
    assert np.allclose([s.alpha for s in stumps], [e[4] for e in expected])
    again = adaboost.stumps_from_table(adaboost.stump_table(spark, stumps).repartition(3))
    assert again == stumps


def test_adaboost_stops_on_a_perfect_stump(spark):
    df = spark.createDataFrame([(0.0, 0, 5), (1.0, 1, 7)], "x double, label int, copies long")
    stumps = adaboost.fit_adaboost(df, ["x"], 10)
    assert len(stumps) == 1 and stumps[0].alpha == 1.0 and stumps[0].threshold == 0.5
    scored = adaboost.apply_adaboost(df, stumps).collect()
    assert all(r["prediction"] == r["label"] for r in scored)


def test_probabilities_fall_back_to_the_prediction(spark):
    df = spark.createDataFrame([(0.0,), (1.0,)], "prediction double")
    assert [r["p_phishing"] for r in phishing_probability(df).collect()] == [1.0, 0.0]


def separable(spark, n=600):
    rng = np.random.default_rng(1)
    x = rng.integers(-1, 2, (n, 3))
    rows = [(*map(float, r), int(r[0] + r[1] > 0)) for r in x]
    return spark.createDataFrame(rows, "a double, b double, c double, y int")


GRID = {
    "RandomForest": {"numTrees": [5]},
    "DecisionTree": {"impurity": ["gini", "entropy"]},
    "GradientBoosting": {"stepSize": [0.1], "maxIter": [3]},
    "AdaBoost": {"rounds": [2, 8]},
    "SecondOrderBoosting": {"stepSize": [0.2], "maxIter": [3]},
}


def test_grid_search_reports_every_model(spark):
    columns = ["a", "b", "c"]
    df = separable(spark)
    results = training.train_models(df, df, columns, "y", GRID)
    report = training.model_report(spark, results)
    assert [r["model"] for r in report.orderBy("ordinal").collect()] == list(GRID)
    best = gates.best_model(report).first()
    assert best["test_f1"] >= 0.95 and best["meets_minimum"]
    for r in results:
        path = shared_folder(spark, "model")
        r.model.save(spark, path)
        order = lambda d: [(x["prediction"], round(x["probability"][0], 9)) for x in d.orderBy(*columns).collect()]
        assert order(RiskModel.load(spark, path).predict(df)) == order(r.model.predict(df))


def test_full_grids_are_the_published_ones():
    sizes = {m: int(np.prod([len(v) for v in g.values()])) for m, g in training.GRIDS.items()}
    assert sum(sizes.values()) == 14 and training.FOLDS == 3


def test_adaboost_finds_thresholds_among_many_values(spark):
    """Ten thousand values of one column: no level is left out."""
    rng = np.random.default_rng(6)
    x = np.stack([rng.permutation(10_000) / 3, rng.integers(0, 4, 10_000)], axis=1).astype(float)
    y = ((x[:, 0] > 2345.6) ^ (rng.random(10_000) < 0.2)).astype(int)
    rows = [(*map(float, r), int(v)) for r, v in zip(x, y, strict=True)]
    df = spark.createDataFrame(rows, "a double, b double, y int")
    stumps = adaboost.fit_adaboost(distinct_rows(df, ["a", "b"], "y"), ["a", "b"], 3)
    # Running sums in plain numpy, one threshold between any two neighbouring values.
    w = np.full(len(y), 1.0)
    for s in stumps:
        best = None
        for f in (0, 1):
            order = np.argsort(x[:, f], kind="stable")
            v, a, b = x[order, f], np.cumsum((w * (y == 0))[order]), np.cumsum((w * (y == 1))[order])
            cut = np.flatnonzero(v[1:] != v[:-1])
            p, q = a[-1] - a[cut], b[-1] - b[cut]
            impurity = a[cut] * b[cut] / (a[cut] + b[cut]) + p * q / (p + q)
            k = int(np.argmin(impurity))
            if best is None or impurity[k] < best[0] - 1e-9:
                best = (impurity[k], "ab"[f], (v[cut[k]] + v[cut[k] + 1]) / 2)
        assert (s.feature, s.threshold) == (best[1], pytest.approx(best[2]))
        vote = np.where(x[:, "ab".index(s.feature)] <= s.threshold, s.left, s.right)
        w = w * np.exp(s.alpha * (vote != y))


def test_stumps_as_trees_and_sets_in_lockstep(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, (300, 3)).astype(float)
    y = ((x @ np.array([1.0, -1.0, 0.5]) + rng.normal(0, 0.7, 300)) > 0).astype(int)
    copies = rng.integers(1, 4, (300, 2)).astype(float)
    rows = [(list(map(float, r)), float(v), list(map(float, c))) for r, v, c in zip(x, y, copies, strict=True)]
    df = spark.createDataFrame(rows, "values array<double>, label double, copies array<double>")
    both = adaboost.fit_adaboost_sets(df, list("abc"), [0, 1], 13)
    for s in (0, 1):
        alone = df.select(*[F.get("values", F.lit(i)).alias(c) for i, c in enumerate("abc")], "label", F.get("copies", F.lit(s)).alias("copies"))
        one = adaboost.fit_adaboost(alone, list("abc"), 13)
        assert [(t.feature, t.threshold, t.left, t.right) for t in one] == [(t.feature, t.threshold, t.left, t.right) for t in both[s]]
        scored = adaboost.apply_adaboost(alone, one).toPandas()
        p = adaboost.as_ensemble(one, list("abc")).scorer()(scored[list("abc")].to_numpy())
        assert np.allclose(p, [v[1] for v in scored["probability"]]) and ((p > 0.5) == (scored["prediction"] == 1)).all()


def test_training_sets_deal_like_the_folds(spark):
    columns = ["a", "b", "c"]
    whole = distinct_rows(separable(spark, 200), columns, "y")
    dealt = {(r["a"], r["b"], r["c"], r["label"], r["fold"]): r["copies"] for r in with_folds(whole, columns, 3).collect()}
    for r in training_sets(whole, columns, 3).collect():
        shares = [dealt.get((*r["values"], r["label"], k), 0) for k in range(3)]
        assert r["fold_copies"] == shares and r["copies"] == [sum(shares) - s for s in shares] + [sum(shares)]
