"""Grid search of the five classifiers and the model report.

A search grows all its models together: every fold's and the whole data's, for every learning rate and criterion, share
the passes over the rows. Longer runs contain the shorter ones, so 50 and 100 trees or rounds are one run. One pass
over the rows then measures all choices on their folds, and the fit on all rows is already there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

from pyspark.sql import DataFrame, SparkSession

from lurescope.contract import SPLIT_SEED
from lurescope.operators.adaboost import as_ensemble, fit_adaboost_sets
from lurescope.operators.classify import RiskModel
from lurescope.operators.ensembles import RESIDUAL, SECOND_ORDER, Ensemble, fit_boosted, fit_forests, fit_trees, fold_accuracy
from lurescope.operators.metrics import classification_metrics
from lurescope.operators.patterns import distinct_rows, training_sets
from lurescope.operators.splits import ENTROPY, GINI
from lurescope.session import stored

# --- Fixed values: model order and published hyper-parameter grids ----------
GRIDS = {
    "RandomForest": {"numTrees": [50, 100]},
    "DecisionTree": {"impurity": ["gini", "entropy"]},
    "GradientBoosting": {"stepSize": [0.1, 0.05], "maxIter": [50, 100]},
    "AdaBoost": {"rounds": [50, 100]},
    "SecondOrderBoosting": {"stepSize": [0.1, 0.2], "maxIter": [50, 100]},
}
FOLDS = 3
# --- end of fixed values ----------------------------------------------------

@dataclass
class Trained:
    name: str
    ordinal: int
    model: RiskModel
    params: dict
    train: dict = field(default_factory=dict)
    test: dict = field(default_factory=dict)


def _fitted(name: str, rows: DataFrame, columns: list[str], grid: dict, sets: list[int]) -> dict[tuple[int, int], object]:
    """Every choice of the grid on every training set: (choice, set) -> stumps or ensemble."""
    width = len(columns)
    choices = list(product(*grid.values()))
    at = {p: i for i, p in enumerate(grid)}
    fitted: dict[tuple[int, int], object] = {}
    if name == "AdaBoost":
        runs = fit_adaboost_sets(rows, columns, sets, max(grid["rounds"]))
        return {(c, s): run[: choice[at["rounds"]]] for s, run in zip(sets, runs, strict=True) for c, choice in enumerate(choices)}
    if name == "RandomForest":
        forests = fit_forests(rows, width, sets, max(grid["numTrees"]), GINI, SPLIT_SEED)
        for s, forest in zip(sets, forests, strict=True):
            fitted |= {(c, s): Ensemble("mean", forest[: choice[at["numTrees"]]]) for c, choice in enumerate(choices)}
        return fitted
    if name == "DecisionTree":
        for c, choice in enumerate(choices):
            trees = fit_trees(rows, width, sets, {"gini": GINI, "entropy": ENTROPY}[choice[at["impurity"]]])
            fitted |= {(c, s): Ensemble("mean", [tree]) for s, tree in zip(sets, trees, strict=True)}
        return fitted
    boosting = {"GradientBoosting": RESIDUAL, "SecondOrderBoosting": SECOND_ORDER}[name]
    runs = fit_boosted(rows, width, sets, grid["stepSize"], max(grid["maxIter"]), boosting)
    for c, choice in enumerate(choices):
        fitted |= {(c, s): runs[choice[at["stepSize"]], s].first(choice[at["maxIter"]]) for s in sets}
    return fitted


def search(name: str, rows: DataFrame, columns: list[str], grid: dict, folds: int) -> tuple[object, dict, dict[int, float]]:
    """(the best choice fitted on all rows, its parameters, mean fold accuracy per choice).

    ``rows``: :func:`patterns.training_sets`. The first of equally accurate choices wins; a grid of one choice is
    only fitted on all rows.
    """
    choices = list(product(*grid.values()))
    alone = len(choices) == 1
    fitted = _fitted(name, rows, columns, grid, [folds] if alone else list(range(folds + 1)))
    scores: dict[int, float] = {}
    if not alone:
        held = {k: as_ensemble(m, columns) if isinstance(m, list) else m for k, m in fitted.items() if k[1] < folds}
        scores = fold_accuracy(rows, folds, held)
    best = max(range(len(choices)), key=lambda c: (scores.get(c, 0.0), -c))
    return fitted[best, folds], dict(zip(grid, choices[best], strict=True)), scores


def train_models(
    train: DataFrame,
    test: DataFrame,
    columns: list[str],
    label: str,
    grids: dict[str, dict] | None = None,
    folds: int = FOLDS,
) -> list[Trained]:
    """Tune every model by CV accuracy, refit it on all training rows and measure it.

    ``train`` and ``test`` are preprocessed rows. They are counted into distinct rows
    once; all fits, folds and metrics then run on those.
    """
    grids = grids or GRIDS
    whole = stored(distinct_rows(train, columns, label))
    held = stored(distinct_rows(test, columns, label))
    sets = stored(training_sets(whole, columns, folds))
    results = []
    for ordinal, (name, grid) in enumerate(grids.items()):
        fitted, params, _ = search(name, sets, columns, grid, folds)
        trained = Trained(name, ordinal, RiskModel(columns, None, fitted), params)
        trained.train, trained.test = _measure(trained.model, whole), _measure(trained.model, held)
        results.append(trained)
    return results


def _measure(model: RiskModel, rows: DataFrame) -> dict:
    scored = model.predict_prepared(rows)
    return classification_metrics(scored, "label", "prediction", weight="copies").first().asDict()


def model_report(spark: SparkSession, results: list[Trained]) -> DataFrame:
    """(model, ordinal, train_f1, test_f1, params, …), one row per model."""
    rows = [
        (
            r.name,
            r.ordinal,
            r.train["f1"],
            r.test["f1"],
            {k: str(v) for k, v in r.params.items()},
            r.train["accuracy"],
            r.test["accuracy"],
            r.test["precision"],
            r.test["recall"],
        )
        for r in results
    ]
    return spark.createDataFrame(
        rows,
        "model string, ordinal int, train_f1 double, test_f1 double, params map<string,string>, "
        "train_accuracy double, test_accuracy double, test_precision double, test_recall double",
    )
