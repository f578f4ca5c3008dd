"""Batch jobs: training, drift and scoring."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.contract import FEATURES, MIN_F1, MIN_IMPROVEMENT, TARGET
from lurescope.functions.reports import investigation, with_report
from lurescope.operators import drift, gates, quality, training
from lurescope.operators.classify import Classifier, RiskModel
from lurescope.operators.dns import lookup_dns
from lurescope.operators.features import extract_features
from lurescope.operators.history import with_history
from lurescope.operators.intake import split_intake
from lurescope.operators.prepare import Preprocessor
from lurescope.session import stored
from lurescope.sources import catalog, logs, store
from lurescope.sources.tables import conform, read_dataset, read_drift_inputs


@dataclass
class TrainingResult:
    run_id: str
    best: str
    version: int
    accepted: bool | None
    report: DataFrame


def feedback_rows(feedback: DataFrame) -> DataFrame:
    """Logged corrections as labelled rows of the dataset contract."""
    from lurescope.operators.features import computed_once, features_from_json

    parsed = computed_once(feedback, f=features_from_json(F.col("features"))).where(F.col("f").isNotNull())
    columns = [F.coalesce(F.col(f"f.{c}"), F.lit(1)).cast("bigint").alias(c) for c in FEATURES]
    label = F.when(F.col("correct_label") == 0, -1).otherwise(1).cast("bigint")
    return parsed.select(*columns, label.alias(TARGET))


def run_training_job(
    spark: SparkSession,
    dataset_path: str,
    root: str,
    run_id: str,
    grids: dict | None = None,
    feedback: DataFrame | None = None,
    min_improvement: float = MIN_IMPROVEMENT,
) -> TrainingResult:
    """Ingest, check, prepare, train, gate. Stages hand over stored tables under ``root``.

    A dataset that breaks the contract is stored under ``invalid`` and ends the job.
    """
    store.write_snapshot(read_dataset(spark, dataset_path), root, run_id)
    snapshot = store.read_snapshot(spark, root, run_id)
    store.write_splits(quality.seeded_split(snapshot, "row_id"), root, run_id)
    splits = {s: store.read_split(spark, root, run_id, s).drop("row_id") for s in ("train", "test")}

    verdict = quality.contract_verdict(splits)
    ok = verdict.first()["dataset_ok"]
    # Routed before anything reads the values: rows of a broken dataset always reach ``invalid``.
    kind = store.route_splits(splits, ok, root, run_id)
    report = drift.validation_drift(splits["train"], splits["test"])
    store.write_report(report, root, "validation_drift", run_id)
    if not ok:
        raise ValueError(f"run {run_id}: the dataset breaks the column contract; rows are under {kind}/")

    labelled = {
        s: quality.remap_label(conform(store.read_split(spark, root, run_id, s, kind)), TARGET) for s in splits
    }
    if feedback is not None:
        extra = quality.remap_label(feedback_rows(feedback), TARGET)
        labelled["train"] = labelled["train"].unionByName(extra)
    prep = Preprocessor().fit(labelled["train"])
    for s, df in labelled.items():
        store.write_matrix(prep.transform(df), root, run_id, s)
    matrix = {s: store.read_split(spark, root, run_id, s, "matrix") for s in splits}

    results = training.train_models(matrix["train"], matrix["test"], FEATURES, TARGET, grids)
    models = training.model_report(spark, results)
    best = gates.best_model(models).first()
    store.write_report(models, root, "model_report", run_id)
    if not best["meets_minimum"]:
        raise ValueError(f"run {run_id}: best test F1 {best['test_f1']:.4f} is below {MIN_F1}")
    chosen = next(r for r in results if r.name == best["model"])
    model = RiskModel(FEATURES, prep, chosen.model.classifier)
    path = f"{root}/models/{run_id}"
    model.save(spark, path)
    version = catalog.register_version(spark, root, run_id, path)
    logs.ensure_logs(spark, root)
    logs.log_run(spark, root, run_id, chosen.test["accuracy"], chosen.test["f1"], path)
    accepted = evaluate_candidate(spark, root, version, labelled["test"], min_improvement)
    return TrainingResult(run_id, chosen.name, version, accepted, models)


def evaluate_candidate(
    spark: SparkSession, root: str, version: int, test: DataFrame, min_improvement: float = MIN_IMPROVEMENT
) -> bool:
    """Score candidate and champion on the same rows and move the alias if it wins."""
    candidate = load_version(spark, root, version)
    champion = load_champion(spark, root)
    scored = candidate.predict(test).withColumnRenamed("prediction", "candidate").drop("probability")
    if champion is not None:
        # Two models in one plan repeat each other's work; the first scores are stored.
        scored = champion.predict(stored(scored)).withColumnRenamed("prediction", "champion")
    names = ("candidate", "champion" if champion is not None else None)
    gate = gates.champion_gate(scored, TARGET, *names, str(version), min_improvement).first()
    if gate["accepted"]:
        catalog.set_production(spark, root, version, gate["candidate_f1"])
    return gate["accepted"]


def load_version(spark: SparkSession, root: str, version: int) -> RiskModel | None:
    row = catalog.read_versions(spark, root).where(
        (F.col("name") == catalog.MODEL_NAME) & (F.col("version") == version)
    ).first()
    return RiskModel.load(spark, row["model_path"]) if row else None


def load_champion(spark: SparkSession, root: str, fallback_path: str | None = None) -> RiskModel | None:
    """The production model; else a stored copy at ``fallback_path``, else none."""
    catalog.ensure_catalog(spark, root)
    versions, aliases = catalog.read_versions(spark, root), catalog.read_aliases(spark, root)
    row = catalog.production_info(versions, aliases).where(F.col("name") == catalog.MODEL_NAME).first()
    if row:
        return load_version(spark, root, row["version"])
    return RiskModel.load(spark, fallback_path) if fallback_path else None


def run_drift_job(spark: SparkSession, reference: str, current: str | None, root: str, run_id: str) -> DataFrame:
    """Drift of one dataset against another, stored as JSON rows and a JSON summary."""
    report = stored(drift.drift_report(*read_drift_inputs(spark, reference, current)))
    store.write_report(report, root, "drift_report", run_id)
    store.write_report(drift.drift_summary(report, with_rows=True), root, "drift_summary", run_id)
    return report


def score_urls(
    urls: DataFrame, classify: Classifier, dns: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """(scored rows with verdict and report, rejected rows) of a table of URLs."""
    accepted, rejected = split_intake(urls)
    scored = with_report(classify(extract_features(accepted, "url", dns)))
    return scored, rejected


def investigate_urls(
    urls: DataFrame,
    classify: Classifier | None,
    scans: DataFrame | None = None,
    dns: DataFrame | None = None,
    error: str = "",
) -> DataFrame:
    """The evidence of every URL side by side with the offline investigation text."""
    accepted, _ = split_intake(urls)
    rows = extract_features(accepted, "url", dns)
    if classify is not None:
        rows = classify(rows)
    else:
        rows = rows.withColumns(
            {"label": F.lit(None).cast("string"), "phishing_probability": F.lit(None).cast("double")}
        )
    if dns is not None:
        rows = lookup_dns(rows, dns)
    if scans is not None:
        rows = with_history(rows, scans, None)
    return investigation(rows, error=error)
