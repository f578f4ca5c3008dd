"""The two drift checks: the monitor (KS + PSI) and the dataset validation (KS only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.contract import DATASET_DRIFT_SHARE, KS_THRESHOLD, PSI_THRESHOLD, TARGET
from lurescope.operators import distribution as dist
from lurescope.session import stored


def common_features(reference: DataFrame, current: DataFrame, target: str = TARGET) -> list[str]:
    return [c for c in reference.columns if c != target and c in current.columns]


def drift_report_from_counts(
    counts: DataFrame,
    features: list[str],
    ks_threshold: float = KS_THRESHOLD,
    psi_threshold: float = PSI_THRESHOLD,
) -> DataFrame:
    """(feature, ks_p_value, psi, drifted), one row per feature.

    Thresholds see the exact figures; rounding comes after. A feature without values
    on one side has a null p and counts as not drifted.
    """
    # Read three times below, so it is stored once instead of being recounted.
    cumulative = stored(dist.cumulative_counts(counts))
    summary = dist.summarise(cumulative, dist.psi_shares())
    shift = dist.psi(cumulative, summary)
    # A feature that is null throughout leaves no counts; the list brings it back.
    listed = counts.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    joined = listed.join(F.broadcast(summary), "feature", "left").join(F.broadcast(shift), "feature", "left")
    moved = (F.col("ks_p") < ks_threshold) | (F.coalesce("psi", F.lit(0.0)) > psi_threshold)
    drifted = F.col("ks_p").isNotNull() & moved
    return joined.select(
        "feature",
        F.round("ks_p", 6).alias("ks_p_value"),
        F.round(F.coalesce("psi", F.lit(0.0)), 6).alias("psi"),
        drifted.alias("drifted"),
    )


def drift_report(
    reference: DataFrame,
    current: DataFrame | None = None,
    ks_threshold: float = KS_THRESHOLD,
    psi_threshold: float = PSI_THRESHOLD,
    target: str = TARGET,
) -> DataFrame:
    """Feature drift of ``current`` against ``reference`` (a self-check if absent)."""
    current = reference if current is None else current
    features = common_features(reference, current, target)
    counts = dist.value_counts(dist.both_sides(reference, current, features), features)
    return drift_report_from_counts(counts, features, ks_threshold, psi_threshold)


def drift_summary(report: DataFrame, with_rows: bool = False) -> DataFrame:
    """One row: how many features drifted and whether the dataset did.

    ``with_rows`` nests the report, which has one entry per feature.
    """
    n, hits = F.count(F.lit(1)), F.coalesce(F.sum(F.col("drifted").cast("bigint")), F.lit(0))
    extra = [F.array_sort(F.collect_list(F.struct(*report.columns))).alias("features")] if with_rows else []
    share = F.coalesce(F.try_divide("n_drifted", "n_features"), F.lit(0.0))
    summary = report.agg(n.alias("n_features"), hits.alias("n_drifted"), *extra)
    return summary.select(
        "n_features",
        "n_drifted",
        F.round(share, 4).alias("drift_share"),
        (share >= DATASET_DRIFT_SHARE).alias("dataset_drift"),
        *[F.col("features") for _ in extra],
    )


def validation_drift_from_counts(counts: DataFrame, columns: list[str], threshold: float = KS_THRESHOLD) -> DataFrame:
    """(column_name, p_value, drift_status); a column with a missing entry has no p."""
    gaps = counts.groupBy("feature").agg(F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)).alias("gaps"))
    ks = dist.summarise(dist.cumulative_counts(counts), [])
    listed = counts.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    joined = listed.join(F.broadcast(gaps), "feature", "left").join(F.broadcast(ks), "feature", "left")
    p = F.when(F.col("gaps") == 0, F.col("ks_p"))
    return joined.select(
        F.col("feature").alias("column_name"),
        p.alias("p_value"),
        F.coalesce(p < threshold, F.lit(False)).alias("drift_status"),
    )


def validation_drift(base: DataFrame, current: DataFrame, threshold: float = KS_THRESHOLD) -> DataFrame:
    """KS per base column, target included; base columns missing from current have no p."""
    shared = [c for c in base.columns if c in current.columns]
    missing = [c for c in base.columns if c not in current.columns]
    counts = dist.value_counts(dist.both_sides(base, current, shared), shared)
    report = validation_drift_from_counts(counts, shared, threshold)
    if not missing:
        return report
    rows = [(c, None, False) for c in missing]
    absent = base.sparkSession.createDataFrame(rows, "column_name string, p_value double, drift_status boolean")
    return report.unionByName(absent)


def drift_free(report: DataFrame) -> DataFrame:
    """One row: true when no column drifted."""
    return report.agg((~F.coalesce(F.bool_or("drift_status"), F.lit(False))).alias("drift_free"))
