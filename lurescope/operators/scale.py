"""Robust scaling: (x - median) / IQR, where a zero IQR divides by one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.operators import distribution as dist


def fit_robust_scale(train: DataFrame, columns: list[str], copies: str | None = None) -> DataFrame:
    """(feature, median, iqr, scale), one row per column.

    ``copies`` names the count column when ``train`` holds distinct rows.
    """
    n = F.col(copies) if copies else None
    counts = dist.value_counts(train.withColumn("is_ref", F.lit(True)), columns, n)
    summary = dist.summarise(dist.cumulative_counts(counts), [0.25, 0.5, 0.75])
    q = [F.get("quantiles", F.lit(i)) for i in range(3)]
    iqr = q[2] - q[0]
    return summary.select(
        "feature", q[1].alias("median"), iqr.alias("iqr"), F.when(iqr == 0, 1.0).otherwise(iqr).alias("scale")
    )


def apply_robust_scale(df: DataFrame, params: DataFrame, columns: list[str]) -> DataFrame:
    """Scale ``columns``; the parameters are one row per column, read into literals."""
    fitted = {r["feature"]: (r["median"], r["scale"]) for r in params.select("feature", "median", "scale").collect()}
    return df.withColumns({c: (F.col(c) - fitted[c][0]) / fitted[c][1] for c in columns if c in fitted})
