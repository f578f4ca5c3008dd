"""Support-weighted classification metrics from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion_counts(
    df: DataFrame, label: str, prediction: str, by: list[str] | None = None, weight: str | None = None
) -> DataFrame:
    """(…by, label, prediction, n): one small row per class pair, combined map-side.

    ``weight`` names the column with the number of copies when rows are distinct rows.
    """
    keys = [*(by or []), F.col(label).cast("double").alias("label"), F.col(prediction).cast("double").alias("prediction")]
    n = F.sum(F.col(weight).cast("bigint")) if weight else F.count(F.lit(1))
    return df.groupBy(*keys).agg(n.alias("n"))


def weighted_metrics(confusion: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(…by, n_rows, accuracy, precision, recall, f1); empty denominators count as 0."""
    by = by or []
    n, none = F.col("n"), F.lit(0).cast("bigint")
    hit = F.when(F.col("label") == F.col("prediction"), n).otherwise(none)
    actual = F.struct(F.col("label").alias("cls"), n.alias("support"), none.alias("predicted"), hit.alias("tp"))
    guess = F.struct(F.col("prediction").alias("cls"), none.alias("support"), n.alias("predicted"), none.alias("tp"))
    classes = (
        confusion.select(*by, F.explode(F.array(actual, guess)).alias("e"))
        .groupBy(*by, F.col("e.cls").alias("cls"))
        .agg(*[F.sum(f"e.{m}").alias(m) for m in ("support", "predicted", "tp")])
    )
    zero = F.lit(0.0)

    def weighted(value: Column) -> Column:
        return F.try_divide(F.sum(F.col("support") * F.coalesce(value, zero)), F.sum("support"))

    return classes.groupBy(*by).agg(
        F.sum("support").alias("n_rows"),
        F.try_divide(F.sum("tp"), F.sum("support")).alias("accuracy"),
        weighted(F.try_divide("tp", "predicted")).alias("precision"),
        weighted(F.try_divide("tp", "support")).alias("recall"),
        weighted(F.try_divide(F.col("tp") * 2, F.col("support") + F.col("predicted"))).alias("f1"),
    )


def classification_metrics(
    df: DataFrame, label: str, prediction: str, by: list[str] | None = None, weight: str | None = None
) -> DataFrame:
    return weighted_metrics(confusion_counts(df, label, prediction, by, weight), by)
