"""Distinct labelled rows with their counts, and folds over them.

Ternary data repeat heavily, so learners that accept weights see each distinct row
once. The counting combines map-side, hence a row that makes up a third of the data
is one record per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_rows(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """(columns…, label, copies)."""
    keys = [*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias("label")]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def with_folds(rows: DataFrame, columns: list[str], folds: int) -> DataFrame:
    """Deal the copies of each distinct row over ``fold`` = 0…folds-1.

    Every fold gets copies // folds, and the rest goes to folds counted from a hashed
    start. Label shares therefore agree across folds, without ranking any rows.
    """
    start = F.pmod(F.xxhash64(*columns, "label"), F.lit(folds))
    dealt = rows.withColumns({"fold": F.explode(F.sequence(F.lit(0), F.lit(folds - 1))), "_start": start})
    turn = F.pmod(F.col("fold") - F.col("_start"), F.lit(folds))
    share = F.floor((F.col("copies") + F.lit(folds - 1) - turn) / F.lit(folds)).cast("bigint")
    return dealt.withColumn("copies", share).where("copies > 0").drop("_start")


def training_sets(rows: DataFrame, columns: list[str], folds: int) -> DataFrame:
    """(values, label, copies, fold_copies): distinct rows with their counts in every training set of a search.

    ``fold_copies`` deals the copies over the folds as :func:`with_folds` does; ``copies`` holds the
    rest of each fold's data, and all of it in the last place.
    """
    start = F.pmod(F.xxhash64(*columns, "label"), F.lit(folds))
    turns = [F.pmod(F.lit(k) - start, F.lit(folds)) for k in range(folds)]
    shares = [F.floor((F.col("copies") + F.lit(folds - 1) - t) / F.lit(folds)).cast("double") for t in turns]
    total = F.col("copies").cast("double")
    return rows.select(
        F.array(*[F.col(c).cast("double") for c in columns]).alias("values"),
        F.col("label").cast("double").alias("label"),
        F.array(*[total - s for s in shares], total).alias("copies"),
        F.array(*shares).alias("fold_copies"),
    )


def bagging_units(rows: DataFrame, units: int = 32) -> DataFrame:
    """Split each distinct row into up to ``units`` equal shares with a ``weight``.

    A bagging learner draws records, so a heavy row must not be one record.
    """
    n = F.least(F.col("copies"), F.lit(units))
    return rows.withColumns({"weight": F.col("copies") / n, "_unit": F.explode(F.sequence(F.lit(1), n))}).drop("_unit")
