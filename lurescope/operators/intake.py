"""Intake checks of URLs and of human feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.functions.urls import trimmed
from lurescope.operators.features import with_url_parts


def _reject_reason(url: str) -> Column:
    empty = F.col(url).isNull() | (F.length(F.col(url)) == 0)
    return F.when(empty, "empty_url").when(F.col("parse_error") == "invalid_port", "invalid_port")


def check_intake(df: DataFrame, url: str = "url") -> DataFrame:
    """Trim the URL and add ``reject_reason`` (null for rows that can be scored)."""
    checked = with_url_parts(df.withColumn(url, trimmed(F.col(url))), url)
    return checked.withColumn("reject_reason", _reject_reason(url)).select(*df.columns, "reject_reason")


def split_intake(df: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) URLs; together they are the whole input."""
    checked = check_intake(df, url)
    accepted = checked.where(F.col("reject_reason").isNull()).drop("reject_reason")
    return accepted, checked.where(F.col("reject_reason").isNotNull())


def check_feedback(df: DataFrame) -> DataFrame:
    """Add ``accepted``; an absent predicted label becomes -1."""
    valid = F.coalesce(F.col("correct_label").isin(0, 1), F.lit(False))
    return df.withColumns(
        {"predicted_label": F.coalesce(F.col("predicted_label"), F.lit(-1)).cast("int"), "accepted": valid}
    )


def split_feedback(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    checked = check_feedback(df)
    return checked.where("accepted").drop("accepted"), checked.where("not accepted").drop("accepted")
