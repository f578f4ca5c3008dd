"""Verdict, confidence and wording of a phishing probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.contract import MEDIUM_MARGIN, REVIEW_MARGIN


def prediction(p: Column) -> Column:
    """0 (phishing) above one half, else 1; null stays null."""
    return F.when(p > 0.5, 0).when(p.isNotNull(), 1)


def label_text(code: Column) -> Column:
    return F.when(code == 0, "phishing").when(code.isNotNull(), "safe")


def margin(p: Column) -> Column:
    return F.abs(p - 0.5)


def confidence(p: Column) -> Column:
    gap = margin(p)
    return F.when(gap < REVIEW_MARGIN, "LOW").when(gap < MEDIUM_MARGIN, "MEDIUM").when(gap.isNotNull(), "HIGH")


def with_verdict(df: DataFrame, p: str = "p_phishing") -> DataFrame:
    """Add prediction, label, rounded probability, confidence and the review flag."""
    code = prediction(F.col(p))
    return df.withColumns(
        {
            "prediction": code,
            "label": label_text(code),
            "phishing_probability": F.round(p, 4),
            "confidence": confidence(F.col(p)),
            "needs_review": margin(F.col(p)) < REVIEW_MARGIN,
        }
    )
