"""Model choice and the promotion gates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lurescope.contract import MIN_F1, MIN_IMPROVEMENT, OVERFIT_GAP
from lurescope.operators.metrics import weighted_metrics


def best_model(report: DataFrame, min_f1: float = MIN_F1, gap: float = OVERFIT_GAP) -> DataFrame:
    """The row of (model, ordinal, train_f1, test_f1, …) with the best test F1.

    The first declared model wins a tie. The choice looks at the test rows, as the
    published procedure does, so its F1 is an optimistic estimate.
    """
    row = F.struct(*report.columns)
    best = report.agg(F.max_by(row, F.struct(F.col("test_f1"), -F.col("ordinal"))).alias("best")).select("best.*")
    return best.withColumns(
        {
            "meets_minimum": F.col("test_f1") >= min_f1,
            "overfit": F.abs(F.col("train_f1") - F.col("test_f1")) > gap,
        }
    )


def champion_gate(
    scored: DataFrame,
    label: str,
    candidate: str,
    champion: str | None,
    candidate_version: str | None = None,
    min_improvement: float = MIN_IMPROVEMENT,
) -> DataFrame:
    """One row: does the candidate replace the champion on the same test rows?

    ``scored`` carries both predictions side by side, so one aggregate over the rows
    serves both F1s. Without a champion the candidate is accepted and the champion's
    F1 reads -1.
    """
    names = {"candidate": candidate} | ({"champion": champion} if champion else {})
    cells = scored.groupBy(
        F.col(label).cast("double").alias("label"), *[F.col(c).cast("double").alias(m) for m, c in names.items()]
    ).agg(F.count(F.lit(1)).alias("n"))
    long = cells.unpivot(["label", "n"], list(names), "model", "prediction")
    f1 = weighted_metrics(long, ["model"]).select("model", "f1")
    pair = f1.agg(
        F.max(F.when(F.col("model") == "candidate", F.col("f1"))).alias("candidate_f1"),
        F.max(F.when(F.col("model") == "champion", F.col("f1"))).alias("champion"),
    )
    improvement = F.col("candidate_f1") - F.coalesce("champion", F.lit(0.0))
    accepted = F.col("champion").isNull() | (improvement >= min_improvement)
    return pair.select(
        accepted.alias("accepted"),
        "candidate_f1",
        F.coalesce("champion", F.lit(-1.0)).alias("champion_f1"),
        improvement.alias("improvement"),
        F.when(accepted, F.lit(candidate_version)).cast("string").alias("promoted_version"),
    )


def stored_metric_gate(candidates: DataFrame, champion: DataFrame) -> DataFrame:
    """Add ``promote`` to (version, test_f1): compare with the champion's stored tag.

    ``champion`` holds at most one row with ``test_f1`` as text; a missing tag is 0,
    and without a champion row everything is promoted.
    """
    seen = champion.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"), F.max(F.coalesce(F.expr("try_cast(test_f1 AS double)"), F.lit(0.0))).alias("f1")
        )
    ).scalar()
    promote = (seen["n"] == 0) | (seen["f1"] < 0) | (F.col("test_f1") >= seen["f1"])
    return candidates.withColumn("promote", promote)
