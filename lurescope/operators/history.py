"""Newest-first reads of the logs and per-URL scan history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescope.contract import FEEDBACK_LIMIT, PAST_VERDICTS, RECENT_SCANS, RUN_LIMIT, SCAN_LIMIT
from lurescope.functions.reports import history_verdict
from lurescope.operators.features import features_from_json
from lurescope.plans.skew import salted_left_join


def _newest_first() -> list:
    return [F.col("created_at").desc(), F.col("id").desc()]


def newest(log: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` newest rows: each task keeps that many, one merges them."""
    return log.orderBy(*_newest_first()).limit(limit)


def scan_history(log: DataFrame, limit: int = SCAN_LIMIT) -> DataFrame:
    """Newest scans; ``features_map`` is null where the stored text is not JSON."""
    return newest(log, limit).withColumn("features_map", features_from_json(F.col("features")))


def feedback_history(log: DataFrame, limit: int = FEEDBACK_LIMIT) -> DataFrame:
    return newest(log, limit)


def run_history(log: DataFrame, limit: int = RUN_LIMIT) -> DataFrame:
    return newest(log, limit)


def url_history(log: DataFrame, url: str, recent_limit: int = RECENT_SCANS) -> DataFrame:
    """Scans of one URL among the ``recent_limit`` newest scans of all URLs.

    The limit comes first, as in the published lookup; older scans do not show.
    """
    return newest(log, recent_limit).where(F.col("url") == url)


def history_summary(log: DataFrame, recent_limit: int | None = RECENT_SCANS) -> DataFrame:
    """(url, previous_scans, past_verdicts): count and the five newest verdicts.

    As in the published lookup, only the ``recent_limit`` newest scans of all URLs are looked at;
    None looks at the whole log, which is what a table of URLs wants.

    Counting combines map-side, and the rank filter lets every task drop all but five
    rows per URL before the shuffle, so a URL with a third of all scans stays cheap.
    """
    scans = log.select("url", "created_at", "id", "prediction")
    scans = newest(scans, recent_limit) if recent_limit is not None else scans
    rank = F.row_number().over(Window.partitionBy("url").orderBy(*_newest_first()))
    recent = (
        scans.withColumn("rank", rank)
        .where(F.col("rank") <= PAST_VERDICTS)
        .groupBy("url")
        .agg(F.array_sort(F.collect_list(F.struct("rank", history_verdict(F.col("prediction")).alias("v")))).alias("r"))
        .select("url", F.slice(F.transform("r", lambda x: x["v"]), 1, PAST_VERDICTS).alias("past_verdicts"))
    )
    counts = scans.groupBy("url").agg(F.count(F.lit(1)).alias("previous_scans"))
    return counts.join(recent, "url")


def with_history(urls: DataFrame, log: DataFrame, recent_limit: int | None = RECENT_SCANS) -> DataFrame:
    """Left join of the history summary; URLs without scans get 0 and an empty list."""
    summary = history_summary(log, recent_limit)
    if urls.isStreaming:
        joined = urls.join(summary, "url", "left")
    else:
        joined = salted_left_join(urls, summary, "url", [c for c, t in urls.dtypes if "map<" not in t])
    return joined.withColumns(
        {
            "previous_scans": F.coalesce("previous_scans", F.lit(0)),
            "past_verdicts": F.coalesce("past_verdicts", F.array().cast("array<string>")),
        }
    )
