"""Structured Streaming jobs: scoring, feedback intake and drift of live traffic."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lurescope.contract import FEATURES, PAST_VERDICTS
from lurescope.functions.reports import history_verdict
from lurescope.operators.classify import Classifier
from lurescope.operators.drift import drift_report_from_counts
from lurescope.plans.jobs import score_urls
from lurescope.sources import logs


def read_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_per_batch: int = 1000) -> DataFrame:
    """A file stream; naive timestamps become UTC instants, as watermarks need."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(fmt).load(path)
    naive = [c for c, t in stream.dtypes if t == "timestamp_ntz"]
    return stream.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else stream


def _replace(df: DataFrame, path: str, batch_id: str) -> None:
    rows = df.withColumn("batch_id", F.lit(batch_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def score_stream(
    urls: DataFrame,
    classify: Classifier,
    root: str,
    checkpoint: str,
    dns: DataFrame | None = None,
    name: str = "scan",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Score each micro-batch into the scan log; unusable URLs go to ``rejected_urls``.

    A batch owns its log partition, so a batch repeated after a failure is stored once.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # two sinks read it
        scored, rejected = score_urls(batch, classify, dns)
        logs.log_scans(scored, root, f"{name}-{epoch:012d}")
        _replace(rejected, f"{root}/rejected_urls", f"{name}-{epoch:012d}")
        batch.unpersist()

    writer = urls.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def feedback_stream(
    feedback: DataFrame, root: str, checkpoint: str, name: str = "feedback", trigger: dict | None = None
) -> StreamingQuery:
    """Valid corrections go to the feedback log, the others to ``rejected_feedback``."""

    def work(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # two sinks read it
        rejects = logs.log_feedback(batch, root, f"{name}-{epoch:012d}")
        _replace(rejects, f"{root}/rejected_feedback", f"{name}-{epoch:012d}")
        batch.unpersist()

    writer = feedback.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def daily_counts(rows: DataFrame, columns: list[str], ts: str = "ts") -> DataFrame:
    """(day, feature, value, n) of a batch of rows."""
    values = [F.col(c).cast("double").alias(c) for c in columns]
    long = rows.select(F.to_date(ts).alias("day"), *values).unpivot(["day"], columns, "feature", "value")
    return long.groupBy("day", "feature", "value").agg(F.count(F.lit(1)).alias("n"))


def window_drift(reference_counts: DataFrame, window_counts: DataFrame, columns: list[str]) -> DataFrame:
    """Drift of the windows in ``window_counts`` (taken together) against a reference.

    ``reference_counts`` is (feature, value, n).
    """
    zero = F.lit(0).cast("bigint")
    reference = reference_counts.select("feature", "value", F.col("n").alias("n_ref"), zero.alias("n_cur"))
    current = window_counts.select("feature", "value", zero.alias("n_ref"), F.col("n").alias("n_cur"))
    counts = reference.unionByName(current).groupBy("feature", "value")
    return drift_report_from_counts(counts.agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")), columns)


def drift_stream(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    columns: list[str] | None = None,
    ts: str = "ts",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Count every micro-batch by day; days may come in any order and as late as they like.

    There is no watermark and no state: a batch stores its own counts under its own partition,
    so a repeated batch is stored once, and readers add the batches up.
    """

    def work(batch: DataFrame, epoch: int) -> None:
        _replace(daily_counts(batch, columns or FEATURES, ts), f"{root}/window_counts", f"{epoch:012d}")

    writer = stream.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stored_counts(spark: SparkSession, root: str) -> DataFrame:
    """(day, feature, value, n) over all batches."""
    return spark.read.parquet(f"{root}/window_counts").groupBy("day", "feature", "value").agg(F.sum("n").alias("n"))


def stored_drift(
    spark: SparkSession, root: str, reference_counts: DataFrame, columns: list[str], since: str | None = None
) -> DataFrame:
    """Drift report of the stored days (from ``since`` on) against the reference counts."""
    counts = stored_counts(spark, root)
    counts = counts.where(F.col("day") >= F.lit(since).cast("date")) if since else counts
    return window_drift(reference_counts, counts, columns)


#: Shares a day's rows are dealt to: a day with a third of all rows is counted by as many tasks.
DAY_SHARES = 16


def _fold_days(columns: list[str]):
    """State worker of one (day, share): its counts while the day is open, the number of rows that came later."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        closed = pd.isna(key[0]) or key[0] <= state.getCurrentWatermarkMs()
        counts = {(c, v): n for c, v, n in json.loads(state.get[0])} if state.exists else {}
        late = 0
        for batch in batches:
            if closed:
                late += len(batch)
                continue
            for c in columns:
                for value, n in batch[c].value_counts(dropna=False).items():
                    place = (c, None if pd.isna(value) else float(value))
                    counts[place] = counts.get(place, 0) + int(n)
        kept = json.dumps([[c, v, n] for (c, v), n in counts.items()])
        if not closed:
            state.update((kept,))
        elif state.exists:
            state.remove()  # the stored counts of the day are final
        named = None if closed else json.dumps([{"feature": c, "value": v, "n": n} for (c, v), n in counts.items()])
        yield pd.DataFrame({"day_end": [None if pd.isna(key[0]) else key[0]], "share": [key[1]], "counts": [named], "n_late": [late]}).astype({"day_end": "Int64"})

    return fold


def event_time_drift_stream(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    columns: list[str] | None = None,
    ts: str = "ts",
    lateness: str = "1 day",
    shares: int = DAY_SHARES,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Count rows by day of their event time as state of the stream; a day closes when the watermark passes its end.

    The watermark trails the newest event time of earlier batches by ``lateness``. Rows of open days change the day's
    counts however late they are; rows of closed days change nothing and are counted in a side table, read by
    :func:`late_rows`. Counted and late rows add up to all rows. Rows without a time belong to no day and count as late.
    Columns are counted value by value: pass continuous ones through ``sketch_value``, so that a day's state is bounded.
    A batch stores the days it changed under its own partition, so a repeated batch is stored once.
    """
    columns = columns or FEATURES
    day_end = F.unix_millis(F.date_trunc("day", ts) + F.expr("INTERVAL 1 DAY"))
    share = F.pmod(F.xxhash64(ts, *columns), F.lit(shares)).cast("int")
    rows = stream.withWatermark(ts, lateness).select(
        day_end.alias("_day_end"), share.alias("_share"), ts, *[F.col(c).cast("double").alias(c) for c in columns]
    )
    out = "day_end long, share int, counts string, n_late long"
    stream.sparkSession.createDataFrame([], out + ", batch_id string").write.mode("ignore").partitionBy("batch_id").parquet(f"{root}/event_days")
    days = rows.groupBy("_day_end", "_share").applyInPandasWithState(_fold_days(columns), out, "counts string", "update", GroupStateTimeout.NoTimeout)

    def work(batch: DataFrame, epoch: int) -> None:
        _replace(batch, f"{root}/event_days", f"{epoch:012d}")

    writer = days.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _event_days(spark: SparkSession, root: str) -> DataFrame:
    rows = spark.read.schema("day_end long, share int, counts string, n_late long, batch_id string").parquet(f"{root}/event_days")
    return rows.withColumn("day", F.to_date(F.timestamp_millis(F.col("day_end") - 1)))


def event_day_counts(spark: SparkSession, root: str) -> DataFrame:
    """(day, feature, value, n) as of the last batch, in the form :func:`window_drift` takes."""
    states = _event_days(spark, root).where("counts IS NOT NULL").groupBy("day", "share").agg(F.max_by("counts", "batch_id").alias("counts"))
    entries = states.select("day", F.inline(F.from_json("counts", "array<struct<feature: string, value: double, n: long>>")))
    return entries.groupBy("day", "feature", "value").agg(F.sum("n").alias("n"))


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """(day, n): rows that came after their day had closed; the null day holds rows without a time."""
    return _event_days(spark, root).where("n_late > 0").groupBy("day").agg(F.sum("n_late").alias("n"))


#: Shares the scans of a hot URL are dealt to: a URL with a third of all scans is folded by as many tasks.
HISTORY_SHARES = 16
#: A URL is hot where one part of a batch holds that many of its scans.
HOT_SCANS = 1000


def _newer(scan: tuple[Any, ...]) -> tuple:
    """Sorts as ``created_at`` and ``id`` do in the batch history: nulls are the oldest."""
    at, name = scan[:2]
    return at is not None, at or 0, name is not None, name or ""


def _newest_of_parts(shares: int):
    """Task: a part's newest scans of each URL, the first of them with the URL's number of scans; the others go no further."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            order = [("url", "ascending"), ("at", "descending"), ("id", "descending")]  # nulls last
            rows = pa.Table.from_batches([batch]).sort_by(order).combine_chunks()
            code = rows["url"].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            size = np.diff(np.append(first, len(code)))
            place = np.arange(len(code)) - np.repeat(first, size)
            number = np.where(place == 0, np.repeat(size, size), 0)
            hot = np.repeat(size >= HOT_SCANS, size)
            share = np.where(hot, np.repeat(rows["share"].to_numpy()[first], size), 0).astype(np.int32)
            kept = np.flatnonzero(place < PAST_VERDICTS)
            rows = rows.set_column(1, "share", pa.array(share)).append_column("n", pa.array(number.astype(np.int64))).take(kept)
            yield from rows.combine_chunks().to_batches()

    return run


def _fold_scans(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    n, newest = state.get if state.exists else (0, "[]")
    scans = json.loads(newest)
    for batch in batches:
        n += int(batch["n"].sum())
        scans += zip(*(batch[c].tolist() for c in ("at", "id", "verdict")), strict=True)
        scans = [(None if at is None or at != at else int(at), name, verdict) for at, name, verdict in scans]
        scans = heapq.nlargest(PAST_VERDICTS, scans, key=_newer)
    state.update((n, json.dumps(scans)))
    named = json.dumps([{"at": at, "id": name, "verdict": verdict} for at, name, verdict in scans])
    yield pd.DataFrame({"url": [key[0]], "share": [key[1]], "n": [n], "newest": [named]})


def history_stream(scans: DataFrame, root: str, checkpoint: str, shares: int = HISTORY_SHARES, trigger: dict | None = None) -> StreamingQuery:
    """Keep each URL's scan count and newest scans as state of the stream itself; ``live_history`` reads them.

    The state of a (URL, share) is a count and five scans, whatever its history. Scans may arrive in any order and at any
    time: counts add up and the five newest of parts contain the five newest of all. Parts of a batch are cut to those five
    before the shuffle, and only URLs that are hot in a part are dealt to shares: a state costs far more than a scan. A batch stores
    the states it changed under its own partition, so a repeated batch is stored once.
    """
    rows = scans.select(
        "url",
        F.pmod(F.xxhash64("id", "created_at"), F.lit(shares)).cast("int").alias("share"),
        F.unix_micros("created_at").alias("at"),
        F.col("id").cast("string").alias("id"),
        history_verdict(F.col("prediction")).alias("verdict"),
    )
    rows = rows.mapInArrow(_newest_of_parts(shares), "url string, share int, at long, id string, verdict string, n long")
    out = "url string, share int, n long, newest string"
    scans.sparkSession.createDataFrame([], out + ", batch_id string").write.mode("ignore").partitionBy("batch_id").parquet(f"{root}/url_history")
    states = rows.groupBy("url", "share").applyInPandasWithState(_fold_scans, out, "n long, newest string", "update", GroupStateTimeout.NoTimeout)

    def work(batch: DataFrame, epoch: int) -> None:
        _replace(batch, f"{root}/url_history", f"{epoch:012d}")

    writer = states.writeStream.outputMode("update").foreachBatch(work).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def live_history(spark: SparkSession, root: str) -> DataFrame:
    """(url, previous_scans, past_verdicts) as of the last batch, equal to the summary of the whole log."""
    rows = spark.read.schema("url string, share int, n long, newest string, batch_id string").parquet(f"{root}/url_history")
    latest = rows.groupBy("url", "share").agg(F.max_by(F.struct("n", "newest"), "batch_id").alias("s"))
    scans = F.from_json("s.newest", "array<struct<at: long, id: string, verdict: string>>")
    # At most five scans a share are gathered per URL.
    merged = latest.groupBy("url").agg(F.sum("s.n").alias("previous_scans"), F.flatten(F.collect_list(scans)).alias("scans"))
    newest = F.slice(F.sort_array("scans", asc=False), 1, PAST_VERDICTS)
    return merged.select("url", "previous_scans", F.transform(newest, lambda x: x["verdict"]).alias("past_verdicts"))
