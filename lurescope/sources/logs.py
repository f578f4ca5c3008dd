"""Append-only scan, feedback and run logs.

A log is a Parquet folder partitioned by ``batch_id``. Each append owns one batch and
replaces only that partition, so a retried batch is stored once.

``compact_log`` folds batches into few large files in a folder of its own and then commits a manifest, which lists all
such folders. Readers take the newest manifest and, beside its folders, the batches it does not name. So they see every
batch once before, during and after; a compaction that fails or loses the race for the next manifest leaves files that nobody reads.
A batch that is written again after it was folded is the same batch and is passed over. ``vacuum_log`` deletes what the
manifest has replaced; call it when no reader that began before the compaction is still at work.
"""

from __future__ import annotations

import json
import math
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescope.contract import FEEDBACK_LOG, RUN_LOG, SCAN_LOG
from lurescope.operators.features import FEATURES, extract_features, features_json
from lurescope.operators.intake import check_intake, split_feedback
from lurescope.sources.markers import names, put_if_absent, read_text, remove

#: Rows of a file of folded batches.
ROWS_PER_FILE = 2_000_000
SCHEMAS = {"scan_history": SCAN_LOG, "feedback": FEEDBACK_LOG, "pipeline_runs": RUN_LOG}


def _schema(table: str) -> T.StructType:
    return T.StructType([*SCHEMAS[table].fields, T.StructField("batch_id", T.StringType())])


def ensure_logs(spark: SparkSession, root: str) -> None:
    """Create the log folders that are missing; existing ones are left alone."""
    for table in SCHEMAS:
        empty = spark.createDataFrame([], _schema(table))
        empty.write.mode("ignore").partitionBy("batch_id").parquet(f"{root}/{table}")


def _manifest(spark: SparkSession, root: str, table: str) -> tuple[int, list[str]]:
    """Number and folders of the newest manifest; 0 and none where nothing is folded."""
    commits = f"{root}/{table}_folded/commits"
    newest = max((int(n) for n in names(spark, commits)), default=0)
    return newest, json.loads(read_text(spark, f"{commits}/{newest}")) if newest else []


def _unfolded(spark: SparkSession, root: str, table: str, folders: list[str]) -> DataFrame:
    batches = spark.read.schema(_schema(table)).parquet(f"{root}/{table}")
    if not folders:
        return batches
    return batches.join(spark.read.schema("batch_id string").parquet(*[f"{f}/batches" for f in folders]), "batch_id", "left_anti")


def _folded(spark: SparkSession, table: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(_schema(table)).parquet(*[f"{f}/rows" for f in folders])


def read_log(spark: SparkSession, root: str, table: str) -> DataFrame:
    folders = [f"{root}/{table}_folded/{f}" for f in _manifest(spark, root, table)[1]]
    rows = _unfolded(spark, root, table, folders)
    return (rows.unionByName(_folded(spark, table, folders)) if folders else rows).drop("batch_id")


def compact_log(spark: SparkSession, root: str, table: str, rows_per_file: int = ROWS_PER_FILE, whole: bool = False) -> bool:
    """Fold the batches written since the last compaction; with ``whole``, earlier folders are merged in as well.

    False if there was nothing to fold or another compaction committed first.
    """
    number, before = _manifest(spark, root, table)
    paths = [f"{root}/{table}_folded/{f}" for f in before]
    # One listing of the files serves the rows and the batches: a batch that comes later is in neither.
    rows = _unfolded(spark, root, table, paths)
    if whole and before:
        rows = rows.unionByName(_folded(spark, table, paths))
    total = rows.count()
    if not total:
        return False
    name = f"part-{uuid.uuid4().hex}"
    path = f"{root}/{table}_folded/{name}"
    rows.repartition(math.ceil(total / rows_per_file)).write.parquet(f"{path}/rows")
    folded = rows.select("batch_id").distinct()
    if whole and before:
        folded = folded.union(spark.read.schema("batch_id string").parquet(*[f"{p}/batches" for p in paths])).distinct()
    folded.coalesce(1).write.parquet(f"{path}/batches")
    return put_if_absent(spark, f"{root}/{table}_folded/commits/{number + 1}", json.dumps([name] if whole else [*before, name]))


def vacuum_log(spark: SparkSession, root: str, table: str) -> int:
    """Delete the batches that are folded and the folders that no manifest lists any more; how many there were.

    Not to be run beside a compaction: the folder it writes is listed only at its end.
    """
    folders = _manifest(spark, root, table)[1]
    if not folders:
        return 0
    paths = [f"{root}/{table}_folded/{f}" for f in folders]
    done = {r.batch_id for r in spark.read.schema("batch_id string").parquet(*[f"{p}/batches" for p in paths]).toLocalIterator()}
    old = [f"{root}/{table}/{n}" for n in names(spark, f"{root}/{table}") if n.startswith("batch_id=") and unquote(n[9:]) in done]
    old += [f"{root}/{table}_folded/{n}" for n in names(spark, f"{root}/{table}_folded") if n.startswith("part-") and n not in folders]
    return sum(remove(spark, path) for path in old)


def append_log(rows: DataFrame, root: str, table: str, batch_id: str | None = None) -> str:
    """Append ``rows``; ``id`` and ``created_at`` are filled in where absent."""
    batch_id = batch_id or uuid.uuid4().hex
    if "id" not in rows.columns:
        number = F.lpad(F.monotonically_increasing_id().cast("string"), 19, "0")
        rows = rows.withColumn("id", F.concat(F.lit(batch_id + "-"), number))
    if "created_at" not in rows.columns:
        rows = rows.withColumn("created_at", F.current_timestamp())
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[table]]
    batch = rows.select(*typed, F.lit(batch_id).alias("batch_id"))
    writer = batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("batch_id").parquet(f"{root}/{table}")
    return batch_id


def log_scans(scored: DataFrame, root: str, batch_id: str | None = None, p: str = "p_phishing") -> str:
    """Append scored rows (30 codes, prediction, probability, ``ai_analysis``)."""
    rows = scored.withColumns({"probability": F.col(p), "features": features_json()})
    return append_log(rows, root, "scan_history", batch_id)


def prepare_feedback(feedback: DataFrame, dns: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(log rows with the features as JSON, rejects with ``reject_reason``)."""
    valid, bad_label = split_feedback(feedback)
    checked = check_intake(valid)
    # Feedback needs no URL text, but a URL that cannot be parsed cannot be featured.
    bad_url = checked.where(F.col("reject_reason") == "invalid_port")
    usable = checked.where(~F.col("reject_reason").eqNullSafe("invalid_port")).drop("reject_reason")
    rows = extract_features(usable, "url", dns).withColumn("features", features_json()).drop(*FEATURES)
    rejects = bad_label.withColumn("reject_reason", F.lit("invalid_label")).unionByName(bad_url)
    return rows, rejects


def log_feedback(feedback: DataFrame, root: str, batch_id: str | None = None, dns: DataFrame | None = None) -> DataFrame:
    """Append the accepted corrections and return the rejects."""
    rows, rejects = prepare_feedback(feedback, dns)
    append_log(rows, root, "feedback", batch_id)
    return rejects


def log_run(spark: SparkSession, root: str, run_id: str, accuracy: float, f1: float, model_path: str) -> str:
    row = spark.createDataFrame(
        [(run_id, accuracy, f1, model_path)], "run_id string, accuracy double, f1_score double, model_path string"
    )
    return append_log(row, root, "pipeline_runs", run_id)
