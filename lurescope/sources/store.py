"""Stored results of the training job: one folder per kind, one partition per run.

Every write replaces only its own partition, so a repeated or retried stage leaves
one copy of its rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _write(df: DataFrame, path: str, *partitions: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*partitions).format(fmt).save(path)


def write_snapshot(df: DataFrame, root: str, run_id: str) -> None:
    """The raw rows of a run; ``row_id`` is fixed by being stored."""
    rows = df.withColumns({"row_id": F.monotonically_increasing_id(), "run_id": F.lit(run_id)})
    _write(rows, f"{root}/feature_store", "run_id")


def read_snapshot(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.parquet(f"{root}/feature_store").where(F.col("run_id") == run_id).drop("run_id")


def write_splits(df: DataFrame, root: str, run_id: str) -> None:
    split = F.when(F.col("is_test"), "test").otherwise("train")
    rows = df.withColumns({"split": split, "run_id": F.lit(run_id)}).drop("is_test")
    _write(rows, f"{root}/splits", "run_id", "split")


def read_split(spark: SparkSession, root: str, run_id: str, split: str, kind: str = "splits") -> DataFrame:
    rows = spark.read.parquet(f"{root}/{kind}")
    return rows.where((F.col("run_id") == run_id) & (F.col("split") == split)).drop("run_id", "split")


def route_splits(splits: dict[str, DataFrame], ok: bool, root: str, run_id: str) -> str:
    """Store the splits under ``valid`` or ``invalid`` and return which."""
    kind = "valid" if ok else "invalid"
    for name, df in splits.items():
        _write(df.withColumns({"split": F.lit(name), "run_id": F.lit(run_id)}), f"{root}/{kind}", "run_id", "split")
    return kind


def write_report(report: DataFrame, root: str, kind: str, run_id: str) -> str:
    """A small report as JSON lines."""
    path = f"{root}/{kind}"
    _write(report.withColumn("run_id", F.lit(run_id)).coalesce(1), path, "run_id", fmt="json")
    return path


def write_matrix(df: DataFrame, root: str, run_id: str, split: str) -> None:
    """Transformed features and label."""
    _write(df.withColumns({"split": F.lit(split), "run_id": F.lit(run_id)}), f"{root}/matrix", "run_id", "split")
