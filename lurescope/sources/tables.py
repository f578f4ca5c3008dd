"""Dataset scans and run-time choice of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.contract import DATASET_SCHEMA


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table; naive timestamps are read as UTC instants."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    naive = [c for c, t in df.dtypes if t == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def read_dataset(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A labelled dataset. CSV keeps its own header, so a wrong column count shows.

    Reading fails when the path does not exist.
    """
    fmt = fmt or ("csv" if path.endswith(".csv") else "parquet")
    if fmt == "csv":
        return spark.read.option("header", True).option("inferSchema", True).csv(path)
    return spark.read.format(fmt).load(path)


def conform(df: DataFrame) -> DataFrame:
    """Cast the contract columns to the contract types, in contract order."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DATASET_SCHEMA])


def read_drift_inputs(spark: SparkSession, reference: str, current: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides of a drift run; without ``current`` the run is a self-check."""
    base = read_dataset(spark, reference)
    return base, read_dataset(spark, current) if current else base


def url_column(df: DataFrame, column: str = "url") -> DataFrame:
    """URLs to scan; works for a table and for a stream."""
    return df.select(F.col(column).alias("url"))
