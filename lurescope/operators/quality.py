"""Dataset contract check and the seeded train/test split."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lurescope.contract import DATASET_SCHEMA, SPLIT_SEED, TEST_SHARE

HASH_PREFIX = 4  # hex digits, so at most 65,536 prefix counts


def column_count_ok(df: DataFrame, expected: int = len(DATASET_SCHEMA)) -> bool:
    return len(df.columns) == expected


def contract_verdict(splits: dict[str, DataFrame], expected: int = len(DATASET_SCHEMA)) -> DataFrame:
    """(split, expected_columns, actual_columns, ok, dataset_ok), from the schemas alone."""
    spark = next(iter(splits.values())).sparkSession
    checks = [(name, expected, len(df.columns), column_count_ok(df, expected)) for name, df in splits.items()]
    all_ok = all(ok for *_, ok in checks)
    return spark.createDataFrame(
        [(*row, all_ok) for row in checks],
        "split string, expected_columns int, actual_columns int, ok boolean, dataset_ok boolean",
    )


def split_hash(key: str, seed: int = SPLIT_SEED):
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(str(seed))))


def seeded_split(df: DataFrame, key: str, test_share: float = TEST_SHARE, seed: int = SPLIT_SEED) -> DataFrame:
    """Add ``is_test``: exactly ceil(share * n) rows, whatever the partitioning.

    Rows are ordered by the hash of a unique key. Counting hash prefixes finds the
    prefix in which the cut falls, and only that prefix's keys (one in 65,536) are
    ranked. The cut then is a scalar, so marking the rows takes no shuffle. Should a
    key repeat, its rows count as one entry and stay on one side.
    """
    hashed = df.select(F.col(key).alias("k"), split_hash(key, seed).alias("h"))
    prefix = F.substring("h", 1, HASH_PREFIX)
    per_prefix = hashed.groupBy(prefix.alias("p")).count()
    order = Window.orderBy("p")
    running = per_prefix.select(
        "p",
        F.col("count").alias("n"),
        F.sum("count").over(order).alias("upto"),
        F.sum("count").over(Window.partitionBy()).alias("total"),
    )
    wanted = F.ceil(F.col("total") * F.lit(test_share))
    cut = (
        running.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted))
        .select(F.struct("p", (wanted - F.col("upto") + F.col("n")).alias("rank")))
        .scalar()
    )
    keys = hashed.where(prefix == cut["p"]).groupBy("h", "k").agg(F.count(F.lit(1)).alias("n"))
    ranked = keys.withColumn("upto", F.sum("n").over(Window.orderBy("h", "k")))
    reaches = (F.col("upto") >= cut["rank"]) & (F.col("upto") - F.col("n") < cut["rank"])
    last = ranked.where(reaches).select(F.struct("h", "k")).scalar()
    mine = F.struct(split_hash(key, seed).alias("h"), F.col(key).alias("k"))
    return df.withColumn("is_test", F.coalesce(mine <= last, F.lit(False)))


def remap_label(df: DataFrame, target: str) -> DataFrame:
    """-1 becomes 0; every other value stays."""
    return df.replace(-1, 0, subset=[target])
