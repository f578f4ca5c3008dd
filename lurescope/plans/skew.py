"""Left join that stays balanced when a few keys hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 64
TRACKED_KEYS = 4096


def hot_keys(df: DataFrame, key: str, share: float = 0.01):
    """Scalar subquery: the keys that hold at least ``share`` of the rows.

    A mergeable sketch finds them in one map-side pass, so only sketches move.
    At most ``HOT_KEYS`` keys come back, whatever the size of the table.
    """
    sketch = df.agg(
        F.expr(f"approx_top_k(`{key}`, {HOT_KEYS}, {TRACKED_KEYS})").alias("top"), F.count(F.lit(1)).alias("n")
    )
    frequent = F.filter(F.col("top"), lambda x: x["count"] >= F.col("n") * share)
    return sketch.select(F.transform(frequent, lambda x: x["item"]).alias("hot")).scalar()


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread_by: list[str], salts: int = 32) -> DataFrame:
    """``left LEFT JOIN right USING (key)`` with hot keys spread over ``salts`` tasks.

    ``right`` holds one row per key (a dimension). Rows of a hot key get a salt
    from ``spread_by``; the matching dimension rows are repeated once per salt,
    all other rows keep salt 0. No hint is given: a dimension below the session's
    broadcast threshold is still broadcast by the planner from its measured size.
    """
    hot = hot_keys(left.select(key), key)
    is_hot = F.coalesce(F.array_contains(hot, F.col(key)), F.lit(False))
    # The input partition is part of the hash, so even whole copies of a row spread,
    # and a retried task gives its rows the same salts again.
    mixed = F.xxhash64(F.spark_partition_id(), *spread_by)
    salt = F.when(is_hot, F.pmod(mixed, F.lit(salts))).otherwise(F.lit(0)).cast("int")
    repeated = F.explode(F.sequence(F.lit(0), F.when(is_hot, salts - 1).otherwise(0)))
    return (
        left.withColumn("_salt", salt)
        .join(right.withColumn("_salt", repeated), [key, "_salt"], "left")
        .drop("_salt")
    )
