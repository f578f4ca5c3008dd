"""Distributions of many columns at once, for a reference and a current side.

Every operator here starts from one table of value counts per feature. Counting
combines map-side, so a value that fills a third of the rows costs one row per task.
The running counts are built in range chunks, so no feature is sorted in one task
however many distinct values it has. The KS statistic, exact quantiles, histogram
counts and PSI are all read off that table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lurescope.contract import PSI_BUCKETS
from lurescope.functions.stats import ks_p_value, psi_term, with_rank_in_edges

MAX_CHUNKS = 1024
SKETCH_ACCURACY = 10000


def number(df: DataFrame, column: str) -> Column:
    """The column as double; what is no number counts as missing."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.NumericType | T.BooleanType | T.StringType):
        return F.col(f"`{column}`").try_cast("double").alias(column)
    return F.lit(None).cast("double").alias(column)


def both_sides(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """The two datasets under one schema, told apart by ``is_ref``."""

    def side(df: DataFrame, is_ref: bool) -> DataFrame:
        return df.select(*[number(df, c) for c in columns], F.lit(is_ref).alias("is_ref"))

    return side(reference, True).unionByName(side(current, False))


def value_counts(df: DataFrame, columns: list[str], copies: Column | None = None) -> DataFrame:
    """(feature, value, n_ref, n_cur) of rows with an ``is_ref`` flag.

    ``value`` is null for missing entries. ``copies`` is set when a row stands for
    several equal ones.
    """
    n = F.lit(1) if copies is None else copies
    wide = df.select(*[number(df, c) for c in columns], "is_ref", n.cast("bigint").alias("n"))
    # ``stack`` rather than ``unpivot``: its copies in one plan stay equal to Spark, so
    # all readers of the counts share one scan and one shuffle.
    pairs = [part for c in columns for part in (F.lit(c), F.col(c))]
    long = wide.select("is_ref", "n", F.stack(F.lit(len(columns)), *pairs).alias("feature", "value"))
    value = F.when(~F.isnan("value"), F.col("value"))
    return (
        long.withColumn("value", value)
        .groupBy("feature", "value")
        .agg(
            F.sum(F.when(F.col("is_ref"), F.col("n")).otherwise(0)).alias("n_ref"),
            F.sum(F.when(F.col("is_ref"), 0).otherwise(F.col("n"))).alias("n_cur"),
        )
    )


def chunk_count(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(8, min(MAX_CHUNKS, partitions))


def cumulative_counts(counts: DataFrame) -> DataFrame:
    """Add running counts (``cum_ref``, ``cum_cur``) and totals per feature.

    Chunk borders are sketch quantiles of the distinct values, at most ``MAX_CHUNKS``
    per feature. Sums of whole chunks give each chunk its offset, and a window inside
    (feature, chunk) does the rest. Borders only balance the work: any borders give
    the same counts. The three broadcasts hold features x chunks rows at most.
    """
    chunks = chunk_count(counts)
    present = counts.where(F.col("value").isNotNull())
    cuts = [i / chunks for i in range(1, chunks)]
    borders = (
        # The always-true count filter keeps both counts in this branch, so that all
        # readers of the counts share one shuffle.
        present.where(F.col("n_ref") + F.col("n_cur") > 0)
        .groupBy("feature")
        .agg(F.percentile_approx("value", cuts, SKETCH_ACCURACY).alias("borders"))
    )
    bordered = present.join(F.broadcast(borders), "feature")
    located = with_rank_in_edges(bordered, "borders", "value", chunks, "chunk").drop("borders")
    per_chunk = located.groupBy("feature", "chunk").agg(F.sum("n_ref").alias("c_ref"), F.sum("n_cur").alias("c_cur"))
    before = Window.partitionBy("feature").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("feature")
    offsets = per_chunk.select(
        "feature",
        "chunk",
        F.coalesce(F.sum("c_ref").over(before), F.lit(0)).alias("o_ref"),
        F.coalesce(F.sum("c_cur").over(before), F.lit(0)).alias("o_cur"),
        F.sum("c_ref").over(whole).alias("tot_ref"),
        F.sum("c_cur").over(whole).alias("tot_cur"),
    )
    running = Window.partitionBy("feature", "chunk").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    return located.join(F.broadcast(offsets), ["feature", "chunk"]).select(
        "feature",
        "value",
        "n_ref",
        "n_cur",
        (F.col("o_ref") + F.sum("n_ref").over(running)).alias("cum_ref"),
        (F.col("o_cur") + F.sum("n_cur").over(running)).alias("cum_cur"),
        "tot_ref",
        "tot_cur",
    )


def _order_statistic(rank: Column) -> Column:
    """The reference value at a 0-based rank, inside a per-feature aggregate."""
    covers = (F.col("cum_ref") - F.col("n_ref") <= rank) & (rank < F.col("cum_ref"))
    return F.max(F.when(covers, F.col("value")))


def summarise(cumulative: DataFrame, shares: list[float]) -> DataFrame:
    """(feature, n_ref, n_cur, ks_d, ks_p, quantiles), all in one aggregate.

    ``quantiles`` are the exact, linearly interpolated quantiles of the reference
    side. Each needs the values at two ranks, which are conditional maxima over the
    running counts. KS figures are null when a side is empty.
    """
    gap = F.abs(F.try_divide("cum_ref", "tot_ref") - F.try_divide("cum_cur", "tot_cur"))
    ranks = []
    for i, share in enumerate(shares):
        position = F.lit(share) * (F.col("tot_ref") - 1)
        ranks.append(_order_statistic(F.floor(position)).alias(f"lo{i}"))
        ranks.append(_order_statistic(F.ceil(position)).alias(f"hi{i}"))
    found = cumulative.groupBy("feature").agg(
        F.max("tot_ref").alias("n_ref"), F.max("tot_cur").alias("n_cur"), F.max(gap).alias("ks_d"), *ranks
    )
    interpolated = []
    for i, share in enumerate(shares):
        position = F.lit(share) * (F.col("n_ref") - 1)
        lo, hi = F.col(f"lo{i}"), F.col(f"hi{i}")
        interpolated.append(lo + (hi - lo) * (position - F.floor(position)))
    return found.select(
        "feature",
        "n_ref",
        "n_cur",
        "ks_d",
        ks_p_value(F.col("ks_d"), F.col("n_ref"), F.col("n_cur")).alias("ks_p"),
        (F.array(*interpolated) if shares else F.array().cast("array<double>")).alias("quantiles"),
    )


def psi_shares(buckets: int = PSI_BUCKETS) -> list[float]:
    return [i / buckets for i in range(buckets + 1)]


def psi_edges(summary: DataFrame) -> DataFrame:
    """(feature, edges): deduplicated quantile edges of the reference side."""
    edges = F.array_sort(F.array_distinct(F.filter("quantiles", lambda q: q.isNotNull())))
    return summary.select("feature", edges.alias("edges"))


def histogram(cumulative: DataFrame, edges: DataFrame, buckets: int = PSI_BUCKETS) -> DataFrame:
    """(feature, bin, n_ref, n_cur) over the edges; values outside them are left out.

    Bins are right-open but for the last one. Empty bins have no row. The edges are
    at most ``buckets`` + 1 numbers per feature, hence the broadcast.
    """
    placed = cumulative.join(F.broadcast(edges.where(F.size("edges") >= 3)), "feature")
    inside = placed.where(F.col("value").between(F.get("edges", F.lit(0)), F.element_at("edges", -1)))
    ranked = with_rank_in_edges(inside, "edges", "value", buckets + 1, "rank")
    binned = ranked.withColumn("bin", F.least(F.col("rank"), F.size("edges") - 1))
    return binned.groupBy("feature", "bin").agg(F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur"))


def psi(cumulative: DataFrame, summary: DataFrame, buckets: int = PSI_BUCKETS) -> DataFrame:
    """(feature, psi); no row where the reference has too few distinct edges to bin."""
    hist = histogram(cumulative, psi_edges(summary), buckets)
    whole = Window.partitionBy("feature")  # at most ``buckets`` rows per feature

    def share(n: str) -> Column:
        return F.col(n) / F.greatest(F.sum(n).over(whole), F.lit(1))

    terms = hist.select("feature", psi_term(share("n_ref"), share("n_cur")).alias("term"))
    return terms.groupBy("feature").agg(F.sum("term").alias("psi"))
