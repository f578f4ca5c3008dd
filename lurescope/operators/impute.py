"""Nearest-neighbour imputation over distinct rows.

The work follows the number of distinct rows, not of rows: donors are the distinct
training rows with their counts, receivers the distinct rows with gaps. Both are cut
into hash blocks of bounded size. Each (donor block, receiver block) tile keeps only
the few nearest donors per gap, so no pair list is ever written, and a window merges
the tiles exactly. Inside a tile an index of column ranges leaves out runs of donors that are too far for every gap. Ties are settled by the donor's values in column order.
"""

from __future__ import annotations

from functools import reduce
from math import ceil
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lurescope.contract import NEIGHBOURS
from lurescope.plans.skew import salted_left_join
from lurescope.session import stored

# A tile of two full blocks is 20,000 x 20,000 distances at most, taken ROW_STEP rows and a run of donors at a time.
DONOR_BLOCK = 20_000
RECEIVER_BLOCK = 20_000
SMALL_BLOCK = 256
ROW_STEP = 128
DONOR_RUN = 128


def _known(df: DataFrame, columns: list[str]) -> list[Column]:
    """The columns as doubles; NaN, which only fractions can hold, counts as a gap."""
    types = dict(df.dtypes)
    values = [F.col(c).cast("double") for c in columns]
    return [
        F.when(~F.isnan(v), v) if types[c] in ("double", "float") else v for c, v in zip(columns, values, strict=True)
    ]


def with_row_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Add ``row_values`` and ``has_gap``.

    They come out of a one-row generator, so a filter on ``has_gap`` stays a filter on
    one column. Spread over thirty columns it would make the optimizer derive a
    constraint for every combination of renamed columns.
    """
    values = _known(df, columns)
    gap = reduce(or_, [v.isNull() for v in values])
    return df.select("*", F.inline(F.array(F.struct(F.array(*values).alias("row_values"), gap.alias("has_gap")))))


def fit_donors(train: DataFrame, columns: list[str]) -> DataFrame:
    """(donor array<double>, copies): distinct training rows, stored once."""
    donors = train.groupBy(F.array(*_known(train, columns)).alias("donor")).agg(F.count(F.lit(1)).alias("copies"))
    return stored(donors)


def column_means(donors: DataFrame, columns: list[str]) -> DataFrame:
    """One row with the training mean of each column, the fallback of the imputer."""
    sums = []
    for i, c in enumerate(columns):
        value = F.get("donor", F.lit(i))
        present = F.sum(F.when(value.isNotNull(), F.col("copies")))
        sums.append(F.try_divide(F.sum(value * F.col("copies")), present).alias(c))
    return donors.agg(*sums)


def _compact_order(values: np.ndarray, size: int) -> np.ndarray:
    """Rows in an order whose runs of ``size`` lie close together: halves along the widest column, again and again."""
    low = np.where(np.isnan(values), np.nanmin(values, initial=0.0) - 1, values)
    done, todo = [], [np.arange(len(values))]
    while todo:
        rows = todo.pop()
        if len(rows) <= size:
            done.append(rows)
            continue
        part = low[rows]
        widest = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        half = -(-len(rows) // (2 * size)) * size  # whole runs on the left
        rows = rows[np.argpartition(part[:, widest], half - 1)]
        todo += [rows[half:], rows[:half]]
    return np.concatenate(done)


class DonorIndex:
    """Donors in compact runs, each with the range of every column: what a run cannot beat is never compared.

    A run's donors differ from a receiver by at least its distance to the range, in columns that the whole run knows,
    and share no more columns than some donor of the run knows. Their quotient bounds the distance from below.
    """

    def __init__(self, values: np.ndarray, run: int):
        order = _compact_order(values, run)
        self.rank, self.values, self.run = order, values[order], run
        self.known = ~np.isnan(self.values)
        self.starts = np.arange(0, len(order), run)
        self.low = np.minimum.reduceat(np.where(self.known, self.values, np.inf), self.starts)
        self.high = np.maximum.reduceat(np.where(self.known, self.values, -np.inf), self.starts)
        self.some = np.logical_or.reduceat(self.known, self.starts)
        self.all = np.logical_and.reduceat(self.known, self.starts)

    def bounds(self, block: np.ndarray) -> np.ndarray:
        """(receivers, runs): least possible distances."""
        least = np.zeros((len(block), len(self.starts)))
        shared = np.zeros_like(least)
        for f in range(block.shape[1]):
            mine = block[:, f][:, None]
            has = ~np.isnan(mine)
            off = np.maximum(np.maximum(self.low[:, f] - mine, mine - self.high[:, f]), 0.0)
            least += np.where(has & self.all[:, f], off * off, 0.0)
            shared += has & self.some[:, f]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, block.shape[1] * least / shared * (1 - 1e-12), np.inf)

    def distances(self, block: np.ndarray, rows: slice) -> np.ndarray:
        """(receivers, donors of the run): distances over the shared columns, infinite without any."""
        values, known = self.values[rows], self.known[rows]
        squares = np.zeros((len(block), len(values)))
        shared = np.zeros((len(block), len(values)))
        for f in range(block.shape[1]):
            both = ~np.isnan(block[:, f])[:, None] & known[:, f][None, :]
            gap = np.where(both, block[:, f][:, None] - values[:, f][None, :], 0.0)
            squares += gap * gap
            shared += both
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(shared > 0, block.shape[1] * squares / shared, np.inf)

    def nearest(self, block: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """Per gap of the block: its row, its column, the k least (distance, donor) pairs, and the number of
        (receiver, run) pairs that were compared.

        Runs are taken nearest first. A run is left out where its bound exceeds the k-th distance of every gap; ties
        with it are still compared, as the donors' order settles them.
        """
        row, gap = np.nonzero(np.isnan(block))
        best = np.full((len(row), k), np.inf)
        donor = np.full((len(row), k), len(self.values))
        bounds = self.bounds(block)
        compared = 0
        for r in np.argsort(bounds.min(axis=0), kind="stable"):
            open_ = (bounds[row, r] <= best[:, -1]) & np.isfinite(bounds[row, r]) & self.some[r, gap]
            if not open_.any():
                continue
            rows = slice(int(self.starts[r]), min(int(self.starts[r]) + self.run, len(self.values)))
            wanted, place = np.unique(row[open_], return_inverse=True)
            compared += len(wanted)
            found = self.distances(block[wanted], rows)[place]
            found = np.where(self.known[rows][:, gap[open_]].T, found, np.inf)
            better = found.min(axis=1) <= best[open_, -1]
            slots = np.flatnonzero(open_)[better]
            both = np.concatenate([best[slots], found[better]], axis=1)
            names = np.concatenate([donor[slots], np.broadcast_to(self.rank[rows], (len(slots), rows.stop - rows.start))], axis=1)
            first = np.lexsort((names, both), axis=1)[:, :k]
            best[slots], donor[slots] = np.take_along_axis(both, first, 1), np.take_along_axis(names, first, 1)
        return row, gap, best, donor, np.array(compared)


def _nearest_in_tile(width: int, k: int):
    """Tile worker: per receiver and gap, the donors that can be among the k nearest."""

    def matrix(rows: pd.Series) -> np.ndarray:
        return np.array([list(r) for r in rows], dtype="float64").reshape(len(rows), width)

    def lists(rows: np.ndarray) -> list[list[float | None]]:
        return np.where(np.isnan(rows), None, rows.astype(object)).tolist()

    def work(receivers: pd.DataFrame, donors: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(receivers) and len(donors):
            values = matrix(donors["donor"])
            copies = donors["copies"].to_numpy()
            # Value order with gaps first, as Spark and SQL order them.
            order = np.lexsort(np.where(np.isnan(values), -np.inf, values).T[::-1])
            values, copies = values[order], copies[order]
            index = DonorIndex(values, DONOR_RUN)
            wanted = matrix(receivers["receiver"])
            wanted = wanted[_compact_order(wanted, ROW_STEP)]
            for start in range(0, len(wanted), ROW_STEP):
                block = wanted[start : start + ROW_STEP]
                row, gap, distance, donor, _ = index.nearest(block, k)
                slot, place = np.nonzero(np.isfinite(distance))
                if not len(slot):
                    continue
                d = donor[slot, place]
                parts.append(
                    pd.DataFrame(
                        {
                            "receiver": lists(block[row[slot]]),
                            "gap": gap[slot].astype("int32"),
                            "distance": distance[slot, place],
                            "donor": lists(values[d]),
                            "value": values[d, gap[slot]],
                            "copies": copies[d],
                        }
                    )
                )
        return pd.concat(parts) if parts else pd.DataFrame(columns=["receiver", "gap", "distance", "donor", "value", "copies"])

    return work


def nearest_donors(receivers: DataFrame, donors: DataFrame, width: int, k: int = NEIGHBOURS) -> DataFrame:
    """(receiver, gap, value): the mean over the k nearest donors that know the column."""
    donor_blocks = max(1, ceil(donors.count() / DONOR_BLOCK))
    n, slots = receivers.count(), receivers.sparkSession.sparkContext.defaultParallelism
    # Few receivers still use every slot; many are cut by size.
    receiver_blocks = max(1, ceil(n / RECEIVER_BLOCK), min(ceil(n / SMALL_BLOCK), slots))

    def block(column: str, blocks: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def every(blocks: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = receivers.withColumn("rb", block("receiver", receiver_blocks)).withColumn("db", every(donor_blocks))
    right = donors.withColumn("db", block("donor", donor_blocks)).withColumn("rb", every(receiver_blocks))
    schema = "receiver array<double>, gap int, distance double, donor array<double>, value double, copies bigint"
    near = (
        left.groupBy("db", "rb")
        .cogroup(right.groupBy("db", "rb"))
        .applyInPandas(_nearest_in_tile(width, k), schema)
    )
    nearest_first = Window.partitionBy("receiver", "gap").orderBy("distance", "donor")
    before = F.coalesce(F.sum("copies").over(nearest_first.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    used = near.withColumn("used", F.least(F.col("copies"), F.lit(k) - before)).where("used > 0")
    return used.groupBy("receiver", "gap").agg(
        (F.sum(F.col("value") * F.col("used")) / F.sum("used")).alias("value")
    )


def knn_impute(
    df: DataFrame, donors: DataFrame, columns: list[str], k: int = NEIGHBOURS, means: DataFrame | None = None
) -> DataFrame:
    """Fill the gaps of ``columns``; complete rows pass through untouched.

    A gap without any comparable donor gets the training mean of its column.
    """
    means = column_means(donors, columns) if means is None else means
    marked = with_row_values(df, columns)
    receivers = stored(marked.where("has_gap").select(F.col("row_values").alias("receiver")).distinct())
    filled = nearest_donors(receivers, donors, len(columns), k)
    by_row = filled.groupBy("receiver").agg(  # at most one entry per column
        F.map_from_entries(F.collect_list(F.struct("gap", "value"))).alias("fills")
    )
    by_row = by_row.withColumn("row_key", F.to_json("receiver")).select("row_key", "fills")
    default = means.select(F.struct(*columns)).scalar()
    carried = [c for c in df.columns if c not in columns]
    known = {c: F.get("row_values", F.lit(i)) for i, c in enumerate(columns)}
    complete = marked.where("not has_gap").select(*carried, *[known[c].alias(c) for c in columns])
    keyed = marked.where("has_gap").withColumn("row_key", F.to_json("row_values"))
    others = [c for c, t in df.dtypes if c not in columns and "map<" not in t]
    joined = salted_left_join(keyed, by_row, "row_key", others)
    filled = [
        F.coalesce(known[c], F.try_element_at("fills", F.lit(i)), default[c]).alias(c) for i, c in enumerate(columns)
    ]
    return complete.unionByName(joined.select(*carried, *filled)).select(*df.columns)
