"""Closed-form statistics over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lurescope.contract import PSI_FLOOR

# Fixed values of the limiting Kolmogorov series with its small-sample correction.
SERIES_TERMS = 100
SMALL_LAMBDA = 0.2


#: Products of the two sample sizes up to which the p-value is exact.
EXACT_CELLS = 10_000


def exact_ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """Exact two-sided p-value for small samples without ties, as a lattice-path recurrence.

    An order of the pooled samples is a path from (0, 0) to (n1, n2), and all paths are alike likely. The p-value is
    the share of paths that touch a point where the two running shares are ``d`` or more apart. The state is one row
    of the lattice, over the smaller sample; a step of the larger sample makes the next row. Comparisons are made in
    whole numbers: ``d`` times both sizes is one.
    """
    m, n = F.least(n1, n2).cast("int"), F.greatest(n1, n2).cast("int")
    limit = F.round(d * m * n).cast("long")

    def next_row(row: Column, i: Column) -> Column:
        def with_cell(cells: Column, j: Column) -> Column:
            apart = F.abs(i.cast("long") * m - j.cast("long") * n) >= limit
            along = F.coalesce(F.get(row, j), F.lit(0.0)) * i + F.coalesce(F.get(cells, j - 1), F.lit(0.0)) * j
            return F.concat(cells, F.array(F.when(apart, F.lit(1.0)).otherwise(along / F.greatest(i + j, F.lit(1)))))

        return F.aggregate(F.sequence(F.lit(0), m), F.array().cast("array<double>"), with_cell)

    last = F.aggregate(F.sequence(F.lit(0), n), F.array().cast("array<double>"), next_row)
    return F.get(last, m)


def ks_p_value(d: Column, n1: Column, n2: Column, exact_cells: int = EXACT_CELLS) -> Column:
    """Two-sided p-value of the two-sample KS statistic; null if a side is empty.

    Exact where the product of the sizes is at most ``exact_cells``, the corrected limiting form beyond.
    """
    small = (n1 > 0) & (n2 > 0) & (n1.cast("double") * n2 <= exact_cells)
    # Sizes outside the exact range read as 1, so that no row is ever longer than the range.
    size = lambda n: F.when(small, n).otherwise(F.lit(1))
    return F.when(small, exact_ks_p_value(d, size(n1), size(n2))).otherwise(limiting_ks_p_value(d, n1, n2))


def limiting_ks_p_value(d: Column, n1: Column, n2: Column) -> Column:
    """The limiting form with its small-sample correction; null if a side is empty."""
    n1, n2 = n1.cast("double"), n2.cast("double")
    root = F.sqrt(n1 * n2 / (n1 + n2))
    lam = d * (root + F.lit(0.12) + F.lit(0.11) / root)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(SERIES_TERMS)),
        F.lit(0.0),
        lambda acc, j: acc
        + F.when(j % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * j * j * lam * lam),
    )
    bounded = F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0))
    # Below this the alternating series no longer converges in its terms; p is 1 there.
    return F.when((n1 > 0) & (n2 > 0), F.when(lam < SMALL_LAMBDA, F.lit(1.0)).otherwise(bounded))


def sketch_value(value: Column, accuracy: float = 0.01) -> Column:
    """A value's bucket on a logarithmic grid, as a value within ``accuracy`` of it (relative).

    Counts of such values are a quantile sketch: they add up in any order, and a column has a few hundred of them
    however many rows there are. Zero, infinities and nulls stay; NaN counts as null.
    """
    value = value.cast("double")
    ratio = F.lit((1 + accuracy) / (1 - accuracy))
    bucket = F.pow(ratio, F.ceil(F.log(F.abs(value)) / F.log(ratio)))
    middle = F.signum(value) * bucket * 2 / (ratio + 1)
    exact = (value == 0) | (F.abs(value) == F.lit(float("inf")))
    return F.when(exact, value).when(~F.isnan(value), middle)


def psi_term(expected_share: Column, actual_share: Column) -> Column:
    e = F.greatest(expected_share, F.lit(PSI_FLOOR))
    a = F.greatest(actual_share, F.lit(PSI_FLOOR))
    return (a - e) * F.ln(a / e)


def percent_text(p: Column, decimals: int = 1) -> Column:
    """``p`` as a percentage with one or two decimals, rounded like C's ``%.nf``.

    Java's formatter rounds the shortest decimal text half up, which turns 6.25 into
    6.3; C and Python look at the exact binary value and give 6.2. Whether ``x`` lies
    above the midpoint ``m`` of two outputs is decided by steps that are exact in
    doubles: powers of two times ``x`` are taken off ``m`` one by one.
    """
    scale, *powers = {1: (10, 16.0, 4.0), 2: (100, 128.0, 64.0, 8.0)}[decimals]
    x = p * 100
    below = F.floor(x * scale)
    rest = (below * 2 + 1).cast("double")
    for power in powers:
        rest = rest - x * power
    odd = below % 2 == 1
    units = below + F.when((rest < 0) | ((rest == 0) & odd), 1).otherwise(0)
    whole = F.floor(units / scale).cast("string")
    return F.concat(whole, F.lit("."), F.lpad((units % scale).cast("string"), decimals, "0"), F.lit("%"))


def metric_tag(value: Column) -> Column:
    return F.format_string("%.6f", value)


def with_rank_in_edges(df: DataFrame, edges: str, value: str, size: int, out: str) -> DataFrame:
    """Add ``out``: how many of the sorted ``edges`` (at most ``size``) are <= ``value``.

    A binary search over log2(size) projections. Each step is a column of its own, so
    the search stays in generated code and no expression is repeated.
    """
    position = F.lit(0)
    for i in range(size.bit_length() - 1, -1, -1):
        step = 2**i
        probe = F.get(edges, position + F.lit(step - 1))
        df = df.withColumn(out, position + F.when(probe <= F.col(value), step).otherwise(0))
        position = F.col(out)
    return df
