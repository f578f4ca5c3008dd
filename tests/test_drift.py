"""KS, PSI and exact quantiles against numpy, and the two drift front ends."""

from fractions import Fraction
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lurescope.functions.stats import ks_p_value
from lurescope.operators import distribution as dist
from lurescope.operators import drift


def frame(spark, seed, shift=0.0, n=500):
    rng = np.random.default_rng(seed)
    data = {"f1": rng.normal(shift, 1, n), "f2": rng.normal(shift, 1, n), "Result": rng.integers(0, 2, n)}
    return spark.createDataFrame(pd.DataFrame(data))


def one_column(spark, ref, cur):
    side = lambda v: spark.createDataFrame([(None if x is None else float(x),) for x in v], "f double")
    return drift.drift_report(side(ref), side(cur)).first()


def numpy_psi(e, a):
    edges = np.unique(np.percentile(e, np.linspace(0, 100, 11)))
    ec, ac = np.histogram(e, bins=edges)[0], np.histogram(a, bins=edges)[0]
    ep, ap = np.clip(ec / max(ec.sum(), 1), 1e-6, None), np.clip(ac / max(ac.sum(), 1), 1e-6, None)
    return np.sum((ap - ep) * np.log(ap / ep))


def numpy_ks(a, b):
    a, b = np.sort(a), np.sort(b)
    both = np.concatenate([a, b])
    d = np.abs(np.searchsorted(a, both, side="right") / len(a) - np.searchsorted(b, both, side="right") / len(b)).max()
    n = len(a) * len(b) / (len(a) + len(b))
    lam = d * (n**0.5 + 0.12 + 0.11 / n**0.5)
    return 2 * sum((-1) ** (j - 1) * np.exp(-2 * j * j * lam * lam) for j in range(1, 101))


def test_same_distribution_does_not_drift(spark):
    report = drift.drift_report(frame(spark, 1), frame(spark, 2))
    summary = drift.drift_summary(report, with_rows=True).first()
    assert summary["n_features"] == 2 and summary["dataset_drift"] is False
    assert [r["feature"] for r in summary["features"]] == ["f1", "f2"]


def test_shifted_distribution_drifts(spark):
    summary = drift.drift_summary(drift.drift_report(frame(spark, 1), frame(spark, 2, 3.0))).first()
    assert summary["dataset_drift"] is True and summary["n_drifted"] == 2 and summary["drift_share"] == 1.0


def test_self_check(spark):
    rows = drift.drift_report(frame(spark, 1)).collect()
    assert all(r["ks_p_value"] == 1.0 and r["psi"] == 0.0 and not r["drifted"] for r in rows)


def test_matches_numpy(spark):
    rng = np.random.default_rng(0)
    ref, cur = rng.normal(0, 1, 1000), rng.normal(0.2, 1.3, 700)
    row = one_column(spark, ref, cur)
    assert row["psi"] == pytest.approx(numpy_psi(ref, cur), abs=2e-6)
    assert row["ks_p_value"] == pytest.approx(numpy_ks(ref, cur), abs=2e-6)
    assert one_column(spark, rng.normal(0, 1, 1000), rng.normal(2, 1, 1000))["psi"] > 0.2


def test_psi_of_identical_grid_is_zero(spark):
    grid = np.linspace(0, 1, 1000)
    assert one_column(spark, grid, grid)["psi"] == 0.0


def test_edge_columns(spark):
    constant = one_column(spark, [1] * 50, [1] * 60)
    assert constant["psi"] == 0.0 and constant["ks_p_value"] == 1.0 and not constant["drifted"]
    empty = one_column(spark, [1, 2, 3], [None, None])
    assert empty["ks_p_value"] is None and not empty["drifted"]
    void = one_column(spark, [None], [None, float("nan")])
    assert void["ks_p_value"] is None and void["psi"] == 0.0
    outside = one_column(spark, range(100), range(1000, 1100))
    assert outside["drifted"] and outside["psi"] == pytest.approx(numpy_psi(np.arange(100), np.arange(1000, 1100)), abs=1e-5)


def test_hot_value_and_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([np.zeros(4000), rng.exponential(100, 3001), rng.integers(0, 9, 2000)])
    side = spark.createDataFrame(pd.DataFrame({"v": values})).repartition(13)
    counts = dist.value_counts(dist.both_sides(side, side.limit(0), ["v"]), ["v"])
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    row = dist.summarise(dist.cumulative_counts(counts), shares).first()
    assert row["n_ref"] == len(values) and row["ks_p"] is None
    assert np.allclose(row["quantiles"], np.quantile(values, shares), atol=1e-9)


def test_columns_are_intersected_and_target_left_out(spark):
    ref = spark.createDataFrame([(1, 2, 1)], "a int, b int, Result int")
    cur = spark.createDataFrame([(1, 9, 1)], "a int, c int, Result int")
    assert [r["feature"] for r in drift.drift_report(ref, cur).collect()] == ["a"]


def test_validation_drift(spark):
    base = spark.createDataFrame([(float(i), 0.0 if i else None, 1) for i in range(60)], "a double, b double, Result int")
    current = spark.createDataFrame([(float(i + 50), 1.0) for i in range(60)], "a double, b double")
    rows = {r["column_name"]: r for r in drift.validation_drift(base, current).collect()}
    assert rows["a"]["drift_status"] and rows["a"]["p_value"] < 0.05
    assert rows["b"]["p_value"] is None and not rows["b"]["drift_status"]  # a gap gives no p
    assert rows["Result"]["p_value"] is None and not rows["Result"]["drift_status"]  # missing from current
    assert drift.drift_free(drift.validation_drift(base, current)).first()["drift_free"] is False
    assert drift.drift_free(drift.validation_drift(base, base)).first()["drift_free"] is True


def enumerated_ks(n1, n2):
    """(d times both sizes, p) by going through every order of the pooled samples."""
    found = []
    for places in combinations(range(n1 + n2), n1):
        mine, seen, most = set(places), 0, 0
        for k in range(n1 + n2):
            seen += k in mine
            most = max(most, abs(seen * n2 - (k + 1 - seen) * n1))
        found.append(most)
    return [(h, Fraction(sum(x >= h for x in found), comb(n1 + n2, n1))) for h in sorted(set(found))]


def test_small_samples_have_exact_p(spark):
    want = {(n1, n2, h): p for n1 in range(1, 9) for n2 in range(n1, 9) for h, p in enumerated_ks(n1, n2)}
    rows = [(n1, n2, h, h / (n1 * n2)) for n1, n2, h in want] + [(n2, n1, h, h / (n1 * n2)) for n1, n2, h in want]
    got = spark.createDataFrame(rows, "n1 long, n2 long, h long, d double").withColumn("p", ks_p_value(F.col("d"), F.col("n1"), F.col("n2")))
    for r in got.collect():
        assert r.p == pytest.approx(float(want[min(r.n1, r.n2), max(r.n1, r.n2), r.h]), rel=1e-12)


def test_exact_and_limiting_p_meet(spark):
    rows = [(100, 100, 0.2), (1, 10_000, 0.9), (100, 101, 0.2), (0, 5, 0.3), (5, 0, None), (7, 9, 0.0), (7, 9, 1.0)]
    got = spark.createDataFrame(rows, "n1 long, n2 long, d double").select(ks_p_value(F.col("d"), F.col("n1"), F.col("n2"))).collect()
    p = [r[0] for r in got]
    reflected = 2 * sum((-1) ** (k - 1) * comb(200, 100 - 20 * k) for k in range(1, 6)) / comb(200, 100)  # equal sizes
    assert p[0] == pytest.approx(reflected, rel=1e-9) and p[1] == pytest.approx(0.2, abs=1e-3)  # one value beyond a tenth from either end
    assert p[2] == pytest.approx(p[0], abs=1e-2) and p[3] is None and p[4] is None
    assert p[5] == 1.0 and p[6] == pytest.approx(2 / comb(16, 7))
