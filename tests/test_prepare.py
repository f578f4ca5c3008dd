"""Split, label remap, imputer, scaler and preprocessor."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lurescope.contract import DATASET_SCHEMA
from lurescope.operators import impute, quality
from lurescope.operators.patterns import bagging_units, distinct_rows, with_folds
from lurescope.operators.prepare import Preprocessor, PreprocessorModel
from lurescope.operators.scale import apply_robust_scale, fit_robust_scale
from lurescope.session import shared_folder

COLS = ["a", "b", "c", "d", "e"]


def test_split_is_exact_and_stable(spark):
    for n in (1, 4, 5, 101, 1000):
        ids = spark.range(n).withColumnRenamed("id", "k")
        parts = [
            frozenset(r["k"] for r in quality.seeded_split(ids.repartition(p), "k").where("is_test").collect())
            for p in (1, 7)
        ]
        assert parts[0] == parts[1] and len(parts[0]) == math.ceil(0.2 * n)
    other = quality.seeded_split(spark.range(1000), "id", seed=7).where("is_test")
    assert {r["id"] for r in other.collect()} != set(parts[0])


def test_split_keeps_copies_of_a_key_together(spark):
    rows = spark.range(300).select((F.greatest(F.col("id") - 100, F.lit(0))).alias("k"))  # key 0 holds a third
    sides = quality.seeded_split(rows, "k").groupBy("k").agg(F.count_distinct("is_test").alias("n")).collect()
    assert {r["n"] for r in sides} == {1}


def test_label_remap_touches_only_minus_one(spark):
    df = spark.createDataFrame([(-1,), (1,), (0,), (7,), (None,)], "Result long")
    assert [r[0] for r in quality.remap_label(df, "Result").collect()] == [0, 1, 0, 7, None]


def test_contract_counts_columns(spark):
    whole = spark.createDataFrame([], DATASET_SCHEMA)
    rows = {r["split"]: r for r in quality.contract_verdict({"train": whole, "test": whole.drop("Iframe")}).collect()}
    assert rows["train"]["ok"] and not rows["test"]["ok"] and not rows["train"]["dataset_ok"]


def gappy(seed, n=150, share=0.1):
    rng = np.random.default_rng(seed)
    x = rng.integers(-1, 2, (n, len(COLS))).astype(float)
    x[rng.random(x.shape) < share] = np.nan
    return x


def table(spark, x):
    rows = [(i, *[None if math.isnan(v) else float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id int, " + ", ".join(f"{c} double" for c in COLS))


def brute_force(x, donors, k=3):
    out = x.copy()
    for i, r in enumerate(x):
        for f in np.flatnonzero(np.isnan(r)):
            near = []
            for q in donors:
                both = ~np.isnan(r) & ~np.isnan(q)
                if not np.isnan(q[f]) and both.any():
                    d = len(r) * ((r - q)[both] ** 2).sum() / both.sum()
                    near.append((d, tuple(-9 if np.isnan(v) else v for v in q), q[f]))
            near.sort()
            out[i, f] = np.mean([v for *_, v in near[:k]]) if near else np.nanmean(donors[:, f])
    return out


def imputed(spark, x, train):
    donors = impute.fit_donors(table(spark, train), COLS)
    rows = impute.knn_impute(table(spark, x), donors, COLS).orderBy("id").collect()
    return np.array([[r[c] for c in COLS] for r in rows])


def test_imputer_equals_brute_force(spark):
    train, test = gappy(3), gappy(4, 40, 0.3)
    assert np.allclose(imputed(spark, train, train), brute_force(train, train))
    assert np.allclose(imputed(spark, test, train), brute_force(test, train))


def test_imputer_tiles_agree(spark, monkeypatch):
    x = gappy(5, 80, 0.2)
    whole = imputed(spark, x, x)
    monkeypatch.setattr(impute, "DONOR_BLOCK", 11)
    monkeypatch.setattr(impute, "RECEIVER_BLOCK", 7)
    assert np.array_equal(imputed(spark, x, x), whole)


def plain_nearest(block, donors, k):
    """Per gap the k least (distance, donor) pairs, all donors compared."""
    out = {}
    for i, r in enumerate(block):
        for f in np.flatnonzero(np.isnan(r)):
            near = []
            for j, q in enumerate(donors):
                both = ~np.isnan(r) & ~np.isnan(q)
                if not np.isnan(q[f]) and both.any():
                    near.append((len(r) * ((r - q)[both] ** 2).sum() / both.sum(), j))
            out[i, int(f)] = sorted(near)[:k]
    return out


@pytest.mark.parametrize("values", ["codes", "continuous"])
def test_donor_index_equals_all_comparisons(values):
    rng = np.random.default_rng(8)
    draw = (lambda n: rng.integers(-1, 2, (n, 7)).astype(float)) if values == "codes" else (lambda n: rng.normal(size=(n, 7)).round(1))
    donors, block = draw(500), draw(60)
    donors[rng.random(donors.shape) < 0.15] = np.nan
    block[rng.random(block.shape) < 0.3] = np.nan
    block[0], donors[3] = np.nan, np.nan
    donors = np.unique(donors, axis=0)
    for run in (1, 16, 1000):
        row, gap, distance, donor, compared = impute.DonorIndex(donors, run).nearest(block, 3)
        got = {(int(i), int(f)): [(d, int(j)) for d, j in zip(ds, js) if np.isfinite(d)] for i, f, ds, js in zip(row, gap, distance, donor)}
        want = plain_nearest(block, donors, 3)
        assert got.keys() == want.keys()
        for slot, near in want.items():
            assert [j for _, j in got[slot]] == [j for _, j in near] and np.allclose([d for d, _ in got[slot]], [d for d, _ in near])
        assert compared <= -(-len(donors) // run) * len(block)


def test_donor_index_skips_far_runs():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 7)) * 50
    donors = np.concatenate([c + rng.normal(size=(64, 7)) for c in centres])
    block = centres[:1] + rng.normal(size=(30, 7))
    block[:, 2] = np.nan
    index = impute.DonorIndex(donors, 64)
    assert index.nearest(block, 3)[-1] <= len(block) * len(index.starts) // 4


def test_imputer_without_shared_columns_uses_the_mean(spark):
    train = np.array([[1, np.nan, 1, 1, 1], [0, np.nan, 0, 0, 0], [1, np.nan, 1, 1, 1.0]])
    x = np.array([[np.nan, 1, np.nan, np.nan, np.nan]])
    assert np.allclose(imputed(spark, x, train)[0][[0, 2]], 2 / 3)


def test_hot_pattern_counts_as_its_copies(spark):
    """A third of the rows are one pattern with a gap, another third its donor."""
    hot, donor = [np.nan, 0, 0, 0, 0], [1, 0, 0, 0, 0]
    x = np.array([hot] * 300 + [donor] * 300 + [[-1, 1, 1, 1, 1]] * 300)
    assert set(imputed(spark, x, x)[:300, 0]) == {1.0}


def test_scaler_keeps_zero_iqr_columns(spark):
    df = spark.createDataFrame([(1.0, float(i)) for i in range(9)] + [(-1.0, 9.0)], "flat double, ramp double")
    params = fit_robust_scale(df, ["flat", "ramp"])
    rows = apply_robust_scale(df, params, ["flat", "ramp"]).collect()
    assert [r["flat"] for r in rows] == [0.0] * 9 + [-2.0]
    ramp = np.arange(10.0)
    q1, q2, q3 = np.percentile(ramp, [25, 50, 75])
    assert np.allclose([r["ramp"] for r in rows], (ramp - q2) / (q3 - q1))


def test_preprocessor_is_fitted_on_train_and_reloads(spark):
    train, test = gappy(6), gappy(7, 30)
    model = Preprocessor(COLS).fit(table(spark, train))
    rows = model.transform(table(spark, test)).orderBy("id").collect()
    filled = brute_force(train, train)
    q1, q2, q3 = np.percentile(filled, [25, 50, 75], axis=0)
    expected = (brute_force(test, train) - q2) / np.where(q3 == q1, 1, q3 - q1)
    assert np.allclose([[r[c] for c in COLS] for r in rows], expected)
    path = shared_folder(spark, "prep")
    model.save(path)
    again = PreprocessorModel.load(spark, path).transform(table(spark, test)).orderBy("id").collect()
    assert again == rows


def test_folds_deal_all_copies_evenly(spark):
    pdf = pd.DataFrame({"x": [0] * 100 + [1] * 7 + [2], "y": [0] * 50 + [1] * 58})
    dealt = with_folds(distinct_rows(spark.createDataFrame(pdf), ["x"], "y"), ["x"], 3)
    per_row = dealt.groupBy("x", "label").agg(F.sum("copies").alias("n"), F.max("copies") - F.min("copies")).collect()
    assert sum(r["n"] for r in per_row) == 108
    assert dealt.where("fold < 0 or fold > 2").count() == 0
    sizes = [r["n"] for r in dealt.groupBy("fold").agg(F.sum("copies").alias("n")).collect()]
    assert max(sizes) - min(sizes) <= 4


def test_bagging_units_keep_the_weight(spark):
    df = spark.createDataFrame([(1, 1000), (2, 3)], "x int, copies long")
    rows = bagging_units(df, 32).groupBy("x").agg(F.count("*").alias("n"), F.sum("weight").alias("w")).orderBy("x").collect()
    assert [(r["n"], pytest.approx(r["w"])) for r in rows] == [(32, 1000.0), (3, 3.0)]
