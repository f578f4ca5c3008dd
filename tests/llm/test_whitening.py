"""Whitening against numpy's own eigenvectors and plain integers."""

import math

import numpy as np
import pytest

from lurescope.llm import queries, whitening

FULL = "/root/testdata/sf0.01"


def symmetric(values, seed):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(values), len(values))))
    return (q * values) @ q.T


@pytest.mark.parametrize(
    "values",
    [
        np.linspace(1, 30, 30),
        np.array([5.0] * 6 + [1.0] * 6),  # equal eigenvalues
        np.array([1.0, 1.0 + 1e-9, 1.0 + 2e-9, 0.5, 0.25, 0.1]),
        np.array([1e9, 1e3, 1.0, 1e-3]),
        np.zeros(5),
        np.array([3.0]),
        np.array([2.0, 7.0]),
        np.array([-4.0, 1.0, 2.0, 0.0]),
    ],
)
@pytest.mark.parametrize("rotated", [True, False])
def test_components_of_known_matrices(values, rotated):
    matrix = symmetric(values, 4) if rotated else np.diag(values)
    k = min(8, len(values))
    found, vectors = whitening.leading_components(matrix, k)
    size = max(np.abs(values).max(), 1e-300)
    assert np.allclose(found, np.sort(values)[::-1][:k], rtol=0, atol=1e-13 * size * len(values))
    assert np.allclose(vectors @ vectors.T, np.eye(k), atol=1e-12)
    assert np.abs(matrix @ vectors.T - vectors.T * found).max() <= 1e-13 * size * len(values)


def test_sturm_counts():
    rng = np.random.default_rng(8)
    d, e = rng.standard_normal(12), rng.standard_normal(11)
    e[4] = 0.0  # two blocks
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    x = np.linspace(-4, 4, 50)
    assert whitening.count_below(d, e, x).tolist() == [int((values < v).sum()) for v in x]


def expected(rows, components=8):
    usable = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in usable])
    n, sums = len(x), [sum(c) for c in x.T.tolist()]
    y = x - np.array(sums) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [i for i, _ in usable], n, deviation, (y @ u) / np.sqrt(e), e / np.trace(v), e


def check(got, rows):
    ids, n, deviation, projected, explained, _ = expected(rows)
    assert len(got) == len(ids) * projected.shape[1]
    table = {}
    for r in got:
        assert r["n"] == n and r["identity_error"] <= 1e-9
        table.setdefault(r["vec_id"], {})[r["component"]] = r
    signs = np.zeros(projected.shape[1])
    for at, i in enumerate(ids):
        for c in range(projected.shape[1]):
            r = table[i][c + 1]
            assert r["deviation"] == deviation[at]
            assert r["explained"] == pytest.approx(explained[c], rel=1e-10)
            assert abs(r["whitened"]) == pytest.approx(abs(projected[at, c]), abs=1e-7)
            signs[c] += np.sign(r["whitened"] * projected[at, c])
    assert (np.abs(signs) == len(ids)).all()  # one sign per component for all rows


def test_op11_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{FULL}/embeddings.parquet").collect()]
    got = queries.QUERIES["op11_whitening"](spark, FULL)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(got.dtypes)["deviation"] == "bigint"
    check(got.collect(), rows)


def vectors(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, "own") for i, v in rows], f"vec_id bigint, embedding array<{kind}>, whitened string").repartition(3)


def test_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(k, [float(c) for c in rng.standard_normal(5) * [5, 3, 2, 1, 0.5]]) for k in range(60)]
    odd = [(100, None), (101, []), (102, [1.0, None, 1.0, 1.0, 1.0]), (103, [float("nan")] * 5), (104, [float("inf"), 0.0, 0.0, 0.0, 0.0]), (105, [1.0, 2.0]), (106, [-float("inf")] * 5)]
    got = whitening.whitened_rows(vectors(spark, good + odd)).collect()
    check(got, good)
    repeated = good + [(60 + k, good[0][1]) for k in range(30)]  # a third of all rows is one vector
    check(whitening.whitened_rows(vectors(spark, repeated)).collect(), repeated)
    nulls = vectors(spark, [(None, v) for _, v in good])
    assert {r["vec_id"] for r in whitening.whitened_rows(nulls).collect()} == {None}


def test_no_variance_no_component(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)]):
        got = whitening.whitened_rows(vectors(spark, rows))
        assert got.count() == 0 and got.columns == [c.split()[0] for c in whitening.RESULT.split(", ")]
    line = [(k, [float(k), 2.0 * k, 7.0]) for k in range(10)]  # rank one
    got = whitening.whitened_rows(vectors(spark, line)).collect()
    assert {r["component"] for r in got} == {1} and all(r["explained"] == pytest.approx(1) for r in got)


def test_deviation_beyond_64_bits_stays_exact():
    rows = np.array([[2**45, 5], [7, -(2**45)], [1, 1]])
    sums = [int(c) for c in rows.sum(axis=0)]
    assert whitening.exact_deviation(rows, 3, sums) == [sum((3 * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in rows]
