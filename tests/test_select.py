"""PCA invariants (no SQL oracle for eigenvectors) and selection rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from dpframe.operators import select
from tests.conftest import SF01


def test_pca_invariants(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    mean, comps, ratio = select.pca_fit(e, "embedding", 10)
    assert comps.shape == (10, 64)
    assert comps @ comps.T == pytest.approx(np.eye(10), abs=1e-10)        # orthonormal loadings
    assert all(np.argmax(np.abs(c)) == np.argmax(c) for c in comps)        # largest loading positive
    assert np.all(np.diff(ratio) <= 1e-15) and ratio.sum() < 1.0
    X = np.array([r[0] for r in e.select("embedding").collect()], dtype=float)
    cov = np.cov(X - X.mean(0), rowvar=False, bias=True)
    _, c2, _ = select.covariance(e, "embedding")
    assert c2 == pytest.approx(cov, abs=1e-10)
    z = np.array([r[0] for r in e.select(select.pca_transform(F.col("embedding"), mean, comps)).collect()])
    assert z.var(0) == pytest.approx(np.sort(np.linalg.eigvalsh(cov))[::-1][:10], rel=1e-9)


def test_choose_components_rule(spark):
    ratios = spark.createDataFrame(list(enumerate([0.5, 0.3, 0.15, 0.05])), "component int, ratio double")
    assert select.choose_components(ratios, 0.94, 1, 300).first()["k"] == 3
    assert select.choose_components(ratios, 0.94, 10, 300).first()["k"] == 4   # clipped to the width
    got = select.choose_components(ratios, 0.5, 2, 300).first()
    assert (got["k"], got["retained"]) == (2, pytest.approx(0.8))


def test_variance_threshold_raises_when_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 2.0)], "a double, b double")
    with pytest.raises(ValueError):
        select.variance_threshold(df, {"a": F.col("a"), "b": F.col("b")}, 0.0)


def test_axes_of_wide_rows_come_from_a_small_basis(spark):
    """120 columns, 4 axes, a basis of at most 30: restarts, several partitions; a rank-2 table and a constant one."""
    rng = np.random.default_rng(0)
    d, n = 120, 500
    X = rng.normal(size=(n, d)) * 0.3 + (rng.normal(size=(n, 5)) * [9, 7, 5, 4, 3]) @ np.linalg.qr(rng.normal(size=(d, 5)))[0].T
    df = spark.createDataFrame([(x.tolist(),) for x in X] + [(None,)], "v array<double>").repartition(3)
    mean, axes, vals, total, rows = select.principal_axes(df, "v", 4, tol=1e-9, max_basis=30)
    cov = np.cov(X, rowvar=False, bias=True)
    assert rows == n and total == pytest.approx(np.trace(cov)) and vals == pytest.approx(np.linalg.eigvalsh(cov)[::-1][:4], rel=1e-9)
    assert np.abs(cov @ axes.T - axes.T * vals).max() < 1e-8 * total and axes @ axes.T == pytest.approx(np.eye(4), abs=1e-10)
    flat = X[:, :2] @ rng.normal(size=(2, 30))
    low = spark.createDataFrame([(x.tolist(),) for x in flat], "v array<double>")
    _, axes, vals, _, _ = select.principal_axes(low, "v", 5)
    assert vals[2:] == pytest.approx(np.zeros(3), abs=1e-9) and axes @ axes.T == pytest.approx(np.eye(5), abs=1e-9)
    same = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.0],)], "v array<double>")
    assert select.pca_fit(same, "v", 1)[2].tolist() == [0.0]
