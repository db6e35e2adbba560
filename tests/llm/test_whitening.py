"""TSQR whitening against an eigendecomposition of the covariance."""

from __future__ import annotations

import numpy as np
import pytest

from codeloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n long, component int"  # with clashing columns


def made(spark, rows):
    return spark.createDataFrame([(i, v, "x", None, None) for i, v in rows], SCHEMA)


@pytest.mark.parametrize("parts", [1, 40])
def test_equals_eigendecomposition(spark, parts):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7)) * [1, 2, 3, 4, 5, 6, 90]).astype(np.float32)
    odd = [(900, None), (901, [1.0] * 6), (902, [1.0] * 6 + [float("nan")]), (903, [float("inf")] + [0.0] * 6), (904, [None] + [0.0] * 6)]
    got = whitening.whiten(made(spark, [(i % 290, v.tolist()) for i, v in enumerate(vectors)] + odd).repartition(parts)).toPandas()
    x = np.floor(64 * vectors.astype(float)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    e, axes = np.linalg.eigh(centred.T @ centred / n)
    e, axes = e[::-1], axes[:, ::-1]
    whitened = centred @ axes / np.sqrt(e)
    deviation = ((n * x - sums) ** 2).sum(axis=1)
    assert len(got) == 300 * 7 and set(got.vec_id) == set(range(290)) and set(got.n) == {300}
    wanted = {(i % 290, k + 1, int(deviation[i]), round(abs(whitened[i, k]), 6)) for i in range(300) for k in range(7)}
    assert {(r.vec_id, r.component, r.deviation, round(abs(r.whitened), 6)) for r in got.itertuples()} == wanted
    explained = got.groupby("component").explained.first().to_numpy()
    assert np.allclose(explained, e / e.sum(), rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_signs_agree_over_rows(spark):
    """The rows' scalar products are those of the whitened vectors whatever the signs, but only if all rows share them."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(60, 5)).astype(np.float32)
    got = whitening.whiten(made(spark, list(enumerate(vectors.tolist()))).repartition(9)).toPandas()
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.allclose(z.T @ z / 60, np.eye(5), atol=1e-9)
    x = np.floor(64 * vectors.astype(float))
    c = x - x.mean(axis=0)
    assert np.allclose(z @ z.T, c @ np.linalg.inv(c.T @ c / 60) @ c.T, atol=1e-6)


def test_without_variance(spark):
    assert whitening.whiten(made(spark, [])).count() == 0
    assert whitening.whiten(made(spark, [(1, None), (2, [])])).count() == 0
    equal = whitening.whiten(made(spark, [(1, [1.0, 2.0])] * 50 + [(None, [1.0, 2.0])])).collect()
    assert len(equal) == 102 and {(r.n, r.deviation, r.whitened, r.identity_error) for r in equal} == {(51, 0, 0.0, 0.0)}
    line = whitening.whiten(made(spark, [(i, [float(i), float(i)]) for i in range(4)])).collect()
    assert {r.component for r in line if abs(r.whitened) > 0.1} == {1} and max(r.explained for r in line) == pytest.approx(1)


def test_tree_merges_factors(spark):
    rows = np.arange(24.0).reshape(12, 2) ** 1.5
    parts = spark.createDataFrame([(i, bytearray(np.linalg.qr(rows[2 * i : 2 * i + 2], mode="r").tobytes())) for i in range(6)], "part long, r binary")
    r = whitening.merged_factor(parts, 2, fan=2)
    assert np.allclose(r.T @ r, rows.T @ rows)


def test_overflow_fails(spark):
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(made(spark, [(1, [3e7]), (2, [-3e7])])).count()
