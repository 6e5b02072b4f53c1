"""Whitening against numpy, in the randomised range and after the expansion to all dimensions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import whitening

ROW = "vec_id long, embedding array<float>, x string, n long"


def frame(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, [float(c) for c in v], "x", 1) for i, v in enumerate(vectors)], ROW).repartition(3)


def plain(vectors, wanted=16):
    x = np.floor(64 * np.asarray(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    e, v = np.linalg.eigh(c.T @ c / n)
    e, v = e[::-1][:wanted], v[:, ::-1][:, :wanted]
    return n, ((n * x - s) ** 2).sum(1), ((n * x - s) / n) @ (v / np.sqrt(e)), e / ((c * c).sum() / n), c


def check(spark, vectors, wanted=16):
    rows = whitening.whiten(frame(spark, vectors), wanted).toPandas()
    n, deviation, white, explained, c = plain(vectors, wanted)
    got = rows.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    assert got.shape == white.shape
    assert np.abs(got * np.sign((got * white).sum(0)) - white).max() < 1e-8
    first = rows[rows["component"] == 1].sort_values("vec_id")
    assert (first["deviation"].to_numpy() == deviation).all()
    assert (rows["n"] == n).all()
    assert (rows["identity_error"] < 1e-8).all()
    assert np.allclose(rows[rows["vec_id"] == 0].sort_values("component")["explained"], explained, rtol=1e-9)


def test_flat_spectrum_needs_all_dimensions(spark):
    check(spark, np.random.default_rng(1).standard_normal((400, 40)))


def test_steep_spectrum_stays_in_the_range(spark):
    vectors = np.random.default_rng(2).standard_normal((500, 60)) * 300 * 0.4 ** np.arange(60)
    check(spark, vectors, 4)
    rows = whitening.integer_rows(frame(spark, vectors))
    fit = rows.select("x").distinct()
    found = whitening.find_components(fit, whitening.centre_of(fit, 60), 60, wanted=4, oversampling=8)
    assert found.size == 12


def test_copies_count_once_in_the_fit(spark):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((120, 6)) * [9, 5, 3, 2, 1, 0.5]
    check(spark, np.vstack([vectors, np.repeat(vectors[:1], 300, 0)]))


def test_awkward_rows(spark):
    rng = np.random.default_rng(4)
    good = [(i, [float(c) for c in v], "x", 1) for i, v in enumerate(rng.standard_normal((60, 3)))]
    bad = [(100, None), (101, []), (102, [1.0, None, 2.0]), (103, [float("nan"), 0.0, 0.0]), (104, [float("inf"), 0.0, 0.0]), (105, [3e38, 0.0, 0.0]), (106, [1.0, 2.0])]
    odd = [(None, [0.5, 0.5, 0.5], "x", 1), good[0]]
    rows = whitening.whiten(spark.createDataFrame([*good, *[(*b, "x", 1) for b in bad], *odd], ROW)).collect()
    assert len(rows) == 62 * 3
    assert {r["vec_id"] for r in rows} == {None, *range(60)}
    assert {r["n"] for r in rows} == {61}


def test_no_variance(spark):
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [[1.0, 2.0]] * 3)).count() == 0
    line = whitening.whiten(frame(spark, [[float(i), 2.0 * i, 0.0] for i in range(9)])).toPandas()
    assert set(line["component"]) == {1}
    assert line["explained"].iloc[0] == pytest.approx(1)


def test_large_deviation_is_exact_or_null():
    centre = whitening.Centre(3, np.array([0, 5]), np.array([1, 2]))
    x = np.array([[7, 9], [1 << 40, 5]])
    assert centre.deviation(x[:1]) == [(21 - 1) ** 2 + (12 - 2) ** 2]
    assert centre.deviation(x) == [500, None]


def test_shift_costs_no_digits(spark):
    """Centring is done on whole numbers, so the offset of a million doesn't reach the whitened values."""
    rows = whitening.integer_rows(frame(spark, [[0.1, -0.2]]))
    assert rows.select(F.element_at("x", 1), F.element_at("x", 2)).first()[:] == (1_000_006, 999_987)
