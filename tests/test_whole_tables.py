"""Registered queries answer for every row of their tables, not for a subset."""

import math

import numpy as np
import pytest

import __spark_entry__
from meterline.operators import georef, layers, nearest
from test_entry import DATA


def left_out(rows, kind):
    """(residual, left_out) of each row (px, py, x, y), by a fit of its own for each point."""
    u, v, x, y = np.array(rows).T
    one, none = np.ones(len(rows)), np.zeros(len(rows))
    if kind == "affine":
        a = np.stack([np.stack([u, v, one, none, none, none], 1), np.stack([none, none, none, u, v, one], 1)], 1)
    else:
        a = np.stack([np.stack([u, v, one, none], 1), np.stack([-v, u, none, one], 1)], 1)
    w, out = np.stack([x, y], 1), []
    for i in range(len(rows)):
        errors = []
        for keep in (np.ones(len(rows), bool), np.arange(len(rows)) != i):
            p = np.linalg.lstsq(a[keep].reshape(-1, a.shape[2]), w[keep].ravel(), rcond=None)[0]
            errors.append(float(np.hypot(*(a[i] @ p - w[i]))))
        out.append(tuple(errors))
    return out


@pytest.mark.parametrize("kind", ["affine", "similarity"])
def test_points_left_out(spark, kind):
    r = np.random.default_rng(7)
    rows = [(*map(float, r.uniform(0, 500, 2)), *map(float, r.uniform(0, 90, 2))) for _ in range(12)]
    points = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)] + [(99, None, 1.0, 2.0, 3.0)], "point_id long, px double, py double, x double, y double")
    got = {x.point_id: (x.residual, x.left_out) for x in georef.residuals(points, kind).collect()}
    assert got.pop(99) == (None, None)
    assert [got[i] for i in range(12)] == [pytest.approx(x, rel=1e-6) for x in left_out(rows, kind)]


def test_a_point_that_the_fit_needs(spark):
    points = spark.createDataFrame([(0, 0.0, 0.0, 1.0, 2.0), (1, 9.0, 0.0, 3.0, 4.0), (2, 0.0, 9.0, 7.0, 5.0)], "point_id long, px double, py double, x double, y double")
    assert all(r.residual == pytest.approx(0, abs=1e-9) and r.left_out is None for r in georef.residuals(points).collect())


def test_every_supplier_is_a_point(spark):
    d = "/root/testdata/sf0.01"
    got = {r.point_id: (r.residual, r.left_out) for r in __spark_entry__.queries()["georeference"](spark, d).collect()}
    s = [(r.s_suppkey, r.s_acctbal) for r in spark.read.parquet(f"{d}/supplier.parquet").collect()]
    want = left_out([(k * 3.0, k % 7 * 5.0, k * 6.0 + a / 1e4, k % 7 * -9.0) for k, a in s], "affine")  # far from the origin in the query
    assert len(got) == len(s) > 60
    assert [got[k] for k, _ in s] == [pytest.approx(x, rel=1e-5, abs=1e-6) for x in want]


def test_every_reading_is_settled(spark, monkeypatch):
    """OCR readings of all dots reach the operator, also of those read by hand; each of its four cases occurs."""
    given, real = [], layers.settled_readings
    monkeypatch.setattr(layers, "settled_readings", lambda r: given.append(r) or real(r))
    out = {r.dot: (r.number, r.origin) for r in __spark_entry__.queries()["settled_readings"](spark, DATA).collect()}
    parts = spark.read.parquet(f"{DATA}/part.parquet").count()
    assert given[0].where("origin = 'ocr'").select("dot").distinct().count() == parts
    assert out[13] == (20_000_013, "manual") and out[17] == (18, "manual") and out[1] == (1, "ocr")
    assert all(dot not in out for dot in (6, 7, 11, 18))  # a disputed number, both its dots; a dot with two numbers; a number taken by hand


def test_nearest_place_however_far(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 7e5, 0.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 3e6, 4e6)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 3.0, 0.0), (8, 0.0, -9.0), (9, None, 0.0)], "rid long, rx double, ry double")
    got = {r.id: (r.rid, r.distance) for r in nearest.nearest(a, b).collect()}
    assert got == {1: (7, 3.0), 2: (7, 699997.0), 3: (None, None), 4: (None, None), 5: (7, pytest.approx(math.hypot(3e6 - 3, 4e6)))}
    assert [r.rid for r in nearest.nearest(a, b.limit(0)).collect()] == [None] * 5


@pytest.mark.parametrize("kind", ["affine", "similarity"])
def test_fit_far_from_the_origin(spark, kind):
    """Grid coordinates of millions of metres, points a few metres apart."""
    r = np.random.default_rng(3)
    u, v = r.uniform(0, 9, (2, 40))
    x, y = 5_600_000 + 0.4 * u + 0.3 * v, 7_400_000 + 0.3 * u - 0.4 * v
    m = georef.fit(spark.createDataFrame([tuple(map(float, t)) for t in zip(u + 1e6, v + 2e6, x, y)], "px double, py double, x double, y double"), kind)
    assert m[:2] == pytest.approx(np.array([[0.4, 0.3], [0.3, -0.4]]), abs=1e-7)
    line = spark.createDataFrame([(float(i), 2.0 * i, 1.0 * i, 0.0) for i in range(5)], "px double, py double, x double, y double")
    if kind == "affine":
        with pytest.raises(ValueError, match="line"):
            georef.fit(line)
