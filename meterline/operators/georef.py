"""Fits of map pixels to coordinates by least squares, about the points' centre and in orthogonal directions.

Spark sums products of centred columns, so grid coordinates of millions of metres lose no digits; the driver only divides sums.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COORDINATES = ("px", "py", "x", "y")


@dataclass(frozen=True)
class Fit:
    """x = centre + slopes . (u, w), u being px from its mean and w what is left of py from its mean after `shear` times u; u and w
    are orthogonal over the points, with the sums of squares `uu` and `ww`."""

    n: int
    means: dict[str, float]
    shear: float
    uu: float
    ww: float
    slopes: dict[str, tuple[float, float]]

    def directions(self) -> tuple[Column, Column]:
        u = F.col("px") - F.lit(self.means["px"])
        return u, F.col("py") - F.lit(self.means["py"]) - F.lit(self.shear) * u

    def predicted(self, c: str) -> Column:
        u, w = self.directions()
        return F.lit(self.means[c]) + F.lit(self.slopes[c][0]) * u + F.lit(self.slopes[c][1]) * w

    def leverage(self) -> Column:
        u, w = self.directions()
        return F.lit(1 / self.n) + u * u / F.lit(self.uu) + w * w / F.lit(self.ww)

    def matrix(self) -> np.ndarray:
        """3 x 2 matrix M with [px, py, 1] M = [x, y]."""
        first = [self.slopes[c][0] - self.shear * self.slopes[c][1] for c in "xy"]
        second = [self.slopes[c][1] for c in "xy"]
        return np.array([first, second, [self.means[c] - a * self.means["px"] - b * self.means["py"] for c, a, b in zip("xy", first, second)]])


def _complete(points: DataFrame) -> DataFrame:
    return points.where(" and ".join(f"{c} is not null" for c in COORDINATES))


def solve(points: DataFrame, kind: str = "affine") -> Fit:
    """The fit of all points (px, py, x, y) without a null coordinate. An affine fit takes its three unknowns for each of x and y
    one after the other: mean, px about its mean, the rest of py. A similarity turns and scales alike in both, image rows
    growing downwards, so its two slopes are those of one complex number."""
    t = _complete(points)
    m = t.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in COORDINATES]).first().asDict()
    n = m.pop("n")
    if n < (3 if kind == "affine" else 2):
        raise ValueError("too few control points")
    off = {c: F.col(c) - F.lit(m[c]) for c in COORDINATES}
    s = t.agg(F.sum(off["px"] ** 2).alias("uu"), F.sum(off["py"] ** 2).alias("vv"), F.sum(off["px"] * off["py"]).alias("uv"), *[F.sum(off[p] * off[c]).alias(p + c) for p in ("px", "py") for c in "xy"]).first()
    if kind != "affine":
        size = s.uu + s.vv
        if not size:
            raise ValueError("all control points are one")
        p, q = (s.pxx - s.pyy) / size, (s.pyx + s.pxy) / size
        return Fit(n, m, 0.0, size, size, {"x": (p, q), "y": (q, -p)})
    shear = s.uv / s.uu if s.uu else 0.0
    w = off["py"] - F.lit(shear) * off["px"]
    r = t.agg(F.sum(w * w).alias("ww"), *[F.sum(w * off[c]).alias(c) for c in "xy"]).first()
    if not s.uu or r.ww <= 1e-24 * s.vv or r.ww <= 0:
        raise ValueError("all control points lie on one line")
    return Fit(n, m, shear, s.uu, r.ww, {"x": (s.pxx / s.uu, r.x / r.ww), "y": (s.pxy / s.uu, r.y / r.ww)})


def fit(points: DataFrame, kind: str = "affine") -> np.ndarray:
    """3 x 2 matrix M with [px, py, 1] M = [x, y], from points (px, py, x, y)."""
    return solve(points, kind).matrix()


def residuals(points: DataFrame, kind: str = "affine") -> DataFrame:
    """points (point_id, px, py, x, y) with `residual` and `left_out`, the error at the point when it isn't fitted.

    Leaving a point out divides its error by 1 - h, h being its leverage: a share for the mean and one for each direction. A
    point that the fit needs (h = 1) has no left_out; a point with a null coordinate isn't fitted and has neither.
    """
    f = solve(points, kind)
    off = [f.predicted(c) - F.col(c) for c in "xy"]
    out = points.select(F.col("point_id").cast("long").alias("point_id"), F.hypot(*off).alias("residual"), (1 - f.leverage()).alias("free"))
    return out.select("point_id", "residual", F.when(F.col("free") > 1e-9, F.col("residual") / F.col("free")).alias("left_out"))


def error_summary(errors: DataFrame) -> DataFrame:
    return errors.agg(*[f(c).alias(f"{n}_{c}") for c in ("residual", "left_out") for n, f in (("rmse", lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))), ("median", lambda c: F.percentile(c, 0.5)), ("max", F.max))])
