"""Segments (ax, ay, bx, by) that meet or lie near each other: an equality join on grid cells with the exact test behind it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo


def typical(segments: DataFrame) -> float:
    """A cell size for these segments: twice their mean length."""
    return 2 * (segments.agg(F.avg(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")))).first()[0] or 0.5) or 1.0


def in_cells(segments: DataFrame, size: float, pad: float = 0.0) -> DataFrame:
    """A row for each grid cell (gx, gy) that a segment, widened by `pad`, may touch. A long segment is taken in pieces no longer
    than a cell, so it comes into as many cells as it is long, not as its box is wide."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    pieces = F.greatest(F.ceil(F.hypot(dx, dy) / size), F.lit(1)).cast("int")
    t = segments.withColumn("__n", pieces).withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = lambda c, d, i: F.col(c) + d * (F.col("__i") + i) / F.col("__n")
    slack = pad + 1e-9 * size
    span = lambda c, d: F.sequence(F.floor((F.least(at(c, d, 0), at(c, d, 1)) - slack) / size), F.floor((F.greatest(at(c, d, 0), at(c, d, 1)) + slack) / size))
    t = t.withColumn("gx", F.explode(span("ax", dx))).withColumn("gy", F.explode(span("ay", dy))).drop("__n", "__i")
    return t.distinct()


def _side(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    return (bx - ax) * (y - ay) - (by - ay) * (x - ax)


def _both(left: DataFrame, right: DataFrame, size: float, pad: float) -> DataFrame:
    """Pairs of segments that share a cell, once each: columns of left with prefix l_, of right with prefix r_."""
    a, b = in_cells(left, size, pad), in_cells(right, size, 0.0)
    a = a.select("gx", "gy", *[F.col(c).alias(f"l_{c}") for c in left.columns])
    b = b.select("gx", "gy", *[F.col(c).alias(f"r_{c}") for c in right.columns])
    return a.join(b, ["gx", "gy"]).drop("gx", "gy")


def _ends(s: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{s}_{c}") for c in ("ax", "ay", "bx", "by"))


def crossing(left: DataFrame, right: DataFrame, size: float | None = None) -> DataFrame:
    """Pairs of a left and a right segment that have a point in common, with that point (x, y): columns l_*, r_*, x, y. Of two that
    lie on one line the point is the middle of what they share. Segments with a null end meet nothing; a segment without length
    is a point; a pair is returned once, repeated rows count as one."""
    size = size or typical(left)
    a, c = _ends("l"), _ends("r")
    t = _both(left.dropna(subset=["ax", "ay", "bx", "by"]), right.dropna(subset=["ax", "ay", "bx", "by"]), size, 0.0)
    s1, s2, s3, s4 = _side(*a, c[0], c[1]), _side(*a, c[2], c[3]), _side(*c, a[0], a[1]), _side(*c, a[2], a[3])
    cross = (a[2] - a[0]) * (c[3] - c[1]) - (a[3] - a[1]) * (c[2] - c[0])
    t = t.withColumns({"__s1": s1, "__s2": s2, "__s3": s3, "__s4": s4, "__c": cross})
    within = lambda u: (F.greatest(F.least(a[u], a[u + 2]), F.least(c[u], c[u + 2])), F.least(F.greatest(a[u], a[u + 2]), F.greatest(c[u], c[u + 2])))
    (x0, x1), (y0, y1) = within(0), within(1)
    boxes = (x0 <= x1) & (y0 <= y1)
    proper = (F.col("__c") != 0) & (F.col("__s1") * F.col("__s2") <= 0) & (F.col("__s3") * F.col("__s4") <= 0)
    flat = (F.col("__c") == 0) & (F.col("__s1") == 0) & (F.col("__s3") == 0) & boxes
    share = ((c[0] - a[0]) * (c[3] - c[1]) - (c[1] - a[1]) * (c[2] - c[0])) / F.nullif(F.col("__c"), F.lit(0.0))
    t = t.where(proper | flat)
    out = t.withColumns({"x": F.when(proper, a[0] + share * (a[2] - a[0])).otherwise((x0 + x1) / 2), "y": F.when(proper, a[1] + share * (a[3] - a[1])).otherwise((y0 + y1) / 2)})
    return out.drop("__s1", "__s2", "__s3", "__s4", "__c").distinct()


def near(left: DataFrame, right: DataFrame, reach: float, size: float | None = None) -> DataFrame:
    """Pairs of a left and a right segment at most `reach` apart, with their `distance` (0 where they meet): columns l_*, r_*."""
    size = size or max(typical(left), reach)
    a, c = _ends("l"), _ends("r")
    t = _both(left.dropna(subset=["ax", "ay", "bx", "by"]), right.dropna(subset=["ax", "ay", "bx", "by"]), size, reach)
    apart = F.least(geo.segment_distance(a[0], a[1], *c), geo.segment_distance(a[2], a[3], *c), geo.segment_distance(c[0], c[1], *a), geo.segment_distance(c[2], c[3], *a))
    meet = (_side(*a, c[0], c[1]) * _side(*a, c[2], c[3]) < 0) & (_side(*c, a[0], a[1]) * _side(*c, a[2], a[3]) < 0)
    return t.withColumn("distance", F.when(meet, F.lit(0.0)).otherwise(apart)).where(F.col("distance") <= reach).distinct()


def crossings_of_lines(lines: DataFrame, wanted: DataFrame, size: float | None = None) -> DataFrame:
    """first, second, x, y, n: for each wanted pair of names (first, second) the centre of the points where their lines meet, and
    how many those are; null and 0 where they don't. lines: name, ax, ay, bx, by, a row for each segment.

    A point where several segments of a line meet another counts once (points are told apart to a micrometre). Names in `wanted`
    may be repeated and null; a pair of one name with itself has no crossing of its own.
    """
    asked = wanted.select("first", "second").distinct()
    met = crossing(lines.join(asked.select(F.col("first").alias("name")).distinct(), "name", "left_semi"), lines.join(asked.select(F.col("second").alias("name")).distinct(), "name", "left_semi"), size or typical(lines))
    points = met.where("l_name <> r_name").select(F.col("l_name").alias("first"), F.col("r_name").alias("second"), F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))
    points = points.join(asked, ["first", "second"], "left_semi").distinct()
    return asked.join(points.groupBy("first", "second").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n")), ["first", "second"], "left").fillna(0, ["n"])
