"""Spatial joins as equality joins on grid cells with an exact distance behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from . import coverage, quadtree, segments


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size)


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of left (id, x, y) and right (rid, rx, ry) rows at most `radius` apart, with the distance.

    Each left row looks into its own grid cell and the eight around it, so the join is an equality on cells.
    """
    around = F.explode(F.array(*[F.struct((_cell(F.col("x"), radius) + i).alias("cx"), (_cell(F.col("y"), radius) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    a = left.withColumn("c", around).select(*left.columns, "c.cx", "c.cy")
    b = right.withColumns({"cx": _cell(F.col("rx"), radius), "cy": _cell(F.col("ry"), radius)})
    pairs = a.join(b, ["cx", "cy"]).withColumn("distance", geo.distance(F.col("x"), F.col("y"), F.col("rx"), F.col("ry")))
    return pairs.where(F.col("distance") <= radius).drop("cx", "cy")


def nearest(left: DataFrame, right: DataFrame, bound: int = 32) -> DataFrame:
    """For each left row (id, x, y) the nearest right row (rid) and its distance; the smallest rid on a tie.

    right is divided by a quad-tree whose leaves hold at most `bound` places, so the pairs that are looked at follow the
    number of rows, not how dense they lie. Rows of left without a place (null, NaN or infinite), and all rows if right has no
    place, have nulls; a repeated row of left is answered each time, repeated places of right are one.
    """
    placed = quadtree.real("x", "y")
    tree = quadtree.build(right.where(quadtree.real("rx", "ry")).groupBy(F.col("rx").cast("double").alias("x"), F.col("ry").cast("double").alias("y")).agg(F.min("rid").alias("rid")), bound)
    none = [F.lit(None).cast(right.schema["rid"].dataType).alias("rid"), F.lit(None).cast("double").alias("distance")]
    if tree is None:
        return left.select("id", *none)
    asked = left.where(placed).groupBy("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.count("*").alias("times"))
    found = quadtree.nearest_place(asked, tree).withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    return found.select("id", "near.rid", "near.distance").unionByName(left.where(~placed).select("id", *none))


def nearest_or_new(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """As nearest, but what has nothing within the radius is new: rid null, `new` true."""
    best = within(left, right, radius).groupBy("id").agg(F.min(F.struct("distance", "rid")).alias("b")).select("id", "b.rid", "b.distance")
    return left.select("id").join(best, "id", "left").withColumn("new", F.col("rid").isNull())


def _whole(zones: DataFrame) -> DataFrame:
    """zone, rings: a zone given by one `ring` has just that."""
    rings = F.col("rings") if "rings" in zones.columns else F.array("ring")
    return zones.select("zone", rings.alias("rings"))


def zones_at(places: DataFrame, zones: DataFrame) -> DataFrame:
    """places (x, y and any columns) with the `zone` they lie in: polygons of several parts and with holes, all rings in `rings`.

    A zone is registered in the grid cells of its box; cells are as wide as the mean box, so a zone comes into few of them. A
    place in no zone has no row, one in several zones (they overlap) a row for each; a place on a border lies on one side of it.
    """
    low = lambda c: F.array_min(F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[c]))))
    high = lambda c: F.array_max(F.flatten(F.transform("rings", lambda r: F.transform(r, lambda p: p[c]))))
    boxed = _whole(zones).withColumns({"x0": low("x"), "x1": high("x"), "y0": low("y"), "y1": high("y")}).where("x0 is not null")
    size = boxed.agg(F.avg(F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))).first()[0] or 1.0
    tiled = boxed.withColumn("cx", F.explode(F.sequence(_cell(F.col("x0"), size), _cell(F.col("x1"), size)))).withColumn("cy", F.explode(F.sequence(_cell(F.col("y0"), size), _cell(F.col("y1"), size))))
    at = places.where(quadtree.real("x", "y")).drop("zone", "cx", "cy").withColumns({"cx": _cell(F.col("x"), size), "cy": _cell(F.col("y"), size)})
    met = at.join(tiled, ["cx", "cy"]).where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    inside = F.size(F.filter("rings", lambda r: geo.in_ring(F.col("x"), F.col("y"), r))) % 2 == 1
    return met.where(inside).drop("cx", "cy", "rings", "x0", "x1", "y0", "y1")


def touching(zones: DataFrame, others: DataFrame, touch: float) -> DataFrame:
    """zone, near: zones whose borders come within `touch` of another zone's border, by their edges, not their corners alone."""
    a, b = (coverage.edges_of(_whole(z), "zone") for z in (zones, others))
    return segments.near(a, b, touch).where("l_zone <> r_zone").select(F.col("l_zone").alias("zone"), F.col("r_zone").alias("near")).distinct()


def reach(meters: DataFrame, zones: DataFrame, radius: float = 500.0, touch: float = 1.0) -> DataFrame:
    """(meter, zone, distance, origin): zones whose polygon lies within `radius` of a meter.

    meters: meter, x, y, zone; zones: zone and ring (array of struct x, y) or rings (several parts, holes). Zones' edges and meters
    meet in grid cells, so a meter is measured against nearby edges only; a meter inside a zone is at distance 0. A meter
    without a place has its own zone, also one without a polygon, and those that touch it; without a zone either it has none.
    """
    whole = _whole(zones)
    placed = meters.where(quadtree.real("x", "y")).select("meter", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    points = placed.select("meter", F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("x").alias("bx"), F.col("y").alias("by"))
    by_edge = segments.near(points, coverage.edges_of(whole, "zone"), radius, radius).select(F.col("l_meter").alias("meter"), F.col("r_zone").alias("zone"), "distance")
    by_place = by_edge.unionByName(zones_at(placed, whole).select("meter", "zone", F.lit(0.0).alias("distance"))).groupBy("meter", "zone").agg(F.round(F.min("distance"), 1).alias("distance")).withColumn("origin", F.lit("radius"))
    lost = meters.where(~quadtree.real("x", "y") & F.col("zone").isNotNull()).select("meter", "zone")
    near = touching(whole.join(lost.select("zone").distinct(), "zone", "left_semi"), whole, touch)
    by_zone = lost.unionByName(lost.join(near, "zone").select("meter", F.col("near").alias("zone"))).select("meter", "zone", F.lit(None).cast("double").alias("distance"), F.lit("own or adjacent zone").alias("origin"))
    return by_place.unionByName(by_zone).groupBy("meter", "zone").agg(F.min("distance").alias("distance"), F.min_by("origin", F.coalesce("distance", F.lit(float("inf")))).alias("origin"))


def reach_statistics(table: DataFrame) -> DataFrame:
    """Fewest, median and most zones a meter reaches."""
    n = table.groupBy("meter").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("fewest"), F.percentile_approx("n", 0.5).alias("median"), F.max("n").alias("most"))


def nearest_line(left: DataFrame, lines: DataFrame, radius: float, fallback: DataFrame | None = None) -> DataFrame:
    """For each left row (id, x, y) the nearest line (name, ax, ay, bx, by: segments) within `radius`, else the fallback's name.

    A segment is registered in the grid cells of its box, so a point meets only segments nearby. fallback: id, name.
    """
    span = lambda a, b: F.sequence(_cell(F.least(a, b) - radius, radius), _cell(F.greatest(a, b) + radius, radius))
    tiled = lines.withColumn("cx", F.explode(span("ax", "bx"))).withColumn("cy", F.explode(span("ay", "by")))
    at = left.withColumns({"cx": _cell(F.col("x"), radius), "cy": _cell(F.col("y"), radius)})
    d = geo.segment_distance(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    best = at.join(tiled, ["cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).groupBy("id").agg(F.min(F.struct("distance", "name")).alias("b")).select("id", "b.name", "b.distance")
    out = left.select("id").join(best, "id", "left")
    if fallback is None:
        return out
    return out.join(fallback.select("id", F.col("name").alias("other")), "id", "left").select("id", F.coalesce("name", "other").alias("name"), "distance")
