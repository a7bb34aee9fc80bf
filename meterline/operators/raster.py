"""Dots in rasters: connected components of pixels, tile by tile, and merged dots split by k-means, all rasters at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import kept
from .coverage import components

#: The side of a tile; a task labels a tile's pixels in memory, a quarter of a million at most.
TILE = 512
#: Columns of a raster at most: a pixel's number is its row times this plus its column.
WIDE = 1 << 31
_AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def labelled_tile(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each pixel of a tile the place, in these arrays, of the first pixel of its component (eight neighbours).

    Every pixel takes the least label around it, then that label's own, until nothing changes: the steps follow the logarithm of
    a component's extent, not its length.
    """
    x0, y0 = x.min() - 1, y.min() - 1
    width = int(x.max() - x0 + 2)
    at = np.full(width * int(y.max() - y0 + 2), -1, np.int64)
    place = (y - y0) * width + (x - x0)
    order = np.argsort(place, kind="stable")
    at[place[order][::-1]] = order[::-1]  # of repeated pixels the first
    near = np.stack([at[place + dy * width + dx] for dx, dy in [*_AROUND, (0, 0)]])
    label = np.arange(len(x))
    while True:
        new = np.where(near >= 0, label[near], len(x)).min(0)
        np.minimum.at(new, label, new.copy())  # the label's own pixel hears of it
        new = new[new]
        if (new == label).all():
            return label
        label = new


def dots(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """pixels (raster long, x, y: whole numbers from 0) with `dot`, the number of the first pixel (row by row) of the component that
    it belongs to within its raster; pixels touch at sides and corners. Repeated pixels count once, those with nulls are left
    out; an empty table gives none.

    A task labels one tile; components that touch over a tile's edge are linked by their pixels there, and links are resolved for
    all rasters at once. So a raster, or a component, may be larger than any task.
    """
    p = pixels.where("raster is not null and x is not null and y is not null").select(F.col("raster").cast("long").alias("raster"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
    t = p.withColumns({"tx": F.floor(F.col("x") / tile), "ty": F.floor(F.col("y") / tile)})

    def label(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([("y", "ascending"), ("x", "ascending")])
        x, y = np.asarray(t.column("x")), np.asarray(t.column("y"))
        first = labelled_tile(x, y)
        return pa.table({"raster": t.column("raster"), "x": x, "y": y, "part": y[first] * WIDE + x[first]})

    local = kept(t.groupBy("raster", "tx", "ty").applyInArrow(label, "raster bigint, x bigint, y bigint, part bigint"), "dots")
    edge = local.where(F.pmod("x", F.lit(tile)).isin(0, tile - 1) | F.pmod("y", F.lit(tile)).isin(0, tile - 1))
    # Parts of all rasters are told apart by a number of their own.
    named = kept(local.select("raster", "part").distinct().withColumn("n", F.monotonically_increasing_id()), "dot-parts")
    edge = edge.join(named, ["raster", "part"])
    over = edge.select("raster", "n", F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in _AROUND])).alias("to")).select("raster", F.col("n").alias("a"), "to.x", "to.y")
    links = over.join(edge.select("raster", "x", "y", F.col("n").alias("b")), ["raster", "x", "y"]).where("a <> b").select("a", "b").distinct()
    whole = named.join(components(links).withColumnsRenamed({"id": "n"}), "n", "left").withColumn("label", F.coalesce("label", "n"))
    first = whole.groupBy("label").agg(F.min("part").alias("dot"))
    return local.join(whole.join(first, "label").select("raster", "part", "dot"), ["raster", "part"]).select("raster", "x", "y", "dot")


def measured(labelled: DataFrame) -> DataFrame:
    """raster, dot, area, cx, cy and the box of each dot."""
    sides = [f(c).alias(f"{c}{i}") for c in "xy" for i, f in ((0, F.min), (1, F.max))]
    return labelled.groupBy("raster", "dot").agg(F.count("*").alias("area"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), *sides)


def split_dots(labelled: DataFrame, size: float, least: int = 1, rounds: int = 50, still: float = 0.01) -> DataFrame:
    """raster, dot, no, x, y, area: the centres of single dots, where a dot of `size` pixels is one and a larger one is several that
    have run together: as many as its area holds, rounded. Dots under `least` pixels are left out.

    k-means by rounds over all merged dots: the first centres are the means of equal slices along a dot's longer side, then each
    pixel goes to its nearest centre and centres to their pixels' means, until none moves by more than `still`. Pixels are summed
    by centre in each task before the exchange; a centre without pixels is dropped.
    """
    m = measured(labelled).where(F.col("area") >= least).withColumn("k", F.greatest(F.lit(1), F.round(F.col("area") / F.lit(size))).cast("int"))
    single = m.where("k = 1").select("raster", "dot", F.lit(0).alias("no"), F.col("cx").alias("x"), F.col("cy").alias("y"), "area")
    merged = kept(labelled.join(m.where("k > 1"), ["raster", "dot"]), "merged-dots")
    wide = F.col("x1") - F.col("x0") >= F.col("y1") - F.col("y0")
    slice_of = lambda c: F.floor((F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0") + 1) * F.col("k")).cast("int")
    keys = ["raster", "dot"]

    def means(assigned: DataFrame) -> DataFrame:
        each = assigned.groupBy(*keys, "no").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
        return each.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("no", "x", "y", "n"))).alias("centres"))

    centres = kept(means(merged.withColumn("no", F.when(wide, slice_of("x")).otherwise(slice_of("y")))), "dot-centres")
    for _ in range(rounds):
        away = lambda c: (c["x"] - F.col("x")) * (c["x"] - F.col("x")) + (c["y"] - F.col("y")) * (c["y"] - F.col("y"))
        nearest = F.array_min(F.transform("centres", lambda c: F.struct(away(c).alias("d"), c["no"].alias("no"))))["no"]
        new = kept(means(merged.select(*keys, "x", "y").join(centres, keys).withColumn("no", nearest).drop("centres")), "dot-centres")
        was = centres.select(*keys, F.explode("centres").alias("c")).select(*keys, "c.*")
        now = new.select(*keys, F.explode("centres").alias("c")).select(*keys, "c.no", F.col("c.x").alias("nx"), F.col("c.y").alias("ny"))
        moved = was.join(now, [*keys, "no"], "left").where(F.col("nx").isNull() | (F.hypot(F.col("x") - F.col("nx"), F.col("y") - F.col("ny")) > still))
        centres = new
        if not moved.head(1):
            break
    return single.unionByName(centres.select(*keys, F.explode("centres").alias("c")).select(*keys, "c.no", "c.x", "c.y", F.col("c.n").alias("area")))
