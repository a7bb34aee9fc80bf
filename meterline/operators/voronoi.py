"""Voronoi cells of places: cut locally, then certified by nearest searches until every corner's nearest place is its own."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import kept
from . import quadtree

#: Corners are snapped to this grid (metres), so that cells that share a corner have it bit by bit.
GRID = 1e-6
#: Where a corner isn't certain yet, the nearest place is sought there; at corners farther than FAR times the nearest known
#: neighbour, also at these shares of the way to it, so that a cell which reaches far shrinks at once.
PROBES, FAR = (0.25, 1 / 16, 1 / 64, 1 / 256), 8
#: The margin of a leaf, as a share of its side, whose places are looked at with the leaf's own.
MARGIN = 0.25
#: By so much nearer a place must be to count (metres, and a share of the coordinates): less is rounding.
NEARER, ROUNDING = GRID / 10, 1e-13

Corner = tuple[float, float, object]  # where an edge begins, and what makes the edge: a neighbour's id, or ("side", number)


def cut(ring: list[Corner], a: float, b: float, c: float, label: object) -> list[Corner]:
    """What of a convex ring has a x + b y <= c; the new edge is called `label`."""
    off = [a * x + b * y - c for x, y, _ in ring]
    if max(off) <= 0:
        return ring
    out: list[Corner] = []
    for i, (x, y, edge) in enumerate(ring):
        j = (i + 1) % len(ring)
        inside, next_inside = off[i] <= 0, off[j] <= 0
        if inside:
            out.append((x, y, edge))
        if inside != next_inside:
            t = off[i] / (off[i] - off[j])
            out.append((x + t * (ring[j][0] - x), y + t * (ring[j][1] - y), label if inside else edge))
    return out if len(out) >= 3 else []


def frame_ring(frame: tuple[float, float, float, float]) -> list[Corner]:
    left, low, right, high = frame
    return sided([(left, low), (right, low), (right, high), (left, high)])


def sided(part: list[tuple[float, float]]) -> list[Corner]:
    return [(x, y, ("side", i)) for i, (x, y) in enumerate(part)]


def cell(x: float, y: float, others: list[tuple[float, float, int]], frame: tuple[float, float, float, float]) -> list[Corner]:
    """The cell of a place among the others (x, y, number), nearest first; edges are called by the others' numbers."""
    ring = frame_ring(frame)
    reach = max(math.hypot(p - x, q - y) for p, q, _ in ring)
    for p, q, number in sorted(others, key=lambda o: (o[0] - x) ** 2 + (o[1] - y) ** 2):
        if math.hypot(p - x, q - y) > 2 * reach * (1 + 1e-9):
            break
        shorter = cut(ring, p - x, q - y, ((p - x) * (p + x) + (q - y) * (q + y)) / 2, number)
        if shorter is not ring:
            ring = shorter
            reach = max((math.hypot(a - x, b - y) for a, b, _ in ring), default=0.0)
    return ring


def centre(a: tuple, b: tuple, c: tuple) -> tuple[float, float]:
    """The point as far from three places (x, y, number); taken in the order of numbers, so it is the same in all three cells."""
    (ax, ay, _), (bx, by, _), (cx, cy, _) = sorted((a, b, c), key=lambda p: p[2])
    bx, by, cx, cy = bx - ax, by - ay, cx - ax, cy - ay
    d = 2 * (bx * cy - by * cx)
    b2, c2 = bx * bx + by * by, cx * cx + cy * cy
    return ax + (cy * b2 - by * c2) / d, ay + (bx * c2 - cx * b2) / d


def between(a: tuple, b: tuple, p: tuple[float, float], q: tuple[float, float]) -> tuple[float, float]:
    """Where the line between p and q is as far from place a as from b."""
    a, b = sorted((a, b), key=lambda s: s[2])
    nx, ny = b[0] - a[0], b[1] - a[1]
    c = nx * (a[0] + b[0]) / 2 + ny * (a[1] + b[1]) / 2
    t = (c - nx * p[0] - ny * p[1]) / (nx * (q[0] - p[0]) + ny * (q[1] - p[1]))
    return p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])


def on_circle(a: tuple, b: tuple, radius: float, near: tuple[float, float]) -> tuple[float, float]:
    """The point at `radius` from both places that is nearer to `near`."""
    a, b = sorted((a, b), key=lambda s: s[2])
    mx, my, dx, dy = (a[0] + b[0]) / 2, (a[1] + b[1]) / 2, b[0] - a[0], b[1] - a[1]
    d = math.hypot(dx, dy)
    h = math.sqrt(max(radius * radius - d * d / 4, 0.0)) / d
    return min([(mx - h * dy, my + h * dx), (mx + h * dy, my - h * dx)], key=lambda p: (p[0] - near[0]) ** 2 + (p[1] - near[1]) ** 2)


def outline(place: tuple, others: list[tuple], part: list[tuple[float, float]], radius: float | None, sides: int = 64) -> list[tuple[float, float]]:
    """The finished ring: the cell within the convex `part` of the boundary and within `radius` of its place, snapped to GRID.

    Corners that several cells share are worked out from what makes them (three places, two places and a side, two places and
    the radius), not from the cutting, so the cells' edges match. An arc is drawn by its ends and the corners of a regular
    polygon of `sides` corners.
    """
    x, y, _ = place
    n = len(part)
    ring = sided(part)
    for p, q, number in others:
        ring = cut(ring, p - x, q - y, ((p - x) * (p + x) + (q - y) * (q + y)) / 2, number) if ring else ring
    if not ring:
        return []
    known = {o[2]: o for o in others}
    side = lambda e: (part[e[1]], part[(e[1] + 1) % n])

    def corner(before: object, after: object, at: tuple[float, float]) -> tuple[float, float]:
        if before in known and after in known:
            return centre(place, known[before], known[after])
        if before in known or after in known:
            neighbour, edge = (before, after) if before in known else (after, before)
            return between(place, known[neighbour], *side(edge))
        return part[after[1]] if after[1] == (before[1] + 1) % n else at

    exact = [(*corner(ring[i - 1][2], e, (px, py)), e) for i, (px, py, e) in enumerate(ring)]
    if radius is not None:
        exact = _within(exact, place, known, side, radius, sides)
    out: list[tuple[float, float]] = []
    for px, py, *_ in exact:
        p = (round(px / GRID) * GRID, round(py / GRID) * GRID)
        if not out or p != out[-1]:
            out.append(p)
    while len(out) > 1 and out[0] == out[-1]:
        out.pop()
    return out if len(out) >= 3 else []


def _within(ring: list[Corner], place: tuple, known: dict, side, radius: float, sides: int) -> list[tuple]:
    """A convex ring cut to the circle around its place; arcs get the corners of the regular polygon that lie on them."""
    x, y, _ = place
    if all(math.hypot(px - x, py - y) <= radius for px, py, _ in ring):
        return ring
    out: list[tuple] = []
    step = 2 * math.pi / sides
    arc_from: float | None = None
    first_in: float | None = None

    def arc(a: float, b: float) -> None:
        b += 2 * math.pi * math.ceil((a - b) / (2 * math.pi))
        k = math.floor(a / step) + 1
        while k * step < b - 1e-12:
            if k * step > a + 1e-12:
                out.append((x + radius * math.cos(k * step), y + radius * math.sin(k * step)))
            k += 1

    for i, (px, py, e) in enumerate(ring):
        qx, qy, _ = ring[(i + 1) % len(ring)]
        dx, dy = qx - px, qy - py
        size = dx * dx + dy * dy
        if size == 0:
            continue
        along, beside = -((px - x) * dx + (py - y) * dy) / size, abs((px - x) * dy - (py - y) * dx) / math.sqrt(size)
        if beside >= radius:
            continue
        half = math.sqrt(radius * radius - beside * beside) / math.sqrt(size)
        a, b = max(0.0, along - half), min(1.0, along + half)
        if a >= b:
            continue

        def at(t: float, edge: object = e, px: float = px, py: float = py, dx: float = dx, dy: float = dy) -> tuple[float, float]:
            p = (px + t * dx, py + t * dy)
            return on_circle(place, known[edge], radius, p) if edge in known else p

        begin, end = (px, py) if a == 0 else at(a), (qx, qy) if b == 1 else at(b)
        if a > 0:  # the boundary comes back from the circle
            angle = math.atan2(begin[1] - y, begin[0] - x)
            if arc_from is not None:
                arc(arc_from, angle)
                arc_from = None
            else:
                first_in = angle
        out.append(begin)
        if b < 1:
            out.append(end)
            arc_from = math.atan2(end[1] - y, end[0] - x)
    if not out:  # all of the circle lies within, or nothing
        inside = all((qx - px) * (y - py) - (qy - py) * (x - px) >= 0 for (px, py, _), (qx, qy, _) in zip(ring, ring[1:] + ring[:1]))
        return [(x + radius * math.cos(k * step), y + radius * math.sin(k * step)) for k in range(sides)] if inside else []
    if arc_from is not None:
        arc(arc_from, first_in if first_in is not None else math.atan2(out[0][1] - y, out[0][0] - x))
    return out


_NEIGHBOURS = "array<struct<x:double,y:double,id:bigint>>"


def voronoi(sites: DataFrame, frame: tuple[float, float, float, float] | None = None, parts: list[list[tuple[float, float]]] | None = None, radius: float | None = None, bound: int = 256) -> DataFrame:
    """sites (id long, x, y: finite, no two places alike, all within the frame) with `ring`, an array of struct x, y in
    counter-clockwise order, and `part`: the cell of each site within each convex part of the boundary and within `radius` of
    the site. frame: left, low, right, high; by default the sites' box. parts: convex rings, counter-clockwise, without
    overlaps; by default the frame. A site without area in a part has no row for it; an empty table has none.

    A task cuts the cells of one quad-tree leaf, at most `bound` sites, with those of a margin around it. A corner is certain if no
    site lies nearer to it than its own: at once where the circle through it stays in the leaf and its margin, else by a nearest search for all open corners together,
    whose finds cut the cell again. A convex cell whose corners are certain is final, so no halo has to be guessed, and a site
    beside a dense spot meets only those of its sites that it borders on.
    """
    spark = sites.sparkSession
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    tree = quadtree.build(sites.select(F.col("id").cast("long").alias("id"), x.alias("x"), y.alias("y"), x.alias("sx"), y.alias("sy")), bound)
    if tree is None:
        return sites.withColumns({"part": F.lit(None).cast("int"), "ring": F.lit(None).cast("array<struct<x:double,y:double>>")})
    if frame is None:
        frame = (tree.left, tree.low, *(sites.agg(F.max("x"), F.max("y")).first()))
    parts = parts or [[(p, q) for p, q, _ in frame_ring(frame)]]
    left, low, size = tree.left, tree.low, tree.size
    slack = max(NEARER, ROUNDING * max(map(abs, frame)))
    state_ddl = f"id bigint, x double, y double, others {_NEIGHBOURS}, px array<double>, py array<double>"
    others_type = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64()), ("id", pa.int64())]))

    def emit(rows: list[tuple]) -> pa.RecordBatch:
        c = list(zip(*rows)) if rows else [[]] * 6
        kinds = [pa.int64(), pa.float64(), pa.float64(), others_type, pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(c, kinds)], names=["id", "x", "y", "others", "px", "py"])

    def shaped(number: int, x: float, y: float, others: list[tuple], safe: tuple | None) -> tuple:
        """A row of the state: the neighbours that make the cell, and the probes of its open corners."""
        ring = cell(x, y, others, frame)
        makes = {e for _, _, e in ring}
        px, py = [], []
        least = min((math.hypot(p - x, q - y) for p, q, i in others if i in makes), default=math.inf)
        for a, b, _ in ring:
            d = math.hypot(a - x, b - y)
            if safe is not None and min(a - safe[0], b - safe[1], safe[2] - a, safe[3] - b) >= d:
                continue
            for share in (1.0, *PROBES) if d > FAR * least else (1.0,):
                px.append(x + share * (a - x))
                py.append(y + share * (b - y))
        return number, x, y, [{"x": p, "y": q, "id": i} for p, q, i in others if i in makes], px, py

    def local(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        level, cx, cy = (g.as_py() for g in group)
        edge = size / 2**level
        rows = list(zip(*(t.column(c).to_pylist() for c in ("x", "y", "id", "own", "whole"))))
        m = MARGIN * (1 - 1e-9) * edge if all(r[4] for r in rows) else 0.0
        safe = (left + cx * edge - m, low + cy * edge - m, left + (cx + 1) * edge + m, low + (cy + 1) * edge + m)
        places = [r[:3] for r in rows]
        return pa.Table.from_batches([emit([shaped(i, x, y, [o for o in places if o[2] != i], safe) for x, y, i, own, _ in rows if own])])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                others = {o["id"]: (o["x"], o["y"], o["id"]) for o in [*r["others"], *r["found"]]}
                rows.append(shaped(r["id"], r["x"], r["y"], list(others.values()), None))
            yield emit(rows)

    state = kept(quadtree.with_margins(tree, MARGIN, 2 * bound).groupBy("level", "cx", "cy").applyInArrow(local, state_ddl), "voronoi")
    done = [state.where(F.size("px") == 0)]
    state = state.where(F.size("px") > 0)
    while state.head(1):
        probes = state.select(F.col("id").alias("own"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.explode(F.arrays_zip("px", "py")).alias("p")).select("own", "ox", "oy", F.col("p.px").alias("x"), F.col("p.py").alias("y")).distinct()
        near = quadtree.nearest_place(probes, tree)
        nearer = F.col("near.distance") < F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy")) - slack
        found = near.where(nearer & (F.col("near.id") != F.col("own"))).groupBy("own").agg(F.collect_set(F.struct(F.col("near.sx").alias("x"), F.col("near.sy").alias("y"), F.col("near.id").alias("id"))).alias("found"))
        told = kept(state.join(found.withColumnRenamed("own", "id"), "id", "left"), "voronoi")
        done.append(told.where("found is null").drop("found"))
        changed = told.where("found is not null")
        state = kept(changed.mapInArrow(again, state_ddl), "voronoi")
    final = done[0]
    for t in done[1:]:
        final = final.unionByName(t)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                place, others = (r["x"], r["y"], r["id"]), [(o["x"], o["y"], o["id"]) for o in r["others"]]
                for k, part in enumerate(parts):
                    if ring := outline(place, others, part, radius):
                        rows.append((r["id"], k, [{"x": p, "y": q} for p, q in ring]))
            c = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))], names=["id", "part", "ring"])

    cells = final.select("id", "x", "y", "others").mapInArrow(finish, "id bigint, part int, ring array<struct<x:double,y:double>>")
    return sites.drop("part", "ring").join(cells, "id")
