"""Spatial operators against brute force: clustered, repeated, empty and odd places."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.operators import coverage, nearest, quadtree, raster, segments, voronoi


def clustered(n, seed=3):
    """Two thirds of the places lie in a spot a millionth as wide as the rest."""
    r = np.random.default_rng(seed)
    spread = r.uniform(-500, 500, (n // 3, 2))
    spot = 77 + r.uniform(0, 1e-3, (n - n // 3, 2))
    return [(i, float(x), float(y)) for i, (x, y) in enumerate(np.vstack([spread, spot]))]


# ---- nearest ----

@pytest.mark.parametrize("bound", [8])
def test_nearest_in_clusters(spark, bound):
    right, left = clustered(900), clustered(300, seed=8) + [(1000, 1e6, -1e6), (1001, 77.0005, 77.0005), (1001, 77.0005, 77.0005)]
    right += [(901, right[5][1], right[5][2]), (-4, right[700][1], right[700][2])]  # repeated places
    left += [(1002, right[700][1], right[700][2])]
    got = nearest.nearest(spark.createDataFrame(left, "id long, x double, y double"), spark.createDataFrame(right, "rid long, rx double, ry double"), bound).collect()
    want = [(i, *min((math.hypot(x - a, y - b), k) for k, a, b in right)) for i, x, y in left]
    assert sorted((r.id, r.rid) for r in got) == sorted((i, k) for i, _, k in want)
    assert sorted(r.distance for r in got) == pytest.approx(sorted(d for _, d, _ in want), abs=1e-12)


def test_leaves_are_bounded_and_hold_every_place(spark):
    places = spark.createDataFrame(clustered(3000), "id long, x double, y double")
    tree = quadtree.build(places, 20)
    leaves = tree.cells.where("not inner")
    assert leaves.agg(F.max("n")).first()[0] <= 20 and leaves.agg(F.sum("n")).first()[0] == 3000
    assert tree.places.select("id").distinct().count() == tree.places.count() == 3000
    assert tree.cells.where("inner").agg(F.min("n")).first()[0] > 20
    assert quadtree.build(places.limit(0)) is None
    one = quadtree.build(places.limit(1))
    assert one.places.count() == 1


def test_pairs_follow_the_number_of_places(spark):
    """Rows that the last join makes: five times the places in the same spot make about five times the pairs."""
    made = []
    for n in (600, 3000):
        right = spark.createDataFrame(clustered(n), "id long, x double, y double")
        tree = quadtree.build(right.withColumnRenamed("id", "rid"), 16)
        asked = spark.createDataFrame(clustered(n, seed=5), "id long, x double, y double")
        made.append(quadtree.candidates(asked, tree).count())
    assert made[1] < 8 * made[0] and made[1] < 300 * 3000


# ---- Voronoi ----

def area(ring):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def inside(ring, x, y):
    return all((b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"]) >= -2e-6 * math.hypot(b["x"] - a["x"], b["y"] - a["y"]) for a, b in zip(ring, ring[1:] + ring[:1]))


@pytest.mark.parametrize("sites", ["clustered", "grid"])
def test_cells_tile_the_frame(spark, sites):
    r = np.random.default_rng(1)
    rows = {"clustered": [(i, x, y) for i, x, y in clustered(400)], "even": [(i - 200, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 100, (400, 2)))], "grid": [(i, float(i % 12), float(i // 12)) for i in range(144)]}[sites]
    if sites == "clustered":
        rows = [(i, x, y) if abs(x - 77) > 1 or abs(y - 77) > 1 else (i, 77 + (x - 77) * 1e3, 77 + (y - 77) * 1e3) for i, x, y in rows]
    got = voronoi.voronoi(spark.createDataFrame(rows, "id long, x double, y double").withColumn("ring", F.lit("clash")), bound=32).collect()
    assert sorted(g.id for g in got) == sorted(i for i, _, _ in rows)
    xs, ys = [x for _, x, _ in rows], [y for _, _, y in rows]
    assert sum(area(g.ring) for g in got) == pytest.approx((max(xs) - min(xs)) * (max(ys) - min(ys)), rel=1e-7)
    assert all(inside(g.ring, g.x, g.y) for g in got)
    cells = {g.id: g.ring for g in got}
    for x, y in zip(r.uniform(min(xs), max(xs), 300), r.uniform(min(ys), max(ys), 300)):
        d = sorted((math.hypot(x - p, y - q), i) for i, p, q in rows)
        if d[1][0] - d[0][0] > 1e-4:
            assert inside(cells[d[0][1]], x, y)
    # every inner edge is there once in each direction, bit by bit
    edges = {}
    for ring in cells.values():
        for a, b in zip(ring, ring[1:] + ring[:1]):
            edges[(a["x"], a["y"]), (b["x"], b["y"])] = edges.get(((a["x"], a["y"]), (b["x"], b["y"])), 0) + 1
    rim = lambda a, b: any(abs(a[k] - v) < 1e-5 and abs(b[k] - v) < 1e-5 for k, v in ((0, min(xs)), (0, max(xs)), (1, min(ys)), (1, max(ys))))
    assert all(n == 1 and ((b, a) in edges or rim(a, b)) for (a, b), n in edges.items())


def test_cells_within_parts_and_radius(spark):
    r = np.random.default_rng(4)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 100, (120, 2)))]
    left, right = [(0.0, 0.0), (40.0, 0.0), (60.0, 100.0), (0.0, 100.0)], [(40.0, 0.0), (100.0, 0.0), (100.0, 100.0), (60.0, 100.0)]
    got = voronoi.voronoi(spark.createDataFrame(rows, "id long, x double, y double"), (0.0, 0.0, 100.0, 100.0), [left, right], 9.0, bound=16).collect()
    probes = r.uniform(0, 100, (1500, 2))
    for x, y in probes:
        d = sorted((math.hypot(x - p, y - q), i) for i, p, q in rows)
        if d[1][0] - d[0][0] < 1e-4 or abs(d[0][0] - 9) < 0.02 or abs((x - 40) * 100 - y * 20) < 1e-6:
            continue
        part = 0 if (x - 40) * 100 < y * 20 else 1
        want = [(d[0][1], part)] if d[0][0] < 9 else []
        assert [(g.id, g.part) for g in got if inside(g.ring, x, y)] == want
    assert voronoi.voronoi(spark.createDataFrame([], "id long, x double, y double")).count() == 0
    alone = voronoi.voronoi(spark.createDataFrame([(7, 1.0, 2.0)], "id long, x double, y double"), (0.0, 0.0, 4.0, 4.0), radius=1.0).collect()
    assert len(alone) == 1 and len(alone[0].ring) == 64 and area(alone[0].ring) == pytest.approx(math.pi, rel=0.01)


# ---- coverages ----

def squares(spark, rows):
    """rows: id, key, column, row of unit squares."""
    ring = lambda x, y: [[{"x": float(x), "y": float(y)}, {"x": x + 1.0, "y": float(y)}, {"x": x + 1.0, "y": y + 1.0}, {"x": float(x), "y": y + 1.0}]]
    return spark.createDataFrame([(i, k, ring(x, y)) for i, k, x, y in rows], "id long, key string, rings array<array<struct<x:double,y:double>>>")


def flood(cells):
    left, parts = set(cells), []
    while left:
        todo, part = [left.pop()], set()
        while todo:
            x, y = todo.pop()
            part.add((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in left:
                    left.remove(n)
                    todo.append(n)
        parts.append(part)
    return parts


def euler(part):
    shared = sum((x + 1, y) in part for x, y in part) + sum((x, y + 1) in part for x, y in part)
    full = sum({(x, y), (x + 1, y), (x, y + 1), (x + 1, y + 1)} <= part for x, y in part)
    return len(part) - shared + full


def test_components_of_long_paths(spark):
    r = np.random.default_rng(2)
    names = r.permutation(300)
    links = [(int(names[i]), int(names[i + 1])) for i in range(299) if i % 100 != 99] + [(5000, 5001), (5001, 5000), (7, 7)]
    got = {x.id: x.label for x in coverage.components(spark.createDataFrame(links, "a long, b long")).collect()}
    for k in range(3):
        ids = [int(n) for n in names[100 * k : 100 * k + 100]]
        assert {got[i] for i in ids} == {min(ids)}
    assert got[5000] == got[5001] == 5000 and coverage.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dissolve_equals_flood_fill(spark):
    r = np.random.default_rng(11)
    cells = [(x, y) for x in range(14) for y in range(14)]
    rows = [(i, ["a", "b", None][int(r.integers(0, 8)) // 4 if i % 9 else 2], x, y) for i, (x, y) in enumerate(cells)]
    df = squares(spark, rows + rows[:5]).unionByName(spark.createDataFrame([(900, "a", None), (901, "a", []), (902, "z", [[]])], "id long, key string, rings array<array<struct<x:double,y:double>>>"))
    got = coverage.dissolve(df).collect()
    want = []
    for key in ("a", "b", None):
        for part in flood([(x, y) for _, k, x, y in rows if k == key]):
            want.append((str(key), min(i for i, _, x, y in rows if (x, y) in part), float(len(part)), 1 - euler(part)))
    assert sorted((str(g.key), g.part, g.area, len(g.rings) - 1) for g in got) == sorted(want)
    assert all(area(g.rings[0]) > 0 and all(area(h) < 0 for h in g.rings[1:]) for g in got)
    assert coverage.dissolve(df.limit(0)).count() == 0


def proper_cross(p, q, r, s):
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    return side(p, q, r) * side(p, q, s) < 0 and side(r, s, p) * side(r, s, q) < 0


def test_simplified_zones_still_tile(spark):
    """Voronoi cells of three mixed keys: areas add up, common borders stay common, nothing crosses, fewer corners."""
    r = np.random.default_rng(6)
    sites = [(i, float(x), float(y)) for i, (x, y) in enumerate(r.uniform(0, 100, (150, 2)))]
    cells = voronoi.voronoi(spark.createDataFrame(sites, "id long, x double, y double"), (0.0, 0.0, 100.0, 100.0))
    polygons = cells.select("id", (F.col("x") / 34).cast("int").alias("key"), F.array("ring").alias("rings"))
    zones = coverage.dissolve(polygons).select(F.col("part").alias("zone"), "key", "rings", "area").persist()
    assert zones.agg(F.sum("area")).first()[0] == pytest.approx(1e4, rel=1e-6)
    for tolerance in (6.0,):
        got = coverage.simplify(zones.withColumn("area", F.lit("clash")), tolerance).collect()
        assert len(got) == zones.count() and sum(g.area for g in got) == pytest.approx(1e4, rel=1e-6)
        edges = [((a["x"], a["y"]), (b["x"], b["y"])) for g in got for ring in g.rings for a, b in zip(ring, ring[1:] + ring[:1])]
        rim = lambda a, b: any(a[k] == v and b[k] == v for k in (0, 1) for v in (0.0, 100.0))
        assert len(set(edges)) == len(edges) and all((b, a) in set(edges) or rim(a, b) for a, b in edges)
        assert not any(proper_cross(*e, *f) for i, e in enumerate(edges) for f in edges[:i])
        assert len(edges) < sum(len(ring) for z in zones.collect() for ring in z.rings)


def test_line_without_small_corners():
    line = [(0.0, 0.0), (1.0, 0.01), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0), (4.0, 4.0)]
    assert coverage.visvalingam(line, 0.5) == [(0.0, 0.0), (2.0, 0.0), (3.0, 5.0), (4.0, 0.0), (4.0, 4.0)]
    ring = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)]
    assert len(coverage.visvalingam(ring, 1e9)) == 4


# ---- segments ----

def test_crossings_and_distances_equal_all_pairs(spark):
    r = np.random.default_rng(12)
    rows = [(i, *map(float, r.integers(0, 40, 2)), *map(float, r.integers(0, 40, 2))) for i in range(120)]
    rows += [(200, 0.0, 0.0, 40.0, 0.0), (201, 10.0, 0.0, 20.0, 0.0), (202, 5.0, 5.0, 5.0, 5.0), (203, None, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(rows, "name long, ax double, ay double, bx double, by double")
    got = {(g.l_name, g.r_name): (g.x, g.y) for g in segments.crossing(df, df, 7.0).collect()}
    gaps = {(g.l_name, g.r_name): g.distance for g in segments.near(df, df, 3.0, 5.0).collect()}

    def point_gap(p, a, b):
        d = (b[0] - a[0], b[1] - a[1])
        n = d[0] ** 2 + d[1] ** 2
        t = max(0.0, min(1.0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0.0
        return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])

    for i, ax, ay, bx, by in rows[:-1]:
        for j, cx, cy, dx, dy in rows[:-1]:
            a, b, c, d = (ax, ay), (bx, by), (cx, cy), (dx, dy)
            gap = 0.0 if proper_cross(a, b, c, d) else min(point_gap(a, c, d), point_gap(b, c, d), point_gap(c, a, b), point_gap(d, a, b))
            assert ((i, j) in gaps) == (gap <= 3) and (gap > 3 or gaps[i, j] == pytest.approx(gap, abs=1e-9))
            if gap == 0:
                assert point_gap(got[i, j], a, b) < 1e-9 and point_gap(got[i, j], c, d) < 1e-9
            elif gap > 1e-9:
                assert (i, j) not in got
    assert got[200, 201] == (15.0, 0.0)


def test_crossings_of_named_lines(spark):
    lines = spark.createDataFrame([("a", 0.0, 0.0, 10.0, 0.0), ("a", 10.0, 0.0, 20.0, 0.0), ("b", 10.0, -5.0, 10.0, 5.0), ("b", 10.0, 5.0, 18.0, -3.0), ("c", 0.0, 9.0, 20.0, 9.0)], "name string, ax double, ay double, bx double, by double")
    wanted = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "c"), ("x", "a"), ("a", "a")], "first string, second string")
    got = {(g.first, g.second): (g.x, g.y, g.n) for g in segments.crossings_of_lines(lines, wanted).collect()}
    assert got == {("a", "b"): (12.5, 0.0, 2), ("a", "c"): (None, None, 0), ("x", "a"): (None, None, 0), ("a", "a"): (None, None, 0)}


# ---- dots ----

def components_of(pixels):
    left, out = set(pixels), []
    while left:
        todo, part = [left.pop()], []
        while todo:
            x, y = todo.pop()
            part.append((x, y))
            for n in [(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if n in left:
                    left.remove(n)
                    todo.append(n)
        out.append(part)
    return out


@pytest.mark.parametrize("share, tile", [(0.3, 7), (0.45, 16)])
def test_dots_equal_flood_fill(spark, share, tile):
    r = np.random.default_rng(5)
    rows, want = [], []
    for k in range(2):
        pixels = [(int(x), int(y)) for y, x in np.argwhere(r.random((50, 60)) < share)]
        rows += [(k, x, y) for x, y in pixels]
        want += [(k, min((y, x) for x, y in part), len(part)) for part in components_of(pixels)]
    df = spark.createDataFrame([*rows, *rows[:9], (0, None, 1), (None, 1, 1)], "raster long, x int, y int")
    got = raster.measured(raster.dots(df, tile)).collect()
    assert sorted((g.raster, divmod(g.dot, raster.WIDE), g.area) for g in got) == sorted(want)
    assert raster.dots(df.limit(0)).count() == 0


def test_a_spiral_is_one_dot():
    n, path, x, y, dx, dy = 41, set(), 0, 0, 1, 0
    while True:
        path.add((x, y))
        ahead = [(x + dx, y + dy), (x + 2 * dx, y + 2 * dy)]
        if not (0 <= ahead[0][0] < n and 0 <= ahead[0][1] < n) or ahead[1] in path:
            dx, dy = -dy, dx
            if (x + dx, y + dy) in path or not (0 <= x + dx < n and 0 <= y + dy < n) or (x + 2 * dx, y + 2 * dy) in path:
                break
        x, y = x + dx, y + dy
    pixels = np.array(sorted(path, key=lambda p: (p[1], p[0])))
    assert len(path) > 400 and set(raster.labelled_tile(pixels[:, 0], pixels[:, 1]).tolist()) == {0}


def test_merged_dots_are_split(spark):
    disc = lambda cx, cy: {(x, y) for x in range(cx - 5, cx + 6) for y in range(cy - 5, cy + 6) if (x - cx) ** 2 + (y - cy) ** 2 <= 20}
    pixels = disc(20, 20) | disc(50, 20) | disc(58, 20) | disc(20, 60) | disc(20, 68) | disc(28, 68) | {(90, 90)}
    labelled = raster.dots(spark.createDataFrame([(4, x, y) for x, y in pixels], "raster long, x long, y long"), 24)
    got = sorted((round(d.x), round(d.y)) for d in raster.split_dots(labelled, len(disc(0, 0)), least=10).collect())
    want = sorted([(20, 20), (50, 20), (58, 20), (20, 60), (20, 68), (28, 68)])
    assert len(got) == 6 and all(abs(a - c) <= 1 and abs(b - e) <= 1 for (a, b), (c, e) in zip(got, want))
