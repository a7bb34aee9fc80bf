"""Coverages of polygons: dissolving by a key, and simplifying lines so that neighbours keep their common borders.

A coverage is a table of polygons that don't overlap and whose common borders have the same corners in both. Rings are arrays of
struct x, y, not closed; outer rings run counter-clockwise, holes clockwise, so the polygon is always on the left.
"""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import kept
from . import segments

_POINT = "struct<x:double,y:double>"


def edges_of(polygons: DataFrame, *keep: str, rings: str = "rings") -> DataFrame:
    """keep..., ax, ay, bx, by: the directed edges of all rings. Edges without length are left out."""
    r = F.col("__r")
    n = F.size(r)
    pairs = F.transform(r, lambda p, i: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), F.element_at(r, (i + 1) % n + 1)["x"].alias("bx"), F.element_at(r, (i + 1) % n + 1)["y"].alias("by")))
    t = polygons.select(*keep, F.explode(rings).alias("__r")).where(F.size("__r") >= 3).select(*keep, F.explode(pairs).alias("__e")).select(*keep, "__e.*")
    return t.where("ax <> bx or ay <> by")


def components(links: DataFrame) -> DataFrame:
    """id, label: for every id that occurs in links (a, b: long) the smallest id it is connected with.

    Rounds of large and small stars: each number hands its larger neighbours to its smallest one, then its smaller neighbours;
    minima are summed in each task before the exchange, and the edges shrink to stars in a logarithmic number of rounds.
    """
    e = kept(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    last = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if state == last:
            break
        last = state
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.unionByName(least.where("m < a").select("a", F.col("m").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e = kept(small.where("a <> b").distinct(), "components")
    ids = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).distinct()
    return ids.join(e.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("label")), "id", "left").withColumn("label", F.coalesce("label", "id"))


def stitch(edges: DataFrame, by: str) -> DataFrame:
    """by, rings, area: the rings that the directed edges (by, ax, ay, bx, by...) of each value of `by` make, the outer ones first.

    Every edge points to the next one, at a corner where several begin to the one that turns most to the left, so rings that
    touch in a corner stay apart. Pointer jumping then gives all edges of a ring the number of its first one; only the edges of
    one ring are put in order in one place.
    """
    e = kept(edges.select(by, "ax", "ay", "bx", "by").withColumn("e", F.monotonically_increasing_id()), "edges")
    into = e.select(by, "e", F.col("bx").alias("x"), F.col("by").alias("y"), (F.col("bx") - F.col("ax")).alias("dx"), (F.col("by") - F.col("ay")).alias("dy"))
    out = e.select(by, F.col("e").alias("next"), F.col("ax").alias("x"), F.col("ay").alias("y"), (F.col("bx") - F.col("ax")).alias("ox"), (F.col("by") - F.col("ay")).alias("oy"))
    turn = F.atan2(F.expr("dx * oy - dy * ox"), F.expr("dx * ox + dy * oy"))
    turn = F.when(turn > math.pi - 1e-12, F.lit(-math.pi)).otherwise(turn)  # back the same way comes last
    jump = kept(into.join(out, [by, "x", "y"]).groupBy("e").agg(F.max_by("next", F.struct(turn, -F.col("next"))).alias("next")).withColumn("label", F.least("e", "next")), "jumps")
    first = jump.select("e", "next")
    while True:
        step = jump.select(F.col("e").alias("next"), F.col("next").alias("__n"), F.col("label").alias("__l"))
        new = kept(jump.join(step, "next").select("e", F.col("__n").alias("next"), F.least("label", "__l").alias("label"), (F.col("__l") < F.col("label")).alias("changed")), "jumps")
        if not new.where("changed").head(1):
            break
        jump = new.drop("changed")
    whole = e.join(first, "e").join(jump.select("e", "label"), "e")
    points = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))

    def order(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        begins = dict(zip(t.column("e").to_pylist(), zip(t.column("ax").to_pylist(), t.column("ay").to_pylist())))
        follows = dict(zip(t.column("e").to_pylist(), t.column("next").to_pylist()))
        at = min(begins, key=lambda k: (begins[k], k))
        ring, start = [], at
        while True:
            ring.append(begins[at])
            at = follows[at]
            if at == start or at not in follows:
                break
        size = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2
        return pa.table({by: t.column(by).slice(0, 1), "ring": pa.array([[{"x": x, "y": y} for x, y in ring]], points), "area": pa.array([size], pa.float64())})

    kind = edges.schema[by].dataType.simpleString()
    rings = whole.select(by, "label", "e", "next", "ax", "ay").groupBy("label").applyInArrow(order, f"`{by}` {kind}, ring array<{_POINT}>, area double")
    sorted_rings = F.array_sort(F.collect_list(F.struct((-F.col("area")).alias("least"), "ring")))
    return rings.groupBy(by).agg(F.transform(sorted_rings, lambda r: r["ring"]).alias("rings"), F.sum("area").alias("area"))


def dissolve(polygons: DataFrame, key: str = "key", id: str = "id") -> DataFrame:  # noqa: A002
    """key, part, rings, area: the union of the polygons (id long, unique; key; rings) of each key, a row for each connected part;
    `part` is the smallest id in it, the first ring its outline, the others its holes.

    Edges that a key has in both directions cancel in one aggregation by edge and key; they also say which polygons hang
    together. What is left is stitched to rings. A key that holds a third of all polygons is dealt by its edges, never gathered.
    Polygons that touch in a corner alone are parts of their own. A null key is a key of its own; polygons without rings, or
    with fewer than three corners, have no part; repeated polygons count once; an empty table gives none.
    """
    p = polygons.select(F.col(id).cast("long").alias("id"), F.col(key).alias("key"), "rings")
    e = edges_of(p, "id", "key")
    forward = F.expr("ax < bx or (ax = bx and ay < by)")
    low = lambda c, o: F.when(forward, F.col(c)).otherwise(F.col(o))
    e = e.select("id", "key", low("ax", "bx").alias("ax"), low("ay", "by").alias("ay"), low("bx", "ax").alias("bx"), low("by", "ay").alias("by"), F.when(forward, 1).otherwise(-1).alias("way"))
    sums = kept(e.groupBy("key", "ax", "ay", "bx", "by").agg((F.max("way") + F.min("way")).alias("net"), F.min("id").alias("a"), F.max("id").alias("b")), "dissolve")
    hang = components(sums.where("a <> b").select("a", "b"))
    rest = sums.where("net <> 0").join(hang.withColumnsRenamed({"id": "a", "label": "part"}), "a", "left").withColumn("part", F.coalesce("part", "a"))
    turned = lambda c, o: F.when(F.col("net") > 0, F.col(c)).otherwise(F.col(o)).alias(c)
    outline = rest.select("part", turned("ax", "bx"), turned("ay", "by"), turned("bx", "ax"), turned("by", "ay"))
    keys = rest.groupBy("part").agg(F.first("key").alias("key"))
    return stitch(outline, "part").join(keys, "part").select(F.col("key").alias(key), "part", "rings", "area")


def visvalingam(line: list[tuple[float, float]], limit: float) -> list[tuple[float, float]]:
    """The line without the corners whose triangle with their neighbours is smaller than `limit`, smallest first; ends stay, and a
    closed line keeps two corners between them."""
    n = len(line)
    before, after, gone = list(range(-1, n - 1)), list(range(1, n + 1)), [False] * n
    least = 4 if line[0] == line[-1] else 2
    size = lambda i: abs((line[i][0] - line[before[i]][0]) * (line[after[i]][1] - line[before[i]][1]) - (line[i][1] - line[before[i]][1]) * (line[after[i]][0] - line[before[i]][0])) / 2
    heap = [(size(i), i) for i in range(1, n - 1)]
    heapq.heapify(heap)
    left, now = n, {i: s for s, i in heap}
    while heap and left > least:
        s, i = heapq.heappop(heap)
        if s >= limit:
            break
        if gone[i] or now[i] != s:
            continue
        gone[i], left = True, left - 1
        a, b = before[i], after[i]
        after[a], before[b] = b, a
        for j in (a, b):
            if 0 < j < n - 1:
                now[j] = max(size(j), s)  # never smaller than what has gone already
                heapq.heappush(heap, (now[j], j))
    return [p for p, g in zip(line, gone) if not g]


def chained(rows: list[tuple[tuple, tuple]], fixed: set) -> list[tuple[float, float]]:
    """The corners of an arc in order, from edges in any order and direction; a ring begins and ends at its fixed corner, if it has
    one, else at its smallest."""
    around: dict[tuple, list[tuple]] = {}
    for a, b in rows:
        around.setdefault(a, []).append(b)
        around.setdefault(b, []).append(a)
    ends = sorted(p for p, q in around.items() if len(q) == 1)
    at = ends[0] if ends else min(around, key=lambda p: (p not in fixed, p))
    line, last = [at], None
    while len(line) <= len(rows):
        options = list(around[at])
        if last is not None:
            options.remove(last)
        if not options:
            break
        last, at = at, min(options)
        line.append(at)
        if at == line[0]:
            break
    return line


def simplify(zones: DataFrame, tolerance: float, zone: str = "zone") -> DataFrame:
    """zones (zone, rings: a coverage) with simpler `rings` and their `area`; common borders stay common.

    The borders form arcs between junctions (corners where other than two edges meet). Each arc is simplified once, as a
    whole, and both its neighbours get the result, so there are no gaps. Corners whose triangle is smaller than `tolerance`
    squared go. Where simpler arcs would meet anywhere but in junctions, or fall together, they are put back as they were, and
    that is looked at again until nothing meets: there are no overlaps. A zone in several parts stays one row.
    """
    e = edges_of(zones.select(F.col(zone).alias("zone"), "rings"), "zone")
    forward = F.expr("ax < bx or (ax = bx and ay < by)")
    low = lambda c, o: F.when(forward, F.col(c)).otherwise(F.col(o)).alias(c)
    sides = e.select("zone", low("ax", "bx"), low("ay", "by"), low("bx", "ax"), low("by", "ay"), forward.alias("__f"))
    border = sides.groupBy("ax", "ay", "bx", "by").agg(F.min(F.when(F.col("__f"), F.col("zone"))).alias("left"), F.min(F.when(~F.col("__f"), F.col("zone"))).alias("right"))
    border = kept(border.withColumn("e", F.monotonically_increasing_id()), "borders")
    ends = border.select("e", F.col("ax").alias("x"), F.col("ay").alias("y")).unionByName(border.select("e", F.col("bx").alias("x"), F.col("by").alias("y")))
    corner = ends.groupBy("x", "y").agg(F.count("*").alias("n"), F.min("e").alias("a"), F.max("e").alias("b"))
    junctions = ends.join(corner.where("n <> 2").select("x", "y"), ["x", "y"]).groupBy("e").agg(F.collect_list(F.struct("x", "y")).alias("fixed"))
    arcs = kept(border.join(junctions, "e", "left").join(components(corner.where("n = 2").select("a", "b")).withColumnsRenamed({"id": "e", "label": "arc"}), "e", "left").withColumn("arc", F.coalesce("arc", "e")), "arcs")
    limit = tolerance * tolerance

    def shorter(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        ax, ay, bx, by, left, right, ends = (t.column(c).to_pylist() for c in ("ax", "ay", "bx", "by", "left", "right", "fixed"))
        line = chained([((p, q), (r, s)) for p, q, r, s in zip(ax, ay, bx, by)], {(p["x"], p["y"]) for f in ends for p in f or []})
        # On which side the zones lie of an edge as the line runs: all edges of an arc have the same two.
        ways = {((p, q), (r, s)): (a, b) for p, q, r, s, a, b in zip(ax, ay, bx, by, left, right)}
        one, two = ways[line[0], line[1]] if (line[0], line[1]) in ways else ways[line[1], line[0]][::-1]
        line = visvalingam(line, limit)
        out = list(zip(line, line[1:]))
        return pa.table({
            "arc": pa.array([group[0].as_py()] * len(out), pa.int64()), **{c: pa.array([pair[i][j] for pair in out], pa.float64()) for c, i, j in (("ax", 0, 0), ("ay", 0, 1), ("bx", 1, 0), ("by", 1, 1))},
            "left": pa.array([one] * len(out), t.schema.field("left").type), "right": pa.array([two] * len(out), t.schema.field("right").type),
        })

    kind = zones.schema[zone].dataType.simpleString()
    ddl = f"arc bigint, ax double, ay double, bx double, by double, `left` {kind}, `right` {kind}"
    columns = ["arc", "ax", "ay", "bx", "by", "left", "right"]
    simple = kept(arcs.select(*columns, "fixed").groupBy("arc").applyInArrow(shorter, ddl), "simple")
    while True:
        bare = simple.select("arc", "ax", "ay", "bx", "by").withColumn("e", F.monotonically_increasing_id())
        bare = kept(bare, "simple-edges")
        met = segments.crossing(bare, bare, segments.typical(bare)).where("l_e < r_e")
        same = lambda u, v: (F.col(f"l_{u}x") == F.col(f"r_{v}x")) & (F.col(f"l_{u}y") == F.col(f"r_{v}y"))
        shared = sum((same(u, v).cast("int") for u in "ab" for v in "ab"), F.lit(0))
        touch = F.lit(False)
        for u in "ab":
            touch = touch | ((F.abs(F.col("x") - F.col(f"l_{u}x")) <= 1e-9 * (1 + F.abs(F.col("x")))) & (F.abs(F.col("y") - F.col(f"l_{u}y")) <= 1e-9 * (1 + F.abs(F.col("y")))))
        bad = met.where(~((shared == 1) & touch)).select(F.explode(F.array("l_arc", "r_arc")).alias("arc")).distinct()
        # An arc that is as it was can't be put back again.
        changed = simple.groupBy("arc").count().join(arcs.groupBy("arc").agg(F.count("*").alias("was")), "arc").where("count < was").select("arc")
        bad = kept(bad.join(changed, "arc", "left_semi"), "put-back")
        if not bad.head(1):
            break
        simple = kept(simple.join(bad, "arc", "left_anti").select(*columns).unionByName(arcs.join(bad, "arc", "left_semi").select(*columns)), "simple")
    directed = simple.select(F.col("left").alias("zone"), "ax", "ay", "bx", "by").unionByName(simple.select(F.col("right").alias("zone"), F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by")))
    rings = stitch(directed.where("zone is not null"), "zone").withColumnRenamed("zone", zone)
    return zones.drop("rings", "area").join(rings, zone)
