"""Queries of the spatial operators on the vectors of `embeddings` as places, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import coverage, layers, nearest, raster, segments, voronoi
from ..shared import shared_dir
from ..sources import shapefile, sinks
from .queries import query, table, vectors

# Vectors lie in districts of 500 side by side, so that the places of a district are as dense in a large table as in a small one.
_AT = """
pts as (
  select vec_id as id, label, vec_id // 500 * 300 + cast(embedding[1] as double) * 100 as x, cast(embedding[2] as double) * 100 as y,
    cast(embedding[3] as double) * 100 as u, cast(embedding[4] as double) * 100 as v
  from embeddings
)
"""


def places(spark, d) -> DataFrame:
    e = F.col("embedding")
    part = lambda i: e[i].cast("double") * 100
    at = (F.floor(F.col("vec_id") / 500) * 300 + part(0)).alias("x")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", at, part(1).alias("y"), part(2).alias("u"), part(3).alias("v"))


_VORONOI = """
with p as (
  select vec_id as id, cast(embedding[1] as double) * 100 as x, cast(embedding[2] as double) * 100 as y,
    cast(embedding[3] as double) * 100 as u, cast(embedding[4] as double) * 100 as v
  from embeddings
)
select a.id, arg_min(b.id, ((a.u - b.x) ** 2 + (a.v - b.y) ** 2, b.id)) as zone, cast(40000.0 as double) as whole
from p a, p b group by a.id
"""


@query("voronoi_zones", _VORONOI)
def voronoi_zones(spark, d):
    """In which place's cell each vector's second place lies, and the area of all cells."""
    sites = vectors(spark, d)
    cells = voronoi.voronoi(sites, (-100.0, -100.0, 100.0, 100.0)).select(F.col("id").alias("zone"), "ring")
    size = 200.0 / max(1.0, sites.count() ** 0.5)
    cell = lambda c: F.floor(c / F.lit(size))
    span = lambda f: F.sequence(cell(F.array_min(F.transform("ring", f))), cell(F.array_max(F.transform("ring", f))))
    tiled = cells.withColumn("gx", F.explode(span(lambda p: p["x"]))).withColumn("gy", F.explode(span(lambda p: p["y"])))
    e = F.col("embedding")
    second = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), (e[2].cast("double") * 100).alias("u"), (e[3].cast("double") * 100).alias("v"))
    found = second.withColumns({"gx": cell(F.col("u")), "gy": cell(F.col("v"))}).join(tiled, ["gx", "gy"]).where(geo.in_ring(F.col("u"), F.col("v"), F.col("ring")))
    whole = cells.agg(F.round(F.sum(geo.ring_area(F.col("ring"))), 3).alias("whole")).first().whole
    return found.select("id", "zone", F.lit(whole).alias("whole"))


_SQUARES = (
    _AT
    + """,
sq as (select cast(floor(x / 4) as bigint) as cx, cast(floor(y / 4) as bigint) as cy, min(label) as key from pts group by all)
"""
)
_DISSOLVED = f"""
with recursive {_SQUARES},
r as (
  select cx, cy, cx as ox, cy as oy, key from sq
  union
  select sq.cx, sq.cy, ox, oy, key from r join sq using (key) where abs(sq.cx - r.cx) + abs(sq.cy - r.cy) = 1
),
parts as (select key, cx, cy, min((ox, oy)) as part from r group by all),
sides as (select a.key, a.part, count(*) as n from parts a join parts b on a.part = b.part and (b.cx - a.cx, b.cy - a.cy) in ((1, 0), (0, 1)) group by all),
full_corners as (
  select a.key, a.part, count(*) as n from parts a join parts b on a.part = b.part and b.cx = a.cx + 1 and b.cy = a.cy
  join parts c on a.part = c.part and c.cx = a.cx and c.cy = a.cy + 1 join parts e on a.part = e.part and e.cx = a.cx + 1 and e.cy = a.cy + 1 group by all
),
sizes as (select key, part, count(*) as n from parts group by all)
select key, cast(count(*) as bigint) as n_parts, cast(sum(1 - (s.n - coalesce(e.n, 0) + coalesce(f.n, 0))) as bigint) as n_holes,
  cast(sum(16 * s.n) as double) as area, cast(sum(4 * s.n - 2 * coalesce(e.n, 0)) as bigint) as n_edges
from sizes s left join sides e using (key, part) left join full_corners f using (key, part) group by key
"""


def square_zones(spark, d) -> DataFrame:
    """The squares of 4 by 4 that hold places, each with the smallest label in it."""
    sq = places(spark, d).groupBy(F.floor(F.col("x") / 4).alias("cx"), F.floor(F.col("y") / 4).alias("cy")).agg(F.min("label").alias("key"))
    at = lambda i, j: F.struct(((F.col("cx") + i) * 4.0).alias("x"), ((F.col("cy") + j) * 4.0).alias("y"))
    number = (F.col("cx") + 1000) * 1000 + F.col("cy") + 500
    return sq.select(number.cast("long").alias("id"), "key", F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1))).alias("rings"))


@query("dissolved_zones", _DISSOLVED)
def dissolved_zones(spark, d):
    """Parts, holes, area and edges of the union of each label's squares."""
    z = coverage.dissolve(square_zones(spark, d))
    n = F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r))
    return z.groupBy("key").agg(F.count("*").alias("n_parts"), F.sum(F.size("rings") - 1).cast("long").alias("n_holes"), F.sum("area").alias("area"), F.sum(n).cast("long").alias("n_edges"))


_SIMPLIFIED = f"""
with {_SQUARES},
c as (
  select cx + dx as gx, cy + dy as gy, key, place from sq, (values (1, 1, 0), (0, 1, 1), (0, 0, 2), (1, 0, 3)) as o(dx, dy, place)
),
g as (
  select gx, gy, max(key) filter (place = 0) as k0, max(key) filter (place = 1) as k1, max(key) filter (place = 2) as k2, max(key) filter (place = 3) as k3
  from c group by all
),
h as (
  select *, cast(k0 is distinct from k1 as int) + cast(k1 is distinct from k2 as int) + cast(k2 is distinct from k3 as int) + cast(k3 is distinct from k0 as int) as degree
  from g
),
n as (
  select c.gx, c.gy, c.key, count(*) as squares, sum(place) as places, any_value(degree) as degree, list(place order by place) as taken
  from c join h using (gx, gy) group by all
)
select key, cast(sum(case when squares in (1, 3) then 1 when squares = 4 then 0 when taken in ([0, 2], [1, 3]) then 2 when degree >= 3 then 1 else 0 end) as bigint) as n_corners,
  (select cast(count(*) * 16 as double) from sq where sq.key = n.key) as area
from n group by key
"""


@query("simplified_zones", _SIMPLIFIED)
def simplified_zones(spark, d):
    """Corners and area of each label's zones once the corners that lie on straight borders are gone."""
    zones = coverage.dissolve(square_zones(spark, d)).select(F.col("part").alias("zone"), "key", "rings")
    z = coverage.simplify(zones, 0.1)
    return z.groupBy("key").agg(F.sum(F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r))).cast("long").alias("n_corners"), F.sum("area").alias("area"))


_CROSSINGS = f"""
with {_AT},
s as (select id, cast(id // 500 * 1000 + id % 20 as bigint) as name, x as x0, y as y0, x + u / 5 as x1, y + v / 5 as y1 from pts),
q as (
  select a.name as first, b.name as second, a.x0, a.y0, a.x1, a.y1,
    (a.x1 - a.x0) * (b.y1 - b.y0) - (a.y1 - a.y0) * (b.x1 - b.x0) as c,
    ((b.x0 - a.x0) * (b.y1 - b.y0) - (b.y0 - a.y0) * (b.x1 - b.x0)) as t, ((b.x0 - a.x0) * (a.y1 - a.y0) - (b.y0 - a.y0) * (a.x1 - a.x0)) as w
  from s a join s b on b.name = a.name + 1
),
m as (
  select distinct first, second, round(x0 + t / c * (x1 - x0), 6) as x, round(y0 + t / c * (y1 - y0), 6) as y
  from q where c <> 0 and t / c between 0 and 1 and w / c between 0 and 1
),
p as (select distinct name as first, name + 1 as second from s)
select p.first, p.second, round(avg(x), 4) as x, round(avg(y), 4) as y, count(x) as n from p left join m using (first, second) group by all
"""


@query("line_crossings", _CROSSINGS)
def line_crossings(spark, d):
    """Where each line of segments meets the next one: the centre of the points and their number."""
    name = (F.floor(F.col("id") / 500) * 1000 + F.col("id") % 20).cast("long")
    lines = places(spark, d).select(name.alias("name"), F.col("x").alias("ax"), F.col("y").alias("ay"), (F.col("x") + F.col("u") / 5).alias("bx"), (F.col("y") + F.col("v") / 5).alias("by"))
    wanted = lines.select(F.col("name").alias("first"), (F.col("name") + 1).alias("second"))
    return segments.crossings_of_lines(lines, wanted).select("first", "second", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "n")


_REACH = f"""
with recursive {_SQUARES},
r as (
  select cx, cy, cx as ox, cy as oy, key from sq
  union
  select sq.cx, sq.cy, ox, oy, key from r join sq using (key) where abs(sq.cx - r.cx) + abs(sq.cy - r.cy) = 1
),
parts as (select key, cx, cy, min((ox + 1000) * 1000 + oy + 500) as zone from r group by all),
m as (select id, id // 500 * 300 + u as mx, v as my, x, y from pts),
d as (
  select id as meter, zone, round(min(sqrt(greatest(cx * 4 - mx, mx - cx * 4 - 4, 0) ** 2 + greatest(cy * 4 - my, my - cy * 4 - 4, 0) ** 2)), 1) as distance
  from m join parts on abs(cx * 4 + 2 - mx) < 9 and abs(cy * 4 + 2 - my) < 9
  where id % 3 <> 0 and sqrt(greatest(cx * 4 - mx, mx - cx * 4 - 4, 0) ** 2 + greatest(cy * 4 - my, my - cy * 4 - 4, 0) ** 2) <= 6 group by all
),
own as (select id as meter, zone from m join parts on cx = floor(x / 4) and cy = floor(y / 4) where id % 3 = 0),
beside as (select distinct a.zone, b.zone as near from parts a join parts b on abs(a.cx - b.cx) <= 1 and abs(a.cy - b.cy) <= 1)
select meter, zone, distance, 'radius' as origin from d
union all
select distinct meter, near, cast(null as double), 'own or adjacent zone' from own join beside using (zone)
"""


@query("zone_reach", _REACH)
def zone_reach(spark, d):
    """Zones within 6 of a meter; a third of the meters has no place, only the zone it stands in."""
    p = places(spark, d)
    zones = coverage.dissolve(square_zones(spark, d)).select(F.col("part").alias("zone"), "rings")
    meters = p.where("id % 3 <> 0").select(F.col("id").alias("meter"), (F.floor(F.col("id") / 500) * 300 + F.col("u")).alias("x"), F.col("v").alias("y"), F.lit(None).cast("long").alias("zone"))
    known = nearest.zones_at(p.where("id % 3 = 0").select(F.col("id").alias("meter"), "x", "y"), zones)
    lost = known.select("meter", F.lit(None).cast("double").alias("x"), F.lit(None).cast("double").alias("y"), "zone")
    return nearest.reach(meters.unionByName(lost), zones, 6.0)


# ---- forms of files: written from a table and read back ----

def _new(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("shapes_read_back", f"with {_SQUARES} select key, cast(cx * 4 as double) as xmin, cast(cy * 4 as double) as ymin, cast(16 as double) as area from sq where cx * 4 >= 0 and cy * 4 + 4 < 10")
def shapes_read_back(spark, d):
    """Squares as shapefiles; those in a window, chosen by the source."""
    at = _new(spark, "shapes")
    shapefile.write_shapes(square_zones(spark, d).select("key", "rings"), at)
    back = shapefile.read_shapes(spark, at, "key bigint, xmin double, ymin double, ymax double, rings array<array<struct<x: double, y: double>>>").where("xmin >= 0 and ymax < 10")
    return back.select(F.col("key").cast("int").alias("key"), "xmin", "ymin", geo.ring_area(F.col("rings")[0]).alias("area"))


@query("collection_read_back", f"with {_AT} select id, label, round(x, 6) as lon, round(y, 6) as lat from pts")
def collection_read_back(spark, d):
    """Places as one GeoJSON collection."""
    at = _new(spark, "collection") + ".json"
    sinks.write_geojson(layers.geojson(places(spark, d), layers.point("x", "y"), "id", "label"), at)
    f = layers.feature_rows(spark.read.schema("features array<struct<properties: struct<id: bigint, label: int>, geometry: struct<coordinates: array<double>>>>").json(at, multiLine=True))
    return f.select("id", "label", F.col("geometry.coordinates")[0].alias("lon"), F.col("geometry.coordinates")[1].alias("lat"))


@query("csv_read_back", "select c_custkey, c_name, c_mktsegment, cast(c_acctbal as double) as c_acctbal from customer")
def csv_read_back(spark, d):
    """Customers as CSV with a byte-order mark."""
    at = _new(spark, "customers") + ".csv"
    sinks.write_csv(table(spark, d, "customer").select("c_name", "c_custkey", "c_mktsegment", F.col("c_acctbal").cast("double").alias("c_acctbal")), at, mark=True)
    kinds = "c_name string, c_custkey bigint, c_mktsegment string, c_acctbal double"
    return spark.read.csv(at, header=True, schema=kinds, escape='"').select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")


# Each vector is a row of a picture of 64 columns, 500 rows to a picture; a pixel is set where the entry is large.
_DOTS = """
with recursive e as (select vec_id // 500 as raster, vec_id % 500 as y, unnest(range(0, len(embedding))) as x, unnest(embedding) as v from embeddings),
p as (select raster, x, y from e where v > 0.09),
r as (
  select raster, x, y, y * 2147483648 + x as origin from p
  union
  select p.raster, p.x, p.y, origin from r join p on p.raster = r.raster and abs(p.x - r.x) <= 1 and abs(p.y - r.y) <= 1
),
d as (select raster, x, y, min(origin) as dot from r group by all)
select raster, cast(dot as bigint) as dot, count(*) as area, round(avg(x), 6) as cx, round(avg(y), 6) as cy from d group by raster, dot
"""


def picture(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 500).alias("raster"), (F.col("vec_id") % 500).alias("y"), F.posexplode("embedding").alias("x", "v"))
    return e.where("v > double(0.09)").select("raster", "x", "y")


@query("dots", _DOTS)
def dots(spark, d):
    """Connected components of pixels, with area and centre; tiles are small, so most cross an edge."""
    return raster.measured(raster.dots(picture(spark, d), 48)).select("raster", "dot", "area", F.round("cx", 6).alias("cx"), F.round("cy", 6).alias("cy"))
