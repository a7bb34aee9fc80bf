"""Sources and sinks of files: shapefiles, one file from many tasks, CSV with a mark, GeoJSON."""

import csv
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from meterline.sources import onefile, shapefile, sinks


@pytest.fixture
def zones(spark):
    ring = lambda x, s=1.0: [{"x": x, "y": 0.0}, {"x": x + s, "y": 0.0}, {"x": x + s, "y": s}, {"x": x, "y": s}]
    rows = [(i, f"zone ł{i}" if i % 5 else None, i / 3 if i % 7 else None, [ring(10.0 * i), ring(10.0 * i + 3, 0.25)][: 1 + i % 2] if i % 11 else None) for i in range(1, 60)]
    return spark.createDataFrame(rows, "code long, name string, share double, rings array<array<struct<x:double,y:double>>>").repartition(4)


def test_shapefiles_there_and_back(spark, zones, tmp_path):
    at = str(tmp_path / "z")
    shapefile.write_shapes(zones, at)
    assert len(list((tmp_path / "z").glob("*.shp"))) == 4 and not list((tmp_path / "z").glob("_*"))
    back = shapefile.read_shapes(spark, at, split=600)
    assert back.rdd.getNumPartitions() > 4
    assert sorted(back.select("code", "name", "share", "rings").collect(), key=str) == sorted(zones.collect(), key=str)
    assert back.where("code = 3").select("xmin", "ymin", "xmax", "ymax", "kind").first() == (30.0, 0.0, 33.25, 1.0, 5)
    assert back.where("rings is null").select("kind", "xmin").distinct().collect() == [(0, None)]


def test_a_box_reaches_the_source_and_columns_are_chosen(spark, zones, tmp_path):
    at = str(tmp_path / "z")
    shapefile.write_shapes(zones, at)
    near = shapefile.read_shapes(spark, at, "code bigint, xmin double, xmax double").where("xmax >= 100 and xmin < 200")
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "Filter" not in plan or "isnotnull" in plan
    assert sorted(r.code for r in near.collect()) == [i for i in range(10, 20) if i % 11]
    reader = shapefile.ShapefileReader(near.schema, at, 1 << 20)
    list(reader.pushFilters([shapefile.GreaterThan(("xmin",), 200.0)]))
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == sum(1 for i in range(21, 60) if i % 11)


def test_points_lines_and_archives(spark, tmp_path):
    """Files of other writers: points and lines, in a .zip, without attributes."""
    bodies = [struct.pack("<i2d", 1, 2.0, 3.0), struct.pack("<i4d2ii", 3, 0, 0, 4, 4, 1, 2, 0) + struct.pack("<4d", 0, 0, 4, 4), struct.pack("<i", 0)]
    shp, shx, at = b"", b"", 100
    for i, b in enumerate(bodies, 1):
        shp += struct.pack(">II", i, len(b) // 2) + b
        shx += struct.pack(">II", at // 2, len(b) // 2)
        at += 8 + len(b)
    head = lambda n: struct.pack(">I20xI", 9994, n // 2) + struct.pack("<II4d32x", 1000, 1, 0, 0, 4, 4)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x/a.shp", head(at) + shp)
        z.writestr("x/a.shx", head(100 + len(shx)) + shx)
        z.writestr("x/a.dbf", struct.pack("<BBBBIHH20x", 3, 126, 1, 1, 3, 33, 1) + b"\r" + b"   ")
    got = shapefile.read_shapes(spark, str(tmp_path / "a.zip")).orderBy("record").collect()
    assert [(r.kind, r.xmin, r.rings) for r in got] == [(1, 2.0, [[(2.0, 3.0)]]), (3, 0.0, [[(0.0, 0.0), (4.0, 4.0)]]), (0, None, None)]


def test_a_text_that_does_not_fit(spark, tmp_path):
    with pytest.raises(Exception, match="doesn't fit"):
        shapefile.write_shapes(spark.createDataFrame([("x" * 300, None)], "name string, rings array<array<struct<x:double,y:double>>>"), str(tmp_path / "z"))
    assert not list((tmp_path / "z").glob("*.shp")) or all(p.name.startswith("_") for p in (tmp_path / "z").glob("*.shp"))


def test_geojson_from_many_tasks(spark, tmp_path):
    rows = spark.range(1000).repartition(7).select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("id").alias("properties"))).alias("value"))
    for _ in range(2):  # a second run replaces the first
        sinks.write_geojson(rows, str(tmp_path / "g.json"))
        whole = json.loads((tmp_path / "g.json").read_text())
        assert whole["type"] == "FeatureCollection" and sorted(f["properties"]["id"] for f in whole["features"]) == list(range(1000))
    sinks.write_geojson(rows.limit(0), str(tmp_path / "none.json"))
    assert json.loads((tmp_path / "none.json").read_text())["features"] == []
    assert [p.name for p in tmp_path.iterdir() if ".parts" in p.name] == []
    assert spark.read.json(str(tmp_path / "g.json"), multiLine=True).select(F.explode("features")).count() == 1000


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.lit("x")).alias("value"))
    with pytest.raises(Exception, match="lost"):
        onefile.write_one_file(bad, str(tmp_path / "f"))
    assert not (tmp_path / "f").exists()


def test_csv_with_a_mark(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"', None), ("ł", "line", 2)], 'text string, `a, "name"` string, n long')
    sinks.write_csv(df, str(tmp_path / "c.csv"), mark=True)
    with open(tmp_path / "c.csv", encoding="utf-8-sig", newline="") as f:
        assert sorted(csv.reader(f)) == sorted([["text", 'a, "name"', "n"], ["a,b", 'say "x"', ""], ["ł", "line", "2"]])
    assert (tmp_path / "c.csv").read_bytes().startswith(b"\xef\xbb\xbftext")
