"""Levels, tariffs, decisions, layers and places by known values."""

import math

import pytest
from pyspark.sql import functions as F

from meterline.config import Policy, Settings
from meterline.functions import calendar, geo, money, text
from meterline.operators import decisions, georef, layers, levels, nearest
from meterline.sources import sinks, tables

S, P = Settings(), Policy()
ZONE = "zone string, block string, period string, cards bigint, pressure double, too_few boolean, paid_zone boolean"
GROUP = "zone string, block string, period string, service_group string, cards bigint, driver_share double, visit_minutes double, pressure double, paid_zone boolean"


def cells(spark, pressures, block="07-10", period="summer", cards=40):
    return spark.createDataFrame([(f"z{i}", block, period, cards, p, False, True) for i, p in enumerate(pressures)], ZONE)


def test_levels_and_percentiles(spark):
    table = levels.level_table(cells(spark, [0.0, 0.05, 0.051, 0.15, 0.151, 0.30, 0.301, 2.0]), S)
    got = {r.zone: r for r in table.where("block = '07-10' and period = 'summer'").collect()}
    assert [got[f"z{i}"].level for i in range(8)] == ["P1", "P1", "P2", "P2", "P3", "P3", "P4", "P4"]
    assert [got[f"z{i}"].percentile for i in range(8)] == [12.5 * (i + 1) for i in range(8)]
    assert table.count() == 8 * 4 * 2
    assert {r.note for r in table.where("block <> '07-10'").collect()} == {levels.TOO_FEW}


def test_ties_get_the_lowest_rank_and_few_cards_none(spark):
    t = levels.level_table(cells(spark, [0.1] * 10), S).where("not too_few")
    assert {r.percentile for r in t.collect()} == {10.0}
    assert levels.level_table(cells(spark, [0.5], cards=29), S).where("not too_few").count() == 0
    assert levels.level_table(cells(spark, [None]), S).where("not too_few").count() == 0


def test_costs(spark):
    stays = spark.createDataFrame([("P4", 0, 90, 13.80), ("P4", 0, 20, 1.80), ("P4", 0, 150, 28.80), ("P1", 0, 180, 13.20), ("P2", 0, 180, 21.60), ("P3", 0, 120, 14.25), ("P3", 0, 180, 26.25), ("P3", 0, 0, 0.0)], "level string, shift int, minutes int, wanted double")
    assert all(r.cost == pytest.approx(r.wanted) for r in decisions.stay_costs(stays, P).collect())


def test_shift_is_capped_and_sentence(spark):
    d = spark.createDataFrame([("P1", 15), ("P4", 15), ("P4", -15), ("P3", 0)], "level string, shift int").withColumn("r", money.rates(F.col("level"), F.col("shift"), P))
    rows = d.select("r.first_minutes", money.sentence(F.col("r"), P).alias("s")).collect()
    assert [r.first_minutes for r in rows] == [60, 45, 15, 45]
    assert rows[3].s == "Pierwsze 45 min kosztuje 3,00 zł, potem 9,00 zł/h, po 2 h 12,00 zł/h."
    assert rows[0].s == "Pierwsze 60 min kosztuje 3,60 zł/h, potem 4,80 zł/h."


def test_driver_card(spark):
    zone = spark.createDataFrame([("z", b, "summer", 50, p, False, True) for b, p in (("07-10", 0.2), ("10-13", 0.4), ("13-16", 0.4), ("16-19", 0.1))], ZONE)
    groups = spark.createDataFrame([("z", "10-13", "summer", g, c, 0.5, 30.0, p, True) for g, c, p in (("retail", 40, 0.2), ("quick_services", 50, 0.2), ("leisure", 30, 0.1))], GROUP)
    asked = spark.createDataFrame([(1, "z", "summer", "2025-07-08 11:00:00"), (2, "z", "summer", "2025-07-06 11:00:00"), (3, "z", "summer", "2025-07-08 19:00:00")], "request_id long, zone string, period string, at string").withColumn("at", F.to_timestamp("at"))
    out = {r.request_id: r for r in decisions.driver_cards(asked, levels.valid_until(levels.level_table(zone, S)), groups, P, S).collect()}
    assert (out[1].level, out[1].until, out[1].dominant_group, out[1].shift) == ("P4", "16:00", "quick_services", -15)
    assert out[1].message.startswith("Ta strefa ma teraz poziom P4 (do 16:00). Pierwsze 15 min kosztuje 1,80 zł,")
    assert out[2].hour_1 == 0.0 and out[3].message.startswith("Parkowanie bezpłatne")


def test_recommendations_order(spark):
    zone = spark.createDataFrame([(z, b, "summer", 50, p, False, True) for z, ps in (("a", (0.5, 0.5, 0.1, 0.1)), ("b", (0.9, 0.1, 0.1, 0.1)), ("c", (0.2, 0.4, 0.1, 0.1))) for b, p in zip(("07-10", "10-13", "13-16", "16-19"), ps)], ZONE)
    r = decisions.recommendations(levels.level_table(zone, S), spark.createDataFrame([], GROUP), S, "summer", "07-10").collect()
    assert [(x.zone, x.high_blocks, x.known_blocks) for x in r] == [("a", 2, 4), ("c", 2, 4), ("b", 1, 4)]
    assert r[2].action != r[0].action


def test_assignments_are_checked(spark):
    c = spark.createDataFrame([("P1", "low ", ""), ("P2", "high", None)], "group_id string, name string, description string")
    one = spark.createDataFrame([("z", "P1")], "zone string, level string")
    hand = spark.createDataFrame([("z", "P2")], "zone string, group_id string")
    r = decisions.assigned(one, hand, decisions.checked_catalogue(c)).first()
    assert (r.group_id, r.changed, r.group_name) == ("P2", True, "high")
    with pytest.raises(decisions.DanglingAssignment):
        decisions.assigned(one, hand.withColumn("group_id", F.lit("X")), c)
    with pytest.raises(decisions.DanglingAssignment):
        decisions.checked_catalogue(c.withColumn("name", F.lit("LOW")))


def test_readings_and_labels(spark):
    r = spark.createDataFrame([(1, 10, "manual"), (1, 11, "ocr"), (2, 10, "ocr"), (3, 12, "ocr"), (4, 13, "ocr"), (5, 13, "ocr"), (6, 14, "ocr"), (6, 15, "ocr"), (7, None, "ocr")], "dot int, number int, origin string")
    assert sorted((x.dot, x.number) for x in layers.settled_readings(r).collect()) == [(1, 10), (3, 12)]
    with pytest.raises(ValueError):
        layers.settled_readings(r.unionByName(spark.createDataFrame([(9, 10, "manual")], r.schema)))
    t = spark.createDataFrame([("B5A", "A"), ("2178", "B"), ("12 B", "B"), ("441A", "A"), ("0A", "A"), ("x", "A"), (None, "A")], "t string, l string")
    assert [x[0] for x in t.select(text.label_number(F.col("t"), F.col("l"))).collect()] == [5, 217, 12, None, None, None, None]


def test_projection_and_distances(spark):
    d = spark.createDataFrame([(51.7592, 19.4560), (50.0614, 19.9383)], "lat double, lon double")
    x, y = geo.to_grid(F.col("lat"), F.col("lon"))
    g = d.withColumns({"x": x, "y": y})
    lat, lon = geo.to_degrees(F.col("x"), F.col("y"))
    for r in g.select("*", lat.alias("a"), lon.alias("o")).collect():
        assert (r.a, r.o) == (pytest.approx(r.lat, abs=1e-7), pytest.approx(r.lon, abs=1e-7))
    first = g.first()
    assert (first.x, first.y) == (pytest.approx(531462, abs=5), pytest.approx(432634, abs=2))
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((0, 0), (10, 0), (10, 10), (0, 10))])
    p = spark.createDataFrame([(5.0, 5.0), (13.0, 14.0), (-2.0, 5.0)], "x double, y double")
    assert [r[0] for r in p.select(geo.ring_distance(F.col("x"), F.col("y"), ring)).collect()] == [0.0, 5.0, 2.0]
    assert p.select(geo.rectangle_distance(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(10.0))).collect()[1][0] == 5.0


def test_reach_of_squares(spark):
    at = lambda x, y: F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"))
    zones = None
    for name, x in (("A", 0), ("B", 200), ("C", 400), ("D", 800)):
        z = spark.range(1).select(F.lit(name).alias("zone"), F.array(at(x, 0), at(x + 200, 0), at(x + 200, 200), at(x, 200)).alias("ring"))
        zones = z if zones is None else zones.unionByName(z)
    meters = spark.createDataFrame([("1", 100.0, 100.0, "A"), ("2", None, None, "B"), ("3", None, None, "Q")], "meter string, x double, y double, zone string")
    got = sorted((r.meter, r.zone, r.distance) for r in nearest.reach(meters, zones).collect())
    assert got == [("1", "A", 0.0), ("1", "B", 100.0), ("1", "C", 300.0), ("2", "A", None), ("2", "B", None), ("2", "C", None), ("3", "Q", None)]


def test_nearest_grows_its_radius(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 100.0, 0.0)], "id long, x double, y double")
    b = spark.createDataFrame([(7, 5.0, 10.0), (8, -5.0, -10.0), (9, 190.0, 0.0)], "rid long, rx double, ry double")
    got = {r.id: (r.rid, round(r.distance, 1)) for r in nearest.nearest(a, b).collect()}
    assert got == {1: (7, 11.2), 2: (9, 90.0)}


def test_fits(spark):
    m = [[2.0, 0.5], [-0.25, -3.0], [7.0, 11.0]]
    px = [(0.0, 0.0), (10.0, 0.0), (0.0, 10.0), (10.0, 10.0), (5.0, 3.0)]
    rows = [(i, a, b, *(a * m[0][k] + b * m[1][k] + m[2][k] for k in (0, 1))) for i, (a, b) in enumerate(px)]
    points = spark.createDataFrame(rows, "point_id long, px double, py double, x double, y double")
    assert georef.fit(points).tolist() == [pytest.approx(r) for r in m]
    s = georef.error_summary(georef.residuals(points)).first()
    assert s.rmse_left_out == pytest.approx(0, abs=1e-9)
    turned = spark.createDataFrame([(i, a, b, 3 * a + 2 * b + 1, 2 * a - 3 * b + 4) for i, (a, b) in enumerate(px)], points.schema)
    assert georef.fit(turned, "similarity").tolist() == [pytest.approx(r) for r in ([3, 2], [2, -3], [1, 4])]
    with pytest.raises(ValueError):
        georef.fit(points.limit(2))


def test_smooth_curve_and_scale(spark):
    ys = [F.lit(v) for v in (0.0, 1.0, 1.0, 0.5)]
    hours = spark.range(70, 191).select((F.col("id") / 10.0).alias("h"))
    got = [r[0] for r in hours.select(geo.smooth(F.col("h"), layers.MIDDLES, ys)).collect()]
    assert got[0] == 0.0 and got[-1] == 0.5 and max(got) <= 1.0 + 1e-12 and min(got) >= 0.0
    assert all(b >= a - 1e-12 for a, b in zip(got[:45], got[1:46]))
    at = spark.createDataFrame([(0.0,), (0.05,), (0.1,), (0.6,), (9.0,)], "p double").select(geo.scale_04(F.col("p"), S.cuts)).collect()
    assert [r[0] for r in at] == [0.0, 1.0, 1.5, 4.0, 4.0]


def test_display_strings(spark):
    d = spark.createDataFrame([(12.5, 45), (0.0, 60), (1234.0, 125)], "v double, m int").select(text.money(F.col("v")), text.duration(F.col("m"))).collect()
    assert [tuple(r) for r in d] == [("12,50 zł", "45 min"), ("0,00 zł", "60 min"), ("1234,00 zł", "2 h 5 min")]
    assert spark.range(1).select(text.shortened(F.lit("a; b; c"), 2)).first()[0] == "a; b (+1)"
    assert spark.range(1).select(calendar.block_end(F.lit("07-10"))).first()[0] == "10:00"


def test_circles(spark):
    hours = spark.createDataFrame([("a", "07-10", "summer", 4.0, 30), ("b", "07-10", "summer", -1.0, 30), ("c", "10-13", "summer", 16.0, 30)], "zone string, block string, period string, paid_hours double, cards long")
    places = spark.createDataFrame([("a", 1.0, 1.0, None), ("b", 1.0, 1.0, "s"), ("c", None, 1.0, "s")], "zone string, lat double, lon double, streets string")
    assert [(r.zone, r.radius_m) for r in layers.demand_circles(hours, places, "summer", "07-10").collect()] == [("a", 220 * math.sqrt(4 / 16)), ("b", 0.0)]


def test_sources_and_sinks(spark, tmp_path):
    xml = tmp_path / "m.xml"
    xml.write_text('<k><placemark><name>Sektor A13</name><card>1</card><model>x</model><parkingmeter>0042</parkingmeter><address>ul. B</address><coordinates><latitude>50.1</latitude><longitude>19.9</longitude></coordinates></placemark></k>')
    r = tables.meters_from_xml(spark, str(xml)).first()
    assert (r.meter, r.sector, r.subzone, r.lat) == ("42", "A13", "A", 50.1)
    for name, body in (("mcc_groups", "mcc,mcc_name,service_group,default_minutes\n5812,x,food_service,75\n"), ("tariff", "period,first,last,division,subzone,resident,half_hour,h1,h2,h3,h4,certainty\nI,2025-01-01,2025-06-01,2024,A,0,2.5,5,5.5,6,5,sure\n"), ("meters", "meter,subzone,old_subzone,lat,lon,street,zone,address_m,status\n012a,A,A,1.0,2.0,s,90-001,3.0,map_2024\n")):
        (tmp_path / f"{name}.csv").write_text(body)
    ref = tables.load_reference(spark, str(tmp_path), str(tmp_path))
    assert ref.meters.first().meter == "012A" and ref.reach is None and ref.tariff.first().h2 == 5.5
    with pytest.raises(FileNotFoundError):
        tables.read_csv(spark, "streets", [str(tmp_path)])
    good = spark.createDataFrame([("z", "07-10", "summer", 40, 0.1, False, None)], ZONE)
    sinks.write_aggregate(good, str(tmp_path / "zone_metrics.parquet"))
    sinks.write_aggregate(spark.createDataFrame([], GROUP), str(tmp_path / "group_metrics.parquet"))
    read = tables.read_aggregates(spark, [str(tmp_path / "none"), str(tmp_path)])
    assert read["zone_metrics"].count() == 1 and read["calibration"] is None
    with pytest.raises(tables.ContractError):
        tables.check_contract(good.drop("cards"), "zone_metrics")
    features = layers.geojson(spark.createDataFrame([("z", 1.23456789, 2.0)], "zone string, lon double, lat double"), layers.point("lon", "lat"), "zone")
    sinks.write_geojson(features, str(tmp_path / "g"))
    back = layers.feature_rows(spark.read.json(str(tmp_path / "g"), multiLine=True)).first()
    assert back.zone == "z" and back.geometry.coordinates == [1.234568, 2.0]
    rings = tables.boundary_rings(spark.createDataFrame([("OK",), ("2180;POLYGON((0 0, 1 0, 1 1, 0 0))|",)], "value string")).first()
    assert rings.srid == 2180 and [tuple(p) for p in rings.ring][1] == (1.0, 0.0)
    sinks.write_csv(good, str(tmp_path / "c"), mark=True)
    assert sinks.write_rows(good, str(tmp_path / "r")) == 1


def test_small_helpers(spark):
    ids = spark.createDataFrame([("10B",), ("2A",), ("x",), ("2",)], "id string")
    assert [r.id for r in layers.natural_order(ids, "id").collect()] == ["2", "2A", "10B", "x"]
    lines = spark.createDataFrame([("near", 0.0, 0.0, 10.0, 0.0), ("tilted", 0.0, 100.0, 30.0, 130.0)], "name string, ax double, ay double, bx double, by double")
    at = spark.createDataFrame([(1, 5.0, 3.0), (2, 16.0, 114.0), (3, 500.0, 0.0)], "id long, x double, y double")
    got = {r.id: (r.name, r.distance) for r in nearest.nearest_line(at, lines, 30.0, spark.createDataFrame([(3, "own")], "id long, name string")).collect()}
    assert got[1] == ("near", 3.0) and got[2] == ("tilted", pytest.approx(math.sqrt(2))) and got[3] == ("own", None)
    ring = spark.range(1).select(layers.rounded(F.array(F.array(F.lit(1.234567), F.lit(2.0))), 2)).first()[0]
    assert ring == [[1.23, 2.0]]


def test_sample_aggregates_feed_the_model(spark):
    from meterline.plans import testdata

    z = tables.check_contract(testdata.sample_aggregates(spark), "zone_metrics")
    t = levels.level_table(z, S)
    assert z.count() == 16 * 8 - 3 and t.count() == 16 * 8
    assert t.where("note = '' and level is null").count() == 0
    assert levels.schedule(t, "summer", S).columns == ["zone", *[b.name for b in S.blocks]]
