"""Small layers: payload of a day's playback, labels, orders of cells."""

import json

from meterline.config import Settings
from meterline.operators import layers


def test_playback_payload(spark):
    s = Settings()
    names = [b.name for b in s.blocks]
    kinds = ", ".join(f"`{n}` double" for n in names)
    profile = spark.createDataFrame([("a", 0.0, 0.05, 0.3, 9.0), ("b", None, 0.025, -1.0, 0.1)], f"zone string, {kinds}")
    labels = spark.createDataFrame([("a", "P1", "P1", "P3", "P4"), ("b", "too few data", "P1", "P1", "P2")], "zone string, " + ", ".join(f"`{n}` string" for n in names))
    streets = spark.createDataFrame([("a", "Long; Short")], "zone string, streets string")
    got = {r.zone: json.loads(r.payload) for r in layers.playback_payload(profile, labels, streets, s).collect()}
    assert got["a"] == {"zone": "a", "streets": "Long; Short", "scale": [0.0, 1.0, 3.0, 4.0], "labels": ["P1", "P1", "P3", "P4"]}
    assert got["b"]["scale"] == [0.0, 0.5, 0.0, 1.5] and got["b"]["streets"] == "" and got["b"]["labels"][0] == "too few data"


def test_labels_and_orders(spark):
    df = spark.createDataFrame([("x", True, 2.0, "b1"), ("y", False, None, "b1"), ("z", False, 1.0, "b0"), ("w", None, 9.0, "b0"), ("v", False, 1.0, "b1")], "zone string, too_few boolean, pressure double, block string")
    assert [r.zone for r in layers.zone_picker(df).orderBy("position").collect()] == ["v", "z", "y", "w", "x"]
    assert [r.zone for r in layers.by_pressure(df).orderBy("position").collect()] == ["w", "x", "v", "z", "y"]
    shown = df.select(layers.labelled(df.too_few, {"true": "few", "false": "enough"}, "-").alias("s"), layers.labelled(df.zone, {}).alias("z"))
    assert [(r.s, r.z) for r in shown.collect()] == [("few", "x"), ("enough", "y"), ("enough", "z"), ("-", "w"), ("enough", "v")]
    assert [(r.zone, r.meters) for r in layers.meters_by_zone(df.withColumn("zone", df.block)).collect()] == [("b0", 2), ("b1", 3)]
