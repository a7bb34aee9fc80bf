"""Tables behind map layers: state of zones, shares of visit types, demand circles, meters, street lists."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import geo, text
from .levels import TOO_FEW

# Visit types and the groups in them; one overlaps the others.
VISIT_TYPES = {"short": ["quick_services", "small_grocery"], "shopping": ["retail"], "long": ["food_service", "personal_services", "leisure"], "curb_sensitive": ["quick_services", "small_grocery", "food_service"]}
#: Places of meters: code, label.
STATUS = {"map_2024": "from the 2024 map", "map_2024_inset": "from the 2024 map, inset", "coordinates": "coordinates of the operator"}
MIDDLES = [8.5, 11.5, 14.5, 17.5]


def zone_states(zones: DataFrame, cells: DataFrame, left_out: DataFrame) -> DataFrame:
    """zones (zone) with state, level, note and description: left out, too few data, or level. Left out wins.

    left_out: zone, description.
    """
    one = cells.select("zone", "level", "note", "paid_zone", "percentile").dropDuplicates(["zone"])
    out = zones.select("zone").distinct().join(one, "zone", "left").join(left_out.select("zone", F.col("description").alias("why")).dropDuplicates(["zone"]), "zone", "left")
    gone, few = F.col("why").isNotNull(), F.col("level").isNull() | (F.col("note") == TOO_FEW)
    return out.select(
        "zone", F.when(gone, "left_out").when(few, "too_few").otherwise("level").alias("state"), F.when(gone, "").otherwise(F.coalesce("level", F.lit("P1"))).alias("level"),
        F.when(gone, "").when(few, TOO_FEW).otherwise("").alias("note"), F.coalesce("why", F.lit("")).alias("description"), "paid_zone", "percentile",
    )


def left_out_zones(hubs: DataFrame, malls: DataFrame | None = None) -> DataFrame:
    """(zone, description) of hubs (zone, merchants) and malls (zone, name); where both name a zone the mall's text stays."""
    h = hubs.select("zone", F.concat(F.lit("billing address of "), text.thousands("merchants"), F.lit(" merchants")).alias("description"), F.lit(0).alias("rank"))
    if malls is None:
        return h.select("zone", "description")
    m = malls.select("zone", F.concat(F.lit("left out: "), F.col("name")).alias("description"), F.lit(1).alias("rank"))
    return h.unionByName(m).groupBy("zone").agg(F.max_by("description", "rank").alias("description"))


def type_shares(groups: DataFrame, period: str, block: str, s: Settings) -> DataFrame:
    """zone x visit type: percent of the cards of groups with enough of them."""
    of = groups.where((F.col("period") == period) & (F.col("block") == block) & (F.col("cards") >= s.min_cards))
    names = sorted({g for x in VISIT_TYPES.values() for g in x})
    wide = of.groupBy("zone").pivot("service_group", names).agg(F.sum("cards")).fillna(0, names)
    total = of.groupBy("zone").agg(F.sum("cards").alias("total"))
    return wide.join(total, "zone").select("zone", *[(100.0 * sum((F.col(g) for g in gs), F.lit(0)) / F.col("total")).alias(t) for t, gs in VISIT_TYPES.items()])


def with_types(shares: DataFrame, types: list[str], percent: float, all_of: bool = False) -> DataFrame:
    """Zones in which any, or all, of the types have at least so many percent."""
    tests = F.array(*[F.col(t) >= percent for t in types])
    return shares.where((F.forall if all_of else F.exists)(tests, lambda x: x)).select("zone")


def types_in_words(shares: DataFrame) -> DataFrame:
    """(zone, words): the types that occur, largest share first."""
    parts = F.array_sort(F.array(*[F.struct((-F.col(t)).alias("o"), F.lit(t).alias("t"), F.col(t).alias("p")) for t in VISIT_TYPES if t != "curb_sensitive"]))
    some = F.filter(parts, lambda x: x["p"] > 0)
    return shares.select("zone", F.array_join(F.transform(some, lambda x: F.concat(x["t"], F.lit(" "), F.format_string("%.0f", x["p"]), F.lit("%"))), "; ").alias("words"))


def demand_circles(paid_hours: DataFrame, places: DataFrame, period: str, block: str, largest: float = 220.0) -> DataFrame:
    """Paid hours of one season and block at the zones' centres; a circle's area is in proportion, the largest cell of all
    seasons and blocks has radius `largest`. Large circles come first."""
    top = paid_hours.agg(F.max("paid_hours").alias("top")).where("top > 0").scalar()
    at = paid_hours.where((F.col("period") == period) & (F.col("block") == block)).join(places.where("lat is not null and lon is not null").select("zone", "lat", "lon", "streets"), "zone")
    radius = F.lit(largest) * F.sqrt(F.greatest("paid_hours", F.lit(0.0)) / top)
    out = at.select("zone", "lat", "lon", F.coalesce("streets", F.lit("")).alias("streets"), "paid_hours", "cards", radius.alias("radius_m"))
    return out.where("radius_m is not null").orderBy(F.desc("paid_hours"), "zone")


def meters_on_map(meters: DataFrame) -> DataFrame:
    """Located meters with a label of where the place is from."""
    labels = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("subzone", "old_subzone", "street", "zone")]
    return meters.where("lat is not null and lon is not null").select("meter", *blank, F.coalesce(F.element_at(labels, F.coalesce("status", F.lit(""))), "status").alias("status"), "lat", "lon")


def playback(profile: DataFrame, s: Settings, start: int = 420, end: int = 1140, step: int = 30) -> DataFrame:
    """(zone, minute, scale): the day's pressure, smooth through the blocks' middles, on a scale of 0 to 4."""
    ys = [F.coalesce(F.col(f"`{b.name}`"), F.lit(0.0)) for b in s.blocks]
    at = profile.withColumn("minute", F.explode(F.sequence(F.lit(start), F.lit(end), F.lit(step))))
    p = F.greatest(F.lit(0.0), geo.smooth(F.col("minute") / 60, MIDDLES, ys))
    return at.select("zone", "minute", geo.scale_04(p, s.cuts).alias("scale"))


def street_lists(points: DataFrame, street: str = "street") -> DataFrame:
    """points (zone, street, x, y) by zone: streets joined, those with most addresses first; numbers; mean place.

    Streets are counted first, so what is gathered for a zone is its streets, not its addresses.
    """
    per = points.groupBy("zone", street).agg(F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))
    named = F.filter(F.collect_list(F.struct((-F.col("n")).alias("o"), F.col(street).alias("s"))), lambda x: x["s"].isNotNull())
    return per.groupBy("zone").agg(
        F.array_join(F.transform(F.array_sort(named), lambda x: x["s"]), "; ").alias("streets"), F.count(street).alias("n_streets"), F.sum("n").alias("n_addresses"),
        (F.sum("sx") / F.sum("n")).alias("x"), (F.sum("sy") / F.sum("n")).alias("y"),
    )


def street_names(points: DataFrame, full: str = "street_full", short: str = "street") -> DataFrame:
    """zone, streets_full, streets, n_streets: a zone's streets by their full and by their short names, two lists of the same
    addresses; n_streets counts full names. Zones without any street have empty lists."""
    lists = street_lists(points, full).select("zone", F.col("streets").alias("streets_full"), "n_streets")
    return lists.join(street_lists(points, short).select("zone", "streets"), "zone").select("zone", "streets_full", "streets", "n_streets")


def meters_by_zone(meters: DataFrame) -> DataFrame:
    """zone, meters: zones with a meter whose zone is known, in the zones' order."""
    return meters.where(F.col("zone").isNotNull()).groupBy("zone").agg(F.count("*").alias("meters")).orderBy("zone")


def zone_picker(cells: DataFrame) -> DataFrame:
    """The cells of one season and block (zone, too_few, pressure) with `position`: zones with enough data first, then by pressure,
    the highest first and unknown last, then by zone. There are as many rows as zones."""
    order = Window.orderBy(F.coalesce("too_few", F.lit(True)), F.desc_nulls_last("pressure"), "zone")
    return cells.withColumn("position", F.row_number().over(order))


def by_pressure(cells: DataFrame) -> DataFrame:
    """Cells with `position` by pressure, the highest first, unknown last; then by zone and block."""
    return cells.withColumn("position", F.row_number().over(Window.orderBy(F.desc_nulls_last("pressure"), "zone", "block")))


def labelled(code: Column, labels: dict[str, str], missing: str = "") -> Column:
    """The label of a code, the code itself where there is none, `missing` for null."""
    known = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]) if labels else F.create_map().cast("map<string,string>")
    return F.coalesce(F.element_at(known, code.cast("string")), code.cast("string"), F.lit(missing))


def playback_payload(profile: DataFrame, labels: DataFrame, streets: DataFrame, s: Settings) -> DataFrame:
    """zone, payload: what a day's playback shows of a zone, as JSON: its streets, the pressure of each block on the scale of 0 to 4
    and the block's label. profile: zone and a pressure for each block; labels: zone and a label for each block."""
    names = [b.name for b in s.blocks]
    values = F.array(*[geo.scale_04(F.greatest(F.lit(0.0), F.coalesce(F.col(f"`{n}`"), F.lit(0.0))), s.cuts) for n in names])
    at = profile.select("zone", values.alias("scale")).join(labels.select("zone", F.array(*[F.col(f"`{n}`") for n in names]).alias("labels")), "zone")
    at = at.join(streets.select("zone", "streets"), "zone", "left")
    return at.select("zone", F.to_json(F.struct("zone", F.coalesce("streets", F.lit("")).alias("streets"), F.transform("scale", lambda v: F.round(v, 3)).alias("scale"), "labels")).alias("payload"))


def one_zone_a_place(points: DataFrame) -> DataFrame:
    """(x, y, zone): the most frequent zone at a place, the smallest on a tie."""
    return points.groupBy("x", "y", "zone").agg(F.count("*").alias("n")).groupBy("x", "y").agg(F.min_by("zone", F.struct(-F.col("n"), F.col("zone"))).alias("zone"))


def geojson(rows: DataFrame, geometry: Column, *properties: str) -> DataFrame:
    """(value): one GeoJSON feature a row, ready for `write.text`."""
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties"))).alias("value"))


def point(lon: str, lat: str, digits: int = 6) -> Column:
    return F.struct(F.lit("Point").alias("type"), F.array(F.round(lon, digits), F.round(lat, digits)).alias("coordinates"))


def numbers_audit(numbers: DataFrame, highest: int = 440) -> DataFrame:
    """(number, fault): numbers given twice, outside 1 .. highest, or missing."""
    n = numbers.where("number is not null").groupBy("number").agg(F.count("*").alias("n"))
    twice = n.where("n > 1").select("number", F.lit("duplicate").alias("fault"))
    outside = n.where(~F.col("number").between(1, highest)).select("number", F.lit("out of range").alias("fault"))
    every = numbers.sparkSession.range(1, highest + 1).select(F.col("id").cast("int").alias("number"))
    return twice.unionByName(outside).unionByName(every.join(n, "number", "left_anti").select("number", F.lit("missing").alias("fault")))


def settled_readings(readings: DataFrame) -> DataFrame:
    """One number a dot, one dot a number: readings by hand stand, OCR's only where neither its dot nor its number is taken
    or disputed. Raises if readings by hand contradict each other."""
    r = readings.where("number is not null").select("dot", "number", "origin").distinct()
    hand, ocr = r.where("origin = 'manual'"), r.where("origin = 'ocr'")
    for c in ("dot", "number"):
        if hand.groupBy(c).count().where("count > 1").head(1):
            raise ValueError("readings by hand name a dot or a number twice")
        ocr = ocr.join(hand.select(c), c, "left_anti")
    alone = lambda c: F.count("*").over(Window.partitionBy(c)) == 1
    ocr = ocr.withColumns({"d": alone("dot"), "n": alone("number")}).where("d and n")
    return hand.unionByName(ocr.select("dot", "number", "origin"))


def feature_rows(path_json: DataFrame) -> DataFrame:
    """Rows of a GeoJSON feature collection read by `spark.read.json(multiLine=True)`."""
    return path_json.select(F.explode("features").alias("f")).select("f.properties.*", F.col("f.geometry").alias("geometry"))


def as_page_json(value: object) -> str:
    """JSON that is safe inside a script element."""
    return json.dumps(value, ensure_ascii=False).replace("</", "<\\/")


def natural_key(id_column: str) -> list[Column]:
    """What sorts ids by the number they begin with, then as text: 2A before 10; ids without a number come last."""
    return [F.regexp_extract(id_column, "^([0-9]+)", 1).try_cast("long").asc_nulls_last(), F.col(id_column)]


def natural_order(df: DataFrame, id_column: str) -> DataFrame:
    """Rows by the number an id begins with, then by the id."""
    return df.orderBy(*natural_key(id_column))


def with_total(df: DataFrame, key: str, *amounts: str) -> DataFrame:
    """df by key, with a last row (key null, total true) of the sums."""
    return df.rollup(key).agg(F.grouping(key).alias("g"), *[F.sum(a).alias(a) for a in amounts]).select(F.col(key), (F.col("g") == 1).alias("total"), *amounts)


def missing_keys(wanted: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys of `wanted` that `known` lacks."""
    return wanted.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def rounded(coordinates: Column, digits: int = 5) -> Column:
    """A ring's coordinates (array of arrays of double), rounded."""
    return F.transform(coordinates, lambda p: F.transform(p, lambda v: F.round(v, digits)))


def in_box(x: Column, y: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """Whether a pixel lies inside a region of the picture (a legend, an inset)."""
    return x.between(left, right) & y.between(top, bottom)
