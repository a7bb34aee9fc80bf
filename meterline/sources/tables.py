"""Sources: reference tables with explicit schemas, optional ones, contracts, and semi-structured inputs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMAS = {
    "mcc_groups": "mcc short, mcc_name string, service_group string, default_minutes int",
    "tariff": "period string, first date, last date, division int, subzone string, resident int, half_hour double, h1 double, h2 double, h3 double, h4 double, certainty string",
    "meters": "meter string, subzone string, old_subzone string, lat double, lon double, street string, zone string, address_m double, status string",
    "reach": "meter string, zone string, distance double, origin string",
    "paid_zones": "zone string, meters int",
    "exclusions": "pattern string, category string",
    "left_out": "zone string, name string, reason string",
    "streets": "zone string, streets string, streets_full string, n_streets int, n_addresses int, lat double, lon double",
}

#: Columns and types that an aggregate must have, in order; a ? marks a column that may be all null.
CONTRACTS = {
    "zone_metrics": "zone string, block string, period string, cards bigint, pressure double, too_few boolean, paid_zone boolean",
    "group_metrics": "zone string, block string, period string, service_group string, cards bigint, driver_share double, visit_minutes double, pressure double, paid_zone boolean",
    "calibration": "service_group string, default_minutes int, multi_visits bigint, cards bigint, multi_share double, measured_minutes double",
    "paid_hours": "zone string, block string, period string, paid_hours double, cards bigint",
}
OPTIONAL = {"calibration", "paid_hours"}


class ContractError(ValueError):
    pass


def check_contract(df: DataFrame, name: str) -> DataFrame:
    """df itself, if its columns and types are those of the contract."""
    wanted = [tuple(x.split()) for x in CONTRACTS[name].split(", ")]
    if [(c, t) for c, t in df.dtypes] != wanted:
        raise ContractError(f"{name}: {df.dtypes}, expected {wanted}")
    return df


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Spark can read anything at the path, whatever store it is in."""
    try:
        spark.read.format("binaryFile").load(path).select("path").head(1)
        return True
    except Exception as e:  # only a missing path means no
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise


def read_csv(spark: SparkSession, name: str, directories: list[str], optional: bool = False) -> DataFrame | None:
    """A reference table from the first directory that has it; ids stay strings, so leading zeros and letters do too."""
    for d in directories:
        if exists(spark, f"{d}/{name}.csv"):
            return spark.read.csv(f"{d}/{name}.csv", header=True, schema=SCHEMAS[name], enforceSchema=False)
    if optional:
        return None
    raise FileNotFoundError(f"{name}.csv in none of {directories}")


#: Exclusion patterns that may be given.
MOST_PATTERNS = 10_000


@dataclass
class Reference:
    groups: DataFrame
    tariff: DataFrame
    meters: DataFrame | None = None
    reach: DataFrame | None = None
    paid_zones: DataFrame | None = None
    left_out: DataFrame | None = None
    exclusions: tuple[str, ...] = ()


def load_reference(spark: SparkSession, directory: str, shared: str) -> Reference:
    """A city's tables; groups and exclusions may come from the shared directory. Tables of zones stay DataFrames."""
    both = [directory, shared]
    meters = read_csv(spark, "meters", [directory], optional=True)
    if meters is not None:
        meters = meters.select(F.upper("meter").alias("meter"), "subzone", "old_subzone", F.col("zone").alias("meter_zone"))
    near = read_csv(spark, "reach", [directory], optional=True)
    patterns = read_csv(spark, "exclusions", both, optional=True)
    return Reference(
        groups=read_csv(spark, "mcc_groups", both).select("mcc", "service_group", "default_minutes"),
        tariff=read_csv(spark, "tariff", [directory]),
        meters=meters,
        reach=None if near is None else near.select(F.upper("meter").alias("meter"), "zone"),
        paid_zones=read_csv(spark, "paid_zones", [directory], optional=True),
        left_out=read_csv(spark, "left_out", [directory], optional=True),
        exclusions=() if patterns is None else _patterns(patterns),
    )


def _patterns(table: DataFrame) -> tuple[str, ...]:
    """Patterns become one expression, so there is a bound to their number; more are an error, not cut off."""
    found = table.limit(MOST_PATTERNS + 1).collect()
    if len(found) > MOST_PATTERNS:
        raise ValueError(f"more than {MOST_PATTERNS} exclusion patterns")
    return tuple(r.pattern for r in found)


def read_aggregates(spark: SparkSession, directories: list[str]) -> dict[str, DataFrame | None]:
    """The aggregates of the first directory that has zone metrics, checked against their contracts."""
    home = next((d for d in directories if exists(spark, f"{d}/zone_metrics.parquet")), None)
    if home is None:
        raise FileNotFoundError(f"zone_metrics.parquet in none of {directories}")
    out: dict[str, DataFrame | None] = {}
    for name in CONTRACTS:
        path = f"{home}/{name}.parquet"
        out[name] = None if name in OPTIONAL and not exists(spark, path) else check_contract(spark.read.parquet(path), name)
    return out


def meters_from_xml(spark: SparkSession, path: str) -> DataFrame:
    """meter, sector, subzone, address, model, card, lat, lon of an operator's placemark file; ids lose leading zeros."""
    kinds = "name string, card string, model string, parkingmeter string, address string, coordinates struct<latitude:double,longitude:double>"
    x = spark.read.format("xml").option("rowTag", "placemark").schema(kinds).load(path)
    sector = F.regexp_replace(F.trim(F.coalesce("name", F.lit(""))), r"(?i)^sektor\s+", "")
    return x.select(
        F.regexp_replace(F.trim("parkingmeter"), "^0+(?=.)", "").alias("meter"), sector.alias("sector"), F.nullif(F.upper(sector.substr(1, 1)), F.lit("")).alias("subzone"),
        F.trim("address").alias("address"), F.trim("model").alias("model"), F.trim("card").alias("card"), F.col("coordinates.latitude").alias("lat"), F.col("coordinates.longitude").alias("lon"),
    )


def boundary_rings(text: DataFrame) -> DataFrame:
    """(srid, ring) of lines `status`, then `SRID;POLYGON((x y, ...))|...`: each outer ring as an array of struct x, y."""
    body = text.where(F.col("value").contains(";")).select(F.explode(F.split("value", r"\|")).alias("part")).where("part != ''")
    parsed = body.select(F.regexp_extract("part", "^([0-9]+);", 1).cast("int").alias("srid"), F.explode(F.regexp_extract_all("part", F.lit(r"\(([-0-9., ]+)\)"), F.lit(1))).alias("ring"))
    return parsed.select("srid", F.transform(F.split(F.trim("ring"), r"\s*,\s*"), lambda p: F.struct(F.split(p, " ")[0].cast("double").alias("x"), F.split(p, " ")[1].cast("double").alias("y"))).alias("ring"))


def address_points(points: DataFrame, streets: DataFrame) -> DataFrame:
    """points (zone, street_id, x, y) with the full and the short name of their street (streets: street_id, full, stem)."""
    from ..functions.text import short_street

    return points.join(streets, "street_id", "left").select("zone", F.col("full").alias("street_full"), short_street(F.col("full"), F.col("stem")).alias("street"), "x", "y")


def split_coordinates(c: str, sep: str = "/"):
    """lat and lon of a `lat/lon` string; null where it isn't one."""
    parts = F.split(c, sep)
    return F.try_element_at(parts, F.lit(1)).try_cast("double"), F.try_element_at(parts, F.lit(2)).try_cast("double")


def meter_ids(primary: DataFrame | None, fallback: DataFrame) -> DataFrame:
    """Distinct meter ids, from the first source that there is."""
    return (fallback if primary is None else primary).select(F.upper("meter").alias("meter")).distinct()


def schema_of(spark: SparkSession, path: str) -> StructType:
    """A file's schema, from its footer alone."""
    return spark.read.parquet(path).schema
