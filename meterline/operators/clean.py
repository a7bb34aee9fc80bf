"""From raw card transactions to one city's cleaned transactions in local time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import City, Settings
from ..functions import calendar, text

#: The fact table's columns, in order, and their types.
RAW = (
    "tran_id_raw long, tran_id_gmt_tm string, pymt_crd_acct_num_raw string, transaction_type string, transaction_pos_entry_mode string, mrch_ctry_nm string, "
    "mrch_nm_raw string, mrch_catg_cd short, mrch_city_nm_raw string, mrch_postal_code string, cs_tran_amt decimal(38,10), channel_flg string, cp_flag short, "
    "prch_dt string, lau_enr string, pstl_cd_enr string"
)
RAW_COLUMNS = [x.split()[0] for x in RAW.split(", ")]


def select_city(raw: DataFrame, city: City, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """A city's rows: by postal prefix, or by the city's name where there is no valid code. The country filter reaches the
    scan; both codes come out normalised. columns: the fact table's columns that are needed, these codes, the country and the
    city's name among them."""
    rows = text.once(raw.select(*columns).where(F.col("mrch_ctry_nm") == city.country), __code=text.postal_code(F.col("mrch_postal_code")))
    code = F.col("__code")
    here = code.substr(1, 2).isin(*city.postal_prefixes) | (code.isNull() & text.folded(F.col("mrch_city_nm_raw")).startswith(city.folded_name))
    return rows.where(here).withColumns({"mrch_postal_code": code, "pstl_cd_enr": text.postal_code(F.col("pstl_cd_enr"))}).select(*columns)


def timed(df: DataFrame, s: Settings) -> DataFrame:
    """Rows with a known time, renamed, with ts in the city's wall time."""
    named = df.where(F.col("tran_id_gmt_tm") != "000000").withColumnsRenamed({"tran_id_raw": "txn_id", "pymt_crd_acct_num_raw": "card", "mrch_nm_raw": "merchant", "mrch_catg_cd": "mcc", "mrch_postal_code": "zone", "pstl_cd_enr": "home", "lau_enr": "area"})
    return text.once(named, ts=calendar.local_time("prch_dt", "tran_id_gmt_tm", s.city.time_zone)).where("ts is not null")


def dated(df: DataFrame, s: Settings) -> DataFrame:
    """df with what follows from ts: day, week, block, period and workday."""
    return df.withColumn("day", F.to_date("ts")).withColumns({"week": calendar.week_of(F.col("ts")), "block": calendar.block_of(F.col("ts"), s), "period": calendar.period_of(F.col("day"), s), "workday": calendar.is_workday(F.col("day"), s)})


def localised(df: DataFrame, s: Settings) -> DataFrame:
    """Rows with a known time, renamed, with ts, day, week, block, period and workday in the city's wall time."""
    return dated(timed(df, s), s)


def hubs(tx: DataFrame, s: Settings) -> DataFrame:
    """Zones that are billing addresses rather than places: more than `hub_merchants` merchants, over all periods."""
    return tx.where("zone is not null").groupBy("zone").agg(F.count_distinct("merchant").alias("merchants"), F.count("*").alias("transactions")).where(F.col("merchants") > s.hub_merchants)


def _visit_rules(s: Settings) -> list[tuple[str, list, bool, bool]]:
    """What a purchase at a place looks like: column, values, whether they are the ones wanted, and whether null passes."""
    return [
        ("period", s.seasons, True, False),
        ("workday", [True], True, False),
        ("cp_flag", [1], True, False),
        ("transaction_type", list(s.visit_types), True, False),
        ("channel_flg", list(s.remote_channels), False, True),
        ("transaction_pos_entry_mode", list(s.manual_modes), False, True),
        ("mcc", [*s.excluded_mcc, *s.fuel_mcc], False, False),
    ]


def bought(s: Settings) -> Column:
    """Whether a person made the purchase at a place, on a season's workday."""
    holds = F.col("zone").isNotNull()
    for column, values, wanted, null_passes in _visit_rules(s):
        among = F.col(column).isin(*values)
        holds &= F.coalesce(among if wanted else ~among, F.lit(null_passes)) if null_passes else (among if wanted else ~among)
    if s.exclusions:
        holds &= ~F.upper(F.coalesce("merchant", F.lit(""))).rlike("|".join(f"(?:{p})" for p in s.exclusions))
    return holds


def visit_transactions(tx: DataFrame, groups: DataFrame, s: Settings, left_out: DataFrame | None = None) -> DataFrame:
    """Purchases that a person made at a place on a season's workday, with service group, default minutes and visitor flag."""
    return at_places(tx.where(bought(s)), groups, left_out)


def at_places(purchases: DataFrame, groups: DataFrame, left_out: DataFrame | None = None) -> DataFrame:
    """Purchases with service group, default minutes and visitor flag.

    `groups` maps mcc to a service group and drops what it doesn't know; `left_out` holds zones to leave out. Both are short lists
    with few keys: they go to the purchases, which would else be dealt out by category or zone to a few tasks.
    """
    kept = purchases.join(F.broadcast(groups), "mcc")
    if left_out is not None:
        kept = kept.join(F.broadcast(left_out.select("zone").distinct()), "zone", "left_anti")
    return kept.withColumn("visitor", (~F.col("home").eqNullSafe(F.col("zone"))).cast("int"))


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("n")).orderBy(F.desc("n"), *columns)


def merchants_of_zones(raw: DataFrame, zones: list[str], most: int = 40) -> DataFrame:
    """The `most` frequent pairs of merchant and category in the zones named, as in a profile of a few postal codes."""
    c = ["mrch_postal_code", "mrch_nm_raw", "mrch_catg_cd"]
    return value_counts(raw.where(F.col("mrch_postal_code").isin(*zones)), *c).limit(most)


def profile(df: DataFrame, merchant: str, pattern: str, nullable: str) -> DataFrame:
    """One row: rows, rows whose merchant matches, rows without a value."""
    return df.agg(F.count("*").alias("n"), F.count_if(F.col(merchant).rlike(pattern)).alias("n_match"), F.count_if(F.col(nullable).isNull()).alias("n_null"))
