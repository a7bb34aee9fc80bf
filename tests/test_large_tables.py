"""What only large tables hold: many users, and groups of more rows than a sketch keeps apart."""

import re
from datetime import date, datetime

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from meterline.functions import calendar, text
from meterline.operators import clean, metrics, parking, visits
from meterline.plans import queries as plans
from meterline.plans import testdata as td

DATA = "/root/testdata/sf0.001"


def test_grid_positions_at_the_pole_and_beyond(spark, tmp_path):
    """User 38,400 stands at the pole; later ones pass it."""
    users = [0, 1500, 38_399, 38_400, 38_401, 60_000, 89_999]
    spark.createDataFrame([(i, u) for i, u in enumerate(users)], "event_id long, user_id long").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    found = {r[0]: tuple(r[1:]) for r in __spark_entry__.queries()["grid_positions"](spark, str(tmp_path)).collect()}
    sql = __spark_entry__.oracle_sql()["grid_positions"].replace("events", f"'{tmp_path}/events.parquet/*.parquet'", 1).replace("join events", f"join '{tmp_path}/events.parquet/*.parquet'")
    assert found == {r[0]: pytest.approx(r[1:], abs=1e-9) for r in duckdb.sql(sql).fetchall()} and len(found) == len(users)


def test_medians_of_large_groups_are_exact(spark):
    """Values all different: a rank that is off by one shows."""
    values = spark.range(600_000).select(F.lit("S1").alias("period"), F.lit("07-10").alias("block"), F.lit("A").alias("subzone"), (F.col("id") * 7919 % 600_000 / 10).alias("minutes"), F.lit(1.0).alias("amount"), (F.col("id") % 50).alias("card"), F.lit("1A").alias("meter"), F.lit("2024-01-02").alias("day"))
    assert metrics.subzone_metrics(values.repartition(7), td.SETTINGS).first()["median_minutes"] == 29_999.9


def test_each_transaction_is_timed_once_and_short_lists_go_to_it(spark):
    """The local time is in one place of the plan, and no join with a list of few keys deals the purchases out by it."""
    made = plans.tx(spark, DATA)
    assert made._jdf.queryExecution().optimizedPlan().toString().count("from_utc_timestamp") == 1
    bought = clean.visit_transactions(made, plans.ref(spark).groups, td.SETTINGS)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in bought and "SortMergeJoin" not in bought


def test_odd_times_and_codes(spark):
    rows = [("2024-01-02", "120000", "90 001"), ("2024-02-30", "120000", "9\t0-0\n01"), ("2024-1-2", "120000", "90001\x85"), ("2024-01-02", "12000", "9000"), (None, "120000", None), ("2024-01-02", "245959", "90-0012")]
    df = spark.createDataFrame(rows, "day string, t string, code string").coalesce(1)
    out = df.select(calendar.local_time("day", "t", "Europe/Warsaw").cast("string").alias("ts"), text.postal_code(F.col("code")).alias("code"))
    assert [tuple(r) for r in out.collect()] == [("2024-01-02 13:00:00", "90-001"), (None, "90-001"), (None, None), (None, None), (None, None), (None, None)]


def test_visits_keep_no_more_of_transactions_than_they_read(spark):
    """Amounts, which are slow to keep, and what follows from the time aren't kept; no payment is priced for visits."""
    plans.kept(spark, DATA)
    assert "bought" in plans._LAST[0].columns and not {"cs_tran_amt", "area", "day", "week", "block", "period", "workday"} & set(plans._LAST[0].columns)
    assert "rates" not in plans._LAST[2]._jdf.queryExecution().analyzed().toString()
    plans.let_go()


def test_codes_in_order_and_not(spark):
    given = ["90-001", " 90-001", "90--001", "9-0001", "90 001\n", "90-001\n", "90-0a1", "９０-001", "", None]
    out = [r[0] for r in spark.createDataFrame([(x,) for x in given], "c string").coalesce(1).select(text.postal_code(F.col("c"))).collect()]
    assert out == ["90-001"] * 6 + [None] * 4


def exchanges(df):
    """Keys of the exchanges that were run, those of what is kept included."""
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().executedPlan().toString()
    return [re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", ran)]


def test_a_cards_visits_are_dealt_out_once(spark):
    """One exchange, by card, serves the visits, the days of drivers and all counts of cards; amounts aren't made for them."""
    k = plans.kept(spark, DATA)
    found = exchanges(k.facts.visits.groupBy("card", "zone", "period").count())
    assert {x for x in found if "card" in x} == {"card"}
    assert "decimal(38,10)" not in plans._LAST[0]._jdf.queryExecution().optimizedPlan().toString()
    plans.let_go()


def test_drivers_are_marked_as_by_a_join(spark):
    """Each visit's driver flag is what a join with the days of payments gives; payments without a card or day mark nobody."""
    minute = lambda m: datetime(2024, 1, 2, 9, m)
    day = date(2024, 1, 2)
    bought = [(c, day, z, minute(m), date(2024, 1, 1), "S1", i, "retail", 45, 1) for i, (c, z, m) in enumerate([("a", "Z", 20), ("a", "Y", 30), ("b", "Z", 20), (None, "Z", 20), ("c", "Z", 20)])]
    purchases = spark.createDataFrame(bought, "card string, day date, zone string, ts timestamp, week date, period string, txn_id long, service_group string, default_minutes int, visitor int")
    payments = [("a", day, minute(5)), ("a", day, minute(6)), (None, day, minute(5)), ("c", None, minute(5)), ("b", date(2024, 1, 3), minute(5))]
    paid = spark.createDataFrame(payments, "card string, day date, ts timestamp")
    reached = paid.select("card", "day", F.lit("Z").alias("zone"), F.col("ts").alias("paid_ts"))
    ours = visits.of_visitors(visits.visits(purchases, td.SETTINGS, reached, paid))
    joined = visits.with_drivers(visits.visits(purchases, td.SETTINGS, reached), parking.driver_days(paid))
    columns = ["card", "zone", "visit_no", "minutes", "driver"]
    rows = sorted((str(r.card), *r[1:]) for r in ours.select(*columns).collect())
    assert rows == sorted((str(r.card), *r[1:]) for r in joined.select(*columns).collect())
    assert rows == [("None", "Z", 1, 45.0, 0), ("a", "Y", 1, 45.0, 1), ("a", "Z", 1, 59.0, 1), ("b", "Z", 1, 45.0, 0), ("c", "Z", 1, 45.0, 0)]


def test_large_kept_tables_are_made_before_they_are_read(spark):
    """Transactions and visits are whole in the store when a query starts, so no two stages make them side by side; visits lie in
    as many parts as their rows need."""
    spark.catalog.clearCache()
    k = plans.kept(spark, DATA)
    stored = spark.sparkContext._jsc.sc().getRDDStorageInfo()
    assert sum(i.numCachedPartitions() == i.numPartitions() for i in stored) >= 2
    assert k.facts.visits.rdd.getNumPartitions() < int(spark.conf.get("spark.sql.shuffle.partitions"))
    plans.let_go()
