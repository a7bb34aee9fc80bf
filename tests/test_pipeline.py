"""Raw rows to aggregates, by hand-made days."""

from dataclasses import replace
from decimal import Decimal
from itertools import count

import pytest
from pyspark.sql import functions as F

from meterline.config import Period, Settings
from meterline.operators import clean, metrics, parking, visits
from meterline.plans import build
from meterline.sources.tables import Reference

SUMMER, WINTER = "2025-07-08", "2026-01-13"
_ids = count(1)
GROUPS = [(5812, "food_service", 75), (5411, "small_grocery", 20), (5814, "quick_services", 15)]
TARIFF = [("2025-01-01", "2025-06-01", 2024, z, r, h / 2, h, h + 0.5, h + 1, h) for z, h in (("A", 5.0), ("B", 4.0)) for r in (0, 1)] + [("2025-06-02", "2026-12-31", 2025, z, r, 3.0, 6.0, 7.0, 8.0, 6.0) for z in "ABC" for r in (0, 1)]


def row(card, time, day=SUMMER, **more):
    base = dict(
        tran_id_raw=next(_ids), tran_id_gmt_tm=time, pymt_crd_acct_num_raw=card, transaction_type="POS", transaction_pos_entry_mode="Tap to pay", mrch_ctry_nm="POLAND", mrch_nm_raw="BISTRO", mrch_catg_cd=5812,
        mrch_city_nm_raw="LODZ", mrch_postal_code="90-001", cs_tran_amt=Decimal("10"), channel_flg="cp_contactless", cp_flag=1, prch_dt=day, lau_enr="ZGIERZ", pstl_cd_enr="95-100",
    )
    return tuple((base | more)[c] for c in clean.RAW_COLUMNS)


def pay(card, time, day=SUMMER, meter="12A", amount="6.00", **more):
    return row(card, time, day, **({"mrch_nm_raw": f"SPP Lodz {meter}", "mrch_catg_cd": 7523, "cp_flag": 0, "channel_flg": "mobile", "cs_tran_amt": Decimal(amount), "mrch_postal_code": "93-180"} | more))


def raw(spark, rows):
    return spark.createDataFrame(rows, clean.RAW)


def reference(spark, **more):
    tariff = spark.createDataFrame(TARIFF, "first string, last string, division int, subzone string, resident int, half_hour double, h1 double, h2 double, h3 double, h4 double")
    base = dict(
        groups=spark.createDataFrame(GROUPS, "mcc int, service_group string, default_minutes int").withColumn("mcc", F.col("mcc").cast("smallint")),
        tariff=tariff.withColumns({"first": F.to_date("first"), "last": F.to_date("last")}),
        meters=spark.createDataFrame([("12A", "A", "A", "90-001")], "meter string, subzone string, old_subzone string, meter_zone string"),
        exclusions=(r"CARREFOUR(?! EXPRESS)", "WOLT"),
    )
    return Reference(**(base | more))


def seen(spark, rows, s=Settings(min_cards=1), **more):
    return build.facts(raw(spark, rows), reference(spark, **more), s)


def test_daylight_saving_and_missing_time(spark):
    tx = clean.localised(raw(spark, [row("a", "060000"), row("a", "060000", WINTER), row("a", "000000"), row("a", "99xx99")]), Settings())
    assert sorted((r.ts.hour, r.block) for r in tx.collect()) == [(7, "07-10"), (8, "07-10")]


def test_gap_merges_at_90_minutes_and_splits_beyond(spark):
    rows = [row("a", "100000"), row("a", "113000"), row("b", "100000"), row("b", "113001")]
    got = {(r.card, r.visit_no): (r.transactions, r.minutes) for r in seen(spark, rows).visits.collect()}
    assert got[("a", 1)] == (2, 165.0)
    assert got[("b", 1)][0] == got[("b", 2)][0] == 1


def test_payment_starts_visit_within_three_hours(spark):
    rows = [pay("a", "090000"), row("a", "100000"), pay("b", "060000"), row("b", "100001"), pay("c", "080000"), pay("c", "093000"), row("c", "100000")]
    got = {r.card: (r.minutes, r.block) for r in seen(spark, rows).visits.collect()}
    assert got == {"a": (135.0, "10-13"), "b": (75.0, "10-13"), "c": (105.0, "10-13")}


def test_last_purchase_decides_group(spark):
    rows = [row("a", "100000"), row("a", "103000", mrch_catg_cd=5411)]
    v = seen(spark, rows).visits.first()
    assert (v.service_group, v.default_minutes, v.minutes) == ("small_grocery", 20, 50.0)


@pytest.mark.parametrize(
    "more",
    [dict(transaction_type="REFUND"), dict(cp_flag=0), dict(channel_flg="eci"), dict(transaction_pos_entry_mode="COF"), dict(mrch_catg_cd=5541), dict(mrch_nm_raw="Carrefour 7"), dict(mrch_postal_code=None), dict(pstl_cd_enr="90-001"), dict(prch_dt="2025-07-06"), dict(prch_dt="2025-08-15"), dict(mrch_catg_cd=1)],
)
def test_rows_that_are_no_visit(spark, more):
    assert seen(spark, [row("a", "100000", **more)]).visits.count() == 0


def test_rows_that_are(spark):
    rows = [row("a", "100000", channel_flg=None), row("b", "100000", transaction_pos_entry_mode=None), row("c", "100000", mrch_nm_raw="CARREFOUR EXPRESS"), row("d", "100000", pstl_cd_enr=None), row("e", "100000", mrch_nm_raw=None)]
    assert seen(spark, rows).visits.count() == 5


def test_paid_minutes_and_subzone_origin(spark):
    rows = [pay("a", "100000", amount="3.00"), pay("b", "100000", amount="9.50"), pay("c", "100000", amount="21.00"), pay("d", "100000", amount="27.00"), pay("e", "100000", meter="77D"), pay("f", "100000", meter="312"), pay("g", "100000", mrch_nm_raw="PARKING"), pay("h", "100000", "2025-05-27", meter="9B", amount="4.00")]
    p = {r.card: (r.minutes, r.subzone, r.subzone_from) for r in seen(spark, rows).paid.collect()}
    assert p["a"] == (30.0, "A", "location")
    assert p["b"] == (90.0, "A", "location")
    assert p["c"][0] == 180.0 and p["d"][0] == 240.0
    assert p["e"][1:] == ("C", "id_letter")
    assert p["f"] == (None, None, "id_letter")
    assert p["g"] == (None, None, None)
    assert p["h"] == (60.0, "B", "id_letter")


def test_reach_fans_out_and_falls_back(spark):
    paid = seen(spark, [pay("a", "100000"), pay("b", "100000", meter="99B")]).paid
    reach = spark.createDataFrame([("12A", "90-001"), ("12A", "90-002")], "meter string, zone string")
    assert sorted((r.card, r.zone) for r in parking.reached(paid, reach).collect()) == [("a", "90-001"), ("a", "90-002")]
    assert [(r.card, r.zone) for r in parking.reached(paid).collect()] == [("a", "90-001")]


def test_hubs_and_left_out_zones(spark):
    rows = [row(f"c{i}", "100000", mrch_nm_raw=f"M{i}") for i in range(4)] + [row("z", "100000", mrch_postal_code="90-009")]
    f = seen(spark, rows, Settings(min_cards=1, hub_merchants=3))
    assert [(r.zone, r.merchants) for r in f.hubs.collect()] == [("90-001", 4)]
    assert [r.zone for r in f.visits.collect()] == ["90-009"]
    gone = spark.createDataFrame([("90-009", "mall")], "zone string, name string")
    assert seen(spark, rows, Settings(min_cards=1, hub_merchants=3), left_out=gone).visits.count() == 0


def test_driver_share_and_buffer(spark):
    rows = [row("a", "100000"), pay("a", "090000", meter="1Z"), row("b", "100000"), pay("b", "150000", mrch_nm_raw="APP"), row("c", "100000"), row("d", "100000", mrch_postal_code="90-002")]
    v = seen(spark, rows).visits
    assert {r.zone: r.share for r in metrics.driver_share(v).collect()} == {"90-001": pytest.approx(2 / 3), "90-002": 0.0}
    paid_zones = spark.createDataFrame([("90-001",)], "zone string")
    assert {(r.zone, r.paid_zone): r.share for r in metrics.driver_share(v, paid_zones).collect()} == {("90-001", True): pytest.approx(2 / 3), ("90-002", False): pytest.approx(2 / 3)}


def test_zero_filled_weekly_median(spark):
    weeks = ["2025-07-08", "2025-07-15", "2025-07-22"]
    rows = [r for d in weeks[:2] for r in (row("a", "100000", d), pay("a", "093000", d))] + [row("x", "100000", weeks[2], mrch_postal_code="90-002")]
    out = build.aggregates(raw(spark, rows), reference(spark), Settings(min_cards=1))
    assert {r.zone: r.pressure for r in out["zone_metrics"].collect()} == {"90-001": pytest.approx(1.75), "90-002": 0.0}
    one = build.aggregates(raw(spark, rows[:2] + [row("x", "100000", d, mrch_postal_code="90-002") for d in weeks]), reference(spark), Settings(min_cards=1))
    assert {r.zone: r.pressure for r in one["zone_metrics"].collect()}["90-001"] == 0.0
    assert {r.zone: r.paid_hours for r in out["paid_hours"].collect()} == {"90-001": 1.0}


def test_threshold_of_cards(spark):
    few = [row(f"c{i}", "100000") for i in range(29)]
    for n, kept in ((29, 0), (30, 1)):
        out = build.aggregates(raw(spark, few + [row("last", "100000")] * (n - 29)), reference(spark), Settings())
        assert out["group_metrics"].count() == kept
        z = out["zone_metrics"].first()
        assert (z.too_few, z.cards) == ((True, None) if n == 29 else (False, 30))


def test_regulars_and_calibration(spark):
    week = ["2025-07-07", "2025-07-08", "2025-07-09"]
    rows = [pay("a", "070000", d, amount="40.00") for d in week] + [pay("b", "070000", d, amount="6.00") for d in week] + [r for c, n in (("a", 30), ("b", 70), ("c", 60)) for r in (row(c, "100000"), row(c, f"1{n // 60}{n % 60:02d}00"))] + [row(c, "100000") for c in "def"]
    out = build.aggregates(raw(spark, rows), reference(spark), Settings(min_cards=1))
    assert [(r.meter, r.cards, r.regular_share) for r in out["regulars"].collect()] == [("12A", 2, 0.5)]
    c = out["calibration"].first()
    assert (c.multi_visits, c.measured_minutes, c.multi_share) == (3, 60.0, 0.5)


def test_outputs_name_no_card(spark):
    out = build.aggregates(raw(spark, [row("a", "100000")]), reference(spark), Settings(min_cards=1))
    for df in out.values():
        assert not {"card", "txn_id"} & set(df.columns)
        assert not any(t.startswith("array") for _, t in df.dtypes)


def test_empty_input(spark):
    for df in build.aggregates(raw(spark, []), reference(spark), Settings()).values():
        assert df.count() == 0


def test_city_selection(spark):
    s = replace(Settings(), periods=(Period("S", "2025-01-01", "2025-12-31"),))
    rows = [row("a", "1", mrch_postal_code=c, mrch_city_nm_raw=n) for c, n in (("93180", "x"), (" 93 180", "x"), ("00-950", "ŁÓDŹ"), (None, " łódź widzew"), ("9318", "Łódź"), (None, "KRAKOW"))] + [row("b", "1", mrch_ctry_nm="GERMANY")]
    got = clean.select_city(raw(spark, rows), s.city).collect()
    assert [r.mrch_postal_code for r in got] == ["93-180", "93-180", None, None]


def test_visits_plan_has_no_second_exchange(spark):
    v = visits.visits(clean.visit_transactions(clean.localised(raw(spark, [row("a", "100000")]), Settings()), reference(spark).groups, Settings()), Settings())
    plan = v._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(card") == 1
