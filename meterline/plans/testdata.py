"""The driver's `events` as card transactions, with small reference tables made by rule, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import City, Period, Settings
from ..functions import text
from ..operators.clean import RAW_COLUMNS
from ..sources.tables import Reference

#: More merchants than this make a zone of the test data a hub.
HUBS = 50

SETTINGS = Settings(
    city=City(),
    min_cards=15,
    hub_merchants=HUBS,
    amount_scale=1.0,
    periods=(Period("S1", "2024-01-01", "2024-01-15"), Period("S2", "2024-01-16", "2024-01-31")),
    holidays=("2024-01-01",),
    exclusions=(r"WOLT(?! KIOSK)", "VENDING"),
    regular_days=2,
    regular_minutes=120,
)

#: Raw transactions: the first expression runs in Spark, the second, where it differs, in DuckDB.
_K, _KD = "cast(get_json_object(props, '$.k') as int)", "cast(json_extract_string(props, '$.k') as int)"
_RAW: list[tuple[str, str, str | None]] = [
    ("tran_id_raw", "event_id", None),
    ("tran_id_gmt_tm", "lpad(cast(hour(ts) * 10000 + minute(ts) * 100 + second(ts) as string), 6, '0')", "strftime(ts, '%H%M%S')"),
    ("pymt_crd_acct_num_raw", "concat('c', user_id)", None),
    ("transaction_type", "case when k % 25 = 0 then 'REFUND' when k % 25 = 1 then 'ATM' else 'POS' end", None),
    ("transaction_pos_entry_mode", "case when k % 20 = 1 then 'COF' when k % 20 = 2 then null else 'Tap to pay' end", None),
    ("mrch_ctry_nm", "case when k = 99 then 'GERMANY' else 'POLAND' end", None),
    ("mrch_nm_raw", "case when event_type = 'purchase' and k % 17 <> 3 then concat('spp lodz  ', k % 20 + 1, substring('ABCD', k % 4 + 1, 1)) when event_type = 'purchase' then 'PARKING 7' when k % 33 = 5 then 'wolt delivery' when k % 33 = 6 then 'wolt kiosk' else concat('SHOP ', case when k % 4 = 3 then user_id % 60 else user_id % 37 end) end", None),
    ("mrch_catg_cd", "cast(case event_type when 'purchase' then 7523 when 'view' then 5411 when 'click' then 5812 when 'error' then 5651 else case when k % 10 = 9 then 5541 else 7230 end end as smallint)", None),
    ("mrch_city_nm_raw", "' Łódź '", None),
    ("mrch_postal_code", "case when k % 50 = 7 then null when k % 50 = 8 then '9000' when k % 3 = 0 then concat('90 00', k % 4) when k % 3 = 1 then concat('90-00', k % 4) else concat('9000', k % 4) end", None),
    ("cs_tran_amt", "cast(value as decimal(38, 10))", None),
    ("channel_flg", "case when k % 30 = 3 then 'eci' when k % 30 = 4 then null else 'cp_contactless' end", None),
    ("cp_flag", "cast(case when k % 40 = 4 then 0 else 1 end as smallint)", None),
    ("prch_dt", "cast(cast(ts as date) as string)", "strftime(ts, '%Y-%m-%d')"),
    ("lau_enr", "case when user_id % 5 = 0 then 'Lodz ' else 'ZGIERZ' end", None),
    ("pstl_cd_enr", "case when user_id % 11 = 0 then null else concat('90-00', user_id % 4) end", None),
]


#: What filters and columns both read, dear enough to be made only once.
_ONCE = ("tran_id_gmt_tm", "prch_dt", "mrch_postal_code")


def raw(spark: SparkSession, sf_dir: str, columns: list[str] = RAW_COLUMNS) -> DataFrame:
    """The events' transactions, with the columns named: what isn't named isn't made."""
    made = {n: F.expr(x) for n, x, _ in _RAW if n in columns}
    e = text.once(spark.read.parquet(f"{sf_dir}/events.parquet"), k=F.expr(_K))  # each row's JSON is parsed once
    e = text.once(e, **{n: made.pop(n) for n in _ONCE if n in made})
    return e.withColumns(made).select(*columns)


_GROUPS = [(5411, "small_grocery", 20), (5812, "food_service", 75), (5651, "retail", 45), (7230, "personal_services", 90)]
_METERS = "concat(id, substring('ABCD', cast((id - 1) % 4 as int) + 1, 1)) as meter, case when id % 3 = 0 then null else substring('ABC', cast(id % 3 as int), 1) end as subzone, case when id % 3 = 0 then null else substring('ABCD', cast(id % 4 as int) + 1, 1) end as old_subzone, case when id % 7 = 0 then null else concat('90-00', id % 4) end as meter_zone"
_REACH = "concat(id, substring('ABCD', cast((id - 1) % 4 as int) + 1, 1)) as meter, concat('90-00', (id + z) % 4) as zone"


def _tariff() -> list[tuple]:
    """Rates by rule. Primes, so that no paid minutes lie on a rounding tie."""
    rows, primes = [], [47, 43, 37, 31, 53, 41, 29, 59, 47, 43, 37, 31, 53, 41]
    for first, last, division, names in (("2024-01-01", "2024-01-10", 2024, "ABCD"), ("2024-01-11", "2024-12-31", 2025, "ABC")):
        for i, z in enumerate(names):
            for resident in (0, 1):
                h = float(primes[len(rows)])
                rows.append((first, last, division, z, resident, h / 2, h, 61.0, 67.0, 71.0))
    return rows


def reference(spark: SparkSession, with_paid_zones: bool = True) -> Reference:
    ids = spark.range(1, 21)
    tariff = spark.createDataFrame(_tariff(), "first string, last string, division int, subzone string, resident int, half_hour double, h1 double, h2 double, h3 double, h4 double")
    return Reference(
        groups=spark.createDataFrame(_GROUPS, "mcc int, service_group string, default_minutes int").withColumn("mcc", F.col("mcc").cast("smallint")),
        tariff=tariff.withColumns({"first": F.to_date("first"), "last": F.to_date("last")}),
        meters=ids.select(*[F.expr(x) for x in _split(_METERS)]),
        reach=ids.where("id % 5 <> 0").withColumn("z", F.explode(F.array(F.lit(0), F.lit(1)))).select(*[F.expr(x) for x in _split(_REACH)]),
        paid_zones=spark.createDataFrame([("90-000",), ("90-001",)], "zone string") if with_paid_zones else None,
        left_out=None,
        exclusions=SETTINGS.exclusions,
    )


def sample_aggregates(spark: SparkSession, zones: int = 16) -> DataFrame:
    """Zone metrics made by rule: zones x seasons x blocks, some cells too few, three missing. A fixture for what builds on them."""
    s = Settings()
    cells = spark.range(zones).withColumn("period", F.explode(F.array(*[F.lit(p) for p in s.seasons]))).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(len(s.blocks) - 1))))
    block = F.element_at(F.array(*[F.lit(b.name) for b in s.blocks]), F.col("b") + 1)
    n = F.col("id") * 7 + F.col("b") * 3 + F.length("period")
    few = n % 11 == 0
    made = cells.select(F.concat(F.lit("90-0"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("zone"), block.alias("block"), "period", F.when(~few, 30 + n % 90).alias("cards"), F.when(~few, (n % 40) / 80.0).alias("pressure"), few.alias("too_few"), (F.col("id") % 3 != 0).alias("paid_zone"))
    return made.where("not (zone = '90-003' and block = '16-19') and not (zone = '90-005' and block = '07-10' and period = 'summer')")


def _split(listed: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(listed):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append(listed[at:i].strip())
            at = i + 1
    return [*out, listed[at:].strip()]


# ---- the same plan as SQL: named parts that a query's text is made of ----

def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


_BLOCK = "case when h >= 7 and h < 10 then '07-10' when h >= 10 and h < 13 then '10-13' when h >= 13 and h < 16 then '13-16' when h >= 16 and h < 19 then '16-19' end"


def _block(ts: str) -> str:
    return _BLOCK.replace("h >=", f"hour({ts}) >=").replace("h <", f"hour({ts}) <")


_NORMAL = "case when regexp_full_match(regexp_replace({c}, '[\\s-]', '', 'g'), '[0-9]{{5}}') then regexp_replace({c}, '[\\s-]', '', 'g')[1:2] || '-' || regexp_replace({c}, '[\\s-]', '', 'g')[3:5] end"
_RAW_SQL = ", ".join(f"{(d or x).replace('k %', 'k %')} as {n}" for n, x, d in _RAW)
PARTS: dict[str, str] = {
    "raw": f"select {_RAW_SQL} from (select *, {_KD} as k from events)",
    "city": f"select * replace ({_NORMAL.format(c='mrch_postal_code')} as mrch_postal_code, {_NORMAL.format(c='pstl_cd_enr')} as pstl_cd_enr) from raw where mrch_ctry_nm = 'POLAND' and (coalesce({_NORMAL.format(c='mrch_postal_code')}[1:2] in ('90','91','92','93','94'), false) or ({_NORMAL.format(c='mrch_postal_code')} is null and upper(translate(trim(mrch_city_nm_raw), 'łŁóÓźŹ', 'lLoOzZ')) like 'LODZ%'))",
    "timed": "select *, (strptime(prch_dt || ' ' || tran_id_gmt_tm, '%Y-%m-%d %H%M%S') at time zone 'UTC') at time zone 'Europe/Warsaw' as ts from city where tran_id_gmt_tm <> '000000'",
    "tx": f"select tran_id_raw as txn_id, pymt_crd_acct_num_raw as card, transaction_type, transaction_pos_entry_mode, mrch_nm_raw as merchant, mrch_catg_cd as mcc, mrch_postal_code as zone, cs_tran_amt, channel_flg, cp_flag, lau_enr as area, pstl_cd_enr as home, ts, cast(ts as date) as day, cast(date_trunc('week', ts) as date) as week, {_block('ts')} as block, case when cast(ts as date) between date '2024-01-01' and date '2024-01-15' then 'S1' when cast(ts as date) between date '2024-01-16' and date '2024-01-31' then 'S2' end as period, isodow(ts) <= 5 and cast(ts as date) <> date '2024-01-01' as workday from timed",
    "grp": f"select * from (values {_values(_GROUPS)}) t(mcc, service_group, default_minutes)",
    "tariff": f"select * from (values {_values(_tariff())}) t(first_day, last_day, division, t_subzone, t_resident, half_hour, h1, h2, h3, h4)",
    "meters": f"select {_METERS} from range(1, 21) r(id)",
    "reach": f"select {_REACH} from range(1, 21) r(id), (values (0), (1)) q(z) where id % 5 <> 0",
    "hubs": "select zone, count(distinct merchant) as merchants, count(*) as transactions from tx where zone is not null group by zone having count(distinct merchant) > {hubs}",
    "pm": "select *, nullif(regexp_extract(upper(trim(merchant)), '^SPP LODZ\\s+(\\d+[A-Z]?)', 1), '') as meter from tx where mcc = 7523",
    "pz": "select pm.*, m.subzone as s0, m.old_subzone as o0, m.meter_zone, nullif(regexp_extract(pm.meter, '([A-Z])$', 1), '') as letter, coalesce(cast(upper(trim(area)) = 'LODZ' as int), 0) as resident, round(cast(cs_tran_amt as double), 2) as amount from pm left join meters m on pm.meter = m.meter",
    "ps": "select *, case when s0 is not null then 'location' when meter is not null then 'id_letter' end as subzone_from, coalesce(s0, case letter when 'A' then 'A' when 'B' then 'B' when 'C' then 'B' when 'D' then 'C' end) as subzone, coalesce(o0, letter) as old_subzone from pz",
    "paid": "select ps.*, case when ps.meter is not null and t.h1 is not null then round(case when amount <= half_hour then 30.0 when amount <= h1 then 60 * amount / h1 when amount <= h1 + h2 then 60 + 60 * (amount - h1) / h2 when amount <= h1 + h2 + h3 then 120 + 60 * (amount - h1 - h2) / h3 else 180 + 60 * (amount - h1 - h2 - h3) / h4 end, 1) end as minutes from ps left join tariff t on ps.day between cast(t.first_day as date) and cast(t.last_day as date) and case when t.division = 2024 then ps.old_subzone else ps.subzone end = t.t_subzone and ps.resident = t.t_resident",
    "vt": "select tx.*, grp.service_group, grp.default_minutes, cast(home is null or home <> zone as int) as visitor from tx join grp on tx.mcc = grp.mcc where period is not null and workday and zone is not null and zone not in (select zone from hubs) and transaction_type in ('POS', 'ATM') and cp_flag = 1 and coalesce(channel_flg, '') not in ('eci', 'recur', 'moto') and coalesce(transaction_pos_entry_mode, '') not in ('Manual key entry', 'COF') and tx.mcc not in (7523, 4111, 4784, 5541, 5542) and not (upper(merchant) like '%WOLT%' and upper(merchant) not like '%WOLT KIOSK%') and upper(merchant) not like '%VENDING%'",
    "gaps": "select *, lag(ts) over (partition by card, day, zone order by ts, txn_id) as prev from vt",
    "numbered": "select *, sum(case when prev is null or (epoch(ts) - epoch(prev)) / 60 > 90 then 1 else 0 end) over (partition by card, day, zone order by ts, txn_id rows unbounded preceding) as visit_no from gaps",
    "v0": "select card, day, zone, visit_no, max(week) as week, max(period) as period, min(ts) as start, max(ts) as \"end\", arg_max(service_group, (ts, txn_id)) as service_group, arg_max(default_minutes, (ts, txn_id)) as default_minutes, max(visitor) as visitor, count(*) as transactions from numbered group by card, day, zone, visit_no",
    "pay": "select card, day, r.zone, ts as paid_ts from paid join reach r on paid.meter = r.meter union all select card, day, meter_zone, ts from paid where meter is not null and meter_zone is not null and meter not in (select meter from reach)",
    "v1": "select v0.card, v0.day, v0.zone, v0.visit_no, any_value(v0.week) as week, any_value(v0.period) as period, any_value(v0.start) as start, any_value(v0.\"end\") as \"end\", any_value(v0.service_group) as service_group, any_value(v0.default_minutes) as default_minutes, any_value(v0.visitor) as visitor, any_value(v0.transactions) as transactions, max(pay.paid_ts) as paid_ts from v0 left join pay on v0.card = pay.card and v0.day = pay.day and v0.zone = pay.zone and pay.paid_ts <= v0.start and (epoch(v0.start) - epoch(pay.paid_ts)) / 60 <= 180 group by v0.card, v0.day, v0.zone, v0.visit_no",
    "vis": f"select *, {_block('coalesce(paid_ts, start)')} as block, (epoch(\"end\") - epoch(coalesce(paid_ts, start))) / 60 + default_minutes as minutes from v1",
    "v": "select vis.*, coalesce(d.driver, 0) as driver from vis left join (select distinct card, day, 1 as driver from paid) d on vis.card = d.card and vis.day = d.day where block is not null and visitor = 1",
    "weeks": "select distinct period, week from tx where period is not null and workday",
    "own": "select zone, period, service_group, count(distinct case when driver = 1 then card || '|' || day end) / count(distinct card || '|' || day) as own from v group by all",
    "ins": "select period, service_group, count(distinct case when driver = 1 then card || '|' || day end) / count(distinct card || '|' || day) as inside from v where zone in ('90-000', '90-001') group by all",
    "share": "select zone, own.period, own.service_group, zone in ('90-000', '90-001') as paid_zone, case when zone in ('90-000', '90-001') then own else inside end as share from own left join ins on own.period = ins.period and own.service_group = ins.service_group",
    "cells": "select c.*, s.share, s.paid_zone from (select zone, block, period, service_group, count(distinct card) as cards, quantile_disc(minutes, 0.5) as visit_minutes from v group by all) c join share s using (zone, period, service_group)",
    "wk": "select zone, block, period, service_group, week, count(distinct card) as n from v group by all",
    "weekly": "select c.zone, c.block, c.period, c.service_group, w.week, coalesce(wk.n, 0) * coalesce(c.share, 0.0) * c.visit_minutes / 60.0 as pressure from cells c join weeks w using (period) left join wk on c.zone = wk.zone and c.block = wk.block and c.period = wk.period and c.service_group = wk.service_group and w.week = wk.week",
    "gp": "select zone, block, period, service_group, quantile_disc(pressure, 0.5) as pressure from weekly group by all",
    "gm": "select c.zone, c.block, c.period, c.service_group, c.cards, c.share as driver_share, c.visit_minutes, gp.pressure, c.paid_zone from cells c join gp using (zone, block, period, service_group) where c.cards >= {k}",
    "zm": "select a.zone, a.block, a.period, case when a.cards >= {kz} then a.cards end as cards, case when a.cards >= {kz} then p.pressure end as pressure, a.cards < {kz} as too_few, a.zone in ('90-000', '90-001') as paid_zone from (select zone, block, period, count(distinct card) as cards from v group by all) a join (select zone, block, period, quantile_disc(pressure, 0.5) as pressure from (select zone, block, period, week, sum(pressure) as pressure from weekly group by all) group by all) p using (zone, block, period)",
    "axes": "select * from (values ('S1', 0), ('S2', 1)) p(period, period_no), (values ('07-10', 0), ('10-13', 1), ('13-16', 2), ('16-19', 3)) b(block, block_no)",
    "dn": "select z.zone, z.paid_zone, x.period, x.block, x.period_no, x.block_no, zm.cards, zm.pressure, coalesce(zm.too_few, true) or zm.pressure is null or not coalesce(zm.cards >= {kz}, false) as few from (select zone, bool_or(paid_zone) as paid_zone from zm group by zone) z cross join axes x left join zm on z.zone = zm.zone and x.period = zm.period and x.block = zm.block",
    "rk": "select zone, period, block, 100.0 * rank() over (partition by period order by pressure) / count(*) over (partition by period) as percentile from dn where not few",
    "lv": "select dn.zone, dn.period, dn.block, case when few then 'P1' when pressure > {c3} then 'P4' when pressure > {c2} then 'P3' when pressure > {c1} then 'P2' else 'P1' end as level, case when few then 'too few data' else '' end as note, rk.percentile, case when not few then pressure end as pressure, case when not few then cards end as cards, few as too_few, paid_zone, period_no, block_no from dn left join rk on dn.zone = rk.zone and dn.period = rk.period and dn.block = rk.block",
    "met": "select * from paid where meter is not null and period is not null and workday and block is not null",
}
NUMBERS = {"hubs": HUBS, "k": 15, "kz": 33, "c1": 4.5, "c2": 6.0, "c3": 7.2}


def sql(last: str, *names: str) -> str:
    """A query with the parts up to the given ones before it."""
    order = list(PARTS)
    need: set[str] = set()
    todo = list(names)
    import re

    while todo:
        n = todo.pop()
        if n not in need:
            need.add(n)
            todo += [m for m in order if m != n and re.search(rf"\b(from|join|,) {m}\b|\({m}\b|cross join {m}\b", PARTS[n])]
    text = ", ".join(f"{n} as ({PARTS[n]})" for n in order if n in need)
    for key, value in NUMBERS.items():
        text, last = text.replace("{" + key + "}", str(value)), last.replace("{" + key + "}", str(value))
    return f"with {text} {last}"
