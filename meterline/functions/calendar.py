"""Dates, blocks and periods as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Settings


def first_case(cases: list[tuple[Column, str]]) -> Column:
    """The value of the first condition that holds, else null."""
    start = F.lit(None).cast("string")
    return reduce(lambda rest, case: F.when(case[0], F.lit(case[1])).otherwise(rest), reversed(cases), start)


def local_time(day: str, gmt_time: str, zone: str) -> Column:
    """Wall time of a GMT date (yyyy-MM-dd) and time (HHmmss); null where either is malformed."""
    t = F.col(gmt_time)
    well = F.concat(F.col(day), F.lit(" "), t).rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{6}\z")
    # a cast costs a fraction of a formatter's parse
    stamp = F.concat(F.col(day), F.lit(" "), t.substr(1, 2), F.lit(":"), t.substr(3, 2), F.lit(":"), t.substr(5, 2)).try_cast("timestamp")
    return F.from_utc_timestamp(F.when(well, stamp), zone)


def block_of(ts: Column, s: Settings) -> Column:
    names = [next((b.name for b in s.blocks if b.start <= hour < b.end), None) for hour in range(24)]
    return F.get(F.array(*[F.lit(n).cast("string") for n in names]), F.hour(ts))


def period_of(day: Column, s: Settings) -> Column:
    return first_case([(day.between(F.lit(p.first).cast("date"), F.lit(p.last).cast("date")), p.name) for p in s.periods])


def is_workday(day: Column, s: Settings) -> Column:
    free = [F.lit(h).cast("date") for h in s.holidays]
    return F.dayofweek(day).between(2, 6) & (~day.isin(*free) if free else F.lit(True))


def week_of(ts: Column) -> Column:
    return F.trunc(F.to_date(ts), "week")


def minutes_between(a: Column, b: Column) -> Column:
    """Minutes from a to b, of whole seconds."""
    return (F.unix_timestamp(b) - F.unix_timestamp(a)) / F.lit(60.0)


def fee_block(ts: Column, s: Settings) -> Column:
    """The block of an instant by the clock alone: null at weekends and outside the blocks; holidays don't matter."""
    return F.when(F.dayofweek(ts).between(2, 6), block_of(ts, s))


def block_end(block: Column) -> Column:
    """'07-10' -> '10:00'."""
    return F.concat(F.split(block, "-")[1], F.lit(":00"))
