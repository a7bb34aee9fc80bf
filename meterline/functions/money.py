"""Tariffs: what a stay costs, and how long an amount pays for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Policy
from .text import duration, money


def minutes_for(amount: Column, half_hour: Column, hours: list[Column]) -> Column:
    """Minutes that an amount buys under hourly rates, the last of which goes on; half an hour at least, one decimal.

    Each band adds its share of an hour: the part of the amount between what the earlier hours cost and what this one does.
    """
    spent, longer = F.lit(0.0), F.lit(0.0)
    bands = []
    for i, rate in enumerate(hours):
        bands.append((spent + rate, longer + 60 * (amount - spent) / rate))
        spent, longer = spent + rate, longer + F.lit(60.0)
    out = bands[-1][1]
    for limit, value in reversed(bands[:-1]):
        out = F.when(amount <= limit, value).otherwise(out)
    return F.round(F.when(amount <= half_hour, F.lit(30.0)).otherwise(out), 1)


def rates(level: Column, shift: Column, policy: Policy, resident: bool = False) -> Column:
    """struct(first_minutes, first, flat, then, after) of a level. Rates are rounded before anything is computed with them."""
    base = policy.base_rate * (policy.resident_share if resident else 1.0)
    out = F.lit(None).cast("struct<first_minutes:int,first:double,flat:boolean,then:double,after:double>")
    for x in policy.levels:
        one = F.struct(
            F.least(F.lit(x.free_minutes) + F.coalesce(shift, F.lit(0)), F.lit(policy.longest_first)).cast("int").alias("first_minutes"),
            F.lit(round(x.first * base, 2)).alias("first"),
            F.lit(x.flat).alias("flat"),
            F.lit(round(x.then * base, 2)).alias("then"),
            F.lit(round(x.after * base, 2)).alias("after"),
        )
        out = F.when(level == x.name, one).otherwise(out)
    return out


def cost(r: Column, minutes: Column, policy: Policy) -> Column:
    """Cost of a stay, not rounded. A flat fee is due in full; the step counts from the start of the stay."""
    step = F.lit(policy.step_minutes)
    first = F.when(r["flat"], r["first"]).otherwise(F.least(minutes, r["first_minutes"]) / 60 * r["first"])
    then = F.greatest(F.lit(0), F.least(minutes, step) - r["first_minutes"]) / 60 * r["then"]
    after = F.greatest(F.lit(0), minutes - F.greatest(r["first_minutes"], step)) / 60 * r["after"]
    return F.when(minutes <= 0, F.lit(0.0)).otherwise(first + then + after)


def shift_of(group: Column, policy: Policy) -> Column:
    table = F.create_map(*[F.lit(x) for pair in policy.shifts.items() for x in pair])
    return F.coalesce(F.element_at(table, F.coalesce(group, F.lit(""))), F.lit(0))


def sentence(r: Column, policy: Policy) -> Column:
    """A rate plan in words."""
    step = F.lit(policy.step_minutes)
    hourly = lambda c: F.concat(money(c), F.lit("/h"))
    begin = F.concat(F.lit("Pierwsze "), duration(r["first_minutes"]), F.lit(" kosztuje "), money(r["first"]), F.when(r["flat"], "").otherwise("/h"))
    later = F.concat(F.lit(", potem "), hourly(r["then"]), F.when(r["after"] != r["then"], F.concat(F.lit(", po "), duration(step), F.lit(" "), hourly(r["after"]))).otherwise(""))
    return F.concat(begin, F.when(r["first_minutes"] < step, later).otherwise(F.concat(F.lit(", potem "), hourly(r["after"]))), F.lit("."))


def opening(r: Column) -> Column:
    """How a stay begins, in words."""
    flat = F.concat(money(r["first"]), F.lit(" za pierwsze "), r["first_minutes"].cast("string"), F.lit(" min (opłata stała)"))
    return F.when(r["flat"], flat).otherwise(F.concat(money(r["first"]), F.lit("/h przez pierwsze "), r["first_minutes"].cast("string"), F.lit(" min")))
