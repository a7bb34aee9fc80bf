"""Anonymous aggregates: each leaves only cells of at least `min_cards` distinct cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.calendar import minutes_between

CELL = ["zone", "block", "period", "service_group"]
ZONE = ["zone", "block", "period"]


def median(c: str) -> Column:
    """The lower median, exact whatever the rows number. A group keeps a count for each different value: minutes, amounts of a
    tariff or a season's weeks, which don't grow with the rows."""
    return F.expr(f"percentile_disc(0.5) within group (order by {c})")


def season_weeks(tx: DataFrame, s: Settings) -> DataFrame:
    """Weeks of each season in which any transaction fell on a workday."""
    return tx.where(F.col("period").isin(*s.seasons) & F.col("workday")).select("period", "week").distinct()


def driver_share(v: DataFrame, paid_zones: DataFrame | None = None) -> DataFrame:
    """(zone, period, service_group, paid_zone, share): card-days of drivers among all card-days.

    With `paid_zones` (zone), zones outside it take the share of all paid zones together; without, paid_zone is null. Card-days
    are reduced to one row each first, so a count needs no distinct set.
    """
    keys = ["period", "service_group"]
    days = v.groupBy("zone", *keys, "card", "day").agg(F.max("driver").alias("driver"))
    own = days.groupBy("zone", *keys).agg((F.sum("driver") / F.count("*")).alias("own"))
    if paid_zones is None:
        return own.select("zone", *keys, F.lit(None).cast("boolean").alias("paid_zone"), F.col("own").alias("share"))
    marks = F.broadcast(paid_zones.select("zone").distinct().withColumn("paid_zone", F.lit(True)))
    # a card may visit several paid zones in a day: count it once
    inside = days.join(marks, "zone", "left_semi").groupBy(*keys, "card", "day").agg(F.max("driver").alias("driver"))
    inside = inside.groupBy(*keys).agg((F.sum("driver") / F.count("*")).alias("inside"))
    flagged = own.join(marks, "zone", "left").withColumn("paid_zone", F.coalesce("paid_zone", F.lit(False)))
    return flagged.join(inside, keys, "left").select("zone", *keys, "paid_zone", F.when(F.col("paid_zone"), F.col("own")).otherwise(F.col("inside")).alias("share"))


def card_weeks(v: DataFrame) -> DataFrame:
    """A row for each card that came to a cell in a week: all counts of cards, by week, cell or zone, are counts of its rows."""
    return v.select(*CELL, "week", "card").distinct()


def counted(rows: DataFrame, keys: list[str], of: str, name: str) -> DataFrame:
    """How many different values `of` a group has. The pairs are reduced first, on their own: beside a median they would make a
    sketch for each pair."""
    return rows.where(F.col(of).isNotNull()).select(*keys, of).distinct().groupBy(*keys).agg(F.count("*").alias(name))


def same_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joined on keys that may be null."""
    r = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(r, on, how).drop(*[f"__{k}" for k in keys])


def cells(v: DataFrame, share: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """Season cells with distinct cards, median visit minutes and driver share. seen: `card_weeks` of v, where it is kept already."""
    cards = counted(card_weeks(v) if seen is None else seen, CELL, "card", "cards")
    base = cards.join(v.groupBy(*CELL).agg(median("minutes").alias("visit_minutes")), CELL)
    return base.join(share, ["zone", "period", "service_group"])


def weekly_pressure(v: DataFrame, season_cells: DataFrame, weeks: DataFrame, seen: DataFrame | None = None) -> DataFrame:
    """A row for each cell and week of its season: cards of the week (0 where none came) x driver share x visit hours."""
    came = (card_weeks(v) if seen is None else seen).groupBy(*CELL, "week").agg(F.count("card").alias("week_cards"))
    grid = season_cells.select(*CELL, "share", "visit_minutes").join(weeks, "period")
    return grid.join(came, [*CELL, "week"], "left").select(*CELL, "week", (F.coalesce("week_cards", F.lit(0)) * F.coalesce("share", F.lit(0.0)) * F.col("visit_minutes") / 60.0).alias("pressure"))


def group_metrics(season_cells: DataFrame, weekly: DataFrame, s: Settings) -> DataFrame:
    """Cells of enough cards with the median of weekly pressure."""
    return season_cells.join(weekly.groupBy(*CELL).agg(median("pressure").alias("pressure")), CELL).where(F.col("cards") >= s.min_cards).select(*CELL, "cards", F.col("share").alias("driver_share"), "visit_minutes", "pressure", "paid_zone")


def zone_metrics(v: DataFrame, weekly: DataFrame, s: Settings, paid_zones: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """All zone cells; those of too few cards have nulls. Pressure: the median week's sum over all groups, small ones too."""
    cards = counted(v if seen is None else seen, ZONE, "card", "cards")
    weeks = weekly.groupBy(*ZONE, "week").agg(F.sum("pressure").alias("pressure")).groupBy(*ZONE).agg(median("pressure").alias("pressure"))
    out = cards.join(weeks, ZONE)
    if paid_zones is None:
        out = out.withColumn("paid_zone", F.lit(None).cast("boolean"))
    else:
        out = out.join(paid_zones.select("zone").distinct().withColumn("paid_zone", F.lit(True)), "zone", "left").withColumn("paid_zone", F.coalesce("paid_zone", F.lit(False)))
    enough = F.col("cards") >= s.min_cards
    return out.select(*ZONE, F.when(enough, F.col("cards")).alias("cards"), F.when(enough, F.col("pressure")).alias("pressure"), (~enough).alias("too_few"), "paid_zone")


def metered(paid: DataFrame) -> DataFrame:
    return paid.where("meter is not null and period is not null and workday and block is not null")


def meter_metrics(m: DataFrame, s: Settings) -> DataFrame:
    """Per meter, period and block: payments, cards, days, minutes, amounts, and the median of weekly paid hours over weeks
    that had payments."""
    key = ["meter", "period", "block"]
    hours = m.groupBy(*key, "week").agg((F.sum("minutes") / 60).alias("hours")).groupBy(*key).agg(median("hours").alias("weekly_hours"))
    base = m.groupBy(*key).agg(
        F.max("subzone").alias("subzone"), F.max("subzone_from").alias("subzone_from"), F.max("meter_zone").alias("zone"), F.count("*").alias("payments"), F.size(F.collect_set("day")).cast("long").alias("days"),
        median("minutes").alias("median_minutes"), F.avg("minutes").alias("mean_minutes"), F.avg("amount").alias("mean_amount"),
    )
    base = base.join(counted(m, key, "card", "cards"), key).select(*key, "subzone", "subzone_from", "zone", "payments", "cards", "days", "median_minutes", "mean_minutes", "mean_amount")
    return base.join(hours, key).withColumn("payments_a_day", F.col("payments") / F.col("days")).where(F.col("cards") >= s.min_cards)


def subzone_metrics(m: DataFrame, s: Settings) -> DataFrame:
    """Per period, block and subzone, over the whole paid area."""
    key = ["period", "block", "subzone"]
    base = m.groupBy(*key).agg(
        F.count("*").alias("payments"), F.size(F.collect_set("day")).cast("long").alias("workdays"), median("minutes").alias("median_minutes"), F.avg("minutes").alias("mean_minutes"),
        F.avg((F.col("minutes") > 120).cast("double")).alias("share_over_2h"), F.avg("amount").alias("mean_amount"),
    )
    base = same_keys(same_keys(base, counted(m, key, "card", "cards"), key), counted(m, key, "meter", "meters"), key)
    base = base.select(*key, "payments", "cards", "meters", "workdays", "median_minutes", "mean_minutes", "share_over_2h", "mean_amount")
    return base.withColumn("payments_a_meter_day", F.col("payments") / (F.col("meters") * F.col("workdays"))).where(F.col("cards") >= s.min_cards)


def paid_hours(m: DataFrame, weeks: DataFrame, s: Settings) -> DataFrame:
    """Per zone cell the median of weekly paid hours, weeks without payments as 0."""
    own = m.where(F.col("meter_zone").isNotNull() & F.col("period").isin(*s.seasons)).withColumn("zone", F.col("meter_zone"))
    cards = counted(own, ZONE, "card", "cards")
    seen = own.groupBy(*ZONE, "week").agg((F.sum("minutes") / 60).alias("hours"))
    grid = cards.where(F.col("cards") >= s.min_cards).join(weeks, "period").join(seen, [*ZONE, "week"], "left")
    return grid.fillna(0.0, ["hours"]).groupBy(*ZONE, "cards").agg(median("hours").alias("paid_hours")).select(*ZONE, "paid_hours", "cards")


def regulars(m: DataFrame, s: Settings) -> DataFrame:
    """Per meter and season the share of cards that, in some week, parked long on enough days. One chain of aggregations:
    minutes a day, long days a week, a card's best week, cards."""
    days = m.where(F.col("period").isin(*s.seasons)).groupBy("meter", "period", "card", "week", "day").agg(F.sum("minutes").alias("minutes"), F.max("meter_zone").alias("zone"))
    weeks = days.groupBy("meter", "period", "card", "week").agg(F.count_if(F.col("minutes") > s.regular_minutes).alias("long"), F.max("zone").alias("zone"))
    cards = weeks.groupBy("meter", "period", "card").agg((F.max("long") >= s.regular_days).alias("regular"), F.max("zone").alias("zone"))
    return cards.groupBy("meter", "period").agg(F.max("zone").alias("zone"), F.count("*").alias("cards"), F.round(F.count_if("regular") / F.count("*"), 2).alias("regular_share")).where(F.col("cards") >= s.min_cards)


def calibration(v: DataFrame, s: Settings) -> DataFrame:
    """Per service group, over visits of two purchases or more: measured minutes from first to last purchase."""
    several = F.col("transactions") >= 2
    measured = minutes_between(F.col("start"), F.col("end"))
    out = v.withColumn("measured", F.when(several, measured)).groupBy("service_group").agg(
        F.max(F.when(several, F.col("default_minutes"))).alias("default_minutes"), F.count_if(several).alias("multi_visits"),
        (F.count_if(several) / F.count("*")).alias("multi_share"), median("measured").alias("measured_minutes"),
    )
    out = out.join(counted(v.where(several), ["service_group"], "card", "cards"), "service_group", "left").fillna(0, ["cards"])
    return out.select("service_group", "default_minutes", "multi_visits", "cards", "multi_share", "measured_minutes").where(F.col("cards") >= s.min_cards)
