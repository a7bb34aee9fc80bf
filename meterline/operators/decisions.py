"""What follows from levels: rate tables, driver cards, recommendations, manual assignments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Policy, Settings
from ..functions import money
from ..functions.calendar import fee_block

CELL = ["zone", "period", "block"]


def dominant_groups(groups: DataFrame) -> DataFrame:
    """The service group of most pressure in each cell; ties by more cards, then by name. Null pressure doesn't count."""
    first = F.min_by("service_group", F.struct(-F.col("pressure"), -F.col("cards"), F.col("service_group")))
    return groups.where("pressure is not null").groupBy(*CELL).agg(first.alias("dominant_group"))


def priced(cells: DataFrame, groups: DataFrame, policy: Policy) -> DataFrame:
    """cells (zone, period, block, level, ...) with dominant group, shift and rates, standard and for residents."""
    out = cells.join(dominant_groups(groups), CELL, "left").withColumn("shift", money.shift_of(F.col("dominant_group"), policy))
    return out.withColumns({"rates": money.rates(F.col("level"), F.col("shift"), policy), "resident_rates": money.rates(F.col("level"), F.col("shift"), policy, True)})


def rate_table(cells: DataFrame, groups: DataFrame, policy: Policy) -> DataFrame:
    """One row a cell: the rates, what each of three hours costs, and the cost of one, two and three hours."""
    p = priced(cells, groups, policy)
    total = {h: money.cost(F.col("rates"), F.lit(60 * h), policy) for h in range(4)}
    hours = [F.round(total[h] - total[h - 1], 2).alias(f"hour_{h}") for h in (1, 2, 3)]
    sums = [F.round(total[h], 2).alias(f"cost_{h}h") for h in (1, 2, 3)]
    r = F.col("rates")
    then = F.when(r["first_minutes"] < policy.step_minutes, r["then"]).alias("then_rate")
    return p.select(*CELL, "level", "dominant_group", r["first_minutes"].alias("first_minutes"), r["flat"].alias("flat"), r["first"].alias("first_rate"), then, r["after"].alias("after_rate"), *hours, *sums)


def level_rates(spark, policy: Policy) -> DataFrame:
    """The policy itself as a table: how a stay begins at each level and what its hours cost."""
    levels = spark.createDataFrame([(x.name,) for x in policy.levels], "level string")
    r = money.rates(F.col("level"), F.lit(0), policy)
    total = {h: money.cost(r, F.lit(60 * h), policy) for h in range(4)}
    return levels.select("level", money.opening(r).alias("opening"), *[F.round(total[h] - total[h - 1], 2).alias(f"hour_{h}") for h in (1, 2, 3)], F.round(total[3], 2).alias("cost_3h"))


def stay_costs(stays: DataFrame, policy: Policy, resident: bool = False) -> DataFrame:
    """stays (level, shift, minutes, ...) with the rounded cost."""
    return stays.withColumn("cost", F.round(money.cost(money.rates(F.col("level"), F.col("shift"), policy, resident), F.col("minutes"), policy), 2))


def cost_breakdown(cells: DataFrame, groups: DataFrame, policy: Policy) -> DataFrame:
    """For each cell the parts of the cost at half an hour, one, two and three hours and at the end of the first period."""
    r, m, step = F.col("rates"), F.col("minutes"), F.lit(policy.step_minutes)
    points = F.array_sort(F.array_distinct(F.array(*[F.lit(x) for x in (30, 60, 120, 180)], r["first_minutes"])))
    rows = priced(cells, groups, policy).withColumn("minutes", F.explode(points))
    parts = {"first_part": F.least(m, r["first_minutes"]), "then_part": F.greatest(F.lit(0), F.least(m, step) - r["first_minutes"]), "after_part": F.greatest(F.lit(0), m - F.greatest(r["first_minutes"], step))}
    return rows.select(*CELL, "level", "minutes", *[c.alias(n) for n, c in parts.items()], F.round(money.cost(r, m, policy), 2).alias("cost"))


def driver_cards(requests: DataFrame, levels: DataFrame, groups: DataFrame, policy: Policy, s: Settings) -> DataFrame:
    """requests (request_id, zone, period, at) answered in bulk: level, how long it holds, rates in words, hours' costs.

    levels is `levels.valid_until`'s table. Outside the blocks and at weekends parking is free.
    """
    asked = requests.withColumn("block", fee_block(F.col("at"), s))
    cells = levels.select(*CELL, "level", "note", "until")
    out = priced(asked.join(cells, CELL, "left"), groups, policy)
    free = F.col("block").isNull()
    text = lambda r: F.when(free, "Parkowanie bezpłatne (strefa płatna działa pn–pt 7–19).").otherwise(F.concat(F.lit("Ta strefa ma teraz poziom "), F.col("level"), F.lit(" (do "), F.col("until"), F.lit("). "), money.sentence(F.col(r), policy)))
    hour = lambda r, h: F.when(free, 0.0).otherwise(F.round(money.cost(F.col(r), F.lit(60 * h), policy) - money.cost(F.col(r), F.lit(60 * h - 60), policy), 2))
    costs = [hour(r, h).alias(f"{n}hour_{h}") for r, n in (("rates", ""), ("resident_rates", "resident_")) for h in (1, 2, 3)]
    return out.select("request_id", "zone", "period", "block", "level", "note", "until", "dominant_group", "shift", text("rates").alias("message"), text("resident_rates").alias("resident_message"), *costs)


def eligible(levels: DataFrame, s: Settings, left_out: DataFrame | None = None) -> DataFrame:
    """Paid zones' cells with enough data, without zones that are left out."""
    ok = levels.where(F.coalesce("paid_zone", F.lit(False)) & ~F.col("too_few") & (F.col("cards") >= s.min_cards) & F.col("pressure").isNotNull())
    return ok if left_out is None else ok.join(left_out.select("zone").distinct(), "zone", "left_anti")


def recommendations(levels: DataFrame, groups: DataFrame, s: Settings, period: str, block: str, left_out: DataFrame | None = None) -> DataFrame:
    """Zones of level P3 or P4 in the block, what to look into, most blocks of high pressure first.

    The counts of blocks are over the whole season: one aggregation of the eligible cells gives both and the block's own row.
    """
    ok = eligible(levels.where(F.col("period") == period), s, left_out)
    high = F.col("level").isin("P3", "P4")
    now = F.when(high & (F.col("block") == block), F.struct("level", "pressure", "cards", "percentile"))
    zones = ok.groupBy("zone").agg(F.count_distinct(F.when(high, F.col("block"))).alias("high_blocks"), F.count_distinct("block").alias("known_blocks"), F.max(now).alias("now")).where("now is not null")
    named = zones.select("zone", F.lit(period).alias("period"), F.lit(block).alias("block"), "now.*", "high_blocks", "known_blocks").join(dominant_groups(groups), CELL, "left")
    action = F.when(F.col("high_blocks") >= 2, "look into more spaces").otherwise("look into how peak hours are organised")
    also = F.when(F.col("dominant_group").isin("quick_services", "small_grocery"), "look into turnover and short-stay spaces").otherwise("look into sharing car parks and guiding to free spaces")
    return named.withColumns({"action": action, "also": also}).orderBy(F.desc("high_blocks"), F.desc("pressure"), "zone")


class DanglingAssignment(ValueError):
    """An assignment names a group that the catalogue doesn't have, or the catalogue isn't unique."""


def checked_catalogue(catalogue: DataFrame) -> DataFrame:
    """catalogue (group_id, name, description), trimmed; names must be given and differ whatever their case."""
    c = catalogue.withColumns({n: F.trim(F.coalesce(n, F.lit(""))) for n in ("name", "description")})
    state = c.agg(F.count("*").alias("n"), F.count_if(F.col("name") == "").alias("blank"), F.count_distinct(F.lower("name")).alias("names"), F.count_distinct("group_id").alias("ids")).first()
    if state.blank or state.names < state.n or state.ids < state.n:
        raise DanglingAssignment("every group needs a name and an id of its own")
    return c


def assigned(cells: DataFrame, assignments: DataFrame, catalogue: DataFrame) -> DataFrame:
    """cells (zone, level, ...) with the group each is assigned to by hand, or else its level's, and whether that differs."""
    out = cells.withColumnRenamed("level", "model_level").join(assignments.select("zone", F.col("group_id").alias("by_hand")), "zone", "left")
    out = out.withColumn("group_id", F.coalesce("by_hand", "model_level")).drop("by_hand").withColumn("changed", F.col("group_id") != F.col("model_level"))
    if out.join(catalogue, "group_id", "left_anti").head(1):
        raise DanglingAssignment("an assignment names a group that isn't there")
    return out.join(catalogue.select("group_id", F.col("name").alias("group_name"), F.col("description").alias("group_description")), "group_id", "left")
