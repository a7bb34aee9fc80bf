"""Visits: a card's purchases in a zone on a day, cut where more than the gap lies between two."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.calendar import block_of, minutes_between


def visits(purchases: DataFrame, s: Settings, reached: DataFrame | None = None, paid: DataFrame | None = None) -> DataFrame:
    """One row a visit: card, day, week, period, zone, visit_no, start, end, service_group, default_minutes, visitor,
    transactions, block, minutes; with `paid`, payments anywhere, also `driver`: 1 where the card paid for parking that day.

    Purchases and payments that reach the zone are one stream, ordered by time within (card, day, zone). So the gap, the
    number of the visit and the latest payment before it come from one window over one exchange, the aggregation after it
    keeps that partitioning, and no row fans out. A payment up to `payment_minutes` before the first purchase starts the
    visit. Group and default are the last purchase's. The exchange is by card alone: days of drivers, and whatever is counted
    of cards afterwards, find a card's visits in one partition.
    """
    keys = ["card", "day", "zone"]
    extra = ["week", "period", "txn_id", "service_group", "default_minutes", "visitor"]
    stream = purchases.select(*keys, "ts", *extra, F.lit(None).cast("timestamp").alias("paid_ts"), F.lit(1).alias("bought"))
    known = "card is not null and day is not null"  # a payment without a card or day belongs to no visit
    if reached is not None:
        stream = stream.unionByName(reached.where(known).select(*keys, F.col("paid_ts").alias("ts"), "paid_ts", F.lit(0).alias("bought")), allowMissingColumns=True)
    if paid is not None:
        stream = stream.unionByName(paid.where(known).select("card", "day", F.lit(0).alias("bought"), F.lit(1).alias("parked")), allowMissingColumns=True)
    stream = stream.repartition("card")
    order = Window.partitionBy(*keys).orderBy("ts", "bought", "txn_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    previous = F.last(F.when(F.col("bought") == 1, F.col("ts")), ignorenulls=True).over(before)
    fresh = F.when(F.col("bought") == 1, (previous.isNull() | (minutes_between(previous, F.col("ts")) > s.gap_minutes)).cast("int")).otherwise(0)
    marked = stream.withColumns({"fresh": fresh, "latest": F.last("paid_ts", ignorenulls=True).over(upto)})
    marked = marked.withColumn("visit_no", F.sum("fresh").over(upto))
    if paid is not None:
        marked = marked.withColumn("driver", F.coalesce(F.max("parked").over(Window.partitionBy("card", "day")), F.lit(0)))
    marked = marked.where("bought = 1")
    last = F.struct("ts", "txn_id")
    grouped = marked.groupBy(*keys, "visit_no").agg(
        F.max("week").alias("week"),
        F.max("period").alias("period"),
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.max_by("service_group", last).alias("service_group"),
        F.max_by("default_minutes", last).alias("default_minutes"),
        F.max("visitor").alias("visitor"),
        F.count("*").alias("transactions"),
        F.max(F.when(F.col("fresh") == 1, F.col("latest"))).alias("latest"),
        *([] if paid is None else [F.max("driver").alias("driver")]),
    )
    near = minutes_between(F.col("latest"), F.col("start")) <= s.payment_minutes
    begin = F.coalesce(F.when(near, F.col("latest")), F.col("start"))
    return grouped.withColumns({"block": block_of(begin, s), "minutes": minutes_between(begin, F.col("end")) + F.col("default_minutes")}).drop("latest")


def of_visitors(v: DataFrame) -> DataFrame:
    """Visitors' visits inside the blocks."""
    return v.where(F.col("block").isNotNull() & (F.col("visitor") == 1))


def with_drivers(v: DataFrame, driver_days: DataFrame) -> DataFrame:
    """`of_visitors` with `driver` 1 where the card paid for parking anywhere that day, for visits that were made without."""
    return of_visitors(v).join(driver_days, ["card", "day"], "left").withColumn("driver", F.coalesce("driver", F.lit(0)))
