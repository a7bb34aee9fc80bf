"""Levels of zones, dense over seasons and blocks, and their reshapings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings

TOO_FEW = "too few data"


def level_of(pressure: Column, s: Settings) -> Column:
    """P1 .. P4; a cut belongs to the level below it."""
    low, mid, high = s.cuts
    return F.when(pressure > high, "P4").when(pressure > mid, "P3").when(pressure > low, "P2").otherwise("P1")


def dense(zone_metrics: DataFrame, s: Settings) -> DataFrame:
    """Every zone x season x block; the paid-zone flag is the zone's. A zone's cells, a few, become a map that the grid reads."""
    axes = F.array(*[F.struct(F.lit(p).alias("period"), F.lit(i).alias("period_no"), F.lit(b.name).alias("block"), F.lit(j).alias("block_no")) for i, p in enumerate(s.seasons) for j, b in enumerate(s.blocks)])
    cell = F.struct(F.struct("period", "block").alias("key"), F.struct("cards", "pressure", "too_few").alias("value"))
    zones = zone_metrics.groupBy("zone").agg(F.max("paid_zone").alias("paid_zone"), F.map_from_entries(F.collect_list(cell)).alias("cells"))
    grid = zones.select("zone", "paid_zone", "cells", F.explode(axes).alias("axis"))
    found = F.try_element_at("cells", F.struct("axis.period", "axis.block"))
    return grid.select("zone", "axis.*", "paid_zone", found.alias("cell")).select("zone", "period", "block", "paid_zone", "period_no", "block_no", "cell.*")


def level_table(zone_metrics: DataFrame, s: Settings) -> DataFrame:
    """zone, period, block, level, note, percentile, pressure, cards, too_few, paid_zone (and the order of period and block).

    The percentile is 100 x minimum rank / number of the season's cells with enough data; it informs only. A season has as many
    cells as zones times blocks, whatever the transactions number, so its ranks are one window.
    """
    few = F.coalesce("too_few", F.lit(True)) | F.col("pressure").isNull() | ~F.coalesce(F.col("cards") >= s.min_cards, F.lit(False))
    grid = dense(zone_metrics, s).withColumn("too_few", few)
    season = Window.partitionBy("period", "too_few")
    rank = 100.0 * F.rank().over(season.orderBy("pressure")) / F.count("*").over(season)
    hidden = lambda c: F.when(~F.col("too_few"), F.col(c))
    return grid.withColumn("rank", rank).select(
        "zone", "period", "block", F.when(F.col("too_few"), "P1").otherwise(level_of(F.col("pressure"), s)).alias("level"), F.when(F.col("too_few"), TOO_FEW).otherwise("").alias("note"),
        hidden("rank").alias("percentile"), hidden("pressure").alias("pressure"), hidden("cards").alias("cards"), "too_few", "paid_zone", "period_no", "block_no",
    )


def ordered(levels: DataFrame) -> DataFrame:
    return levels.orderBy("period_no", "block_no", "zone")


def schedule(levels: DataFrame, period: str, s: Settings) -> DataFrame:
    """zone x block of levels."""
    return levels.where(F.col("period") == period).groupBy("zone").pivot("block", [b.name for b in s.blocks]).agg(F.max("level"))


def day_profile(levels: DataFrame, period: str, s: Settings) -> DataFrame:
    """zone x block of pressure, null where data are too few."""
    return levels.where(F.col("period") == period).groupBy("zone").pivot("block", [b.name for b in s.blocks]).agg(F.max("pressure"))


def day_labels(levels: DataFrame, period: str, s: Settings) -> DataFrame:
    """zone x block of level, or the note where data are too few."""
    label = F.when(F.col("note") != "", F.col("note")).otherwise(F.col("level"))
    return levels.where(F.col("period") == period).groupBy("zone").pivot("block", [b.name for b in s.blocks]).agg(F.max(label)).fillna(TOO_FEW)


def visit_minutes(groups: DataFrame, period: str, block: str, names: list[str]) -> DataFrame:
    """zone x service group of median visit minutes."""
    return groups.where((F.col("period") == period) & (F.col("block") == block)).groupBy("zone").pivot("service_group", names).agg(F.max("visit_minutes"))


def level_counts(levels: DataFrame) -> DataFrame:
    return levels.groupBy("period", "block").agg(*[F.count_if((F.col("level") == p) & ~F.col("too_few")).alias(p.lower()) for p in ("P1", "P2", "P3", "P4")], F.count_if("too_few").alias("too_few"))


def valid_until(levels: DataFrame) -> DataFrame:
    """levels with `until`: the end of the run of consecutive blocks of one level that each block belongs to.

    A run is named by the number of level changes up to it.
    """
    order = Window.partitionBy("zone", "period").orderBy("block_no")
    changed = (F.col("level") != F.coalesce(F.lag("level").over(order), F.col("level"))).cast("int")
    runs = levels.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by("block", "block_no").over(Window.partitionBy("zone", "period", "run"))
    return runs.withColumn("until", F.concat(F.split(last, "-")[1], F.lit(":00"))).drop("changed", "run")
