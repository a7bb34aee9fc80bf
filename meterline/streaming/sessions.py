"""Visits and block counts over a stream of localised purchases. The batch plan stays the reference for both."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings


def visit_stream(purchases: DataFrame, s: Settings, late: str = "1 day") -> DataFrame:
    """Gap sessions per card and zone: start, end, purchases; rows later than `late` are dropped by the watermark.

    A session ends a gap after its last purchase, as the batch rule has it to the second; days aren't cut.
    """
    gap = F.session_window("ts", f"{s.gap_minutes} minutes")
    counted = purchases.withWatermark("ts", late).groupBy(gap.alias("w"), "card", "zone").agg(F.count("*").alias("transactions"), F.max("ts").alias("finish"))
    return counted.select("card", "zone", F.col("w.start").alias("start"), "finish", "transactions")


def block_stream(purchases: DataFrame, s: Settings, late: str = "1 day") -> DataFrame:
    """Purchases and approximately distinct cards by zone and block window, on the blocks' own grid."""
    first = s.blocks[0]
    width = first.end - first.start
    w = F.window("ts", f"{width} hours", f"{width} hours", f"{first.start % width} hours")
    counted = purchases.withWatermark("ts", late).groupBy(w.alias("w"), "zone").agg(F.count("*").alias("transactions"), F.approx_count_distinct("card").alias("cards"))
    inside = F.hour("start").between(first.start, s.blocks[-1].end - 1)
    return counted.select("zone", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "transactions", "cards").where(inside)
