"""From raw transactions to all aggregates and levels: one lazy plan each, which share what is written once."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from ..config import Settings
from ..operators import clean, levels, metrics, parking, visits
from ..sources.tables import Reference


@dataclass
class Facts:
    tx: DataFrame
    paid: DataFrame
    hubs: DataFrame
    visits: DataFrame


def facts(raw: DataFrame, ref: Reference, s: Settings, keep: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, priced: bool = True) -> Facts:
    """The cleaned transactions, parking payments, hub zones and visits of one city. `keep` gets each as it is made, with its name,
    and returns what the next is made from. Visits need no prices: without `priced`, payments have no amounts and minutes."""
    s = replace(s, exclusions=ref.exclusions or s.exclusions)
    tx = keep(clean.localised(raw, s).withColumn("bought", clean.bought(s)), "tx")
    paid = keep(parking.payments(tx, ref.tariff, s, ref.meters) if priced else parking.parked(tx, s, ref.meters), "paid")
    hub = keep(clean.hubs(tx, s), "hubs")
    gone = hub.select("zone") if ref.left_out is None else hub.select("zone").unionByName(ref.left_out.select("zone"))
    v = visits.visits(clean.at_places(tx.where("bought"), ref.groups, gone), s, parking.reached(paid, ref.reach), paid)
    return Facts(tx, paid, hub, keep(visits.of_visitors(v), "visits"))


def aggregates(raw: DataFrame, ref: Reference, s: Settings) -> dict[str, DataFrame]:
    """All outputs by name. Nothing in them names a card or a transaction. `visits` feeds several: persist it around a run of
    all of them (`with_visits`)."""
    return from_facts(facts(raw, ref, s), ref, s)


def from_facts(f: Facts, ref: Reference, s: Settings) -> dict[str, DataFrame]:
    v, m = f.visits, metrics.metered(f.paid)
    weeks = metrics.season_weeks(f.tx, s)
    seen = metrics.card_weeks(v)
    cells = metrics.cells(v, metrics.driver_share(v, ref.paid_zones), seen)
    weekly = metrics.weekly_pressure(v, cells, weeks, seen)
    return outputs(f, ref, s, m, weeks, cells, weekly, seen)


def outputs(f: Facts, ref: Reference, s: Settings, m: DataFrame, weeks: DataFrame, cells: DataFrame, weekly: DataFrame, seen: DataFrame) -> dict[str, DataFrame]:
    """The aggregates from facts and from what several of them share."""
    v = f.visits
    return {
        "group_metrics": metrics.group_metrics(cells, weekly, s),
        "zone_metrics": metrics.zone_metrics(v, weekly, s, ref.paid_zones, seen),
        "meter_metrics": metrics.meter_metrics(m, s),
        "subzone_metrics": metrics.subzone_metrics(m, s),
        "hubs": f.hubs,
        "paid_hours": metrics.paid_hours(m, weeks, s),
        "regulars": metrics.regulars(m, s),
        "calibration": metrics.calibration(v, s),
    }


def write_all(raw: DataFrame, ref: Reference, s: Settings, directory: str) -> None:
    """Every aggregate as one file under the directory.

    What several aggregates read is written once to the shared folder: transactions, payments, visits, a card's weeks, cells and
    weekly pressures. The scan and the windows run once, and a lost executor costs a
    task, not these tables. They are left for the folder's owner to expire.
    """
    from ..shared import kept
    from ..sources.sinks import write_aggregate

    f = facts(raw, ref, s, kept)
    m = metrics.metered(f.paid)
    weeks = kept(metrics.season_weeks(f.tx, s), "weeks")
    seen = kept(metrics.card_weeks(f.visits), "card-weeks")
    cells = kept(metrics.cells(f.visits, metrics.driver_share(f.visits, ref.paid_zones), seen), "cells")
    weekly = kept(metrics.weekly_pressure(f.visits, cells, weeks, seen), "weekly")
    for name, df in outputs(f, ref, s, m, weeks, cells, weekly, seen).items():
        write_aggregate(df, f"{directory}/{name}.parquet")


def level_table(raw: DataFrame, ref: Reference, s: Settings) -> DataFrame:
    return levels.level_table(aggregates(raw, ref, s)["zone_metrics"], s)
