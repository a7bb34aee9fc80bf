"""Sinks: partitioned parquet, single-file exports, CSV with a byte-order mark, GeoJSON collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .onefile import write_one_file


def write_rows(df: DataFrame, path: str) -> int:
    """Parquet in files of a size that adaptive execution picks (REBALANCE splits skewed partitions); the rows written."""
    df.hint("rebalance").write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def write_aggregate(df: DataFrame, path: str) -> None:
    """An aggregate as one file; aggregates are small by construction (cells, not cards). Only finished rows move to the one task."""
    df.repartition(1).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """One CSV file with a header; `mark` puts a byte-order mark before it, for spreadsheets. Nulls are empty, quotes doubled."""
    quoted = lambda n: '"' + n.replace('"', '""') + '"' if any(c in n for c in ',"\r\n') or n != n.strip() else n
    line = F.to_csv(F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns]), {"escape": '"'})
    write_one_file(df.select(line.alias("value")), path, ("﻿" if mark else "") + ",".join(map(quoted, df.columns)) + "\n")


def write_geojson(features: DataFrame, path: str) -> None:
    """Features (value) as one collection, written by as many tasks as there are partitions."""
    write_one_file(features.select("value"), path, '{"type":"FeatureCollection","features":[', ",\n", "]}\n")
