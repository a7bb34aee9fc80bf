"""A Spark session with the settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def short_methods(spark: SparkSession) -> None:
    """HotSpot never compiles a method of more than 8,000 bytes of bytecode but interprets it row by row. Spark runs a wide step as
    one method of up to 65,535; with this it deals such a step out over several."""
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")


def joined_parts(spark: SparkSession) -> None:
    """A table that is kept has as many parts as its rows need, as a result has, and not one for each of the session's shuffle
    partitions: what reads it starts as many tasks. Rows with equal keys stay in one part."""
    spark.conf.set("spark.sql.optimizer.canChangeCachedPlanOutputPartitioning", "true")


def get_spark(app: str = "meterline", driver_memory: str = "4g") -> SparkSession:
    """UTC session; master and shuffle width from SPARK_MASTER and SPARK_SHUFFLE_PARTITIONS. AQE splits skewed joins."""
    return (
        SparkSession.builder.appName(app)
        .master(os.environ.get("SPARK_MASTER", "local[*]"))
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", os.environ.get("SPARK_SHUFFLE_PARTITIONS", "64"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.codegen.hugeMethodLimit", "8000")
        .config("spark.sql.parquet.datetimeRebaseModeInRead", "CORRECTED")
        .getOrCreate()
    )
