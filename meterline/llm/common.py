"""What the operators share: the shared folder, staged tables, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch that goes to a Python worker: bounds a task's memory whatever the rows weigh.
BATCH_BYTES = 1 << 20


#: Bytes of a page of a table that is compressed hard: more to find repeats in.
PAGE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir; a local one only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    own = os.path.join(tempfile.gettempdir(), "meterline-shared")
    os.makedirs(own, exist_ok=True)
    return f"file://{own}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, few: bool = False, level: int = 3) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors.

    `few` is for results whose partitions are as many as their input's but hold little: adaptive execution puts such rows together
    into files of its advisory size, however many there are. `level` is the compression's.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    if few:
        df = df.hint("rebalance")
    df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", level).option("parquet.page.size", PAGE_BYTES if level > 3 else 1 << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session by bytes as well as by rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that carry an output's name; the outputs replace them."""
    gone = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in gone])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def append_columns(df: DataFrame, inputs: list[str], outputs: pa.Schema, ddl: str, make: Callable[[], Callable[[list[pa.Array]], list[pa.Array]]]) -> DataFrame:
    """df plus columns made from some of its own, batch by batch in Arrow.

    `make` runs once for each task and returns what turns a batch's input arrays into its output arrays. Columns of df that
    have an output's name are replaced.
    """
    small_batches(df.sparkSession)
    names = [f.name for f in outputs]
    kept = [c for c in df.columns if c.lower() not in {n.lower() for n in names}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for b in batches:
            for part in pieces(b, inputs):
                made = f([part.column(c) for c in inputs])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made], names=[*kept, *names])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*[F.col(f"`{c}`") for c in kept]).schema)
    return df.mapInArrow(run, f"{kinds}, {ddl}" if kinds else ddl)


def pieces(batch: pa.RecordBatch, by: list[str], most: int = 2 * BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose columns `by` hold at most about `most` bytes, one row at least."""
    if batch.num_rows == 0:
        return
    total = sum(batch.column(c).nbytes for c in by)
    if total <= most or batch.num_rows == 1:
        yield batch
        return
    half = batch.num_rows // 2
    yield from pieces(batch.slice(0, half), by, most)
    yield from pieces(batch.slice(half), by, most)
