"""Histogram sort: shards of near-equal bytes by exact counts below candidate key boundaries, then one exchange."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, stage, without

LOW, HIGH = -(1 << 63), (1 << 63) - 1


def content_key(text: str = "text", row_id: str = "doc_id") -> Column:
    """A 64-bit order key: equal texts are neighbours, and rows of one text still differ, so a hot text can be split."""
    upper = F.xxhash64(F.col(text)).bitwiseAND(F.lit(-(1 << 32)))
    return upper.bitwiseOR(F.xxhash64(F.col(row_id), F.col(text)).bitwiseAND(F.lit((1 << 32) - 1)))


def histogram(keys: DataFrame, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exact bytes and rows whose key lies below each bound. Each task counts its rows; Spark sums at most len(bounds) + 1 cells."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
        for b in batches:
            k, w = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            at = np.searchsorted(bounds, k, side="right")
            size += np.bincount(at, weights=w, minlength=len(size)).astype(np.int64)
            rows += np.bincount(at, minlength=len(rows))
        has = np.flatnonzero(rows)
        yield pa.RecordBatch.from_arrays([pa.array(has), pa.array(size[has]), pa.array(rows[has])], names=["cell", "size", "n"])

    cells = keys.mapInArrow(count, "cell bigint, size bigint, n bigint").groupBy("cell").agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
    size, rows = np.zeros(len(bounds) + 1, np.int64), np.zeros(len(bounds) + 1, np.int64)
    for r in cells.collect():
        size[r.cell], rows[r.cell] = r.size, r.n
    return size.cumsum()[:-1], rows.cumsum()[:-1]


def splitters(keys: DataFrame, parts: int, tolerance: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of `parts` key ranges of near-equal bytes, and the exact number of rows below each.

    Every round counts at evenly spaced probes inside each open interval and keeps the subinterval that brackets the target; a
    splitter is done within `tolerance` bytes of its target, or when its interval is one key wide (a tie that no key splits).
    """
    total = keys.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first().w
    targets = [total * i // parts for i in range(1, parts)]
    low, high = [LOW] * len(targets), [HIGH] * len(targets)
    best: list[tuple[int, int, int] | None] = [None] * len(targets)  # distance, bound, rows below
    todo = list(range(len(targets)))
    while todo:
        tried = sorted({low[i] + (high[i] - low[i]) * j // (probes + 1) for i in todo for j in range(1, probes + 1)} | {high[i] for i in todo if high[i] - low[i] <= probes})
        size, rows = histogram(keys, np.array(tried, np.int64))
        at = {b: (int(s), int(n)) for b, s, n in zip(tried, size, rows)}
        left = []
        for i in todo:
            inside = [b for b in tried if low[i] <= b <= high[i]] if len(todo) < 64 else [low[i] + (high[i] - low[i]) * j // (probes + 1) for j in range(1, probes + 1)]
            for b in inside:
                s, n = at[b]
                if best[i] is None or abs(s - targets[i]) < best[i][0]:
                    best[i] = abs(s - targets[i]), b, n
                if s <= targets[i]:
                    low[i] = max(low[i], b)
                else:
                    high[i] = min(high[i], b)
            if best[i][0] > tolerance and high[i] - low[i] > 1:
                left.append(i)
        todo = left
    found = sorted((b[1], b[2]) for b in best)
    return np.array([b for b, _ in found], np.int64), np.array([n for _, n in found], np.int64)


def histogram_shards(df: DataFrame, key: Column, size: Column, shards: int = 24, tolerance: float = 0.0005, probes: int = 15, range_bytes: int = 16 << 20, most_ranges: int = 1 << 17) -> DataFrame:
    """df with `size` (bytes of the row), `shard` (0 .. shards - 1) and `slot` (gapless from 0 within a shard).

    Law: shards are consecutive key ranges whose byte sums lie within `tolerance` of a shard of each other's target, unless one
    row or one tied key is heavier than that. The rows cross the network once. A shard is dealt to tasks as finer key ranges of
    about `range_bytes` (larger ones where there would be more than `most_ranges`, which bounds what the driver holds); the
    histogram already knows their row counts, so slots need no task that sees a whole shard. Each range has a partition of its own.

    Null keys order first and null sizes count 0; rows equal in every column get neighbouring slots; an empty table stays
    empty; columns named size, shard or slot are replaced, others pass through.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = without(df.withColumns({"__key": F.coalesce(key, F.lit(LOW)), "__size": F.coalesce(size, F.lit(0)).cast("long")}), "size", "shard", "slot")
    keys = stage(df.select(F.col("__key").alias("k"), F.col("__size").alias("w")), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first().w
    each = max(1, min(-(-total // (shards * range_bytes)), most_ranges // shards))
    bounds, below = splitters(keys, shards * each, int(tolerance * total / shards), max(3, min(probes, (1 << 17) // (shards * each))))
    starts = np.concatenate([[0], below])
    offset = (starts - np.repeat(starts[::each], each)).tolist()

    @F.pandas_udf("int")
    def cell(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, k.to_numpy(), side="right").astype(np.int32))

    ties = [F.col(f"`{f.name}`") for f in df.schema if f.name not in ("__key", "__size") and f.dataType.simpleString() in ("bigint", "int", "string")]
    rank = F.row_number().over(Window.partitionBy("__cell").orderBy("__key", *ties))
    return (
        df.withColumn("__cell", cell("__key"))
        .repartitionById(shards * each, F.col("__cell"))
        .withColumn("__rank", rank)
        .withColumns({"size": F.col("__size"), "shard": F.floor(F.col("__cell") / each).cast("int"), "slot": F.element_at(F.lit(offset).cast("array<bigint>"), F.col("__cell") + 1) + F.col("__rank") - 1})
        .drop("__key", "__size", "__cell", "__rank")
    )


def op10_histogram_sort(spark, sf_dir: str) -> DataFrame:
    """`documents` in 24 shards by the law `bytes`; equal texts are neighbours in key order. Null text: no bytes.

    Texts go through the exchange, as they must where shards are written, though the digest needs their checksum alone.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = histogram_shards(docs, content_key(), F.coalesce(F.octet_length("text"), F.lit(0)) + 8)
    return out.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
