"""Token counts by a two-tier lookup on the map side: a broadcast table of frequent pre-tokens, then the worker's own cache."""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, documents, small_batches, stage
from .words import chunks, encoder, special, split


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Sketches merged by one task; the last so many meet in the driver.
FAN_IN = 16


def _heaviest(seen: Counter, most: int) -> tuple[list[str], list[int]]:
    top = sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:most]
    return [w for w, _ in top], [n for _, n in top]


def frequent_lengths(df: DataFrame, text: str, path: str, entries: int = 30_000) -> dict[str, int]:
    """Token counts of the most frequent pre-tokens of all texts, at most `entries` of them.

    Each task reads its texts into a bounded counter and hands on one row: a sketch of its `entries` most frequent pre-tokens.
    Sketches are merged FAN_IN at a time into sketches of the same size, so pre-tokens themselves are never dealt out, and what
    the driver gets is bounded. The table only saves work; a pre-token that it lacks is encoded where it is met. So counts that a
    full counter drops do no harm.
    """
    small_batches(df.sparkSession)
    ddl = "block bigint, words array<string>, counts array<bigint>"

    def table(block: int, seen: Counter) -> dict:
        words, counts = _heaviest(seen, entries)
        return {"block": pa.array([block], pa.int64()), "words": pa.array([words], pa.list_(pa.string())), "counts": pa.array([counts], pa.list_(pa.int64()))}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                for part in () if special(t) else chunks(t):
                    seen.update(split(part))
                    if len(seen) > 20 * entries:
                        seen = Counter(dict(seen.most_common(10 * entries)))
        if seen:
            yield pa.RecordBatch.from_pydict(table(TaskContext.get().partitionId(), seen))

    def merged(rows) -> Counter:
        seen: Counter = Counter()
        for words, counts in rows:
            seen.update(dict(zip(words, counts)))
        return seen

    def merge(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        return pa.table(table(group[0].as_py(), merged(zip(t.column("words").to_pylist(), t.column("counts").to_pylist()))))

    sketches = stage(df.select(F.col(text)).where(F.col(text).isNotNull()).mapInArrow(count, ddl), "token-sketches")
    while sketches.count() > FAN_IN:
        sketches = stage(sketches.groupBy(F.floor(F.col("block") / FAN_IN).alias("group")).applyInArrow(merge, ddl), "token-sketches")
    words, _ = _heaviest(merged((r.words, r.counts) for r in sketches.collect()), entries)
    enc = encoder(path, True)
    enc.learn(set(words))
    return {w: enc.get(w) for w in words}


def token_counts(df: DataFrame, text: str = "text", path: str | None = None, entries: int = 30_000) -> DataFrame:
    """df with `n_tokens`, the library's count for the text, without begin or end tokens.

    Null and empty texts count 0; a text of any length is counted whole; special strings inside a text are single tokens, as
    the library's default has it; rows pass through one by one, so repeated rows stay; a column named n_tokens is replaced.
    """
    path = path or vocabulary_path()
    key = uuid.uuid4().hex
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(df, text, path, entries))

    def make():
        enc = encoder(path, True, key)
        if not enc.base:
            enc.start_from(table.value)

        def count(columns):
            return [pa.array(enc.batch(columns[0].to_pylist()), pa.int64())]

        return count

    return append_columns(df, [text], pa.schema([("n_tokens", pa.int64())]), "n_tokens bigint", make)


def op3_token_counts(spark, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of `documents` under word_bpe_49k.json."""
    out = token_counts(documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    return out.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
