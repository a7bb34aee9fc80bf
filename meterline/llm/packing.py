"""Bounded-space online packing: a fixed number of open windows per partition, best fit, then a merge of what stays open."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, pieces, small_batches, stage
from .tokens import vocabulary_path
from .words import encoder

_PIECES = "__doc {doc}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, open boolean"


class _Window:
    __slots__ = ("fill", "number", "rows")

    def __init__(self, number: int):
        self.fill, self.number, self.rows = 0, number, []


def _pack(window: int, opened: int, base: int):
    """place(doc, start, ids, doc_tokens) yields finished windows; rest() those still open."""
    windows: list[_Window] = []
    made = [0]

    def new() -> _Window:
        made[0] += 1
        return _Window(base + made[0] - 1)

    def place(doc, ids, total):
        for start in range(0, total - window + 1, window):  # whole windows of a long document
            w = new()
            w.rows.append((doc, start, ids[4 * start : 4 * (start + window)], total, 0))
            w.fill = window
            yield w
        start = total - total % window
        n = total - start
        if not n:
            return
        fits = [w for w in windows if w.fill + n <= window]
        if fits:
            w = max(fits, key=lambda x: x.fill)
        else:
            if len(windows) == opened:
                full = max(windows, key=lambda x: x.fill)
                windows.remove(full)
                yield full
            w = new()
            windows.append(w)
        w.rows.append((doc, start, ids[4 * start :], total, w.fill))
        w.fill += n
        if w.fill == window:
            windows.remove(w)
            yield w

    return place, windows


def pack_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, window: int = 2048, opened: int = 64, end_id: int = 1, merge_windows: int = 100_000) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Each partition tokenizes its texts once, keeps `opened` windows open, puts the rest of a document (what is left after
    whole windows) into the fullest window that holds it, and sends off the fullest window when none does. The windows that
    stay open, at most `opened` for each partition, are merged by best fit, largest first, `merge_windows` to a task.

    Null and empty texts are the end id alone; texts of any length are cut into windows; a repeated row is packed each time;
    an empty table gives no rows; other columns are left out.
    """
    spark = df.sparkSession
    small_batches(spark)
    path = path or vocabulary_path()
    kind = df.schema[doc_id].dataType.simpleString()
    rows = df.select(F.col(doc_id).alias("__doc"), F.coalesce(F.col(text), F.lit("")).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path, False), end_id.to_bytes(4, "little")
        place, windows = _pack(window, opened, TaskContext.get().partitionId() << 36)
        out: list[tuple] = []
        held, doc_type = 0, pa.int64()

        def flush():
            c = list(zip(*out))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[0], doc_type), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.binary()), *(pa.array(x, pa.int64()) for x in c[4:7]), pa.array(c[7], pa.bool_())], names=["__doc", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"])

        def done(w: _Window, still: bool):
            out.extend((doc, start, len(ids) // 4, ids, total, w.number, at, still) for doc, start, ids, total, at in w.rows)
            return w.fill

        for batch in batches:
            doc_type = batch.column(0).type
            for b in pieces(batch, ["__text"]):
                for doc, ids in zip(b.column(0).to_pylist(), enc.batch(b.column(1).to_pylist())):
                    ids += end
                    for w in place(doc, ids, len(ids) // 4):
                        held += done(w, False)
                    if held > 1 << 20:
                        yield flush()
                        held = 0
        for w in windows:
            done(w, True)
        if out:
            yield flush()

    placed = stage(rows.mapInArrow(run, _PIECES.format(doc=kind)), "packed")
    left = placed.where("open").groupBy("sequence_id").agg(F.sum("length").alias("fill"))
    tasks = max(1, -(-left.count() // merge_windows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = sorted(((f, s) for b in batches for s, f in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), key=lambda x: (-x[0], x[1]))
        rooms: list[tuple[int, int]] = []  # free room, sequence, in order
        moved = []
        for fill, old in todo:
            at = bisect_left(rooms, (fill, -1))
            room, into = rooms.pop(at) if at < len(rooms) else (window, old)
            moved.append((old, into, window - room))
            if room > fill:
                insort(rooms, (room - fill, into))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*moved)] if moved else [pa.array([], pa.int64())] * 3, names=["sequence_id", "into", "base"])

    moved = left.repartition(tasks, "sequence_id").mapInArrow(merge, "sequence_id bigint, into bigint, base bigint")
    merged = placed.where("open").join(moved, "sequence_id").withColumns({"sequence_id": F.col("into"), "offset": F.col("offset") + F.col("base")})
    out = ["start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return placed.where("not open").select("__doc", *out).unionByName(merged.select("__doc", *out)).withColumnRenamed("__doc", doc_id)


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All `documents` in sequences of at most 2048 tokens of word_bpe_49k.json."""
    return digest(pack_documents(documents(spark, sf_dir)))
