"""Benchmark decontamination by winnowing.

Each window of w consecutive k-word hashes keeps its smallest, so any shared span of k + w - 1 words shares a fingerprint
however the texts around it differ. Fingerprints of documents that a benchmark item also has are extended, word by word, to
the longest shared run; a run that holds a whole window of the item is a hit.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bytewords import ALNUM, Words, grams
from .common import append_columns, documents, pieces, small_batches, stage, without

WINDOW = 13
#: Text bytes of a benchmark that may be broadcast; they are counted first, and a larger one is joined.
BROADCAST_BYTES = 16 << 20
RANGES = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def shape(length: int) -> tuple[int, int]:
    """k and w with k + w - 1 = length."""
    k = length // 2 + 1
    return k, length - k + 1


def winnow(hashes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the fingerprints: the rightmost minimum of each window of w k-gram hashes."""
    g = grams(hashes, k)
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    best, at = g[:n].copy(), np.arange(n)
    for j in range(1, w):
        other = g[j : j + n]
        less = other <= best
        best[less] = other[less]
        at[less] = np.flatnonzero(less) + j
    at = np.unique(at)
    return at, g[at]


class Block:
    """Fingerprints and words of some benchmark items, one set for each window length that occurs (13, or a shorter item's)."""

    def __init__(self, items: list[tuple]):
        by_words: dict[tuple, list] = defaultdict(list)
        for item_id, text in items:
            w = Words([text], ALNUM)
            if len(w.hash):
                by_words[tuple(w.word(i) for i in range(len(w.hash)))].append(item_id)
        self.words = list(by_words)
        self.ids = list(by_words.values())
        self.sets: dict[int, tuple[np.ndarray, dict]] = {}
        found: dict[int, dict] = defaultdict(lambda: defaultdict(list))
        for number, words in enumerate(self.words):
            length = min(WINDOW, len(words))
            w = Words([b"\n".join(words).decode("utf-8", "surrogatepass")], ALNUM)
            for at, value in zip(*winnow(w.hash, *shape(length))):
                found[length][int(value)].append((number, int(at)))
        for length, places in found.items():
            self.sets[length] = np.array(sorted(places), np.uint64), dict(places)

    def search(self, doc: list[bytes], first: np.ndarray, places: dict, length: int, hit: np.ndarray, items: set) -> None:
        """Extend fingerprints at words `first` of one document (with the items' places of each) and mark hits."""
        done: dict[tuple[int, int], int] = {}
        for i, value in first:
            for number, j in places[value]:
                words = self.words[number]
                if done.get((number, i - j), -1) >= i:
                    continue
                a = 0
                while a < min(i, j) and doc[i - a - 1] == words[j - a - 1]:
                    a += 1
                b, most = 0, min(len(doc) - i, len(words) - j)
                while b < most and doc[i + b] == words[j + b]:
                    b += 1
                done[number, i - j] = i + b - 1 if b else i
                if b and a + b >= length:
                    hit[i - a : i + b] = True
                    items.add(number)


def contamination(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """df with `n_words`, `hits` (array of struct start, end: word ranges inside shared windows) and `items` (their item ids).

    A window is 13 consecutive words of an item; an item of fewer words, but not none, is one window. A benchmark whose texts
    hold at most `broadcast_bytes` (counted first) goes to the tasks, and nothing is shuffled; a larger one is a table of
    fingerprints that Spark joins with those of the documents, and only texts that meet are compared. Both give the same.

    A null or empty text has no words and no hits; items without words match nothing; repeated rows and equal items each
    count; empty tables give no rows, or no hits; columns with an output's name are replaced, others pass through.
    """
    spark = df.sparkSession
    small_batches(spark)
    b = benchmark.select(F.col(item_id).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("item"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("item")), F.lit(0)).alias("n")).first().n
    id_type = benchmark.schema[item_id].dataType
    if size <= broadcast_bytes:
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, [(r.id, r.item) for r in b.collect()]))
        arrow_id = to_arrow_type(id_type)
        schema = pa.schema([("n_words", pa.int64()), ("hits", RANGES), ("items", pa.list_(arrow_id))])
        ddl = f"n_words bigint, hits array<struct<start:int,end:int>>, items array<{id_type.simpleString()}>"
        return append_columns(df, [text], schema, ddl, lambda: _searcher(sent, arrow_id))
    return _joined(df, b, text, id_type.simpleString())


#: This worker's last block, kept over tasks.
_BLOCKS: dict[str, Block] = {}


def find(block: Block, w: Words) -> tuple[dict[int, np.ndarray], dict[int, set]]:
    """For each text of w that shares a window with the block: which of its words are hit, and the numbers of the items."""
    hits: dict[int, np.ndarray] = {}
    items: dict[int, set] = defaultdict(set)
    for length, (values, places) in block.sets.items():
        at, value = winnow(w.hash, *shape(length))
        if not len(at):
            continue
        where = np.searchsorted(values, value)
        doc = np.searchsorted(w.first, at, side="right") - 1
        match = (values[np.minimum(where, len(values) - 1)] == value) & (at + shape(length)[0] <= w.first[doc + 1])
        at, value, doc = at[match], value[match], doc[match]
        for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(doc)) + 1) if len(at) else []:
            d = int(doc[part[0]])
            base, end = w.first[d], w.first[d + 1]
            words = [w.word(i) for i in range(base, end)]
            block.search(words, [(int(a - base), int(v)) for a, v in zip(at[part], value[part])], places, length, hits.setdefault(d, np.zeros(end - base, bool)), items[d])
    return hits, items


def _ranges(mark: np.ndarray | None) -> list[dict]:
    if mark is None:
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mark.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)]


def _searcher(sent, arrow_id):
    key, given = sent.value
    if key not in _BLOCKS:
        _BLOCKS.clear()
        _BLOCKS[key] = Block(given)
    block = _BLOCKS[key]

    def run(columns):
        w = Words(columns[0].to_pylist(), ALNUM)
        hits, items = find(block, w)
        n = range(len(w.first) - 1)
        ids = [sorted(set().union(*(block.ids[i] for i in items[d])), key=str) if d in items else [] for d in n]
        return [pa.array(np.diff(w.first)), pa.array([_ranges(hits.get(d)) for d in n], RANGES), pa.array(ids, pa.list_(arrow_id))]

    return run


def _fingerprints(texts: DataFrame, lengths: list[int] | None) -> DataFrame:
    """(k1, k2, length, print) from (k1, k2, text): the distinct fingerprints of each text for every window length, or, of an
    item (`lengths` is None), for its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in pieces(batch, ["text"], 1 << 18):
                w = Words(b.column("text").to_pylist(), ALNUM)
                n = np.diff(w.first)
                for length in lengths or range(1, WINDOW + 1):
                    at, value = winnow(w.hash, *shape(length))
                    doc = np.searchsorted(w.first, at, side="right") - 1
                    inside = at + shape(length)[0] <= w.first[doc + 1]
                    if lengths is None:
                        inside &= np.minimum(WINDOW, n[doc]) == length
                    pair = np.unique(np.stack([doc[inside].astype(np.uint64), value[inside]], axis=1), axis=0)
                    row = pa.array(pair[:, 0].astype(np.int64))
                    yield pa.RecordBatch.from_arrays([b.column("k1").take(row), b.column("k2").take(row), pa.array(np.full(len(row), length, np.int32)), pa.array(pair[:, 1].view(np.int64))], names=["k1", "k2", "length", "print"])

    return texts.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 int, length int, print bigint")


def _keys(column: str) -> list[Column]:
    """Texts with the same keys (96 bits) are taken to be equal."""
    return [F.xxhash64(column).alias("k1"), F.hash(column).alias("k2")]


def _joined(df: DataFrame, b: DataFrame, text: str, id_type: str) -> DataFrame:
    """`contamination` by a join of fingerprints. Equal texts are one on both sides, so copies don't multiply, and what a frequent
    fingerprint matches is split by adaptive execution."""
    own = F.coalesce(F.col(text), F.lit(""))
    rows = without(df.withColumns({"__k1": F.xxhash64(own), "__k2": F.hash(own), "__n": _word_count(own)}), "n_words", "hits", "items")
    rows = rows.withColumnsRenamed({c: f"__in_{c}" for c in rows.columns})
    docs = df.select(F.coalesce(F.col(text), F.lit("")).alias("text")).select("text", *_keys("text"))
    items = b.select("id", F.col("item").alias("text"), *_keys("item"))
    item_prints = stage(_fingerprints(items.dropDuplicates(["k1", "k2"]), None), "bench-prints")
    lengths = sorted(r.length for r in item_prints.select("length").distinct().collect())  # 13 at most
    doc_prints = _fingerprints(docs, lengths or [WINDOW])
    met = doc_prints.join(item_prints.withColumnsRenamed({"k1": "i1", "k2": "i2"}), ["length", "print"]).select("k1", "k2", "i1", "i2").distinct()
    met = stage(met, "bench-met")
    doc_texts = docs.join(met.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").dropDuplicates(["k1", "k2"])
    item_texts = items.select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), F.col("text").alias("item")).dropDuplicates(["i1", "i2"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, ["text", "item"]):
                out: list[tuple] = []
                for k1, k2, t, i1, i2, item in zip(*(part.column(c).to_pylist() for c in ("k1", "k2", "text", "i1", "i2", "item"))):
                    hits, _ = find(Block([(0, item)]), Words([t], ALNUM))
                    if 0 in hits and hits[0].any():
                        out.append((k1, k2, i1, i2, _ranges(hits[0])))
                c = list(zip(*out)) if out else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), RANGES))], names=["k1", "k2", "i1", "i2", "hits"])

    pairs = met.join(doc_texts, ["k1", "k2"]).join(item_texts, ["i1", "i2"]).select("k1", "k2", "text", "i1", "i2", "item")
    found = stage(pairs.mapInArrow(extend, "k1 bigint, k2 int, i1 bigint, i2 int, hits array<struct<start:int,end:int>>"), "bench-hits")
    ranges = found.select("k1", "k2", F.explode("hits").alias("h")).groupBy("k1", "k2").agg(F.sort_array(F.collect_set("h")).alias("hits")).mapInArrow(_merge, "k1 bigint, k2 int, hits array<struct<start:int,end:int>>")
    ids = found.select("k1", "k2", "i1", "i2").join(items.select(F.col("k1").alias("i1"), F.col("k2").alias("i2"), "id"), ["i1", "i2"])
    known = ranges.join(ids.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("id")).alias("items")), ["k1", "k2"])
    out = rows.join(known, (F.col("__in___k1") == F.col("k1")) & (F.col("__in___k2") == F.col("k2")), "left")
    named = [F.col(f"`{c}`").alias(c.removeprefix("__in_")) for c in rows.columns if c not in ("__in___k1", "__in___k2", "__in___n")]
    none = F.array().cast("array<struct<start:int,end:int>>")
    return out.select(*named, F.col("__in___n").alias("n_words"), F.coalesce("hits", none).alias("hits"), F.coalesce("items", F.array().cast(f"array<{id_type}>")).alias("items"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ranges of each text as maximal ones."""
    for b in batches:
        merged = []
        for found in b.column(2).to_pylist():
            out: list[dict] = []
            for r in found:
                if out and r["start"] <= out[-1]["end"]:
                    out[-1]["end"] = max(out[-1]["end"], r["end"])
                else:
                    out.append(dict(r))
            merged.append(out)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(merged, RANGES)], names=["k1", "k2", "hits"])


def _word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda w: w != "")).cast("long")


def digest(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated (a twentieth of the words, or more, are hit) from `contamination`."""
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    joined = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.withColumns({"n_hit": hit, "n_items": F.size("items").cast("long"), "items_sha256": F.sha2(joined.cast("binary"), 256)}).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    """Whole `documents` against whole `benchmark` items."""
    found = contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
