"""MinHash near-duplicates with odd sketches.

One pass makes each text's shingle set, its MinHash values, band keys from them, and an odd sketch: a parity bitmap of the
values, in which the population count of two sketches' XOR estimates a high similarity closely. Texts with equal sets are one
class. Classes that share a band key are compared with a few centres of that bucket, only while they lie in different
components; the sketch rejects pairs that are clearly below the threshold; the others are confirmed on their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import NOT_BLANK, Words, grams, mix
from .common import append_columns, documents, pieces, small_batches, stage, without

ROWS, BANDS = 5, 28
#: MinHash values: the bands take the first ROWS * BANDS, the sketch folds all of them.
SAMPLES, SKETCH_BITS = 280, 1024
#: Bits of the parity bitmap of the whole set. Two bitmaps differ in no more bits than the sets in elements, so it bounds the
#: similarity from above and never rejects a link.
PARITY_BITS = 4096
#: A sketch estimate this far below the threshold (about five standard errors) rejects a pair unseen.
MARGIN = 0.13
#: Centres of an unresolved bucket in each round; in the last, all members outside its largest component, so no link is missed.
CENTRES = (1, 16, None)
#: Members of an unresolved bucket that one task compares with as many others; a larger bucket is dealt by parts on both sides.
PART_ROWS = 1024

_RNG = np.random.default_rng(20240229)
_A = (_RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[:, None]
_B = _RNG.integers(0, 1 << 32, SAMPLES, dtype=np.uint64).astype(np.uint32)[:, None]


def shingle_sets(words: Words, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than k words is one shingle, without words none."""
    g = grams(words.hash, k)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(mix(grams(words.hash[a:b], int(b - a)) ^ np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minhash(shingles: np.ndarray) -> np.ndarray:
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(_A), np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(best, (_A * x[at : at + 2048] + _B).min(axis=1), out=best)
    return best


def band_keys(values: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, for MinHash values in rows."""
    v = values[:, : ROWS * BANDS].reshape(len(values), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), v.shape[:2]).copy()
    for r in range(ROWS):
        key = mix(key ^ v[:, :, r])
    return key.view(np.int64)


def parities(row: np.ndarray, values: np.ndarray, n: int, bits: int) -> np.ndarray:
    """For each of n rows a bitmap, as signed 64-bit words: a bit is set if an odd number of the row's values hash to it."""
    at = row * bits + (mix(values) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(at, minlength=n * bits) & 1).astype(np.uint8).reshape(n, bits)
    return np.packbits(odd, axis=1).view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Odd sketches of MinHash values in rows."""
    n, k = values.shape
    named = (np.arange(k, dtype=np.uint64)[None, :] << np.uint64(32)) | values
    return parities(np.repeat(np.arange(n), k), named.ravel(), n, SKETCH_BITS)


def set_parities(sets: list[np.ndarray]) -> np.ndarray:
    out = []
    for at in range(0, len(sets), 256):
        part = sets[at : at + 256]
        out.append(parities(np.repeat(np.arange(len(part)), [len(s) for s in part]), np.concatenate(part), len(part), PARITY_BITS))
    return np.concatenate(out)


def most_flips(threshold: float) -> int:
    """The largest XOR population count that still leaves an estimate of threshold - MARGIN."""
    differ = 2 * SAMPLES * (1 - max(0.0, threshold - MARGIN))
    return math.ceil(SKETCH_BITS / 2 * (1 - math.exp(-2 * differ / SKETCH_BITS)))


def _lists(table: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(0, table.size + 1, table.shape[1], dtype=np.int32), np.ascontiguousarray(table).ravel())


def _signatures(df: DataFrame, text: str, k: int) -> DataFrame:
    schema = pa.schema([("__n", pa.int64()), ("__node", pa.int64()), ("__bands", pa.list_(pa.int64())), ("__sketch", pa.list_(pa.int64())), ("__parity", pa.list_(pa.int64())), ("__packed", pa.binary())])

    def make():
        press = zstandard.ZstdCompressor(level=1)

        def run(columns):
            texts = columns[0].to_pylist()
            sets = shingle_sets(Words(texts, NOT_BLANK), k)
            values = np.array([minhash(s) for s in sets])
            bands, sketches = band_keys(values), odd_sketches(values)
            node = np.array([int(mix(np.bitwise_xor.reduce(mix(s), keepdims=True) + np.uint64(len(s)) + s.sum(keepdims=True))[0]) if len(s) else 0 for s in sets], np.uint64)
            some = [len(s) > 0 for s in sets]
            return [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([int(x) if y else None for x, y in zip(node.view(np.int64), some)], pa.int64()),
                _lists(bands),
                _lists(sketches),
                _lists(set_parities(sets)),
                pa.array([None if t is None else press.compress(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary()),
            ]

        return run

    return append_columns(df, [text], schema, "__n bigint, __node bigint, __bands array<bigint>, __sketch array<bigint>, __parity array<bigint>, __packed binary", make)


def _unpacked(packed: str) -> Column:
    def run(values: pd.Series) -> pd.Series:
        z = zstandard.ZstdDecompressor()
        return pd.Series([None if p is None else z.decompress(p).decode("utf-8", "surrogatepass") for p in values], dtype=object)

    return F.pandas_udf(run, "string")(packed)


def _confirmed(pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets, made anew from both texts, satisfy 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for b in pieces(batch, ["pa", "pb"], 1 << 18):
                both = [z.decompress(x).decode("utf-8", "surrogatepass") for c in ("pa", "pb") for x in b.column(c).to_pylist()]
                sets = shingle_sets(Words(both, NOT_BLANK), k)
                n = b.num_rows
                good = []
                for x, y in zip(sets[:n], sets[n:]):
                    inter = len(np.intersect1d(x, y, assume_unique=True))
                    good.append(100 * inter >= percent * (len(x) + len(y) - inter))
                keep = pa.array(good)
                yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep)], names=["a", "b"])

    return pairs.select("a", "b", "pa", "pb").mapInArrow(run, "a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of each node that has an edge (a, b); equal labels, the smallest node, make a component.

    Labels spread along edges and then jump to their own label's label; every round is a written table.
    """
    both = stage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = stage(spread.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) != F.col("label")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").head(1):
            return labels


def _flips(a: Column, b: Column, bits: int) -> Column:
    total = F.lit(0)
    for i in range(bits // 64):
        total = total + F.bit_count(a[i].bitwiseXOR(b[i]))
    return total


def _close(a: str, b: str, percent: int) -> Column:
    """May the rows with suffixes a and b be linked? By size, by the sketches' estimate and by the parity bitmaps' bound."""
    c = lambda n: (F.col(n + a), F.col(n + b))
    (na, nb), limit = c("n"), most_flips(percent / 100)
    sized = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
    sketched = _flips(*c("sketch"), SKETCH_BITS) <= limit
    bounded = (100 + percent) * _flips(*c("parity"), PARITY_BITS) <= (100 - percent) * (na + nb)
    return sized & sketched & bounded


def open_rows(named: DataFrame, classes: DataFrame, centres: int | None) -> DataFrame:
    """The members (no, band, size, node, label) of buckets in which several components meet, with their sketches, and `chosen`:
    the bucket's centres of this round. Without a number of centres they are all members outside the bucket's largest component:
    two members inside it need no comparison, so a bucket of N costs N times those outside."""
    labels = named.groupBy("band", "label").agg(F.count("*").alias("c"))
    split = labels.groupBy("band").agg(F.count("*").alias("labels"), F.sum("c").alias("members"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("top")).where("labels > 1")
    outside = F.lit(1) if centres is not None else F.ceil((F.col("members") - F.col("most")) / PART_ROWS)
    split = split.select("band", "top", F.ceil(F.col("members") / PART_ROWS).alias("parts"), outside.cast("bigint").alias("outside"))
    chosen = F.col("label") != F.col("top") if centres is None else F.pmod(F.xxhash64("node", "band"), F.col("size")) < centres
    return named.join(split, "band").join(classes.select("node", "n", "bands", "sketch", "parity"), "node").withColumn("chosen", chosen)


def dealt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Open rows as two sides, members and centres, that meet once by (band, part_a, part_b): each part of the members meets each
    part of the centres in one place."""
    mine = lambda c: F.pmod(F.xxhash64("node"), F.col(c))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1))
    o = rows.select("no", "band", mine("parts").alias("part_a"), every("outside").alias("part_b"), *[F.col(c).alias(f"{c}_a") for c in ("node", "label", "n", "bands", "sketch", "parity", "chosen")])
    c = rows.where("chosen").select("band", every("parts").alias("part_a"), mine("outside").alias("part_b"), *[F.col(c).alias(f"{c}_b") for c in ("node", "label", "n", "bands", "sketch", "parity")])
    return o, c


def near_duplicates(df: DataFrame, row_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80) -> DataFrame:
    """df with `n_shingles`, `component_id` (the smallest id of all that links lead to) and `kept` (the row has that id).

    A link: Jaccard similarity of the sets of `shingle`-word shingles is `percent` / 100 at least. Of pairs at exactly 0.8
    one in 70,000 shares no band (fewer above); pairs that do are compared unless other links already join them, in rounds
    of more centres, in the last of which all members outside a bucket's largest component are centres, so nothing is capped.
    Large buckets are dealt by parts of both sides. The odd sketch rejects a pair whose estimate lies MARGIN below the threshold (none of 6,000 such pairs
    in the tests).

    Null and empty texts, and those without words, link with nothing and are kept; a null id joins groups but never names one
    unless all its ids are null; repeated rows share an id and so stay or go together; columns with an output's name are
    replaced. Sets are compared as 64-bit hashes.
    """
    spark = df.sparkSession
    small_batches(spark)
    df = without(df, "n_shingles", "component_id", "kept")
    order = df.columns
    rows = df.withColumn("__id", F.col(row_id)).withColumn("__text", F.col(text)).drop(text)
    signed = _signatures(rows, "__text", shingle).drop("__text")
    signed = stage(signed, "signatures")
    classes = stage(
        signed.where("__node is not null").groupBy(F.col("__node").alias("node")).agg(F.min("__id").alias("low"), F.max("__n").alias("n"), F.min_by(F.struct("__bands", "__sketch", "__parity"), F.xxhash64("__id")).alias("s"))
        .select("node", "low", "n", F.col("s.__bands").alias("bands"), F.col("s.__sketch").alias("sketch"), F.col("s.__parity").alias("parity")),
        "classes",
    )
    members = classes.select(F.posexplode("bands").alias("no", "band"), "node")
    shared = stage(members.groupBy("band").agg(F.count("*").alias("size")).where("size > 1"), "buckets")
    bucket = stage(members.join(shared, "band"), "bucket-members")
    # a text in the middle of its group meets more others than one at the edge: the best centre links most at once
    degree = bucket.groupBy("node").agg(F.sum("size").alias("degree"))
    middle = bucket.join(degree, "node").groupBy("band").agg(F.max_by("node", F.struct("degree", "node")).alias("centre"))
    first = bucket.join(stage(middle, "centres"), "band").where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct()
    sides = [classes.select(F.col("node").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "sketch", "parity")]) for x in "ab"]
    right = sides[1].withColumnRenamed("b", "b2")
    likely = first.join(sides[0], "a").join(right, (F.col("b") == F.col("b2")) & _close("_a", "_b", percent)).select("a", "b")
    labels, texts, links, tried = None, None, None, None
    for centres in CENTRES:
        if centres != CENTRES[0]:
            if tried is None:
                named = bucket.withColumn("label", F.col("node"))
            else:
                named = bucket.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
            named = named.where("size > 2")  # pairs are settled by the first round
            rows = stage(open_rows(named, classes, centres), "open-rows")
            if not rows.head(1):
                break
            o, c = dealt(rows)
            # only close pairs of different components leave the join, each from the first band that it shares
            once = (F.col("label_a") != F.col("label_b")) & (~F.col("chosen_a") | (F.col("node_a") < F.col("node_b")))
            here = F.array_position(F.zip_with("bands_a", "bands_b", lambda x, y: x == y), True) == F.col("no") + 1
            met = o.join(c, ["band", "part_a", "part_b"]).where(once & _close("_a", "_b", percent) & here)
            likely = met.select(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b"))
            likely = likely.join(tried, ["a", "b"], "left_anti") if tried is not None else likely
        likely = stage(likely, "likely", few=True)
        if not likely.head(1):
            continue
        tried = likely if tried is None else tried.unionByName(likely)
        needed = likely.select(F.col("a").alias("node")).unionByName(likely.select(F.col("b").alias("node"))).distinct()
        if texts is not None:
            needed = needed.join(texts.select("node"), "node", "left_anti")
        owners = needed.join(classes.select("node", "low"), "node")
        found = signed.select(F.col("__node").alias("node"), F.col("__id"), F.col("__packed").alias("packed")).join(owners, "node").where(F.col("__id").eqNullSafe(F.col("low"))).drop("__id", "low").dropDuplicates(["node"])
        found = stage(found, "texts", few=True)
        texts = found if texts is None else texts.unionByName(found)
        full = likely.join(texts.toDF("a", "pa"), "a").join(texts.toDF("b", "pb"), "b")
        good = stage(_confirmed(full, shingle, percent), "links", few=True)
        links = good if links is None else links.unionByName(good)
        labels = components(links)
    if labels is None:
        labels = classes.select("node", F.col("node").alias("label")).limit(0)
    named = classes.select("node", "low").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    lowest = named.groupBy("label").agg(F.min("low").alias("component_id"))
    of = named.join(lowest, "label").select(F.col("node").alias("__node"), "component_id")
    out = signed.join(of, "__node", "left").withColumn("component_id", F.when(F.col("__node").isNull(), F.col("__id")).otherwise(F.col("component_id")))
    out = out.withColumns({text: _unpacked("__packed"), "n_shingles": F.col("__n"), "kept": F.col("__id").eqNullSafe(F.col("component_id"))})
    return out.select(*order, "n_shingles", "component_id", "kept")


def op2_odd_sketches(spark, sf_dir: str) -> DataFrame:
    """Components of whole `documents` texts under 4-word shingles and a similarity of 0.8."""
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), shingle=4).select("doc_id", "n_shingles", "component_id", "kept")
