"""Exact top-k inner products: vectors in buckets of like length, pruned by local cosine thresholds, survivors verified."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import small_batches, stage

#: Vectors of a bucket and queries of a block, about; the ratio of the lengths within a bucket; buckets of the first round.
BUCKET, BLOCK, RATIO, SEEDS = 2048, 1024, 1.1, 4
#: Coordinates that a query is looked up by, the share of a bucket below which looking up beats multiplying, queries tried for it.
FOCUS, WORTH, TRIED = 3, 0.2, 16
#: Relative slack of bounds computed in doubles: they may let a vector through, never cut one.
SLACK = 1e-9

_PACKED = "{key} bigint, rows bigint, longest double, u binary, ids array<bigint>, x binary, width int, least binary"
_FOUND = "query_u bigint, query_id bigint, vec_id bigint, score bigint"


def _pack(key: str):
    """One row for a group of rows (u, id, x, norm[, least]): arrays as bytes, longest first."""

    def run(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        norm = np.asarray(t.column("norm"))
        order = np.lexsort((np.asarray(t.column("u")), -norm))
        t, norm = t.take(pa.array(order)), norm[order]
        x = vectors.matrix(t.column("x"))
        least = np.asarray(t.column("least"), dtype=float)
        return pa.table({
            key: pa.array([group[0].as_py()], pa.int64()), "rows": pa.array([len(x)], pa.int64()), "longest": [float(norm[0])], "u": [np.asarray(t.column("u"), dtype=np.int64).tobytes()],
            "ids": pa.array([t.column("id").to_pylist()], pa.list_(pa.int64())), "x": [np.ascontiguousarray(x).tobytes()], "width": pa.array([x.shape[1]], pa.int32()), "least": [least.tobytes()],
        })

    return run


class _Side:
    def __init__(self, row: dict):
        self.u = np.frombuffer(row["u"], np.int64)
        self.x = np.frombuffer(row["x"], np.int64).reshape(len(self.u), row["width"])
        self.ids = row["ids"]
        self.least = np.frombuffer(row["least"])
        self.norm = np.sqrt((self.x.astype(float) ** 2).sum(1))


def _widened(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] == width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Bucket:
    """Vectors of like length, longest first, that answer which of them reach a score with a query."""

    def __init__(self, x: np.ndarray, norm: np.ndarray):
        self.x, self.norm = x, norm
        self.unit = x / np.where(norm > 0, norm, 1.0)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def by(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """The bucket in the order of coordinate f of the unit vectors, and the sorted coordinates."""
        if f not in self.lists:
            order = np.argsort(self.unit[:, f], kind="stable")
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    @staticmethod
    def region(q: np.ndarray, f: int, cosine: float) -> tuple[float, float]:
        """Where coordinate f of a unit vector must lie if its cosine with the unit vector q is at least this."""
        a, b = math.acos(min(1.0, max(-1.0, cosine))), math.acos(min(1.0, max(-1.0, q[f])))
        low = math.cos(a + b) if a + b < math.pi else -1.0
        high = math.cos(b - a) if b > a else 1.0
        return low - SLACK, high + SLACK

    def range(self, q: np.ndarray, cosine: float) -> tuple[int, int, int]:
        """The focus coordinate with the fewest vectors in its region, and its range in that coordinate's order."""
        best = (len(self.norm) + 1, 0, 0, 0)
        for f in np.argsort(-np.abs(q))[:FOCUS]:
            _, values = self.by(int(f))
            low, high = self.region(q, int(f), cosine)
            a, b = np.searchsorted(values, low, "left"), np.searchsorted(values, high, "right")
            best = min(best, (int(b - a), int(f), int(a), int(b)))
        return best[1:]

    def threshold(self, q: np.ndarray, cosines: np.ndarray) -> float:
        """The least cosine from which a look-up leaves at most the share WORTH of the bucket, judged by some of the queries."""
        tried = np.argsort(cosines)[np.unique(np.linspace(0, len(cosines) - 1, min(TRIED, len(cosines))).astype(int))]
        worth = math.inf
        for i in tried[::-1]:
            _, a, b = self.range(q[i], cosines[i])
            if b - a > WORTH * len(self.norm):
                break
            worth = cosines[i]
        return worth

    def reach(self, q: np.ndarray, unit: np.ndarray, cosine: float, length: float) -> np.ndarray:
        """Places of the vectors that pass the regions of the focus coordinates and are at least so long."""
        f, a, b = self.range(unit, cosine)
        at = self.by(f)[0][a:b]
        at = at[self.norm[at] >= length]
        for g in np.argsort(-np.abs(unit))[:FOCUS]:
            low, high = self.region(unit, int(g), cosine)
            c = self.unit[at, g]
            at = at[(c >= low) & (c <= high)]
        return at


def best_of(queries: _Side, found: _Side, k: int) -> list[tuple[int, int, int, int]]:
    """(query's u, query's id, vector's id, score) of the k best of this bucket for each query whose score is at least the
    query's `least`; fewer where fewer reach it."""
    width = max(queries.x.shape[1], found.x.shape[1])
    qx, px = _widened(queries.x, width), _widened(found.x, width)
    longest = float(found.norm.max(initial=0))
    if float(queries.norm.max(initial=0)) * longest >= 2.0**62:
        raise OverflowError("a score may exceed 64 bits")
    plain = float(np.abs(qx).max(initial=0)) * float(np.abs(px).max(initial=0)) * max(width, 1) < 2.0**53  # then doubles are exact
    kind, at_least = (np.float64, queries.least) if plain else (np.int64, queries.least - np.abs(queries.least) * 2.0**-51)
    qv, pv = qx.astype(kind), px.astype(kind)
    bucket = Bucket(px.astype(float), found.norm)
    ids, known = np.array([i or 0 for i in found.ids], np.int64), np.array([i is not None for i in found.ids])
    own = {int(u): i for i, u in enumerate(found.u)}
    out = []

    def take(q: int, at: np.ndarray, scores: np.ndarray) -> None:
        order = np.lexsort((ids[at], ~known[at], -scores))[:k]
        out.extend((int(queries.u[q]), queries.ids[q], found.ids[at[i]], int(scores[i])) for i in order)

    with np.errstate(divide="ignore", invalid="ignore"):
        need = np.where(queries.least > 0, queries.least / queries.norm, -np.inf)  # the length that a parallel vector needs
        cosine = np.where(queries.least > 0, need / longest if longest else np.inf, -np.inf)
    live = np.flatnonzero(cosine <= 1 + SLACK)
    unit = qx / np.where(queries.norm > 0, queries.norm, 1.0)[:, None]
    pruned = live[cosine[live] > 0]
    worth = bucket.threshold(unit[pruned], cosine[pruned]) if len(pruned) else math.inf
    for q in live[cosine[live] >= worth]:
        at = bucket.reach(qx[q], unit[q], float(cosine[q]) * (1 - SLACK), float(need[q]) * (1 - SLACK))
        at = at[found.u[at] != queries.u[q]]
        scores = pv[at] @ qv[q]
        enough = scores >= at_least[q]
        if enough.any():
            take(q, at[enough], scores[enough])
    whole = live[cosine[live] < worth]
    prefix = np.searchsorted(-found.norm, -need[whole] * (1 - SLACK), "right") if len(whole) else whole
    prefix = np.where(np.isneginf(need[whole]), len(found.norm), prefix)
    whole, prefix = whole[np.argsort(prefix, kind="stable")], np.sort(prefix, kind="stable")
    for at in range(0, len(whole), 256):
        part, n = whole[at : at + 256], int(prefix[at : at + 256].max(initial=0))
        if not n:
            continue
        scores = qv[part] @ pv[:n].T
        fits = scores >= at_least[part][:, None]
        for i, q in enumerate(part):
            mine = own.get(int(queries.u[q]), n)
            if mine < n:
                fits[i, mine] = False
        if n > k:
            kth = np.partition(np.where(fits, scores, -(2.0**63)) if plain else np.where(fits, scores, -(2**63)), n - k, axis=1)[:, n - k]
            fits &= scores >= kth[:, None]
        for i in np.flatnonzero(fits.any(1)):
            hit = np.flatnonzero(fits[i])
            take(part[i], hit, scores[i, hit])
    return out


def _search(pairs: DataFrame, k: int) -> DataFrame:
    """The best of each pair of a query block and a bucket: pairs has their columns with the prefixes q_ and b_."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                sides = [_Side({c: row[f"{s}_{c}"] for c in ("u", "ids", "x", "width", "least")}) for s in "qb"]
                if got := best_of(*sides, k):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*got)], names=["query_u", "query_id", "vec_id", "score"])

    return pairs.select(*[f"{s}_{c}" for s in "qb" for c in ("u", "ids", "x", "width", "least")]).mapInArrow(run, _FOUND)


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_u").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, queries, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding", bucket: int = BUCKET, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest integer inner products of each row of df that the condition
    `queries` names with all other rows of df, ties to the smaller vec_id. Vectors are taken as floor(256 * entry).

    Rows are grouped by length, a bucket for each factor of RATIO; a length that many rows share is dealt into several buckets by
    a hash, so none is much over `bucket` rows. Queries are packed in blocks and meet the buckets block by block. The first
    round takes the buckets of the longest vectors; its k-th score of a query is the threshold of the second round, in which a
    bucket is left out if even a parallel vector of its greatest length can't reach the threshold of any query of a block. Within
    a bucket the local cosine threshold decides: above the bucket's own limit, vectors are looked up by the coordinates in
    which the query is largest; below it, all that are long enough are multiplied. Every score is verified in whole numbers.

    Vectors that are null or hold null or non-finite entries take no part; shorter vectors count as filled up with zeros, an
    empty one has score 0 with all. Each row is a vector of its own: repeated rows are hits of each other, a row with a null id
    is a hit that comes last among ties, and a query by rows of the same id is answered for each row. Fewer than k other rows
    give fewer results; an empty table gives none. Other columns are left out. Scores beyond 64 bits are an error.
    """
    spark = df.sparkSession
    small_batches(spark)
    asked = F.expr(queries) if isinstance(queries, str) else queries
    base = vectors.table(df.withColumn("__asked", F.coalesce(asked, F.lit(False))).select(F.col(vec_id).cast("long").alias("id"), "__asked", F.col(vector).alias("v")), "v")
    rows = stage(base.withColumns({"u": F.monotonically_increasing_id(), "norm": F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))}), "topk-rows")
    length = F.when(F.col("norm") > 0, F.floor(F.log("norm") / math.log(RATIO))).otherwise(F.lit(-1)).cast("int")
    # One number for each length class, at most some thousand: doubles have no more powers of RATIO.
    sizes = {r.c: r.n for r in rows.groupBy(length.alias("c")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    base_no, parts = {}, {}
    for c in sorted(sizes, reverse=True):
        base_no[c], parts[c] = sum(parts.values()), -(-sizes[c] // bucket)
    table = lambda d: F.create_map(*[F.lit(x) for pair in d.items() for x in pair])
    number = (table(base_no)[length] + F.pmod(F.xxhash64("u"), table(parts)[length])).cast("long")
    columns = ["rows", "longest", "u", "ids", "x", "width", "least"]
    unset = F.lit(float("-inf"))
    buckets = stage(rows.withColumns({"b": number, "least": unset}).select("b", "u", "id", "x", "norm", "least").groupBy("b").applyInArrow(_pack("b"), _PACKED.format(key="b")), "topk-buckets")
    blocks = max(1, -(-rows.where("__asked").count() // block))
    asked_rows = rows.where("__asked").select(F.pmod(F.xxhash64("u"), F.lit(blocks)).alias("q"), "u", "id", "x", "norm")
    side = lambda t, s: t.select(s, *[F.col(c).alias(f"{s}_{c}") for c in columns])

    def packed(least: DataFrame | None) -> DataFrame:
        t = asked_rows.withColumn("least", unset) if least is None else asked_rows.join(least, "u", "left").withColumn("least", F.coalesce("least", unset))
        return stage(t.select("q", "u", "id", "x", "norm", "least").groupBy("q").applyInArrow(_pack("q"), _PACKED.format(key="q")), "topk-queries")

    seeds = buckets.select("b", "longest").orderBy(F.col("longest").desc(), "b").limit(SEEDS)
    first, every = packed(None), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    pairs = seeds.select("b", every.alias("q"))
    met = pairs.join(side(buckets, "b"), "b").join(side(first, "q"), "q")
    begun = stage(_top(_search(met, k), k).drop("rank"), "topk-first", few=True)
    least = begun.groupBy("query_u").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).select(F.col("query_u").alias("u"), F.col("least").cast("double"))
    second = packed(least)
    # The shortest vector that could reach a threshold of the block.
    reach = rows.where("__asked").select(F.pmod(F.xxhash64("u"), F.lit(blocks)).alias("q"), "u", "norm").join(least, "u", "left").groupBy("q").agg(F.min(F.when(F.col("least") > 0, F.col("least") / F.nullif("norm", F.lit(0.0))).otherwise(F.lit(0.0))).alias("reach"))
    rest = buckets.select("b", "longest").join(seeds.select("b"), "b", "left_anti").select("b", "longest", every.alias("q"))
    rest = rest.join(reach, "q").where(F.col("longest") >= F.col("reach") * (1 - SLACK)).select("b", "q")
    met = rest.join(side(buckets, "b"), "b").join(side(second, "q"), "q")
    return _top(begun.unionByName(_search(met, k)), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def op12_norm_buckets(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all `embeddings` for each row whose vec_id is divisible by 50."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id % 50 = 0")
