"""Whitening by a one-sided Jacobi singular value decomposition of a triangle that blockwise TSQR leaves of the centred rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectors
from .common import append_columns, small_batches, stage

#: Triangles merged by one task; the last so many meet in the driver, each as large as the dimension squared.
FAN_IN = 16
#: A component whose deviation is at most this share of the largest is rounding, not a direction of the data.
RANK = 1e-12


def rounds_of_pairs(d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A tournament: each column meets each other once, all pairs of a round are disjoint."""
    n = d + d % 2
    ring, out = list(range(1, n)), []
    for _ in range(n - 1):
        seats = [0, *ring]
        pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[: n // 2], reversed(seats[n // 2 :])) if max(a, b) < d]
        if pairs:
            out.append(tuple(np.array(x) for x in zip(*pairs)))
        ring = ring[-1:] + ring[:-1]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values, falling, and right singular vectors (as columns) of r.

    Plane rotations make the columns of r orthogonal; the product of the rotations holds the vectors, the columns' lengths are
    the values. Each column is rotated until no pair's cosine exceeds rounding, so small values keep their relative accuracy.
    """
    d = r.shape[1]
    order = np.argsort(-np.linalg.norm(r, axis=0), kind="stable")
    u, v = r[:, order].astype(float), np.eye(d)[:, order]
    small = np.finfo(float).eps * max(4.0, d**0.5)
    for _ in range(sweeps):
        turned = False
        for p, q in rounds_of_pairs(d):
            a, b = u[:, p], u[:, q]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            turn = np.abs(ab) > small * np.sqrt(aa * bb)
            if not turn.any():
                continue
            turned = True
            p, q, aa, bb, ab = p[turn], q[turn], aa[turn], bb[turn], ab[turn]
            z = (bb - aa) / (2 * ab)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z))
            c = 1 / np.hypot(1.0, t)
            s = c * t
            for m in (u, v):
                m[:, p], m[:, q] = c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]
        if not turned:
            break
    sizes = np.linalg.norm(u, axis=0)
    order = np.argsort(-sizes, kind="stable")
    return sizes[order], v[:, order] / np.linalg.norm(v[:, order], axis=0)


def triangle(rows: np.ndarray) -> np.ndarray:
    return np.linalg.qr(rows, mode="r")


def _off(m: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n * m - sums in whole numbers; an error where that doesn't fit 64 bits."""
    if n * float(np.abs(m).max(initial=0)) + float(np.abs(sums).max(initial=0)) >= 2.0**62:
        raise OverflowError("n * x - S exceeds 64 bits")
    return n * m - sums


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors of d entries with sums S; components as columns, with their deviations, and the whole variance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    deviations: np.ndarray
    variance: float

    def apply(self, df: DataFrame, x: str = "x") -> DataFrame:
        """df with `deviation` (sum of (n * x - S)^2, exact; an error if it exceeds a long) and `whitened`, an entry for each
        component. Columns of df by these names are replaced."""
        n, sums, d = self.n, self.sums, len(self.sums)
        scaled = self.components / self.deviations / max(n, 1)

        def make():
            def run(columns: list[pa.Array]) -> list[pa.Array]:
                m = vectors.matrix(columns[0], d)
                off = _off(m, n, sums)
                if float((off.astype(float) ** 2).sum(1).max(initial=0)) >= 2.0**63 * (1 - 1e-9):
                    raise OverflowError("a deviation exceeds 64 bits")
                white = off.astype(float) @ scaled
                return [pa.array((off * off).sum(1)), pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * white.shape[1], white.reshape(-1))]

            return run

        return append_columns(df, [x], pa.schema([("deviation", pa.int64()), ("whitened", pa.list_(pa.float64()))]), "deviation bigint, whitened array<double>", make)


def fit(distinct: DataFrame, components: int = 4) -> Whitening:
    """The leading components of the vectors in column `x` (array<bigint>) of `distinct`, each counted as often as it is there.

    Sums are whole numbers. Each task then centres its rows and keeps one triangle; triangles are merged FAN_IN at a time. Only
    sums and the last triangles, whose sizes follow the dimension, reach the driver. Vectors shorter than the longest count as filled up with zeros; without rows, or with a single vector, there
    are no components.
    """
    small_batches(distinct.sparkSession)
    totals = distinct.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum("c").alias("s")).orderBy("i").collect()
    n, sums = distinct.count(), np.array([t.s for t in totals], np.int64)
    d = len(sums)
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0)
    if n < 2 or not d:
        return none

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, d))
        for b in batches:
            centred = _off(vectors.matrix(b.column(0), d), n, sums).astype(float) / n
            r = triangle(np.vstack([r, centred]))
        if len(r):
            yield pa.RecordBatch.from_pydict({"block": pa.array([TaskContext.get().partitionId()], pa.int64()), "r": [np.ascontiguousarray(r).tobytes()]})

    def merge(group: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        r = triangle(np.vstack([np.frombuffer(x).reshape(-1, d) for x in t.column("r").to_pylist()]))
        return pa.table({"block": pa.array([group[0].as_py()], pa.int64()), "r": [np.ascontiguousarray(r).tobytes()]})

    parts = stage(distinct.mapInArrow(blocks, "block bigint, r binary"), "whitening-triangles")
    while parts.count() > FAN_IN:
        parts = stage(parts.groupBy(F.floor(F.col("block") / FAN_IN).alias("group")).applyInArrow(merge, "block bigint, r binary"), "whitening-triangles")
    r = triangle(np.vstack([np.frombuffer(p.r).reshape(-1, d) for p in parts.orderBy("block").collect()]))
    sizes, v = jacobi(r)
    real = min(components, int((sizes > RANK * sizes[0]).sum())) if sizes[0] > 0 else 0
    v = v * np.where(v[np.abs(v).argmax(0), np.arange(v.shape[1])] < 0, -1.0, 1.0)  # the largest entry is positive
    return Whitening(n, sums, v[:, :real], sizes[:real] / n**0.5, float((sizes**2).sum() / n))


def identity_error(model: Whitening, distinct: DataFrame) -> float:
    """The largest absolute entry of the whitened vectors' covariance (divisor n) minus the identity; 0 without components."""
    k = len(model.deviations)
    if not k:
        return 0.0
    white = model.apply(distinct)
    w = [F.col("whitened")[i] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = white.agg(*[F.sum(c) for c in w], *[F.sum(w[i] * w[j]) for i, j in pairs]).first()
    mean = [got[i] / model.n for i in range(k)]
    return max(abs(got[k + at] / model.n - mean[i] * mean[j] - (i == j)) for at, (i, j) in enumerate(pairs))


def whiten(df: DataFrame, vector: str = "embedding", components: int = 4) -> DataFrame:
    """A row for each usable row of df and component: all other columns, `component`, `n`, `deviation`, `whitened`, `explained`,
    `identity_error`. Columns of df by these names, and `x`, are replaced.

    The fit takes each distinct vector once: equal ones meet in one exchange after each task has dropped its own repeats, so a
    vector that makes up a third of all rows is a row a task; vectors of different lengths are different. Rows whose vector is null, or holds null or non-finite entries, are left out; repeated rows are each returned, but count
    once in the fit; of equal eigenvalues the order is that of the decomposition. A component without deviation (fewer distinct
    directions than asked for) can't be whitened and is left out, so an empty table, or one of a single vector, gives no rows.
    """
    rows = vectors.table(df, vector)
    distinct = stage(rows.select("x").distinct(), "whitening-rows", few=True)
    model = fit(distinct, components)
    error = identity_error(model, distinct)
    out = model.apply(rows)
    shares = [float(s**2 / model.variance) for s in model.deviations]
    made = ("component", "n", "deviation", "whitened", "explained", "identity_error", "x")
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (*made, vector.lower())]
    part = F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), F.array(*map(F.lit, shares)).cast("array<double>").alias("e"))).alias("at", "part")
    return out.select(*kept, "deviation", part).select(
        *kept, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("part.w").alias("whitened"), F.col("part.e").alias("explained"), F.lit(error).alias("identity_error"),
    )


def op11_jacobi_whitening(spark, sf_dir: str) -> DataFrame:
    """Four components of all `embeddings`."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")
