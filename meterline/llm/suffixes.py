"""Exact removal of repeated byte strings by bucket-pointer refinement over sampled suffixes.

Suffixes are bucketed by a q-gram that every window of `length` bytes chooses from its own content (its smallest q-gram
hash), so equal windows, wherever they are, lie in the same bucket at the same distance from its q-gram. A bucket whose
members agree on all their windows needs no more work. In the others the members' surroundings are refined: the bucket
identifier of a longer stretch comes from sorting pairs of an identifier that is already known and the bytes, or the
identifier, at the next offset; identifiers are reused by every longer stretch, and members alone in their bucket drop out.
Large buckets are refined the same way by Spark, a round for each halving of the windows' range, until a task can hold the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import mix
from .common import documents, pieces, small_batches, stage, without

#: Bytes of the q-gram that names a bucket.
Q = 32
#: Window starts that are handled at once; a longer text goes in parts.
PART = 1 << 18
#: A bucket of more distinct members is first refined by Spark in rounds, until its parts are smaller.
GATHER = 8_000
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_BASE = 0x9FB21C651E98DF25
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Tables:
    """Powers that turn prefix sums into hashes of any stretch, made once for a worker."""

    def __init__(self):
        self.n = 0

    def get(self, n: int):
        if n > self.n:
            self.n = max(n, PART + 65536)
            self.up, self.down = _powers(_BASE, self.n), _powers(pow(_BASE, -1, 1 << 64), self.n)
        return self.up[:n], self.down[:n]


_TABLES = _Tables()


def _eights(buf: np.ndarray, n: int) -> np.ndarray:
    return mix(np.lib.stride_tricks.as_strided(buf[:8].view(np.uint64), (n,), (1,)))


def anchors(parts: list[bytes], length: int) -> tuple[np.ndarray, ...] | None:
    """(part, q-gram hash, hash of all bytes that its windows cover, first start, last start, q-gram's place) of each bucket
    member: a maximal run of window starts that choose the same q-gram. Places are in bytes of the part."""
    size = np.array([len(p) for p in parts], np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    n, w = int(first[-1]), length - Q + 1
    inside = np.zeros(n + 1, np.int32)
    long = size >= length
    if not long.any():
        return None
    inside[first[:-1][long]] += 1
    inside[first[1:][long] - length + 1] -= 1
    s = np.flatnonzero(np.cumsum(inside[:n]) > 0)
    buf = np.frombuffer(b"".join(parts) + bytes(64), np.uint8)
    h8 = _eights(buf, n + Q)
    gram = sum((h8[8 * j : 8 * j + n] * _C[j] for j in range(Q // 8)), np.zeros(n, np.uint64))
    gram = mix(gram)
    key = (gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(n, dtype=np.uint64)  # ties: the leftmost
    blocks = np.concatenate([key, np.full(-n % w + w, _ALL)]).reshape(-1, w)
    least = np.minimum(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n], np.minimum.accumulate(blocks, axis=1).ravel()[w - 1 : w - 1 + n])
    chosen = (least[s] & np.uint64(0xFFFFFF)).astype(np.int64)
    cut = np.flatnonzero((chosen[1:] != chosen[:-1]) | (s[1:] != s[:-1] + 1)) + 1
    lo, hi, at = s[np.concatenate([[0], cut])], s[np.concatenate([cut - 1, [len(s) - 1]])], chosen[np.concatenate([[0], cut])]
    up, down = _TABLES.get(n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h8[:n] * up[:n], dtype=np.uint64)])
    shape = (at - lo).astype(np.uint64) << np.uint64(40) | (hi - lo).astype(np.uint64) << np.uint64(52)
    around = mix((sums[hi + length - 7] - sums[lo]) * down[lo] + shape)
    part = np.searchsorted(first, lo, side="right") - 1
    base = first[part]
    return part, gram[at], around, lo - base, hi - base, at - base


def _members(docs: DataFrame, length: int) -> DataFrame:
    """Rows (k1, k2, gram, around, places): a document's members of a bucket that cover equal bytes are one row.

    A place packs first start << 16 | distance of the q-gram << 8 | further starts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            held: list[tuple[int, int, bytes]] = []
            size = 0

            def flush():
                found = anchors([h[2] for h in held], length)
                if found is None:
                    return None
                part, gram, around, lo, hi, at = found
                row, base = np.array([h[0] for h in held])[part], np.array([h[1] for h in held], np.int64)[part]
                place = (lo + base) << 16 | (at - lo) << 8 | (hi - lo)
                order = np.lexsort((place, around, gram, row))
                row, gram, around, place = row[order], gram[order], around[order], place[order]
                new = np.concatenate([[True], (row[1:] != row[:-1]) | (gram[1:] != gram[:-1]) | (around[1:] != around[:-1])])
                head = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(np.concatenate([head, [len(row)]]).astype(np.int32), place)
                return pa.RecordBatch.from_arrays([pa.array(k1[row[head]]), pa.array(k2[row[head]]), pa.array(gram[head].view(np.int64)), pa.array(around[head].view(np.int64)), lists], names=["k1", "k2", "gram", "around", "places"])

            for i, t in enumerate(batch.column(2).to_pylist()):
                raw = t.encode("utf-8", "surrogatepass")
                for start in range(0, max(1, len(raw) - length + 1), PART):
                    piece = raw[start : start + PART + length - 1]
                    if len(piece) < length:
                        continue
                    held.append((i, start, piece))
                    size += len(piece)
                    if size >= PART:
                        if (out := flush()) is not None:
                            yield out
                        held, size = [], 0
            if held and (out := flush()) is not None:
                yield out

    return docs.select("k1", "k2", "text").mapInArrow(run, "k1 bigint, k2 int, gram bigint, around bigint, places array<bigint>")


def _packed(docs: DataFrame) -> DataFrame:
    """docs with `packed`, the text's compressed bytes, in place of the text: what crosses the network."""
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for b in pieces(batch, ["text"]):
                packed = pa.array([z.compress((t or "").encode("utf-8", "surrogatepass")) for t in b.column("text").to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in others), packed], names=[*others, "packed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in others]).schema)
    return docs.mapInArrow(run, f"{kinds}, packed binary")


def _surroundings(rows: DataFrame, length: int) -> DataFrame:
    """(gram, k1, k2, place, n, bytes) from (k1, k2, packed, wanted): the bytes that the wanted members' windows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for k1, k2, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("k1", "k2", "packed", "wanted"))):
                raw = z.decompress(packed)
                for x in wanted:
                    lo, more = x["place"] >> 16, x["place"] & 255
                    out.append((x["gram"], k1, k2, x["place"], x["n"], x["size"], raw[lo : lo + more + length]))
                    held += length
                if held > 1 << 20:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return rows.mapInArrow(run, "gram bigint, k1 bigint, k2 int, place bigint, n bigint, size bigint, bytes binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], names=["gram", "k1", "k2", "place", "n", "size", "bytes"])


def _refine(known: np.ndarray, alive: np.ndarray, then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket identifiers of longer stretches: members sorted by (identifier so far, what follows). Members that are alone
    drop out: no longer stretch of theirs can be shared."""
    order = np.lexsort((then, known))
    a, b = known[order], then[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    name = (np.cumsum(new) - 1).astype(np.int32)
    several = np.bincount(name)[name] > 1
    kept = order[several]
    return name[several], alive[kept]


def shared_windows(group: np.ndarray, dist: np.ndarray, more: np.ndarray, texts: list[bytes], length: int) -> np.ndarray:
    """(members, starts) flags: the window that starts `d` bytes before the q-gram is also in another member of the group.

    A member's windows start `dist` to `dist - more` bytes before its q-gram. `back[d]` and `on[j]` are bucket identifiers of
    the d bytes before the q-gram and the j bytes from it; each is refined from the one a byte shorter, and a window's bucket
    from the pair that makes it up.
    """
    n, w = len(group), length - Q + 1
    table = np.zeros((n, w + length), np.uint8)
    for i, t in enumerate(texts):
        table[i, w - dist[i] : w - dist[i] + len(t)] = np.frombuffer(t, np.uint8)
    ahead = length + more - dist  # bytes from the q-gram on that some window covers
    flags = np.zeros((n, w), bool)
    back: list[tuple[np.ndarray, np.ndarray]] = [(group.astype(np.int32), np.arange(n, dtype=np.int32))]
    for d in range(1, w):
        known, alive = back[-1]
        keep = dist[alive] >= d
        known, alive = known[keep], alive[keep]
        back.append(_refine(known, alive, table[alive, w - d]) if len(alive) else (known, alive))
    known, alive = back[0]
    on = {}
    for j in range(8, Q + 1, 8):  # all members reach past the q-gram
        words = np.ascontiguousarray(table[alive, w + j - 8 : w + j]).view(np.uint64)[:, 0]
        known, alive = _refine(known, alive, words)
    on[Q] = known, alive
    for j in range(Q + 1, length + 1):
        known, alive = on[j - 1]
        keep = ahead[alive] >= j
        known, alive = known[keep], alive[keep]
        on[j] = _refine(known, alive, table[alive, w + j - 1]) if len(alive) else (known, alive)
    name = np.empty(n, np.int64)
    for d in range(w):
        (k0, a0), (k1, a1) = back[d], on[length - d]
        if not len(a0) or not len(a1):
            continue
        name.fill(-1)
        name[a0] = k0
        both = a1[(name[a1] >= 0)]
        right = k1[name[a1] >= 0]
        fits = (dist[both] >= d) & (dist[both] - more[both] <= d)
        if fits.any():
            flags[_refine(name[both[fits]], both[fits], right[fits])[1], d] = True
    return flags


def _spans(flags: np.ndarray, at: int, length: int) -> list[int]:
    """Byte spans, packed start << 32 | end, of the flagged windows of a member whose q-gram is at `at`."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(at - b + 1) << 32 | (at - a + length) for a, b in edge.reshape(-1, 2).tolist()]


def _refined(members: DataFrame, length: int) -> DataFrame:
    """(k1, k2, span) for members (sorted by bucket within a partition) that cover bytes no other member covers as a whole."""

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        gram, k1, k2, place, n, texts = (list(x) for x in zip(*rows))
        place = np.array(place, np.int64)
        lo, dist, more = place >> 16, place >> 8 & 255, place & 255
        group = np.unique(np.array(gram), return_inverse=True)[1]
        flags = shared_windows(group, dist, more, texts, length)
        out = [(a, b, s) for i, (a, b) in enumerate(zip(k1, k2)) if n[i] == 1 for s in _spans(flags[i], int(lo[i] + dist[i]), length)]
        c = list(zip(*out)) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.int64())], names=["k1", "k2", "span"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for b in batches:
            rows += zip(*(b.column(c).to_pylist() for c in ("gram", "k1", "k2", "place", "n", "bytes")))
            if len(rows) >= 2048:
                last = rows[-1][0]
                at = len(rows)
                while at and rows[at - 1][0] == last:
                    at -= 1
                if at:  # the last bucket may go on in the next batch
                    yield solve(rows[:at])
                    rows = rows[at:]
        if rows:
            yield solve(rows)

    return members.mapInArrow(run, "k1 bigint, k2 int, span bigint")


def _halved(members: DataFrame, length: int, gather: int) -> tuple[DataFrame | None, DataFrame]:
    """Buckets of more than `gather` members in rounds: (members of buckets that are small by now, (k1, k2, span)).

    A bucket's windows start up to `length` - Q bytes before its q-gram. Each round halves that range of starts. All windows of a
    half cover one longer stretch around the q-gram, so the half's buckets are named by the bucket so far and that stretch.
    Members alone in theirs drop out; where all agree on every byte their windows cover, all are shared. A range of one start
    always ends so, hence rounds number at most the logarithm of `length`.
    """
    rows = members.select("gram", "k1", "k2", "place", "n", "bytes", F.lit(0).alias("d1"), F.lit(length - Q).alias("d2"))
    lo, dist, more = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(F.lit(255)).cast("int"), F.col("place").bitwiseAND(F.lit(255)).cast("int")
    mid = F.floor((F.col("d1") + F.col("d2")) / 2).cast("int")
    halves = F.array(F.struct(F.col("d1").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("d2").alias("b")))
    small, spans = None, None
    while True:
        cut = rows.select("gram", "k1", "k2", "n", "bytes", lo.alias("lo"), dist.alias("dist"), more.alias("more"), F.explode(halves).alias("r"))
        near, far = F.greatest(F.col("r.a"), F.col("dist") - F.col("more")), F.least(F.col("r.b"), F.col("dist"))
        cut = cut.withColumns({"near": near, "far": far}).where("near <= far")
        shared = F.expr(f"substring(bytes, dist - r.a + 1, {length} - r.b + r.a)")
        cut = cut.select(
            F.xxhash64("gram", "r.a", "r.b", shared).alias("gram"), "k1", "k2",
            (F.shiftleft(F.col("lo") + F.col("dist") - F.col("far"), 16) + F.shiftleft(F.col("far").cast("long"), 8) + F.col("far") - F.col("near")).alias("place"), "n",
            F.expr(f"substring(bytes, dist - far + 1, far - near + {length})").alias("bytes"), F.col("r.a").alias("d1"), F.col("r.b").alias("d2"),
        )
        cut = stage(cut.withColumn("all", F.xxhash64("bytes", F.col("place").bitwiseAND(F.lit(65535)))), "halves")
        sizes = cut.groupBy("gram").agg(F.count("*").alias("size"), (F.min("all") == F.max("all")).alias("same")).where("size > 1")
        named = stage(cut.join(sizes, "gram"), "half-buckets")
        whole = named.where("same and n = 1").select("k1", "k2", (F.shiftleft(lo, 32) + lo + more + length).alias("span"))
        few = named.where(~F.col("same") & (F.col("size") <= gather)).select("gram", "k1", "k2", "place", "n", "bytes")
        small, spans = (few, whole) if small is None else (small.unionByName(few), spans.unionByName(whole))
        rows = named.where(~F.col("same") & (F.col("size") > gather)).drop("all", "size", "same")
        if not rows.head(1):
            return small, spans


def remove_repeats(df: DataFrame, row_id: str = "doc_id", text: str = "text", length: int = 200, gather: int = GATHER) -> DataFrame:
    """df, its text replaced by `kept` (the bytes that stay), with `n_bytes`, `n_removed` and `n_spans`.

    A byte is removed if a string of `length` bytes that covers it starts anywhere else too, in this text or another; strings
    are judged on the input. Null and empty texts and those shorter than `length` lose nothing; a repeated row is a copy; an
    empty table stays empty; columns with an output's name are replaced. Bytes of a bucket are compared as such, equality of
    whole members by 64-bit hashes within a 64-bit bucket.
    """
    if not Q < length <= Q + 224:
        raise ValueError("length must lie between 33 and 256")
    spark = df.sparkSession
    small_batches(spark)
    others = [c for c in without(df, "kept", "n_bytes", "n_removed", "n_spans").columns if c != text]
    keyed = df.select(*[F.col(f"`{c}`").alias(f"__{c}") for c in others], F.coalesce(F.col(text), F.lit("")).alias("text"), F.xxhash64(F.col(row_id), F.col(text)).alias("k1"), F.hash(F.col(text), F.col(row_id)).alias("k2"))
    members = _members(keyed.where(F.octet_length("text") >= length), length)
    repeated = stage(members.groupBy("gram").agg(F.sum(F.size("places")).alias("n")).where("n > 1").select("gram"), "grams")
    again = stage(members.join(repeated, "gram"), "members")
    covers = stage(again.groupBy("gram", "around").agg(F.sum(F.size("places")).alias("n"), F.min(F.struct("k1", "k2", F.col("places")[0].alias("place"))).alias("one")), "covers")
    open_grams = stage(covers.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1"), "open-grams")
    wanted = covers.join(open_grams, "gram").select("one.*", "gram", "n", "size").groupBy("k1", "k2").agg(F.collect_list(F.struct("gram", "place", "n", "size")).alias("wanted"))
    packed = _packed(keyed.select("k1", "k2", "text"))
    around = _surroundings(packed.join(wanted, ["k1", "k2"]), length)
    large = bool(open_grams.where(F.col("size") > gather).head(1))
    if large:
        around = stage(around, "surroundings")
    gathered, spans = around.where(F.col("size") <= gather).select("gram", "k1", "k2", "place", "n", "bytes"), []
    if large:
        halved, whole = _halved(around.where(F.col("size") > gather), length, gather)
        gathered, spans = gathered.unionByName(halved), [whole]
    spans.append(_refined(gathered.repartition("gram").sortWithinPartitions("gram", "k1", "k2", "place"), length))
    # members that cover the same bytes as another: all their windows are shared
    several = covers.where("n > 1").select("gram", "around")
    whole = again.join(several, ["gram", "around"], "left_semi").select("k1", "k2", F.explode("places").alias("p"))
    start = F.shiftright("p", 16)
    spans.append(whole.select("k1", "k2", (F.shiftleft(start, 32) + start + F.col("p").bitwiseAND(F.lit(255)) + length).alias("span")))
    every = spans[0]
    for x in spans[1:]:
        every = every.unionByName(x)
    by_row = every.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))
    joined = _packed(keyed).join(by_row, ["k1", "k2"], "left").drop("k1", "k2")
    names = [f"__{c}" for c in others]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdDecompressor()
        for batch in batches:
            for b in pieces(batch, ["packed"], 1 << 20):
                kept, numbers = [], []
                for data, found in zip(b.column("packed").to_pylist(), b.column("spans").to_pylist()):
                    raw = z.decompress(data)
                    left, at, n = [], 0, 0
                    end = -1
                    for x in sorted(found or ()):
                        a, e = x >> 32, x & 0xFFFFFFFF
                        if a > end:
                            n += 1
                            left.append(raw[at:a])
                        end = at = max(end, e)
                    left.append(raw[at:])
                    kept.append(b"".join(left))
                    numbers.append((len(raw), len(raw) - len(kept[-1]), n))
                made = [pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in zip(*numbers))]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *made], names=[*others, "kept", "n_bytes", "n_removed", "n_spans"])

    kinds = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in others)
    return joined.mapInArrow(cut, f"{kinds}kept binary, n_bytes bigint, n_removed bigint, n_spans bigint")


def op1_bucket_pointer_refinement(spark, sf_dir: str) -> DataFrame:
    """Bytes of `documents` under repeated strings of 200 bytes."""
    out = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
