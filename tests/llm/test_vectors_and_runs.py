"""Whitening, exact top-k and periodic runs against brute force, with nulls, empty values, ties, repeats and clashing names."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterline.llm import common, neardup, runs, tokens, topk, whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute_vectors(rows):
    return [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(300, 12)) * np.linspace(1, 3, 12)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(i, rows[7][1]) for i in range(300, 420)]  # one vector over and over
    rows += [(420, None), (421, [None] + [0.5] * 11), (422, [float("nan")] + [0.5] * 11), (423, [float("inf")] + [0.5] * 11), (424, [-0.0] * 12), (425, []), (426, [0.25] * 5), (None, [0.5] * 12), (7, rows[7][1])]
    return rows


# ---- 11 ----

def test_jacobi_equals_a_library_svd():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 16, 33):
        r = np.linalg.qr(rng.normal(size=(4 * d, d)) * 10.0 ** -np.arange(d), mode="r")
        sizes, v = whitening.jacobi(r)
        u, s, vt = np.linalg.svd(r)
        assert np.allclose(sizes, s, rtol=1e-6, atol=1e-15 * s[0])
        assert np.allclose(np.abs((v * vt.T).sum(0))[: min(d, 6)], 1, atol=1e-6)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-12)
    graded = np.diag([1.0, 1e-9]) @ np.array([[1.0, 1.0], [0.0, 1.0]])  # the small value keeps its relative accuracy
    assert whitening.jacobi(graded)[0][1] == pytest.approx(1e-9 / whitening.jacobi(graded)[0][0], rel=1e-9)


def test_every_pair_meets_once():
    for d in range(1, 12):
        met = [(int(a), int(b)) for p, q in whitening.rounds_of_pairs(d) for a, b in zip(p, q)]
        assert sorted(met) == [(a, b) for a in range(d) for b in range(a + 1, d)]


def test_whitening_equals_an_eigenvalue_solver(spark, odd_vectors, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)  # triangles are merged in rounds
    monkeypatch.setattr(whitening, "stage", lambda df, name, few=False: common.stage(df.repartition(9) if few else df, name))
    df = spark.createDataFrame(odd_vectors, SCHEMA).repartition(7).withColumns({"n": F.lit("clash"), "X": F.lit(1), "deviation": F.lit(None).cast("string"), "block": F.lit(3)})
    got = whitening.whiten(df).collect()
    rows = [(i, x + [0] * (12 - len(x))) for i, x in brute_vectors(odd_vectors)]
    fit = np.array([[*x] + [0] * (12 - len(x)) for x in {tuple(x) for _, x in brute_vectors(odd_vectors)}])
    n, sums = len(fit), fit.sum(0)
    e, vectors = np.linalg.eigh((fit - sums / n).T @ (fit - sums / n) / n)
    assert len(got) == 4 * len(rows) and {r.component for r in got} == {1, 2, 3, 4} and "block" in df.columns
    white = lambda x, c: float((np.array(x) - sums / n) @ vectors[:, -c] / e[-c] ** 0.5)
    key = lambda t: (t[0] is None, t[0] or 0)
    for c in (1, 2, 3, 4):
        mine = sorted(((r.vec_id, r.whitened, r.deviation) for r in got if r.component == c), key=lambda t: (*key(t), t[1]))
        want = sorted(((i, white(x, c), sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums))) for i, x in rows), key=key)
        sign = np.sign(max(mine, key=lambda t: abs(t[1]))[1] * dict((i, w) for i, w, _ in want)[max(mine, key=lambda t: abs(t[1]))[0]])
        want = sorted([(i, sign * w, d) for i, w, d in want], key=lambda t: (*key(t), t[1]))
        assert [(i, d) for i, _, d in mine] == [(i, d) for i, _, d in want]
        assert np.allclose([w for _, w, _ in mine], [w for _, w, _ in want], atol=1e-9)
        assert {round(r.explained / (e[-c] / e.sum()), 9) for r in got if r.component == c} == {1.0}
    assert {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-10


def test_whitening_of_tables_without_directions(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, None), (2, []), (3, [])], SCHEMA)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, SCHEMA)).count() == 0
    line = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(6)], SCHEMA)).collect()
    assert {r.component for r in line} == {1} and {round(r.explained, 12) for r in line} == {1.0} and len(line) == 6
    with pytest.raises(Exception, match="64 bits"):
        whitening.whiten(spark.createDataFrame([(1, [1e15]), (2, [2e15]), (3, [3e16])], SCHEMA)).collect()


# ---- 12 ----

def brute_top(rows, asked, k):
    v = brute_vectors(rows)
    out = []
    for a, (i, x) in enumerate(v):
        if i is not None and asked(i):
            hits = sorted((-sum(p * q for p, q in zip(x, y)), j is None, j or 0) for b, (j, y) in enumerate(v) if a != b)[:k]
            out += [(i, rank, None if no else j, -s) for rank, (s, no, j) in enumerate(hits, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("bucket, block", [(2048, 1024), (16, 8)])
def test_top_k_equals_all_products(spark, odd_vectors, bucket, block):
    df = spark.createDataFrame(odd_vectors, SCHEMA).withColumns({"u": F.lit("clash"), "norm": F.lit(1), "x": F.lit(2), "q": F.lit(3)})
    got = sorted([tuple(r) for r in topk.top_k(df, "vec_id % 7 = 0", k=5, bucket=bucket, block=block).collect()], key=str)
    assert got == brute_top(odd_vectors, lambda i: i % 7 == 0, 5)


def test_top_k_where_lookups_prune(spark, monkeypatch):
    """Close groups: high thresholds, so that vectors are looked up by coordinate; counted."""
    used = []
    real = topk.Bucket.reach
    monkeypatch.setattr(topk.Bucket, "reach", lambda self, *a: used.append(len(self.norm)) or real(self, *a))
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 8))
    centres *= 10 / np.linalg.norm(centres, axis=1)[:, None]
    rows = [(i, [float(np.float32(c)) for c in centres[i % 60] * rng.uniform(0.95, 1) + rng.normal(size=8) * 0.01]) for i in range(1500)]
    v = brute_vectors(rows)
    x = np.array(sorted((y for _, y in v), key=lambda y: -sum(c * c for c in y)))  # a bucket lies longest first
    scores = x @ x.T
    np.fill_diagonal(scores, -(2**60))
    side = lambda least: topk._Side({"u": np.arange(1500).tobytes(), "x": x.tobytes(), "width": 8, "ids": list(range(1500)), "least": least.tobytes()})
    least = np.sort(scores, axis=1)[:, -3].astype(float)
    got = topk.best_of(side(least), side(least), 3)
    want = [(q, q, int(c), int(scores[q, c])) for q in range(1500) for c in sorted(np.flatnonzero(scores[q] >= least[q]), key=lambda c: (-scores[q, c], c))[:3]]
    assert sorted(got) == sorted(want) and len(used) > 100


def test_top_k_of_few_and_large_values(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0]), (2, None)], SCHEMA)
    assert [tuple(r) for r in topk.top_k(few, "vec_id % 50 = 0").collect()] == [(0, 1, 1, 256 * 768)]
    assert topk.top_k(spark.createDataFrame([], SCHEMA), "vec_id % 50 = 0").count() == 0
    assert topk.top_k(few, "vec_id > 10").count() == 0
    wide = [(i, [float(2**20 + i), float(-(2**19) - 3 * i)]) for i in range(40)]
    got = sorted([tuple(r) for r in topk.top_k(spark.createDataFrame(wide, SCHEMA), "vec_id % 10 = 0", bucket=4).collect()], key=str)
    assert got == brute_top(wide, lambda i: i % 10 == 0, 5)
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], SCHEMA), "vec_id = 0").collect()


# ---- 13 ----

def brute_runs(w, times=4, least=6):
    seen, n = {}, len(w)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, times * q):
                seen.setdefault((start, i + q), q)
            i += 1
    return sorted(((a, b - a, q) for (a, b), q in seen.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_a_test_of_all_periods():
    rng = random.Random(4)
    for _ in range(4000):
        w = [rng.randrange(rng.choice([1, 2, 2, 3, 5])) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            if len(w) > 4:
                a, p = rng.randrange(len(w)), rng.randint(1, 7)
                for i in range(a + p, min(len(w), a + p + rng.randint(1, 40))):
                    w[i] = w[i - p]
        w = w * rng.randint(1, 5) if rng.random() < 0.3 else w
        assert runs.runs_of(w) == brute_runs(w), w
        assert [(a, b - a, p) for a, b, p in runs.periodic_runs(w)] == brute_runs(w), w


def test_factors_are_the_longest_earlier_words():
    rng = random.Random(9)
    for _ in range(500):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))]
        at = 0
        for start, end, source in runs.factors(w):
            assert start == at
            longest = max((k for k in range(1, len(w) - start + 1) if any(w[s : s + k] == w[start : start + k] for s in range(start))), default=0)
            assert end - start == max(1, longest) and (source == -1 if not longest else w[source : source + longest] == w[start:end] and source < start)
            at = end
        assert at == len(w)


def plain(doc, text):
    words = [x for x in (text or "").encode().split()]
    n, h = len(words), zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10 == 0 and n > 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    gone = {i for s, k, q in found for i in range(s + q, s + k)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (len(found), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_documents(spark):
    rng = random.Random(6)
    texts = [None, "", " \t\n", "one", "a " * 5, "a " * 6, "a b " * 4, "x y " * 9, "Ünï 😀 " * 30, " ".join(f"w{i % 50}" for i in range(9000)), "a a a a a a b b b b b b " * 4]
    texts += [" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 200))) for _ in range(150)]
    texts += [texts[9]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"runs": F.lit("clash"), "start": F.lit(1)})
    got = {r.doc_id: tuple(r)[1:] for r in runs.digest(runs.find_runs(df, plant="doc_id")).collect()}
    assert got == {i: plain(i, t) for i, t in enumerate(texts)}
    assert runs.find_runs(df.limit(0)).count() == 0
    alone = runs.find_runs(df, plant=None).where("doc_id = 6").first()
    assert alone.runs == [(0, 8, 2)] and bytes(alone.collapsed) == b"a b" and alone.start == 1
    assert runs.find_runs(df.withColumn("doc_id", F.lit(None).cast("long")), plant="doc_id").where("size(runs) > 0").count() > 3


# ---- 2, its last round ----

def test_a_component_is_not_compared_with_itself(spark):
    """A bucket of 20,000 linked members and two strangers: pairs with a stranger alone are made, each once, in parts."""
    n = 20_000
    named = spark.range(n + 2).select(F.lit(0).alias("no"), F.lit(9).cast("long").alias("band"), F.lit(n + 2).cast("long").alias("size"), F.col("id").alias("node"), F.greatest(F.col("id") - n + 1, F.lit(0)).alias("label"))
    alone = spark.range(3).select(F.lit(0).alias("no"), F.lit(8).cast("long").alias("band"), F.lit(3).cast("long").alias("size"), F.col("id").alias("node"), F.lit(5).cast("long").alias("label"))
    empty = F.array().cast("array<bigint>")
    classes = spark.range(n + 2).select(F.col("id").alias("node"), F.lit(1).alias("n"), empty.alias("bands"), empty.alias("sketch"), empty.alias("parity"))
    rows = neardup.open_rows(named.unionByName(alone), classes, None).persist()
    assert rows.count() == n + 2 and rows.where("chosen").count() == 2
    o, c = neardup.dealt(rows)
    met = o.join(c, ["band", "part_a", "part_b"]).select("node_a", "node_b").persist()
    assert o.count() == n + 2 and met.count() == 2 * (n + 2) and met.distinct().count() == 2 * (n + 2)
    few, centres = neardup.dealt(neardup.open_rows(named, classes, 16).persist())
    assert few.count() == n + 2 and few.join(centres, ["band", "part_a", "part_b"]).count() == (n + 2) * centres.select("node_b").distinct().count()


# ---- 3, its frequent pre-tokens ----

def test_sketches_are_merged_in_rounds(spark, monkeypatch):
    """One row a task leaves the texts; the merged table holds the most frequent pre-tokens with the library's counts."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "FAN_IN", 2)
    made = []
    monkeypatch.setattr(tokens, "stage", lambda df, name: made.append((name, df)) or common.stage(df, name))
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    texts = [f"often word{name(i % 5)} sometimes{name(i % 40)} rare{name(i)}" for i in range(400)] + [None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(9)
    table = tokens.frequent_lengths(df, "text", tokens.vocabulary_path(), entries=46)
    assert {"often"} | {f"word{name(i)}" for i in range(5)} <= {w.strip() for w in table}
    t = Tokenizer.from_file(tokens.vocabulary_path())
    assert all(n == len(t.encode(w, add_special_tokens=False).ids) for w, n in table.items())
    assert len(made) > 2 and made[0][1].count() <= 9 and len(table) <= 46
