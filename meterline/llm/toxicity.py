"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bytewords import ALNUM, NOT_BLANK, Words, hash_words
from .common import append_columns, documents, stage, without

#: Labelled rows that are learned from, at most: a bounded sample by hash of the id.
TRAIN_ROWS = 20_000
#: Words that the learned lexicons hold, at most.
LEXICON = 2_000
#: Second person in the four languages of the corpus.
SECOND = "you your yours yourself du dein deine dich dir euch tu toi vous votre vos usted tú tus ustedes".split()
FEATURES = ["strong", "strong_n", "weak", "mild", "near_you", "caps", "shout", "marks", "odd", "inner", "digits", "repeats", "longest", "words"]


@dataclass
class Lexicon:
    """Words by how much oftener toxic documents hold them: strong, weak and mild."""

    strong: list[str]
    weak: list[str]
    mild: list[str]


def learn_lexicon(train: DataFrame, text: str = "text", label: str = "label", least: int = 4) -> Lexicon:
    """Words whose smoothed document frequency among toxic rows is over 30, 8 or 3 times that among others."""
    words = F.array_distinct(F.split(F.lower(F.translate(F.col(text), "\u0000", " ")), r"[^\p{L}\p{N}]+"))
    n = train.agg(F.sum(label).alias("bad"), F.count("*").alias("n")).first()
    bad, good = (n.bad or 0) + 1.0, (n.n - (n.bad or 0)) + 1.0
    seen = train.select(F.explode(words).alias("w"), F.col(label).alias("y")).where("w != ''").groupBy("w").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("q"))
    lift = ((F.col("p") + 0.5) / bad) / ((F.col("q") + 0.5) / good)
    top = seen.withColumn("lift", lift).where((F.col("p") >= least) & (F.col("lift") > 3)).orderBy(F.desc(F.col("p") * F.log("lift")), "w").limit(LEXICON).collect()
    tier = lambda a, b: sorted(r.w for r in top if a < r.lift <= b)
    # a strong word is also common: rare words of single toxic documents say little about others
    strong = sorted(r.w for r in top if r.lift > 30 and r.p >= max(6, 0.01 * bad))
    kept = set(strong)
    return Lexicon(strong, [w for w in tier(8, float("inf")) if w not in kept], tier(3, 8))


def with_features(df: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """df with the dense `features` (array<double>, in the order of FEATURES). Null and empty texts give zeros."""

    def make():
        lists = [np.sort(hash_words(x)) if x else np.zeros(0, np.uint64) for x in (lexicon.strong, lexicon.weak, lexicon.mild, SECOND)]
        member = lambda h, s: s[np.minimum(np.searchsorted(s, h), len(s) - 1)] == h if len(s) else np.zeros(len(h), bool)

        def run(columns):
            texts = columns[0].to_pylist()
            w, tokens = Words(texts, ALNUM), Words(texts, NOT_BLANK)

            def total(values, first):
                c = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
                return c[first[1:]] - c[first[:-1]]

            n = np.diff(w.first).astype(float)
            strong, weak, mild, you = (member(w.hash, s) for s in lists)
            at = np.flatnonzero(you)
            owner = np.searchsorted(w.first, np.arange(len(w.hash)), side="right") - 1
            near = np.zeros(len(w.hash), bool)
            for i in np.flatnonzero(strong | weak) if len(at) else []:
                j = np.searchsorted(at, i)
                near[i] = any(0 <= k < len(at) and abs(at[k] - i) <= 8 and owner[at[k]] == owner[i] for k in (j - 1, j))
            upper = (w.raw >= 65) & (w.raw <= 90)
            letter = upper | ((w.raw >= 97) & (w.raw <= 122)) | (w.raw >= 128)
            digit = (w.raw >= 48) & (w.raw <= 57)
            mark = (w.raw == 33) | (w.raw == 63)
            other = ~letter & ~digit & (w.raw > 32)
            same = np.concatenate([[False], (w.raw[1:] == w.raw[:-1]) & letter[1:]])
            same &= np.concatenate([[False], same[:-1]])
            bounds = np.concatenate([w.text_start])
            chars = np.maximum(1, np.diff(bounds) - 1).astype(float)
            count = lambda mask: total(mask, bounds)
            # obfuscation: digits or marks between the letters of one word
            c_letter, c_odd, c_digit, c_up = (np.concatenate([[0], np.cumsum(m)]) for m in (letter, other | digit, digit, upper))
            s, e = tokens.start, tokens.end
            inner = (e - s > 2) & letter[s] & letter[e - 1] & (c_odd[e] > c_odd[s]) if len(s) else np.zeros(0, bool)
            mixed = (c_digit[e] > c_digit[s]) & (c_letter[e] > c_letter[s])
            loud = (c_up[e] - c_up[s] >= 2) & (c_up[e] - c_up[s] == c_letter[e] - c_letter[s])
            t = np.maximum(1.0, np.diff(tokens.first))
            longest = np.zeros(len(texts))
            if len(s):
                held = np.flatnonzero(np.diff(tokens.first))
                longest[held] = np.maximum.reduceat(e - s, tokens.first[:-1][held])
            d = np.maximum(1.0, n)
            table = [total(strong, w.first) / d, total(strong, w.first), total(weak, w.first) / d, total(mild, w.first) / d, total(near, w.first), count(upper) / np.maximum(1, count(letter)), total(loud, tokens.first) / t, count(mark) / chars, count(other) / chars, total(inner, tokens.first) / t, total(mixed, tokens.first) / t, count(same) / chars, np.minimum(longest, 1000.0), np.log1p(n)]
            flat = np.stack(table, axis=1)
            return [pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32), flat.ravel())]

        return run

    return append_columns(df, [text], pa.schema([("features", pa.list_(pa.float64()))]), "features array<double>", make)


@dataclass
class Model:
    """Lexicons, trees and the calibration curve. `score` is monotone in the trees' probability."""

    lexicon: Lexicon
    trees: GBTClassificationModel | None
    bounds: list[float]
    values: list[float]
    base: float

    def score(self, df: DataFrame, text: str = "text", threshold: float = 0.3) -> DataFrame:
        """df with `score` (0 to 1) and `predicted` (1 where score >= threshold); columns of these names are replaced.

        Null and empty texts get the score of a text without any words. Without labelled rows all scores are `base`.
        """
        df = without(df, "score", "predicted")
        if self.trees is None:
            out = df.withColumn("score", F.lit(self.base))
        else:
            rows = with_features(df.withColumnsRenamed({c: f"__in_{i}" for i, c in enumerate(df.columns)}), self.lexicon, f"__in_{df.columns.index(text)}")
            out = _raw(self.trees, rows).withColumn("score", self._curve(F.col("__p"))).drop("__p").withColumnsRenamed({f"__in_{i}": c for i, c in enumerate(df.columns)})
        return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

    def _curve(self, p: Column) -> Column:
        """The isotonic fit, linear between its boundaries; a thousandth of the raw probability keeps ties in order."""
        b, v = self.bounds, self.values
        curve = F.lit(v[-1])
        for i in range(len(b) - 1, 0, -1):
            rise = v[i - 1] + (v[i] - v[i - 1]) * (p - b[i - 1]) / ((b[i] - b[i - 1]) or 1.0)
            curve = F.when(p < b[i], rise).otherwise(curve)
        curve = F.when(p <= b[0], F.lit(v[0])).otherwise(curve)
        return F.least(F.lit(1.0), F.greatest(F.lit(0.0), curve * 0.999 + p * 0.001))


def _raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    columns = {f"__f{i}": F.col("features")[i] for i in range(len(FEATURES))}
    wide = VectorAssembler(inputCols=list(columns), outputCol="__vector").transform(rows.withColumns(columns)).drop(*columns, "features")
    scored = trees.transform(wide)
    return scored.withColumn("__p", vector_to_array(F.col("probability"))[1]).drop("__vector", "rawPrediction", "probability", "__class")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from at most `train_rows` labelled rows whose crc32(doc_id) mod 4 isn't 2, sampled by a hash of the id.

    Rows of remainder 3 calibrate the trees; the others grow them and the lexicons. The sample's labels are broadcast: their
    number is bounded by `train_rows`. Null ids, labels or texts are not learned from.
    """
    chosen = labels.select(F.col(doc_id).alias("__id"), F.col(label).cast("int").alias("label")).where("__id is not null and label is not null").where(~held_out("__id"))
    chosen = chosen.groupBy("__id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("__id"), "__id").limit(train_rows)
    rows = stage(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("text")).where(F.col(text).isNotNull()).join(F.broadcast(chosen), "__id"), "toxic-rows", few=True)
    calibrate = F.crc32(F.col("__id").cast("string")) % 4 == 3
    stats = rows.agg(F.count("*").alias("n"), F.sum("label").alias("bad")).first()
    base = (stats.bad or 0) / stats.n if stats.n else 0.0
    if not stats.bad or stats.bad == stats.n:
        return Model(Lexicon([], [], []), None, [], [], base)
    lexicon = learn_lexicon(rows.where(~calibrate))
    table = stage(with_features(rows, lexicon).select("label", "features", calibrate.alias("calibrate")), "toxic-features", few=True)
    columns = {f"__f{i}": F.col("features")[i] for i in range(len(FEATURES))}
    train = VectorAssembler(inputCols=list(columns), outputCol="__vector").transform(table.where("not calibrate").withColumns(columns)).select("__vector", "label").repartition(4).cache()
    kinds = train.select("label").distinct().count()
    if kinds < 2:
        train.unpersist()
        return Model(lexicon, None, [], [], base)
    trees = GBTClassifier(featuresCol="__vector", labelCol="label", predictionCol="__class", maxIter=20, maxDepth=4, stepSize=0.2, seed=7).fit(train)
    train.unpersist()
    check = _raw(trees, table.where("calibrate").select("label", "features")).select(F.col("label").cast("double").alias("label"), "__p")
    if not check.head(1):
        return Model(lexicon, trees, [0.0, 1.0], [0.0, 1.0], base)
    curve = IsotonicRegression(featuresCol="__p", labelCol="label").fit(check)
    return Model(lexicon, trees, [float(x) for x in curve.boundaries], [float(x) for x in curve.predictions], base)


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """A calibrated score for every whole text of `documents`, learned from `labels.toxic`."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs).select("doc_id", held_out().alias("held_out"), "score", "predicted")
