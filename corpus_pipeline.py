"""The corpus pipeline: reject toxic documents, keep one of each near-duplicate group, drop contaminated ones, mask personal
data, pack. Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.

What holds for all stages: columns beyond those of documents are left out; a null or empty text is a document without words, which no
stage drops and packing gives its end id alone; a null in lang, source or n_chars changes nothing; a repeated row is a row of its own
until near-duplicates, where rows of one doc_id stay or go together; an empty table goes through as an empty table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterline.llm import decontam, neardup, packing, pii, toxicity
from meterline.llm.common import stage

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Documents that an operator scored below this are rejected; the same threshold as the operator's `predicted`.
TOXIC = 0.3


def drop_toxic(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a calibrated score under TOXIC; a score that equals it is rejected. The model learns from labelled rows that
    are not held out. Documents without text have a score like others, from features of nought."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return model.score(docs.select(*COLUMNS), threshold=TOXIC).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component (five-word shingles, similarity 0.8 or more). Repeated rows of that id all
    stay; documents without words are components of their own; a null id never names a component that has another id."""
    return neardup.near_duplicates(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def drop_contaminated(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth of the words lies inside benchmark windows: a twentieth is contaminated, a document
    without words isn't. Without benchmark items all stay."""
    found = decontam.contamination(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontam.digest(found).where("not contaminated").select(*COLUMNS)


def mask_personal_data(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets; n_chars follows the text, 0 without one. Spans
    that overlap become one, named after the first."""
    masked = pii.redact(pii.find_pii(docs.select(*COLUMNS)))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in sequences: the columns of query op8 and the ids themselves (little-endian, 32 bits each)."""
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]
#: SQL can express neither the learned scores nor the tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, f in STAGES[:-1]:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
