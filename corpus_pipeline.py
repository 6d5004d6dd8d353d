"""The corpus pipeline: a document table in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns a DataFrame; all but the
last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import mixing, near_duplicates, packing, secrets, string_kernel
from lumenfold.llm.common import staged


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages of the labelled documents, whatever their doc_id. Null, empty and letterless
    texts are in none and go; without labels all go, with one label all with letters stay; repeated rows are judged each
    and alike; an empty table gives an empty one; other columns pass unread."""
    model = string_kernel.train(docs)
    out = string_kernel.classify(docs, model, docs.columns, "__pred", "__score", reject=True)
    return out.where(F.col("__pred") != string_kernel.UNKNOWN).drop("__pred", "__score")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of documents that share 80 % of their 5-word shingles: that of least doc_id,
    those without one last, ties by a hash of the text; of equal rows one. Null and empty texts, if any come, are near
    nothing and stay; a doc_id with several texts keeps each that is near no other; an empty table gives an empty one."""
    return near_duplicates.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets in every text, overlapping ones together, and sets n_chars to match. Null texts stay null; texts
    without a secret stay as they are; repeated rows are masked each; an empty table gives an empty one."""
    return secrets.redacted(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources meet their target weights, no document over twice. Null sources are
    one source; documents without a word stay once; ties of the hash order are cut by a hash of the text; an empty table
    gives an empty one."""
    return mixing.mixed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens, cut and packed into sequences: a row per piece. Null and empty texts are the end id alone; repeated rows are
    packed each; long texts are cut, never shortened; an empty table gives no rows."""
    return packing.packed(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("mix", mix),
    ("pack", pack),
]

#: No stage but the third and fourth can be written in SQL; tests/llm holds each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
