"""The queries of this subpackage and their SQL, as __spark_entry__ registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, html_text, mixing, near_duplicates, packing, quality, secrets, string_kernel, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(_table(spark, sf_dir, name))


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_index": _over("pages", warc.archived),
    "op2_secret_scans": _over("documents", secrets.secrets_of),
    "op3_quality_rules": _over("documents", quality.judged),
    "op4_best_fit_packing": _over("documents", packing.packed),
    "op5_html_extraction": _over("pages", html_text.extracted),
    "op6_document_fingerprints": _over("documents", fingerprints.fingerprinted),
    "op7_source_mixing": _over("documents", mixing.mix_documents),
    "op8_toxicity": lambda spark, sf_dir: toxicity.graded(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")),
    "op9_language_id": _over("documents", string_kernel.language_of),
    "op10_minhash_near_dedup": _over("documents", near_duplicates.components),
    "pipeline": _pipeline,
}

ORACLES: dict[str, str] = {
    "op1_warc_index": warc.ORACLE,
    "op2_secret_scans": secrets.oracle(),
    "op3_quality_rules": quality.ORACLE,
    "op6_document_fingerprints": fingerprints.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op10_minhash_near_dedup": near_duplicates.oracle(),
}
