"""The operators as queries over the test tables, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, licenses, line_dedup, lm, media, ngram_join, packing, quality, secrets, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every text of ``documents``: counts and digests of spans, named and by entropy."""
    return secrets.secrets_report(table(spark, sf_dir, "documents"))


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` stored as a lossless WebP image, read back and measured."""
    return media.media_report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds to four fifths or more."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and detections in every text of ``documents``."""
    return licenses.licenses_report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and probability of a good one for every row of ``documents``, fitted on a bounded sample of ``labels``."""
    return quality.quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the smallest id that links of similar texts reach from it."""
    return ngram_join.similar_texts(table(spark, sf_dir, "documents"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored by a mixture learned from the texts not held out."""
    return lm.lm_report(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of ``documents`` scored by a lexicon learned from labels not held out."""
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the number of lines that boilerplate takes from it, and what is left."""
    return line_dedup.lines_report(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as pieces of training sequences."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def instruction_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The operator of op10_packing on instruction data, where all three limits bind."""
    return packing.conversations_report(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()} | {"instruction_packing": instruction_packing}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontam.DECONTAM_SQL, "op9_line_dedup": line_dedup.LINES_SQL}
