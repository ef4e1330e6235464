"""The queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import fit_toxicity, score_toxicity

    docs = _documents(spark, sf_dir)
    return score_toxicity(docs, fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .png_columns import read_media, store_texts

    return read_media(store_texts(_documents(spark, sf_dir))).select("doc_id", "n_bytes", F.length("payload").cast("long").alias("payload_bytes"), "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import hex16, near_duplicates

    found = near_duplicates(_documents(spark, sf_dir), words=4, max_distance=4)
    return found.select("doc_id", hex16("f0").alias("fingerprint"), "component_id")


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_sources

    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op5_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_digests import scan

    return scan(_documents(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .phrase_index import decontaminate

    found = decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10, near=30)
    items = F.array_distinct("items")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["length"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"))


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .backoff_lm import score_texts

    return score_texts(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_trees import fit_quality, score_quality

    docs = _documents(spark, sf_dir)
    return score_quality(docs, fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), threshold=0.3)


def op9_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir), min_bytes=400).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_shared")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .token_counts import count_tokens

    return count_tokens(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [op1_toxicity, op2_media_columns, op3_simhash_near_duplicates, op4_source_mixing, op5_license_digests, op6_decontamination, op7_language_model, op8_quality, op9_suffix_array, op10_token_counts]
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from .license_digests import scan_sql
    from .mixing import mix_sql

    return {"op4_source_mixing": mix_sql(), "op5_license_digests": scan_sql()}
