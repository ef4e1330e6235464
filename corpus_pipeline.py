"""A corpus pipeline in five stages; each takes the documents that the stage before it kept.

Every stage function takes (spark, docs, sf_dir). All but the last return the
columns of `documents`; the last adds how often and how far a text is used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.mixing import mix_sources
from tidemark.llm.near_copies import first_of_each
from tidemark.llm.phrase_index import decontaminate
from tidemark.llm.shared import saved
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.toxicity import ToxicityModel, fit_toxicity, score_toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Near duplicates: shingles of five words, four fingerprint lanes in twelve segments.
#: They find the groups that are compared first; what counts is that 0.8 of the shingles of both are shared.
SHINGLE_WORDS, LANES, SEGMENTS, MAX_DISTANCE = 5, 4, 3, 44
#: Repeated passages: fifty words take more bytes than this.
PASSAGE_BYTES = 240
WINDOW = 10


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; null and empty texts stay, repeated rows are judged each."""
    model: ToxicityModel = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_toxicity(docs, model, carry=COLUMNS).where("predicted = 0").select("carried.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest id, null ids last.

    Different texts under one id, or under none, are different documents. Texts
    without words (null, empty) are one group. Of equal rows one stays.
    """
    return first_of_each(docs, words=SHINGLE_WORDS, lanes=LANES, segments=SEGMENTS, max_distance=MAX_DISTANCE, carry=COLUMNS)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that stand in more than one place; texts of nothing else go, null and empty texts stay."""
    cut = remove_repeats(docs, min_bytes=PASSAGE_BYTES, characters=True, carry=COLUMNS)
    text = F.when(F.col("n_removed") == 0, F.col("carried.text")).otherwise(F.col("kept").cast("string"))
    kept = cut.where("n_removed = 0 or trim(cast(kept as string)) <> ''")
    return kept.select("carried.doc_id", text.alias("text"), "carried.lang", "carried.source", F.when(F.col("n_removed") == 0, F.col("carried.n_chars")).otherwise(F.length(text).cast("long")).alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item; null and empty texts have none and stay."""
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=WINDOW, carry=COLUMNS)
    return found.where(F.size("spans") == 0).select("carried.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Uses of documents under the target weights: one row per document and epoch."""
    return mix_sources(docs, keep=["text", "n_chars"])


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", drop_repeated_passages),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix),
]

#: The first three stages are a learned score, hashed links and byte spans; SQL has no form for them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written once and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
