"""A training corpus from ``documents``: language, repeated lines, near duplicates, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that the stage before it kept;
between stages the documents are written as Parquet and read again.  All but the
last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm.decontaminate import EVIDENCE_WORDS, contamination
from geoloom.llm.language_id import UNKNOWN, held_out, identify, learn
from geoloom.llm.line_dedup import line_dedup
from geoloom.llm.packing import pack
from geoloom.llm.simhash import one_of_each
from geoloom.llm.staging import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document below this similarity to every known language is rejected; running text is far above it.
MIN_LANGUAGE_SCORE = 0.1


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: null texts, texts without letters, texts far from every profile."""
    profiles = learn(docs.where(~held_out()).select("doc_id", "lang", "text"))
    found = identify(docs, profiles, carry=COLUMNS)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that an earlier document holds; a document may be left with an empty text."""
    found = line_dedup(docs, carry=("lang", "source"))
    return found.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the one with the smallest id, of each SimHash component."""
    return one_of_each(docs.select(*COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item of at least ``EVIDENCE_WORDS`` words, edited copies too."""
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__key"))
    leaks = contamination(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), key="__key", min_words=EVIDENCE_WORDS).select(F.col("row_key").alias("__key")).distinct()
    return keyed.join(leaks, "__key", "left_anti").select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the documents that are left into windows of 1024 tokens; one row for each piece."""
    return pack(docs)


STAGES = [
    ("language", language_stage),
    ("lines", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The stages' models and hashes have no SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
