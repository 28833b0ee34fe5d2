"""The corpus pipeline: language ID, line dedup, MinHash near-dedup, substring dedup, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet in the shared
folder and reads them again as the next stage's docs. All stages but the last return the columns of documents, with
n_chars kept true to the text. Null texts have no letter and are rejected by the first stage; empty tables pass through.
Line dedup keeps documents whose every line went, marked by an empty text and n_chars 0; the later stages keep them too,
and packing gives them their end marker only. Other columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bibloom.llm import language, line_dedup, near_dedup, packing, substring_dedup
from bibloom.llm.common import written
from bibloom.llm.queries import vocabulary


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose language the network cannot tell."""
    return language.accepted(docs, language.fit(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that are near copies of an earlier line."""
    return _counted(line_dedup.cleaned(docs))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates (five words, similarity 0.8)."""
    gone = near_dedup.near_duplicates(docs, words=5, percent=80).where(~F.col("kept")).select("doc_id")
    return docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def dedup_substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that an earlier document holds."""
    return _counted(substring_dedup.cleaned(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens, neighbours on the curve together."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end=0, length=1024)


STAGES = [("language_id", identify), ("line_dedup", dedup_lines), ("minhash_near_dedup", dedup_near), ("substring_dedup", dedup_substrings), ("packing", pack)]

#: SQL cannot express the stages; tests/llm holds the operators against brute-force versions, language ID against held-out rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
