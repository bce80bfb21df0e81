"""A corpus pipeline over `documents`: five stages, each written as Parquet and read by the next.

All stages but the last return the columns of documents, and any further ones that these have. Decisions of one stage take effect in what
it returns. The last returns a row for each remaining document with the words that the mix takes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfscope.llm import decontam, exact, langid, minhash, mixing, scratch
from shelfscope.llm.queries import language_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised stay; those without text or letters go."""
    return langid.accepted(docs, language_model(docs))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (null as empty) the row with the largest id stays, with a null id only if all
    of them have none; repeated rows of that id and text stay together."""
    stay = exact.duplicates(docs).where("kept").select("doc_id", "text_sha256").distinct()
    same = F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)) == stay["text_sha256"]
    return docs.join(stay, same & docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the least id stays; texts without words, and
    rows without id, are in no group and stay."""
    stay = minhash.near_duplicates(docs).where("kept").select("doc_id").distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(stay["doc_id"]), "left_semi")


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word in any benchmark window stay, those without text among them."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document; a null source is a source of its own."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", exact_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
]

#: SQL can't express the trained language model nor the hashed draws of the mix.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.save(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.drop(before)  # only what an earlier stage has written
    return STAGES[-1][1](spark, docs, sf_dir)
