"""The corpus pipeline: STAGES over documents, each stage's rows written and read by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import decontamination, language, mixing, sharding, simhash
from wordloom.llm.common import staged, table

#: A document whose best language scores less is in none of the learned languages. Alone it rejects
#: nothing of four languages: the winner has a quarter at least.
LEAST_SCORE = 0.25


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a learned language; those without a letter, or unlike all languages, go:
    too few of their 3-grams are in the landmarks. Where no language can be learned, only the letters count."""
    cols = docs.columns
    model = language.train(docs)
    if not model.languages:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = docs.withColumn("__lang", language.predicted(F.col("text"), model, spark))
    return found.where((F.col("__lang.lang_pred") != language.UNKNOWN) & (F.col("__lang.score") >= LEAST_SCORE) & (F.col("__lang.known") >= model.least_known)).select(*cols)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.distinct_documents(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence in order: a document as often as the mix takes it. The stage returns documents' own
    columns, so a row's place in the sequence is that of its file and its place in it, which are range-sorted."""
    return mixing.mix(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with shard and slot. Equal texts share a shard; in each shard slots follow the order in which
    docs' files were written, so reading all shards side by side follows the curriculum."""
    order = [F.col("_metadata.file_name"), F.col("_metadata.row_index")] if docs.inputFiles() else None
    return sharding.shard(docs, order=order)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]
#: The kernel classifier and the fingerprints can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
