"""Shared plumbing: table access, staged tables, components of links, and ASCII-only text helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.staging import discard, scratch, staged

__all__ = ["ascii_lower", "components", "discard", "row_key", "scratch", "staged", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: White space of the word and line contracts: [\x20\x09-\x0D].
SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def row_key() -> Column:
    """One non-null string for doc_id and text: rows that share it are alike in both."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.hex(F.xxhash64("text")))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in edges (a, b), the root being the smallest node that
    links reach. Rounds of large-star and small-star contraction; each is written to the
    shared folder. A row moves per link and round, never a group."""
    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()

    a, b = F.col("a"), F.col("b")
    now = staged(edges.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    seen = mark(now)
    while True:
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.join(low, "a").where(b > a).select(b.alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where(b != F.col("m")).select(b.alias("a"), F.col("m").alias("b"))
        after = staged(rest.union(low).distinct(), "links")
        discard(now)
        now, before, seen = after, seen, mark(after)
        if before == seen:
            return now.select(a.alias("node"), b.alias("root"))
