"""Line dedup: drop lines that recur in many documents, keep one copy of each.

Lines are exploded once, reduced to a 128-bit key, made one of each (key, document), and
counted per key with map-side partial aggregation, so a line that a third of all documents
share costs the count one row per task. Only (document, position, key) rows of long lines meet the frequent keys; the text
itself moves once, with the positions that its document loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower, row_key, staged, table

MIN_CHARS, MIN_DOCS = 40, 5


def _keys(min_chars: int) -> Column:
    """Of each line its key, or null where the trimmed line is short. Lower-casing A-Z
    doesn't change a length, so short lines are never lower-cased or hashed."""
    def key(line: Column) -> Column:
        line = F.btrim(line, F.lit(SPACE))
        return F.when(F.length(line) >= min_chars, F.unhex(F.md5(ascii_lower(line))))

    return F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), key)


def frequent_lines(keys: DataFrame, min_docs: int) -> DataFrame:
    """(key, keep): keys in at least min_docs documents, with the largest doc_id. Rows of one
    doc_id are one document; a null id counts as one like any other. Pairs are reduced before
    keys are counted, spread by both, so that a hot line is in no task alone."""
    return (
        keys.select("doc_id", F.explode(F.array_distinct(F.array_compact("keys"))).alias("key"))
        .distinct()
        .groupBy("key")
        .agg(F.count("*").alias("n"), F.max("doc_id").alias("keep"))
        .where(F.col("n") >= min_docs)
        .select("key", "keep")
    )


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with `text` rewritten, n_lines and n_dropped added (columns of these names are replaced).

    A null or empty text is one empty line. Every row is rewritten by itself, but rows
    that share a doc_id count as one document. Lines of a null doc_id count like any others; a null id is the largest only where no
    other document holds the line. The kept document may hold the line several times and
    keeps all of these.
    """
    docs = docs.drop("n_lines", "n_dropped").withColumn("__row", row_key())
    keys = staged(docs.select("__row", "doc_id", _keys(min_chars).alias("keys")), "line-keys")
    # A table of known size: Spark broadcasts it under its threshold, and else joins two
    # exchanges, of which adaptive execution splits the partition of a hot line.
    common = staged(frequent_lines(keys, min_docs), "frequent-lines")
    # Few documents lose lines; their table is staged, so its size is known and all texts needn't be
    # shuffled to it where it is small.
    lost = staged(
        keys.select("__row", "doc_id", F.posexplode("keys").alias("pos", "key"))
        .where(F.col("key").isNotNull())
        .join(common, "key")
        .where(~F.col("doc_id").eqNullSafe(F.col("keep")))
        .groupBy("__row")
        .agg(F.collect_set("pos").alias("__gone")),
        "lost-lines",
    )
    lines, gone = F.col("__lines"), F.coalesce("__gone", F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
    return (
        docs.join(lost, "__row", "left")
        .withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
        .withColumn("text", F.when(F.col("__gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")))
        .withColumn("n_lines", F.size(lines).cast("long"))
        .withColumn("n_dropped", F.size(gone).cast("long"))
        .drop("__row", "__lines", "__gone")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (
  SELECT doc_id, g.i AS pos, g.line FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents) d,
    LATERAL (SELECT unnest(ls) AS line, generate_subscripts(ls, 1) AS i) g),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keep FROM k WHERE length(key) >= {MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
m AS (SELECT k.doc_id, pos, line, f.key IS NOT NULL AND k.doc_id <> f.keep AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
