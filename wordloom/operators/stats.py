"""Corpus statistics: counts, scalars, alphabet, frequency scale, coverage."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions import orthography as o
from wordloom.functions.ledger import Ledger, fingerprint
from wordloom.functions.staging import staged

from .tokens import is_word, unit_stream, units


def unit_counts(docs: DataFrame) -> DataFrame:
    """(item, cnt, is_word)."""
    return docs.select(F.explode(units(F.col("text"))).alias("item")).groupBy("item").agg(F.count("*").alias("cnt")).withColumn("is_word", is_word(F.col("item")))


def word_counts(docs: DataFrame) -> DataFrame:
    return unit_counts(docs).where("is_word").select("item", "cnt")


def scalars(docs: DataFrame) -> DataFrame:
    """One row: documents, lines, bytes, units, unit types, word tokens, word types, characters in the alphabet."""
    text = docs.agg(F.count("text").alias("documents"), F.sum(F.size(F.split("text", "\n", -1))).alias("lines"), F.sum(F.octet_length("text")).alias("bytes"))
    n = unit_counts(docs).agg(F.sum("cnt").alias("units"), F.count("*").alias("unit_types"), F.sum(F.when(F.col("is_word"), F.col("cnt"))).alias("word_tokens"), F.count_if("is_word").alias("word_types"))
    return text.join(F.broadcast(n)).join(F.broadcast(alphabet(docs).agg(F.count("*").alias("alphabet"))))


def alphabet(docs: DataFrame) -> DataFrame:
    """(ch, cnt) of the characters that aren't white space. Counted from units' counts, not the text."""
    return unit_counts(docs).select("cnt", F.explode(F.split("item", "")).alias("ch")).where("ch <> ''").groupBy("ch").agg(F.sum("cnt").alias("cnt"))


def zipf_table(counts: DataFrame) -> DataFrame:
    """(word, cnt, zipf) of lower-cased a-z words of (item, cnt)."""
    rows = counts.groupBy(F.lower("item").alias("word")).agg(F.sum("cnt").alias("cnt")).where(F.col("word").rlike("^[a-z]+$"))
    total = rows.agg(F.sum("cnt").alias("total"))
    return rows.join(F.broadcast(total)).select("word", "cnt", o.zipf(F.col("cnt"), F.col("total")).alias("zipf"))


#: Hex digits of a line's place that are counted at once, and lines that one task may put in order.
DIGITS, LEAF_LINES = 4, 100_000


def sample_lines(docs: DataFrame, n: int, seed: int = 0, leaf: int = LEAF_LINES) -> DataFrame:
    """(doc_id, line_no, line): exactly n lines of all, or all where there are fewer; the same for the same seed, and in the
    same order, however the table is partitioned.

    A line's place is a digest of its document, number and the seed; the n first are the sample. Lines are
    counted by the first digits of their places, which says where the n-th stands; only the lines with the very digits of the
    n-th are counted on by more, until they are few enough to be put in order. So texts are read twice, and no
    task holds the sample.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    lines = lines.withColumn("__place", F.md5(F.concat_ws(":", "doc_id", "line_no", F.lit(seed)).cast("binary")))
    columns, order = ["doc_id", "line_no", "line"], ["__place", "doc_id", "line_no", "line"]

    def split(rows: DataFrame, wanted: int, digits: int) -> tuple[str | None, int, int]:
        """The digits that the wanted-th line begins with, how many are before them, and of them."""
        below = 0
        for x in sorted(rows.groupBy(F.substring("__place", 1, digits).alias("d")).agg(F.count("*").alias("k")).collect()):
            if below + x.k > wanted:
                return x.d, below, x.k
            below += x.k
        return None, below, 0

    if n <= 0:
        return lines.where("false").select(columns)
    digits, wanted = DIGITS, n
    edge, below, k = split(lines, wanted, digits)
    if edge is None:
        return lines.orderBy(*order).select(columns)
    prefix = F.substring("__place", 1, digits)
    kept = staged(lines.where(prefix <= edge), "sample")
    parts = [kept.where(prefix < edge)]
    rest, wanted = kept.where(prefix == edge), wanted - below
    while k > leaf and digits < 32:
        digits += DIGITS
        edge, below, k = split(rest, wanted, digits)
        prefix = F.substring("__place", 1, digits)
        parts.append(rest.where(prefix < edge) if edge is not None else rest)
        rest, wanted = rest.where(prefix == (edge or "")), wanted - below
    last = rest.withColumn("__k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order))).where(F.col("__k") <= wanted).drop("__k")
    return functools.reduce(DataFrame.union, [*parts, last]).orderBy(*order).select(columns)


def kept_sample(docs: DataFrame, n: int, base: str, seed: int = 0) -> DataFrame:
    """sample_lines(), kept under base and read again for the same documents, number and seed. Its record says
    how many lines were sampled, with which seed."""
    rows = docs.select("doc_id", "text")
    note = {"wanted": n, "seed": seed}
    return Ledger(docs.sparkSession, base).made("sample", fingerprint(note, rows), lambda: sample_lines(rows, n, seed), note)


def kept_splits(docs: DataFrame, base: str, test_share: int = 10) -> DataFrame:
    """splits(), kept under base in the same way."""
    rows = docs.select("doc_id", "text")
    note = {"test_share": test_share}
    return Ledger(docs.sparkSession, base).made("splits", fingerprint(note, rows), lambda: splits(rows, test_share), note)


def splits(docs: DataFrame, test_share: int = 10) -> DataFrame:
    """(split, documents, units, types): a document is test by a hash of its id."""
    rows = unit_stream(docs.withColumn("split", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(100)) < test_share, "test").otherwise("train")), "split")
    n = docs.withColumn("split", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(100)) < test_share, "test").otherwise("train")).groupBy("split").agg(F.count("*").alias("documents"))
    types = rows.groupBy("split", "unit").agg(F.count("*").alias("cnt"))
    return types.groupBy("split").agg(F.sum("cnt").alias("units"), F.count("*").alias("types")).join(n, "split").select("split", "documents", "units", "types")


def coverage(counts: DataFrame, best: DataFrame) -> DataFrame:
    """(gate, tokens, types, token_share, type_share) of (item, cnt) by the best record of each item."""
    rows = counts.join(best.select(F.col("word").alias("item"), "gate"), "item", "left").groupBy("gate").agg(F.sum("cnt").alias("tokens"), F.count("*").alias("types"))
    total = rows.agg(F.sum("tokens").alias("all_tokens"), F.sum("types").alias("all_types"))
    return rows.join(F.broadcast(total)).select("gate", "tokens", "types", F.round(F.col("tokens") / F.col("all_tokens"), 6).alias("token_share"), F.round(F.col("types") / F.col("all_types"), 6).alias("type_share"))


def top_fallback(counts: DataFrame, best: DataFrame, k: int = 20) -> DataFrame:
    """The k commonest items without a reading."""
    return counts.join(best.where("gate = 'no_analysis'").select(F.col("word").alias("item")), "item").orderBy(F.desc("cnt"), "item").limit(k)
