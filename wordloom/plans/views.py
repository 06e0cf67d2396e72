"""Analyses and segmentations as views, for Spark SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wordloom.functions.staging import staged
from wordloom.operators.analyze import Ruleset, analyze
from wordloom.operators.segment import segment


def register(words: DataFrame, rules: Ruleset, prefix: str = "word") -> list[str]:
    """Make temporary views over words (word) and the rules: PREFIX_analyses, PREFIX_segments (default order),
    PREFIX_derived (derived first), and the lexicon PREFIX_lexemes. They are computed when queried."""
    views = {"analyses": analyze(words, rules), "segments": segment(words, rules), "derived": segment(words, rules, derived_first=True), "lexemes": rules.lexeme}
    for name, df in views.items():
        df.createOrReplaceTempView(f"{prefix}_{name}")
    return [f"{prefix}_{name}" for name in views]


def functions(words: DataFrame, rules: Ruleset, prefix: str = "") -> list[str]:
    """Make temporary SQL table functions over a vocabulary: PREFIXanalyze(word) gives a word's readings in order,
    PREFIXsegment(word, n) its n best segmentations. Words (word) are read once and written by spelling; a call looks a
    word up, alone or laterally for each row of a table, and gives no row for a word that isn't in the vocabulary."""
    spark = words.sparkSession
    said = {
        "analyze": (analyze(words, rules), "", "rank INT, stem STRING, pos STRING, features ARRAY<STRING>, weight FLOAT, prefix STRING, deriv ARRAY<STRING>"),
        "segment": (segment(words, rules), ", n INT DEFAULT 1", "rank INT, pieces ARRAY<STRING>, labels ARRAY<STRING>, offsets ARRAY<INT>, lemma STRING, gate STRING"),
    }
    for name, (df, more, columns) in said.items():
        names = [c.split()[0] for c in columns.split(", ")]
        table = f"{prefix}{name}_of_words"
        staged(df.select("word", *names).repartitionByRange("word").sortWithinPartitions("word"), table).createOrReplaceTempView(table)
        # Analyses fold case, segmentations don't.
        key = "translate(asked, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')" if name == "analyze" else "asked"
        limit = " AND t.rank <= n" if more else ""
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}(asked STRING{more}) RETURNS TABLE ({columns}) RETURN SELECT {', '.join(f't.{c}' for c in names)} FROM {table} t WHERE t.word = {key}{limit}")
    return [f"{prefix}{name}" for name in said]
