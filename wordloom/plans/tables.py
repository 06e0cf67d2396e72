"""The lexicons and words that the registered queries use over the driver's tables.

STEMS is a small list of fixed cases. MINED adds, by a rule, a quarter of a table's own words as
lexemes, thousands of them, so that the rules are met by what the table holds; and query_words adds to the
table's words some that are built of these by every prefix, suffix and ending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions import orthography as o
from wordloom.functions import rules as r
from wordloom.functions.local import local
from wordloom.operators.analyze import LEXEME, Ruleset

#: stem, part of speech, class, weight (None: not known), stored forms. Stems occur in the tables' prose.
STEMS = [
    ("the", "N", "REG", 1.2, {}), ("th", "N", "REG", 0.9, {}), ("er", "V", "REG", 1.05, {}), ("er", "N", "REG", None, {}), ("on", "V", "REG", 1.0, {}), ("an", "N", "REG", 0.95, {}), ("sh", "V", "SIBILANT", 0.8, {}), ("sh", "N", "SIBILANT", 0.85, {}),
    ("and", "V", "REG", None, {"+PAST": "anded", "+PAST_PART": "ander"}), ("that", "ADJ", "REG", 1.1, {}), ("with", "V", "REG", 1.0, {}), ("ere", "V", "SILENT_E", 0.9, {}), ("ble", "ADJ", "SILENT_E", 0.8, {}), ("hat", "V", "DOUBLE_CONS", 0.9, {}),
    ("thy", "N", "Y_FINAL", 0.7, {}), ("ony", "V", "Y_FINAL", None, {}), ("rey", "ADJ", "Y_FINAL", 0.75, {}), ("reti", "V", "REG", 0.8, {}), ("rea", "N", "REG", 0.85, {}), ("ouhe", "V", "SILENT_E", 0.8, {}), ("nd", "ADJ", "REG", 0.9, {}), ("ing", "N", "REG", 0.9, {}),
    ("heat", "N", "REG", 1.0, {}), ("heat", "V", "REG", 0.98, {"+PAST": "hea"}), ("that", "FUNC", "REG", 1.3, {}), ("is", "FUNC", "REG", 1.3, {}), ("ern", "V", "IRR_SING", 0.8, {"+PAST": "erand"}), ("re", "V", "UNKNOWN", 0.9, {}), ("tion", "N", "UNKNOWN", 0.8, {}),
    ("license", "N", "SILENT_E", 1.0, {}), ("license", "V", "SILENT_E", 0.9, {}), ("right", "N", "REG", 1.1, {}), ("reserve", "V", "SILENT_E", 1.0, {}), ("there", "ADJ", "SILENT_E", 0.9, {}), ("onthe", "V", "SILENT_E", 0.8, {}),
]
CLOSED = ["the", "of", "and", "to", "in", "that", "it", "is", "was", "for", "on", "with", "as", "be", "by", "an", "at", "are", "from", "this"]

#: What the digits h of md5(word) say, in words that Spark and DuckDB share: which words are lexemes, their part
#: of speech, whether the class is unknown or irregular, whether a last consonant doubles, weight, stored forms, id.
MINED_WORD, MINED = "^[a-z]{3,9}$", "substr(h, 1, 1) < '4'"
MINED_POS = "CASE WHEN substr(h, 2, 1) < '6' THEN 'N' WHEN substr(h, 2, 1) < 'b' THEN 'V' WHEN substr(h, 2, 1) < 'f' THEN 'ADJ' ELSE 'ADV' END"
MINED_KNOWN, MINED_STORED, BUILT = "substr(h, 4, 1) >= '4'", "substr(h, 5, 1) < '2'", "substr(h, 17, 2) = '00'"
MINED_WEIGHT = "CASE WHEN substr(h, 4, 1) >= '4' THEN 0.7 + 0.04 * (instr('0123456789abcdef', substr(h, 4, 1)) - 1) ELSE 1.0 END"
#: The smallest of four nested lexicons that has a lexeme: an eighth of them, a quarter, a half, all; the fixed cases are in the first.
LEVEL = "CASE WHEN substr(h, 19, 1) < '2' THEN 1 WHEN substr(h, 19, 1) < '4' THEN 2 WHEN substr(h, 19, 1) < '8' THEN 3 ELSE 4 END"
#: Endings of built words, besides the suffixes; some follow a suffix.
BUILT_ENDINGS = ["s", "es", "ed", "d", "ing", "er", "est"]
SECOND = 7  # the suffix that stands outside another is this many rules further on


def lexeme(spark: SparkSession) -> DataFrame:
    rows = [(i, s, p, c, 1.0 if w is None else w, w is not None, list(f.items())) for i, (s, p, c, w, f) in enumerate(STEMS)]
    return local(spark, rows, LEXEME)


def rules(spark: SparkSession) -> Ruleset:
    """The fixed cases alone."""
    return Ruleset.of(lexeme(spark), local(spark, [(w,) for w in CLOSED], "word string"))


def mined_stems(words: DataFrame) -> DataFrame:
    """(stem, h) of words (word) that are lexemes by rule."""
    return words.where(F.col("word").rlike(MINED_WORD)).select(F.col("word").alias("stem")).distinct().withColumn("h", F.md5(F.col("stem").cast("binary"))).where(MINED)


def mined(words: DataFrame) -> DataFrame:
    """Lexemes that words (word) give by rule."""
    h3, stem = F.substring("h", 3, 1), F.col("stem")
    rows = mined_stems(words).withColumn("pos", F.expr(MINED_POS))
    doubles = F.col("pos").isin("V", "ADJ") & o.may_double(stem)
    stem_class = F.when(h3 == "0", "UNKNOWN").when((h3 == "1") & (F.col("pos") == "V"), "IRR_SING").when(F.col("pos") == "ADV", "REG").when(doubles & (h3 < "8"), "DOUBLE_CONS").otherwise(o.implied_class(stem))
    stored = F.when(F.expr(MINED_STORED) & (F.col("pos") == "V"), F.create_map(F.lit("+PAST"), F.concat("stem", F.lit("t")))).when(F.expr(MINED_STORED) & (F.col("pos") == "N"), F.create_map(F.lit("+PL"), F.concat("stem", F.lit("en"))))
    lex_id = F.conv(F.substring("h", 6, 11), 16, 10).cast("long") + 1000
    return rows.select(lex_id.alias("lex_id"), "stem", "pos", stem_class.alias("stem_class"), F.expr(MINED_WEIGHT).cast("float").alias("weight"), F.expr(MINED_KNOWN).alias("weight_known"), stored.alias("irregular"))


def nested_rules(words: DataFrame) -> Ruleset:
    """The same lexemes as four nested lexicons."""
    spark = words.sparkSession
    h = F.md5(F.col("stem").cast("binary"))
    own = mined(words).withColumn("h", h).withColumn("level", F.expr(LEVEL)).drop("h")
    return Ruleset.of(lexeme(spark).withColumn("level", F.lit(1)).unionByName(own), local(spark, [(w,) for w in CLOSED], "word string"))


def mined_rules(words: DataFrame) -> Ruleset:
    """The fixed cases and the mined lexemes."""
    spark = words.sparkSession
    return Ruleset.of(lexeme(spark).unionByName(mined(words)), local(spark, [(w,) for w in CLOSED], "word string"))


def query_words(words: DataFrame) -> DataFrame:
    """words, and those that are built of some of the mined lexemes."""
    spark = words.sparkSession
    n = len(r.DERIVATION)
    after = [x[0] for x in r.DERIVATION] + BUILT_ENDINGS + [f"{r.DERIVATION[i][0]}{r.DERIVATION[(i + SECOND) % n][0]}" for i in range(n)] + [f"{x[0]}s" for x in r.DERIVATION] + ["t", "en"]
    around = local(spark, [("", x) for x in after] + [(p, x) for p, _ in r.PREFIXES for x in ("", "s", "t", "ness")], "before string, after string")
    some = mined_stems(words).where(BUILT).select("stem", F.lit(1).alias("k"))
    made = some.join(F.broadcast(around.withColumn("k", F.lit(1))), "k").select(F.concat("before", "stem", "after").alias("word"))
    capital = made.where("substr(md5(cast(word as binary)), 1, 1) = '0'")
    return words.select("word").union(made).union(capital.select(F.upper("word"))).distinct()
