"""Spelling predicates as Column expressions, and the codes used everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of parts of speech, stem classes and features.
POS = ["N", "V", "ADJ", "ADV", "FUNC"]
REGULAR = ["REG", "Y_FINAL", "SIBILANT", "DOUBLE_CONS", "SILENT_E", "UNKNOWN"]
IRREGULAR = ["IRR_MOUSE", "IRR_CHILD", "IRR_SHEEP", "IRR_OX", "IRR_GO", "IRR_BE", "IRR_HAVE", "IRR_DO", "IRR_SING", "IRR_RING", "IRR_SWIM"]
FEATURES = {"PLURAL": "+PL", "PAST": "+PAST", "PAST_PART": "+PAST_PART", "PRES_PART": "+PRES_PART", "THIRD_SG": "+3SG", "COMP": "+COMP", "SUP": "+SUP"}
# Forms that lose an e before a consonant.
E_DELETION = ["argument", "judgment", "acknowledgment", "abridgment", "truly", "duly", "wholly", "introduction", "production", "reduction"]
WEIGHT_PER_ZIPF, MARGIN_ZIPF = 0.075, 0.25


def ascii_lower(c: Column) -> Column:
    """A-Z only: the Kelvin sign and its like stay what they are."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def is_vowel(c: Column) -> Column:
    return c.isin("a", "e", "i", "o", "u")


def takes_es(stem: Column) -> Column:
    return stem.rlike("(?:[szxo]|ch|sh)$")


def ends_in_sibilant(lemma: Column) -> Column:
    """The test of epenthesis: with j, without o."""
    return lemma.rlike("(?:[szxj]|ch|sh)$")


def has_silent_e(stem: Column) -> Column:
    return stem.rlike("(?s)^.+[^aeio]e$")


def has_consonant_y(stem: Column) -> Column:
    return stem.rlike("[^aeiou]y$")


def may_double(stem: Column) -> Column:
    return stem.rlike("[^aeiou][aeiou][^aeiouywx]$")


def implied_class(stem: Column) -> Column:
    return F.when(takes_es(stem), "SIBILANT").when(has_silent_e(stem), "SILENT_E").when(has_consonant_y(stem), "Y_FINAL").otherwise("REG")


def is_irregular(stem_class: Column) -> Column:
    return stem_class.startswith("IRR_")


def effective_class(stem: Column, stem_class: Column) -> Column:
    return F.when(is_irregular(stem_class), implied_class(stem)).otherwise(stem_class)


def derivational_class(stem: Column, stem_class: Column) -> Column:
    return F.when(is_irregular(stem_class) | (stem_class == "UNKNOWN"), implied_class(stem)).otherwise(stem_class)


def vowel_initial(suffix: Column) -> Column:
    return suffix.rlike("^[aeiou]")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    return F.when(n < 1, F.lit(0)).otherwise(F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))))


def two_digits(x: Column) -> Column:
    """A double of 0 up to 20 to two decimals by its exact binary value, halves to even: whether it is over the
    middle is asked of integers, since the decimal text of a double may lie on the other side."""
    one = 1 << 52
    m = (x * float(one)).cast("long")
    n = F.shiftright(m * 100, 52)
    over = m * 200 - (2 * n + 1) * F.lit(one)
    return (n + F.when((over > 0) | ((over == 0) & (n % 2 == 1)), 1).otherwise(0)) / F.lit(100.0)


def weight_of_zipf(zipf: Column) -> Column:
    return two_digits(F.least(F.lit(1.3), F.greatest(F.lit(0.7), F.lit(0.7) + F.lit(WEIGHT_PER_ZIPF) * zipf.cast("double"))))


def zipf(n: Column, total: Column) -> Column:
    """log10 of the occurrences in a billion tokens."""
    return F.round(F.log10(n * F.lit(1e9) / total), 2)


def six_digits(w: Column) -> Column:
    """A float as %.6g: six significant digits, no trailing zeros; 0 where it is no number."""
    w = w.cast("double")
    digits = F.regexp_replace(F.regexp_replace(F.format_string("%.6g", w), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")), "0").otherwise(digits)


def clean_line(w: Column) -> Column:
    return F.translate(w, "\r\n", "")


def offsets(pieces: Column) -> Column:
    """0 and the running lengths of the pieces, in code points."""
    return F.aggregate(pieces, F.array(F.lit(0)), lambda a, p: F.concat(a, F.array(F.element_at(a, -1) + F.length(p))))


def inner(offs: Column) -> Column:
    """The boundaries between pieces: offsets without the first and the last."""
    return F.when(F.size(offs) > 2, F.slice(offs, 2, F.greatest(F.size(offs) - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def matched(predicted: Column, gold: Column, tolerance: int = 0) -> Column:
    """How many predicted boundaries, in rising order, find a gold boundary of their own at most
    `tolerance` away, the nearest first."""
    if tolerance == 0:
        return F.size(F.array_intersect(predicted, gold))
    state = F.struct(gold.alias("free"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        near = F.array_min(F.transform(F.filter(a["free"], lambda g: F.abs(g - p) <= tolerance), lambda g: F.struct(F.abs(g - p).alias("d"), g.alias("g"))))["g"]
        return F.struct(F.when(near.isNull(), a["free"]).otherwise(F.array_remove(a["free"], F.coalesce(near, F.lit(-1)))).alias("free"), (a["n"] + F.when(near.isNull(), 0).otherwise(1)).alias("n"))

    return F.aggregate(F.array_sort(predicted), state, step, lambda a: a["n"])


def flat_parse(parse: Column, suffixes_only: bool = False) -> Column:
    """Morphemes of a bracketed parse; empty if one isn't of a-z, as < isn't with suffixes_only."""
    parts = F.filter(F.transform(F.split(parse, "[>{}()]+" if suffixes_only else "[<>{}()]+"), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.exists(parts, lambda x: ~x.rlike("^[a-z]+$")), F.array().cast("array<string>")).otherwise(parts)


def analysis_string(stem: Column, pos: Column, features: Column, prefix: Column, deriv: Column) -> Column:
    """`un+kind -ness +ADJ +PL`: prefix, stem, layers, part of speech, tags."""
    return F.concat(F.when(prefix != "", F.concat(prefix, F.lit("+"))).otherwise(""), F.array_join(F.concat(F.array(stem), deriv, F.array(F.concat(F.lit("+"), pos)), features), " "))
