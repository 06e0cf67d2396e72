"""Rule tables. They are data: analysis joins them, so a language is a set of tables."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession

from .local import local
from .orthography import E_DELETION, FEATURES, POS

_ANY: list[str] = []
_MOST = ["REG", "Y_FINAL", "SILENT_E", "UNKNOWN"]
# Suffix, sources, derived part of speech, stem classes (none: any), y restored, least stem, restrictions.
DERIVATION = [
    ("ness", ["ADJ"], "N", _MOST, True, 1, ""),
    ("ly", ["ADJ"], "ADV", _MOST, True, 1, ""),
    ("er", ["V"], "N", [*_MOST, "DOUBLE_CONS"], True, 1, ""),
    ("tion", ["V"], "N", ["REG", "SILENT_E", "UNKNOWN"], False, 1, ""),
    ("ment", ["V"], "N", ["REG", "SILENT_E", "UNKNOWN"], False, 1, ""),
    ("able", ["V"], "ADJ", _ANY, True, 3, ""),
    ("al", ["N"], "ADJ", _ANY, True, 3, ""),
    ("ful", ["N", "V"], "ADJ", _ANY, True, 3, ""),
    ("less", ["N"], "ADJ", _ANY, True, 3, ""),
    ("ous", ["N"], "ADJ", _ANY, True, 3, ""),
    ("ic", ["N"], "ADJ", _ANY, True, 3, ""),
    ("ive", ["V"], "ADJ", _ANY, True, 3, ""),
    ("ish", ["N", "ADJ"], "ADJ", _ANY, True, 3, ""),
    ("y", ["N"], "ADJ", _ANY, True, 4, "FREQUENT_STEM NOT_CLOSED_CLASS"),
    ("ity", ["ADJ"], "N", _ANY, True, 3, ""),
    ("ism", ["N", "ADJ"], "N", _ANY, True, 3, ""),
    ("ist", ["N", "ADJ"], "N", _ANY, True, 3, ""),
    ("ion", ["V"], "N", _ANY, True, 3, ""),
    ("ation", ["V"], "N", _ANY, True, 3, ""),
    ("ance", ["V"], "N", _ANY, True, 3, ""),
    ("ence", ["V"], "N", _ANY, True, 3, ""),
    ("hood", ["N", "ADJ"], "N", _ANY, True, 3, ""),
    ("ship", ["N"], "N", _ANY, True, 3, ""),
    ("dom", ["N", "ADJ"], "N", _ANY, True, 3, ""),
    ("ize", ["ADJ", "N"], "V", _ANY, True, 3, ""),
    ("ise", ["ADJ", "N"], "V", _ANY, True, 4, ""),
    ("ify", ["ADJ", "N"], "V", _ANY, True, 3, ""),
    ("en", ["ADJ"], "V", _ANY, True, 3, ""),
]
# Prefixes in order of trial, and what they attach to.
PREFIXES = [
    ("un", ["ADJ", "V", "N"]), ("re", ["V"]), ("pre", ["N", "V", "ADJ"]), ("dis", ["V", "ADJ", "N"]), ("mis", ["V", "N"]),
    ("over", ["V", "ADJ", "N"]), ("under", ["V", "ADJ", "N"]), ("non", ["N", "ADJ"]), ("anti", ["N", "ADJ"]), ("de", ["V"]),
    ("out", ["V"]), ("up", ["V"]), ("sub", ["N", "V", "ADJ"]), ("inter", ["V", "ADJ"]), ("co", ["N", "V"]),
]

_KNOWN = ["REG", "Y_FINAL", "SIBILANT", "DOUBLE_CONS", "SILENT_E"]
# Fixed values, here and in OUTER and PARADIGM.
#: How the end of a word is read: how the stem was recovered from the rest, the ending, part of
#: speech, effective classes, tag, and a guard. kinds: 0 as it stands, 1 i for y, 2 doubled, 3 e lost.
INFLECTION = [
    (0, "s", "N", _KNOWN, "+PL", ""), (0, "es", "N", _KNOWN, "+PL", "takes_es"),
    (0, "s", "V", ["REG", "SILENT_E", "DOUBLE_CONS"], "+3SG", ""), (0, "es", "V", ["SIBILANT"], "+3SG", ""),
    (0, "ed", "V", ["REG", "SILENT_E", "SIBILANT"], "+PAST", "doubling_known"), (0, "ed", "V", ["REG", "SILENT_E", "SIBILANT"], "+PAST_PART", "doubling_known"),
    (0, "ing", "V", ["REG", "Y_FINAL", "SIBILANT"], "+PRES_PART", "doubling_known"),
    (0, "er", "ADJ", ["REG"], "+COMP", ""), (0, "est", "ADJ", ["REG"], "+SUP", ""),
    (1, "es", "N", ["Y_FINAL"], "+PL", ""), (1, "es", "V", ["Y_FINAL"], "+3SG", ""), (1, "ed", "V", ["Y_FINAL"], "+PAST", ""), (1, "ed", "V", ["Y_FINAL"], "+PAST_PART", ""),
    (1, "er", "ADJ", ["Y_FINAL"], "+COMP", ""), (1, "est", "ADJ", ["Y_FINAL"], "+SUP", ""),
    *((kind, *rest) for kind, c in ((2, "DOUBLE_CONS"), (3, "SILENT_E")) for rest in (
        ("ed", "V", [c], "+PAST", ""), ("ed", "V", [c], "+PAST_PART", ""), ("ing", "V", [c], "+PRES_PART", ""), ("er", "ADJ", [c], "+COMP", ""), ("est", "ADJ", [c], "+SUP", ""))),
]
_ALL = ["REG", "Y_FINAL", "SIBILANT", "SILENT_E"]
#: The same outside a derived form, whose class is the one that its spelling implies.
OUTER = [
    (0, "es", "N", ["SIBILANT"], "+PL"), (0, "s", "N", ["REG", "SILENT_E"], "+PL"), (0, "s", "V", ["REG", "SILENT_E"], "+3SG"), (0, "es", "V", ["SIBILANT"], "+3SG"),
    (0, "d", "V", ["SILENT_E"], "+PAST"), (0, "d", "V", ["SILENT_E"], "+PAST_PART"), (0, "ed", "V", ["REG", "SIBILANT"], "+PAST"), (0, "ed", "V", ["REG", "SIBILANT"], "+PAST_PART"),
    (0, "ing", "V", ["REG", "SIBILANT", "Y_FINAL"], "+PRES_PART"),
    (1, "es", "N", _ALL, "+PL"), (1, "es", "V", _ALL, "+3SG"), (1, "ed", "V", _ALL, "+PAST"), (1, "ed", "V", _ALL, "+PAST_PART"),
    (3, "ing", "V", _ALL, "+PRES_PART"), (3, "ed", "V", _ALL, "+PAST"), (3, "ed", "V", _ALL, "+PAST_PART"),
]
#: The paradigm: part of speech, effective class, tag, ending, characters cut, whether the last letter doubles.
PARADIGM = [
    ("N", "SIBILANT", "+PL", "es", 0, False), ("N", "Y_FINAL", "+PL", "ies", 1, False), *(("N", c, "+PL", "s", 0, False) for c in ("REG", "SILENT_E", "DOUBLE_CONS")),
    ("V", "SIBILANT", "+3SG", "es", 0, False), ("V", "SIBILANT", "+PAST", "ed", 0, False), ("V", "SIBILANT", "+PRES_PART", "ing", 0, False),
    ("V", "Y_FINAL", "+3SG", "ies", 1, False), ("V", "Y_FINAL", "+PAST", "ied", 1, False), ("V", "Y_FINAL", "+PRES_PART", "ing", 0, False),
    ("V", "DOUBLE_CONS", "+3SG", "s", 0, False), ("V", "DOUBLE_CONS", "+PAST", "ed", 0, True), ("V", "DOUBLE_CONS", "+PRES_PART", "ing", 0, True),
    ("V", "SILENT_E", "+3SG", "s", 0, False), ("V", "SILENT_E", "+PAST", "d", 0, False), ("V", "SILENT_E", "+PAST", "ed", 1, False), ("V", "SILENT_E", "+PRES_PART", "ing", 1, False),
    ("V", "REG", "+3SG", "s", 0, False), ("V", "REG", "+PAST", "ed", 0, False), ("V", "REG", "+PRES_PART", "ing", 0, False),
    *(("ADJ", c, tag, i + e, cut, double) for tag, e in (("+COMP", "er"), ("+SUP", "est")) for c, i, cut, double in (("Y_FINAL", "i", 1, False), ("DOUBLE_CONS", "", 0, True), ("SILENT_E", "", 1, False), ("REG", "", 0, False), ("SIBILANT", "", 0, False))),
]
# Limits of stacking and splitting.
MAX_TAIL, STACK_ROOT, STACK_SUFFIX, LAYER = 3, 4, 2, 0.9
#: How a word is read: an ending on a stem, one on a derived form, a stored form, not at all.
INFLECTED, DERIVED, STORED, NOTHING = range(4)


@dataclasses.dataclass(frozen=True)
class Language:
    """A language's rules as data. ENGLISH has the tables above; others give their own in the same form."""

    derivation: tuple = tuple(DERIVATION)
    prefixes: tuple = tuple(PREFIXES)
    inflection: tuple = tuple(INFLECTION)
    outer: tuple = tuple(OUTER)
    paradigm: tuple = tuple(PARADIGM)
    pos: tuple = tuple(POS)
    tags: tuple = tuple(FEATURES.values())
    e_deletion: tuple = tuple(E_DELETION)
    max_tail: int = MAX_TAIL
    stack_root: int = STACK_ROOT
    stack_suffix: int = STACK_SUFFIX
    layer: float = LAYER


ENGLISH = Language()


def derivation(spark: SparkSession, language: Language = ENGLISH, with_none: bool = False) -> DataFrame:
    """A row a rule; with_none: and one for no suffix."""
    rows = [("", [], "", [], False, 0, False, False, -1)] if with_none else []
    rows += [(s, src, d, c, y, m, "FREQUENT_STEM" in r, "NOT_CLOSED_CLASS" in r, i) for i, (s, src, d, c, y, m, r) in enumerate(language.derivation)]
    return local(spark, rows, "suffix string, sources array<string>, derived string, classes array<string>, y_restoration boolean, min_stem int, frequent_stem boolean, not_closed boolean, rule_ord int")


def prefixes(spark: SparkSession, language: Language = ENGLISH) -> DataFrame:
    """A row a prefix, and one for none."""
    return local(spark, [("", None, -1), *((p, a, i) for i, (p, a) in enumerate(language.prefixes))], "prefix string, attaches array<string>, prefix_ord int")


def tails(spark: SparkSession, language: Language = ENGLISH) -> DataFrame:
    """(route, tail, kind): how endings are taken off, outside an inflected stem (INFLECTED) or a derived form (DERIVED)."""
    rows = {(INFLECTED, x[1], x[0]) for x in language.inflection} | {(DERIVED, x[1], x[0]) for x in language.outer if len(x[1]) <= language.max_tail}
    return local(spark, sorted(rows | {(INFLECTED, "", 0), (DERIVED, "", 0)}), "route int, tail string, kind int")


def endings(spark: SparkSession, language: Language = ENGLISH) -> DataFrame:
    """(route, kind, tail, pos, classes, tag, guard, tag_ord): what an ending says of a stem or a derived form.
    Without an ending, and for stored forms (STORED), nothing is asked; NOTHING keeps a word without a reading."""
    rows = [(INFLECTED, *x, i) for i, x in enumerate(language.inflection)] + [(DERIVED, *x, "", i) for i, x in enumerate(language.outer)]
    rows += [(route, 0, "", p, None, None, "", 0) for route in (INFLECTED, DERIVED, STORED) for p in language.pos] + [(NOTHING, 0, "", "", None, None, "", 0)]
    return local(spark, rows, "route int, kind int, tail string, pos string, classes array<string>, tag string, guard string, tag_ord int")


def inflection(spark: SparkSession, language: Language = ENGLISH) -> DataFrame:
    return local(spark, [(*x, i) for i, x in enumerate(language.inflection)], "kind int, tail string, pos string, classes array<string>, tag string, guard string, tag_ord int")


def paradigm(spark: SparkSession, language: Language = ENGLISH) -> DataFrame:
    return local(spark, list(language.paradigm), "pos string, eff string, tag string, ending string, cut int, doubles boolean")
