"""A lexicon from dictionary entries and a frequency table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import orthography as o
from wordloom.functions.local import local
from wordloom.functions.staging import numbered

# Dictionary names of parts of speech, and the tag sets that name one feature exactly.
DICTIONARY_POS = {"noun": "N", "verb": "V", "adj": "ADJ", "adv": "ADV"}
TAG_SETS = {
    "PLURAL": ["plural"], "PAST": ["past"], "PAST_PART": ["participle", "past"], "PRES_PART": ["participle", "present"],
    "THIRD_SG": ["present", "singular", "third-person"], "COMP": ["comparative"], "SUP": ["superlative"],
}


def listed_forms(entries: DataFrame) -> DataFrame:
    """(word, pos, feature, form, line_no): forms of a-z whose tags name one feature exactly."""
    rows = entries.where(F.col("word").rlike("^[a-z]+$") & F.col("pos").isin(*DICTIONARY_POS)).withColumn("line_no", F.monotonically_increasing_id())
    feature = F.lit(None).cast("string")
    for name, tags in TAG_SETS.items():
        feature = F.when(F.array_sort("f.tags") == F.array(*map(F.lit, tags)), name).otherwise(feature)
    return rows.select("word", "pos", "line_no", F.explode("forms").alias("f")).select("word", "pos", feature.alias("feature"), F.col("f.form").alias("form"), "line_no").where("feature is not null and form is not null").where(F.col("form").rlike("^[a-z]+$"))


def headwords(entries: DataFrame) -> DataFrame:
    return entries.where(F.col("word").rlike("^[a-z]+$") & F.col("pos").isin(*DICTIONARY_POS)).select("word", "pos").distinct()


def form_of(heads: DataFrame, forms: DataFrame) -> DataFrame:
    """(word, pos) that only inflect another headword and list no forms of their own."""
    listed = forms.select("word", "pos").distinct()
    inflects = forms.where("form <> word").select(F.col("form").alias("word"), "pos").distinct()
    return heads.join(inflects, ["word", "pos"], "left_semi").join(listed, ["word", "pos"], "left_anti")


def classes_of(stem: Column, pos: Column) -> Column:
    """Classes that the spelling allows, the best first; REG is always the last."""
    some = lambda when, name: F.when(when, F.lit(name))
    return F.when(pos == "adv", F.array().cast("array<string>")).otherwise(F.array_compact(F.array(
        some(pos.isin("noun", "verb") & o.takes_es(stem), "SIBILANT"), some(o.has_consonant_y(stem), "Y_FINAL"), some(pos.isin("verb", "adj") & o.has_silent_e(stem), "SILENT_E"),
        some(pos.isin("verb", "adj") & o.may_double(stem), "DOUBLE_CONS"), F.lit("REG"),
    )))


#: What each class predicts: part of speech, class, feature, ending, letters cut, last letter doubled.
_VERB = {"SIBILANT": ("es", "ing", "ed", 0, 0, 0, False), "Y_FINAL": ("ies", "ing", "ied", 1, 0, 1, False), "DOUBLE_CONS": ("s", "ing", "ed", 0, 0, 0, True), "SILENT_E": ("s", "ing", "d", 0, 1, 0, False), "REG": ("s", "ing", "ed", 0, 0, 0, False)}
_ADJ = {"Y_FINAL": ("i", 1, False), "DOUBLE_CONS": ("", 0, True), "SILENT_E": ("", 1, False), "REG": ("", 0, False)}
PREDICTED = [
    ("noun", "SIBILANT", "PLURAL", "es", 0, False), ("noun", "Y_FINAL", "PLURAL", "ies", 1, False), ("noun", "REG", "PLURAL", "s", 0, False),
    *(("verb", c, f, e, cut, d and f != "THIRD_SG") for c, (s, g, p, cs, cg, cp, d) in _VERB.items() for f, e, cut in (("THIRD_SG", s, cs), ("PRES_PART", g, cg), ("PAST", p, cp), ("PAST_PART", p, cp))),
    *(("adj", c, f, i + e, cut, d) for c, (i, cut, d) in _ADJ.items() for f, e in (("COMP", "er"), ("SUP", "est"))),
]


def predicted(heads: DataFrame) -> DataFrame:
    """(word, pos, class_ord, stem_class, feature, predicted): the forms of every class that fits."""
    table = F.broadcast(local(heads.sparkSession, PREDICTED, "pos string, stem_class string, feature string, ending string, cut int, doubles boolean"))
    rows = heads.select("word", "pos", F.posexplode(classes_of(F.col("word"), F.col("pos"))).alias("class_ord", "stem_class")).join(table, ["pos", "stem_class"])
    form = F.concat(F.substring(F.col("word"), F.lit(1), F.length("word") - F.col("cut")), F.when(F.col("doubles"), F.substring("word", -1, 1)).otherwise(""), "ending")
    return rows.select("word", "pos", "class_ord", "stem_class", "feature", form.alias("predicted"))


def chosen_forms(forms: DataFrame, freq: DataFrame, expected: DataFrame) -> DataFrame:
    """(word, pos, feature, form): of the forms listed for a feature the commonest, then one that some
    class predicts, then the shortest, then the last by spelling."""
    guesses = expected.select("word", "pos", "feature", F.col("predicted").alias("form"), F.lit(True).alias("hit")).distinct()
    rows = forms.select("word", "pos", "feature", "form").distinct().join(freq.select(F.col("word").alias("form"), "zipf"), "form", "left").join(guesses, ["word", "pos", "feature", "form"], "left")
    rank = F.struct(F.coalesce("zipf", F.lit(0.0)), F.coalesce("hit", F.lit(False)), -F.length("form"), F.col("form"))
    return rows.groupBy("word", "pos", "feature").agg(F.max_by("form", rank).alias("form"))


def build_lexicon(entries: DataFrame, freq: DataFrame, keep_form_of: bool = False) -> DataFrame:
    """(word, pos, stem_class, irregular, zipf, weight): a row a headword, by frequency, then word.

    The class is the first with most of the listed forms; forms that it doesn't predict are
    stored. Without listed forms adverbs are REG, others UNKNOWN.
    """
    forms, heads = listed_forms(entries), headwords(entries)
    if not keep_form_of:
        heads = heads.join(form_of(heads, forms), ["word", "pos"], "left_anti")
    expected = predicted(heads)
    best = chosen_forms(forms.join(heads, ["word", "pos"], "left_semi"), freq, expected)
    # One row a class and feature with what the class predicts and what is listed.
    classes = heads.select("word", "pos", F.posexplode(classes_of(F.col("word"), F.col("pos"))).alias("class_ord", "stem_class"))
    listed = classes.join(best, ["word", "pos"]).join(expected, ["word", "pos", "class_ord", "stem_class", "feature"], "left")
    hit = F.coalesce(F.col("form") == F.col("predicted"), F.lit(False))
    scored = listed.groupBy("word", "pos", "class_ord", "stem_class").agg(F.count_if(hit).alias("hits"), F.collect_list(F.when(~hit, F.struct("feature", "form"))).alias("stored"))
    top = scored.groupBy("word", "pos").agg(F.max_by(F.struct("stem_class", "stored"), F.struct("hits", -F.col("class_ord"))).alias("x"))
    out = heads.join(top, ["word", "pos"], "left").join(freq.select("word", "zipf"), "word", "left")
    z = F.coalesce("zipf", F.lit(0.0))
    return out.select("word", "pos", F.coalesce("x.stem_class", F.when(F.col("pos") == "adv", "REG").otherwise("UNKNOWN")).alias("stem_class"), F.map_from_entries(F.coalesce("x.stored", F.array().cast("array<struct<feature:string,form:string>>"))).alias("irregular"), z.alias("zipf"), o.weight_of_zipf(z).alias("weight"))


def as_lexeme(entries: DataFrame) -> DataFrame:
    """Built entries as lexemes, in order of frequency, then word."""
    tag = F.create_map(*(F.lit(x) for kv in o.FEATURES.items() for x in kv))
    pos = F.create_map(*(F.lit(x) for kv in DICTIONARY_POS.items() for x in kv))
    return numbered(entries, F.desc("zipf"), F.col("word"), F.col("pos")).select(
        F.col("number").alias("lex_id"), F.col("word").alias("stem"), F.element_at(pos, F.col("pos")).alias("pos"), "stem_class", F.col("weight").cast("float").alias("weight"),
        F.lit(True).alias("weight_known"), F.transform_keys("irregular", lambda k, v: F.element_at(tag, k)).alias("irregular"),
    )


def top_words(entries: DataFrame, n: int) -> DataFrame:
    """The rows of the n commonest words; all of a word's rows stay together."""
    top = entries.select("word", "zipf").distinct().orderBy(F.desc("zipf"), "word").limit(n)
    return entries.join(top.select("word"), "word", "left_semi")


def regenerated(entries: DataFrame, forms: DataFrame) -> DataFrame:
    """(listed, equal): how many chosen forms the entries would give again."""
    heads = entries.select("word", "pos", "stem_class", "irregular")
    made = predicted(entries.select("word", "pos")).join(heads, ["word", "pos", "stem_class"])
    rows = forms.join(heads, ["word", "pos"]).join(made.select("word", "pos", "feature", "predicted"), ["word", "pos", "feature"], "left")
    again = F.coalesce(F.try_element_at("irregular", F.col("feature")), "predicted")
    return rows.agg(F.count("*").alias("listed"), F.count_if(again == F.col("form")).alias("equal"))


def histogram(entries: DataFrame, column: str) -> DataFrame:
    """(column, n, share)."""
    rows = entries.groupBy(column).agg(F.count("*").alias("n"))
    return rows.join(F.broadcast(rows.agg(F.sum("n").alias("all")))).select(column, "n", F.round(F.col("n") / F.col("all"), 6).alias("share"))
