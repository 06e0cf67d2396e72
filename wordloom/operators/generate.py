"""Forms of lexemes, and the check that each is read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions import orthography as o
from wordloom.functions import rules as r
from wordloom.functions.staging import staged

from .analyze import Ruleset, read_words

COLS = ["lex_id", "surface", "lemma", "pos", "stem_class", "origin"]


def regular_forms(rules: Ruleset) -> DataFrame:
    """Lexemes with each row of the paradigm that spells a form of theirs: not where a stored form stands for the tag."""
    par = rules.lexeme.join(F.broadcast(r.paradigm(rules.spark, rules.language)), ["pos", "eff"]).where(~F.map_contains_key("irregular", F.col("tag")))
    # A verb or a regular adjective whose doubling is unknown has no form that would show it.
    shows = F.col("tag").isin("+PAST", "+PRES_PART") & (F.col("pos") == "V") & F.col("eff").isin("REG", "SIBILANT", "SILENT_E") | (F.col("pos") == "ADJ") & F.col("eff").isin("REG", "SIBILANT")
    return par.where(F.col("doubling_known") | ~shows)


def generated_forms(rules: Ruleset) -> DataFrame:
    """COLS: citation, paradigm, stored forms, derivations with their spelling variants, un- and re-."""
    lex = rules.lexeme.withColumn("lemma", F.col("stem"))
    last, cut = F.substring("stem", -1, 1), F.substring(F.col("stem"), F.lit(1), F.length("stem") - 1)
    row = lambda df, surface, origin: df.select("lex_id", surface.alias("surface"), "lemma", "pos", "stem_class", origin.alias("origin"))
    out = row(lex, F.col("stem"), F.lit("citation"))
    par = regular_forms(rules).withColumn("lemma", F.col("stem"))
    body = F.concat(F.substring(F.col("stem"), F.lit(1), F.length("stem") - F.col("cut")), F.when(F.col("doubles"), last).otherwise(""), "ending")
    out = out.unionByName(row(par, body, F.col("tag")))
    out = out.unionByName(row(lex.select("*", F.explode("irregular").alias("tag", "form")), F.col("form"), F.concat(F.lit("irregular "), "tag")))
    der = lex.join(rules.derivation, F.array_contains("sources", F.col("pos")) & ((F.size("classes") == 0) | F.array_contains("classes", F.col("stem_class"))) & (F.length("stem") >= F.col("min_stem")))
    sc, vowel, suffix = F.col("stem_class"), o.vowel_initial(F.col("suffix")), F.col("suffix")
    forms = F.array_compact(F.array(
        F.concat("stem", suffix),
        F.when(F.col("y_restoration") & (sc == "Y_FINAL") & (last == "y"), F.concat(cut, F.lit("i"), suffix)),
        F.when((sc == "SILENT_E") & (last == "e") & (vowel | F.concat(cut, suffix).isin(o.E_DELETION)), F.concat(cut, suffix)),
        F.when((sc == "DOUBLE_CONS") & vowel, F.concat(F.col("stem"), last, suffix)),
    ))
    out = out.unionByName(row(der.select("*", F.explode(forms).alias("form")), F.col("form"), F.concat(F.lit("deriv -"), suffix)))
    pre = lex.where((F.col("pos") != "FUNC") & (F.length("stem") >= 2)).select("*", F.explode(F.array(F.lit("un"), F.lit("re"))).alias("prefix"))
    return out.unionByName(row(pre, F.concat("prefix", "stem"), F.concat(F.lit("prefix "), "prefix", F.lit("-"))))


def unread(rules: Ruleset, forms: DataFrame | None = None) -> DataFrame:
    """Generated forms without a reading."""
    forms = staged(generated_forms(rules).select(*COLS), "forms") if forms is None else forms  # read as words and as forms
    read = read_words(forms.select(F.col("surface").alias("word")), rules)
    return forms.withColumn("word", o.ascii_lower(F.col("surface"))).join(read, "word", "left_anti").drop("word")


def selfcheck(rules: Ruleset) -> DataFrame:
    """(origin, n, examples): unread forms by cause, most first, with the first three examples by spelling."""
    rows = staged(unread(rules).select("origin", "surface"), "unread")
    first = Window.partitionBy("origin").orderBy("surface")  # Spark keeps three of each origin in a task before it moves them
    some = rows.distinct().withColumn("k", F.row_number().over(first)).where("k <= 3").groupBy("origin").agg(F.array_sort(F.collect_list("surface")).alias("examples"))
    return rows.groupBy("origin").agg(F.count("*").alias("n")).join(some, "origin").select("origin", "n", "examples").orderBy(F.desc("n"), "origin")
