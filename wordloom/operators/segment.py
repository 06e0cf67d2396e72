"""Analyses to ranked surface pieces that concatenate to the word exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions import orthography as o
from wordloom.functions import utf8
from wordloom.functions.staging import dealt

from .analyze import Ruleset, heaviest, readings

# Labels by tag, in order of preference.
LABELS = [("+PL", "SUFFIX_PL"), ("+PAST", "SUFFIX_PAST"), ("+PAST_PART", "SUFFIX_PAST"), ("+PRES_PART", "SUFFIX_ING"), ("+3SG", "SUFFIX_3SG"), ("+COMP", "SUFFIX_COMP"), ("+SUP", "SUFFIX_SUP")]
ALL_CAPS = 6
OUT = ["word", "rank", "pieces", "offsets", "labels", "lemma", "alt", "source", "gate", "n_analyses", "weight", "demoted", "promotable"]


def _at(s: Column, i: Column) -> Column:
    """The character at 0-based i, or ''."""
    return F.substring(s, i + 1, F.lit(1))


def _cut(rest: Column, suffix: Column, may_skip: bool) -> Column:
    """How much of rest the suffix takes: its common prefix, after at most one displaced letter."""
    first = F.substring(suffix, 1, 1)
    skip = F.when((F.substring(rest, 1, 1) != first) & (F.length(rest) > 1) & (F.substring(rest, 2, 1) == first), 1).otherwise(0) if may_skip else F.lit(0)
    n = o.common_prefix(F.substring(rest, skip + 1, F.length(rest)), suffix)
    return F.when(suffix.isNull() | (n == 0), 0).otherwise(skip + n)


def cut_up(rows: DataFrame) -> DataFrame:
    """rows (word, lower, prefix, stem, features, deriv, whole, lemma_sibilant) with parts, pieces, labels, alt and gate."""
    rows = rows.withColumn("p", F.length("prefix")).withColumn("region", F.expr("substring(lower, p + 1)"))
    rows = rows.withColumn("lcp", o.common_prefix(F.col("region"), F.col("stem"))).withColumn("whole", F.col("whole") | (F.col("lcp") == 0))
    rows = rows.withColumn("tail", F.expr("substring(word, p + lcp + 1)"))
    suffix = lambda i: F.substring(F.try_element_at("deriv", F.lit(i)), 2, 99)
    rows = rows.withColumn("m1", _cut(F.col("tail"), suffix(1), True)).withColumn("rest", F.expr("substring(tail, m1 + 1)"))
    rows = rows.withColumn("m2", F.when((F.col("m1") > 0) & (F.col("rest") != ""), _cut(F.col("rest"), suffix(2), False)).otherwise(0)).withColumn("rest2", F.expr("substring(rest, m2 + 1)"))
    label = F.when(F.size("features") == 0, "SUFFIX_DERIV").otherwise("SUFFIX_INFL")
    for tag, name in reversed(LABELS):
        label = F.when(F.array_contains("features", tag), name).otherwise(label)
    piece = lambda when, text, name: F.when(when & (text != ""), F.struct(text.alias("text"), name.alias("label")))
    parts = F.array_compact(F.array(
        piece(F.col("p") > 0, F.expr("substring(word, 1, p)"), F.lit("PREFIX")),
        piece(F.lit(True), F.expr("substring(word, p + 1, lcp)"), F.lit("STEM")),
        piece(F.col("m1") > 0, F.expr("substring(tail, 1, m1)"), F.lit("SUFFIX_DERIV")),
        piece(F.col("m2") > 0, F.expr("substring(rest, 1, m2)"), F.lit("SUFFIX_DERIV")),
        piece(F.lit(True), F.col("rest2"), label),
    ))
    parts = F.when(F.col("whole"), F.array(F.struct(F.col("word").alias("text"), F.lit("IRREGULAR").alias("label")))).otherwise(parts)
    rows = rows.withColumn("parts", parts)
    reg, stem, lcp = F.col("region"), F.col("stem"), F.col("lcp")
    matched = lcp == F.length(stem)
    alt = (
        F.when(F.col("whole") | (lcp >= F.length(reg)), "")
        .when((lcp < F.length(stem)) & (_at(stem, lcp) == "y") & (_at(reg, lcp) == "i"), "y_to_i")
        .when((lcp + 1 == F.length(stem)) & (_at(stem, lcp) == "e"), "e_deletion")
        .when(matched & (_at(reg, lcp) == _at(stem, lcp - 1)) & ~o.is_vowel(_at(reg, lcp)), "consonant_doubling")
        .when(matched & (F.substring(reg, lcp + 1, F.lit(2)) == "es") & (o.ends_in_sibilant(stem) | F.col("lemma_sibilant")), "epenthesis")
        .otherwise("")
    )
    gate = F.when(F.col("whole"), "irregular").when(F.size("parts") >= 2, "decomposed").otherwise("lexicon_stem")
    return rows.withColumns({"pieces": F.transform("parts", lambda x: x["text"]), "labels": F.transform("parts", lambda x: x["label"]), "alt": alt, "gate": gate})


def shortest_affix(parts: Column, alt: Column) -> Column:
    """Letters of the shortest piece that isn't the stem; of the first longer one after the stem a
    letter that an alternation displaced doesn't count. 0 without affixes."""
    displaced = alt.isin("y_to_i", "consonant_doubling", "epenthesis")
    state = F.struct(F.lit(0).alias("least"), F.lit(False).alias("after"))

    def step(a: Column, p: Column) -> Column:
        n = F.length(p["text"])
        less = displaced & a["after"] & (n > 1)
        n = F.when(less, n - 1).otherwise(n)
        is_stem = p["label"] == "STEM"
        least = F.when(is_stem, a["least"]).when((a["least"] == 0) | (n < a["least"]), n).otherwise(a["least"])
        return F.struct(least.alias("least"), (is_stem | (a["after"] & ~less)).alias("after"))

    return F.aggregate(parts, state, step, lambda a: a["least"])


def heaviest_of(lexemes: Column, pos: Column) -> Column:
    """The heaviest lexeme of a part of speech, or of one of several."""
    return heaviest(lexemes, lambda x: F.array_contains(pos, x["pos"]))


def some_of(lexemes: Column, pos: str) -> Column:
    return F.coalesce(F.exists(lexemes, lambda x: x["pos"] == pos), F.lit(False))


def guarded(rows: DataFrame, rules: Ruleset) -> DataFrame:
    """rows with demoted and promotable, by what the lexicon says of word, lemma, base and prefixed lemma."""
    has = F.col("prefix") != ""
    # Without a prefix nothing is asked of base and joint; the word and its stem stand for them, so that no null is a hot key.
    rows = rows.withColumn("base", F.when(has, F.expr("substring(lower, p + 1)")))
    rows = rules.looked_up(rows, F.coalesce("base", "lower"), "base")
    rows = rules.looked_up(rows, F.when(has, F.concat("prefix", "stem")).otherwise(F.coalesce("stem", "lower")), "joint")
    attaches = F.create_map(*(F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for p in rules.language.prefixes for x in p))
    rows = rows.withColumn("attaches", F.try_element_at(attaches, F.col("prefix")))
    direct, through = heaviest_of(F.col("base_lexemes"), F.col("attaches")), heaviest_of(F.col("lemma_lexemes"), F.col("attaches"))
    joint = F.when((F.col("stem") != F.col("base")) & through.isNotNull(), heaviest(F.col("joint_lexemes")))
    whole = heaviest(F.col("whole_lexemes"))["weight"]
    rows = rows.withColumn("attached", F.coalesce(direct, joint)).withColumn("own", heaviest_of(F.col("lemma_lexemes"), F.array("pos")))
    rows = rows.withColumns({"attached_weight": F.col("attached.weight"), "attached_known": F.col("attached.known"), "own_weight": F.col("own.weight"), "own_known": F.col("own.known"), "whole_weight": whole})
    margin = F.lit(o.WEIGHT_PER_ZIPF * o.MARGIN_ZIPF).cast("float")
    heavier = F.col("attached_known") & F.coalesce(F.col("whole_weight") > F.col("attached_weight") - margin, F.lit(False))
    licensed = ~has | (
        (F.length("base") >= 3) & ~F.coalesce("base_closed", F.lit(False)) & ~some_of(F.col("base_lexemes"), "FUNC") & F.col("attached_weight").isNotNull() & ~F.coalesce(heavier, F.lit(False))
    )
    long_plural = ~F.array_contains("features", "+PL") | (F.length("stem") >= 3)
    rows = rows.withColumn("demoted", (F.col("gate") == "decomposed") & (~licensed | ~long_plural))
    affix = shortest_affix(F.col("parts"), F.col("alt"))
    commoner = (affix > 0) & (affix <= 2) & F.col("own_known") & F.coalesce(F.col("whole_weight") > F.col("own_weight"), F.lit(False))
    doubled_verb = (F.col("alt") == "consonant_doubling") & (F.size("deriv") > 0) & (F.col("derived_pos") != "V") & some_of(F.col("whole_lexemes"), "V")
    is_stored = lambda name: F.coalesce(F.size(f"{name}_stored") > 0, F.lit(False))
    promotable = (
        ~F.col("demoted") & (F.col("gate") == "decomposed") & ~F.coalesce("whole_closed", F.lit(False)) & (F.col("pos") != "FUNC") & ~some_of(F.col("whole_lexemes"), "FUNC")
        & (F.length("stem") >= 3) & F.col("own_weight").isNotNull() & ~F.coalesce(commoner, F.lit(False)) & ~is_stored("whole") & ~(has & is_stored("base")) & ~doubled_verb
    )
    return rows.withColumn("promotable", F.coalesce(promotable, F.lit(False)))


#: What a word is ranked by, of its readings: see segment().
ORDER = ["demoted", "light", "fewer", "lemma", "labels", "gate", "alt"]


def cuts(words: DataFrame, rules: Ruleset) -> DataFrame:
    """Every distinct segmentation of each distinct word, unranked: OUT without rank and offsets, `flat` for the
    one record of a word that has no reading, and promoted (0 or 1), light and fewer, which ranks are made of."""
    words = dealt(words.where(F.col("word").isNotNull()), "word").withColumn("lower", o.ascii_lower(F.col("word")))
    letters = F.col("word").rlike("[A-Za-z]")
    rows = readings(words, rules, when=letters)
    rows = rules.looked_up(rows, F.coalesce("stem", "lower"), "lemma")
    rows = rules.looked_up(rows, F.col("lower"), "whole")
    stored = F.exists("whole_stored", lambda x: (x["stem"] == F.col("stem")) & (x["stored_tag"] == F.get("features", F.lit(0))))
    rows = rows.withColumns({
        "whole": F.coalesce((F.size("features") == 1) & stored, F.lit(False)),
        "lemma_sibilant": F.coalesce(F.exists("lemma_lexemes", lambda x: x["stem_class"] == "SIBILANT"), F.lit(False)),
    })
    rows = guarded(cut_up(rows), rules)
    # Words without a reading are one piece, or none.
    flat = F.col("stem").isNull()
    bare = F.when(F.col("word") != "", F.array(F.struct(F.col("word").alias("text"), F.lit("UNK").alias("label")))).otherwise(F.slice("parts", 1, 0))
    parts = F.when(flat, bare).otherwise(F.col("parts"))
    own = lambda c, other: F.when(flat, other).otherwise(F.col(c)).alias(c)
    rows = rows.select(
        *rules.by, flat.alias("flat"), F.transform(parts, lambda x: x["text"]).alias("pieces"), F.transform(parts, lambda x: x["label"]).alias("labels"),
        F.coalesce("stem", F.lit("")).alias("lemma"), own("alt", F.lit("")), F.when(~flat, "fst").when(letters, "fallback").otherwise("passthrough").alias("source"),
        F.when(~flat, F.col("gate")).when(letters, "no_analysis").otherwise("passthrough").alias("gate"),
        F.coalesce("weight", F.lit(0.0)).cast("float").alias("weight"), own("demoted", F.lit(False)), own("promotable", F.lit(False)),
    )
    by_word = Window.partitionBy(*rules.by)
    rows = rows.withColumn("n_analyses", F.count_if(~F.col("flat")).over(by_word)).where(~F.col("flat") | (F.col("n_analyses") == 0))
    return rows.withColumns({"promoted": F.when((F.size("pieces") > 1) & F.col("promotable"), 0).otherwise(1), "light": -F.col("weight"), "fewer": -F.size("pieces")})


def ranked(rows: DataFrame, derived_first: bool = False) -> DataFrame:
    """The distinct segmentations of cuts() in order, and before them the whole of a word in capitals that
    none of them is good for."""
    by = ["word", "level"] if "level" in rows.columns else ["word"]
    by_word, same = Window.partitionBy(*by), [*by, "lemma", "gate", "alt", "pieces", "labels", "n_analyses", "source", "flat"]
    order = F.struct(*(["promoted"] if derived_first else []), *ORDER)
    rows = rows.withColumn("order", order).groupBy(*same).agg(F.min("order").alias("order"), F.min_by(F.struct("weight", "demoted", "promotable"), "order").alias("x"))
    rows = rows.select(*same, "order", "x.*").withColumn("rank", F.row_number().over(by_word.orderBy("order")))
    # A short word in capitals whose readings are all demoted stands for itself first.
    caps = (F.length("word") <= ALL_CAPS) & ~F.col("word").rlike("[a-z]") & F.col("word").rlike("[A-Z]") & ~F.col("flat")
    rows = rows.withColumn("capped", caps & F.min("demoted").over(by_word))
    fields = ["pieces", "labels", "lemma", "alt", "source", "gate", "weight", "demoted", "promotable", "rank"]
    unk, empty, no = F.array(F.lit("UNK")), F.lit(""), F.lit(False)
    itself = [F.array("word"), unk, empty, empty, F.lit("fallback"), F.lit("no_analysis"), F.lit(0.0).cast("float"), no, no, F.lit(1)]
    one = F.struct(*(F.col(c) for c in fields[:-1]), (F.col("rank") + F.col("capped").cast("int")).alias("rank"))
    first = F.struct(*(v.alias(c) for c, v in zip(fields, itself)))
    both = F.when(F.col("capped") & (F.col("rank") == 1), F.array(first, one)).otherwise(F.array(one))
    return rows.select(*by, "n_analyses", F.inline(both))


def segment(words: DataFrame, rules: Ruleset, derived_first: bool = False, nbest: int | None = None) -> DataFrame:
    """All segmentations (OUT) of each distinct word, best at rank 1; nbest keeps that many.

    A word without an ASCII letter passes through; a word without a reading falls back to one
    piece. Ranking: readings that a guard demotes last; with derived_first, promotable cuts
    first; then weight, number of pieces, lemma, labels, gate, alternation. Of nested lexicons (Ruleset) each
    gives records of its own, with their `level`.
    """
    out = ranked(cuts(words, rules), derived_first)
    if nbest is not None:
        out = out.where(F.col("rank") <= nbest)
    return out.withColumn("offsets", o.offsets(F.col("pieces"))).select(*OUT, *rules.by[1:])


def violations(records: DataFrame) -> DataFrame:
    """Records that break an invariant, with the reason; a sound table gives no row."""
    n = F.size("pieces")
    why = (
        F.when(F.array_join("pieces", "") != F.col("word"), "pieces don't rebuild the word")
        .when((F.size("offsets") != n + 1) | (F.element_at("offsets", 1) != 0) | (F.element_at("offsets", -1) != F.length("word")), "offsets don't span the word")
        .when(F.exists("pieces", lambda p: p == ""), "an empty piece")
        .when(F.size("labels") != n, "labels and pieces differ in number")
        .when((F.col("source") == "fallback") & ((n != 1) | (F.col("lemma") != "") | (F.col("weight") != 0)), "a fallback that isn't one bare piece")
        .when((F.col("gate") == "decomposed") & (n < 2), "decomposed into fewer than two pieces")
    )
    return records.withColumn("why", why).where("why is not null")


def encode(words: DataFrame, rules: Ruleset, derived_first: bool = False) -> DataFrame:
    """Every input row's word with its best pieces; duplicates and rows are kept."""
    best = segment(words, rules, derived_first, nbest=1)
    return words.join(best.select("word", "pieces"), "word", "left")


def decode(pieces: Column) -> Column:
    return F.array_join(pieces, "")


def quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(c.alias("v"))), r"(?s)^\{\"v\":(.*)\}$", 1)


def record_json(word: Column, said: Column | None = None) -> Column:
    """The fields of a record in fixed order, without braces. said: the word as JSON, where that isn't null; such a
    word is its only piece."""
    many = lambda c: F.concat(F.lit("["), F.array_join(F.transform(c, quoted), ", "), F.lit("]"))
    own, pieces = quoted(word), many(F.col("pieces"))
    if said is not None:
        own, pieces = F.coalesce(said, own), F.coalesce(F.concat(F.lit("["), said, F.lit("]")), pieces)
    return F.concat(
        F.lit('"word": '), own, F.lit(', "pieces": '), pieces, F.lit(', "offsets": ['), F.array_join(F.col("offsets").cast("array<string>"), ", "), F.lit('], "labels": '), many(F.col("labels")),
        F.lit(', "lemma": '), quoted(F.col("lemma")), F.lit(', "alt": '), quoted(F.col("alt")), F.lit(', "source": '), quoted(F.col("source")), F.lit(', "gate": '), quoted(F.col("gate")),
        F.lit(', "n_analyses": '), F.col("n_analyses").cast("string"), F.lit(', "weight": '), o.six_digits(F.col("weight")),
    )


def jsonl(records: DataFrame, nbest: int = 1) -> DataFrame:
    """(word, value): the record as a JSON line, with `, ` and `: `, and its alternatives when nbest is over 1."""
    one = record_json(F.col("word"))
    if nbest == 1:
        return records.where("rank = 1").select("word", F.concat(F.lit("{"), one, F.lit("}")).alias("value"))
    rows = records.where(F.col("rank") <= nbest).groupBy("word").agg(F.array_sort(F.collect_list(F.struct("rank", one.alias("s")))).alias("all"))
    others = F.array_join(F.transform(F.slice("all", 2, nbest), lambda x: F.concat(F.lit("{"), x["s"], F.lit("}"))), ", ")
    return rows.select("word", F.concat(F.lit("{"), F.get("all", F.lit(0))["s"], F.lit(', "alternatives": ['), others, F.lit("]}")).alias("value"))


def bytes_jsonl(lines: DataFrame, rules: Ruleset, derived_first: bool = False) -> DataFrame:
    """lines (value binary, a word) with `record`: the best record of each as a JSON line, one character a byte that is
    no UTF-8. Such a word is never cut: it is one piece, counted and written by characters and stray bytes."""
    rows = lines.withColumn("__word", utf8.text(F.col("value")))
    best = segment(rows.select(F.col("__word").alias("word")), rules, derived_first, nbest=1)
    said = F.when(~utf8.is_valid(F.col("value")), utf8.json_string(F.col("value")))
    met = rows.join(best.withColumnRenamed("word", "__word"), "__word")
    return met.select(*lines.columns, F.concat(F.lit("{"), record_json(F.col("__word"), said), F.lit("}")).alias("record"))
