"""Words to analyses: candidate stems of each word meet the lexicon in one join.

A word is taken apart by joins with the rule tables (prefixes, endings, suffixes, suffixes again),
which are a few dozen rows and are broadcast. What may be a stem then meets the lexicon, kept as one
row a spelling. All steps keep the word's partitioning, so where the lexicon is small enough to be
sent to the executors (its size is checked) a word moves once; beyond that Spark shuffles to it.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions import orthography as o
from wordloom.functions import rules as r
from wordloom.functions.local import local
from wordloom.functions.staging import dealt, staged

LEXEME = "lex_id long, stem string, pos string, stem_class string, weight float, weight_known boolean, irregular map<string,string>"
#: Lexemes, and closed-class words, up to which the lexicon is broadcast: some 100 MB.
BROADCAST_LEXEMES = 200_000


@dataclasses.dataclass
class Ruleset:
    """A language at work: lexemes, closed-class words, rules as data, and whether the lexicon is small.

    Lexemes may have a `level`, from 1 on: lexicon n of several nested ones has the lexemes of levels 1 to n. Words are
    then read by all of them at once: each reading has a row for every level at which the lexicon has it,
    and what is asked of the lexicon is answered by level."""

    lexeme: DataFrame
    closed: DataFrame
    language: r.Language
    small: bool
    levels: int = 0
    table: DataFrame | None = None

    @staticmethod
    def of(lexeme: DataFrame, closed: DataFrame | None = None, language: r.Language = r.ENGLISH, broadcast_lexemes: int = BROADCAST_LEXEMES) -> Ruleset:
        """Counts lexemes and closed-class words, but no further than the bound."""
        if closed is None:
            closed = local(lexeme.sparkSession, [], "word string")
        small = all(x.limit(broadcast_lexemes + 1).count() <= broadcast_lexemes for x in (lexeme, closed))
        levels = (lexeme.agg(F.max("level")).first()[0] or 1) if "level" in lexeme.columns else 0
        return Ruleset(enriched(lexeme), closed, language, small, levels)

    @property
    def by(self) -> list[str]:
        """What readings are ranked and counted by."""
        return ["word", "level"] if self.levels else ["word"]

    @property
    def spark(self) -> SparkSession:
        return self.lexeme.sparkSession

    @property
    def derivation(self) -> DataFrame:
        return F.broadcast(r.derivation(self.spark, self.language))

    def irregular_forms(self) -> DataFrame:
        """(form, lex_id, stem, pos, weight, tag): the reverse index of stored forms."""
        return self.lexeme.select("lex_id", "stem", "pos", "weight", F.explode("irregular").alias("tag", "form"))

    def spellings(self) -> DataFrame:
        """(spelling, lexemes, stored, closed), a row each: its lexemes, the heaviest first, of equals the first;
        the lexemes that it is a stored form of, each with the tag; and whether it is of a closed class. Written
        when it is first asked for: every lookup of every plan then reads it."""
        if self.table is None:
            self.table = staged(self._spellings(), "spellings")
        return F.broadcast(self.table) if self.small else self.table

    def _spellings(self) -> DataFrame:
        entry = ["-weight as light", "lex_id", "stem", "pos", "stem_class", "weight", "weight_known as known", "map_keys(irregular) as own_tags", "eff", "deriv_class", "takes_es", "doubling_known", *(["level"] if self.levels else [])]
        one = self.lexeme.selectExpr("stem as spelling", f"struct({', '.join(entry)}, cast(null as string) as stored_tag) as entry", "false as closed")
        forms = self.lexeme.selectExpr("*", "explode(irregular) as (stored_tag, form)").selectExpr("form as spelling", f"struct({', '.join(entry)}, stored_tag) as entry", "false as closed")
        words = self.closed.select(F.col("word").alias("spelling"), F.lit(None).cast(one.schema["entry"].dataType).alias("entry"), F.lit(True).alias("closed"))
        kept = lambda stored: F.array_sort(F.collect_list(F.when(F.col("entry.stored_tag").isNotNull() == stored, F.col("entry"))))
        return one.unionByName(forms).unionByName(words).groupBy("spelling").agg(kept(False).alias("lexemes"), kept(True).alias("stored"), F.max("closed").alias("closed"))

    def looked_up(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows with what the lexicon knows of a spelling, as name_lexemes, name_stored and name_closed, or nulls."""
        own = self.spellings().select(*(F.col(c).alias(f"{name}_{c}") for c in ("spelling", "lexemes", "stored", "closed")))
        at_level = "level" in rows.columns
        rows = rows.join(own, key == F.col(f"{name}_spelling"), "left").drop(f"{name}_spelling")
        if self.levels and at_level:
            rows = rows.withColumns({c: F.filter(c, lambda x: x["level"] <= F.col("level")) for c in (f"{name}_lexemes", f"{name}_stored")})
        return rows


def enriched(lexeme: DataFrame) -> DataFrame:
    s, c = F.col("stem"), F.col("stem_class")
    return lexeme.withColumns({
        **({"level": F.col("level").cast("int")} if "level" in lexeme.columns else {}),
        "eff": o.effective_class(s, c), "deriv_class": o.derivational_class(s, c), "takes_es": o.takes_es(s) | (o.effective_class(s, c) == "SIBILANT"),
        "doubling_known": ~(o.is_irregular(c) & o.may_double(s)), "irregular": F.coalesce("irregular", F.create_map().cast("map<string,string>")),
    })


def heaviest(lexemes: Column, of=None) -> Column:
    """The first lexeme (of those that `of` takes), or null."""
    return F.get(F.filter(lexemes, of) if of else lexemes, F.lit(0))


def _splits(lengths: set[int], of: str, ends: str, rest: str, when: str = "true", whole: str = "true", from_start: bool = False, least: int = 1) -> str:
    """inline() of `of` cut in two: uncut (if `whole`), and with an end of each length (if `when`), which
    leaves at least `least` letters. from_start: the first letters are the end."""
    cut = (lambda k: f"left({of}, {k}) as {ends}, substring({of}, {k + 1}) as {rest}") if from_start else (lambda k: f"right({of}, {k}) as {ends}, left({of}, length({of}) - {k}) as {rest}")
    items = [f"if({whole}, struct('' as {ends}, {of} as {rest}), null)"]
    items += [f"if({when} and length({of}) >= {k + least}, struct({cut(k)}), null)" for k in sorted(lengths)]
    return f"inline(array({', '.join(items)}))"


def _bases(n: int, base: str, form: str, language: r.Language) -> str:
    """inline() of the stems that may stand before layer n's suffix: c{n} (how), need{n} (the class it shows) and cand{n}."""
    cut, deleted = f"left({base}, length({base}) - 1)", ", ".join(f"'{x}'" for x in language.e_deletion)
    has, vowel = f"r{n}.suffix <> ''", f"substring(r{n}.suffix, 1, 1) in ('a', 'e', 'i', 'o', 'u')"
    return f"""inline(array(
        struct(if({has}, 0, -1) as c{n}, '' as need{n}, {base} as cand{n}),
        if({has} and r{n}.y_restoration and endswith({base}, 'i'), struct(1 as c{n}, 'Y_FINAL' as need{n}, concat({cut}, 'y') as cand{n}), null),
        if({has} and ({vowel} or {form} in ({deleted})), struct(2 as c{n}, 'SILENT_E' as need{n}, concat({base}, 'e') as cand{n}), null),
        if({has} and {vowel} and length({base}) > 1 and right({base}, 1) = right({cut}, 1), struct(3 as c{n}, 'DOUBLE_CONS' as need{n}, {cut} as cand{n}), null)))"""


def _implied(x: str) -> str:
    return f"case when {x} rlike '(?:[szxo]|ch|sh)$' then 'SIBILANT' when {x} rlike '(?s)^.+[^aeio]e$' then 'SILENT_E' when {x} rlike '[^aeiou]y$' then 'Y_FINAL' else 'REG' end"


def candidates(words: DataFrame, rules: Ruleset, allow_prefix: bool = True) -> DataFrame:
    """words (word, lower) with a row for each way to take a word apart: prefix and key (the rest), route,
    kind and tail (an ending), form, up to two suffixes r1 (outer) and r2 with how they attach, and
    `stem`, the spelling to look up. is_self marks a key as it stands.

    Two layers are the bound, so the second is unrolled: what the first strips is stripped again.
    """
    lang, spark, b = rules.language, rules.spark, F.broadcast
    rows = words.withColumn("plain", F.col("lower").rlike("^[a-z]+$"))
    cuts = {len(p) for p, _ in lang.prefixes} if allow_prefix else set()
    rows = rows.selectExpr("*", _splits(cuts, "lower", "prefix", "key", "plain", from_start=True, least=2)).where("key is not null")
    rows = rows.join(b(r.prefixes(spark, lang)), "prefix")
    # Endings.
    cuts = {len(x[1]) for x in (*lang.inflection, *lang.outer)}
    rows = rows.selectExpr("*", _splits(cuts, "key", "tail", "head", "plain")).where("head is not null").join(b(r.tails(spark, lang)), "tail")
    form = f"""case kind when 0 then head when 1 then if(endswith(head, 'i'), concat(left(head, length(head) - 1), 'y'), null)
        when 2 then if(length(head) > 1 and right(head, 1) = right(left(head, length(head) - 1), 1), left(head, length(head) - 1), null) else concat(head, 'e') end"""
    outside = "plain and length(key) > length(tail) + 1 and (kind = 0 or (kind = 1 and form rlike '[^aeiou]y$') or (kind = 3 and form rlike '(?s)^.+[^aeio]e$'))"
    rows = rows.withColumn("form", F.expr(form)).where(f"form is not null and (route = {r.INFLECTED} or ({outside}))")
    # Suffixes: none of an inflected stem, one or two of a derived form.
    cuts = {len(x[0]) for x in lang.derivation}
    rule = lambda n: b(r.derivation(spark, lang, with_none=True).select(F.struct("*").alias(f"r{n}"), F.col("suffix").alias(f"s{n}")))
    derived = f"route = {r.DERIVED}"
    rows = rows.selectExpr("*", _splits(cuts, "form", "s1", "b1", derived, f"route = {r.INFLECTED}")).where("b1 is not null").join(rule(1), "s1")
    rows = rows.selectExpr("*", _bases(1, "b1", "form", lang)).where("cand1 is not null")
    inside = f"{derived} and need1 <> 'DOUBLE_CONS' and length(s1) >= {lang.stack_suffix} and length(cand1) >= r1.min_stem and (need1 = '' or {_implied('cand1')} = need1)"
    rows = rows.selectExpr("*", _splits(cuts, "cand1", "s2", "b2", inside)).where("b2 is not null").join(rule(2), "s2")
    rows = rows.selectExpr("*", _bases(2, "b2", "cand1", lang)).where("cand2 is not null")
    return rows.select(
        "word", "lower", "plain", "prefix", "prefix_ord", "key", "route", "kind", "tail", "form", "r1", "c1", "need1", "cand1", "r2", "c2", "need2", F.col("cand2").alias("stem"),
        ((F.col("route") == r.INFLECTED) & (F.col("tail") == "")).alias("is_self"),
    )


def found(words: DataFrame, rules: Ruleset, allow_prefix: bool = True, when: Column | None = None) -> DataFrame:
    """candidates() that meet a lexeme, or a stored form, a row for each: its columns, and the route
    STORED for stored forms. A word whose own spelling has neither, or for which `when` is false, keeps
    one row of route NOTHING; with levels every word has one at each level."""
    rows = candidates(words, rules, allow_prefix)
    rows = rules.looked_up(rows, F.col("stem"), "found").drop("found_closed")
    own = F.col("is_self") & (F.col("prefix") == "")
    rows = rows.where(F.col("found_lexemes").isNotNull() | own)
    lexemes = F.when(F.col("plain"), F.col("found_lexemes")).otherwise(F.slice("found_lexemes", 1, 0))
    entries = F.when(F.col("is_self"), F.concat(lexemes, "found_stored")).otherwise(F.col("found_lexemes"))
    if when is not None:
        entries = F.when(when, entries)
    if rules.levels:
        none = F.slice("found_lexemes", 1, 0)
        nothing = F.array(F.lit(None).cast(rows.schema["found_lexemes"].dataType.elementType))
        entries = F.when(own, F.concat(F.coalesce(entries, none, F.array().cast(rows.schema["found_lexemes"].dataType)), nothing)).otherwise(entries)
    rows = rows.withColumn("entries", entries).drop("stem", "found_lexemes", "found_stored")
    rows = rows.selectExpr("*", "inline_outer(entries)").drop("entries", "light").where(own | F.col("pos").isNotNull())
    if rules.levels:
        rows = rows.withColumn("level", F.explode(F.sequence(F.coalesce("level", F.lit(1)), F.lit(rules.levels))))
    route = F.when(F.col("stored_tag").isNotNull(), r.STORED).when(F.col("pos").isNull(), r.NOTHING).otherwise(F.col("route"))
    return rows.withColumn("route", route)


def accepted(rows: DataFrame, rules: Ruleset) -> DataFrame:
    """Rows of found() whose derivation the rules accept, with deriv, derived_pos, weight after layers, and inner_ord."""
    lang = rules.language
    two = F.col("r2.suffix") != ""
    inner = lambda x: F.when(two, F.col(f"r2.{x}")).otherwise(F.col(f"r1.{x}"))
    need, stem = F.when(two, F.col("need2")).otherwise(F.col("need1")), F.col("stem")
    shows = (
        F.when(need == "Y_FINAL", o.has_consonant_y(stem) | (F.col("stem_class") == "Y_FINAL"))
        .when(need == "SILENT_E", o.has_silent_e(stem) | (F.col("deriv_class") == "SILENT_E"))
        .when(need == "DOUBLE_CONS", F.col("stem_class") == "DOUBLE_CONS")
        .otherwise(True)
    )
    fits = F.array_contains(inner("sources"), F.col("pos")) & ((F.size(inner("classes")) == 0) | F.array_contains(inner("classes"), F.col("stem_class"))) & (F.length("stem") >= inner("min_stem")) & shows
    stacks = ~two | (F.array_contains("r1.sources", F.col("r2.derived")) & (F.length("stem") >= lang.stack_root) & (F.length("r2.suffix") >= lang.stack_suffix))
    derived = F.col("route") == r.DERIVED
    rows = rows.where((~derived | (fits & stacks)) & ((F.col("prefix") == "") | (F.col("pos") != "FUNC") | F.col("pos").isNull()))
    # Restrictions that ask the lexicon about the derived form; others ask it about the stem, to no effect.
    flags = [x[6] for x in lang.derivation]
    if any(flags):
        asks = derived & (inner("frequent_stem") | inner("not_closed"))
        rows = rules.looked_up(rows, F.when(asks, F.when(two, F.col("cand1")).otherwise(F.col("form"))).otherwise(F.coalesce("stem", "word")), "form")
        whole = heaviest(F.col("form_lexemes"), lambda x: x["known"])["weight"]
        frequent = ~inner("frequent_stem") | ~F.col("known") | whole.isNull() | (F.col("weight") >= whole)
        rows = rows.where(~asks | (frequent & ~(inner("not_closed") & F.coalesce("form_closed", F.lit(False))))).drop("form_lexemes", "form_stored", "form_closed")
    if any("NOT_CLOSED_CLASS" in x[6] and len(x[0]) >= lang.stack_suffix for x in lang.derivation):
        asks = derived & two & F.col("r1.not_closed")
        rows = rules.looked_up(rows, F.when(asks, F.col("form")).otherwise(F.coalesce("stem", "word")), "outer")
        rows = rows.where(~asks | ~F.coalesce("outer_closed", F.lit(False))).drop("outer_lexemes", "outer_stored", "outer_closed")
    layer = lambda w: (w * F.lit(lang.layer).cast("float")).cast("float")
    mark = lambda n: F.concat(F.lit("-"), F.col(f"r{n}.suffix"))
    long = lambda *xs: F.array(*(x.cast("long") for x in xs))
    first, second = (F.col("r1.rule_ord"), F.col("c1")), (F.col("r2.rule_ord"), F.col("c2"))
    last = (F.lit(0), F.col("lex_id"))
    return rows.withColumns({
        "deriv": F.when(two, F.array(mark(2), mark(1))).when(derived, F.array(mark(1))).otherwise(_none()),
        "derived_pos": F.when(derived, F.col("r1.derived")).otherwise(""),
        "weight": F.when(two, layer(layer(F.col("weight")))).when(derived, layer(F.col("weight"))).otherwise(F.col("weight")),
        "inner_ord": F.when(two, long(*first, F.lit(1), *second, *last)).otherwise(long(*first, *last)),
    })


def _none() -> Column:
    return F.array().cast("array<string>")


KEY = ["word", "lower", "stem", "pos", "prefix", "deriv", "features"]


def _read(words: DataFrame, rules: Ruleset, allow_prefix: bool = True, when: Column | None = None) -> DataFrame:
    """accepted() rows with an ending that their lexeme takes: the readings, not yet made distinct."""
    rows = accepted(found(words, rules, allow_prefix, when), rules)
    route, derived = F.col("route"), F.col("route") == r.DERIVED
    ends = F.broadcast(r.endings(rules.spark, rules.language).withColumnsRenamed({"pos": "epos", "classes": "e_classes"}))
    epos = F.when(derived, F.col("derived_pos")).otherwise(F.coalesce("pos", F.lit("")))
    # Stored forms and words without a reading are read as they stand.
    rows = rows.withColumns({"epos": epos, "kind": F.when(route >= r.STORED, 0).otherwise(F.col("kind"))}).join(ends, ["route", "kind", "tail", "epos"])
    guard = F.col("guard")
    return rows.where(
        F.col("e_classes").isNull()
        | F.array_contains("e_classes", F.when(derived, o.implied_class(F.col("form"))).otherwise(F.col("eff")))
        & ((guard == "") | ((guard == "takes_es") & F.col("takes_es")) | ((guard == "doubling_known") & F.col("doubling_known")))
        # A stored form blocks the rule; a noun's plural as it stands is never blocked.
        & (derived | ~F.array_contains("own_tags", F.col("tag")) | ((F.col("kind") == 0) & (F.col("pos") == "N")))
    )


def readings(words: DataFrame, rules: Ruleset, allow_prefix: bool = True, when: Column | None = None) -> DataFrame:
    """KEY, weight, emit and derived_pos of the distinct readings of words (word, lower), which must be distinct.

    emit orders them as the passes give them: stored forms, inflections by stem length, derivations,
    prefixes. A word without a reading (all words that `when` leaves out) has one row, or more, of nulls in stem and pos.
    """
    rows = _read(words, rules, allow_prefix, when)
    route, derived = F.col("route"), F.col("route") == r.DERIVED
    tags, long = F.array(*map(F.lit, rules.language.tags)), lambda *xs: F.array(*(x.cast("long") for x in xs))
    emit = (
        F.when(route == r.STORED, long(F.lit(0), F.col("lex_id"), F.array_position(tags, F.col("stored_tag"))))
        .when(derived, F.concat(long(F.lit(2), F.length("tail"), F.col("kind")), "inner_ord", long(F.col("tag_ord"))))
        .otherwise(long(F.lit(1), F.length("key") - F.length("tail"), F.col("kind"), F.col("lex_id"), F.col("tag_ord")))
    )
    tag = F.coalesce("stored_tag", "tag")
    rows = rows.withColumns({"features": F.when(tag.isNotNull(), F.array(tag)).otherwise(_none()), "emit": emit})
    rows = rows.groupBy(*KEY, *rules.by[1:], "prefix_ord").agg(F.max("weight").alias("weight"), F.min("emit").alias("emit"), F.min_by("derived_pos", "emit").alias("derived_pos"))
    prefixed = F.concat(long(F.lit(3), F.col("prefix_ord"), -F.col("weight") * 1e6), "emit")
    return rows.withColumn("emit", F.when(F.col("prefix") == "", F.col("emit")).otherwise(prefixed)).drop("prefix_ord")


def analyze(words: DataFrame, rules: Ruleset, allow_prefix: bool = True) -> DataFrame:
    """(word, stem, pos, features, weight, prefix, deriv, derived_pos, rank) of each distinct word, folded to a-z.

    rank orders a word's readings by falling weight, then as the passes give them: stored
    forms, inflections by stem length, derivations, prefixes. Words without a reading give no row.
    """
    words = dealt(words.where(F.col("word").isNotNull()).select(o.ascii_lower(F.col("word")).alias("word")), "word")
    rows = readings(words.withColumn("lower", F.col("word")), rules, allow_prefix).where(F.col("stem").isNotNull())
    order = Window.partitionBy(*rules.by).orderBy(F.col("weight").desc(), "emit", "stem", "pos")
    return rows.withColumn("rank", F.row_number().over(order)).select(*rules.by, "stem", "pos", "features", "weight", "prefix", "deriv", "derived_pos", "rank")


def read_words(words: DataFrame, rules: Ruleset) -> DataFrame:
    """(word): the distinct words, folded to a-z, that have a reading. What the readings are isn't worked out."""
    words = dealt(words.where(F.col("word").isNotNull()).select(o.ascii_lower(F.col("word")).alias("word")), "word")
    return _read(words.withColumn("lower", F.col("word")), rules).where(F.col("stem").isNotNull()).select("word").distinct()


def stem_lookup(words: DataFrame, rules: Ruleset) -> DataFrame:
    """(word, stem, pos, tail): lexemes that a word, or what a prefix leaves of it, begins with, whatever its
    rules say of the tail."""
    words = words.where(F.col("word").isNotNull()).select(o.ascii_lower(F.col("word")).alias("word")).distinct()
    rows = found(words.withColumn("lower", F.col("word")), rules).where((F.col("route") == r.INFLECTED) & (F.col("kind") == 0))
    return rows.select(F.col("key").alias("word"), "stem", "pos", "tail", "lex_id").distinct().drop("lex_id")


def irregular_lookup(words: DataFrame, rules: Ruleset) -> DataFrame:
    """(word, stem, pos, tag): what a word, or what a prefix leaves of it, is a stored form of."""
    words = words.where(F.col("word").isNotNull()).select(o.ascii_lower(F.col("word")).alias("word")).distinct()
    rows = found(words.withColumn("lower", F.col("word")), rules).where(F.col("route") == r.STORED)
    return rows.select(F.col("key").alias("word"), "stem", "pos", F.col("stored_tag").alias("tag"), "lex_id").distinct().drop("lex_id")


def _lines(analyses: DataFrame) -> DataFrame:
    """(word, all): the readings' strings in order."""
    one = o.analysis_string(F.col("stem"), F.col("pos"), F.col("features"), F.col("prefix"), F.col("deriv"))
    return analyses.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", one.alias("s")))), lambda x: x["s"]).alias("all"))


def analysis_text(analyses: DataFrame) -> DataFrame:
    """(word, n, text): a line for one reading, an indented list for several."""
    several = F.concat(F.col("word"), F.lit(" →\n  "), F.array_join("all", "\n  "))
    text = F.when(F.size("all") == 1, F.concat(F.col("word"), F.lit(" → "), F.get("all", F.lit(0)))).otherwise(several)
    return _lines(analyses).select("word", F.size("all").alias("n"), text.alias("text"))


def compact_text(words: DataFrame, analyses: DataFrame) -> DataFrame:
    """(word, text): a tab-separated line a word, all readings, or NO_ANALYSIS."""
    rows = _lines(analyses).select(F.col("word").alias("lower"), F.array_join("all", "\t").alias("all"))
    asked = words.select("word", o.ascii_lower(F.col("word")).alias("lower")).distinct()
    return asked.join(rows, "lower", "left").select("word", F.concat_ws("\t", "word", F.coalesce("all", F.lit("NO_ANALYSIS"))).alias("text"))


def detailed_text(words: DataFrame, analyses: DataFrame) -> DataFrame:
    """(word, text): of each distinct word its number of readings and the readings, numbered, a line each."""
    rows = _lines(analyses).withColumnRenamed("word", "lower")
    asked = words.select("word", o.ascii_lower(F.col("word")).alias("lower")).distinct().join(rows, "lower", "left")
    n = F.coalesce(F.size("all"), F.lit(0))
    n = F.when(F.col("all").isNull(), 0).otherwise(n).cast("string")
    numbered = F.transform("all", lambda x, i: F.concat(F.lit("  ["), (i + 1).cast("string"), F.lit("] "), x))
    readings_ = F.coalesce(F.array_join(numbered, "\n"), F.lit("  (no analysis found)"))
    return asked.select("word", F.concat(F.lit("Analysis of: "), "word", F.lit("\nFound "), n, F.lit(" reading(s):\n"), readings_).alias("text"))
