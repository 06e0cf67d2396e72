"""Golden readings of own words: each suffix, prefix, alternation and guard, stated independently of the rule tables."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from wordloom.functions import rules as ru
from wordloom.functions.local import local
from wordloom.operators import analyze as an
from wordloom.operators import segment as sg

STEMS = """crab N REG|lamp N REG|shout V REG|melt V REG|berry N Y_FINAL|bully V Y_FINAL|sturdy ADJ Y_FINAL|glide V SILENT_E|skip V DOUBLE_CONS|slim ADJ DOUBLE_CONS|bush N SIBILANT|tax V SIBILANT|stern ADJ REG
gloomy ADJ Y_FINAL|fair ADJ REG|wrap V DOUBLE_CONS|goose N IRR_MOUSE +PL=geese|deer N IRR_SHEEP +PL=deer|sink V IRR_SING +PAST=sank +PAST_PART=sunk|bad ADJ REG +COMP=worse|produce V SILENT_E|treat V REG|wash V SIBILANT
tide N SILENT_E|doubt N REG|root N REG|fame N SILENT_E|hero N SIBILANT|invent V REG|red ADJ DOUBLE_CONS|dust N REG|rare ADJ SILENT_E|tour N REG|art N REG|tempt V REG|guide V SILENT_E|exist V REG|priest N REG|lord N REG
star N REG|idol N REG|style N SILENT_E|solid ADJ REG|sad ADJ DOUBLE_CONS|sense N SILENT_E|cow N REG|act V REG|toast V REG|place V SILENT_E|clean V REG|rate V SILENT_E|smoker N REG|lock V REG|live V SILENT_E|lift V REG|author N REG|bet V DOUBLE_CONS"""
#: word, pieces, labels after the stem or before it, lemma, alternation.
CUTS = """crabs crab|s PL crab -;shouted shout|ed PAST shout -;shouting shout|ing ING shout -;melts melt|s 3SG melt -;berries berr|ies PL berry y_to_i;bullies bull|ies 3SG bully y_to_i;bullied bull|ied PAST bully y_to_i
bullying bully|ing ING bully -;sturdier sturd|ier COMP sturdy y_to_i;sturdiest sturd|iest SUP sturdy y_to_i;gliding glid|ing ING glide e_deletion;glided glide|d PAST glide -;glides glide|s 3SG glide -
skipped skip|ped PAST skip consonant_doubling;skipping skip|ping ING skip consonant_doubling;slimmer slim|mer COMP slim consonant_doubling;slimmest slim|mest SUP slim consonant_doubling;bushes bush|es PL bush epenthesis
taxes tax|es 3SG tax epenthesis;Crabs Crab|s PL crab -;CRABS CRAB|S PL crab -;Berries Berr|ies PL berry y_to_i;sterner stern|er COMP stern -;rarest rare|st SUP rare -"""
SUFFIXES = """sternness stern|ness stern;gloominess gloom|iness gloomy;sternly stern|ly stern;melter melt|er melt;production produc|tion produce;treatment treat|ment treat;washable wash|able wash;tidal tid|al tide;doubtful doubt|ful doubt
rootless root|less root;famous fam|ous fame;heroic hero|ic hero;inventive invent|ive invent;reddish red|dish red;dusty dust|y dust;rarity rar|ity rare;tourism tour|ism tour;artist art|ist art;invention invent|ion invent
temptation tempt|ation tempt;guidance guid|ance guide;existence exist|ence exist;priesthood priest|hood priest;lordship lord|ship lord;stardom star|dom star;idolize idol|ize idol;stylise styl|ise style;solidify solid|ify solid;sadden sad|den sad
treatments treat|ment|s treat;doubtfully doubt|ful|ly doubt;rootlessness root|less|ness root;idolized idol|ize|d idol"""
PREFIXES = "unfair un fair;rewrap re wrap;pretoast pre toast;displace dis place;misplace mis place;overact over act;underrate under rate;nonsmoker non smoker;antihero anti hero;detax de tax;outbet out bet;uplift up lift;subtour sub tour;interlock inter lock;coauthor co author"
WHOLE = "geese goose;deer deer;sank sink;sunk sink;worse bad;Geese goose"
#: No reading: suffixes that aren't rules, stems too short for one, stored forms that block, comparatives of derived forms.
NONE = "sensible coward arty artistic doubtfuler sinked badder bader zzq xy lamped deers' naïve"


def rows_of(text, width):
    rows = [x.split(" ") for line in text.splitlines() for x in line.split(";")]
    assert all(len(r) == width for r in rows)
    return rows


def lexicon(spark, stems=STEMS):
    rows = []
    for i, x in enumerate(y for line in stems.splitlines() for y in line.split("|")):
        stem, pos, stem_class, *stored = x.split(" ")
        rows.append((i, stem, pos, stem_class, 1.0, False, [tuple(s.split("=")) for s in stored]))
    return local(spark, rows, an.LEXEME)


@pytest.fixture(scope="module")
def best(spark):
    rules = an.Ruleset.of(lexicon(spark), local(spark, [("the",)], "word string"))
    words = [r[0] for r in rows_of(CUTS, 5)] + [r[0] for r in rows_of(SUFFIXES, 3)] + [r[0] for r in rows_of(PREFIXES, 3)] + [r[0] for r in rows_of(WHOLE, 2)] + NONE.split() + ["7!", "", "the"]
    return {r.word: r for r in sg.segment(local(spark, [(w,) for w in words], "word string"), rules, nbest=1).collect()}


def test_inflections_and_alternations(best):
    for word, pieces, label, lemma, alt in rows_of(CUTS, 5):
        r = best[word]
        assert ("|".join(r.pieces), r.labels, r.lemma, r.alt, r.gate, r.source) == (pieces, ["STEM", f"SUFFIX_{label}"], lemma, alt.replace("-", ""), "decomposed", "fst"), word
        assert r.offsets == [0, len(r.pieces[0]), len(word)]


def test_every_suffix(best):
    for word, pieces, lemma in rows_of(SUFFIXES, 3):
        r = best[word]
        assert ("|".join(r.pieces), r.lemma, r.labels[1]) == (pieces, lemma, "SUFFIX_DERIV"), word


def test_every_prefix(best):
    for word, prefix, stem in rows_of(PREFIXES, 3):
        r = best[word]
        assert (r.pieces, r.labels, r.lemma) == ([prefix, stem], ["PREFIX", "STEM"], stem), word


def test_stored_forms_stay_whole(best):
    for word, lemma in rows_of(WHOLE, 2):
        r = best[word]
        assert (r.pieces, r.labels, r.lemma, r.gate) == ([word], ["IRREGULAR"], lemma, "irregular"), word


def test_words_without_a_reading(best):
    for word in NONE.split():
        assert (best[word].pieces, best[word].gate, best[word].n_analyses, best[word].weight) == ([word], "no_analysis", 0, 0.0), word
    assert (best["7!"].gate, best[""].pieces, best[""].offsets, best[""].gate) == ("passthrough", [], [0], "passthrough")
    assert (best["the"].gate, best["the"].source) == ("no_analysis", "fallback")  # listed, but no lexeme


#: Lexemes with known weights; word; what stands first, and first with derived cuts promoted.
GUARDS = [
    ([("mild", "ADJ", 1.1), ("mildly", "ADV", 1.0)], "mildly", "mildly", "mild|ly"),
    ([("bare", "ADJ", 1.0), ("barely", "ADV", 1.1)], "barely", "barely", "barely"),  # commoner than its lemma, a short ending
    ([("frost", "N", 1.0), ("frosty", "ADJ", 1.0)], "frosty", "frosty", "frost|y"),
    ([("paint", "V", 1.0), ("painter", "N", 1.2)], "painter", "painter", "painter"),
    ([("amuse", "V", 0.9), ("amusement", "N", 1.2)], "amusement", "amusement", "amuse|ment"),  # a long ending isn't asked for counts
    ([("ox", "N", 1.0), ("oxish", "ADJ", 0.9)], "oxish", "oxish", "oxish"),  # a lemma of two letters
    ([("wise", "ADJ", 1.0), ("unwise", "ADJ", 0.9)], "unwise", "un|wise", "un|wise"),
    ([("wise", "ADJ", 0.9), ("unwise", "ADJ", 1.1)], "unwise", "unwise", "unwise"),  # the prefixed word is the commoner one
    ([("seat", "N", 1.0)], "reseat", "re|seat", "re|seat"),
    ([("is", "N", 1.0)], "unis", "un|is", "un|is"),
]


def test_guards(spark):
    for i, (lexemes, word, first, promoted) in enumerate(GUARDS):
        rows = [(k, s, p, {"bare": "SILENT_E", "amuse": "SILENT_E", "wise": "SILENT_E"}.get(s, "REG"), w, True, []) for k, (s, p, w) in enumerate(lexemes)]
        rules = an.Ruleset.of(local(spark, rows, an.LEXEME))
        df = local(spark, [(word,)], "word string")
        cuts = sg.cuts(df, rules).cache()
        got = ["|".join(sg.ranked(cuts, d).where("rank = 1").first().pieces) for d in (False, True)]
        assert got == [first, promoted], (i, word, got)


def test_short_capitals_stand_for_themselves(spark):
    rules = an.Ruleset.of(local(spark, [(0, "is", "N", "REG", 1.0, False, [])], an.LEXEME))
    found = sg.segment(local(spark, [("UNIS",), ("unis",)], "word string"), rules).orderBy("word", "rank").collect()
    assert [("|".join(r.pieces), r.rank, r.demoted, r.source) for r in found] == [("UNIS", 1, False, "fallback"), ("UN|IS", 2, True, "fst"), ("un|is", 1, True, "fst")]


def test_a_language_of_its_own(spark):
    """A rule, a prefix and an ending that English doesn't have, and none that it has."""
    own = dataclasses.replace(ru.ENGLISH, derivation=(("lijk", ["N"], "ADJ", [], False, 3, ""), ("achtig", ["N"], "ADJ", [], False, 3, "NOT_CLOSED_CLASS")), prefixes=(("ont", ["N"]),), inflection=((0, "jes", "N", ["REG"], "+PL", ""),), outer=())
    lex = local(spark, [(0, "vriend", "N", "REG", 1.0, False, []), (1, "kind", "N", "REG", 1.0, False, [])], an.LEXEME)
    rules = an.Ruleset.of(lex, local(spark, [("kindachtig",)], "word string"), own)
    words = ["vriendlijk", "vriendjes", "ontvriend", "vriends", "unkind", "vriendachtig", "kindachtig"]
    best = {r.word: "|".join(r.pieces) for r in sg.segment(local(spark, [(w,) for w in words], "word string"), rules, nbest=1).collect()}
    assert best == {"vriendlijk": "vriend|lijk", "vriendjes": "vriend|jes", "ontvriend": "ont|vriend", "vriends": "vriends", "unkind": "unkind", "vriendachtig": "vriend|achtig", "kindachtig": "kindachtig"}


def test_a_large_lexicon_is_shuffled_to(spark):
    """The same rows without a broadcast."""
    lex, closed = lexicon(spark), local(spark, [("the",)], "word string")
    words = local(spark, [(r[0],) for r in rows_of(SUFFIXES, 3)] + [("unfair",), ("x",)], "word string")
    small, large = an.Ruleset.of(lex, closed), an.Ruleset.of(lex, closed, broadcast_lexemes=3)
    assert small.small and not large.small
    assert sorted(map(str, sg.segment(words, small).collect())) == sorted(map(str, sg.segment(words, large).collect()))


def test_queries_meet_every_suffix_and_prefix(spark):
    from wordloom.plans import registry

    found = registry.QUERIES["derivations"](spark, "/root/testdata/sf0.001").collect()
    assert {x[0] for x in ru.DERIVATION} <= {s[1:] for r in found for s in r.deriv.split(" ")}
    assert {p for p, _ in ru.PREFIXES} == {r.prefix for r in registry.QUERIES["prefix_strip"](spark, "/root/testdata/sf0.001").collect()}
    w = registry.counts(spark, "/root/testdata/sf0.001").select(F.col("item").alias("word"))
    assert registry.mined_rules(w).lexeme.count() > 500
