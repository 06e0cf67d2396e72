"""Golden cases, invariants and the read-back property."""

import pytest
from pyspark.sql import functions as F

from wordloom.functions import orthography as o
from wordloom.functions.local import local
from wordloom.operators import analyze as an
from wordloom.operators import generate
from wordloom.operators import segment as sg
from wordloom.sources import lexicon as lx


@pytest.fixture(scope="module")
def rules(spark):
    lex = lx.builtin(spark).cache()
    return an.Ruleset.of(lex, lx.builtin_closed(spark))


ANALYSES = {
    "stories": ["story +N +PL"], "flies": ["fly +N +PL", "fly +V +3SG"], "planned": ["plan +V +PAST", "plan +V +PAST_PART"], "baked": ["bake +V +PAST", "bake +V +PAST_PART"],
    "unkind": ["un+kind +ADJ", "un+kind +N"], "brought": ["bring +V +PAST", "bring +V +PAST_PART"], "swam": ["swim +V +PAST"], "Best": ["good +ADJ +SUP"], "argument": ["argue -ment +V"],
    "formality": ["form -al -ity +N"], "nationality": ["national -ity +ADJ", "nation -al -ity +N"], "unable": ["un+can +V +PRES_PART"], "reddest": ["red +ADJ +SUP"],
    "kingdoms": ["king -dom +N +PL"], "redness": [], "swimmed": [], "cat's": [], "bakeed": ["bake +V +PAST", "bake +V +PAST_PART"], "flyed": [], "baking": ["bake +V +PRES_PART"],
}
#: word, pieces, labels, lemma, alternation, gate; rank 1.
CUTS = [
    ("stories", "stor|ies", "STEM|SUFFIX_PL", "story", "y_to_i", "decomposed"), ("flies", "fl|ies", "STEM|SUFFIX_3SG", "fly", "y_to_i", "decomposed"), ("planned", "plan|ned", "STEM|SUFFIX_PAST", "plan", "consonant_doubling", "decomposed"),
    ("baked", "bake|d", "STEM|SUFFIX_PAST", "bake", "", "decomposed"), ("unkind", "un|kind", "PREFIX|STEM", "kind", "", "decomposed"), ("churches", "church|es", "STEM|SUFFIX_PL", "church", "epenthesis", "decomposed"),
    ("Unable", "Unable", "IRREGULAR", "can", "", "irregular"), ("friendships", "friend|ship|s", "STEM|SUFFIX_DERIV|SUFFIX_PL", "friend", "", "decomposed"), ("KINDNESS", "KIND|NESS", "STEM|SUFFIX_DERIV", "kind", "", "decomposed"),
    ("12", "12", "UNK", "", "", "passthrough"), ("naïve", "naïve", "UNK", "", "", "no_analysis"), ("", "", "", "", "", "passthrough"), ("argument", "argu|ment", "STEM|SUFFIX_DERIV", "argue", "e_deletion", "decomposed"),
]


def test_readings(spark, rules):
    df = local(spark, [(w,) for w in ANALYSES] + [(None,)], "word string")
    one = o.analysis_string(F.col("stem"), F.col("pos"), F.col("features"), F.col("prefix"), F.col("deriv"))
    found = {}
    for r in an.analyze(df, rules).select("word", "rank", one.alias("s")).orderBy("word", "rank").collect():
        found.setdefault(r.word, []).append(r.s)
    assert {w: found.get(w.lower(), []) for w in ANALYSES} == ANALYSES


def test_records(spark, rules):
    fuzz = ["éa", "a" * 300, "x-y", "\t", "IT", "UPS", "ﬁ", "ſtop", "K", "0x", "don't"]
    df = local(spark, [(c[0],) for c in CUTS] + [(w,) for w in fuzz] + [(w,) for w in ANALYSES], "word string")
    a, b = sg.segment(df, rules).cache(), sg.segment(df, rules, derived_first=True).cache()
    best = {r.word: r for r in a.where("rank = 1").collect()}
    for word, pieces, labels, lemma, alt, gate in CUTS:
        r = best[word]
        assert ("|".join(r.pieces), "|".join(r.labels), r.lemma, r.alt, r.gate) == (pieces, labels, lemma, alt, gate), word
    assert sg.violations(a).count() == sg.violations(b).count() == 0
    # Policies order the same set of readings differently.
    cols = [c for c in a.columns if c not in ("rank", "demoted", "promotable")]
    assert a.select(*cols).exceptAll(b.select(*cols)).count() == 0 == b.select(*cols).exceptAll(a.select(*cols)).count()
    assert sorted(map(str, a.collect())) == sorted(map(str, sg.segment(df.repartition(3), rules).collect()))
    line = {r.word: r.value for r in sg.jsonl(a, 2).collect()}["flies"]
    assert line.startswith('{"word": "flies", "pieces": ["fl", "ies"], "offsets": [0, 2, 5], "labels": ["STEM", "SUFFIX_3SG"], "lemma": "fly"') and '"weight": 1, "alternatives": [{"word"' in line


def test_prefix_guard(spark):
    lex = [(0, "happy", "ADJ", "Y_FINAL", 1.0, True, []), (1, "unhappy", "ADJ", "Y_FINAL", 0.9, True, []), (2, "read", "V", "REG", 0.9, True, []), (3, "reread", "V", "REG", 1.2, True, [])]
    r = an.Ruleset.of(local(spark, lex, an.LEXEME))
    found = {(x.word, "|".join(x.pieces)): x.demoted for x in sg.segment(local(spark, [("unhappiness",), ("reread",), ("reads",)], "word string"), r).collect()}
    assert found[("unhappiness", "un|happ|iness")] is False and found[("reread", "re|read")] is True and found[("reads", "read|s")] is False


def test_generated_forms_read_back(rules):
    forms = generate.generated_forms(rules).cache()
    assert {"citation", "+PL", "irregular +PAST", "deriv -ness", "prefix un-"} <= {r[0] for r in forms.select("origin").distinct().collect()}
    left = generate.unread(rules, forms.where("not startswith(origin, 'prefix') and not startswith(origin, 'deriv')"))
    assert left.count() == 0


def test_number_format(spark):
    df = local(spark, [(1.0,), (0.9,), (0.81,), (0.729,), (100000.0,), (1234567.0,), (float("nan"),), (0.0,)], "w double")
    assert [r[0] for r in df.select(o.six_digits(F.col("w"))).collect()] == ["1", "0.9", "0.81", "0.729", "100000", "1.23457e+06", "0", "0"]


def test_matching(spark):
    df = local(spark, [([3, 5], [3, 6]), ([4], [3, 5]), ([], [2]), ([2, 3], [3])], "a array<int>, b array<int>")
    got = [tuple(r) for r in df.select(o.matched(F.col("a"), F.col("b")), o.matched(F.col("a"), F.col("b"), 1)).collect()]
    assert got == [(1, 2), (0, 1), (0, 0), (1, 1)]
