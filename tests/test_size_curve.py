"""Nested lexicons in one segmentation: equal to a segmentation by each."""

from pyspark.sql import functions as F

from wordloom.functions.local import local
from wordloom.operators import analyze as an
from wordloom.operators import evaluate
from wordloom.operators.segment import segment

# stem, part of speech, class, weight, stored forms, level. Larger lexicons add heavier wholes, closed bases and stored
# forms, so that what a smaller one reads, a larger one may not.
LEXEMES = [
    ("glad", "ADJ", "REG", 0.9, {}, 1), ("gladden", "V", "REG", 1.2, {}, 3), ("rain", "N", "REG", 0.8, {}, 1), ("rainy", "ADJ", "Y_FINAL", 1.1, {}, 2), ("do", "V", "REG", 1.0, {}, 2), ("undo", "V", "REG", 1.3, {}, 4),
    ("tie", "V", "SILENT_E", 1.0, {}, 1), ("untie", "V", "SILENT_E", 1.2, {}, 3), ("hope", "N", "SILENT_E", 1.0, {}, 2), ("hopeful", "ADJ", "REG", 1.0, {}, 4), ("mark", "N", "REG", 0.9, {}, 1), ("marks", "N", "REG", 1.3, {}, 4),
    ("goose", "N", "SILENT_E", 0.9, {"+PL": "geese"}, 3), ("run", "V", "DOUBLE_CONS", 1.0, {"+PAST": "ran"}, 2), ("run", "N", "REG", 1.1, {}, 4), ("er", "N", "REG", 0.8, {}, 3), ("use", "N", "SILENT_E", 0.7, {}, 1),
]
WORDS = "gladness gladly gladden gladdens rainy rains rain undo undoing do doing untied tied hopefulness hopeful hopes marks mark geese goose runs running runner ran useful useless user unglad REUSE the of x1 12".split()


def table(spark, level):
    rows = [(i, s, p, c, float(w), i % 3 > 0, list(f.items()), n) for i, (s, p, c, w, f, n) in enumerate(LEXEMES) if n <= level]
    return local(spark, rows, f"{an.LEXEME}, level int")


def test_records_and_curve_at_each_level(spark):
    closed = local(spark, [("the",), ("of",), ("do",)], "word string")
    words, counts = local(spark, [(w,) for w in WORDS], "word string"), local(spark, [(w, i + 1) for i, w in enumerate(WORDS)], "item string, cnt long")
    gold = local(spark, [("gladness", ["glad", "ness"]), ("runs", ["run", "s"]), ("runs", ["runs"]), ("hopefulness", ["hope", "ful", "ness"]), ("geese", ["geese"]), ("marks", ["mark", "s"])], "word string, pieces array<string>")
    nested = an.Ruleset.of(table(spark, 4), closed)
    assert nested.levels == 4
    fields = ["word", "rank", "pieces", "labels", "lemma", "alt", "source", "gate", "n_analyses", "weight", "demoted", "promotable"]
    records = {(d, n): set() for d in (False, True) for n in (1, 2, 3, 4)}
    for d in (False, True):
        for r in segment(words, nested, derived_first=d).collect():
            records[d, r.level].add(repr([r[c] for c in fields]))
    readings = {n: set() for n in (1, 2, 3, 4)}
    for r in an.analyze(words, nested).collect():
        readings[r.level].add((r.word, r.stem, r.pos, tuple(r.features), r.prefix, tuple(r.deriv), r["rank"]))
    curve = {r.level: r for r in evaluate.size_curve(counts, nested, gold).collect()}
    for n in (1, 2, 3, 4):
        rules = an.Ruleset.of(table(spark, n).drop("level"), closed)
        for d in (False, True):
            assert records[d, n] == {repr([r[c] for c in fields]) for r in segment(words, rules, derived_first=d).collect()}, (n, d)
        assert readings[n] == {(r.word, r.stem, r.pos, tuple(r.features), r.prefix, tuple(r.deriv), r["rank"]) for r in an.analyze(words, rules).collect()}
        best = segment(words, rules, nbest=1)
        scores = {r.scope: r for r in evaluate.strict_scores(evaluate.scored(best, gold)).collect()}
        assert (curve[n].lexemes, curve[n].f1, curve[n].f1_with_misses) == (table(spark, n).count(), scores["analysed"].f1, scores["all"].f1)
        fst = {r.word for r in best.where("source = 'fst'").collect()}
        assert curve[n].type_fst == round(len(fst) / len(WORDS), 6) and curve[n].token_fst == round(sum(i + 1 for i, w in enumerate(WORDS) if w in fst) / sum(range(1, len(WORDS) + 1)), 6)
    assert len({repr(x) for x in records.values()}) > 4
    assert evaluate.size_curve(counts, nested).where(F.col("lexemes") == len(LEXEMES)).count() == 1
