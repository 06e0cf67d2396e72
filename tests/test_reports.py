"""Reports and sinks: detailed text, shares by gate, layers, decoders, prefix rules, written tables."""

import json

import pytest
from pyspark.sql import functions as F

from wordloom.functions import orthography as o
from wordloom.functions import rules as r
from wordloom.functions.local import local
from wordloom.operators import analyze as an
from wordloom.operators import evaluate, segment, tokens
from wordloom.plans import registry
from wordloom.sources import lexicon as lx


def text_in(path) -> list[str]:
    return "".join(p.read_text() for p in sorted(path.glob("part-*"))).splitlines()


def test_texts_of_readings(spark):
    rules = an.Ruleset.of(lx.builtin(spark), lx.builtin_closed(spark))
    words = local(spark, [("cats",), ("Books",), ("zzz",)], "word string")
    found = an.analyze(words, rules)
    said = {x.word: x.text for x in an.detailed_text(words, found).collect()}
    assert said["cats"] == "Analysis of: cats\nFound 1 reading(s):\n  [1] cat +N +PL" and said["zzz"] == "Analysis of: zzz\nFound 0 reading(s):\n  (no analysis found)"
    lines = said["Books"].split("\n")
    assert lines[0] == "Analysis of: Books" and [x[:5] for x in lines[2:]] == [f"  [{i + 1}]" for i in range(len(lines) - 2)]
    two = local(spark, [("saw", "saw", "N", [], 1.0, "", [], "", 1), ("saw", "see", "V", ["+PAST"], 0.9, "", [], "", 2)], "word string, stem string, pos string, features array<string>, weight float, prefix string, deriv array<string>, derived_pos string, rank int")
    assert an.analysis_text(two).first().text == "saw →\n  saw +N\n  see +V +PAST"


def test_layers_gates_and_gap(spark):
    pred = local(spark, [("hopefulness", ["hopeful", "ness"], "decomposed"), ("uselessly", ["use", "less", "ly"], "decomposed"), ("rainbows", ["rainbow", "s"], "decomposed"), ("unheard", ["unheard"], "lexicon_stem"), ("12", ["12"], "passthrough"), ("redo", ["redo"], "irregular")], "word string, pieces array<string>, gate string")
    gold = local(spark, [("hopefulness", ["hope", "ful", "ness"]), ("uselessly", ["use", "less", "ly"]), ("rainbows", ["rain", "bow", "s"]), ("unheard", ["un", "heard"]), ("12", ["1", "2"]), ("redo", ["re", "do"]), ("gone", ["go", "ne", "x"])], "word string, pieces array<string>")
    rows = evaluate.scored(pred, gold).cache()
    free, suffixes = local(spark, [(w,) for w in ("rain", "bow", "hope", "heard", "do")], "word string"), local(spark, [("ful",), ("ness",), ("s",)], "affix string")
    gap = lambda p: {x.bucket: x.n for x in evaluate.recall_gap(rows, free, suffixes, p).collect()}
    assert gap(None) == {"inner_layer_of_a_multi_layer_form": 1, "compound": 1, "affix_the_rules_do_not_have": 2, "no_analysis_of_the_word": 1}
    assert gap(local(spark, [("un",), ("re",)], "affix string")) == {"inner_layer_of_a_multi_layer_form": 1, "compound": 1, "known_affix_not_stripped": 2, "no_analysis_of_the_word": 1}
    assert tuple(evaluate.layer_counts(rows).first()) == (3, 1, 1)
    assert {(x.gate, x.words, x.share) for x in evaluate.gate_shares(pred).collect()} == {("decomposed", 3, 0.5), ("lexicon_stem", 1, 0.166667), ("passthrough", 1, 0.166667), ("irregular", 1, 0.166667)}


def test_decoders_that_disagree(spark):
    counts = local(spark, [("ab", 3), ("a b", 2), ("c", 1)], "item string, cnt long")
    encoded = local(spark, [("ab", ["a", "b"]), ("a b", ["a", " b"]), ("c", ["d"])], "word string, pieces array<string>")
    joined = F.array_join("pieces", "")
    x = evaluate.round_trips(counts, encoded, joined, F.replace(joined, F.lit(" "), F.lit(""))).first()
    assert (x.types, x.types_exact, x.tokens, x.tokens_exact, x.example, x.other_disagrees, x.other_example) == (3, 2, 6, 5, "c", 2, "a b")


def test_prefix_rules_from_a_file(spark, tmp_path):
    (tmp_path / "p.tsv").write_text("# prefixes\nsuper\tN ADJ\n\nun\tADJ\nbare\n")
    rows = [(x.prefix, x.attaches, x.prefix_ord) for x in lx.read_prefix_rules(spark, str(tmp_path / "p.tsv")).orderBy("prefix_ord").collect()]
    assert rows == [("super", ["N", "ADJ"], 0), ("un", ["ADJ"], 1), ("bare", [""], 2)]
    language = r.Language(prefixes=tuple((p, a) for p, a, _ in rows))
    rules = an.Ruleset.of(lx.builtin(spark), lx.builtin_closed(spark), language)
    assert [(x.prefix, x.stem) for x in an.analyze(local(spark, [("supercat",), ("recat",)], "word string"), rules).collect()] == [("super", "cat")]


def test_a_session_names_its_lexicon(spark, tmp_path):
    (tmp_path / "more.tsv").write_text("zebra\tN\tREG\nquux\tV\tREG\tPAST=quuxen\n")
    (tmp_path / "closed.tsv").write_text("# words\nhenceforth\tADV\n")
    spark.conf.set(lx.LEXICON_FILES, f"{tmp_path}/more.tsv")
    spark.conf.set(lx.CLOSED_FILES, f"{tmp_path}/closed.tsv")
    try:
        rules = an.Ruleset.of(lx.builtin(spark), lx.builtin_closed(spark))
        found = {(x.word, x.stem) for x in an.analyze(local(spark, [("zebras",), ("quuxen",), ("cats",)], "word string"), rules).collect()}
        assert found == {("zebras", "zebra"), ("quuxen", "quux"), ("cats", "cat")}
        assert lx.builtin_closed(spark).where("word in ('henceforth', 'the')").count() == 2
        spark.conf.set(lx.LEXICON_FILES, f"{tmp_path}/none.tsv")
        with pytest.raises(FileNotFoundError):
            lx.builtin(spark)
    finally:
        spark.conf.unset(lx.LEXICON_FILES)
        spark.conf.unset(lx.CLOSED_FILES)


def test_table_functions_in_sql(spark):
    from wordloom.plans import views

    rules = an.Ruleset.of(lx.builtin(spark), lx.builtin_closed(spark))
    words = local(spark, [("cats",), ("Books",), ("stopped",), ("zzz",)], "word string")
    assert views.functions(words, rules, "t_") == ["t_analyze", "t_segment"]
    assert [(x.stem, x.features) for x in spark.sql("SELECT * FROM t_analyze('cats') ORDER BY rank").collect()] == [("cat", ["+PL"])]
    assert spark.sql("SELECT * FROM t_segment('stopped')").first().pieces == ["stop", "ped"]
    words.createOrReplaceTempView("some_words")
    rows = spark.sql("SELECT w.word, s.pieces, s.gate FROM some_words w, LATERAL t_segment(w.word) s").collect()
    best = {x.word: (x.pieces, x.gate) for x in segment.segment(words, rules, nbest=1).collect()}
    assert {x.word: (x.pieces, x.gate) for x in rows} == best
    left = spark.sql("SELECT w.word, a.stem FROM some_words w LEFT JOIN LATERAL t_analyze(w.word) a ON true").collect()
    assert {(x.word, x.stem) for x in left} == {("cats", "cat"), ("stopped", "stop"), ("zzz", None)} | {("Books", x.stem) for x in an.analyze(words, rules).where("word = 'books'").collect()}
    more = spark.sql("SELECT count(*) n FROM some_words w, LATERAL t_segment(w.word, 9) s").first().n
    assert more == segment.segment(words, rules).count()


def test_sinks(spark, tmp_path):
    lx.write_frequency(local(spark, [("b", 3.456), ("a", 3.456), ("c", 7.0)], "word string, zipf double"), str(tmp_path / "f"))
    assert text_in(tmp_path / "f") == ["c\t7.00", "a\t3.46", "b\t3.46"]
    lx.write_counts(local(spark, [("b", 1), ("a", 1), ("c", 5)], "item string, cnt long"), str(tmp_path / "c"))
    assert text_in(tmp_path / "c") == ["c\t5", "a\t1", "b\t1"]
    lx.write_report(local(spark, [("x", 1.5)], "name string, value double"), str(tmp_path / "r"))
    assert [json.loads(x) for x in text_in(tmp_path / "r")] == [{"name": "x", "value": 1.5}]


def test_union_of_lexicons_keeps_order_and_repeats(spark):
    one = local(spark, [(0, "cat", "N", "REG", 1.0, False, []), (1, "dog", "N", "REG", 1.0, False, [])], an.LEXEME)
    both = lx.merged(one, one).orderBy("lex_id").collect()
    assert [x.stem for x in both] == ["cat", "dog", "cat", "dog"] and len({x.lex_id for x in both}) == 4


def test_small_text_helpers(spark):
    df = local(spark, [(1, "a\r\nb1 é-x\n", )], "doc_id long, text string")
    assert df.select(o.clean_line(F.col("text"))).first()[0] == "ab1 é-x"
    assert [x.unit for x in tokens.word_stream(df).orderBy("pos").collect()] == ["a", "b", "é", "x"]
    assert tokens.spaced_lines(df).first().text == "a b 1 é - x"


def test_a_record_with_every_field_is_json(spark):
    rules = an.Ruleset.of(lx.builtin(spark), lx.builtin_closed(spark))
    out = segment.jsonl(segment.segment(local(spark, [('q"\\\x01é',), ("cats",)], "word string"), rules, nbest=1))
    assert {json.loads(x.value)["word"] for x in out.collect()} == {'q"\\\x01é', "cats"}


def test_starts_of_many_tokens(spark):
    """Over several stretches of stretches, and none."""
    texts = ["", " ", "a", "ab c " * 64, "ab  c. " * 9000, "x " * 127 + "y"]
    got = {}
    for x in tokens.tokens(local(spark, list(enumerate(texts)), "doc_id int, text string")).collect():
        got.setdefault(x.doc_id, []).append((x.pos, x.start, x.text, x.ws_before))
    for i, t in enumerate(texts):
        rows = sorted(got.get(i, []))
        assert "".join(w + s for _, _, s, w in rows) == t
        assert all(t[at : at + len(s)] == s for _, at, s, _ in rows if s)


@pytest.mark.parametrize("name", ["lexical_forms", "size_curve", "trie_size", "generated_forms", "gate_shares"])
def test_queries_have_sql(name):
    assert name in registry.QUERIES and name in registry.ORACLES
