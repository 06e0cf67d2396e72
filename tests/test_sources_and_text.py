"""Readers with their error rules, tokens, lexicon building, evaluation, automata and streams."""

import json
import re
import zipfile
from collections import Counter

import pytest
import regex
from pyspark.sql import functions as F

from wordloom.functions import orthography as o
from wordloom.functions.local import local
from wordloom.operators import analyze as an
from wordloom.operators import automata, build, evaluate, stats, tokens
from wordloom.sources import lexicon as lx

TEXTS = ["One. Two! three", "a\n\n b\t", "  lead", "Dr. Smith isn't well-known.", "x\r\ny\r\n", "", "no end", "$3.50, 12%!", "—dash…é", "   "]


def test_lexicon_lines(spark):
    lines = ["# c", "", "cat N REG", "run V DOUBLE_CONS PAST=ran PAST_PART=run PAST=raan WEIGHT=1.1", "bad N NOPE", "odd XX REG FOO=odds WEIGHT=abc token", "two N", "soft ADJECTIVE REG WEIGHT=0.9 COMP=a=b"]
    rows = lx.lexicon_rows(lx.text_lines(spark, "\n".join(lines))).orderBy("line_no").collect()
    assert [r.reason for r in rows] == ["comment", "comment", None, None, "class", None, "short", None]
    assert (rows[3].irregular, round(rows[3].weight, 2), rows[3].weight_known) == ({"+PAST": "raan", "+PAST_PART": "run"}, 1.1, True)
    assert (rows[5].pos, rows[5].irregular, rows[5].weight_known, rows[5].weight) == ("N", {"+PL": "odds"}, False, 1.0)
    assert (rows[7].pos, rows[7].irregular) == ("ADJ", {"+COMP": "a=b"})


def test_files_and_sinks(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        lx.builtin(spark, str(tmp_path / "none.tsv"))
    (tmp_path / "a.tsv").write_text("zed N REG WEIGHT=0.8 PLURAL=zedz\r\n")
    lex = lx.builtin(spark, str(tmp_path / "a.tsv"), optional=(str(tmp_path / "none.tsv"),))
    assert lex.orderBy(F.desc("lex_id")).first().stem == "zed"
    lx.write_lexicon(lex.where("stem = 'zed'"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == "zed\tN\tREG\tPLURAL=zedz\tWEIGHT=0.8"
    again = lx.lexicon(lx.lines(spark, str(tmp_path / "out")))
    assert again.first().irregular == {"+PL": "zedz"}
    assert lx.closed_class(lx.text_lines(spark, "# x\nThe det\nof\n\nthe")).count() == 2
    assert [tuple(r) for r in lx.frequency(lx.text_lines(spark, "# h\na\t4.2\nb\tx\nc")).collect()] == [("a", 4.2)]
    g = lx.gold_rows(lx.text_lines(spark, "cats\tcat|s\nx\ta|b\ndog\nab\ta||b\ncats\tca|ts"))
    assert [r.reason for r in g.orderBy("line_no").collect()] == [None, "pieces don't rebuild the word", "columns", "empty piece", None]
    assert lx.gold(lx.text_lines(spark, "cats\tcat|s\ncats\tca|ts")).first().pieces == ["ca", "ts"]
    stats_ = lx.load_stats(local(spark, [(0, "car", "N", "REG", 1.0, False, []), (1, "cat", "N", "REG", 1.0, False, [])], an.LEXEME)).first()
    assert tuple(stats_) == (2, 5, 4)


def test_other_gold(spark):
    rows = local(spark, [("walk", "walked", "V|PST", "walk|ed"), ("go", "went", "V|PST", "went"), ("cat", "cat", "N|SG", "cat"), ("Él", "els", "N", "")], "lemma string, form string, feature string, seg string")
    assert [(r.pieces, r.reason) for r in lx.inflection_gold(rows).collect()] == [(["walk", "ed"], None), (["", "went"], "nothing shared"), (["cat", ""], "unchanged"), (["", "els"], "characters")]
    rows = local(spark, [("kind", "unkind", "un", "prefix"), ("kind", "kindness", "ness", "suffix"), ("kind", "rekind", "un", "prefix")], "source string, target string, affix string, kind string")
    assert [(r.pieces, r.reason) for r in lx.derivation_gold(rows).collect()] == [(["un", "kind"], None), (["kind", "ness"], None), (["un", "kind"], "prefix absent")]
    rows = local(spark, [("unkindness", "<un<(kind)>ness>"), ("cats", "{(cat)}>s>"), ("bad", "{(b-ad)}"), ("x", "")], "word string, parse string")
    assert {r.form: r.pieces for r in lx.parsed_gold(rows).collect()} == {"unkindness": ["un", "kind", "ness"], "cats": ["cat", "s"]}


def test_workbook(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Word</t></si><si><t>MorphoLexSegm</t></si><si><r><t>ca</t></r><r><t>ts</t></r></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2" t="s"><v>2</v></c><c r="C2" t="inlineStr"><is><t>(cat)&gt;s&gt;</t></is></c></row></sheetData></worksheet>')
    assert [tuple(r) for r in lx.read_xlsx(spark, str(tmp_path / "a.xlsx")).collect()] == [("cats", "(cat)>s>")]


def test_tokens_round_trip(spark):
    docs = local(spark, list(enumerate(TEXTS)) + [(99, None)], "doc_id long, text string")
    toks = tokens.tokens(docs).cache()
    assert {r.doc_id: r.text for r in tokens.rebuilt(toks).collect()} == {i: t for i, t in enumerate(TEXTS) if t}
    for r in toks.collect():
        assert TEXTS[r.doc_id][r.start : r.start + len(r.text)] == r.text
    kinds = [(r.text, r.kind) for r in toks.where("doc_id in (3, 7)").orderBy("doc_id", "pos").collect()]
    assert kinds == [("Dr.", "ABBREVIATION"), ("Smith", "WORD"), ("isn't", "CONTRACTION"), ("well-known", "HYPHENATED"), (".", "PUNCT"), ("$3.50", "NUMBER"), (",", "PUNCT"), ("12%", "NUMBER"), ("!", "PUNCT")]
    said = [(r.sentence, r.word) for r in tokens.sentences(toks).where("doc_id = 0").orderBy("pos").collect()]
    assert said == [(0, "One"), (1, "Two"), (2, "three")]
    rules = an.Ruleset.of(lx.builtin(spark), lx.builtin_closed(spark))
    seg = tokens.segmented_text(local(spark, [(0, "The cats  walked, 3x\n")], "doc_id long, text string"), rules).orderBy("pos").collect()
    assert "".join(r.ws_before + "".join(r.pieces) for r in seg) == "The cats  walked, 3x\n" and ["|".join(r.pieces) for r in seg][1:3] == ["cat|s", "walk|ed"]
    assert tokens.corpus_counts(local(spark, [("It @-@ don't 'tis A@.@b",)], "text string")).count() == 5


#: Every kind of token.
ALL_KINDS = [
    "Mr. Smith's well-known dog, e.g. Rex, ate $3.50 or 12% of it... No. 7 didn't! Was it A.M.? Yes",
    "  Prof. O’Neil-like re-entry\tcosts 1,000.5 in U.S. terms. Ça n’est rien; naïve x2 café-bar's\n",
    "plain words only. And more", "'tis ’quoted’ rock'n'roll",
]


def brute_tokens(text):
    out, at = [], 0
    kinds = [(k, regex.compile(p)) for k, p in tokens.KINDS]
    while at < len(text):
        gap = regex.compile(r"\s*").match(text, at).end()
        if gap == len(text):
            break
        kind, m = next((k, m) for k, p in kinds if (m := p.match(text, gap)))
        out.append((len(out), m[0], kind, gap, text[at:gap]))
        at = m.end()
    return out


def test_text_queries_read_every_text(spark, tmp_path):
    from wordloom.plans import registry

    for name, key in (("benchmark", "item_id"), ("documents", "doc_id")):
        spark.createDataFrame(list(enumerate(ALL_KINDS)), f"{key} long, text string").write.parquet(str(tmp_path / f"{name}.parquet"))
    want = [(i, *x) for i, t in enumerate(ALL_KINDS) for x in brute_tokens(t)]
    assert {x[3] for x in want} == {k for k, _ in tokens.KINDS}
    words = []
    for i in range(len(ALL_KINDS)):
        sentence, seen = [], []
        for _, pos, text, kind, _, _ in (x for x in want if x[0] == i):
            if kind == "WORD" and text.isascii() and text.isalpha():
                sentence.append((pos, text))
            elif kind == "PUNCT" and text in ".!?":
                seen, sentence = seen + [sentence], []
        words += [(i, n, *x) for n, part in enumerate(filter(None, seen + [sentence])) for x in part]
    for prefix in ("", "document_"):
        run = lambda q: sorted(map(tuple, registry.QUERIES[q](spark, str(tmp_path)).collect()))  # noqa: E731, B023
        assert run("text_tokens" if not prefix else "document_tokens") == sorted(want)
        assert run(f"{prefix}sentence_words") == sorted(words)


def test_apostrophe_queries_read_every_text(spark, tmp_path):
    from wordloom.plans import registry

    counts = Counter(m.lower() for t in ALL_KINDS for m in re.findall(tokens.APOSTROPHE, t))
    assert {"didn't", "o’neil", "rock'n'roll"} <= set(counts)
    for prefix, name in (("", "benchmark"), ("document_", "documents")):
        spark.createDataFrame([(t,) for t in ALL_KINDS], "text string").write.parquet(str(tmp_path / f"{name}.parquet"))
        assert dict(map(tuple, registry.QUERIES[f"{prefix}apostrophe_tokens"](spark, str(tmp_path)).collect())) == counts


def test_build(spark, tmp_path):
    forms = lambda *fs: [{"form": f, "tags": t.split()} for f, t in fs]
    rows = [
        {"word": "city", "pos": "noun", "forms": forms(("cities", "plural"))}, {"word": "stop", "pos": "verb", "forms": forms(("stopped", "past"), ("stopping", "participle present"), ("stops", "present singular third-person"), ("odd", "past archaic"))},
        {"word": "go", "pos": "verb", "forms": forms(("went", "past"), ("goes", "third-person singular present"))}, {"word": "cities", "pos": "noun", "forms": []}, {"word": "soon", "pos": "adv", "forms": []},
        {"word": "mouse", "pos": "noun", "forms": forms(("mouses", "plural"), ("mice", "plural"))}, {"word": "No", "pos": "noun", "forms": []}, {"word": "rock", "pos": "noun", "forms": []},
    ]
    (tmp_path / "w.jsonl").write_text("\n".join(json.dumps(r) for r in rows) + "\n{broken\n")
    entries = lx.read_wiktionary(spark, str(tmp_path / "w.jsonl")).cache()
    assert entries.where("_corrupt is not null").count() == 1
    freq = local(spark, [("mice", 4.0), ("mouses", 1.0), ("city", 5.0), ("go", 9.0)], "word string, zipf double")
    made = build.build_lexicon(entries, freq).cache()
    got = {(r.word, r.pos): (r.stem_class, r.irregular, r.weight) for r in made.collect()}
    assert got == {
        ("city", "noun"): ("Y_FINAL", {}, 1.07), ("stop", "verb"): ("DOUBLE_CONS", {}, 0.7), ("go", "verb"): ("SIBILANT", {"PAST": "went"}, 1.3), ("soon", "adv"): ("REG", {}, 0.7),
        ("mouse", "noun"): ("REG", {"PLURAL": "mice"}, 0.7), ("rock", "noun"): ("UNKNOWN", {}, 0.7),
    }
    assert ("cities", "noun") not in got and ("cities", "noun") in {(r.word, r.pos) for r in build.build_lexicon(entries, freq, keep_form_of=True).collect()}
    chosen = build.chosen_forms(build.listed_forms(entries), freq, build.predicted(build.headwords(entries)))
    r = build.regenerated(made, chosen).first()
    assert r.listed == r.equal == 7
    assert [x.word for x in build.top_words(made, 2).orderBy(F.desc("zipf")).collect()] == ["go", "city"]
    lex = build.as_lexeme(made)
    assert lex.orderBy("lex_id").first().stem == "go" and lex.where("stem = 'go'").first().irregular == {"+PAST": "went"}


def test_scores(spark):
    pred = local(spark, [("cats", ["cat", "s"], "decomposed"), ("walked", ["walked"], "no_analysis"), ("unkind", ["un", "kind"], "decomposed")], "word string, pieces array<string>, gate string")
    gold = local(spark, [("cats", ["cat", "s"]), ("walked", ["walk", "ed"]), ("unkind", ["un", "ki", "nd"]), ("unkind", ["unk", "ind"]), ("lost", ["lo", "st"])], "word string, pieces array<string>")
    rows = evaluate.scored(pred, gold).cache()
    s = {r.gate: (r.n, r.tp, r.fp, r.fn, r.exact, r.f1) for r in evaluate.boundary_scores(rows).collect()}
    assert s["ALL"] == (3, 2, 0, 2, 1, 0.666667) and s["no_analysis"] == (1, 0, 0, 1, 0, 0.0)
    assert {r.scope: (r.n, r.fn) for r in evaluate.strict_scores(rows).collect()} == {"analysed": (2, 1), "all": (4, 3)}
    gap = {r.bucket: r.n for r in evaluate.recall_gap(rows, local(spark, [("walk",)], "word string"), local(spark, [("ed",), ("s",)], "affix string")).collect()}
    assert gap == {"no_analysis_of_the_word": 1, "affix_the_rules_do_not_have": 1}
    assert tuple(evaluate.prefix_recall(rows).first()) == (1, 1)
    with pytest.raises(ValueError):
        evaluate.gate(local(spark, [("ab", ["a"])], "word string, pieces array<string>"))
    verdicts = {r.word: r.verdict for r in evaluate.policy_verdicts(pred, local(spark, [("walked", ["walk", "ed"]), ("cats", ["cat", "s"])], "word string, pieces array<string>"), gold).collect()}
    assert verdicts == {"walked": "gain", "cats": "same"}
    suff = evaluate.suffix_of(pred, local(spark, [("s",), ("ind",)], "suffix string"))
    assert {r.word: r.suffix for r in suff.collect()} == {"cats": "s", "walked": None, "unkind": "ind"}
    assert [r.system for r in evaluate.rankings(local(spark, [("a", 1.0), ("b", 2.0)], "system string, m double"), ["m"]).orderBy("place").collect()] == ["b", "a"]


def test_statistics(spark):
    docs = local(spark, [(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    counts = {r.item: r.cnt for r in stats.unit_counts(docs).collect()}
    assert counts["Dr"] == 1 and counts["."] == 4 and counts["isn"] == 1
    assert stats.sample_lines(docs, 3, 1).collect() == stats.sample_lines(docs.repartition(3), 3, 1).collect()
    assert sum(r.documents for r in stats.splits(docs).collect()) == len(TEXTS)


def test_automata(spark):
    arcs = local(spark, [(0, 1, "a", "x"), (1, 1, "a", ""), (1, 2, "", "y"), (0, 2, "a", "zz")], automata.ARCS)
    finals = local(spark, [(2,)], "state int")
    inputs = local(spark, [(0, ["a"]), (1, ["a", "a"]), (2, ["b"]), (3, [])], "id int, symbols array<string>")
    out = sorted((r.id, "".join(r.output)) for r in automata.transduce(inputs, arcs, finals).collect())
    assert out == [(0, "xy"), (0, "zz"), (1, "xy")]
    assert {r.id: r.accepted for r in automata.accepts(inputs, arcs, finals).collect()} == {0: True, 1: True, 2: False, 3: False}
    arcs, finals = automata.inflection_transducer(spark, "+PL", "N", "SIBILANT")
    assert automata.transduce(local(spark, [(0, ["+PL"])], "id int, symbols array<string>"), arcs, finals).first().output == ["es"]


def test_entry_without_the_optional_part(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_token_records_and_lines(spark):
    rules = an.Ruleset.of(lx.builtin(spark), lx.builtin_closed(spark))
    docs = local(spark, [(0, 'He "stopped"\n')], "doc_id long, text string")
    rows = [json.loads(r.value) for r in tokens.token_jsonl(tokens.segmented_text(docs, rules)).orderBy("pos").collect()]
    assert "".join(r["ws_before"] + "".join(r["pieces"]) for r in rows) == 'He "stopped"\n'
    assert (rows[2]["pieces"], rows[2]["alt"], rows[2]["kind"], rows[-1]["kind"]) == (["stop", "ped"], "consonant_doubling", "WORD", "TAIL")
    words = local(spark, [("Cats",), ("zzz",)], "word string")
    assert {r.word: r.text for r in an.compact_text(words, an.analyze(words, rules)).collect()} == {"Cats": "Cats\tcat +N +PL", "zzz": "zzz\tNO_ANALYSIS"}


def test_alternation_and_labelled_gold(spark):
    pred = local(spark, [("cities", ["cit", "ies"], "decomposed", "y_to_i"), ("cats", ["ca", "ts"], "decomposed", "")], "word string, pieces array<string>, gate string, alt string")
    gold = local(spark, [("cities", ["citi", "es"]), ("cats", ["cat", "s"])], "word string, pieces array<string>")
    rows = {r.word: (r.tp, r.tolerant_tp) for r in evaluate.with_alternation(pred, gold).collect()}
    assert rows == {"cities": (0, 1), "cats": (0, 0)}
    both = evaluate.labelled_gold({"a": gold, "b": local(spark, [("unkind", ["un", "kind"])], "word string, pieces array<string>")})
    assert {(r.gold_set, r.word): r.prefix_offsets for r in both.collect()}[("b", "unkind")] == [2]


def test_command_line_conflicts():
    from wordloom.__main__ import arguments

    for bad in (["analyze", "x", "--derived-first"], ["segment"], ["text", "f", "--nbest", "2"], ["segment", "f", "--nbest", "0"]):
        with pytest.raises(SystemExit) as e:
            arguments(bad)
        assert e.value.code == 2


def test_weights_round_by_the_exact_value(spark):
    zipfs = [i / 100 for i in range(0, 900)]
    df = local(spark, [(z,) for z in zipfs], "zipf double").select("zipf", o.weight_of_zipf(F.col("zipf")).alias("w"))
    assert {r.zipf: r.w for r in df.collect()} == {z: round(max(0.7, min(1.3, 0.7 + 0.075 * z)), 2) for z in zipfs}


def test_starts_of_long_texts_and_repeated_keys(spark):
    rows = [(1, "ab  cd. " * 700), (1, "x y"), (None, " z\n"), (None, ""), (2, None), (3, "  \t ")]
    got = tokens.tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for key, text in rows:
        mine = [r for r in got if r.doc_id == key and (text or "")[r.start : r.start + len(r.text)] == r.text]
        assert {(r.pos, r.text) for r in mine} >= {(i, t) for i, t in enumerate(re.findall(r"\w+|\S", text or ""))}
    first = sorted((r for r in got if r.doc_id == 1), key=lambda r: r.pos)
    assert len(first) == 700 * 3 + 1 + 2 and max(r.start for r in first) == len("ab  cd. " * 700)
    assert [(r.kind, r.ws_before) for r in got if r.doc_id == 3] == [("TAIL", "  \t ")]


def test_transducers_spell_the_paradigm(spark):
    cases = [("+PL", "N", "Y_FINAL", "city", "cities"), ("+PL", "N", "REG", "cat", "cats"), ("+PL", "N", "SIBILANT", "bus", "buses"), ("+PAST", "V", "DOUBLE_CONS", "stop", "stopped"), ("+PRES_PART", "V", "SILENT_E", "hope", "hoping"), ("+SUP", "ADJ", "SILENT_E", "large", "largest")]
    for tag, pos, stem_class, stem, form in cases:
        arcs, finals = automata.inflection_transducer(spark, tag, pos, stem_class)
        inputs = local(spark, [(1, [*stem, tag]), (2, [*stem])], "id int, symbols array<string>")
        found = [("".join(r.output), r.id) for r in automata.transduce(inputs, arcs, finals).collect()]
        assert found == [(form, 1)], (stem, found)
    arcs, finals = automata.inflection_transducer(spark, "+PL", "N", "Y_FINAL")
    assert [r.output for r in automata.transduce(local(spark, [(1, ["y", "+PL"]), (2, ["t", "+PL"])], "id int, symbols array<string>"), arcs, finals).collect()] == [["ies"]]
    assert len(automata.TRANSDUCERS) >= 18


def test_numbers_run_over_partitions(spark):
    from wordloom.functions.staging import numbered

    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x")).repartition(7)
    assert all(r.number == r.x + 1 for r in numbered(df, F.col("x")).collect())
    assert numbered(df.where("false"), F.col("x")).count() == 0


def test_tables_of_gold_and_lemmas(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("walk\twalked\tV|PST\twalk|ed\nwalk\twalks\tV|3\twalk|s\nonly\nempty\t\n")
    (tmp_path / "d.tsv").write_text("kind\tunkind\tADJ\tADJ\tun\tprefix\nshort\tline\n")
    got = lx.inflection_gold(lx.read_inflections(spark, str(tmp_path / "i.tsv"))).collect()
    assert [(r.form, r.measured, r.kind, r.pieces, r.reason) for r in got] == [("walked", "walk", "V", ["walk", "ed"], None), ("walks", "walk", "V", ["walk", "s"], None)]
    assert [(r.form, r.pieces) for r in lx.derivation_gold(lx.read_derivations(spark, str(tmp_path / "d.tsv"))).collect()] == [("unkind", ["un", "kind"])]
    assert [r.word for r in lx.read_lemmas(spark, str(tmp_path / "i.tsv")).collect()] == ["walk"]
    rows = local(spark, [("unhappy", "<un<{(happy)}"), ("workman", "{(work)}(man)")], "word string, parse string")
    both = [{r.form: r.pieces for r in lx.parsed_gold(rows, x).collect()} for x in (False, True)]
    assert both == [{"unhappy": ["un", "happy"], "workman": ["work", "man"]}, {"workman": ["work", "man"]}]


def test_comparisons_of_systems(spark, tmp_path):
    schema = "word string, pieces array<string>, suffix string, gate string"
    a = local(spark, [("cats", ["cats"], None, "x"), ("dogs", ["dog", "s"], "s", "x")], schema)
    b = local(spark, [("cats", ["cat", "s"], "s", "x"), ("dogs", ["dog", "s"], "s", "x")], schema)
    counts = local(spark, [("cats", 3), ("dogs", 2)], "item string, cnt long")
    assert [tuple(r) for r in evaluate.before_and_after(a, b, counts).collect()] == [("cats", "s", 3, "cats", "cat|s")]
    gold = local(spark, [("cats", ["cat", "s"])], "word string, pieces array<string>")
    rows = evaluate.differences(a, b, counts, gold)
    assert [tuple(r) for r in rows.collect()] == [("cats", "cats", "cat|s", 3, "cat|s")]
    lx.write_differences(rows, str(tmp_path / "out"))
    assert "".join(p.read_text() for p in (tmp_path / "out").glob("part-*")).splitlines() == ["word\ta\tb\tcnt\tgold", "cats\tcats\tcat|s\t3\tcat|s"]
    use = evaluate.vocabulary_use(b, local(spark, [("cat",), ("s",), ("x",)], "item string")).first()
    assert (use.emitted, use.used, use.outside) == (3, 2, 1)
    verdicts = local(spark, [("a", "gain", 5), ("b", "gain", 7), ("c", "same", 9), ("d", "loss", 1)], "word string, verdict string, cnt long")
    assert {(r.word, r.place) for r in evaluate.top_per_bucket(verdicts, 1).collect()} == {("b", 1), ("d", 1)}


def test_pieces_are_put_together(spark):
    from wordloom.operators import baselines

    rows = [(1, ["\u2581Hel", "lo", "\u2581w", "\u00f6"]), (2, ["play", "##ing"]), (3, ["a", "<0xC3>", "<0xA9>", "b"]), (4, ["<0xFF>", "x"]), (5, [])]
    got = {r.id: r.t for r in local(spark, rows, "id int, pieces array<string>").select("id", baselines.decoded(F.col("pieces")).alias("t")).collect()}
    assert got == {1: " Hello w\u00f6", 2: "playing", 3: "a\u00e9b", 4: "\ufffdx", 5: ""}
    import pandas as pd

    assert baselines.printable_bytes(pd.Series(["\u0120caf\u00c3\u00a9"])).tolist() == [" caf\u00e9"]
    counts = local(spark, [("ab", 3), ("cd", 2)], "item string, cnt long")
    encoded = local(spark, [("ab", ["a", "b"]), ("cd", ["c", "x"])], "word string, pieces array<string>")
    r = evaluate.round_trips(counts, encoded, F.array_join("pieces", "")).first()
    assert (r.types, r.types_exact, r.tokens, r.tokens_exact, r.rate, r.example) == (2, 1, 5, 3, 0.6, "cd")


def test_views_for_sql(spark):
    from wordloom.plans import views

    rules = an.Ruleset.of(local(spark, [(0, "cat", "N", "REG", 1.0, False, [])], an.LEXEME))
    assert views.register(local(spark, [("cats",)], "word string"), rules, "t") == ["t_analyses", "t_segments", "t_derived", "t_lexemes"]
    assert spark.sql("SELECT array_join(pieces, '|') AS p FROM t_segments WHERE rank = 1").first().p == "cat|s"


def test_merged_lexicons_and_lines(spark):
    docs = local(spark, [(1, "One two3, four!")], "doc_id int, text string")
    assert tokens.spaced_lines(docs).first().text == "One two 3 , four !"
    rules = an.Ruleset.of(local(spark, [(0, "cat", "N", "REG", 1.0, False, [])], an.LEXEME))
    got = {(r.word, r.stem) for r in tokens.analyzed_text(local(spark, [(1, "Cats sit. A cat!")], "doc_id int, text string"), rules).collect()}
    assert got == {("Cats", "cat"), ("sit", None), ("A", None), ("cat", "cat")}
