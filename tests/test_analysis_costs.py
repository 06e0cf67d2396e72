from wordloom.functions.local import local
from wordloom.functions.staging import dealt, staged
from wordloom.operators import analyze as an
from wordloom.operators import evaluate, generate
from wordloom.operators import segment as sg
from wordloom.plans import registry
from wordloom.sources import lexicon as lx


def rules_of(spark):
    return an.Ruleset.of(lx.builtin(spark), lx.builtin_closed(spark))


def test_few_bytes_of_words_are_read_by_all_cores(spark):
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        words = staged(spark.range(3000).selectExpr("concat('w', id) as word"), "words")
        assert len(sg.cuts(words, rules_of(spark)).rdd.glom().map(len).collect()) >= spark.sparkContext.defaultParallelism
        assert dealt(words.union(words), "word").count() == 3000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def test_compression_segments_words_once(spark, monkeypatch):
    kept, real = [], evaluate.staged
    monkeypatch.setattr(evaluate, "staged", lambda df, name: kept.append(name) or real(df, name))
    c = local(spark, [("cats", 3), ("walked", 2)], "item string, cnt long")
    out = evaluate.compression(c, sg.segment(c.selectExpr("item as word"), rules_of(spark), nbest=1))
    assert out.first().types == 2 and kept == ["encoded"]


def test_selfcheck_makes_forms_once(spark, monkeypatch):
    kept, real = [], generate.staged
    monkeypatch.setattr(generate, "staged", lambda df, name: kept.append(name) or real(df, name))
    rules = rules_of(spark)
    forms = generate.generated_forms(rules)
    bad = {tuple(x) for x in generate.unread(rules).collect()}
    assert "forms" in kept
    read = {x.word for x in an.analyze(forms.selectExpr("surface as word"), rules).select("word").distinct().collect()}
    assert bad == {tuple(x) for x in forms.select(*generate.COLS).collect() if x.surface.lower() not in read}


def test_only_words_of_the_gold_are_cut_for_it(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(1, "walked and tables, then oddly zzz qqq")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen, real = [], sg.cuts
    monkeypatch.setattr(sg, "cuts", lambda words, rules: seen.append({x.word for x in words.select("word").collect()}) or real(words, rules))
    assert registry.QUERIES["policy_diff"](spark, str(tmp_path)).count()
    assert registry.scored_gold(spark, str(tmp_path)).count() == 3
    assert seen == [{"walked", "tables", "oddly"}] * 2
