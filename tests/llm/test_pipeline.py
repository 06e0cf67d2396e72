"""The pipeline's stages, each judged on its own input."""

import re
from collections import Counter

import corpus_pipeline
from wordloom.llm import mixing, registry, sharding, simhash
from wordloom.llm.common import table

SF = "/root/testdata/sf0.001"


def test_registry_names_the_operators():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    n = {"start": docs.count()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        out = stage(spark, before, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        n[name] = docs.count()
        if name != "sharding":
            assert docs.columns == before.columns
        if name == "language_id":
            assert n[name] == n["start"]  # every document of the table is in some language
        if name == "simhash_near_dedup":
            groups = simhash.near_duplicates(before).select("doc_id", "component_id").collect()
            assert sorted(r.doc_id for r in docs.select("doc_id").collect()) == sorted({g.component_id for g in groups})
        if name == "benchmark_decontamination":
            items = [re.sub(r"\W+", " ", r.text.lower()) for r in table(spark, SF, "benchmark").collect()]
            left = [" " + re.sub(r"\W+", " ", r.text.lower()) + " " for r in docs.collect()]
            assert not any(f" {' '.join(i.split()[:10])} " in t for i in items for t in left if len(i.split()) >= 10)
        if name == "mixing":
            assert abs(sum(len(r.text.split()) for r in docs.collect()) - 1.5 * sum(len(r.text.split()) for r in before.collect())) < 50
    assert {"shard", "slot", "size"} <= set(docs.columns)
    assert docs.agg({"shard": "max"}).first()[0] < sharding.SHARDS


def test_shards_follow_the_curriculum(spark, tmp_path):
    """In each shard the takings of documents stand in the order of the mix, and those of one document apart."""
    docs = table(spark, SF, "documents").where("doc_id % 2 = 0")
    want = [(r.doc_id, r.text) for r in mixing.mix(docs).collect()]
    corpus_pipeline.mix_sources(spark, docs, SF).write.parquet(str(tmp_path / "mixed"))
    got = corpus_pipeline.shard(spark, spark.read.parquet(str(tmp_path / "mixed")), SF).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(want)
    places, at = {}, {}
    for i, x in enumerate(want):
        places.setdefault(x, []).append(i)
    side_by_side = several = 0
    for s in sorted({r.shard for r in got}):
        rows = sorted((r for r in got if r.shard == s), key=lambda r: r.slot)
        assert [r.slot for r in rows] == list(range(len(rows)))
        found = []
        for r in rows:  # the k-th taking in a shard is the k-th of the mix: equal texts share a shard
            k = at.get((r.doc_id, r.text), 0)
            at[r.doc_id, r.text] = k + 1
            found.append(places[r.doc_id, r.text][k])
        assert found == sorted(found)
        several += sum(len(places[r.doc_id, r.text]) > 1 for r in rows)
        side_by_side += sum(a.doc_id == b.doc_id for a, b in zip(rows, rows[1:]) if len(rows) > 4)
    assert several > 20 and side_by_side < several / 8


def test_the_same_row_of_equal_texts_stays(spark):
    rows = [(1, "one and the same text here", lang, source, 1) for lang in ("en", "fr") for source in ("a", "b", None)] + [(2, "quite another text it is", "en", "a", 1)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = {tuple(sorted(map(repr, simhash.distinct_documents(df.repartition(k)).collect()))) for k in (1, 2, 7)}
    assert len(kept) == 1 and len(kept.pop()) == 2


#: In none of the four languages.
FOREIGN = [
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki.",
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem.",
    "Все люди рождаются свободными и равными в своем достоинстве и правах.",
    "يولد جميع الناس أحرارا متساوين في الكرامة والحقوق.",
    "すべての人間は、生れながらにして自由であり、かつ、尊厳と権利とについて平等である。",
    "bcdfg hjklm npqrs tvwxz qwrtp sdfgh zxcvb mnbvc lkjhg ptrwq xzvbn kjhgf dsqwr",
    " ".join(f"{i * 2654435761 % 2**32:08x}" for i in range(1, 40)),
]


def test_language_id_drops_foreign_and_junk_texts(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(10**9 + i, t, None) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.union(odd), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, size long, shard string, spans string"


def test_each_stage_takes_odd_rows(spark):
    """Null cells, empty and long texts, ties, repeated rows, other columns with an operator's names."""
    prose = [r for r in table(spark, SF, "documents").where("length(text) between 200 and 2000").orderBy("doc_id").limit(60).collect()]
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "theirs", "theirs") for r in prose]
    rows += rows[:5] + [(None, prose[0].text, None, None, None, None, None, None), (None, None, None, None, None, None, None, None), (7, "", "en", "s", 0, 0, "", "")]
    rows += [(10**9, prose[1].text * 60, "en", "s", 0, 0, "", ""), (prose[2].doc_id, prose[3].text + " more", "en", None, 0, 0, "", "")]
    docs = spark.createDataFrame(rows, ODD)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        got = out.collect()
        assert len(got) > 0 and stage(spark, docs.where("false"), SF).count() == 0, name
        if name != "sharding":
            assert out.columns == docs.columns and all(x.shard in ("theirs", "", None) and x.spans in ("theirs", "", None) for x in got), name
        if name == "language_id":
            assert sorted(map(repr, got)) == sorted(repr(x) for x in docs.collect() if x.text)
        if name == "simhash_near_dedup":
            of = simhash.near_duplicates(docs.select("doc_id", "text")).select("fp").distinct().count()
            assert len(got) <= of and sum(not (x.text or "").strip() for x in got) == 1
        if name == "benchmark_decontamination":
            assert {x.text for x in got} <= {x[1] for x in rows} and None in {x.text for x in got}
        if name == "mixing":
            assert sum(len(x.text.split()) for x in got) > 0 and all(x.text for x in got)
        if name == "sharding":
            assert len(got) == len(rows) and {"slot", "size"} <= set(out.columns)
