"""Samples of exact size, and results that are made once."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from wordloom.functions import ledger as lg
from wordloom.functions.local import local
from wordloom.operators import evaluate, stats


def documents(spark, n=60):
    rows = [(i, "\n".join(f"line {i} {j}" for j in range(i % 7))) for i in range(n)] + [(None, "no id\nat all"), (5, "again\nthe id"), (6, None), (7, "")]
    return local(spark, rows, "doc_id long, text string")


def test_sample_is_exact_whatever_the_partitions(spark):
    docs = documents(spark)
    lines = [(r.doc_id, k, t) for r in docs.collect() if r.text is not None for k, t in enumerate(r.text.split("\n"))]
    place = lambda x: hashlib.md5(":".join(([] if x[0] is None else [str(x[0])]) + [str(x[1]), "3"]).encode()).hexdigest()
    order = sorted(lines, key=lambda x: (place(x), x[0] or 0, x[1], x[2]))
    for n, leaf, k in [(0, 100, 1), (1, 1, 3), (17, 1, 5), (100, 100, 2), (len(lines) - 1, 1, 4), (len(lines), 10, 1), (10**6, 10, 2)]:
        got = stats.sample_lines(docs.repartition(k), n, 3, leaf).collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, order[:n])), n


def test_no_task_holds_the_sample(spark):
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('a', id, '\nb\nc') as text")
    out = stats.sample_lines(docs, 4000, 1, leaf=50)
    assert out.count() == 4000 and out.distinct().count() == 4000
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrdered" not in plan and "GlobalLimit" not in plan
    sizes = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 1


def test_sample_and_splits_are_kept(spark, tmp_path):
    docs, base = documents(spark), f"file://{tmp_path}/kept"
    first = stats.kept_sample(docs, 20, base, 3)
    again = stats.kept_sample(docs.repartition(3), 20, base, 3)
    assert first.inputFiles() == again.inputFiles() and again.count() == 20
    assert stats.kept_sample(docs, 21, base, 3).inputFiles() != first.inputFiles()
    assert stats.kept_sample(docs.where("doc_id > 3"), 20, base, 3).inputFiles() != first.inputFiles()
    said = [json.loads(p.read_text()) for p in (tmp_path / "kept").glob("sample-*/record.json")]
    assert sorted((x["rows"], x["wanted"], x["seed"]) for x in said) == [(20, 20, 3), (20, 20, 3), (21, 21, 3)]
    assert sorted(map(tuple, stats.kept_splits(docs, base).collect())) == sorted(map(tuple, stats.splits(docs).collect()))


def test_an_interrupted_run_goes_on(spark, tmp_path):
    table, base, ran = local(spark, [("a", 1), ("b", 2)], "item string, cnt long"), f"file://{tmp_path}/runs", []

    def system(name, fails=False):
        def figures():
            ran.append(name)
            rows = table.agg(F.sum("cnt").alias("tokens"))
            # Half of the rows are written when a task fails.
            return rows.select(F.when(F.lit(fails), F.raise_error(F.lit("stopped"))).otherwise(F.col("tokens")).cast("long").alias("tokens"))

        return figures

    four = {n: system(n) for n in "abcd"}
    with pytest.raises(Exception, match="stopped"):
        evaluate.scored_systems(four | {"c": system("c", fails=True)}, base, {"x": 1}, (table,))
    assert ran == ["a", "b", "c"] and list((tmp_path / "runs").glob("_begun-*"))
    out = evaluate.scored_systems(four, base, {"x": 1}, (table,))
    assert ran == ["a", "b", "c", "c", "d"] and not list((tmp_path / "runs").glob("_begun-*"))
    assert sorted(map(tuple, out.collect())) == [(n, 3) for n in "abcd"]
    evaluate.scored_systems(four, base, {"x": 1}, (table.repartition(3),))
    assert len(ran) == 5
    evaluate.scored_systems(four, base, {"x": 1}, (table.withColumn("cnt", F.col("cnt") + 1),))
    assert len(ran) == 9
    evaluate.scored_systems(four, base, {"x": 2}, (table,))
    assert len(ran) == 13
    evaluate.scored_systems(four, base, {"x": 2}, (table,), force=True)
    assert len(ran) == 17


def test_content_of_a_table(spark):
    a = local(spark, [(1, "x"), (1, "x"), (2, None)], "a int, b string")
    assert lg.content(a) == lg.content(a.repartition(2)) != lg.content(a.distinct())
    assert lg.content(a) != lg.content(a.withColumnRenamed("b", "c"))
    m = a.withColumn("m", F.create_map("a", "b"))
    assert lg.content(m) == lg.content(m.repartition(2))
