"""Scoring: predictions against gold, coverage, compression, and comparisons of systems.

Predictions are (word, pieces, gate); gold is (word, pieces), several rows for an ambiguous
word. Boundaries are the inner offsets of pieces.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wordloom.functions import orthography as o
from wordloom.functions import rules as r
from wordloom.functions.ledger import Ledger, fingerprint
from wordloom.functions.staging import staged

from .analyze import Ruleset
from .segment import segment

log = logging.getLogger(__name__)


def precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), tp + fp), F.lit(0.0))


def recall(tp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(tp.cast("double"), tp + fn), F.lit(0.0))


def f1(p: Column, q: Column) -> Column:
    return F.coalesce(F.try_divide(2 * p * q, p + q), F.lit(0.0))


def filtered_gold(gold: DataFrame, lemmas: DataFrame | None, closed: DataFrame | None, least: int = 3) -> DataFrame:
    """gold (form, measured, ...) with `reason`: the first rule that fails of `short` (measured under least
    letters), `no lemma` (measured not among lemmas), `closed class` (form); null for rows to keep."""
    rows = gold
    reason = F.when(F.length("measured") < least, "short")
    if lemmas is not None:
        rows = rows.join(lemmas.select(F.col("word").alias("measured"), F.lit(True).alias("is_lemma")).distinct(), "measured", "left")
        reason = reason.when(F.col("is_lemma").isNull(), "no lemma")
    if closed is not None:
        rows = rows.join(closed.select(F.col("word").alias("form"), F.lit(True).alias("is_closed")).distinct(), "form", "left")
        reason = reason.when(F.col("is_closed"), "closed class")
    return rows.withColumn("reason", reason).drop("is_lemma", "is_closed")


def reasons(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def scored(predicted: DataFrame, gold: DataFrame, tolerance: int = 0) -> DataFrame:
    """(word, gate, pieces, gold_pieces, tp, fp, fn, exact): the best alternative of each gold word: most
    true positives, then least missed, then first by spelling. Words without a prediction have null tp. Where predictions
    have a `level`, each level is scored by itself."""
    by = ["word", *(["level"] if "level" in predicted.columns else [])]
    pairs = gold.withColumnRenamed("pieces", "gold_pieces").join(predicted.select(*by, "pieces", "gate"), "word", "left")
    a, b = o.inner(o.offsets(F.col("pieces"))), o.inner(o.offsets(F.col("gold_pieces")))
    pairs = pairs.withColumns({"a": a, "b": b}).withColumn("tp", o.matched(F.col("a"), F.col("b"), tolerance))
    pairs = pairs.withColumns({"fp": F.size("a") - F.col("tp"), "fn": F.size("b") - F.col("tp"), "exact": F.col("pieces") == F.col("gold_pieces")})
    pairs = pairs.withColumns({c: F.when(F.col("pieces").isNotNull(), F.col(c)) for c in ("tp", "fp", "fn")})
    best = F.min_by(F.struct("gate", "pieces", "gold_pieces", "tp", "fp", "fn"), F.struct((-F.col("tp")).alias("t"), "fn", "gold_pieces"))
    return pairs.groupBy(*by).agg(F.coalesce(best, F.first(F.struct("gate", "pieces", "gold_pieces", "tp", "fp", "fn"))).alias("x"), F.max("exact").alias("exact")).select(*by, "x.*", F.coalesce("exact", F.lit(False)).alias("exact"))


def with_alternation(records: DataFrame, gold: DataFrame) -> DataFrame:
    """scored() twice: the strict columns, and tolerant_tp, _fp and _fn, which allow a boundary to be one letter
    off in words whose cut displaced a letter (alt of the record)."""
    strict = scored(records, gold)
    moved = records.where("alt <> ''").select("word")
    loose = scored(records, gold, 1).join(moved, "word", "left_semi").select("word", *(F.col(c).alias(f"t_{c}") for c in ("tp", "fp", "fn")))
    rows = strict.join(loose, "word", "left")
    return rows.select(*strict.columns, *(F.coalesce(f"t_{c}", c).alias(f"tolerant_{c}") for c in ("tp", "fp", "fn")))


def labelled_gold(sets: dict[str, DataFrame]) -> DataFrame:
    """(gold_set, word, pieces, prefix_offsets) of several gold sets; prefix_offsets are the ends of first
    pieces that are prefixes of the inventory."""
    out = None
    for name, df in sets.items():
        first = F.get("pieces", F.lit(0))
        ends = F.collect_set(F.when((F.size("pieces") > 1) & first.isin([p for p, _ in r.PREFIXES]), F.length(first)))
        df = df.join(df.groupBy("word").agg(ends.alias("prefix_offsets")), "word").select(F.lit(name).alias("gold_set"), "word", "pieces", "prefix_offsets")
        out = df if out is None else out.unionByName(df)
    return out


def _rates(rows: DataFrame) -> DataFrame:
    p, q = precision(F.col("tp"), F.col("fp")), recall(F.col("tp"), F.col("fn"))
    return rows.withColumns({"precision": F.round(p, 6), "recall": F.round(q, 6), "f1": F.round(f1(p, q), 6), "exact_rate": F.round(F.coalesce(F.try_divide(F.col("exact").cast("double"), F.col("n")), F.lit(0.0)), 6)})


def _sums() -> list[Column]:
    return [F.count("*").alias("n"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")), F.count_if("exact").alias("exact")]


def boundary_scores(rows: DataFrame) -> DataFrame:
    """(gate, n, tp, fp, fn, exact, precision, recall, f1, exact_rate), micro-averaged; gate ALL is the whole."""
    rows = rows.where("tp is not null")
    return _rates(rows.rollup("gate").agg(F.grouping("gate").alias("g"), *_sums()).withColumn("gate", F.when(F.col("g") == 1, "ALL").otherwise(F.col("gate"))).drop("g"))


def strict_scores(rows: DataFrame) -> DataFrame:
    """Two rows: over analysed words, and with words without an analysis as misses."""
    analysed = rows.where("tp is not null and gate not in ('no_analysis', 'passthrough')").agg(*_sums()).withColumn("scope", F.lit("analysed"))
    missed = rows.withColumn("fn", F.coalesce("fn", F.size("gold_pieces") - 1)).agg(*_sums()).withColumn("scope", F.lit("all"))
    return _rates(analysed.unionByName(missed))


def intrinsic(records: DataFrame) -> DataFrame:
    """One row: words, round trips, covered, fertility, characters and bytes per piece and per word."""
    n = F.count("*")
    return records.agg(
        n.alias("words"), F.round(F.count_if(F.array_join("pieces", "") == F.col("word")) / n, 6).alias("round_trip"),
        F.round(F.count_if(F.col("source") == "fst") / n, 6).alias("covered"), F.round(F.sum(F.size("pieces")) / n, 6).alias("fertility"),
        F.round(F.sum(F.length("word")) / F.sum(F.size("pieces")), 6).alias("chars_per_piece"), F.round(F.sum(F.octet_length("word")) / F.sum(F.size("pieces")), 6).alias("bytes_per_piece"), F.round(F.avg(F.length("word")), 6).alias("chars_per_word"),
    )


def compression(counts: DataFrame, encoded: DataFrame) -> DataFrame:
    """One row over (item, cnt) and (word, pieces): pieces per token and type, characters per piece, pieces
    per kB, distinct pieces, and the share of types that round-trip."""
    rows = staged(counts.join(encoded.select(F.col("word").alias("item"), "pieces"), "item"), "encoded")  # two sums read it
    rows = rows.withColumns({"k": F.size("pieces"), "chars": F.length("item"), "bytes": F.octet_length("item")})
    distinct = rows.select(F.explode("pieces").alias("p")).agg(F.count_distinct("p").alias("distinct_pieces"))
    one = rows.agg(
        F.sum("cnt").alias("tokens"), F.count("*").alias("types"), F.round(F.sum(F.col("k") * F.col("cnt")) / F.sum("cnt"), 6).alias("pieces_per_token"), F.round(F.avg("k"), 6).alias("pieces_per_type"),
        F.round(F.sum(F.col("chars") * F.col("cnt")) / F.sum(F.col("k") * F.col("cnt")), 6).alias("chars_per_piece"), F.round(1000 * F.sum(F.col("k") * F.col("cnt")) / F.sum(F.col("bytes") * F.col("cnt")), 6).alias("pieces_per_kb"),
        F.round(F.count_if(F.array_join("pieces", "") == F.col("item")) / F.count("*"), 6).alias("round_trip"),
    )
    return one.join(F.broadcast(distinct))


def vocabulary_use(encoded: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(emitted, used, outside): distinct pieces, those in the vocabulary, and the others."""
    pieces = encoded.select(F.explode("pieces").alias("item")).distinct()
    flagged = pieces.join(vocabulary.select("item", F.lit(True).alias("known")).distinct(), "item", "left")
    return flagged.agg(F.count("*").alias("emitted"), F.count_if("known").alias("used"), F.count_if(F.col("known").isNull()).alias("outside"))


def differences(a: DataFrame, b: DataFrame, counts: DataFrame, gold: DataFrame | None = None) -> DataFrame:
    """(word, a, b, cnt, gold) where two systems cut differently."""
    rows = a.select("word", F.array_join("pieces", "|").alias("a")).join(b.select("word", F.array_join("pieces", "|").alias("b")), "word").where("a <> b")
    rows = rows.join(counts.select(F.col("item").alias("word"), "cnt"), "word", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    if gold is not None:
        rows = rows.join(gold.groupBy("word").agg(F.array_join(F.array_sort(F.collect_set(F.array_join("pieces", "|"))), " ; ").alias("gold")), "word", "left")
    return rows


def policy_verdicts(a: DataFrame, b: DataFrame, gold: DataFrame) -> DataFrame:
    """(word, a, b, verdict): of words that two policies cut differently, whether b gains, loses, or neither is
    in gold; `same` where they agree."""
    alts = gold.groupBy("word").agg(F.collect_set(F.array_join("pieces", "|")).alias("alts"))
    rows = a.select("word", F.array_join("pieces", "|").alias("a")).join(b.select("word", F.array_join("pieces", "|").alias("b")), "word").join(alts, "word")
    verdict = F.when(F.col("a") == F.col("b"), "same").when(F.array_contains("alts", F.col("b")), "gain").when(F.array_contains("alts", F.col("a")), "loss").otherwise("neither")
    return rows.select("word", "a", "b", verdict.alias("verdict"))


def before_and_after(before: DataFrame, after: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, suffix, cnt, before, after): words whose pieces changed between two runs (word, pieces, suffix)."""
    rows = before.select("word", F.array_join("pieces", "|").alias("before")).join(after.select("word", "suffix", F.array_join("pieces", "|").alias("after")), "word").where("before <> after")
    rows = rows.join(counts.select(F.col("item").alias("word"), "cnt"), "word", "left")
    return rows.select("word", "suffix", F.coalesce("cnt", F.lit(0)).alias("cnt"), "before", "after")


def round_trips(counts: DataFrame, encoded: DataFrame, decoded: Column, other: Column | None = None) -> DataFrame:
    """One row over (item, cnt) and (word, pieces): strings, tokens and types that `decoded` (of pieces) gives back, and an example
    of others; with another decoder, on how many strings it disagrees with the string, and an example."""
    rows = counts.join(encoded.select(F.col("word").alias("item"), "pieces"), "item").withColumn("exact", F.coalesce(decoded == F.col("item"), F.lit(False)))
    tokens, more = F.sum(F.when(F.col("exact"), F.col("cnt")).otherwise(0)), []
    if other is not None:
        rows = rows.withColumn("differs", ~F.coalesce(other == F.col("item"), F.lit(False)))
        more = [F.count_if("differs").alias("other_disagrees"), F.min(F.when(F.col("differs"), F.col("item"))).alias("other_example")]
    return rows.agg(
        F.count("*").alias("types"), F.count_if("exact").alias("types_exact"), F.sum("cnt").alias("tokens"), tokens.alias("tokens_exact"),
        F.round(F.coalesce(F.try_divide(tokens.cast("double"), F.sum("cnt")), F.lit(0.0)), 6).alias("rate"), F.min(F.when(~F.col("exact"), F.col("item"))).alias("example"), *more,
    )


def top_per_bucket(rows: DataFrame, k: int = 25) -> DataFrame:
    """The k commonest words of each verdict but `same`, in falling order of count, then word."""
    order = Window.partitionBy("verdict").orderBy(F.desc("cnt"), F.desc("word"))
    return rows.where("verdict <> 'same'").withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def rankings(metrics: DataFrame, names: list[str], rising: tuple[str, ...] = ()) -> DataFrame:
    """(metric, place, system, value) of (system, names...), best first, five of each; names in rising are better when smaller."""
    long = metrics.unpivot("system", names, "metric", "value")
    value = F.when(F.col("metric").isin(*rising) if rising else F.lit(False), F.col("value")).otherwise(-F.col("value"))
    return long.withColumn("place", F.rank().over(Window.partitionBy("metric").orderBy(value))).where("place <= 5").select("metric", "place", "system", "value")


def scored_systems(systems: dict[str, Callable[[], DataFrame]], base: str, settings: Any = None, inputs: tuple[DataFrame, ...] = (), force: bool = False) -> DataFrame:
    """(system, ...): the figures that each system's function gives, one system after another, each kept under base when it
    is finished. A run that was interrupted goes on with the first unfinished system; other inputs or settings are
    other runs."""
    spark = SparkSession.active()
    ledger, mark, out = Ledger(spark, base), fingerprint(settings, *inputs), None
    for name, figures in systems.items():
        began = time.time()
        rows = ledger.made(f"system-{name}", mark, figures, force=force).select(F.lit(name).alias("system"), "*")
        log.info("%s: %.1f s", name, time.time() - began)
        out = rows if out is None else out.unionByName(rows)
    return out


def suffix_of(records: DataFrame, suffixes: DataFrame) -> DataFrame:
    """records (word, pieces) with `suffix`: of the last piece, exactly or after one displaced letter, the longest first."""
    last = F.element_at("pieces", -1)
    tries = records.where(F.size("pieces") > 1).select("word", F.posexplode(F.array(last, F.expr("substring(element_at(pieces, -1), 2)"))).alias("shift", "suffix"))
    found = tries.join(suffixes.select("suffix").distinct(), "suffix").groupBy("word").agg(F.min_by("suffix", F.struct("shift", -F.length("suffix"))).alias("suffix"))
    return records.join(found, "word", "left")


def suffix_scores(rows: DataFrame) -> DataFrame:
    """Boundary scores by `suffix` of scored rows."""
    return _rates(rows.where("tp is not null and suffix is not null").groupBy("suffix").agg(*_sums()))


def recall_gap(rows: DataFrame, free_words: DataFrame, suffixes: DataFrame, prefixes: DataFrame | None = None) -> DataFrame:
    """(bucket, n) of the gold boundaries that are missed, by the gold pieces before and after: between two free words, in
    a word without analysis, at an affix (affix) that no rule has, at an inner layer, or at a known affix that wasn't stripped."""
    gold = F.posexplode(F.slice("gold_pieces", 1, F.size("gold_pieces") - 1)).alias("i", "before")
    missed = rows.where("pieces is not null and size(gold_pieces) > 1").select("gate", "pieces", "gold_pieces", gold)
    at = F.get(o.offsets(F.col("gold_pieces")), F.col("i") + 1)
    missed = missed.where(~F.array_contains(o.inner(o.offsets(F.col("pieces"))), at)).withColumn("after", F.get("gold_pieces", F.col("i") + 1))
    flag = lambda df, key, col, name: df.select(F.col(key).alias(col), F.lit(True).alias(name)).distinct()
    missed = missed.join(flag(free_words, "word", "before", "free_before"), "before", "left").join(flag(free_words, "word", "after", "free_after"), "after", "left")
    missed = missed.join(flag(suffixes, "affix", "after", "is_suffix"), "after", "left")
    if prefixes is not None:
        missed = missed.join(flag(prefixes, "affix", "before", "is_prefix"), "before", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    known = yes("is_suffix") | (yes("is_prefix") if prefixes is not None else F.lit(False))
    compound = yes("free_before") & yes("free_after") & (F.length("before") >= 3) & (F.length("after") >= 3) & ~known
    bucket = (
        F.when(compound, "compound").when(F.col("gate").isin("no_analysis", "passthrough"), "no_analysis_of_the_word").when(~known, "affix_the_rules_do_not_have")
        .when((F.size("gold_pieces") >= 3) & (F.size("pieces") < F.size("gold_pieces")), "inner_layer_of_a_multi_layer_form").otherwise("known_affix_not_stripped")
    )
    return missed.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def layer_counts(rows: DataFrame) -> DataFrame:
    """One row of scored rows: gold words of three pieces or more, those of them cut in three or more, and those cut as gold says."""
    deep = rows.where("pieces is not null and size(gold_pieces) >= 3")
    return deep.agg(F.count("*").alias("gold_three_or_more"), F.count_if(F.size("pieces") >= 3).alias("own_three_or_more"), F.count_if("exact").alias("exact"))


def gate_shares(records: DataFrame) -> DataFrame:
    """(gate, words, share) of best records."""
    rows = records.groupBy("gate").agg(F.count("*").alias("words"))
    total = rows.agg(F.sum("words").alias("all"))
    return rows.join(F.broadcast(total)).select("gate", "words", F.round(F.col("words") / F.col("all"), 6).alias("share"))


def prefix_recall(rows: DataFrame) -> DataFrame:
    """(n, found): gold words that begin with an inventory prefix, and those cut there."""
    first = F.get("gold_pieces", F.lit(0))
    own = o.inner(o.offsets(F.col("pieces")))
    return rows.where((F.size("gold_pieces") > 1) & first.isin([p for p, _ in r.PREFIXES])).agg(F.count("*").alias("n"), F.coalesce(F.count_if(F.array_contains(own, F.length(first))), F.lit(0)).alias("found"))


def gate(records: DataFrame) -> DataFrame:
    """The records, or ValueError naming some that don't round-trip."""
    bad = [x["word"] for x in records.where(F.array_join("pieces", "") != F.col("word")).select("word").limit(10).collect()]
    if bad:
        raise ValueError(f"records don't rebuild their words: {bad}")
    return records


def size_curve(counts: DataFrame, rules: Ruleset, gold: DataFrame | None = None) -> DataFrame:
    """(level, lexemes, token_fst, type_fst, token_decomposed, and with gold f1 of the analysed words, f1_with_misses
    and covered): figures of nested lexicons, from one segmentation by all of them (see Ruleset). Gold is
    (word, pieces), of words in counts."""
    best = segment(counts.select(F.col("item").alias("word")), rules, nbest=1)
    if gold is not None:
        best = staged(best.select("word", "level", "pieces", "source", "gate"), "curve")
    rows = counts.join(best.select(F.col("word").alias("item"), "level", "source", "gate"), "item")
    share = lambda when, of: F.round(F.sum(F.when(when, of).otherwise(0)) / F.sum(of), 6)
    fst = F.col("source") == "fst"
    out = rows.groupBy("level").agg(share(fst, F.col("cnt")).alias("token_fst"), share(fst, F.lit(1)).alias("type_fst"), share(F.col("gate") == "decomposed", F.col("cnt")).alias("token_decomposed"))
    upto = F.explode(F.sequence(F.col("level"), F.lit(rules.levels))).alias("level")
    sizes = rules.lexeme.select(upto).groupBy("level").agg(F.count("*").alias("lexemes"))
    # Both have a row a level.
    out = out.join(F.broadcast(sizes), "level", "left").select("level", F.coalesce("lexemes", F.lit(0)).alias("lexemes"), "token_fst", "type_fst", "token_decomposed")
    if gold is None:
        return out
    told = ~F.col("gate").isin("no_analysis", "passthrough")
    rows = scored(best, gold).where("level is not null")
    sums = {c: F.sum(F.when(told, F.col(c)).otherwise(0)) for c in ("tp", "fp", "fn")}
    rate = lambda fn: F.round(f1(precision(sums["tp"], sums["fp"]), recall(sums["tp"], fn)), 6)
    missed = F.sum(F.when(told, F.col("fn")).otherwise(F.size("gold_pieces") - 1))
    scores = rows.groupBy("level").agg(rate(sums["fn"]).alias("f1"), rate(missed).alias("f1_with_misses"), F.round(F.count_if(told) / F.count("*"), 6).alias("covered"))
    return out.join(F.broadcast(scores), "level", "left")
