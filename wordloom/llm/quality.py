"""Quality rules with risk-controlled thresholds.

Fixed base rules come first. Further rules reject a document whose ratio is over a cutoff;
the cutoffs are learned so that few good documents are rejected. Labelled documents are the
holdout (the rules themselves are fixed, nothing else is fitted). For each stratum and rule,
cutoffs are tried from the loosest to the strictest; the exact binomial tail
P(at most k of n good documents rejected | rate = allowed rate) must be at most the level.
Trying stops at the first that fails (fixed-sequence testing), the level is divided by the
number of strata times rules (Bonferroni), and the allowed rate of a stratum is divided
among its rules, so with probability 1 - DELTA every stratum falsely rejects at most ALPHA.
A stratum with too few labels gets no cutoff, so nothing is rejected there.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, staged, table

ALPHA, DELTA = 0.05, 0.05
MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = r"[^#*$%&|<>]+"
#: By rule, from the loosest cutoff to the strictest.
CUTOFFS = {
    "symbols": [0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],  # of a document's characters in words
    "dup_lines": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3],  # of its lines with words
    "repeats": [0.25, 0.2, 0.15, 0.1],  # words in repeated windows, of its words
}


def measured(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_with_words.

    A null text is empty: all zero. Windows are compared by 64-bit hash within a document.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.withColumn("__words", F.regexp_extract_all(text, F.lit(WORD), F.lit(0)))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    w = F.col("__words")
    wide = words.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long"),
        "__lines": lines,
        "__h": F.when(F.size(w) > WINDOW, F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))),
    }).drop("__words")
    h, s, p = F.col("__h"), F.col("__sorted"), F.col("__at")
    # Sorted (hash, place) pairs of documents that repeat a window; equal neighbours are repeats.
    wide = wide.withColumn("__sorted", F.when(F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    wide = wide.withColumn("__at", F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])))
    cover = F.aggregate(
        p, F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n")), lambda a: a["n"],
    )
    n = F.size("__lines")
    return wide.withColumns({
        "n_repeat_words": F.coalesce(cover, F.lit(0)).cast("long"),
        "n_lines_with_words": n.cast("long"),
        "n_dup_lines": (n - F.size(F.array_distinct("__lines"))).cast("long"),
    }).drop("__h", "__lines", "__sorted", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def ratios() -> dict[str, Column]:
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {"symbols": ratio("n_symbols", "word_chars"), "dup_lines": ratio("n_dup_lines", "n_lines_with_words"), "repeats": ratio("n_repeat_words", "n_words")}


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(X <= k) for X binomial of n and p, by its terms in logarithms. Above the mean it is
    over any level of use here, so 1 stands for it and no long sum is taken."""
    step = lambda a, i: F.struct(
        (a["t"] + F.log((n - i + 1) / i) + math.log(p / (1 - p))).alias("t"),
        (a["sum"] + F.exp(a["t"] + F.log((n - i + 1) / i) + math.log(p / (1 - p)))).alias("sum"),
    )
    first = n * math.log(1 - p)
    some = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(first.alias("t"), F.exp(first).alias("sum")), step, lambda a: a["sum"])
    return F.when(k >= n * p, F.lit(1.0)).when(k == 0, F.exp(first)).otherwise(some)


def certified(good: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cutoffs: dict = CUTOFFS) -> DataFrame:
    """(__stratum, and of each rule its strictest certified cutoff or null) from good documents
    with the rules' ratios and __stratum."""
    strata = max(1, good.select("__stratum").distinct().count())
    level, rate = delta / (strata * len(cutoffs)), alpha / len(cutoffs)
    tries = [F.struct(F.lit(rule).alias("rule"), F.lit(i).alias("i"), F.lit(float(c)).alias("cut"), (F.col(f"__{rule}") > c).cast("long").alias("out")) for rule, cs in cutoffs.items() for i, c in enumerate(cs)]
    counts = (
        good.select("__stratum", F.inline(F.array(*tries)))
        .groupBy("__stratum", "rule", "i", "cut")
        .agg(F.count("*").alias("n"), F.sum("out").alias("k"))
        .withColumn("ok", binomial_tail(F.col("k"), F.col("n"), rate) <= level)
    )
    runs = counts.groupBy("__stratum", "rule").agg(F.coalesce(F.min(F.when(~F.col("ok"), F.col("i"))), F.lit(10**6)).alias("stop"))
    return (
        counts.join(runs, ["__stratum", "rule"])
        .where(F.col("i") < F.col("stop"))
        .groupBy("__stratum")
        .agg(*(F.min(F.when(F.col("rule") == rule, F.col("cut"))).alias(f"__cut_{rule}") for rule in cutoffs))
    )


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """docs' other columns without text, the measures, base_failed and kept (columns of these names are replaced).

    labels: (doc_id, quality); good means quality 1 in some row. Null ids and null qualities
    are no labels. Rows of one id and stratum are one trial. A null stratum is one of its own. Empty labels certify nothing. Every row
    is judged by itself, so repeated rows get the same verdict.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines_with_words", "base_failed", "kept"]
    docs = docs.drop(*made).withColumn("__stratum", F.coalesce(F.concat(F.lit("="), F.col(stratum).cast("string")), F.lit("-")))
    own = [c for c in docs.columns if c != "text"]
    m = staged(measured(docs).withColumn("base_failed", base_failed()).withColumns({f"__{k}": v for k, v in ratios().items()}).drop("text"), "quality")
    good = m.where(~F.col("base_failed")).join(labels.where(F.col("quality") == 1).select("doc_id").distinct(), "doc_id", "left_semi")
    # A document is one trial, however often its row repeats; of unlike rows the one that is rejected first counts.
    good = good.groupBy("doc_id", "__stratum").agg(*(F.max(f"__{rule}").alias(f"__{rule}") for rule in CUTOFFS))
    cuts = staged(certified(good, alpha, delta), "cutoffs")
    over = F.lit(False)
    for rule in CUTOFFS:
        over = over | F.coalesce(F.col(f"__{rule}") > F.col(f"__cut_{rule}"), F.lit(False))
    return m.join(cuts, "__stratum", "left").withColumn("kept", ~F.col("base_failed") & ~over).select(*[c for c in own if c != "__stratum"], *made)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = judge(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_RULES = {"symbols": "n_symbols / word_chars", "dup_lines": "n_dup_lines / n_lines", "repeats": "n_repeat_words / n_words"}
_TRIES = ", ".join(f"('{rule}', {i}, {c}::DOUBLE)" for rule, cs in CUTOFFS.items() for i, c in enumerate(cs))
_LONG = " UNION ALL ".join(f"SELECT doc_id, stratum, '{rule}' AS rule, coalesce({ratio}, 0.0::DOUBLE) AS ratio FROM judged" for rule, ratio in _RULES.items())
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce('=' || lang, '-') AS stratum, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS k FROM s, LATERAL (SELECT unnest(range(1, len(w) - {WINDOW - 2})) AS i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + {WINDOW})) AS j FROM twice) GROUP BY doc_id),
m AS (SELECT s.doc_id, stratum, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, length(regexp_replace(text, '{SYMBOLS}', '', 'g'))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(cover.n, 0) AS n_repeat_words FROM s LEFT JOIN cover ON cover.doc_id = s.doc_id),
judged AS (SELECT * REPLACE (nullif(word_chars, 0) AS word_chars, nullif(n_words, 0) AS n_words, nullif(n_lines, 0) AS n_lines), n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed FROM m),
ratios AS ({_LONG}),
good AS (SELECT r.stratum, r.rule, r.doc_id, max(ratio) AS ratio FROM ratios r JOIN judged j ON j.doc_id = r.doc_id WHERE NOT base_failed AND r.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY ALL),
tries AS (SELECT * FROM (VALUES {_TRIES}) AS t(rule, i, cut)),
k AS (SELECT stratum, rule, i, cut, count(*) AS n, count(*) FILTER (ratio > cut) AS k, {ALPHA / len(CUTOFFS)}::DOUBLE AS p, {DELTA}::DOUBLE / ((SELECT count(DISTINCT stratum) FROM good) * {len(CUTOFFS)}) AS level FROM good JOIN tries USING (rule) GROUP BY ALL),
ok AS (SELECT *, CASE WHEN k >= n * p THEN FALSE ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(p) + (n - j) * ln(1 - p)))) <= level END AS ok FROM k),
cuts AS (SELECT stratum, rule, min(cut) AS cut FROM ok WHERE NOT EXISTS (SELECT 1 FROM ok o WHERE o.stratum = ok.stratum AND o.rule = ok.rule AND o.i <= ok.i AND NOT o.ok) GROUP BY ALL),
bad AS (SELECT DISTINCT doc_id FROM ratios r JOIN cuts c ON c.stratum = r.stratum AND c.rule = r.rule WHERE ratio > cut)
SELECT m.doc_id, m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, base_failed, NOT base_failed AND m.doc_id NOT IN (SELECT doc_id FROM bad) AS kept FROM m JOIN judged j ON j.doc_id = m.doc_id
"""
