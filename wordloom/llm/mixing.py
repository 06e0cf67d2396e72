"""Mixing sources to target weights by a time-varying curriculum.

Each source has a schedule: its rate of demand over training time 0 to 1, linear between
knots. The integral of the schedule, scaled to the source's target, is its cumulative token
demand. A source's documents stand in a fixed shuffled order and are gone through again and
again; the document at cumulative word x is due when demand reaches x, so inverting the
demand gives each taking of a document its training position, and the mix is the documents
range-sorted by position.

Running sums over a source are taken in two steps, over hash-prefix buckets and inside a
bucket, so no task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, staged, table

SHARE, REPEATS = 1.5, 2
WEIGHTS = (5, 2, 1)
PLANNED = ["size", "source_size", "target", "taken", "weight", "before"]
#: By weight: (time, rate) knots. Heavy sources come early, light ones late.
SCHEDULES = {5: [(0.0, 1.5), (1.0, 0.5)], 2: [(0.0, 1.0), (1.0, 1.0)], 1: [(0.0, 0.5), (0.5, 0.8), (1.0, 2.0)]}
BUCKET_ROWS, MOST_DIGITS = 2000, 5


def due(share: Column, knots: list[tuple[float, float]]) -> Column:
    """The time at which the integral of the schedule reaches this share of its whole."""
    area = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:])]
    total, below, out = sum(area), 0.0, F.lit(knots[-1][0])
    pieces = []
    for (t, r), (t1, r1), size in zip(knots, knots[1:], area):
        if size > 0:
            q, a = (share - below / total) * total, (r1 - r) / (t1 - t)
            into = q / r if a == 0 else (F.sqrt(F.greatest(F.lit(0.0), r * r + 2 * a * q)) - r) / a
            pieces.append(((below + size) / total, F.lit(t) + into))
        below += size
    for end, value in reversed(pieces):
        out = F.when(share <= end, value).otherwise(out)
    return out


def targets(sizes: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS) -> DataFrame:
    """(__s, source, source_size, weight, target) from (__s, source, source_size), a row a source.

    Targets are the least of the cap and level * weight, at the level that spends the whole
    budget: sorted by cap / weight, it is the first level that no later source's cap is under.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("weight", w).withColumn("__cap", F.lit(float(repeats)) * F.col("source_size")).withColumn("__ratio", F.col("__cap") / F.col("weight"))
    order = Window.orderBy("__ratio", "__s")
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    level = (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("__level", level)
    rows = rows.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__s", "__level"))).over(every)["__level"])
    return rows.select("__s", "source", "source_size", "weight", F.coalesce(F.least("__cap", F.col("__level") * F.col("weight")), F.col("__cap")).alias("target"))


def plan(docs: DataFrame, share: float = SHARE, repeats: int = REPEATS, weights: tuple = WEIGHTS) -> DataFrame:
    """docs with size, source_size, target, taken, weight and before (words of its source ahead of it);
    columns of these names are replaced.

    A null text has no words; such documents are never taken. A null source is a source of its
    own, the last. Rows that repeat are documents of their own. The boundary document of a
    source is taken in part, so that the words taken add up to the floor of the target.
    """
    docs = sized(docs.drop(*PLANNED))
    return named(planned(docs, staged(docs.select("__s", "source", "__size", "__h"), "mix-sizes"), share, repeats, weights))


def sized(docs: DataFrame) -> DataFrame:
    """docs with __size (words), __s (the source, never null) and __h, the place in the shuffled order.

    __h is of id and text, so a null or repeated id spreads over the buckets as far as its texts differ."""
    text = F.coalesce("text", F.lit(""))
    return docs.withColumns({
        "__size": F.size(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).cast("long"),
        "__s": F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-")),
        "__h": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":mix:"), F.md5(text))),
    })


def named(rows: DataFrame) -> DataFrame:
    return rows.withColumnsRenamed({f"__{c}": c for c in PLANNED})


def planned(docs: DataFrame, light: DataFrame, share: float, repeats: int, weights: tuple) -> DataFrame:
    """docs (of sized) with the columns PLANNED, each after two underscores. light: __s, source, __size and
    __h of the same rows, cheap to read again."""
    rows, digits = light.count(), 1
    while rows > BUCKET_ROWS * 16**digits and digits < MOST_DIGITS:
        digits += 1
    bucket = F.col("__h").substr(1, digits)
    buckets = light.groupBy("__s", "source", bucket.alias("__b")).agg(F.sum("__size").alias("__n"))
    sources = targets(buckets.groupBy("__s", "source").agg(F.sum("__n").alias("source_size")), share, repeats, weights)
    ahead = F.sum("__n").over(Window.partitionBy("__s").orderBy("__b")) - F.col("__n")
    frame = buckets.drop("source").withColumn("__ahead", ahead).join(sources.drop("source"), "__s").drop("__n")
    frame = frame.withColumnsRenamed({c: f"__{c}" for c in ("source_size", "weight", "target")})
    inside = Window.partitionBy("__s", "__b").orderBy("__h", "__size").rowsBetween(Window.unboundedPreceding, 0)
    t, size, whole = F.floor("__target"), F.col("__size"), F.col("__source_size")
    taken = size * F.floor(t / whole) + F.greatest(F.lit(0), F.least(size, t % whole - F.col("__before")))
    return (
        docs.withColumn("__b", bucket)
        .withColumn("__to", F.sum(size).over(inside))
        .join(staged(frame, "mix-buckets"), ["__s", "__b"])
        .withColumn("__before", F.col("__ahead") + F.col("__to") - size)
        .withColumn("__taken", F.when(whole > 0, taken).otherwise(0).cast("long"))
        .drop("__s", "__b", "__h", "__to", "__ahead")
    )


def training_position(word: Column, schedules: dict = SCHEDULES, mark: str = "") -> Column:
    """When cumulative demand of a planned row's source reaches this word of its sequence. mark: what
    stands before the planned columns' names."""
    share, position = F.try_divide(word.cast("double"), F.col(f"{mark}target")), F.lit(None).cast("double")
    for w, knots in schedules.items():
        position = F.when(F.col(f"{mark}weight") == w, due(share, knots)).otherwise(position)
    return position


def mix(docs: DataFrame, schedules: dict = SCHEDULES, **settings) -> DataFrame:
    """The training sequence: a row for each taking of a document, with docs' own columns,
    range-sorted by `position` (0 to 1), then source, pass and order within the source.

    A document taken in part keeps the text up to its last taken word. Columns named position
    or pass are replaced; all others are the caller's own, those that plan would replace too.
    """
    own = [c for c in docs.columns if c not in ("position", "pass")]
    docs = sized(docs.select(own))
    p = planned(docs, staged(docs.select("__s", "source", "__size", "__h"), "mix-sizes"), **{"share": SHARE, "repeats": REPEATS, "weights": WEIGHTS} | settings)
    size, taken = F.col("__size"), F.col("__taken")
    full = F.floor(taken / size).cast("int")
    rows = (
        p.where((taken > 0) & (size > 0))
        .withColumn("pass", F.explode(F.sequence(F.lit(0), F.ceil(taken / size).cast("int") - 1)))
        .withColumn("__words", F.when(F.col("pass") < full, size).otherwise(taken % size))
    )
    position = training_position(F.col("pass") * F.col("__source_size") + F.col("__before"), schedules, "__")
    pieces = F.regexp_extract_all(F.col("text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(pieces, 1, F.col("__words").cast("int")), "")
    text = F.when(F.col("__words") < size, cut).otherwise(F.col("text"))
    return rows.withColumn("position", position).withColumn("text", text).orderBy("position", "source", "pass", "__before", "doc_id").select(*own, "position", "pass")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are read once, for their sizes; the rest works on the small rows.
    light = staged(sized(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text"), "mix-sizes")
    first = F.when(F.col("taken") > 0, F.round(training_position(F.col("before")), 6)).alias("first_position")
    return named(planned(light, light, SHARE, REPEATS, WEIGHTS)).select("doc_id", "size", "source_size", "target", "taken", first).orderBy("first_position", "doc_id")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, '-') || ':mix:' || md5(coalesce(text, ''))) AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 2.0::DOUBLE * source_size / weight AS ratio FROM s),
v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()
    - coalesce(sum(cap) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(weight) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
t AS (
  SELECT source, source_size, weight, coalesce(least(cap, weight *
    (SELECT arg_min(level, ratio) FROM v WHERE level <= ratio)), cap) AS target FROM v),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight, floor(t.target)::BIGINT AS whole,
    (sum(d.size) OVER (PARTITION BY d.source ORDER BY h, size ROWS UNBOUNDED PRECEDING))::BIGINT - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CASE WHEN source_size > 0 THEN
    size * (whole // source_size) + greatest(0, least(size, whole % source_size - before)) ELSE 0 END AS taken, before::DOUBLE / nullif(target, 0) AS u FROM r)
-- The schedules' integrals, inverted: 1.5 - t, 1, and 0.5 + 0.6 t up to 0.5, then 2.4 t - 0.4, of 1.025 in all.
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(CASE weight WHEN 5 THEN 1.5::DOUBLE - sqrt(greatest(0, 2.25::DOUBLE - 2 * u)) WHEN 2 THEN u
    ELSE CASE WHEN u <= 0.325::DOUBLE / 1.025 THEN (sqrt(0.25::DOUBLE + 1.2::DOUBLE * u * 1.025) - 0.5) / 0.6 ELSE 0.5 + (sqrt(0.64::DOUBLE + 4.8::DOUBLE * (u * 1.025 - 0.325)) - 0.8) / 2.4 END END, 6) END AS first_position
FROM k
"""
