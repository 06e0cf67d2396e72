"""Sharding by histogram sort: shards of near-equal bytes, cut from one total order.

Rows are ordered by a 128-bit key, text hash first, so equal texts lie side by side and a
group too large for a shard is cut by the second half, a hash of doc_id. Rounds count the
exact bytes and rows below ever finer key prefixes, refining only the prefixes that a shard
boundary crosses (or that hold too many rows for one task), until each boundary is met
within the tolerance. The driver sees a bounded number of prefix counts a round. Then every
row moves once, to the leaf of its prefix, where its slot is its rank plus the leaf's offset.
Rows alike in id and text share a key; where so many repeat that a boundary or a task's bound
cuts them, the rows are written with some more digits of key, dealt by row, and counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import staged, table

SHARDS = 40
#: A boundary may miss its place by this part of a shard, unless a single document is larger.
TOLERANCE = 0.001
FIRST, STEP, KEY, TIE = 3, 2, 32, 6  # hex digits of the first prefixes, of a refinement, of a key, of a row among equals
#: Rows of a leaf, which one task ranks; of leaves there are 65,536 and the refined ones at most, so
#: beyond 6.5 billion rows a leaf is a share of them.
LEAF_ROWS, LEAF_BITS = 100_000, 16


def with_key(docs: DataFrame) -> DataFrame:
    """docs with __size (UTF-8 bytes of the text, plus 16), __crc (of its bytes) and __key."""
    text, h = F.coalesce("text", F.lit("")), F.xxhash64("text")
    return docs.withColumns({
        "__size": F.octet_length(text).cast("long") + 16,
        "__crc": F.crc32(text),
        "__key": F.concat(F.lpad(F.hex(h), 16, "0"), F.lpad(F.hex(F.xxhash64(F.col("doc_id"), h)), 16, "0")),
    })


def splitters(keyed: DataFrame, n: int, tolerance: float = TOLERANCE, key: int = KEY) -> tuple[list[tuple[str, int, int]], bool]:
    """Leaves of the histogram in key order, (prefix, bytes, rows), and whether one of them is too
    large or ill-placed though its prefix is a whole key. A boundary misses two equal rows by no more
    than one of them, as it may any document."""
    def count(prefix_length: int, of: list[str] | None) -> list[tuple[str, int, int]]:
        rows = keyed
        if of is not None:
            rows = rows.where(F.col("__key").substr(1, len(of[0])).isin(of))
        return [tuple(r) for r in rows.groupBy(F.col("__key").substr(1, prefix_length).alias("p")).agg(F.sum("__size"), F.count("*")).collect()]

    rows = keyed.count()
    most, length = max(LEAF_ROWS, rows >> LEAF_BITS), FIRST
    while most << 4 * length < rows:
        length += 1
    leaves = sorted(count(length, None))
    total = sum(x[1] for x in leaves)
    near = tolerance * total / n
    while True:
        below, wide, tied = 0, [], False
        for p, size, k in leaves:
            cut = total and k > 1 and size > near and (below * n // total) != ((below + size) * n // total)
            if len(p) == length and (cut or k > most):
                wide.append(p)
                tied = tied or k > (2 if cut else most)
            below += size
        if not wide or length == key:
            return leaves, tied
        length = min(key, length + STEP)
        at = set(wide)
        leaves = sorted([x for x in leaves if x[0] not in at] + count(length, wide))


def shard(docs: DataFrame, n: int = SHARDS, tolerance: float = TOLERANCE, order: list[Column] | None = None) -> DataFrame:
    """docs with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null); columns of these names are replaced.
    Slots follow `order` in each shard, columns of docs' rows, if it is given, and else the key.

    A null text counts as no bytes, so 16 and a crc of 0. Null ids are ordinary keys. Rows equal in doc_id
    and text lie side by side, in any order among each other. An empty table gives no rows.
    Fewer documents than shards leave shards empty.
    """
    ordered = [c.alias(f"__o{i}") for i, c in enumerate(order or [])]
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    keyed = with_key(docs.select(*(c for c in docs.columns if c not in made), *ordered))
    return dealt(keyed, staged(keyed.select("__key", "__size"), "shard-keys"), n, tolerance, [f"__o{i}" for i in range(len(ordered))])


def dealt(keyed: DataFrame, light: DataFrame, n: int, tolerance: float, order: list[str] | None = None) -> DataFrame:
    """keyed (of with_key) with its shards. light: __key and __size of the same rows, cheap to read again."""
    leaves, tied = splitters(light, n, tolerance)
    if tied:
        # Written, so that a task that is run again reads the same digits.
        tie = F.substring(F.lpad(F.hex(F.xxhash64(F.monotonically_increasing_id())), 16, "0"), 1, TIE)
        keyed = staged(keyed.withColumn("__key", F.concat("__key", tie)), "shard-rows")
        leaves, _ = splitters(keyed.select("__key", "__size"), n, tolerance, KEY + TIE)
    total, below, at, out = max(1, sum(x[1] for x in leaves)), 0, {}, []
    first = min((len(x[0]) for x in leaves), default=FIRST)
    lengths: dict[int, list[str]] = {}
    for p, size, k in leaves:
        s = min(n - 1, (2 * below + size) * n // (2 * total))
        out.append((p, int(s), at.get(s, 0)))
        at[s] = at.get(s, 0) + k
        below += size
        for cut in range(first, len(p), STEP):
            lengths.setdefault(cut, []).append(p[:cut])
    spark = keyed.sparkSession
    # One row a leaf: at most 16 << LEAF_BITS, and 16 ** STEP for each prefix refined.
    leaf = spark.createDataFrame(out, "__leaf string, shard int, __start long")
    length = F.lit(max(map(lambda x: len(x[0]), leaves), default=first))
    for cut in sorted(lengths, reverse=True):
        length = F.when(~F.col("__key").substr(1, cut).isin(sorted(set(lengths[cut]))), cut).otherwise(length)
    keyed = keyed.withColumn("__leaf", F.col("__key").substr(F.lit(1), length))
    columns = [c for c in keyed.columns if not c.startswith("__")]
    made = {"size": F.col("__size"), "text_crc32": F.col("__crc"), "law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    if order:
        # Rows are exchanged once, into the order of shards and of `order` in each; a slot is a row's place in
        # its partition and the shard's rows in those before.
        rows = keyed.join(F.broadcast(leaf.select("__leaf", "shard")), "__leaf").orderBy("shard", *order, "__key").withColumn("__at", F.monotonically_increasing_id())
        rows = staged(rows, "shard-slots").withColumn("__part", F.shiftright("__at", 33))
        parts = rows.groupBy("shard", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
        ahead = F.sum("__n").over(Window.partitionBy("shard").orderBy("__part")) - F.col("__n")
        rows = rows.join(F.broadcast(parts.select("shard", "__part", "__first", ahead.alias("__ahead"))), ["shard", "__part"])  # a row a partition and shard
        return rows.withColumns(made | {"slot": F.col("__ahead") + F.col("__at") - F.col("__first")}).select(*columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    slot = F.row_number().over(Window.partitionBy("__leaf").orderBy("__key", "doc_id")) - 1
    return (
        keyed.withColumn("__slot", slot)
        .join(F.broadcast(leaf), "__leaf")
        .withColumns(made | {"slot": F.col("__start") + F.col("__slot")})
        .select(*columns, "size", "text_crc32", "law", "shard", "slot", "grown_shard")
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the digest columns; the text itself need not move for these."""
    light = staged(with_key(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "shard-keys")
    return dealt(light, light, SHARDS, TOLERANCE).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
