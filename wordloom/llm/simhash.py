"""SimHash near-dedup by a byte-position inverted index with count filtering.

Two fingerprints within 2 bits differ in at most 2 of their 8 bytes, so they share at least
6 bytes at equal positions: the guaranteed minimum of matches. Lists of single positional
bytes would hold a 256th of all fingerprints each, so the index lists each distinct
fingerprint under every choice of 6 positional bytes. A list's members differ in two bytes
only, which bounds it to 65,536 fingerprints however many documents there are. A list gives
candidate pairs (found by looking up the flips of the free bits, not by trying all pairs),
of which it keeps a spanning forest, each with the positions that the list vouches for.
Over all lists the positions of a pair are tallied; pairs that reach 6 are kept and verified
by bit distance. Copies share a fingerprint and are one member.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, row_key, staged, table

BITS, WORDS = 2, 3
SLICE = 100_000  # shingles whose bits are counted at once
INDEX_ROWS = 50_000  # fingerprints of an index task, each listed under every choice
CHOICES = list(combinations(range(8), 8 - BITS))  # positions of a choice
MASKS = [sum(0xFF << 8 * i for i in kept) for kept in CHOICES]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The 64-bit SimHash of a text; 0 without words (or where no bit has a majority)."""
    w = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)))))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(shingles), SLICE):
        h = np.array([digest(x, 42) for x in shingles[i : i + SLICE]], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(shingles), bitorder="little").tobytes(), "little", signed=True)


def fingerprints(text: Column, words: int = WORDS) -> Column:
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(x.as_py(), words) for x in texts], pa.int64())

    return of(text)


def forest(members: list[int], bits: int = BITS) -> list[tuple[int, int]]:
    """Of one list's pairs within `bits` flips, a spanning forest: it joins the same groups."""
    s = np.sort(np.array(members, np.int64).view(np.uint64))
    free = np.bitwise_or.reduce(s ^ s[0])
    if len(s) == 2:
        return [(members[0], members[1])] if int(free).bit_count() <= bits else []
    ones = [1 << i for i in range(64) if int(free) >> i & 1]
    left, right = [], []
    for k in range(1, bits + 1):
        for flip in combinations(ones, k):
            other = s ^ np.uint64(sum(flip))
            at = np.minimum(np.searchsorted(s, other), len(s) - 1)
            hit = np.flatnonzero((s[at] == other) & (at > np.arange(len(s))))
            left.append(hit)
            right.append(at[hit])
    left, right = np.concatenate(left), np.concatenate(right)
    kept = spanning(left, right, len(s))
    s = s.view(np.int64)
    return list(zip(s[left[kept]].tolist(), s[right[kept]].tolist()))


def spanning(left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the edges of a spanning forest, by rounds: each tree takes its first edge to another."""
    label, edge, kept = np.arange(n), np.arange(len(left)), []
    while len(edge):
        a, b = label[left[edge]], label[right[edge]]
        across = a != b
        edge, a, b = edge[across], a[across], b[across]
        first = np.full(n, len(left))
        np.minimum.at(first, a, edge)
        np.minimum.at(first, b, edge)
        taken = np.unique(first[first < len(left)])
        kept.append(taken)
        x, y = left[taken], right[taken]
        while not (label[x] == label[y]).all():
            low = np.minimum(label[x], label[y])
            top = np.concatenate([label[x], label[y]])
            np.minimum.at(label, top, np.concatenate([low, low]))
            label = label[label]
    return np.concatenate(kept) if kept else np.zeros(0, np.int64)


def links(prints: DataFrame) -> DataFrame:
    """Links (a, b) that join the same groups as all pairs of distinct fingerprints (fp) within 2 bits."""
    @F.arrow_udf("array<struct<a:long,b:long>>")
    def candidates(lists: pa.Array) -> pa.Array:
        return pa.array([[{"a": min(x), "b": max(x)} for x in forest(y)] for y in lists.to_pylist()], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(m))) for m in MASKS))).alias("choice", "bytes")
    spread = prints.select("fp").repartition(1 + prints.count() // INDEX_ROWS, "fp")
    lists = spread.select("fp", keys).groupBy("choice", "bytes").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1)
    at = F.element_at(F.array(*(F.lit(sum(1 << i for i in kept)) for kept in CHOICES)), F.col("choice") + 1)
    pairs = lists.select(at.alias("at"), F.inline(candidates("members")))
    tallied = pairs.groupBy("a", "b").agg(F.bit_count(F.bit_or("at")).alias("shared"))
    return tallied.where((F.col("shared") >= 8 - BITS) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS)).select("a", "b")


def near_duplicates(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with fp (signed long) and component_id, the smallest doc_id reachable by links; columns of
    these names are replaced.

    A null or empty text has fingerprint 0, linked like any other. Null ids take part but are
    never the smallest unless a group has no other. Rows that repeat are copies.
    """
    return attach(docs.drop("fp", "component_id").withColumn("fp", fingerprints(F.col("text"), words)))


def groups(docs: DataFrame) -> DataFrame:
    """(fp, root, component_id), staged: of each fingerprint in docs its group's smallest, and the group's smallest doc_id."""
    prints = staged(docs.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    found = components(links(prints))
    rooted = prints.join(found, prints["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return staged(rooted.join(least, "root").select("fp", "root", "component_id"), "components")


def attach(docs: DataFrame) -> DataFrame:
    """docs (with fp) and component_id. docs is read twice: pass a table that is cheap to read."""
    # A staged table: broadcast under Spark's threshold, else joined so that a hot fingerprint splits.
    return docs.join(groups(docs).drop("root"), "fp")


def distinct_documents(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """One document of each group: a row with the group's smallest doc_id, in docs' columns.
    Of a group's rows that share that id one stays, the last by hashes of the text and of all columns, the same in every run.

    A group is told by its root, not by an id: null ids, or one id of unlike texts, are in
    as many groups as their texts, and each keeps a row.
    """
    cols = docs.columns
    tie = F.xxhash64(*(c for c, t in docs.dtypes if "map<" not in t))
    docs = docs.withColumns({"__row": row_key(), "__tie": tie})
    light = staged(docs.select("doc_id", "__row", "__tie", fingerprints(F.col("text"), words).alias("fp")), "prints")
    first = light.join(groups(light), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = staged(first.groupBy("root").agg(F.max(F.struct("__row", "__tie")).alias("x")).select("x.*"), "staying")
    # Texts move once: rows alike in all columns meet where the join has put them.
    return docs.join(stay, ["__row", "__tie"]).dropDuplicates(["__row", "__tie"]).select(*cols)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    light = staged(docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "prints")
    return attach(light).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
