"""Benchmark decontamination with an FM-index per training shard.

A shard is the documents of one Arrow batch, or a stretch of SHARD_WORDS of their words, which
bounds the index. Words are numbered by the benchmark's own
vocabulary; a word outside it can be in no occurrence, so a shard's text for the index is
its runs of in-vocabulary words at least as long as the shortest window. The index is a
suffix array's Burrows-Wheeler transform in a wavelet matrix, with sampled suffix positions.
All windows are searched backward at once, a word a step; what remains is located by walking
to a sampled position, and overlapping occurrences merge into removal spans.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, row_key, staged, table

WINDOW, SAMPLE = 10, 16
#: Benchmark text in one block of windows, in bytes; more makes more blocks, searched one after
#: another. A block of this size takes some 100 MB of the driver and of each worker.
BLOCK_BYTES = 8_000_000
SHARD_WORDS = 500_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_TO = bytes(32 if i < 128 and not chr(i).isalnum() else i + 32 if 65 <= i <= 90 else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing A-Z, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_TO).split() if text else []


class Windows:
    """The windows of some items: by length a matrix of word numbers, and each window's items."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.number: dict[bytes, int] = {}
        found: dict[int, list[tuple[np.ndarray, int | None]]] = {}
        for item, text in items:
            w = np.array([self.number.setdefault(x, len(self.number) + 2) for x in words_of(text)], np.int32)
            if len(w):
                n = min(window, len(w))
                found.setdefault(n, []).append((np.lib.stride_tricks.sliding_window_view(w, n), item))
        self.by_length, holders, base = [], [], 0
        for n, parts in sorted(found.items()):
            keys, number = np.unique(np.concatenate([p for p, _ in parts]), axis=0, return_inverse=True)
            many = [len(p) for p, _ in parts]
            null = np.repeat([i is None for _, i in parts], many)
            pairs = np.stack([number.reshape(-1) + base, np.repeat([i or 0 for _, i in parts], many)], axis=1)
            holders.append(np.unique(pairs[~null], axis=0))
            self.by_length.append((n, keys))
            base += len(keys)
        pairs = np.concatenate(holders) if holders else np.zeros((0, 2), np.int64)
        self.item_at = np.concatenate([[0], np.cumsum(np.bincount(pairs[:, 0], minlength=base))]).astype(np.int64)
        self.items = pairs[:, 1]
        self.shortest = min(found, default=0)
        self.longest = max(found, default=0)


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol is smaller than all others."""
    n, k, rank = len(t), 1, t.astype(np.int64)
    sa = np.argsort(rank, kind="stable")
    while True:
        ordered = rank[sa]
        dense = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[sa] = dense
        if dense[-1] == n - 1:
            return sa
        then = np.zeros(n, np.int64)
        then[:-k] = rank[k:] + 1
        rank = rank * (n + 1) + then
        sa, k = np.argsort(rank, kind="stable"), 2 * k


class FMIndex:
    def __init__(self, t: np.ndarray, sample: int = SAMPLE):
        sa = suffix_array(t)
        seq = t[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t))])
        self.marked = sa % sample == 0
        self.mark_rank = np.concatenate([[0], np.cumsum(self.marked)])
        self.sampled = sa[self.marked]
        self.levels = []
        for b in range(max(1, int(t.max()).bit_length()) - 1, -1, -1):
            bit = (seq >> b) & 1
            zero = np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int64)
            self.levels.append((b, zero, zero[-1], bit.astype(np.int8)))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Of each symbol, how often it stands before row i of the transform."""
        start = np.zeros_like(i)
        for b, zero, zeros, _ in self.levels:
            one = ((c >> b) & 1).astype(bool)
            i = np.where(one, zeros + i - zero[i], zero[i])
            start = np.where(one, zeros + start - zero[start], zero[start])
        return i - start

    def search(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the patterns (rows of p) that occur: which, and the range of suffixes they begin."""
        which = np.flatnonzero((p < len(self.first) - 1).all(axis=1))
        lo, hi = np.zeros(len(which), np.int64), np.full(len(which), self.first[-1])
        for j in range(p.shape[1] - 1, -1, -1):
            c = p[which, j]
            lo, hi = self.first[c] + self.rank(c, lo), self.first[c] + self.rank(c, hi)
            on = hi > lo
            which, lo, hi = which[on], lo[on], hi[on]
        return which, lo, hi

    def locate(self, row: np.ndarray) -> np.ndarray:
        at, steps, left = np.empty(len(row), np.int64), np.zeros(len(row), np.int64), np.arange(len(row))
        row = row.copy()
        while len(left):
            done = self.marked[row[left]]
            d = left[done]
            at[d] = self.sampled[self.mark_rank[row[d]]] + steps[d]
            left = left[~done]
            i, c = row[left], np.zeros(len(left), np.int64)
            start = np.zeros_like(i)
            for b, zero, zeros, bit in self.levels:
                one = bit[i].astype(bool)
                c |= one.astype(np.int64) << b
                i = np.where(one, zeros + i - zero[i], zero[i])
                start = np.where(one, zeros + start - zero[start], zero[start])
            row[left] = self.first[c] + i - start
            steps[left] += 1
        return at


def occurrences(w: Windows, ids: np.ndarray, most: int = SHARD_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(window, place of its first word in ids, its length) of all occurrences, from stretches of `most`
    words; a stretch reads on for as long as a window that begins in it may go."""
    for start in range(0, len(ids), most):
        for window, at, n in indexed(w, ids[start : start + most + max(0, w.longest - 1)]):
            own = at < most
            yield window[own], at[own] + start, n


def indexed(w: Windows, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Occurrences in one index; 0 in ids is a word of no item, and ends a document."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], ids > 0, [0]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= max(1, w.shortest)
    start, end = start[long], end[long]
    if not len(start):
        return
    size = end - start + 1  # with a separator
    t = np.ones(size.sum() + 1, np.int64)
    head = np.concatenate([[0], np.cumsum(size)[:-1]])
    place = np.arange(size.sum()) - np.repeat(head, size) + np.repeat(start, size)
    inside = np.arange(size.sum()) - np.repeat(head, size) < np.repeat(end - start, size)
    t[:-1][inside] = ids[place[inside]]
    t[-1] = 0
    index, base = FMIndex(t), 0
    for n, p in w.by_length:
        which, lo, hi = index.search(p)
        if count := int((hi - lo).sum()):
            row = np.arange(count) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            yield np.repeat(which, hi - lo) + base, place[index.locate(row)], n
        base += len(p)


def search_shard(w: Windows, texts: list[str | None]) -> list[dict]:
    """Of each document: n_words, items and spans (start, end) in words, merged, end excluded."""
    number, parts, counts = w.number.get, [], []
    for text in texts:
        x = words_of(text)
        counts.append(len(x))
        parts.append(np.fromiter((number(y, 0) for y in x), np.int64, len(x)))
        parts.append(np.zeros(1, np.int64))  # no run crosses into the next document
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    begin = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
    cover, pairs = np.zeros(len(ids) + 1, np.int64), []
    for window, at, n in occurrences(w, ids):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + n, -1)
        doc = np.searchsorted(begin, at, side="right") - 1
        pairs.append(np.unique(np.stack([doc, window], axis=1), axis=0))
    out = [{"n_words": n, "items": [], "spans": []} for n in counts]
    if not pairs:
        return out
    doc, window = np.concatenate(pairs).T
    many = w.item_at[window + 1] - w.item_at[window]
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(w.item_at[window], many)
    for d, item in np.unique(np.stack([np.repeat(doc, many), w.items[place]], axis=1), axis=0):
        out[d]["items"].append(int(item))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(cover[:-1]) > 0, [0]]).astype(np.int8)))
    for s, e in zip(edge[::2], edge[1::2]):
        d = int(np.searchsorted(begin, s, side="right")) - 1
        out[d]["spans"].append({"start": int(s - begin[d]), "end": int(e - begin[d])})
    return out


HIT = pa.struct([("n_words", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list]:
    """The benchmark's (item_id, text) in blocks of bounded size, read a partition at a time."""
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= limit:
            yield block
            block, size = [], 0
    yield block


def hits(text: Column, sent: Broadcast) -> Column:
    """n_words, items and spans by the Windows that were sent."""
    @F.arrow_udf("struct<n_words:long,items:array<long>,spans:array<struct<start:long,end:long>>>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(search_shard(sent.value, texts.to_pylist()), HIT)

    return of(text)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, n_hit, items (sorted ids), spans and contaminated; columns of these names are replaced.

    A null or empty text has no words and no hits; an item without words no windows. An item of
    fewer words than the window is one window. Items with a null id hit but are not listed;
    items that repeat are listed once. Spans count words, merged in a document.

    A benchmark of one block is searched in one pass. Of a larger one each block is searched in a
    pass of its own, whose hits are written before the next begins.
    """
    docs = docs.drop("n_words", "n_hit", "items", "spans", "contaminated")
    spark, text = docs.sparkSession, F.col("text")
    several, found = blocks(benchmark, block_bytes), []
    block, after = next(several), next(several, None)
    if after is None:
        docs = docs.withColumn("__hit", hits(text, spark.sparkContext.broadcast(Windows(block, window))))
    else:
        keyed = docs.withColumn("__row", row_key())
        while block is not None:
            sent = spark.sparkContext.broadcast(Windows(block, window))
            hit = keyed.select("__row", hits(text, sent).alias("hit"))
            found.append(staged(hit.where(F.size("hit.spans") > 0), f"hits-{len(found)}"))
            sent.destroy()
            block, after = after, next(several, None)
        docs = joined(keyed, found)
    docs = docs.withColumns({"n_words": F.col("__hit.n_words"), "items": F.col("__hit.items"), "spans": F.col("__hit.spans")})
    n = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return docs.withColumn("n_hit", n).withColumn("contaminated", F.col("n_hit") > 0).drop("__hit")


def joined(keyed: DataFrame, found: list[DataFrame]) -> DataFrame:
    """keyed with __hit, the hits that several blocks found in a row of the same __row. Rows alike in id
    and text have the same hits, so of each block one row a key goes on."""
    rows = functools.reduce(DataFrame.unionByName, (x.groupBy("__row").agg(F.any_value("hit").alias("hit")) for x in found))
    all_of = lambda x: F.sort_array(F.flatten(F.collect_list(f"hit.{x}")))
    rows = rows.groupBy("__row").agg(F.array_distinct(all_of("items")).alias("items"), all_of("spans").alias("all"))
    # Sorted spans of all blocks, merged where they touch.
    last = lambda a: F.get(a, F.size(a) - 1)
    longer = lambda a, s: F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], s["end"]).alias("end"))
    none = F.array().cast("array<struct<start:long,end:long>>")
    merged = F.aggregate(
        "all", none,
        lambda a, s: F.when((F.size(a) > 0) & (last(a)["end"] >= s["start"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(longer(a, s)))).otherwise(F.concat(a, F.array(s))),
    )
    rows = rows.select("__row", "items", merged.alias("spans"))
    n_words = F.size(F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))).cast("long")
    hit = F.struct(n_words.alias("n_words"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce("spans", none).alias("spans"))
    return keyed.join(rows, "__row", "left").withColumn("__hit", hit).drop("__row", "items", "spans")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that share no window with the benchmark, in docs' columns."""
    own = [c for c in docs.columns if c not in ("n_words", "n_hit", "items", "spans", "contaminated")]
    found = contamination(docs.select(*own, *(F.col(c).alias(f"__own_{c}") for c in docs.columns if c not in own)), benchmark).where(~F.col("contaminated"))
    return found.select(*(F.col(c if c in own else f"__own_{c}").alias(c) for c in docs.columns))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM bw, LATERAL (SELECT unnest(range(1, greatest(2, len(w) - 8))) AS i) WHERE len(w) > 0),
lens AS (SELECT DISTINCT n FROM win),
occ AS (
  SELECT d.doc_id, i, lens.n, array_to_string(d.w[i:i + lens.n - 1], ' ') AS k
  FROM dw d, lens, LATERAL (SELECT unnest(range(1, len(d.w) - lens.n + 2)) AS i) WHERE len(d.w) >= lens.n),
hit AS (SELECT occ.doc_id, occ.i, occ.n, win.item_id FROM occ JOIN win ON occ.k = win.k AND occ.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id)
SELECT dw.doc_id, len(dw.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN its ON dw.doc_id = its.doc_id
"""
