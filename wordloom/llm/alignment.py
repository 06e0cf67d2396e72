"""Cross-tokenizer alignment: which tokens of two vocabularies cover the same bytes of a text.

Tokens end at byte offsets. The shorter list of ends gallops through the longer one: from the place of the
end before, an end doubles its reach until it is passed, then halves the bracket. This
gives the rank of every end of the shorter list in the longer; ends that both lists have cut the text into
groups, and differences of ranks say which tokens of one list a token of the other overlaps.

Tokens that end together are linked. How often a pair of ids is linked is counted over the corpus, first
inside each document, and the counts go back to the documents.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import staged, table
from .tokenids import LONG, byte_symbols, encoder, ids_type, loaded

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
END = 1 << 62  # behind all ends
STRETCH = 1 << 16  # ends that are Python numbers at once
#: A space at which a text may be cut for the piece model: no piece has a space behind another character.
CUT = re.compile("(?<=[^ ▁]) (?=[^ ▁])")
#: Counted pairs that are broadcast, 24 bytes each; beyond, pairs are joined by a shuffle, apart from hot ones.
BROADCAST_PAIRS = 500_000
HOT_SHARE = 1000  # a pair with this part of all rows is hot: there are no more than this many
OUTPUTS = {"groups": pa.string(), "pairs": pa.list_(pa.int64()), "times": pa.list_(pa.int32()), "a_ids": pa.list_(pa.int32()), "b_ids": pa.list_(pa.int32()), "a_upto": pa.list_(pa.int32()), "b_upto": pa.list_(pa.int32()), "bytes_upto": pa.list_(pa.int64())}
COUNTS = ["n_a", "n_b", "n_groups", "n_links"]
DDL = {"groups": "string", "pairs": "array<long>", "times": "array<int>", "bytes_upto": "array<long>"}


# Vocabularies


class Bytes:
    """The bytes of each id, in one string with places and lengths."""

    def __init__(self, entries: list[bytes]):
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        self.sizes = np.array([len(x) for x in entries], np.int64)
        self.at = np.cumsum(self.sizes) - self.sizes

    def joined(self, ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if not len(ids):
            return self.blob[:0]
        return self.blob[np.arange(ends[-1]) + np.repeat(self.at[ids] - ends + self.sizes[ids], self.sizes[ids])]


@functools.cache
def bytes_a(path: str) -> Bytes:
    back = {s: b for b, s in byte_symbols().items()}
    entries = [b""] * loaded(path).get_vocab_size()
    for token, i in loaded(path).get_vocab().items():
        entries[i] = bytes(back[c] for c in token) if all(c in back for c in token) else token.encode()
    return Bytes(entries)


@functools.cache
def pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def may_be_cut(path: str) -> bool:
    """Whether no piece of the model crosses CUT, and the model puts a space before what it encodes."""
    model = pieces(path)
    crossing = any(re.search("[^▁]▁", model.id_to_piece(i)) for i in range(model.get_piece_size()))
    return not crossing and model.encode("a b") == [*model.encode("a"), *model.encode("b")] and model.encode(" b") != model.encode("b")


def piece_ids(path: str, text: str, long: int = LONG) -> np.ndarray:
    """The model's ids of a text. One of more than `long` characters is encoded in parts, cut where that changes nothing."""
    encode, out, low = pieces(path).encode, [], 0
    while may_be_cut(path) and len(text) - low > long and (m := CUT.search(text, low + long)):
        out.append(np.array(encode(text[low : m.start()]), np.int32))
        low = m.end()
    out.append(np.array(encode(text[low:]), np.int32))
    return np.concatenate(out)


@functools.cache
def bytes_b(path: str) -> Bytes:
    model = pieces(path)
    said = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    return Bytes([bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(said)])


# Ranks, groups, links


def ranks(short: np.ndarray, long: np.ndarray, stretch: int = STRETCH) -> np.ndarray:
    """Of each end of the rising list `short`, how many of the rising list `long` are less. Both are read in stretches, so
    that a long text's ends aren't all Python numbers at once."""
    out, at, n = np.empty(len(short), np.int64), 0, len(long)
    for i in range(0, len(short), stretch):
        part = short[i : i + stretch]
        upto, reach = at, 1
        while upto < n and long[upto] < part[-1]:
            upto += reach
            reach += reach
        out[i : i + len(part)] = galloped(part.tolist(), long[at : upto + 1].tolist())
        out[i : i + len(part)] += at
        at = int(out[i + len(part) - 1])
    return out


def galloped(short: list[int], long: list[int]) -> list[int]:
    ends, out, at, last = [*long, END], [], 0, len(long)
    for x in short:
        if ends[at] < x:
            at += 1
            reach = 1
            low = at
            while ends[at] < x:
                low = at + 1
                at = min(at + reach, last)
                reach += reach
            if low < at:
                at = bisect_left(ends, x, low, at)
        out.append(at)
    return out


def common(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both lists have."""
    if len(a) > len(b):
        return common(b, a)[::-1]
    at = ranks(a, b)
    both = np.flatnonzero(at < len(b))
    both = both[b[at[both]] == a[both]]
    return both, at[both]


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each token of a, by its end, the half-open range of tokens of b that it shares bytes with. Both end with the text."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = ranks(a, b)
    ended = at + (b[np.minimum(at, len(b) - 1)] == a)
    return np.concatenate([[0], ended[:-1]]), at + 1


def written(a: np.ndarray, b: np.ndarray, a_upto: np.ndarray, b_upto: np.ndarray, words: list[str]) -> str:
    """Groups as a1,a2|b1;a3|b2,b3. words: of each id, with a comma, a bar and a semicolon after it."""
    if not len(a_upto):
        return ""
    out, code_a, code_b = np.empty(len(a) + len(b), np.int64), 3 * a.astype(np.int64), 3 * b.astype(np.int64)
    code_a[a_upto - 1] += 1
    code_b[b_upto - 1] += 2
    before = lambda upto: np.repeat(np.concatenate([[0], upto[:-1]]), np.diff(np.concatenate([[0], upto])))
    out[np.arange(len(a)) + np.repeat(np.concatenate([[0], b_upto[:-1]]), np.diff(np.concatenate([[0], a_upto])))] = code_a
    out[np.arange(len(b)) + np.repeat(a_upto, np.diff(np.concatenate([[0], b_upto])))] = code_b
    return "".join([words[i] for i in out.tolist()])[:-1]


@functools.cache
def id_words(n: int) -> list[str]:
    return [f"{i}{mark}" for i in range(n) for mark in ",|;"]


class Aligner:
    """Two vocabularies at work in a task."""

    def __init__(self, path_a: str, path_b: str):
        self.encode_a, self.encode_b, self.width = encoder(path_a), functools.partial(piece_ids, path_b), ids_type(path_a)
        self.bytes_a, self.bytes_b = bytes_a(path_a), bytes_b(path_b)
        self.words = id_words(max(len(self.bytes_a.sizes), len(self.bytes_b.sizes)))
        self.nothing = tuple(np.zeros(0, np.int64) for _ in range(5))

    def __call__(self, text: str | None) -> tuple[np.ndarray, ...]:
        """(ids of A, ids of B, and of each group how many tokens of A, of B and bytes end with it). Nothing of
        a text that either vocabulary doesn't give back byte by byte."""
        if not text:
            return self.nothing
        data = (" " + text).encode("utf-8", "surrogatepass")
        whole, found = np.frombuffer(data, np.uint8), []
        for ids, table in ((np.frombuffer(self.encode_a(" " + text), self.width), self.bytes_a), (self.encode_b(text), self.bytes_b)):
            ends = np.cumsum(table.sizes[ids])
            if not len(ends) or ends[-1] != len(whole) or not np.array_equal(table.joined(ids, ends), whole):
                return self.nothing
            found.append((ids, ends))
        (a, ends_a), (b, ends_b) = found
        in_a, in_b = common(ends_a, ends_b)
        return a, b, in_a + 1, in_b + 1, ends_a[in_a]


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)])
    flat = np.concatenate(values) if values else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, kind.value_type))


def align(docs: DataFrame, outputs: tuple = ("a_ids", "b_ids", "a_upto", "b_upto", "bytes_upto"), path_a: str | None = None, path_b: str | None = None, own: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in `own`), n_a, n_b, n_groups, n_links and `outputs`; columns of these names are replaced.

    a_ids and b_ids are the tokens of a space and the text. Group k ends after token a_upto[k] of A, token
    b_upto[k] of B and byte bytes_upto[k], all counted from 1. groups writes them as text; pairs (A's id in
    the upper 32 bits, B's in the lower) and times count the document's links. A null or empty text, or one
    that a vocabulary doesn't give back byte by byte, has no tokens. Each row is worked on by itself, whole.
    """
    if path_a is None or path_b is None:
        import public_tokenizers

        path_a, path_b = path_a or public_tokenizers.path(VOCABULARY_A), path_b or public_tokenizers.path(VOCABULARY_B)
    kept = [c for c in (docs.columns if own is None else own) if c not in (*COUNTS, *outputs)]
    names = [f"__c{i}" for i in range(len(kept))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(path_a, path_b)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                columns: dict[str, list] = {c: [] for c in (*COUNTS, *outputs)}
                for text in part.column(part.num_columns - 1):
                    a, b, a_upto, b_upto, ends = aligner(text.as_py())
                    values = {"n_a": len(a), "n_b": len(b), "n_groups": len(ends), "n_links": len(ends), "a_ids": a, "b_ids": b, "a_upto": a_upto, "b_upto": b_upto, "bytes_upto": ends}
                    if "groups" in columns:
                        values["groups"] = written(a, b, a_upto, b_upto, aligner.words)
                    if "pairs" in columns or "times" in columns:
                        values["pairs"], values["times"] = np.unique(a[a_upto - 1].astype(np.int64) << 32 | b[b_upto - 1], return_counts=True)
                    for c in columns:
                        columns[c].append(values[c])
                arrays = [pa.array(columns[c], pa.int64()) for c in COUNTS] + [_lists(columns[c], OUTPUTS[c]) if pa.types.is_list(OUTPUTS[c]) else pa.array(columns[c], OUTPUTS[c]) for c in outputs]
                yield pa.record_batch([*part.columns[:-1], *arrays], [*names, *COUNTS, *outputs])

    given = docs.select(*(F.col(c).alias(n) for c, n in zip(kept, names)), F.col("text").alias("__text"))
    made = StructType.fromDDL(", ".join([*(f"{c} long" for c in COUNTS), *(f"{c} {DDL.get(c, 'array<int>')}" for c in outputs)]))
    schema = StructType([*(StructField(n, docs.schema[c].dataType) for c, n in zip(kept, names)), *made.fields])
    return given.mapInArrow(run, schema).withColumnsRenamed(dict(zip(names, kept)))


def spans(aligned: DataFrame) -> DataFrame:
    """A row a group of align()'s rows: group_no, a_ids, b_ids and the group's bytes, start to end."""
    own = [c for c in aligned.columns if c not in ("a_ids", "b_ids", "a_upto", "b_upto", "bytes_upto")]
    rows = aligned.select(*own, "a_ids", "b_ids", "a_upto", "b_upto", "bytes_upto", F.posexplode("bytes_upto").alias("group_no", "end"))
    before = lambda c: F.coalesce(F.get(c, F.col("group_no") - 1), F.lit(0))
    ids = lambda x: F.slice(f"{x}_ids", (before(f"{x}_upto") + 1).cast("int"), (F.get(f"{x}_upto", F.col("group_no")) - before(f"{x}_upto")).cast("int"))
    return rows.select(*own, "group_no", ids("a").alias("a_ids"), ids("b").alias("b_ids"), before("bytes_upto").alias("start"), "end")


def link_counts(rows: DataFrame) -> DataFrame:
    """(pair, n, rows, best), staged: of each pair of ids in rows (pairs, times) its links, the rows that have it, and
    whether no pair of its B id has more."""
    each = rows.select(F.inline(F.arrays_zip("pairs", "times")))
    counted = staged(each.groupBy(F.col("pairs").alias("pair")).agg(F.sum("times").alias("n"), F.count("*").alias("rows")), "link-counts")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    top = counted.groupBy(b.alias("b")).agg(F.max("n").alias("most"))  # a row an id of B
    joined = counted.withColumn("b", b).join(F.broadcast(top), "b")
    return staged(joined.select("pair", "n", "rows", (F.col("n") == F.col("most")).alias("best")), "links-ranked")


def scored(rows: DataFrame, broadcast_pairs: int = BROADCAST_PAIRS) -> DataFrame:
    """rows (pairs, times, cheap to read again) with n_best, links whose pair is the commonest of its B id, and count_sum,
    their pairs' counts added up, in place of pairs and times."""
    rows = staged(rows.withColumn("__row", F.monotonically_increasing_id()), "aligned")
    counts = link_counts(rows)
    each = rows.select("__row", F.inline(F.arrays_zip(F.col("pairs").alias("pair"), F.col("times").alias("time"))))
    if counts.limit(broadcast_pairs + 1).count() <= broadcast_pairs:
        met = each.join(F.broadcast(counts.drop("rows")), "pair")
    else:
        # A pair has at most one row a document, so those of a thousandth of all rows are a thousand at most.
        least = counts.agg(F.sum("rows")).first()[0] / HOT_SHARE
        hot = F.broadcast(counts.where(F.col("rows") >= least).drop("rows"))
        met = each.join(hot, "pair").unionByName(each.join(hot, "pair", "left_anti").join(counts.where(F.col("rows") < least).drop("rows"), "pair"))
    sums = met.groupBy("__row").agg(F.sum(F.when(F.col("best"), F.col("time")).otherwise(0)).alias("n_best"), F.sum(F.col("time") * F.col("n")).alias("count_sum"))
    out = rows.drop("pairs", "times", "n_best", "count_sum").join(sums, "__row", "left").drop("__row")
    return out.withColumns({c: F.coalesce(c, F.lit(0)).cast("long") for c in ("n_best", "count_sum")})


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = align(table(spark, sf_dir, "documents").select("doc_id", "text"), ("groups", "pairs", "times"), own=["doc_id"])
    groups = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return scored(rows.withColumn("groups_sha256", groups).drop("groups")).select("doc_id", *COUNTS, "n_best", "count_sum", "groups_sha256")
