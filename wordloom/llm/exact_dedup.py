"""Exact dedup by a Golomb-coded exchange of fingerprints.

Texts are normalised, fingerprinted and written once, each row with its sender, the task that wrote it.
Every sender sorts its distinct fingerprints and sends each owner (a range of fingerprints) the ones that
it owns, as gaps in Golomb's code. An owner finds those that came from two senders, or twice from one,
and answers each message with a bitmap. A sender reads its bitmaps from the shared folder and so
knows its suspects; only these are shuffled, and grouped by their bytes. All others stay where they are.

Fingerprints are as short as the number of rows allows (SPARE bits more than it needs), so a message costs
two to four bytes a row, and one row in some thousands is a suspect without a partner.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged, table

SPARE = 12
OWNER_ROWS = 4_000_000  # fingerprints that an owner gathers
SENDER_ROWS = 1_000_000  # fingerprints that a message's task sorts at once
HOT_SHARE = 1000  # a class with this part of all suspects is hot: there are no more than this many
MESSAGE = "sender long, owner long, part long, n long, first long, log_gap int, quotients binary, remainders binary, repeats binary"


# Golomb's code, with a power of two as the divisor: quotients in unary, remainders in log_gap bits


def coded(values: np.ndarray) -> tuple[int, int, bytes, bytes]:
    """(first, log_gap, quotients, remainders) of rising values."""
    gaps = np.diff(values, prepend=values[:1] - 1) - 1
    log_gap = max(0, int(gaps.mean()).bit_length() - 1)
    ones = np.cumsum((gaps >> log_gap) + 1) - 1  # a gap's unary quotient ends at its one
    unary = np.zeros(int(ones[-1]) + 1, np.uint8)
    unary[ones] = 1
    bits = np.unpackbits(gaps.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :log_gap]
    return int(values[0]), log_gap, np.packbits(unary).tobytes(), np.packbits(bits.ravel()).tobytes()


def decoded(n: int, first: int, log_gap: int, quotients: bytes, remainders: bytes) -> np.ndarray:
    ones = np.flatnonzero(np.unpackbits(np.frombuffer(quotients, np.uint8)))[:n].astype(np.int64)
    high = np.diff(ones, prepend=np.int64(-1)) - 1
    bits = np.zeros((n, 64), np.uint8)
    bits[:, :log_gap] = np.unpackbits(np.frombuffer(remainders, np.uint8))[: n * log_gap].reshape(n, log_gap)
    low = np.packbits(bits, axis=1, bitorder="little").view("<i8").ravel()
    return first - 1 + np.cumsum((high << log_gap) + low + 1)


# The exchange


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sent(prints: DataFrame, owners: int, width: int, rows: int = SENDER_ROWS) -> DataFrame:
    """MESSAGE rows of (__sender, __print): prints are numbers under 2^width. A task that sees a sender in several
    parts, or several tasks that do, send several messages."""
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, held, waiting, count = TaskContext.get().partitionId(), {}, 0, 0

        def flush():
            nonlocal held, waiting, count
            out = []
            for sender, parts in held.items():
                values, times = np.unique(np.concatenate(parts), return_counts=True)
                owner = (values * owners) >> width if width + owners.bit_length() < 63 else (values // ((1 << width) // owners + 1))
                cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                for low, high in zip(cuts, [*cuts[1:], len(values)]):
                    part = values[low:high]
                    out.append((sender, int(owner[low]), task << 32 | count, len(part), *coded(part), np.packbits((times[low:high] > 1).astype(np.uint8)).tobytes()))
                count += 1
            held, waiting = {}, 0
            columns = zip(*out)
            types = [pa.int64()] * 5 + [pa.int32()] + [pa.binary()] * 3
            return pa.record_batch([pa.array(list(c), t) for c, t in zip(columns, types)], [x.split()[0] for x in MESSAGE.split(", ")])

        for batch in batches:
            sender, value = (batch.column(i).to_numpy() for i in (0, 1))
            for s in np.unique(sender).tolist():
                held.setdefault(s, []).append(value[sender == s])
            waiting += len(value)
            if waiting >= rows:
                yield flush()
        if held:
            yield flush()

    return prints.select("__sender", "__print").mapInArrow(encode, MESSAGE)


def answered(messages: DataFrame) -> DataFrame:
    """(sender, part, owner, dups): of each message a bitmap of the prints that others sent too, or that repeat. An
    owner's messages are one group: about OWNER_ROWS prints however many senders there are, a few bytes each."""
    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        lists = [decoded(r["n"], r["first"], r["log_gap"], r["quotients"], r["remainders"]) for r in rows]
        repeats = np.concatenate([np.unpackbits(np.frombuffer(r["repeats"], np.uint8))[: r["n"]] for r in rows])
        _, place, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        dups, at, out = ((times[place] > 1) | (repeats > 0)).astype(np.uint8), 0, []
        for r in rows:
            out.append(np.packbits(dups[at : at + r["n"]]).tobytes())
            at += r["n"]
        return pa.table([group.column("sender"), group.column("part"), group.column("owner"), pa.array(out, pa.binary())], ["sender", "part", "owner", "dups"])

    return messages.groupBy("owner").applyInArrow(answer, "sender long, part long, owner long, dups binary")


def marked(rows: DataFrame, base: str, suspects: bool) -> DataFrame:
    """The rows whose sender was told that their print is a duplicate, or the others. base holds a folder a sender."""
    place = [rows.columns.index(c) for c in ("__sender", "__print")]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        known: dict[int, np.ndarray] = {}

        def told(sender: int) -> np.ndarray:
            if sender not in known:
                known.clear()
                found = [np.zeros(0, np.int64)]
                files = [f.path for f in fs.get_file_info(pafs.FileSelector(f"{root}/sender={sender}", allow_not_found=True)) if f.path.endswith(".parquet")]
                for f in files:
                    with fs.open_input_file(f) as source:
                        for batch in pq.ParquetFile(source).iter_batches(256, columns=["n", "first", "log_gap", "quotients", "remainders", "dups"]):
                            for r in batch.to_pylist():
                                dups = np.unpackbits(np.frombuffer(r["dups"], np.uint8))[: r["n"]] > 0
                                found.append(decoded(r["n"], r["first"], r["log_gap"], r["quotients"], r["remainders"])[dups])
                known[sender] = np.unique(np.concatenate(found))
            return known[sender]

        for batch in batches:
            sender, value = (batch.column(i).to_numpy() for i in place)
            told_of = np.zeros(len(value), np.bool_)
            for s in np.unique(sender).tolist():
                mine = sender == s
                told_of[mine] = np.isin(value[mine], told(s))
            yield batch.filter(pa.array(told_of == suspects))

    return rows.mapInArrow(mark, rows.schema)


class Classes:
    """Classes of equal texts in docs (whose texts are normalised already, if `plain`). Rows are told apart by the
    place that they were written to."""

    def __init__(self, docs: DataFrame, plain: bool = False, owner_rows: int = OWNER_ROWS, spare: int = SPARE):
        spark = docs.sparkSession
        self.columns = docs.columns
        self.norm = F.col("__text") if plain else normalised(F.col("__text"))
        others = [c for c in self.columns if c not in ("doc_id", "text")]
        self.names = {"__id": "doc_id", "__text": "text"} | {f"__c{i}": c for i, c in enumerate(others)}
        given = docs.select(*(F.col(c).alias(n) for n, c in self.names.items()))
        given = given.withColumns({"__sha": F.sha2(self.norm, 256), "__hash": F.xxhash64(self.norm), "__tie": F.xxhash64(*(n for n in self.names if "map<" not in given.schema[n].dataType.simpleString())), "__sender": F.spark_partition_id().cast("long"), "__seq": F.monotonically_increasing_id()})
        rows = staged(given, "dedup-rows")
        n = rows.count()
        width = min(62, max(16, n.bit_length() + spare))
        self.rows = rows.withColumn("__print", F.shiftrightunsigned("__hash", 64 - width)).drop("__hash")
        # As many owners as there are partitions of a shuffle, and more where one would gather too much.
        owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + n // owner_rows)
        messages = staged(sent(self.rows, owners, width), "dedup-messages")
        self.base = scratch(spark, "dedup-bitmaps")
        known = messages.drop("repeats").join(answered(messages), ["sender", "part", "owner"])
        known.repartition("sender").write.partitionBy("sender").parquet(self.base)
        light = ["__id", "__sha", "__tie", "__seq", "__sender", "__print"]
        suspects = marked(self.rows.select(*light, "__text"), self.base, True).withColumn("__norm", self.norm).drop("__text", "__sender", "__print")
        self.suspects = staged(suspects.withColumn("__md5", F.md5("__norm")), "dedup-suspects")
        self.alone = marked(self.rows.select(*light), self.base, False)
        # Verified by all bytes, counted in each task before they move. Were there two texts of one digest, another would tell them apart.
        texts = self.suspects.groupBy("__sha", "__norm").agg(F.count("*").alias("n"))
        self.keys = ["__sha"] if texts.groupBy("__sha").count().where("count > 1").isEmpty() else ["__sha", "__md5"]
        first = F.min(F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__tie").alias("tie"), F.col("__seq").alias("seq"))).alias("first")
        self.classes = staged(self.suspects.groupBy(*self.keys).agg(first, F.count("*").alias("n")), "dedup-classes")

    def verdicts(self) -> DataFrame:
        """(__id, __sha, keep_id, group_size, kept) of every row."""
        one = self.alone.select("__id", "__sha", F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        rows, total = self.suspects.select("__id", "__seq", *self.keys), self.suspects.count()
        hot = F.col("n") * HOT_SHARE >= total
        many, few = F.broadcast(self.classes.where(hot)), self.classes.where(~hot)
        # At most HOT_SHARE classes hold a thousandth of the suspects each; no other key is hot.
        met = rows.join(many, self.keys).unionByName(rows.join(many, self.keys, "left_anti").join(few, self.keys))
        return one.unionByName(met.select("__id", "__sha", F.col("first.id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("__seq") == F.col("first.seq")).alias("kept")))


def exact_duplicates(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row of docs.

    Texts are equal when alike after each run of white space is made one space; a null text is empty. Of
    equal texts the row of the smallest doc_id stays, a null id only where there is no other; of several rows with
    that id, one. An empty table gives no rows. docs' other columns are left out.
    """
    found = Classes(docs.select("doc_id", normalised(F.col("text")).alias("text")), plain=True, **settings).verdicts()
    return found.select(F.col("__id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("__sha").alias("text_sha256"))


def distinct_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that stay, with all their columns: those without a suspect fingerprint from where they are, and
    of the others one a class. Of a class's rows with its smallest id the first by a hash of all columns stays, the
    same in every run."""
    found = Classes(docs, **settings)
    stay = found.classes.select(F.col("first.seq").alias("__seq"))
    kept = marked(found.rows, found.base, True).join(stay, "__seq", "left_semi")
    rows = marked(found.rows, found.base, False).unionByName(kept)
    return rows.select(*(F.col(n).alias(c) for n, c in found.names.items())).select(*found.columns)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size, sha256(t) AS text_sha256 FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (t)
"""
