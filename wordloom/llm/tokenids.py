"""Token ids in Arrow's stream-file format: batches of fixed-size lists.

Documents, in ascending doc_id, become one stream of ids, each document followed by END. The
stream is cut into sequences of equal length, stored as a fixed-size list of ids (uint16 where
the vocabulary fits, else uint32) with a fixed-size list of mask bytes (1 for an id, 0 for the
padding that ends a file), so ids and mask of sequence i of a memory-mapped file are found by
multiplication, without a copy. Masks are a dictionary's entries: all sequences but a file's last have the same. Beside each file an
index file names the documents, their starts in it and their lengths. Files hold ascending
ranges of doc_id; a manifest lists them in order with their ids' counts.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch, staged, table

END, LENGTH, BATCH = 0, 2048, 256
VOCABULARY = "byte_bpe_50k.json"
MEMO = 800_000  # words whose ids a worker keeps
LONG = 1 << 20  # characters
#: White space as the vocabulary's split pattern has it.
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The vocabulary's split pattern in terms of `re`, right for texts without odd characters.
WORD = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^{_WHITE}\w]|_)+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
#: For other texts: runs of characters that aren't white space, with the one space before them, or what
#: the pattern makes of white space. No token crosses these chunks.
CHUNK = re.compile(f" ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]+")
_ASTRAL = re.compile("[\U00010000-\U0010ffff]")


def _is_odd(c: str) -> bool:
    """Numerals that `re` counts as word characters but not as digits, and characters that this Python's
    Unicode doesn't have yet, of which the library may know better."""
    return unicodedata.category(c) in ("Nl", "No", "Cn")


@functools.cache
def _odd_pattern() -> re.Pattern:
    """A class of the odd characters below U+10000; one with those above too would try each range at each character."""
    odd, spans = [i for i in range(128, 0x10000) if _is_odd(chr(i))], []
    for i in odd:
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return re.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]")


def is_odd(text: str) -> bool:
    """Whether a text has characters that WORD may read otherwise than the library."""
    if text.isascii():
        return False
    return bool(_odd_pattern().search(text)) or any(map(_is_odd, set(_ASTRAL.findall(text))))


@functools.cache
def loaded(path: str):
    """The tokenizer, once a process. Its users set encode_special_tokens before each call."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def ids_type(path: str) -> str:
    """The numpy type of stored ids: two bytes where every id fits."""
    return "<u2" if loaded(path).get_vocab_size() <= 1 << 16 else "<u4"


@functools.cache
def split_as_known(path: str) -> bool:
    """Whether the file is a byte-level model with the usual split pattern and nothing before or besides it."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre, model = said.get("pre_tokenizer") or {}, said["model"]
    usual = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
    return bool(usual and plain and not said.get("normalizer") and not said.get("truncation"))


@functools.cache
def encoder(path: str) -> Callable[[str], bytes]:
    """text -> its ids, little-endian, as wide as ids_type says.

    Words of the split pattern go to the vocabulary's model one by one, and their ids are
    remembered, in bounded number. Texts with odd characters are encoded by chunks, whole.
    Strings of special tokens are ordinary text here; contract_encoder reads them as tokens. A file of
    another kind than WORD is made for goes to the library, text by text.
    """
    tokenizer = loaded(path)
    tokenize, symbols, width = tokenizer.model.tokenize, byte_symbols(), ids_type(path)
    if not split_as_known(path):
        return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=width).tobytes()

    class Memo(dict):
        def __missing__(self, word: str) -> bytes:
            got = np.array([t.id for t in tokenize(word.encode().decode("latin-1").translate(symbols))], dtype=width).tobytes()
            if len(word) <= 64:
                if len(self) >= MEMO:
                    self.clear()
                self[word] = got
            return got

    memo = Memo()

    def encode(text: str) -> bytes:
        if is_odd(text):
            tokenizer.encode_special_tokens = True
            return b"".join([np.array(tokenizer.encode(c, add_special_tokens=False).ids, dtype=width).tobytes() for c in CHUNK.findall(text)])
        if len(text) > LONG:  # its words needn't all be strings at once
            return b"".join(memo[m[0]] for m in WORD.finditer(text))
        return b"".join([memo[w] for w in WORD.findall(text)])

    return encode


@functools.cache
def contract_encoder(path: str) -> Callable[[str], bytes]:
    """text -> the ids of the file's own encode(text, add_special_tokens=False), as encoder gives them.

    The library takes added tokens out of a text before anything else. A text that holds one's
    content goes whole through the unmodified tokenizer; no other text is changed by that step.
    """
    tokenizer, words, width = loaded(path), encoder(path), ids_type(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def encode(text: str) -> bytes:
        if any(a in text for a in added):
            tokenizer.encode_special_tokens = False
            return np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=width).tobytes()
        return words(text)

    return encode


def byte_symbols() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, and the others, in order, from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


def schema(length: int, width: str) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(np.dtype(width)), length)), ("mask", pa.dictionary(pa.int8(), pa.list_(pa.uint8(), length)))])


INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


class SequenceFile:
    """Writes one file of sequences and its index; both get their names only when complete."""

    def __init__(self, base: str, shard: int, width: str, length: int = LENGTH):
        self.fs, root = pafs.FileSystem.from_uri(base)
        self.fs.create_dir(root, recursive=True)
        self.path = f"{root}/{shard:06d}-{uuid.uuid4().hex}"
        self.uri, self.length = f"{base}/{self.path.rsplit('/', 1)[1]}", length
        self.out = self.fs.open_output_stream(f"{self.path}.tmp")
        self.width, self.bytes = width, np.dtype(width).itemsize
        self.writer = pa.ipc.new_file(self.out, schema(length, width), options=pa.ipc.IpcWriteOptions(emit_dictionary_deltas=True))
        self.waiting: list[bytes] = []
        self.size = self.held = 0
        self.docs: list[pa.RecordBatch] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.bytes
        self.rows.append((doc_id, self.size, n))
        self.waiting.append(ids)
        self.size += n
        self.held += n
        if self.held >= self.length * BATCH:
            self.flush()
        if len(self.rows) >= 10_000:
            self.pack()

    def pack(self) -> None:
        self.docs.append(pa.record_batch([pa.array(c, pa.int64()) for c in zip(*self.rows)] if self.rows else [pa.array([], pa.int64())] * 3, schema=INDEX))
        self.rows = []

    def flush(self, last: bool = False) -> None:
        ids, width = np.frombuffer(b"".join(self.waiting), self.width), self.length
        unit = width if last else width * BATCH  # all batches but a file's last are full
        whole = len(ids) // unit * unit
        for i in range(0, whole, width * BATCH):
            self.put(ids[i : min(whole, i + width * BATCH)], None)
        rest = ids[whole:]
        if last and len(rest):
            self.put(np.concatenate([rest, np.zeros(width - len(rest), self.width)]), len(rest))
            rest = rest[:0]
        self.waiting, self.held = [rest.tobytes()], len(rest)

    def put(self, ids: np.ndarray, real: int | None) -> None:
        masks = np.ones(self.length * (1 if real is None else 2), np.uint8)
        if real is not None:
            masks[self.length + real :] = 0
        lists = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, masks)]
        which = pa.array([int(real is not None)] * len(lists[0]), pa.int8())
        columns = [lists[0], pa.DictionaryArray.from_arrays(which, lists[1])]
        self.writer.write_batch(pa.record_batch(columns, schema=schema(self.length, self.width)))

    def close(self) -> tuple[str, int, int]:
        self.flush(last=True)
        self.writer.close()
        self.out.close()
        self.pack()
        with self.fs.open_output_stream(f"{self.path}.index.tmp") as out, pa.ipc.new_file(out, INDEX) as w:
            for b in self.docs:
                w.write_batch(b)
        self.fs.move(f"{self.path}.index.tmp", f"{self.path}.index.arrow")
        self.fs.move(f"{self.path}.tmp", f"{self.path}.arrow")
        return self.uri, self.size, sum(b.num_rows for b in self.docs)


class Reader:
    """Random access to a file: sequences by number, spans of ids across them. Local files are memory-mapped."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(f"{uri}.arrow")
        source = pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.length = self.file.schema.field("ids").type.list_size
        self.at, self.batch = -1, None
        with fs.open_input_file(path.removesuffix(".arrow") + ".index.arrow") as f:
            self.index = pa.ipc.open_file(f).read_all()

    def _batch(self, i: int) -> pa.RecordBatch:
        if self.at != i:
            self.at, self.batch = i, self.file.get_batch(i)
        return self.batch

    def _place(self, at: int) -> tuple[int, int]:
        """The batch of an id, and its place there. A file has full batches, then at most two short
        ones: the rest, and the padded last sequence."""
        full = self.length * BATCH
        b, lo = divmod(at, full)
        last = self.file.num_record_batches - 1
        if b == last - 1 and lo >= (held := self._batch(b).num_rows * self.length):
            return last, lo - held
        return b, lo

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask of sequence i, views of the file."""
        b, lo = self._place(i * self.length)
        ids, mask = self._batch(b).columns
        at = mask.indices[lo // self.length].as_py() * self.length
        return ids.values.to_numpy(zero_copy_only=True)[lo : lo + self.length], mask.dictionary.values.to_numpy(zero_copy_only=True)[at : at + self.length]

    def span(self, start: int, n: int) -> Iterator[np.ndarray]:
        """The ids start to start + n, in views of one batch each."""
        while n > 0:
            b, lo = self._place(start)
            flat = self._batch(b).column(0).values.to_numpy(zero_copy_only=True)
            got = flat[lo : lo + n]
            yield got
            start, n = start + len(got), n - len(got)


def write_sequences(docs: DataFrame, base: str, vocabulary: str | None = None, length: int = LENGTH) -> DataFrame:
    """Write documents (doc_id, text) under base and return the manifest (shard, file, n_ids, n_docs), staged.

    A null text is empty and gives END alone. Null ids come first. Rows of one id, or of none, stand
    in the order of their texts and may fall into several ranges where the texts' first 64
    characters differ. Rows that repeat are documents of their own. A task writes one range of doc_id; a retried task writes a new
    file, and the manifest names the one of the attempt that counted.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, out, shard = contract_encoder(vocabulary), None, TaskContext.get().partitionId()
        end = np.array([END], ids_type(vocabulary)).tobytes()
        for batch in batches:
            out = out or SequenceFile(base, shard, ids_type(vocabulary), length)
            for i, text in zip(batch.column(0), batch.column(1)):
                out.add(i.as_py(), encode(text.as_py() or "") + end)
        if out:
            uri, n, k = out.close()
            yield pa.record_batch([pa.array([shard], pa.int64()), pa.array([uri]), pa.array([n], pa.int64()), pa.array([k], pa.int64())], ["shard", "file", "n_ids", "n_docs"])

    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id", F.left("text", F.lit(64))).sortWithinPartitions("doc_id", "text")
    return staged(ranged.mapInArrow(write, "shard long, file string, n_ids long, n_docs long"), "manifest")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files. The driver sees a row a file."""
    spark, below, rows = manifest.sparkSession, 0, []
    for r in manifest.orderBy("shard").collect():
        rows.append((r["file"], below))
        below += r["n_ids"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                reader = Reader(uri)
                for part in reader.index.to_batches():
                    ids, starts, sizes = (c.to_pylist() for c in part.columns)
                    crc = [functools.reduce(lambda c, x: zlib.crc32(x.astype("<u4").tobytes(), c), reader.span(s, n), 0) for s, n in zip(starts, sizes)]
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array([first + s for s in starts], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    files = spark.createDataFrame(rows, "file string, below long")
    return files.repartition(max(1, len(rows)), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_sequences(table(spark, sf_dir, "documents"), scratch(spark, "tokens")))
