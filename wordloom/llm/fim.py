"""Fill-in-the-middle transformation: texts cut in prefix, middle and suffix, and put in another order.

A text is indexed by blocks of BLOCK bytes. A Fenwick tree over the blocks stores how many units and how
many code points begin in each; a binary-lifting descent finds the block in which a given unit
begins, with the code points before it, and the boundary is then found inside that block. Units are code
points, or what a pattern says. The parts are joined by sentinels: psm has prefix, suffix, middle; spm suffix,
prefix, middle; plain is the text itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 4096
PREFIX, SUFFIX, MIDDLE = SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 texts, how many are rearranged, and how many of these as spm.
RATE, SPM = 90, 20
SEED = 1
TYPE = "n long, form string, prefix_chars long, middle_chars long, output string"
PLACED = [x.split()[0] for x in TYPE.split(", ")]


class Blocks:
    """The Fenwick tree of one text (its UTF-8 bytes). `unit`: None for code points, else a pattern, of whose
    matches each begins a unit; what stands before the first match is part of the first unit."""

    def __init__(self, text: np.ndarray, unit: re.Pattern | None = None, block: int = BLOCK):
        self.text, self.block, self.unit = text, block, unit
        self.is_start = (text & 0xC0) != 0x80
        chars = self._per_block(np.flatnonzero(self.is_start) if unit else None)
        if unit is None:
            self.starts, units = None, chars
        else:
            at = np.array([m.start() for m in unit.finditer(text.tobytes().decode("utf-8", "replace")) if m.end() > m.start()], np.int64)
            at[:1] = 0
            self.starts = np.flatnonzero(self.is_start)[at]
            units = self._per_block(self.starts)
        self.units, self.chars = (self._tree(x) for x in (units, chars))
        self.n, self.n_chars = int(units.sum()), int(chars.sum())

    def _per_block(self, starts: np.ndarray | None) -> np.ndarray:
        blocks = -(-len(self.text) // self.block)
        if starts is None:
            return np.add.reduceat(self.is_start, np.arange(0, len(self.text), self.block), dtype=np.int64) if blocks else np.zeros(0, np.int64)
        return np.bincount(starts // self.block, minlength=blocks)

    @staticmethod
    def _tree(counts: np.ndarray) -> list[int]:
        """tree[i], from 1 on, sums the lowbit(i) blocks up to i."""
        upto, i = np.concatenate([[0], np.cumsum(counts)]), np.arange(len(counts) + 1)
        return (upto - upto[i - (i & -i)]).tolist()

    def find(self, k: int) -> tuple[int, int]:
        """(bytes, code points) before unit k, counted from 0; the whole text if there are no more than k."""
        if k >= self.n:
            return len(self.text), self.n_chars
        at, chars, step = 0, 0, 1 << (len(self.units) - 1).bit_length() - 1
        while step:
            if at + step < len(self.units) and self.units[at + step] <= k:
                at += step
                k -= self.units[at]
                chars += self.chars[at]
            step >>= 1
        low = at * self.block
        inside = self.is_start[low : low + self.block]
        if self.starts is None:
            byte = int(np.flatnonzero(inside)[k])
        else:
            byte = int(self.starts[np.searchsorted(self.starts, low) + k]) - low
        return low + byte, chars + int(np.count_nonzero(inside[:byte]))


def rearranged(text: bytes, draws: list[int], unit: re.Pattern | None = None, rate: int = RATE, spm: int = SPM, sentinels: tuple = SENTINELS, block: int = BLOCK) -> tuple:
    """(units, form, prefix's code points, middle's code points, output) of a text and its four draws."""
    index = Blocks(np.frombuffer(text, np.uint8), unit, block)
    marks = [s.encode() for s in sentinels]
    if not index.n or draws[2] % 100 >= rate or any(m in text for m in marks):
        return index.n, "plain", None, None, text
    (low, before), (high, upto) = (index.find(k) for k in sorted(d % (index.n + 1) for d in draws[:2]))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    p, s, m = marks
    if draws[3] % 100 < spm:
        return index.n, "spm", before, upto - before, b"".join((s, suffix, p, prefix, m, middle))
    return index.n, "psm", before, upto - before, b"".join((p, prefix, s, suffix, m, middle))


def draws(doc_id: Column, seed: int = SEED) -> Column:
    """Four numbers of 32 bits from the id, the same in every run; of a null id those of an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)))


def fill_in_middle(docs: DataFrame, unit: str | None = None, seed: int = SEED, rate: int = RATE, spm: int = SPM, sentinels: tuple = SENTINELS, block: int = BLOCK) -> DataFrame:
    """docs with n, form, prefix_chars, middle_chars and output; columns of these names are replaced.

    A null or empty text is plain and gives an empty output. A text with a sentinel in it is plain, so that
    every output can be undone. Rows alike in id and text get the same output. Texts are worked on one by
    one and whole, however long; a row stays in its partition.
    """
    pattern = re.compile(unit) if unit else None

    @F.arrow_udf(f"struct<{TYPE.replace(' ', ':').replace(',:', ',')}>")
    def of(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        rows = [rearranged(t.as_buffer().to_pybytes() if t.is_valid else b"", d.as_py(), pattern, rate, spm, sentinels, block) for t, d in zip(texts, numbers)]
        n, form, before, inside, out = zip(*rows) if rows else ([],) * 5
        columns = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(inside, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
        return pa.StructArray.from_arrays(columns, PLACED)

    own = [c for c in docs.columns if c not in PLACED]
    return docs.select(*own).withColumn("__placed", of(F.col("text"), draws(F.col("doc_id"), seed))).select(*own, "__placed.*")


def restored(output: Column, form: Column, sentinels: tuple = SENTINELS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(re.escape(s) for s in sentinels), -1)
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents").select("doc_id", "text"))
    back = restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
e AS (SELECT doc_id, text, length(text)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {RATE} THEN 'plain' WHEN h4 % 100 < {SPM} THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substr(text, 1, lo) AS prefix, substr(text, lo + 1, hi - lo) AS middle, substr(text, hi + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM g
"""
