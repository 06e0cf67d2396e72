"""Other tokenizers as systems to compare with: public vocabularies, encoded over distinct words.

Tokenizers aren't trained here. A system gives (word, pieces) like segmentation does.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class System(Protocol):
    """Something that cuts words."""

    def encode(self, words: DataFrame) -> DataFrame:
        """(word, pieces) of each distinct word."""
        ...


@functools.cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Vocabulary:
    """A tokenizers-library file; pieces are the spans of the word that its tokens cover."""

    def __init__(self, path: str):
        self.path = path

    def encode(self, words: DataFrame) -> DataFrame:
        path = self.path

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                found = _tokenizer(path).encode_batch(b["word"].tolist(), add_special_tokens=False)
                cuts = [sorted({0, len(w), *(x for s in e.offsets for x in s)}) for w, e in zip(b["word"], found)]
                yield pd.DataFrame({"word": b["word"], "pieces": [[w[i:j] for i, j in zip(c, c[1:])] for w, c in zip(b["word"], cuts)]})

        return words.where(F.col("word").isNotNull()).select("word").distinct().mapInPandas(run, "word string, pieces array<string>")


def printable_bytes(pieces: pd.Series) -> pd.Series:
    """Byte-level surfaces as text: bytes stand as printable characters, 256 and on for the others."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}
    return pieces.map(lambda s: bytes(back[c] for c in s).decode("utf-8", "replace"))


def decoded(pieces: Column) -> Column:
    """Surfaces of word-piece, sentence-piece and byte-fallback vocabularies put together: ## continues,
    the low line U+2581 is a space, <0xNN> a byte. Bytes that make no character become U+FFFD."""
    hexed = lambda p: F.when(p.rlike("^<0x[0-9A-Fa-f]{2}>$"), F.upper(F.substring(p, 4, 2))).otherwise(F.hex(F.encode(F.regexp_replace(p, "^##", ""), "utf-8")))
    text = F.make_valid_utf8(F.unhex(F.array_join(F.transform(pieces, hexed), "")).cast("string"))
    return F.replace(text, F.lit("\u2581"), F.lit(" "))
