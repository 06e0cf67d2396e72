"""Finished work in a folder: named results that are made once, kept whole, and read again.

A result is made in a folder of its own beside the others and gets its name by one rename when it is
complete, with the record that says what it was made of. What an interrupted run has begun is discarded by the
next. The name holds a fingerprint of the inputs and settings, so changed inputs make another result.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def content(df: DataFrame) -> str:
    """A digest of a table's rows, whatever their order: columns, number of rows, and sum and parity of the rows' hashes."""
    columns = [F.col(c) if "map<" not in t else F.to_json(c) for c, t in df.dtypes]
    h = F.xxhash64(*columns)
    got = df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr((sorted(df.dtypes), *map(str, got))).encode()).hexdigest()[:32]


def fingerprint(settings: Any = None, *tables: DataFrame) -> str:
    """A digest of settings (anything that JSON holds) and tables' contents."""
    said = json.dumps([settings, [content(t) for t in tables]], sort_keys=True, default=str)
    return hashlib.sha256(said.encode()).hexdigest()[:32]


class Ledger:
    """Results under `base`, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str, mark: str) -> str:
        return f"{self.base}/{name}-{mark}"

    def record(self, name: str, mark: str) -> dict | None:
        """What is said of a finished result, or None."""
        at = self.path(f"{self.at(name, mark)}/record.json")
        if not self.fs.exists(at):
            return None
        source = self.fs.open(at)
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def discard_halves(self, name: str) -> int:
        """Remove what interrupted runs have begun of a result, and say how much."""
        found = self.fs.globStatus(self.path(f"{self.base}/_begun-{name}-*")) or []
        for f in found:
            self.fs.delete(f.getPath(), True)
        return len(found)

    def made(self, name: str, mark: str, make: Callable[[], DataFrame], note: dict | None = None, force: bool = False) -> DataFrame:
        """The result of this name and fingerprint: read if it is finished, else made and kept. One run at a time may
        make a result; of several that do, the first to finish counts."""
        at = self.at(name, mark)
        if force:
            self.fs.delete(self.path(at), True)
        if self.record(name, mark) is None:
            self.discard_halves(name)
            begun = f"{self.base}/_begun-{name}-{uuid.uuid4().hex}"
            rows = make()
            rows.write.parquet(f"{begun}/rows")
            out = self.fs.create(self.path(f"{begun}/record.json"))
            try:
                out.write(bytearray(json.dumps({"name": name, "fingerprint": mark, "rows": self.spark.read.parquet(f"{begun}/rows").count()} | (note or {})).encode()))
            finally:
                out.close()
            if not self.fs.rename(self.path(begun), self.path(at)) and self.record(name, mark) is None:
                raise OSError(f"can't rename {begun} to {at}")
        return self.spark.read.parquet(f"{at}/rows")
