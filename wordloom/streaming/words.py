"""The same transforms over streams.

Segmentation ranks per word, which streams don't allow outside of time windows, so each
micro-batch is segmented as a batch. White space that must be carried over lines is kept in
state per stream.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from wordloom.operators.analyze import Ruleset
from wordloom.operators.segment import encode, jsonl, segment
from wordloom.sources import lines

log = logging.getLogger(__name__)
Sink = Callable[[DataFrame, int], None]


def read_lines(spark: SparkSession, path: str, progress: str | None = None, batch_bytes: int = lines.BATCH) -> DataFrame:
    """A stream of (word, path, start) from text files that arrive in path, a word a line. A micro-batch takes at most
    batch_bytes, part of a large file too. progress: a folder by which a restarted query goes on."""
    rows = lines.stream(spark, path, progress, batch_bytes)
    return rows.select(F.regexp_replace(F.decode("value", "UTF-8"), "\r$", "").alias("word"), "path", "start")


def _started(words: DataFrame, batch: Sink, checkpoint: str | None, every: str | None) -> StreamingQuery:
    writer = words.writeStream.foreachBatch(batch)
    writer = writer.option("checkpointLocation", checkpoint) if checkpoint else writer
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def segment_stream(words: DataFrame, rules: Ruleset, sink: Sink, nbest: int = 1, derived_first: bool = False, checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """Start a query that gives sink, for each micro-batch, words' rows with a JSON line each as `value`. It runs until it is
    stopped, a batch as often as `every` says (such as '1 second'), or without it until what is there has been read."""
    def batch(df: DataFrame, n: int) -> None:
        said = jsonl(segment(df.select("word"), rules, derived_first, nbest), nbest)
        sink(df.join(said, "word"), n)

    return _started(words, batch, checkpoint, every)


def encode_stream(words: DataFrame, rules: Ruleset, sink: Sink, checkpoint: str | None = None, every: str | None = None) -> StreamingQuery:
    """The same with `pieces`."""
    def batch(df: DataFrame, n: int) -> None:
        best = encode(df.select("word").distinct(), rules)
        sink(df.join(best, "word"), n)

    return _started(words, batch, checkpoint, every)


class Batches:
    """A sink that keeps each micro-batch in a folder of its number. A batch that runs again, since its query
    stopped between sink and commit, overwrites what it wrote, so each row is kept once."""

    def __init__(self, base: str):
        self.base = base.rstrip("/")

    def __call__(self, df: DataFrame, n: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.base}/batch={n}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """What finished batches hold, with `batch`."""
        path = spark._jvm.org.apache.hadoop.fs.Path
        fs = path(self.base).getFileSystem(spark._jsc.hadoopConfiguration())
        done = [str(f.getPath().getParent()) for f in fs.globStatus(path(f"{self.base}/batch=*/_SUCCESS")) or []]
        return spark.read.option("basePath", self.base).parquet(*done)


class Progress(StreamingQueryListener):
    """Reports each time that the queries of a session have read another `every` lines."""

    def __init__(self, every: int = 1_000_000, report: Callable[[int], None] = lambda n: log.info("%d lines", n)):
        self.every, self.report, self.lines = every, report, 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        before, self.lines = self.lines, self.lines + event.progress.numInputRows
        for k in range(before // self.every + 1, self.lines // self.every + 1):
            self.report(k * self.every)

    def onQueryTerminated(self, event) -> None:
        pass


CARRIED = "stream string, line_no long, text string, ws_before string"
_STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Carry(StatefulProcessor):
    """Gives each line that isn't blank with the white space since the last one. State of a stream: the number of the
    next line and the white space so far, and lines that came before their turn, each by its number."""

    def __init__(self, timeout_ms: int):
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "next long, pending string")
        self.early = handle.getMapState("early", "line_no long", "value string")

    def _line(self, key, number: int, value: str | None) -> Row | None:
        value = value or ""
        body = value.strip()
        self.next = max(self.next, number + 1)
        if not body:
            self.pending.append(value + "\n")
            return None
        lead = value[: len(value) - len(value.lstrip())]
        row = Row(stream=key[0], line_no=number, text=body, ws_before="".join([*self.pending, lead]))
        self.pending = [value[len(lead) + len(body) :] + "\n"]
        return row

    def _load(self) -> None:
        held = self.now.get()
        self.next, self.pending = (held[0], [held[1]]) if held else (0, [])

    def _store(self) -> None:
        self.now.update((self.next, "".join(self.pending)))

    def _waiting(self) -> list[int]:
        return sorted(k[0] for k in self.early.keys())

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        self._load()
        waits = self.early.exists()
        for r in rows:
            if r.line_no > self.next:
                self.early.updateValue((r.line_no,), (r.value,))
                waits = True
                continue
            if (out := self._line(key, r.line_no, r.value)) is not None:
                yield out
            while waits and self.early.containsKey((self.next,)):
                number = self.next
                value = self.early.getValue((number,))[0]
                self.early.removeKey((number,))
                if (out := self._line(key, number, value)) is not None:
                    yield out
        self._store()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self._load()
        for number in self._waiting():  # lines behind one that never came
            if (out := self._line(key, number, self.early.getValue((number,))[0])) is not None:
                yield out
        self.early.clear()
        rest = "".join(self.pending)
        self.now.update((self.next, ""))
        if rest:
            yield Row(stream=key[0], line_no=-1, text="", ws_before=rest)

    def close(self) -> None:
        pass


def carry_space(lines: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """CARRIED rows of a stream of (stream, line_no, value): each line's text with the white space before it,
    which may have begun lines ago. Lines of a stream are numbered from 0 and may come in any order; one that comes early
    waits in the state. Rows go through one at a time, so a batch of any size takes no memory of its own. What is
    pending when a stream pauses for the timeout is given as a row without text, number -1, and lines
    behind a missing one are then given up to. A null line is an empty one; a line that comes twice is given twice.

    The state is kept in the session's RocksDB store; what is written to a checkpoint survives a restart."""
    lines.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STATE_STORE)
    return lines.groupBy("stream").transformWithState(Carry(timeout_ms), CARRIED, "Append", "ProcessingTime")
