"""Raw lines in parts, unbounded streams, white space carried over lines, progress."""

import io
import json
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from wordloom.operators import analyze as an
from wordloom.operators import tokens
from wordloom.sources import lexicon as lx
from wordloom.sources import lines
from wordloom.streaming import words as sw


def expected(data: bytes):
    out, at = [], 0
    for piece in data.split(b"\n"):
        out.append((at, piece, True))
        at += len(piece) + 1
    start, last, _ = out.pop()
    return out + ([(start, last, False)] if last else [])


def parts(data, cut, chunk):
    got = []
    for low in range(0, max(1, len(data)), cut):
        for batch in lines.lines_of(io.BytesIO(data), "f", low, min(len(data), low + cut), chunk):
            got += list(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))))
    return got


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc", b"\n", b"\n\n", b"\r\n", b"\xff", b"long" * 9, b" "]), max_size=40).map(b"".join), st.integers(1, 30), st.integers(1, 20))
def test_parts_of_a_file_have_its_lines(data, cut, chunk):
    assert parts(data, cut, chunk) == expected(data)


@pytest.mark.parametrize("end", ["\n", "", "\r\n"])
def test_lines_of_files(spark, tmp_path, end):
    r = random.Random(4)
    text = {f"{k}.txt": "\n".join("x" * r.randint(0, 90) for _ in range(400)) + end for k in "ab"}
    for name, t in text.items():
        (tmp_path / name).write_bytes(t.encode())
    (tmp_path / "_skipped").write_text("no")
    df = lines.read(spark, str(tmp_path), split_bytes=1000)
    assert df.rdd.getNumPartitions() > 10
    got = {}
    for x in df.orderBy("path", "start").collect():
        got.setdefault(x.path.rsplit("/", 1)[1], []).append((x.start, bytes(x.value), x.ended))
    assert got == {n: expected(t.encode()) for n, t in text.items()}
    (tmp_path / "empty").mkdir()
    assert lines.read(spark, str(tmp_path / "empty")).count() == 0


def test_a_large_file_in_bounded_memory(tmp_path):
    """A part reads its own bytes and no more than a chunk and a line beyond them."""
    at, n = tmp_path / "large.txt", 300_000
    with at.open("wb") as f:
        for i in range(n):
            f.write(b"%d %s\r\n" % (i, b"word " * (i % 20)))
    size, total, most = at.stat().st_size, 0, 0
    with at.open("rb") as f:
        for low in range(0, size, 1 << 20):
            for batch in lines.lines_of(f, "f", low, min(size, low + (1 << 20)), 1 << 18):
                total += batch.num_rows
                most = max(most, batch.nbytes)
    assert total == n and most < 1 << 20


TEXTS = ["one two\n  three\r\n\n\t\nfour\n \n\n", "", "\n\n", "  lead\nno end", "a\n", "x \u00a0\n\u3000\ny\n" * 30, " ", 'He said "stopped".\n\n'] + ["".join(random.Random(k).choices(["w ", "\n", " ", "end.", "\t", "\r\n", "Dr. "], k=90)) for k in range(6)]


def test_tokens_of_lines_put_files_together(spark, tmp_path):
    for i, t in enumerate(TEXTS):
        (tmp_path / f"{i:03d}.txt").write_bytes(t.encode())
    rows = tokens.line_tokens(lines.read(spark, str(tmp_path), split_bytes=50)).orderBy("line", "pos").collect()
    got = {}
    for x in rows:
        got.setdefault(int(x.line.path[-7:-4]), []).append(x)
    for i, t in enumerate(TEXTS):
        mine = got.get(i, [])
        assert "".join(x.ws_before + x.text for x in mine) == t, i
        assert all(x.kind != "TAIL" for x in mine[:-1]) and all(x.text for x in mine[:-1])
    whole = tokens.tokens(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.text, x.ws_before) for x in whole if x.kind != "TAIL") == sorted((i, x.text, x.ws_before) for i, xs in got.items() for x in xs if x.text)


def test_text_mode_reads_lines(spark, tmp_path):
    (tmp_path / "t.txt").write_text('He "stopped"\n\n  cats')
    records = tokens.segmented_lines(lines.read(spark, str(tmp_path / "t.txt")), rules_of(spark))
    said = [json.loads(x.value) for x in tokens.token_jsonl(records, "line").orderBy("line", "pos").collect()]
    assert "".join(x["ws_before"] + "".join(x["pieces"]) for x in said) == 'He "stopped"\n\n  cats'
    assert said[-1]["pieces"] == ["cat", "s"] and said[-1]["ws_before"] == "\n\n  "


def rules_of(spark):
    return an.Ruleset.of(lx.builtin(spark).cache(), lx.builtin_closed(spark))


def test_a_stream_of_words_in_batches_of_bytes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    words = ["cats", "walked", "cats", "", "unhappy", "zzz"] * 10
    (tmp_path / "in" / "a.txt").write_text("\r\n".join(words) + "\n")
    batches, sink, read = [], sw.Batches(f"file://{tmp_path}/out"), []
    stop_at = {1}

    def failing(df, n):
        sink(df, n)
        batches.append(n)
        if n in stop_at:  # after the sink, before the commit
            stop_at.clear()
            raise RuntimeError("killed")

    def started():
        source = sw.read_lines(spark, str(tmp_path / "in"), f"file://{tmp_path}/progress", batch_bytes=150)
        return sw.segment_stream(source, rules_of(spark), failing, checkpoint=str(tmp_path / "checkpoint"), every="0 seconds")

    query = started()
    with pytest.raises(Exception, match="killed"):
        query.processAllAvailable()
    (tmp_path / "in" / "b.txt").write_text("boxes\nlast")
    query = started()
    query.processAllAvailable()
    query.stop()
    query = started()  # a restart with nothing left, then more
    query.processAllAvailable()
    (tmp_path / "in" / "c.txt").write_text("stopped\n")
    query.processAllAvailable()
    query.stop()
    assert batches[:3] == [0, 1, 1] and batches[3:] == sorted(set(batches[3:])) and len(set(batches)) >= 4
    rows = sink.rows(spark).orderBy("path", "start").collect()
    read = [r.word for r in rows]
    assert read == [*words, "boxes", "last", "stopped"]
    assert all(json.loads(r.value)["word"] == r.word for r in rows)


def test_encoding_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("stopped\ncats\ncats\n")
    sink = sw.Batches(f"file://{tmp_path}/out")
    sw.encode_stream(sw.read_lines(spark, str(tmp_path / "in")), rules_of(spark), sink).awaitTermination(120)
    assert sorted((r.word, r.pieces) for r in sink.rows(spark).collect()) == [("cats", ["cat", "s"]), ("cats", ["cat", "s"]), ("stopped", ["stop", "ped"])]


LINES = "stream string, line_no long, value string"


def carried(spark, tmp_path, timeout_ms=60_000):
    source = spark.readStream.schema(LINES).option("maxFilesPerTrigger", 1).json(str(tmp_path / "lines"))
    return sw.carry_space(source, timeout_ms).writeStream.foreachBatch(sw.Batches(f"file://{tmp_path}/out")).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="0 seconds").start()


def read_until(spark, tmp_path, when, seconds=60):
    """Rows of the sink, as soon as `when` holds. A query with timers never says that it has read all."""
    for _ in range(seconds * 2):
        time.sleep(0.5)
        if list((tmp_path / "out").glob("batch=*/_SUCCESS")) and when(rows := sw.Batches(f"file://{tmp_path}/out").rows(spark).collect()):
            return rows
    raise AssertionError("no such rows")


def put(spark, tmp_path, rows):
    spark.createDataFrame(rows, LINES).coalesce(1).write.mode("append").json(str(tmp_path / "lines"))


def test_white_space_is_carried_over_lines_batches_and_restarts(spark, tmp_path):
    said = ["  One two ", "  ", "three", " four\r", "", "\t", "five"]
    put(spark, tmp_path, [("s", 2, said[2]), ("s", 0, said[0]), ("t", 0, "alone")])  # 2 comes early
    query = carried(spark, tmp_path)
    read_until(spark, tmp_path, lambda rows: len(rows) == 2)
    query.stop()
    put(spark, tmp_path, [("s", 1, said[1]), ("s", 3, said[3]), ("s", 4, None), ("t", 1, " ")])
    query = carried(spark, tmp_path)
    read_until(spark, tmp_path, lambda rows: len(rows) == 4)
    put(spark, tmp_path, [("s", 5, said[5]), ("s", 6, said[6])])
    rows = read_until(spark, tmp_path, lambda rows: len(rows) == 5)
    query.stop()
    rows.sort(key=lambda r: (r.stream, r.line_no))
    of = lambda s: [(r.line_no, r.text) for r in rows if r.stream == s]
    assert of("s") == [(0, "One two"), (2, "three"), (3, "four"), (6, "five")] and of("t") == [(0, "alone")]
    assert "".join(r.ws_before + r.text for r in rows if r.stream == "s") == "\n".join(said)


def test_pending_space_is_given_after_the_timeout(spark, tmp_path):
    put(spark, tmp_path, [("s", 0, "a "), ("s", 2, "c")])  # 1 never comes
    query = carried(spark, tmp_path, timeout_ms=1)
    rows = read_until(spark, tmp_path, lambda rows: any(r.line_no == -1 for r in rows))
    query.stop()
    assert sorted((r.line_no, r.text, r.ws_before) for r in rows) == [(-1, "", "\n"), (0, "a", ""), (2, "c", " \n")]


def test_progress_is_reported(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in "ab":
        (tmp_path / "in" / f"{k}.txt").write_text("word\n" * 250)
    said = []
    listener = sw.Progress(100, said.append)
    spark.streams.addListener(listener)
    try:
        query = lines.stream(spark, str(tmp_path / "in"), batch_bytes=1250).writeStream.foreachBatch(lambda df, n: df.count()).option("checkpointLocation", str(tmp_path / "c")).start()
        query.processAllAvailable()
        query.stop()
        for _ in range(50):
            if len(said) == 5:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
    assert said == [100, 200, 300, 400, 500]
