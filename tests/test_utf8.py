"""Bytes that are no UTF-8, against a decoder written out."""

import json
import random

from pyspark.sql import functions as F

from wordloom.functions import utf8
from wordloom.functions.local import local
from wordloom.operators import analyze as an
from wordloom.operators.segment import bytes_jsonl
from wordloom.sources import lexicon as lx

HARD = [
    b"", b"plain", "é€\U0001f642".encode(), b"\xff", b"a\xffb", b"\xe2\x82", b"\xe2\x82a", b"\xe2", b"\xc0\x80", b"\xc1\xbf", b"\xe0\x80\x80", b"\xe0\x9f\xbf", b"\xed\xa0\x80", b"\xed\x9f\xbf", b"\xed\xbf\xbf",
    b"\xf0\x80\x80\x80", b"\xf0\x8f\xbf\xbf", b"\xf0\x90\x80\x80", b"\xf4\x8f\xbf\xbf", b"\xf4\x90\x80\x80", b"\xf5\x80\x80\x80", b"\xf8\x88\x80\x80\x80", b"\x80\x80", b"caf\xe9", b'q"\\\x01\x7f\n\t\x08\x0c\r', b"\xc3", b"\xc3\xc3\xa9",
]


def read(b: bytes):
    """(bytes, well-formed) of each character, by Python's own decoder."""
    out, i = [], 0
    while i < len(b):
        for n in (1, 2, 3, 4):
            try:
                if len(b[i : i + n]) == n and len(b[i : i + n].decode()) == 1:
                    out.append((b[i : i + n], True))
                    i += n
                    break
            except UnicodeDecodeError:
                pass
        else:
            out.append((b[i : i + 1], False))
            i += 1
    return out


def values():
    r = random.Random(9)
    some = [0x41, 0x7F, 0x80, 0x8F, 0x90, 0x9F, 0xA0, 0xBF, 0xC0, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEF, 0xF0, 0xF1, 0xF4, 0xF5, 0xFF]
    return HARD + [bytes(r.choice(some) for _ in range(r.randint(1, 9))) for _ in range(1500)]


def test_bytes_against_a_decoder(spark):
    data = values()
    df = local(spark, [(i, b) for i, b in enumerate(data)], "i int, b binary")
    b = F.col("b")
    got = df.select("i", utf8.is_valid(b).alias("valid"), utf8.count(b).alias("n"), utf8.text(b).alias("text"), utf8.json_string(b).alias("json"), *(utf8.snap(b, F.lit(k)).alias(f"s{k}") for k in range(11))).collect()
    for x in got:
        raw, chars = data[x.i], read(data[x.i])
        text = "".join(c.decode() if ok else chr(c[0]) for c, ok in chars)
        assert (x.valid, x.n, x.text) == (all(ok for _, ok in chars), len(chars), text), raw
        assert json.loads(x.json) == text and x.json.count("\\u00") >= sum(not ok for _, ok in chars), raw
        for k in range(11):
            at = min(k, len(raw))
            while 0 < at < len(raw) and raw[at] & 0xC0 == 0x80:
                at -= 1
            assert x[f"s{k}"] == at, (raw, k)
    assert df.where("i = 0").select(utf8.count(F.lit(None).cast("binary")).alias("n"), utf8.text(F.lit(None).cast("binary")).alias("t")).first() in [(None, None), (-1, None)]


def test_words_of_any_bytes_are_segmented(spark):
    rules = an.Ruleset.of(lx.builtin(spark), lx.builtin_closed(spark))
    words = [b"stopped", b"caf\xe9", "café".encode(), b"\xff\xfe", b"cats\xc3", b""]
    out = {bytes(r.value): json.loads(r.record) for r in bytes_jsonl(local(spark, [(w, i) for i, w in enumerate(words)], "value binary, i int"), rules).collect()}
    assert set(out) == set(words)
    for w in words:
        text = "".join(c.decode() if ok else chr(c[0]) for c, ok in read(w))
        assert out[w]["word"] == "".join(out[w]["pieces"]) == text and out[w]["offsets"][-1] == len(read(w))
    assert out[b"stopped"]["pieces"] == ["stop", "ped"]
    assert (out[b"caf\xe9"]["gate"], out[b"\xff\xfe"]["gate"], out[b"cats\xc3"]["pieces"]) == ("no_analysis", "passthrough", ["cats\xc3"])
