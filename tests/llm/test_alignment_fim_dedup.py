"""Operators 11 to 13 against brute force on small tables with nulls, ties, repeats and odd texts."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wordloom.llm import alignment, exact_dedup, fim

DOCS = "doc_id long, text string, lang string"
ODD = ["", None, " ", "a", "é \U0001f642x", "<P>", "x <S> y", "naïve — “q” z", "tab\t\n\r end  ", "word " * 40_000, "▁low", "a\n\n  b\n c ", "\x00nul", "١٢ ½ ⅻ", "nospaces" * 3000, "  lead", "trail  "]


def texts():
    r = random.Random(5)
    words = ["stone", "rivers", "naïve", "0x1f", "été", "don't", "\n", "一二", "—"]
    return ODD + [" ".join(r.choice(words) for _ in range(r.randint(1, 60))) for _ in range(80)]


def rows():
    out = [(i, t, "en") for i, t in enumerate(texts())]
    # Copies, copies but for white space, repeats, null ids.
    out += [(1000 + i, (t or "").replace(" ", "  \t") if i % 2 else t, None) for i, t in enumerate(texts()[:60])]
    return out + [out[20], out[20], (20, "another text of the same id", "fr"), (None, "alone without id", None), (None, out[25][1], "x"), (None, "two nulls", None), (None, "two  nulls", None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(6).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# 11


def expected_fim(doc_id, text):
    text = text or ""
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    n = len(text)
    if not n or any(m in text for m in ("<P>", "<S>", "<M>")) or c % 100 >= 90:
        return n, "plain", None, None, text
    lo, hi = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = text[:lo], text[lo:hi], text[hi:]
    return (n, "spm", lo, hi - lo, f"<S>{s}<P>{p}<M>{m}") if d % 100 < 20 else (n, "psm", lo, hi - lo, f"<P>{p}<S>{s}<M>{m}")


def test_fim_against_slices(docs, empty):
    out = fim.fill_in_middle(docs.withColumn("form", F.lit("theirs")).withColumn("output", F.lit(1)))
    assert out.columns == ["doc_id", "text", "lang", *fim.PLACED]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert Counter((r.doc_id, r.text, r.lang) for r in got) == Counter(rows()) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == expected_fim(r.doc_id, r.text) and r.back == (r.text or "")
    assert fim.fill_in_middle(empty).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200), st.integers(1, 9), st.booleans())
def test_fenwick_descent_finds_every_unit(text, block, words):
    pattern = re.compile(r"\w+|\W") if words else None
    index = fim.Blocks(np.frombuffer(text.encode(), np.uint8), pattern, block)
    starts = [m.start() for m in (pattern or re.compile("(?s).")).finditer(text)]
    starts[:1] = [0] if starts else []
    assert (index.n, index.n_chars) == (len(starts), len(text))
    for k in range(len(starts) + 2):
        at = starts[k] if k < len(starts) else len(text)
        assert index.find(k) == (len(text[:at].encode()), at)


def test_fim_by_words(spark):
    df = spark.createDataFrame([(i, "one  two\nthree é four " * (i % 5), "en") for i in range(60)], DOCS)
    got = fim.fill_in_middle(df, unit=r"\S+\s*", rate=100, block=7).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    for r in got:
        assert r.back == r.text and r.n == len(r.text.split())
        if r.form != "plain":
            assert r.text[: r.prefix_chars] == "" or r.text[r.prefix_chars - 1] in " \n"


# 12


def library():
    import public_tokenizers as p
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(p.path(alignment.VOCABULARY_A))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=p.path(alignment.VOCABULARY_B))


def expected_groups(a, b, text):
    """Groups of both libraries' own ids, by sets of ends; none where a library changes the text."""
    from wordloom.llm.tokenids import byte_symbols

    if not text:
        return []
    back = {s: x for x, s in byte_symbols().items()}
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    said_a = [bytes(back[c] for c in a.id_to_token(i)) for i in ids_a]
    said_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(said_a) != (" " + text).encode() or b"".join(said_b) != (" " + text).encode():
        return []
    ends = [np.cumsum([len(x) for x in said]).tolist() for said in (said_a, said_b)]
    out, i, j = [], 0, 0
    after = [{end: k for k, end in enumerate(x, 1)} for x in ends]
    for end in sorted(set(ends[0]) & set(ends[1])):
        k, m = after[0][end], after[1][end]
        out.append((ids_a[i:k], ids_b[j:m], end))
        i, j = k, m
    return out


def test_alignment_against_both_libraries(docs, empty):
    a, b = library()
    counts, each = Counter(), []
    for doc_id, text, _ in rows():
        groups = expected_groups(a, b, text)
        each.append((doc_id, text, groups))
        counts.update((x[-1], y[-1]) for x, y, _ in groups)
    most = defaultdict(int)
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    want = Counter()
    for doc_id, _, groups in each:
        links = [(x[-1], y[-1]) for x, y, _ in groups]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y, _ in groups)
        want[(doc_id, sum(len(x) for x, *_ in groups), sum(len(y) for _, y, _ in groups), len(groups), len(links), sum(counts[k] == most[k[1]] for k in links), sum(counts[k] for k in links), text)] += 1
    columns = ["doc_id", *alignment.COUNTS, "n_best", "count_sum", "groups"]
    aligned = alignment.align(docs, ("groups", "pairs", "times"), own=["doc_id"])
    for most_broadcast in (alignment.BROADCAST_PAIRS, 0):
        assert Counter(map(tuple, alignment.scored(aligned, most_broadcast).select(columns).collect())) == want
    assert alignment.scored(alignment.align(empty, ("pairs", "times"))).count() == 0
    assert alignment.align(docs.withColumn("n_a", F.lit("theirs"))).columns == ["doc_id", "text", "lang", *alignment.COUNTS, "a_ids", "b_ids", "a_upto", "b_upto", "bytes_upto"]


def test_spans_are_the_groups(docs):
    a, b = library()
    got = defaultdict(list)
    few = docs.where("length(text) < 500 and doc_id < 1000 and lang = 'en'").dropDuplicates(["doc_id"])
    for r in alignment.spans(alignment.align(few)).orderBy("doc_id", "group_no").collect():
        got[r.doc_id].append((r.a_ids, r.b_ids, r.end))
        assert r.start < r.end
    for r in few.collect():
        assert got[r.doc_id] == expected_groups(a, b, r.text)


@settings(max_examples=300, deadline=None)
@given(st.sets(st.integers(1, 300), max_size=120), st.sets(st.integers(1, 300), max_size=120), st.booleans())
def test_galloping_ranks_and_overlaps(x, y, sparse):
    x = {i for i in x if not sparse or i % 29 == 0}
    a, b = (np.array(sorted(s | {301})) for s in (x, y))
    for stretch in (1, 3, 1000):
        assert alignment.ranks(a, b, stretch).tolist() == np.searchsorted(b, a).tolist()
    i, j = alignment.common(a, b)
    assert a[i].tolist() == b[j].tolist() == sorted((x & y) | {301})
    low, high = alignment.overlaps(a, b)
    begins = [0, *b[:-1].tolist()]
    for k, (start, end) in enumerate(zip([0, *a[:-1].tolist()], a.tolist())):
        assert list(range(low[k], high[k])) == [m for m in range(len(b)) if begins[m] < end and b[m] > start]


def test_long_texts_are_encoded_in_parts_as_whole():
    import public_tokenizers as p

    path, model, r = p.path(alignment.VOCABULARY_B), library()[1], random.Random(2)
    assert alignment.may_be_cut(path)
    for _ in range(2000):
        text = "".join(r.choice([" ", " ", "  ", "\n", "\t", "▁", "ab", "the", "é", "\r\n", "}", ";", "<s>", "一", "　", "x" * 20]) for _ in range(r.randint(1, 40)))
        assert alignment.piece_ids(path, text, r.randint(1, 9)).tolist() == model.encode(text), repr(text)


# 13


def test_exact_dedup_against_grouping(docs, empty):
    norm = lambda t: re.sub(r"[ \t-\r]+", " ", t or "")
    groups = defaultdict(list)
    for i, t, _ in rows():
        groups[norm(t)].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    for settings_ in ({}, {"owner_rows": 7, "spare": 0}):
        got = exact_dedup.exact_duplicates(docs, **settings_).collect()
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == Counter((i, keep[norm(t)], len(groups[norm(t)]), sha(norm(t))) for i, t, _ in rows())
        kept = [r for r in got if r.kept]
        assert all(r.doc_id == r.keep_id for r in kept) and Counter(r.text_sha256 for r in kept) == Counter(sha(t) for t in groups)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_distinct_documents_keep_their_columns(spark, docs):
    odd = docs.withColumn("__sha", F.lit(1)).withColumn("kept", F.create_map(F.lit("a"), F.lit(1)))
    got = exact_dedup.distinct_documents(odd)
    assert got.columns == odd.columns
    of = {re.sub(r"[ \t-\r]+", " ", t or "") for _, t, _ in rows()}
    found = got.select("doc_id", "text", "lang").collect()
    assert len(found) == len(of) == len({re.sub(r"[ \t-\r]+", " ", r.text or "") for r in found})
    # Rows alike in id and text that differ otherwise: the same one in every run.
    df = spark.createDataFrame([(1, "same text", c) for c in "abcdefgh"] + [(2, "other", "x")], DOCS)
    assert len({tuple(sorted(map(tuple, exact_dedup.distinct_documents(df.repartition(k)).collect()))) for k in (1, 3, 5)}) == 1


@settings(max_examples=300, deadline=None)
@given(st.sets(st.one_of(st.integers(0, 50), st.integers(0, (1 << 62) - 1)), min_size=1, max_size=100))
def test_golomb_codes_are_undone(values):
    rising = np.array(sorted(values), np.int64)
    assert exact_dedup.decoded(len(rising), *exact_dedup.coded(rising)).tolist() == rising.tolist()


def test_messages_are_smaller_than_hashes(spark):
    prints = spark.range(200_000).selectExpr("id % 4 as __sender", "shiftrightunsigned(xxhash64(id), 34) as __print")
    sizes = exact_dedup.sent(prints, 8, 30).selectExpr("sum(length(quotients) + length(remainders)) as bytes", "sum(n) as n").first()
    assert sizes.n > 199_000 and sizes.bytes < 2.5 * sizes.n  # hashes have 8 bytes
