"""The ten operators against brute force on small tables with nulls, ties, repeats and odd texts."""

import gzip
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wordloom.llm import decontamination, extraction, language, line_dedup, mixing, quality, sharding, simhash, tokenids, warc
from wordloom.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = ["alpha", "Beta", "gamma", "delta", "épsilon", "zeta", "eta", "theta", "iota", "kappa", "x1", "naïve"]


def corpus(n=120, seed=3):
    r = random.Random(seed)
    line = " ".join(WORDS) + " shared boilerplate line"
    rows = []
    for i in range(n):
        text = "\n".join(" ".join(r.choice(WORDS) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 4)))
        if i % 4 == 0:
            text += f"\n  {line.upper() if i % 8 else line}\t"
        if i % 10 == 9:
            text = rows[i - 5][1]
        if i % 10 == 8 and rows[i - 3][1]:
            text = rows[i - 3][1] + "."
        rows.append((i, text, ["en", "fr", None][i % 3], ["a", "b", "b", None][i % 4], len(text or "")))
    rows += [(n, None, "en", "a", 0), (n + 1, "", "en", "c", 0), (n + 2, " \t\n", None, None, 3), (None, "no id at all", "en", "b", 1), (n + 3, "1234 #### %%%%", "fr", "b", 1), (n + 4, "word " * 30_000, "en", "a", 1)]
    rows.append(rows[7])  # a row that repeats
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def clashing(docs, *names):
    for n in names:
        docs = docs.withColumn(n, F.lit("theirs"))
    return docs


def ws(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1


def test_language_held_out_accuracy(spark):
    r = random.Random(1)
    kinds = {"xx": "the and ing tion er", "yy": "le eau ment que ou", "zz": "ung sch keit ver ein"}
    rows = [(i, " ".join("".join(r.choice(kinds[k].split()) for _ in range(3)) for _ in range(20)), k) for i in range(300) for k in [list(kinds)[i % 3]]]
    rows += [(1000, None, "xx"), (1001, "123 !!", "yy"), (1002, "", None), (None, "the and the", "xx")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {x.doc_id: x for x in language.identify(clashing(df, "score")).collect()}
    held = [i for i, _, _ in rows[:300] if zlib.crc32(str(i).encode()) % 4 == 2]
    assert held and all(found[i].held_out == (i in held) for i in range(300))
    assert np.mean([found[i].lang_pred == rows[i][2] for i in held]) > 0.98
    assert all(0 <= x.score <= 1 for x in found.values())
    assert [found[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and found[None].held_out is False


def test_language_kernel_is_the_intersection():
    m = language.Model([("abc abd", "p"), ("xyz xyw", "q"), ("abcabc", "p"), ("xyzxyz", "q")], landmarks=2)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    p = m.presence(["abc abd", "xyz"])
    assert p[0].sum() == len(grams("abc abd")) and p[1].sum() == len(grams("xyz"))
    assert [x[0] for x in m.predict(["abd abc", "xyw"])] == ["p", "q"]


def test_language_scores_against_dense_kernel_ridge():
    """Scores of the landmarks' map against kernel ridge in its dual form, with sets of n-grams."""
    r = random.Random(8)
    syllables = {"xx": "the and ing tion er", "yy": "le eau ment que ou", "zz": "ung sch keit ver äin"}
    said = lambda k, n: " ".join("".join(r.choice(syllables[k].split()) for _ in range(3)) for _ in range(n))
    sample = [(said(k, r.randint(1, 25)), k) for k in syllables for _ in range(30)]
    asked = [said(k, r.randint(1, 40)) for k in syllables for _ in range(20)] + ["THE  And-ing", "qqq www", "é", "x", "naïve " * 300, "\n the \t"]

    def grams(t):
        b = re.sub(rb"[^a-zA-Z\x80-\xff]", b" ", t.lower().encode())
        return {b[i : i + n] for n in (1, 2, 3) for i in range(len(b) - n + 1)}

    kernel = lambda xs, ys: np.array([[len(a & b) / math.sqrt(len(a) * len(b)) for b in ys] for a in xs])
    ten, x, q = 10, [grams(t) for t, _ in sample], [grams(t) for t in asked]
    z = [g for lang in sorted(syllables) for g in [x[i] for i, (_, k) in enumerate(sample) if k == lang][:ten]]
    inner = np.linalg.pinv(kernel(z, z), rcond=1e-6, hermitian=True)
    low = lambda a, b: kernel(a, z) @ inner @ kernel(z, b) + 1
    y = np.where(np.array([k for _, k in sample])[:, None] == np.array(sorted(syllables)), 1.0, -1.0)
    f = low(q, x) @ np.linalg.solve(low(x, x) + language.RIDGE * np.eye(len(x)), y)
    got = language.Model(sample, landmarks=ten).predict(asked)
    for (lang, score, _), row in zip(got, f):
        top = np.sort(row)[::-1]
        assert abs(score - min(1, max(0, (1 + top[0]) / 2))) < 2e-3
        assert lang == sorted(syllables)[int(row.argmax())] or top[0] - top[1] < 4e-3


def test_the_labelled_sample_is_bounded(spark, monkeypatch):
    rows = [(i, f"{k} words of {k} number {i}", k) for i, k in enumerate("abcdef" * 60)] + [(5000 + i, "long text " * 40_000, "only long") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(language, "Model", lambda sample, landmarks: seen.append((sample, landmarks)))
    language.train(df)
    per = lambda k: [t for t, x in seen[-1][0] if x == k]
    assert seen[-1][1] == language.LANDMARKS and all(30 < len(per(k)) <= 60 for k in "abcdef")
    assert per("only long") and all(len(t) == language.LONGEST for t in per("only long"))
    language.train(df, all_bytes=7 * 200)
    assert all(1 <= len(per(k)) <= 10 and sum(map(len, per(k))) <= 200 for k in "abcdef") and len(per("only long")) == 1
    monkeypatch.setattr(language, "ALL_SAMPLE", 14)
    monkeypatch.setattr(language, "ALL_LANDMARKS", 7)
    language.train(df)
    assert seen[-1][1] == 1 and all(len(per(k)) == 2 for k in "abcdef")


def test_a_long_text_is_predicted_whole(spark):
    rows = [(i, "the and " * 5 if i % 2 else "le eau " * 5, "xx" if i % 2 else "yy") for i in range(80)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    # Its first half alone is of the other language.
    assert [x[0] for x in model.predict(["le eau " * 60_000, "le " + "the and " * 90_000])] == ["yy", "xx"]


def test_language_without_labels(spark, empty):
    assert language.identify(empty).count() == 0
    df = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    assert language.identify(df).select("lang_pred").first()[0] == "und"


# 2


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    return target


def test_mixing_targets_and_taken(spark, docs):
    p = mixing.plan(clashing(docs, "taken", "target")).collect()
    sizes = {}
    for i, t, _, s, _ in corpus():
        sizes[s] = sizes.get(s, 0) + len(ws(t))
    want = brute_targets(sizes)
    taken = {}
    for x in p:
        assert x.source_size == sizes[x.source] and math.isclose(x.target, want[x.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= x.taken <= 2 * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    assert all(taken[s] == math.floor(want[s] + 1e-9) for s in sizes)
    assert rows_of(mixing.plan(docs)) == rows_of(mixing.plan(docs.repartition(3)))


def test_mixing_sequence(spark, docs, empty):
    out = mixing.mix(docs).collect()
    plan = mixing.plan(docs).collect()
    assert sum(len(ws(x.text)) for x in out) == sum(x.taken for x in plan)
    at = [x.position for x in out]
    assert at == sorted(at) and 0 <= min(at) and max(at) <= 1
    assert mixing.mix(empty).count() == 0


def test_demand_is_inverted(spark):
    knots = [(0.0, 0.5), (0.5, 0.8), (1.0, 2.0)]
    df = spark.range(11).select((F.col("id") / 10.0).alias("u")).withColumn("t", mixing.due(F.col("u"), knots))
    area = lambda t: np.trapezoid(np.interp(x := np.linspace(0, t, 20_001), *zip(*knots)), x)
    for u, t in df.collect():
        assert math.isclose(area(t) / area(1), u, abs_tol=1e-6)


# 3


PAGE = """<html><head><title>No</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><div class="cookie">We use cookies.</div>
<article><h1>Title &amp; more</h1><p><b>First   one&#33;<br>line<p>Second &lt;x&gt; a < b.</p><div class="ad">Buy now.</div><ul><li>Item one<li>Item two</ul></article>
<aside class="sidebar"><p>Read also this.</p></aside><section id="comments"><div class="comment"><p>I like it.</p></div></section>
<form><label>Name</label><button>Send</button></form><footer>&copy; Us</footer></body></html>"""


def test_blocks():
    found = extraction.blocks(PAGE)
    assert [t for _, t, _ in found][3:8] == ["Title & more", "First one! line", "Second <x> a < b.", "Buy now.", "Item one"]
    assert all("var t" not in t and t != "No" for _, t, _ in found)
    assert found[5][0][-2:] == ("article", "p")
    assert extraction.blocks(None) == extraction.blocks("") == [] and extraction.blocks("a<b") != []


@pytest.mark.parametrize("odd", ['<svg class="i"/>', "<svg/>", "<math/>", '<svg><path d="x"/><use href="#a"/></svg>', "<svg><path>", "<svg><title>", "<select><option>", "<object data=x>", "<noscript>", "<template>"])
def test_no_element_swallows_the_page(odd):
    page = f"<body><article><p>First {odd}words.</p><p>Second.</p></article><footer>End</footer></body>"
    found = extraction.blocks(page)
    assert " ".join(t for _, t, _ in found) == "First words. Second. End"
    assert found[-1][0][-1] == "footer" and (not odd.startswith(("<svg", "<math")) or found[-2][0][-2:] == ("article", "p"))


def test_formulas_are_read_and_scripts_are_not():
    page = "<p>So <math><mi>E</mi><mo>=</mo><mi>m</mi></math> holds.</p><svg><style>p{}</style><title>No</title><circle r=1 /></svg><p>Next.</p><script>var t; <p>No</p>"
    assert [t for _, t, _ in extraction.blocks(page)] == ["So E=m holds.", "Next."]


def test_extraction_on_unseen_layouts(spark):
    wrong = blocks = 0
    model = extraction.trained()
    for seed in range(90_000, 90_100):
        found = extraction.blocks(extraction.composed(seed))
        y = [t.startswith("\ue000") for _, t, _ in found]
        bare = [(p, t.replace("\ue000", "").strip() or "-", k) for p, t, k in found]
        if bare:
            wrong += int(((model.label([extraction.features(bare)])[0] > 0.5) != np.array(y)).sum())
            blocks += len(y)
    assert wrong / blocks < 0.02
    df = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", "<p>"), (1, "u", PAGE)], "page_id long, url string, html string")
    out = extraction.extract(clashing(df, "text")).collect()
    want = "Title & more\nFirst one! line\nSecond <x> a < b.\nItem one\nItem two"
    assert [x.text for x in out] == [want, "", "", want] and out[0].n_chars == len(want)


def test_gradients_are_right():
    r = np.random.default_rng(0)
    m = extraction.Labeller(size=5, hidden=3)
    m.w = {k: v.astype(np.float64) for k, v in m.w.items()}
    pages = [(r.standard_normal((4, 5)), np.array([1, 0, 1, 1.0])), (r.standard_normal((2, 5)), np.array([0, 1.0]))]

    def loss():
        said, kept = m.forward([p for p, _ in pages])
        error = np.zeros_like(said)
        total = 0.0
        for i, (_, y) in enumerate(pages):
            s = said[i, : len(y)]
            error[i, : len(y)] = s - y
            total -= (y * np.log(s) + (1 - y) * np.log(1 - s)).sum()
        return total, kept, error

    _, kept, error = loss()
    grads = m.gradients(kept, error)
    for k in ("xf", "hb", "cf", "o"):
        at = np.unravel_index(1, m.w[k].shape)
        m.w[k][at] += 1e-3
        up = loss()[0]
        m.w[k][at] -= 2e-3
        down = loss()[0]
        m.w[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-3, k


# 4


def brute_fingerprint(text):
    w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = ws(w)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_of(prints):
    """prints: (id, fp) -> id to smallest id, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j][1]).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            least[find(i)] = min(least.get(find(i), k), k)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_against_all_pairs(docs, empty):
    out = simhash.near_duplicates(clashing(docs, "fp")).collect()
    want = [(x.doc_id, brute_fingerprint(x.text)) for x in out]
    assert [x.fp & (2**64 - 1) for x in out] == [f for _, f in want]
    assert [x.component_id for x in out] == groups_of(want)
    assert simhash.near_duplicates(empty).count() == 0


def test_links_in_dense_groups(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(4)]
    prints = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 4))) for b in base for _ in range(150)} | {base[0] ^ x for x in range(256)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, doc_id long")
    found = {x.doc_id: x.component_id for x in simhash.attach(df).collect()}
    want = groups_of([(i, x & (2**64 - 1)) for i, x in enumerate(signed)])
    assert [found[i] for i in range(len(signed))] == want


def test_one_document_of_each_group_stays(docs):
    kept = simhash.distinct_documents(docs)
    assert kept.columns == docs.columns
    ids = [x.doc_id for x in kept.collect()]
    assert len(ids) == len(set(ids)) == len({x.component_id for x in simhash.near_duplicates(docs).collect()})


def test_unlike_texts_of_null_or_repeated_ids_stay(spark):
    texts = [" ".join(f"{w}{k}" for k in range(40)) for w in ("red", "blue", "green", "brown", "black")]
    rows = [(None, texts[0], "a"), (None, texts[1], "a"), (None, texts[1], "a"), (1, texts[2], "a"), (1, texts[3], "b"), (2, texts[3], "b"), (None, texts[2], "a"), (3, texts[4], "a"), (3, texts[4], "a"), (None, None, "c"), (None, "", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert rows_of(simhash.distinct_documents(df).where("text <> ''")) == sorted([(None, texts[0], "a"), (None, texts[1], "a"), (1, texts[2], "a"), (1, texts[3], "b"), (3, texts[4], "a")], key=repr)
    assert simhash.distinct_documents(df).count() == 6  # texts without words are one group


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    found = dict(map(tuple, components(edges).collect()))
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == 100


# 5


def test_decontamination_against_brute_force(spark, docs, empty):
    r = random.Random(9)
    long = [" ".join(r.choice(WORDS) for _ in range(14)) for _ in range(6)]
    items = [(i, t) for i, t in enumerate(long)] + [(20, "Zeta, ETA"), (21, None), (22, "--"), (None, long[0]), (7, corpus()[3][1]), (7, corpus()[3][1])]
    more = [(500 + i, f"x1 {long[i].upper()}! {long[i]} end", "en", "a", 1) for i in range(6)] + [(600, long[0][:-8] + " other", "en", "a", 1)]
    df = docs.unionByName(spark.createDataFrame(more, DOCS))
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    for block in (32_000_000, 60):
        for x in decontamination.contamination(clashing(df, "spans"), bench, block_bytes=block).collect():
            w, hit, ids = words(x.text), set(), set()
            for n in {len(k) for k in windows}:
                for j in range(len(w) - n + 1):
                    if tuple(w[j : j + n]) in windows:
                        hit |= set(range(j, j + n))
                        ids |= windows[tuple(w[j : j + n])]
            assert (x.n_words, x.n_hit, x["items"], x.contaminated) == (len(w), len(hit), sorted(ids - {None}), bool(hit))
            assert sorted(k for s in x.spans for k in range(s["start"], s["end"])) == sorted(hit)
    assert decontamination.contamination(empty, bench).count() == 0
    assert decontamination.clean(docs, bench.where("false")).count() == docs.count()
    assert decontamination.clean(df, bench).columns == df.columns


def test_fm_index_counts_and_locates():
    r = np.random.default_rng(2)
    t = np.concatenate([r.integers(1, 6, 400), [0]])
    index = decontamination.FMIndex(t)
    for n in (1, 3, 5):
        p = r.integers(1, 7, (30, n))
        which, lo, hi = index.search(p)
        found = {int(k): sorted(index.locate(np.arange(a, b)).tolist()) for k, a, b in zip(which, lo, hi)}
        for k in range(30):
            want = [i for i in range(len(t) - n + 1) if (t[i : i + n] == p[k]).all()]
            assert found.get(k, []) == want


# 6


def test_arc_versions_and_lengths():
    tricky = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhttp://fake.example 0.0.0.0 20200101000000 text/html 5\nabc\xc3\xa9"
    records = [warc.ArcRecord("http://a.example/x y", "1.2.3.4", "20190203040506", "text/html", tricky), warc.ArcRecord("http://b.example/", "1.2.3.4", "2019", "text/plain", b"")]
    for version in (1, 2):
        data = warc.arc_version_block(version) + b"".join(warc.arc_record(version, x) for x in records)
        got = list(warc.parse_arc(data))
        assert [x.body for x in got] == [tricky, b""] and got[0].url == "http://a.example/x%20y" and got[0].mime == "text/html"
        head, block = next(warc.parse_warc(warc.to_warc(got[0]) + b"\r\n\r\n" + warc.to_warc(got[1])))
        assert block == tricky and head["warc-date"] == "2019-02-03T04:05:06Z" and head["warc-type"] == "response"
    assert warc.warc_date("2019") == "2019-01-01T00:00:00Z"
    with pytest.raises(ValueError):
        list(warc.parse_arc(b"not a header\n"))


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" + "x" * 1200
    rows = [(1, "http://a", big), (2, "http://b", big), (5, "http://c", big), (3, "http://d", "small"), (4, "http://e", "small"), (6, None, None), (None, "http://f", big), (5, "http://c", big), (9, "http://g", "a\r\n\r\nWARC/1.1\r\nb" * 200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.pages_to_warc(df, str(tmp_path / "w"))
    out = {x.page_id: x for x in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert warc.read_warc(spark, str(tmp_path / "w")).count() == len(rows)
    for i, _, h in rows:
        data = (h or "").encode()
        assert (out[i].payload_bytes, out[i].payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
    kinds = {i: (x.record_type, x.refers_to) for i, x in out.items()}
    assert kinds == {1: ("revisit", 5), 2: ("revisit", 5), None: ("revisit", 5), 5: ("response", None), 3: ("response", None), 4: ("response", None), 6: ("response", None), 9: ("response", None)}


def test_arc_files_are_converted(spark, tmp_path):
    data = warc.arc_version_block(2) + warc.arc_record(2, warc.page_to_arc(8, "http://z", "<p>hi"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(data)
    warc.convert_arcs(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert [(x.page_id, x.payload_bytes) for x in warc.read_warc(spark, str(tmp_path / "out")).collect()] == [(8, 5)]


def test_arc_files_of_any_bytes(spark, tmp_path):
    image = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n\x89PNG\xff\xfe\r\n\r\n" + bytes(range(256)) * 8
    made = [
        warc.ArcRecord("http://a.example/i.png", "1.2.3.4", "20190203040506", "image/png", image),
        warc.ArcRecord("dns:a.example", "1.2.3.4", "20190203040505", "text/dns", b"20190203040505\na.example. 60 IN A 1.2.3.4\n"),
        warc.ArcRecord("http://b.example/", "1.2.3.4", "20190203040507", "text/html", b"HTTP/1.0 200 OK\r\n\r\ncaf\xe9"),
    ]
    copy = [warc.ArcRecord("http://b.example/i.png", "1.2.3.4", "20200101000000", "image/png", image)]
    (tmp_path / "in").mkdir()
    for name, version, records in (("a.arc", 1, made), ("b.arc.gz", 2, copy)):
        data = warc.arc_version_block(version, name) + b"".join(warc.arc_record(version, r) for r in records)
        (tmp_path / "in" / name).write_bytes(gzip.compress(data) if name.endswith("gz") else data)
    warc.convert_arcs(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    found = {h.get("warc-target-uri", h.get("warc-filename")): (h, b) for p in (tmp_path / "out").glob("*.gz") for h, b in warc.parse_warc(gzip.decompress(p.read_bytes()))}
    assert {k: h["warc-type"] for k, (h, _) in found.items()} == {
        "a.arc": "warcinfo", "b.arc.gz": "warcinfo", "http://a.example/i.png": "response", "dns:a.example": "resource", "http://b.example/": "response", "http://b.example/i.png": "revisit",
    }
    assert all(found[r.url][1] == r.body for r in made) and found["dns:a.example"][0]["content-type"] == "text/dns"
    head, block = found["http://b.example/i.png"]
    assert block == image.split(b"\x89")[0] and head["warc-refers-to"] == found["http://a.example/i.png"][0]["warc-record-id"]
    rows = {x.url: x for x in warc.read_warc(spark, str(tmp_path / "out")).collect()}
    payload = image.partition(b"\r\n\r\n")[2]
    assert len(rows) == 4 and all((rows[u].payload_bytes, rows[u].payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest()) for u in ("http://a.example/i.png", "http://b.example/i.png"))


# 7


def test_sharding(spark, docs, empty):
    out = sharding.shard(clashing(docs, "slot"), n=7).collect()
    assert len(out) == docs.count()
    total, most = sum(x.size for x in out), max(x.size for x in out)
    by = {}
    for x in out:
        data = (x.text or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(data) + 16, zlib.crc32(data), "bytes", None)
        by.setdefault(x.shard, []).append(x)
    assert set(by) <= set(range(7))
    for rows in by.values():
        assert sorted(x.slot for x in rows) == list(range(len(rows)))
        assert sum(x.size for x in rows) <= total / 7 + most + 1
    assert sharding.shard(empty).count() == 0
    key = lambda rows: {(x.doc_id, x.text): x.shard for x in rows}
    assert key(out) == key(sharding.shard(docs.repartition(2), n=7).collect())


def test_a_group_larger_than_a_shard_is_cut(spark):
    df = spark.createDataFrame([(i, "copy " * 20 if i % 3 else f"text {i}" * 12) for i in range(3000)], "doc_id long, text string")
    sizes = [r[1] for r in sharding.shard(df, n=10).groupBy("shard").agg(F.sum("size")).collect()]
    assert len(sizes) == 10 and max(sizes) - min(sizes) < 0.05 * max(sizes)


# 8


def test_token_files(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(tokenids.VOCABULARY))
    manifest = tokenids.write_sequences(clashing(docs, "start"), f"file://{tmp_path}", length=64)
    found = {}
    for x in tokenids.read_documents(manifest).collect():
        found.setdefault(x.doc_id, []).append((x.start, x.n_tokens, x.ids_crc32))
    rows = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for i, text, *_ in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        assert (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) in found[i]
        at += len(ids)
    first = manifest.orderBy("shard").first()
    reader = tokenids.Reader(first["file"])
    n = -(-first["n_ids"] // 64)
    ids, mask = reader.sequence(n - 1)
    assert len(ids) == 64 and mask.sum() == first["n_ids"] - 64 * (n - 1) and not ids[mask == 0].any() and not mask.flags.owndata and not ids.flags.owndata


def test_ids_of_every_character_are_the_librarys():
    """Alone, before 's and between digits; of characters that Python's Unicode doesn't have, a fortieth."""
    import unicodedata

    import public_tokenizers

    path = public_tokenizers.path(tokenids.VOCABULARY)
    encode, library = tokenids.contract_encoder(path), tokenids.loaded(path)
    known = [c for c in map(chr, [*range(1, 0xD800), *range(0xF900, 0xF0000)]) if unicodedata.category(c) != "Cn" or ord(c) % 40 == 0]
    texts = [t for c in known for t in (c, f"a{c}'s 1{c}2 {c}b")]
    got = [np.frombuffer(encode(t), "<u2").tolist() for t in texts]
    library.encode_special_tokens = False
    assert got == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("text", ["a  b", "  lead", "tab\t x\n\n y", " ", "it's 12 o'clock…", "x y \x1c z", "<|endoftext|> a", "naïve é a​ b", "éa   x", "🙂 ok"])
def test_chunks_encode_like_whole_texts(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(tokenids.VOCABULARY)
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    assert np.frombuffer(tokenids.encoder(path)(text), "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>½ y", "a <|endoftext b", "plain 12 ½"])
def test_added_tokens_are_read_as_the_file_says(spark, tmp_path, text):
    import public_tokenizers
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path(tokenids.VOCABULARY)).encode(text, add_special_tokens=False).ids + [0]
    df = spark.createDataFrame([(1, text), (2, "next")], "doc_id long, text string")
    found = {x.doc_id: x for x in tokenids.read_documents(tokenids.write_sequences(df, f"file://{tmp_path}")).collect()}
    assert (found[1].n_tokens, found[1].ids_crc32, found[2].start) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), len(ids))


# 9


def test_quality_measures(docs, empty):
    labels = docs.sparkSession.createDataFrame([(i, i % 2) for i in range(60)] + [(None, 1), (1, None)], "doc_id long, quality int")
    more = docs.sparkSession.createDataFrame([(900, "a b c d e f g h " * 9, "en", "a", 1), (901, "\n".join(["same line here"] * 4 + ["", " ", "x"]), "en", "a", 1)], DOCS)
    df = docs.unionByName(more)
    for x in quality.judge(clashing(df, "kept", "n_lines_with_words"), labels).join(df.select("doc_id", "text"), "doc_id").collect():
        w = ws(x.text)
        windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        twice = {k for k in windows if windows.count(k) > 1} if len(w) < 2000 else set(windows)
        covered = {i + j for i, k in enumerate(windows) if k in twice for j in range(8)}
        lines = [s for s in (x.text or "").split("\n") if ws(s)]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", x.text or "")), len(lines) - len(set(lines)), len(covered))
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 20 or 100 * len(covered) > 30 * len(w)) and not (x.base_failed and x.kept)
    assert quality.judge(empty, labels).count() == 0
    assert quality.judge(df, labels.where("false")).where("kept = base_failed").count() == 0


def test_cutoffs_keep_their_promise(spark):
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    df = spark.createDataFrame([(0, 900), (3, 900), (11, 900), (0, 50), (40, 900)], "k long, n long")
    for k, n, p in df.withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.02)).collect():
        assert math.isclose(p, tail(k, n, 0.02), rel_tol=1e-6) or (k >= n * 0.02 and p == 1)
    r = random.Random(2)
    rows = [("=en", r.random() * 0.2 if i % 50 == 0 else 0.0, 0.0, 0.0) for i in range(4000)] + [("=fr", 0.0, 0.0, 0.0)] * 50
    good = spark.createDataFrame(rows, "__stratum string, __symbols double, __dup_lines double, __repeats double")
    cuts = {x["__stratum"]: x for x in quality.certified(good).collect()}
    assert "=fr" not in cuts and cuts["=en"]["__cut_dup_lines"] == 0.3
    out = sum(x[1] > cuts["=en"]["__cut_symbols"] for x in rows[:4000])
    assert out / 4000 <= quality.ALPHA / 3


# 10


def test_line_dedup(docs, empty):
    rows = corpus()
    keys = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (t or "").split("\n")]
    holders = {}
    for i, t, *_ in rows:
        for k in set(keys(t)):
            holders.setdefault(k, []).append(i)
    common = {k: max((i for i in v if i is not None), default=None) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    assert common
    for x, (i, t, *_) in zip(sorted(line_dedup.dedup_lines(clashing(docs, "n_lines")).collect(), key=lambda x: (x.doc_id is None, x.doc_id, x.text)), sorted(rows, key=lambda r: (r[0] is None, r[0], ""))):
        lines = (t or "").split("\n")
        kept = [s for s, k in zip(lines, keys(t)) if not (k in common and common[k] != i)]
        assert (x.doc_id, x.text, x.n_lines, x.n_dropped) == (i, "\n".join(kept), len(lines), len(lines) - len(kept))
    assert line_dedup.dedup_lines(empty).count() == 0


def test_line_dedup_counts_documents_not_rows(spark):
    line = "a line of more than forty characters, in all rows"
    few = spark.createDataFrame([(1, f"{line}\n{i}") for i in range(4)] + [(2, line)], "doc_id long, text string")
    assert {x.n_dropped for x in line_dedup.dedup_lines(few).collect()} == {0}
    five = few.union(spark.createDataFrame([(i, line) for i in (3, 4, 5)], "doc_id long, text string"))
    assert sorted((x.doc_id, x.n_dropped) for x in line_dedup.dedup_lines(five).collect()) == [(1, 1)] * 4 + [(2, 1), (3, 1), (4, 1), (5, 0)]


# Odd tables: hot and repeated keys, long texts, clashing names, empty inputs


def test_a_repeated_id_is_learned_from_once(spark):
    rows = [(1, f"the and {i}", "xx") for i in range(400)] + [(2, "x" * (language.LONGEST + 1), "yy"), (4, "le eau", "yy")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["xx", "yy"]
    assert language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).count() == len(rows)


def test_mix_keeps_the_callers_columns(spark, docs):
    names = ["size", "weight", "target", "taken", "before", "source_size"]
    out = mixing.mix(clashing(docs, *names)).collect()
    assert out and all(x[n] == "theirs" for x in out for n in names)
    assert [(x.doc_id, x.text, x.position) for x in out] == [(x.doc_id, x.text, x.position) for x in mixing.mix(docs.repartition(2)).collect()]


def test_mixing_of_null_and_repeated_ids(spark):
    rows = [(None, f"w{i} " * 9, "a") for i in range(50)] + [(7, f"v{i} " * 9, "a") for i in range(50)] + [(7, "same", "a")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert mixing.sized(df).select("__h").distinct().count() == 101
    a, b = (rows_of(mixing.plan(d).select("doc_id", "text", "taken", "before")) for d in (df, df.repartition(7)))
    assert a == b and sum(x[2] for x in a) == math.floor(1.5 * (50 * 18 + 5))


def test_a_long_page_among_others_is_read_in_stretches(monkeypatch):
    model = extraction.Labeller()
    page = extraction.blocks("<body><nav>Menu</nav>" + "<p>Some words here.</p>" * 300 + "<footer>End</footer>")
    other = extraction.blocks(PAGE)
    want = [model.label([extraction.features(p)])[0] for p in (other, page)]
    monkeypatch.setattr(extraction, "BLOCKS", 64)
    seen = []
    read = lambda i, a, b: (seen.append(b - a), extraction.features([other, page, other][i], a, b))[1]
    got = model.labelled([len(other), len(page), len(other)], read)
    assert max(seen) <= 64 and np.allclose(got[1], want[1], atol=1e-6) and np.allclose(got[0], want[0], atol=1e-6) and np.allclose(got[2], want[0], atol=1e-6)


@pytest.mark.parametrize("page", ["<html><head><title>T</title><p>First", "<head><meta charset=x>First", "<head><link rel=a><div>First</div></head>", "<title>T</title><p>First", "<head><noscript><img src=a></noscript>First"])
def test_text_ends_an_open_head(page):
    assert [t for _, t, _ in extraction.blocks(page)] == ["First"]


def test_extraction_recall_on_given_pages():
    """The given pages mark their main text by an article element, which the labeller isn't told."""
    import pyarrow.parquet as pq

    model, found, missed, extra = extraction.trained(), 0, 0, 0
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet", columns=["html"])["html"].to_pylist()
    for page, text in zip(pages, extraction.main_texts(model, pages)):
        want, got = [t for _, t, _ in extraction.blocks(re.search("<article>.*?</article>", page, re.S)[0])], text.split("\n")
        found += len(set(want) & set(got))
        missed += len(set(want) - set(got))
        extra += len(set(got) - set(want) - {""})
    assert found / (found + missed) > 0.98 and found / (found + extra) > 0.98


def test_extraction_of_an_empty_table(spark):
    assert extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_spanning_forest_joins_what_all_edges_join():
    r = np.random.default_rng(4)
    for n, m in ((1, 0), (5, 3), (40, 60), (200, 150)):
        left, right = r.integers(0, n, m), r.integers(0, n, m)
        kept = simhash.spanning(left, right, n)

        def labels(a, b, n=n):
            x = list(range(n))
            for i, j in [*zip(a, b)] * n:
                x[i] = x[j] = min(x[i], x[j])
            return x

        assert labels(left[kept], right[kept]) == labels(left, right) and len(kept) == n - len(set(labels(left, right)))


def test_links_are_pairs_within_two_bits(spark):
    r = random.Random(8)
    base = r.getrandbits(63)
    df = spark.createDataFrame([(base ^ sum(1 << k for k in r.sample(range(63), r.randint(0, 3))),) for _ in range(200)], "fp long").distinct()
    assert all((x.a ^ x.b).bit_count() <= 2 and x.a < x.b for x in simhash.links(df).collect())


def test_windows_are_alive_one_block_at_a_time(spark, docs, monkeypatch):
    alive, most = [], []
    made = decontamination.Windows.__init__

    def counted(self, *a, **k):
        made(self, *a, **k)
        alive.append(1)
        most.append(len(alive))

    real = type(spark.sparkContext.broadcast(1)).destroy
    monkeypatch.setattr(decontamination.Windows, "__init__", counted)
    monkeypatch.setattr(type(spark.sparkContext.broadcast(1)), "destroy", lambda self, *a: (alive.pop(), real(self, *a))[1])
    bench = spark.createDataFrame([(i, corpus()[i + 1][1]) for i in range(6)], "item_id long, text string")
    several = decontamination.contamination(docs, bench, block_bytes=10)
    assert len(most) >= 5 and max(most) == 1
    assert rows_of(several) == rows_of(decontamination.contamination(docs, bench).select(several.columns))


def test_stretches_of_a_long_text_are_searched_as_one():
    r = np.random.default_rng(3)
    text = " ".join(f"w{i}" for i in r.integers(0, 4, 900))
    w = decontamination.Windows([(1, text[30:90]), (2, text[600:700]), (3, "w1")], 5)
    ids = np.array([w.number.get(x, 0) for x in decontamination.words_of(text)], np.int64)
    flat = lambda most: sorted((int(k), int(p), n) for which, at, n in decontamination.occurrences(w, ids, most) for k, p in zip(which, at))
    assert flat(10**6) == flat(37) == flat(1) and flat(37)


def test_revisits_name_a_record_of_the_archive(spark, tmp_path):
    big = "<p>é" + "x" * 1200
    df = spark.createDataFrame([(1, "http://a", big), (2, "http://b c", big), (3, None, "small"), (2, "http://b c", big)], "page_id long, url string, html string")
    warc.pages_to_warc(df, str(tmp_path / "w"))
    heads = [h for p in (tmp_path / "w").glob("*.gz") for h, _ in warc.parse_warc(gzip.decompress(p.read_bytes()))]
    by_id = {h["warc-record-id"]: h for h in heads}
    later = [h for h in heads if h["warc-type"] == "revisit"]
    assert len(later) == 1 and by_id[later[0]["warc-refers-to"]]["warc-target-uri"] == later[0]["warc-refers-to-target-uri"] == "http://b%20c"
    assert len(by_id) == 3  # a row that repeats is the same record again


def test_warc_of_an_empty_table_and_of_a_long_page(spark, tmp_path):
    schema = "page_id long, url string, html string"
    warc.pages_to_warc(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert warc.read_warc(spark, str(tmp_path / "none")).count() == 0
    warc.pages_to_warc(spark.createDataFrame([(1, "u", "é" * 3_000_000)], schema), str(tmp_path / "long"))
    assert [x.payload_bytes for x in warc.read_warc(spark, str(tmp_path / "long")).collect()] == [6_000_000]


def test_repeated_rows_are_cut_by_shards(spark):
    df = spark.createDataFrame([(1, "copy " * 20)] * 900 + [(None, None)] * 50 + [(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    out = sharding.shard(df, n=10).collect()
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append(x)
    sizes = [sum(x.size for x in rows) for rows in by.values()]
    assert len(out) == 1000 and len(sizes) == 10 and max(sizes) - min(sizes) <= 2 * 116
    assert all(sorted(x.slot for x in rows) == list(range(len(rows))) for rows in by.values())


def test_token_files_of_equal_ids_and_of_none(spark, tmp_path):
    df = spark.createDataFrame([(None, f"text {i}") for i in range(30)] + [(5, f"text {i}") for i in range(30)], "doc_id long, text string")
    out = tokenids.read_documents(tokenids.write_sequences(df, f"file://{tmp_path}/a", length=8)).orderBy("start").collect()
    assert [x.doc_id for x in out] == [None] * 30 + [5] * 30
    assert [x.start for x in out] == np.cumsum([0, *(x.n_tokens for x in out)])[:-1].tolist()
    assert tokenids.read_documents(tokenids.write_sequences(df.where("false"), f"file://{tmp_path}/b")).count() == 0


def test_random_access_over_many_batches(tmp_path):
    out, r = tokenids.SequenceFile(f"file://{tmp_path}", 0, "<u2", length=4), np.random.default_rng(0)
    parts = [r.integers(0, 60_000, n).astype("<u2") for n in (3, 5000, 1, 2047, 4096)]
    for i, x in enumerate(parts):
        out.add(i, x.tobytes())
    uri, n, docs = out.close()
    flat, reader = np.concatenate(parts), tokenids.Reader(uri)
    assert (n, docs) == (len(flat), len(parts)) and len({reader.file.get_batch(i).num_rows for i in range(reader.file.num_record_batches - 2)}) == 1
    for at in (0, 1, 1023, 1024, 5000, n - 1):
        assert np.concatenate(list(reader.span(at, n - at))).tolist() == flat[at:].tolist()
    last = -(-n // 4) - 1
    assert all(reader.sequence(i)[0][: n - 4 * i].tolist() == flat[4 * i : 4 * i + 4].tolist() for i in (0, 255, 256, last - 1, last))


def test_other_vocabularies_go_to_the_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    assert not tokenids.split_as_known(path) and tokenids.split_as_known(public_tokenizers.path(tokenids.VOCABULARY))
    ids = Tokenizer.from_file(path).encode("Some Text, 12½ <|endoftext|>", add_special_tokens=False).ids
    assert np.frombuffer(tokenids.contract_encoder(path)("Some Text, 12½ <|endoftext|>"), tokenids.ids_type(path)).tolist() == ids


def test_verdicts_against_brute_force(spark):
    """Every labelled document is one trial, however often its row stands there."""
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    text = lambda share: " ".join(word() + ("#" * 6 if r.random() < share else "") for _ in range(40))
    rows = [(i, text(0.9 if i % 60 == 0 else 0.0), ["en", "fr"][i % 7 == 0]) for i in range(2400)]
    rows += [rows[0]] * 400 + [(5000 + i, text(0.6), "en") for i in range(20)] + [(None, text(0.9), "en")]
    good = set(range(0, 2400, 2))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in good)) for i in range(2400)] * 2, "doc_id long, quality int")
    tail = lambda k, n, p: sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    measures = lambda t: {"symbols": t.count("#") / len(t.replace(" ", "")), "dup_lines": 0.0, "repeats": 0.0}
    cuts = {}
    for lang in ("en", "fr"):
        trials = {i: measures(t) for i, t, x in rows if i in good and x == lang}
        for rule, cs in quality.CUTOFFS.items():
            for c in cs:
                if tail(sum(m[rule] > c for m in trials.values()), len(trials), quality.ALPHA / 3) > quality.DELTA / 6:
                    break
                cuts[lang, rule] = c
    assert ("en", "symbols") in cuts
    for x in quality.judge(df, labels).join(df.distinct(), ["doc_id", "lang"], "left").collect():
        if x.text:
            assert x.kept == (not any(v > cuts.get((x.lang, k), 2) for k, v in measures(x.text).items())), x


def test_archives_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    """Files have a bounded size whatever the pages', and are read a record at a time."""
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    monkeypatch.setattr(warc, "CLASSES", [1 << 10, 64 << 10])
    noise = random.Random(1)
    sizes = [100] * 300 + [20_000] * 60 + [300_000] * 9 + [3_000_000, 0]
    rows = [(i, f"http://x.example/{i}", "".join(noise.choices("abcdefgh", k=n))) for i, n in enumerate(sizes)]
    warc.pages_to_warc(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), str(tmp_path / "w"))
    files = [len(gzip.decompress(p.read_bytes())) for p in (tmp_path / "w").glob("*.gz")]
    assert len(files) > 8 and sorted(files)[-2] < 1.5 * (1 << 20) and max(files) < 3_010_000
    got = {r.page_id: (r.payload_bytes, r.payload_digest) for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert got == {i: (len(h), hashlib.sha1(h.encode()).hexdigest()) for i, _, h in rows}
    assert list(warc.stretches([5, 5, 50, 1, 1], 10)) == [(0, 2), (2, 3), (3, 5)] and list(warc.stretches([], 10)) == []


def test_an_archive_is_read_as_it_is_inflated():
    """Of an archive of 200 MB no more than some records are in memory."""
    import tracemalloc

    record = warc.to_warc(warc.ArcRecord("http://a.example/", "0.0.0.0", "2024", "text/plain", b"x" * 2_000_000)) + b"\r\n\r\n"
    packed = gzip.compress(record, 1) * 100
    tracemalloc.start()
    assert sum(len(block) for _, block in warc.parse_warc(packed)) == 200_000_000
    assert tracemalloc.get_traced_memory()[1] < 20_000_000
    tracemalloc.stop()


@pytest.mark.parametrize("bit", ["<div><p>word word.", "<font>", "<ul><li>item", "<svg><g>", "<b><i>x</b>", "</div></p></li>", "<table><tr><td>cell", "<span class=a>word "])
def test_unclosed_elements_take_linear_time(bit):
    import time
    import tracemalloc

    began = time.process_time()
    found = extraction.blocks(bit * 50_000)
    assert time.process_time() - began < 5
    tracemalloc.start()
    assert len(extraction.blocks(bit * 5_000)) <= 10_000
    assert tracemalloc.get_traced_memory()[1] < 50_000_000
    tracemalloc.stop()
    assert bool(found) == (re.sub("<[^>]*>", "", bit) != "")


def test_words_of_a_long_text_one_after_another(monkeypatch):
    import public_tokenizers

    path = public_tokenizers.path(tokenids.VOCABULARY)
    text = "it's 12 o'clock, naïve  x\n" * 500
    want = tokenids.encoder(path)(text)
    monkeypatch.setattr(tokenids, "LONG", 100)
    assert tokenids.encoder(path)(text) == want
