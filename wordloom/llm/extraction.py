"""HTML main text by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between block-level tags, each with
the path of elements around it. A block's features are its tag path (names, classes, ids and
roles, hashed), its words (hashed) and a few measures. A bidirectional LSTM in numpy reads
the sequence both ways and labels each block main or not with the whole page as context. It
is trained here, on pages composed from a list of layouts with invented words, and never on
the pages it labels.
"""

from __future__ import annotations

import functools
import html as htmllib
import re
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PATH, WORDS, MEASURES, HIDDEN = 768, 32, 10, 20
#: Blocks whose features are held at once: of pages that go side by side, padded to the longest, and
#: of one longer page, which goes alone, a stretch at a time.
BLOCKS = 4000
#: Elements that an open head may hold; any other, or text, ends it.
IN_HEAD = frozenset("head html base basefont bgsound link meta title style script noscript noframes template".split())

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^>"'])*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTR = re.compile(r"""(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements whose content is no markup, up to their closing tag or the end of the page.
RAW = frozenset("script style textarea title xmp iframe noframes".split())
#: Elements in which a tag may close itself, and RAW means nothing.
FOREIGN = frozenset("svg math".split())
#: Elements of these that hold HTML again.
HTML_IN_FOREIGN = frozenset("foreignobject desc annotation-xml mi mo mn ms mtext".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul label button".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("ul ol dl table".split())


ELEMENTS = PATH * 3 // 4  # features of all elements of a path; the others are of the two nearest


def tokens_of(element: str) -> set[str]:
    tag, _, said = element.partition(" ")
    return {f"<{tag}>", *(x for x in re.split(r"[^a-z]+", said) if x)}


@functools.lru_cache(50_000)
def element_slots(element: str) -> tuple[int, ...]:
    return tuple(zlib.crc32(t.encode()) % ELEMENTS for t in tokens_of(element))


@functools.lru_cache(50_000)
def near_vector(near: tuple[str, ...]) -> np.ndarray:
    """Hashed tokens of the two nearest elements."""
    v = np.zeros(PATH - ELEMENTS, np.float32)
    for token in (t for element in near for t in tokens_of(element)):
        v[zlib.crc32(token.encode()) % (PATH - ELEMENTS)] += 1.0
    return np.minimum(v, 2)


class Place:
    """Where a block stands: its nearest elements, at most two, and the hashed tokens of all elements, counted up to 2."""

    __slots__ = ("near", "counts")

    def __init__(self, near: tuple[str, ...], counts: bytes):
        self.near, self.counts = near, counts

    def __getitem__(self, k):
        return self.near[k]


class Path:
    """The open elements. Each step costs what it adds or takes off, however many are open."""

    def __init__(self) -> None:
        self.elements: list[str] = []
        self.tags: list[str] = []
        self.at: dict[str, list[int]] = {}  # of each tag where it is open
        self.foreign: list[int] = []  # where svg and math, and elements that hold HTML in them, are open
        self.counts = [0] * ELEMENTS
        self.seen = bytearray(ELEMENTS)
        self.here: Place | None = None

    def push(self, tag: str, element: str) -> None:
        i = len(self.tags)
        self.elements.append(element)
        self.tags.append(tag)
        self.at.setdefault(tag, []).append(i)
        if tag in FOREIGN or tag in HTML_IN_FOREIGN:
            self.foreign.append(i)
        for k in element_slots(element):
            self.counts[k] += 1
            self.seen[k] = min(self.counts[k], 2)
        self.here = None

    def cut(self, upto: int) -> None:
        while len(self.tags) > upto:
            tag = self.tags.pop()
            self.at[tag].pop()
            if self.foreign and self.foreign[-1] == len(self.tags):
                self.foreign.pop()
            for k in element_slots(self.elements.pop()):
                self.counts[k] -= 1
                self.seen[k] = min(self.counts[k], 2)
            self.here = None

    def last(self, *tags: str) -> int:
        """Where the nearest open element of these tags is, or -1."""
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=-1)

    def first(self, tag: str) -> int:
        found = self.at.get(tag)
        return found[0] if found else -1

    def foreign_at(self) -> int | None:
        """Where the svg or math begins that reads the next tag."""
        return self.foreign[-1] if self.foreign and self.tags[self.foreign[-1]] in FOREIGN else None

    def place(self) -> Place:
        if self.here is None:
            self.here = Place(tuple(self.elements[-2:]), bytes(self.seen))
        return self.here


def blocks(page: str | None) -> list[tuple[Place, str, int]]:
    """(place, text, characters inside links) of each block with text, in page order. Markup, comments
    and RAW elements are left out; references are decoded; white space
    in a block, line-break tags too, becomes one space. Time and memory grow with the page's length, however deep
    its elements are nested and however many are left open."""
    out, path, parts, links, at, page = [], Path(), [], 0, 0, page or ""
    in_link = in_head = 0

    def end_block() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append((path.place(), text, links))
            parts, links = [], 0

    def text(upto: int) -> None:
        nonlocal links, in_head
        if upto > at:
            t = htmllib.unescape(page[at:upto])
            if in_head and t.strip():
                in_head = False
            elif in_head:
                return
            parts.append(t)
            links += len(t.strip()) if in_link else 0

    while m := TAG.search(page, at):
        text(m.start())
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing = bool(m[1] or m[4])
        foreign = path.foreign_at()
        if not closing:
            if foreign is not None and name in BLOCK:  # HTML's own blocks end an svg or math that is still open
                path.cut(foreign)
                foreign = None
            if (name in FOREIGN or foreign is not None) and (m[3] or m[6] or "").endswith("/"):
                continue
            if name in RAW:
                end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
                if end or foreign is None:
                    at = end.end() if end else len(page)
                parts.append(" ")
                continue
        if name == "br":
            parts.append(" ")
            continue
        if name in BLOCK:
            end_block()
        if name == "head":
            in_head = not closing
        elif not closing and name not in IN_HEAD:
            in_head = False
        if name == "a":
            in_link = not closing
        elif name in BLOCK:
            in_link = 0
        if name in VOID:
            continue
        if closing:
            if (i := path.last(name)) >= 0:
                path.cut(i)
            continue
        if name in BLOCK and name not in ("button", "label", "option") and (i := path.first("p")) >= 0:
            path.cut(i)
        elif name in CLOSES and (i := path.last(*CLOSES[name])) > path.last(*FENCE):
            path.cut(i)
        attrs = m[3] or m[6] or ""
        said = " ".join(v.strip("\"'").lower() for _, v in ATTR.findall(attrs)) if "=" in attrs else ""
        path.push(name, f"{name} {said}" if said else name)
    text(len(page))
    end_block()
    return out


@functools.lru_cache(200_000)
def word_slot(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % WORDS


def features(page: list[tuple[Place, str, int]], start: int = 0, end: int | None = None) -> np.ndarray:
    """Of the page's blocks from start to end a row each."""
    part = page[start:end]
    x = np.zeros((len(part), PATH + WORDS + MEASURES), np.float32)
    for i, (place, text, linked) in enumerate(part):
        at = start + i
        words, n = text.split(" "), len(text)
        x[i, :ELEMENTS], x[i, ELEMENTS:PATH] = np.frombuffer(place.counts, np.uint8), near_vector(place.near)
        h = np.bincount(np.fromiter(map(word_slot, words), np.int64, len(words)), minlength=WORDS)
        x[i, PATH : PATH + WORDS] = h / np.sqrt((h * h).sum())
        marks = sum(map(text.count, ".,;:!?"))
        x[i, PATH + WORDS :] = (
            np.log1p(n) / 6, np.log1p(len(words)) / 5, min(1.0, linked / n), min(1.0, 10 * marks / n), text[-1] in ".!?…\"”»",
            text[0].isupper(), at / len(page), at == 0, at == len(page) - 1, "©" in text,
        )
    return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with a logistic output per block."""

    def __init__(self, size: int = PATH + WORDS + MEASURES, hidden: int = HIDDEN, seed: int = 7):
        r = np.random.default_rng(seed)
        self.h = hidden
        self.w = {}
        for d in "fb":
            self.w[f"x{d}"] = (r.standard_normal((size, 4 * hidden)) * 0.1).astype(np.float32)
            self.w[f"h{d}"] = (r.standard_normal((hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
            self.w[f"c{d}"] = np.zeros(4 * hidden, np.float32)
            self.w[f"c{d}"][hidden : 2 * hidden] = 1
        self.w["o"] = (r.standard_normal(2 * hidden) * 0.1).astype(np.float32)
        self.w["k"] = np.zeros(1, np.float32)

    def one_way(self, x: np.ndarray, lengths: np.ndarray, d: str, carried: tuple[np.ndarray, np.ndarray] | None = None, training: bool = True):
        """Hidden states (page, step, unit) of pages sorted by falling length; what training needs, if
        it is; and the last state and cell, which may be carried into the stretch that follows."""
        h, (pages, steps, _) = self.h, x.shape
        gates = x @ self.w[f"x{d}"] + self.w[f"c{d}"]
        state, cell = carried or (np.zeros((pages, h), np.float32), np.zeros((pages, h), np.float32))
        out, kept = np.zeros((pages, steps, h), np.float32), []
        for t in range(steps):
            n = int(np.searchsorted(-lengths, -t, side="left"))  # pages with a block t
            g = gates[:n, t] + state[:n] @ self.w[f"h{d}"]
            s = sigmoid(g[:, : 3 * h])
            i, f, o, u = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(g[:, 3 * h :])
            before, old = state[:n].copy(), cell[:n].copy()
            cell[:n] = f * old + i * u
            tc = np.tanh(cell[:n])
            state[:n] = o * tc
            out[:n, t] = state[:n]
            if training:
                kept.append((n, i, f, o, u, before, old, tc))
        return out, kept, (state, cell)

    def forward(self, pages: list[np.ndarray], training: bool = True):
        """Pages must be sorted by falling length."""
        lengths = np.array([len(p) for p in pages])
        x = np.zeros((len(pages), lengths[0], pages[0].shape[1]), np.float32)
        r = np.zeros_like(x)
        for i, p in enumerate(pages):
            x[i, : len(p)], r[i, : len(p)] = p, p[::-1]
        f, kf, _ = self.one_way(x, lengths, "f", training=training)
        b, kb, _ = self.one_way(r, lengths, "b", training=training)
        back = np.zeros_like(b)
        for i, n in enumerate(lengths):
            back[i, :n] = b[i, :n][::-1]
        both = np.concatenate([f, back], axis=2)
        return sigmoid(both @ self.w["o"] + self.w["k"]), (x, r, lengths, both, kf, kb)

    def gradients(self, kept, error: np.ndarray) -> dict[str, np.ndarray]:
        x, r, lengths, both, kf, kb = kept
        h, g = self.h, {"o": np.einsum("pt,pth->h", error, both), "k": np.array([error.sum()])}
        out = error[:, :, None] * self.w["o"]
        back = np.zeros_like(out[:, :, h:])
        for i, n in enumerate(lengths):
            back[i, :n] = out[i, :n, h:][::-1]
        for d, xs, ks, e in (("f", x, kf, out[:, :, :h]), ("b", r, kb, back)):
            dg = np.zeros((*xs.shape[:2], 4 * h), np.float32)
            dh, dc = np.zeros((len(xs), h), np.float32), np.zeros((len(xs), h), np.float32)
            gh = np.zeros_like(self.w[f"h{d}"])
            for t in range(xs.shape[1] - 1, -1, -1):
                n, i, f, o, u, before, old, tc = ks[t]
                a = e[:n, t] + dh[:n]
                c = dc[:n] + a * o * (1 - tc * tc)
                z = np.concatenate([c * u * i * (1 - i), c * old * f * (1 - f), a * tc * o * (1 - o), c * i * (1 - u * u)], axis=1)
                dg[:n, t] = z
                gh += before.T @ z
                dh[:n], dc[:n] = z @ self.w[f"h{d}"].T, c * f
            flat = dg.reshape(-1, 4 * h)
            g |= {f"x{d}": xs.reshape(-1, xs.shape[2]).T @ flat, f"h{d}": gh, f"c{d}": flat.sum(axis=0)}
        return g

    def fit(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 14, size: int = 32, rate: float = 0.01, seed: int = 11) -> Labeller:
        r, m, step = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.w.items()}, 0
        for epoch in range(epochs):
            order = r.permutation(len(pages))
            for i in range(0, len(order), size):
                part = sorted((pages[j] for j in order[i : i + size]), key=lambda p: -len(p[0]))
                said, kept = self.forward([p[0] for p in part])
                error = np.zeros_like(said)
                for j, (_, y) in enumerate(part):
                    error[j, : len(y)] = said[j, : len(y)] - y
                error /= sum(len(p[1]) for p in part)
                step += 1
                for k, g in self.gradients(kept, error).items():
                    a, b = m[k]
                    a *= 0.9
                    a += 0.1 * g
                    b *= 0.999
                    b += 0.001 * g * g
                    self.w[k] -= (rate * 0.85**epoch * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self

    def label(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Of each page's features the blocks' probabilities to be main."""
        return self.labelled(list(map(len, pages)), lambda i, a, b: pages[i][a:b])

    def labelled(self, lengths: list[int], read: Callable[[int, int, int], np.ndarray]) -> list[np.ndarray]:
        """The same where read gives the features of page i from block a to b. Pages of like length go
        side by side, at most BLOCKS blocks with the padding; a longer page goes alone."""
        order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])
        out, at = [np.zeros(0, np.float32)] * len(lengths), 0
        while at < len(order):
            longest = lengths[order[at]]
            if longest > BLOCKS:
                out[order[at]] = self.alone(longest, functools.partial(read, order[at]))
                at += 1
                continue
            part = order[at : at + BLOCKS // longest]
            for j, p in zip(part, self.forward([read(j, 0, lengths[j]) for j in part], training=False)[0]):
                out[j] = p[: lengths[j]]
            at += len(part)
        return out

    def alone(self, n: int, read: Callable[[int, int], np.ndarray]) -> np.ndarray:
        """One page, BLOCKS blocks at a time, first back to front, then front to back."""
        score, starts = np.zeros(n, np.float32), range(0, n, BLOCKS)
        for d, order in (("b", reversed(starts)), ("f", starts)):
            carried, weights = None, self.w["o"][self.h :] if d == "b" else self.w["o"][: self.h]
            for a in order:
                x = read(a, min(n, a + BLOCKS))
                x = x[::-1] if d == "b" else x
                h, _, carried = self.one_way(x[None], np.array([len(x)]), d, carried, training=False)
                got = h[0] @ weights
                score[a : a + len(x)] += got[::-1] if d == "b" else got
        return sigmoid(score + self.w["k"])


#: Layouts of the parts of a page that are no main text, by kind: (opening, closing, inner elements).
OUTSIDE = {
    "menu": ["nav", "div.menu", "div.navbar", "ul.nav", "div#navigation", "div.main-menu", "div.breadcrumb", "nav.topnav", "div.pagination", "ul.tabs", "div[role=navigation]", "div.toc"],
    "header": ["header", "div.header", "div#header", "div.masthead", "header.site-header", "div.topbar", "div.logo", "div#banner"],
    "footer": ["footer", "div.footer", "div#footer", "footer.site-footer", "div.bottom", "div.copyright", "div.legal", "div#colophon"],
    "sidebar": ["aside", "div.sidebar", "div#sidebar", "aside.widget", "div.related", "div.widget-area", "div.rail", "div.popular", "section.recommended", "div.trending"],
    "notice": ["div.cookie", "div.cookie-banner", "div#consent", "div.notice", "div.alert", "div.gdpr", "div.popup", "div.modal", "div.overlay", "div[role=dialog]", "div.subscribe", "div.paywall", "div[role=alert]", "section.notice"],
    "advert": ["div.ad", "div.ads", "div.advert", "div.advertisement", "div.sponsored", "div.promo", "div#ad", "ins.adsbygoogle", "aside.ad", "div.banner-ad", "section.sponsor"],
    "form": ["form", "form.search", "form#login", "div.newsletter", "form.contact", "div.signup", "form#subscribe", "div.search-box"],
    "comments": ["section.comments", "div#comments", "div.comments", "ol.comment-list", "div.comment", "section#discussion", "div.responses", "div#disqus", "div.replies", "ul.comments", "div.reader-comments", "section.user-comments"],
    "share": ["div.share", "div.social", "ul.share-buttons", "div.tags", "div.author-bio", "div.byline"],
}
INSIDE = ["article", "main", "div.content", "div#content", "div.post", "div.entry-content", "div.article-body", "article.post", "div[role=main]", "div.story", "section.article", "main.page", "div.text", "div#main", "article.entry"]


def _open(spec: str) -> tuple[str, str]:
    tag = re.match(r"\w+", spec)[0]
    attrs = "".join(f' {a}="{v}"' for a, v in [*(("class", x) for x in re.findall(r"\.([\w-]+)", spec)), *(("id", x) for x in re.findall(r"#([\w-]+)", spec)), *(("role", x) for x in re.findall(r"role=(\w+)", spec))])
    return f"<{tag}{attrs}>", f"</{tag}>"


def composed(seed: int) -> str:
    """A page of a random layout. Its main blocks begin with U+E000, which training removes."""
    r = np.random.default_rng(seed)
    one = lambda xs: xs[int(r.integers(len(xs)))]
    syllables = ["".join(chr(97 + int(c)) for c in r.integers(0, 26, int(r.integers(1, 4)))) for _ in range(40)]
    word = lambda: "".join(one(syllables) for _ in range(int(r.integers(1, 4))))

    def words(lo: int, hi: int, stop: bool = True) -> str:
        n = int(np.exp(r.uniform(np.log(lo), np.log(hi + 1))))
        noise = one(["", "", "", "", "###", "%%%", "&amp;&amp;"])
        again = [word() for _ in range(int(r.integers(1, 3)))] if r.random() < 0.08 else None
        got = " ".join((one(again) if again else word()) + one(["", "", "", "", ",", "."]) + noise for _ in range(max(lo, n)))
        return got[0].upper() + got[1:] + ("." if stop and r.random() < 0.85 else "")

    def outside(kind: str) -> str:
        a, b = _open(one(OUTSIDE[kind]))
        link = lambda: f'<a href="/{word()}">{words(1, 3, False)}</a>'
        if kind in ("menu", "share") or r.random() < 0.15:
            item = (lambda: f"<li>{link()}</li>") if r.random() < 0.8 else link
            inner = "".join(item() for _ in range(int(r.integers(2, 9))))
            return f"{a}{inner if a.startswith('<ul') or a.startswith('<ol') else f'<ul>{inner}</ul>' if '<li>' in inner else inner}{b}"
        if kind == "form":
            return f"{a}<label>{words(1, 4, False)}</label><input name=q><p>{words(2, 15)}</p><button>{word()}</button>{b}"
        if kind == "comments":
            style = one(["<p>%s</p>", '<div class="comment"><p>%s</p></div>', "<li>%s</li>", '<div class="comment-body">%s</div>', "<blockquote><p>%s</p></blockquote>", "%s<br>%s"])
            heading = f"<h{int(r.integers(2, 5))}>{words(1, 3, False)}</h3>" if r.random() < 0.6 else ""
            return a + heading + "".join(style.replace("%s", words(3, 60)) for _ in range(int(r.integers(1, 6)))) + b
        copy = "&copy; " if kind == "footer" and r.random() < 0.6 else ""
        style = one(["%s", "%s", "<p>%s</p>", "<div>%s</div>", "<h3>" + words(1, 4, False) + "</h3><p>%s</p>", "<span>%s</span>", "<p>%s</p><p>" + words(2, 30) + "</p>", "<p>%s " + link() + "</p>"])
        return a + copy + style.replace("%s", words(2, 40)) + b

    def main() -> str:
        m, parts = "\ue000", []
        if r.random() < 0.8:
            parts.append(f"<h1>{m}{words(1, 14, False)}</h1>")
        for _ in range(int(np.exp(r.uniform(0, np.log(25))))):
            kind = r.random()
            if kind < 0.68:
                inner = words(1, 160)
                if r.random() < 0.15:
                    inner = f"<b>{inner}" + ("<br>" if r.random() < 0.5 else "</b>")
                elif r.random() < 0.15:
                    inner += f' <a href="#">{word()}</a> {words(1, 20)}'
                parts.append(f"<p>{m}{inner}" + ("" if r.random() < 0.1 else "</p>"))
            elif kind < 0.76:
                parts.append(f"<h{int(r.integers(2, 5))}>{m}{words(1, 8, False)}</h2>")
            elif kind < 0.83:
                close, most = one(["</li>", ""]), one([3, 8, 25])
                parts.append("<ul>" + "".join(f"<li>{m}{words(1, most, most > 3)}{close}" for _ in range(int(r.integers(1, 6)))) + "</ul>")
            elif kind < 0.86:
                parts.append(f"<blockquote>{m}{words(4, 50)}</blockquote>")
            elif kind < 0.89:
                parts.append(f"<pre>{m}{words(3, 40)}</pre>")
            elif kind < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{m}{words(1, 5, False)}</td><td>{m}{words(1, 5, False)}</td></tr>" for _ in range(int(r.integers(1, 5)))) + "</table>")
            elif kind < 0.95:
                parts.append(f"<figure><img src=x><figcaption>{m}{words(2, 15)}</figcaption></figure>")
            else:
                parts.append(outside(one(["advert", "share", "form", "sidebar", "notice", "menu"])))
        if r.random() < 0.12:
            parts.append(outside("comments"))
        a, b = _open(one(INSIDE))
        style = r.random()
        if style < 0.5:
            return a + "".join(parts) + b
        if style < 0.7:
            c, d = _open(one([*INSIDE, "div", "section", f"div.{word()}"]))
            return a + c + "".join(parts) + d + b
        if style < 0.85:
            c, d = _open(f"div.{word()}")
            return c + a + "".join(parts) + b + d
        return "<div>" + "".join(parts) + "</div>" if style < 0.93 else "".join(parts)

    before = [outside(k) for k in ("header", "menu", "notice", "advert", "form", "sidebar") if r.random() < 0.45]
    after = [outside(k) for k in ("share", "comments", "sidebar", "advert", "notice", "menu", "footer") if r.random() < 0.45]
    r.shuffle(before)
    if r.random() < 0.3:
        r.shuffle(after)
    if r.random() < 0.1:
        return "<html><body>" + "".join([*before, *after]) + "</body></html>"
    return "<!DOCTYPE html><html><head><title>x</title></head><body>" + "".join([*before, main(), *after]) + "</body></html>"


@functools.cache
def trained(pages: int = 1800) -> Labeller:
    """The labeller, the same in every process."""
    rows = []
    for seed in range(pages):
        found = blocks(composed(seed))
        y = np.array([t.startswith("\ue000") for _, t, _ in found], np.float32)
        bare = [(p, t.replace("\ue000", "").strip() or "-", k) for p, t, k in found]
        if bare:
            rows.append((features(bare), y))
    return Labeller().fit(rows)


def main_texts(model: Labeller, pages: list[str | None]) -> list[str]:
    out: list[str] = []
    waiting: list[list] = []

    def done() -> None:
        labels = model.labelled(list(map(len, waiting)), lambda i, a, b: features(waiting[i], a, b))
        for found, p in zip(waiting, labels):
            out.append("\n".join(t for (_, t, _), y in zip(found, p) if y > 0.5))
        waiting.clear()

    held = 0
    for page in pages:
        waiting.append(blocks(page))
        held += len(waiting[-1])
        if held > 4 * BLOCKS or len(waiting) >= 500:
            done()
            held = 0
    done()
    return out


def extracted(html: Column, spark: SparkSession, model: Labeller | None = None) -> Column:
    sent = spark.sparkContext.broadcast(model or trained())

    @F.arrow_udf("string")
    def of(pages: pa.Array) -> pa.Array:
        return pa.array(main_texts(sent.value, pages.to_pylist()), pa.string())

    return of(html)


def extract(pages: DataFrame) -> DataFrame:
    """pages with text and n_chars (code points); columns of these names are replaced.

    A null or empty html, and a page without main text, give the empty text. Rows stand for
    themselves: null ids and repeated rows pass through.
    """
    return pages.drop("text", "n_chars").withColumn("text", extracted(F.col("html"), pages.sparkSession)).withColumn("n_chars", F.length("text").cast("long"))


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
