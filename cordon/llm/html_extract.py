"""HTML extraction: a linear-chain conditional random field over the leaf blocks of the DOM.

A page becomes the sequence of its text blocks, each with its chain of open elements. A two-state
chain (boilerplate, content) over ancestor-tag, class-word and text features is trained on labelled
pages and decoded by Viterbi; the content blocks, joined by one space, are the main text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

#: Fixed values of HTML: elements without text of their own, without end tags, and that do not end a block.
UNSEEN = frozenset("script style head title noscript template svg math iframe object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset(("script", "style"))
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME_CLOSES = frozenset("li dt dd tr td th option p".split())
#: An element that is closed implicitly is only looked for up to the nearest of these.
BARRIER = frozenset("ul ol dl table article section div nav aside footer header main form body select".split())
SPACE = re.compile(r"\s+")
CONCEALED = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.I)


def _unseen(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """An element that a browser doesn't show: by its kind, the ``hidden`` attribute, or its style."""
    return tag in UNSEEN or any(n == "hidden" or (n == "aria-hidden" and v == "true") or (n == "style" and CONCEALED.search(v or "")) for n, v in attrs)


class Place:
    """An open element as blocks see it: its tag, and the features of ancestors that hold from it on, beside its parent's."""

    __slots__ = ("fresh", "parent", "tag", "value")

    def __init__(self, parent: Place | None, tag: str, fresh: list[str]):
        self.parent, self.tag, self.fresh = parent, tag, fresh
        self.value: tuple[float, float] | None = None


class _Blocks(HTMLParser):
    """Collects (text, place, characters in links). An element costs its own tag, class words and end, however deep it stands."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, Place]] = []
        self.root = Place(None, "", [])
        self.holding: set[str] = set()
        #: Open elements by name, and those that an implicit end could meet by (open barriers, name).
        self.count: Counter[str] = Counter()
        self.near: Counter[tuple[int, str]] = Counter()
        self.barriers = 0
        self.found: list[tuple[str, Place, int]] = []
        self.text: list[str] = []
        self.linked = self.hidden = 0

    def place(self) -> Place:
        return self.open[-1][2] if self.open else self.root

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.text)).strip()
        if text:
            self.found.append((text, self.place(), self.linked))
        self.text, self.linked = [], 0

    def _push(self, tag: str, unseen: bool, words: list[str]) -> None:
        place = self.place()
        if tag not in INLINE:
            fresh = [f for f in dict.fromkeys([f"in:{tag}", *(f"word:{w}" for w in words)]) if f not in self.holding]
            self.holding.update(fresh)
            place = Place(place, tag, fresh)
        self.open.append((tag, unseen, place))
        self.count[tag] += 1
        self.hidden += unseen
        if tag in BARRIER:
            self.barriers += 1
        elif tag in SAME_CLOSES:
            self.near[self.barriers, tag] += 1

    def _pop_to(self, k: int) -> None:
        while len(self.open) > k:
            tag, unseen, place = self.open.pop()
            self.count[tag] -= 1
            self.hidden -= unseen
            if tag in BARRIER:
                self.barriers -= 1
            elif tag in SAME_CLOSES:
                self.near[self.barriers, tag] -= 1
            if tag not in INLINE:
                self.holding.difference_update(place.fresh)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append("\n")
            return
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag == "body" and self.hidden:  # an unclosed head
            self._pop_to(0)
        ends = {t for t in ("p" if tag in CLOSES_P else "", tag if tag in SAME_CLOSES else "") if t and self.near[self.barriers, t]}
        if ends:
            self._pop_to(next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] in ends))
        words = [w for n, v in attrs if v and n in ("class", "id", "role") for w in re.findall(r"[a-z]+", v.lower())]
        self._push(tag, _unseen(tag, attrs), words)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in RAW:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        if self.count[tag]:
            self._pop_to(next(k for k in range(len(self.open) - 1, -1, -1) if self.open[k][0] == tag))

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            if self.count["a"]:
                self.linked += len(data.strip())


def blocks(html: str | None) -> list[tuple[str, Place, int]]:
    """The page's text blocks in order; white space inside one is one space, references are decoded."""
    p = _Blocks()
    p.feed(html or "")
    p.close()
    p.flush()
    return p.found


def own_features(block: tuple[str, Place, int]) -> list[str]:
    """Names of the features of a block's text and innermost element."""
    text, place, linked = block
    n = len(text)
    out = ["bias", f"leaf:{place.tag}", f"size:{min(8, n.bit_length())}", f"links:{(4 * min(linked, n)) // n}"]
    if "©" in text or "copyright" in text.lower():
        out.append("copyright")
    if text[-1] in ".!?…\"”":
        out.append("sentence")
    return out


def features(block: tuple[str, Place, int]) -> list[str]:
    """All features of a block: its ancestors' tags and class words, and its own. For training; it walks to the root."""
    out, place = own_features(block), block[1]
    while place is not None:
        out += place.fresh
        place = place.parent
    return out


class Chain:
    """A two-state conditional random field: weights by feature and state, and by transition."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.index, self.weights, self.moves = index, weights, moves
        self.pairs = {f: tuple(weights[k].tolist()) for f, k in index.items()}

    def _sum(self, fs: Iterable[str], start: tuple[float, float] = (0.0, 0.0)) -> tuple[float, float]:
        a, b = start
        get = self.pairs.get
        for f in fs:
            if w := get(f):
                a += w[0]
                b += w[1]
        return a, b

    def _value(self, place: Place) -> tuple[float, float]:
        """What a place's ancestors and itself add to each state; kept with each place, so a page's blocks share it."""
        above = []
        value = (0.0, 0.0)
        at: Place | None = place
        while at is not None:
            if at.value is not None:
                value = at.value
                break
            above.append(at)
            at = at.parent
        for p in reversed(above):
            value = p.value = self._sum(p.fresh, value)
        return value

    def potentials(self, page: list[list[str]]) -> np.ndarray:
        return np.array([self._sum(fs) for fs in page]).reshape(-1, 2)

    def viterbi(self, page: list[list[str]]) -> list[int]:
        """The most probable states of blocks given by all their features."""
        return self.best([self._sum(fs) for fs in page])

    def label(self, page: list[tuple[str, Place, int]]) -> list[int]:
        """The most probable states of a page's blocks, whose ancestors are added up once for all of them."""
        return self.best([self._sum(own_features(b), self._value(b[1])) for b in page])

    def best(self, u: list[tuple[float, float]]) -> list[int]:
        """The path of greatest sum over the blocks' potentials; equal paths go to content."""
        if not u:
            return []
        (m00, m01), (m10, m11) = self.moves.tolist()
        a, b, back = u[0][0], u[0][1], []
        for p, q in u[1:]:
            f0, f1 = b + m10 >= a + m00, b + m11 >= a + m01
            back.append((f0, f1))
            a, b = p + (b + m10 if f0 else a + m00), q + (b + m11 if f1 else a + m01)
        out = [int(b >= a)]
        for f in reversed(back):
            out.append(int(f[out[-1]]))
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 10, rate: float = 0.3, ridge: float = 1e-4) -> Chain:
    """Maximum conditional likelihood by adaptive gradient steps, one page at a time."""
    index: dict[str, int] = {}
    coded = [([[index.setdefault(f, len(index)) for f in fs] for fs in x], np.array(y)) for x, y in pages if x]
    w, m = np.zeros((len(index), 2)), np.zeros((2, 2))
    gw, gm = np.full(w.shape, 1e-2), np.full(m.shape, 1e-2)
    rng = np.random.default_rng(3)
    for _ in range(rounds):
        for k in rng.permutation(len(coded)):
            x, y = coded[k]
            u = np.array([w[fs].sum(axis=0) for fs in x])
            n = len(u)
            fwd, bwd = u.copy(), np.zeros_like(u)
            for i in range(1, n):
                fwd[i] += np.logaddexp(fwd[i - 1, 0] + m[0], fwd[i - 1, 1] + m[1])
            for i in range(n - 2, -1, -1):
                v = bwd[i + 1] + u[i + 1]
                bwd[i] = np.logaddexp(m[:, 0] + v[0], m[:, 1] + v[1])
            z = np.logaddexp(fwd[-1, 0], fwd[-1, 1])
            g = -np.exp(fwd + bwd - z)
            g[np.arange(n), y] += 1
            step = np.zeros_like(m)
            for i in range(1, n):
                step -= np.exp(fwd[i - 1][:, None] + m + (u[i] + bwd[i])[None] - z)
                step[y[i - 1], y[i]] += 1
            for i, fs in enumerate(x):
                gw[fs] += g[i] ** 2
                w[fs] += rate * (g[i] / np.sqrt(gw[fs]) - ridge * w[fs])
            gm += step**2
            m += rate * step / np.sqrt(gm)
    return Chain(index, w, m)


#: Class words of the labelled pages, by what an element that carries one holds.
MENUS = ("nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "pagination", "pager", "toc", "skip")
HEADERS = ("header", "masthead", "banner", "top", "topbar", "logo", "branding")
FOOTERS = ("footer", "foot", "bottom", "copyright", "legal", "colophon", "contentinfo")
SIDEBARS = ("sidebar", "side", "widget", "related", "recommended", "popular", "trending", "tags", "rail", "complementary")
NOTICES = ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "paywall", "privacy")
ADVERTS = ("ad", "ads", "advert", "advertisement", "sponsored", "sponsor", "promo", "banner", "outbrain", "taboola", "dfp")
FORMS = ("newsletter", "subscribe", "signup", "login", "search", "share", "social", "contact", "form")
COMMENTS = ("comment", "comments", "reply", "replies", "respond", "disqus", "discussion", "commentlist", "reader", "feedback", "responses", "opinions", "thread", "guestbook")
ARTICLES = ("article", "content", "post", "entry", "story", "text", "body", "main", "page", "hentry")


def labelled_pages(n: int = 400, seed: int = 11) -> list[tuple[str, list[int]]]:
    """Training pages made by rule: page templates whose parts are known, and the label of each block.

    ``n`` bounds the sample; it does not depend on the data.
    """
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    chance = lambda p: rng.random() < p
    word = lambda: "".join(pick("aeiou") + pick("bcdfghlmnprstvw") for _ in range(int(rng.integers(1, 5))))

    def said(lo: int, hi: int) -> str:
        t = " ".join(word() for _ in range(int(rng.integers(lo, hi)))).capitalize()
        return t + (pick((".", ".", "!", "?")) if chance(0.7) else "")

    def attr(words: tuple[str, ...], always: bool = False) -> str:
        if not words or (not always and chance(0.3)):
            return ""
        return f' {pick(("class", "id", "class"))}="{pick(words)}{pick(("", "-" + word(), " " + word()))}"'

    def part(tag: str, words: tuple[str, ...], label: int, must: bool) -> tuple[str, list[int]]:
        inner, y = [], []
        for _ in range(int(rng.integers(1, 5))):
            kind = pick(("p", "p", "bare", "list", "h", "link"))
            if kind == "list":
                k = int(rng.integers(1, 7))
                inner.append("<ul>" + "".join(f'<li><a href="#">{said(1, 4)}</a></li>' for _ in range(k)) + "</ul>")
                y += [label] * k
                continue
            t = said(1, 40) if kind in ("p", "bare") else said(1, 8)
            inner.append({"p": f"<p>{t}</p>", "bare": f"<div>{t}</div>", "h": f"<h3>{t}</h3>", "link": f'<p><a href="#">{t}</a></p>'}[kind])
            y.append(label)
        return f"<{tag}{attr(words, must)}>{''.join(inner)}</{tag}>", y

    junk = [
        ("nav", MENUS, False), ("div", MENUS, True), ("header", HEADERS, False), ("div", HEADERS, True), ("aside", SIDEBARS, False), ("div", SIDEBARS, True),
        ("div", NOTICES, True), ("section", NOTICES, True), ("div", ADVERTS, True), ("aside", ADVERTS, False), ("form", FORMS, False), ("div", FORMS, True),
        ("section", COMMENTS, True), ("div", COMMENTS, True), ("ol", COMMENTS, True),
    ]

    def article() -> tuple[str, list[int]]:
        tag, words, must = pick((("article", ARTICLES, False), ("article", ARTICLES, False), ("main", ARTICLES, False), ("div", ARTICLES, True), ("div", (), False)))
        plain = not words and chance(0.5)  # an article of nothing but divisions
        inner, y = [f"<h1>{said(2, 12)}</h1>"] if chance(0.9) else [], []
        y += [1] * len(inner)
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            k = 1
            if kind < 0.58:
                inner.append(f"<div>{said(5, 80)}</div>" if plain else f"<p>{said(1, 80)}</p>")
            elif kind < 0.64:
                inner.append(f"<p><b>{said(1, 30)}<br><p>{said(1, 40)}</p>")
                k = 2
            elif kind < 0.7:
                inner.append(f"<{(h := pick(('h2', 'h3', 'h4')))}>{said(1, 8)}</{h}>")
            elif kind < 0.8:
                k = int(rng.integers(1, 6))
                inner.append(f"<{(h := pick(('ul', 'ol')))}>" + "".join(f"<li>{said(1, 20)}</li>" for _ in range(k)) + f"</{h}>")
            elif kind < 0.83:
                k = int(rng.integers(1, 4))
                inner.append("<ul>" + "".join(f'<li><a href="#">{said(1, 8)}</a></li>' for _ in range(k)) + "</ul>")
            elif kind < 0.86:
                k = 2 * int(rng.integers(1, 4))
                inner.append("<table>" + "".join(f"<tr><td>{said(1, 5)}</td><td>{said(1, 5)}</td></tr>" for _ in range(k // 2)) + "</table>")
            elif kind < 0.9:
                inner.append(f"<{(h := pick(('blockquote', 'pre', 'figcaption', 'div', 'section')))}>{said(3, 30)}</{h}>")
            elif kind < 0.92:
                inner.append(f'<p><a href="#">{said(2, 8)}</a></p>')
            else:
                t, w, m = pick(junk)
                h, z = part(t, w, 0, m)
                inner.append(h)
                y += z
                k = 0
            y += [1] * k
        if chance(0.15):
            h, z = part(pick(("div", "section")), COMMENTS, 0, True)
            inner.append(h)
            y += z
        return f"<{tag}{attr(words, must)}>{''.join(inner)}</{tag}>", y

    out = []
    for _ in range(n):
        html, y = [], []
        for _ in range(int(rng.integers(1, 5))):
            h, z = part(*(lambda t, w, m: (t, w, 0, m))(*pick(junk)))
            html.append(h)
            y += z
        h, z = article()
        html.append(h)
        y += z
        for _ in range(int(rng.integers(0, 4))):
            h, z = part(*(lambda t, w, m: (t, w, 0, m))(*pick(junk)))
            html.append(h)
            y += z
        if chance(0.85):
            t = f"<footer{attr(FOOTERS)}>" if chance(0.8) else f"<div{attr(FOOTERS, True)}>"
            html.append(f"{t}&copy; {said(1, 12)}</{t[1:].split()[0].rstrip('>')}>")
            y.append(0)
        wrap = ("<div class='wrapper'>", "</div>") if chance(0.3) else ("", "")
        out.append((f"<html><head><title>{said(2, 6)}</title><script>var a='</p>';</script></head><body>{wrap[0]}{''.join(html)}{wrap[1]}</body></html>", y))
    return out


def fit(pages: Iterable[tuple[str, list[int]]] | None = None) -> Chain:
    """Train on labelled pages (html, label of each block); the default ones are made by rule, and trained on once in a process."""
    return _fit_rules() if pages is None else _fit(pages)


@cache
def _fit_rules() -> Chain:
    return _fit(labelled_pages())


def _fit(pages: Iterable[tuple[str, list[int]]]) -> Chain:
    data = []
    for html, y in pages:
        x = [features(b) for b in blocks(html)]
        if len(x) != len(y):
            raise ValueError("a label for each block is needed")
        data.append((x, y))
    return train(data)


def main_text(html: str | None, model: Chain) -> str:
    found = blocks(html)
    return " ".join(b[0] for b, y in zip(found, model.label(found), strict=True) if y)


def extract(pages: DataFrame, model: Chain, keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """Columns ``keep``, text (main text, whole; empty if none) and n_chars (its code points), a row for each page.

    Null and empty html give an empty text. Repeated pages are extracted each. Other columns play no part.
    """
    source = pages.select(*keep, F.col("html").alias("__html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            text = [main_text(h, model) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.record_batch([*b.columns[:-1], pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = source.drop("__html").schema.add("text", "string").add("n_chars", "long")
    return source.mapInArrow(run, schema)
