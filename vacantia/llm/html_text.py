"""Main text of web pages by a recurrent block labeller.

A page is read as the sequence of its leaf blocks: runs of text between block-level tags, scripts,
styles, comments and the head left out. Each block has a vector of its tag path (hashed tags, classes
and ids of its ancestors), one of its words (the mean of a fixed random vector for each word's hash) and
a few counts. A bidirectional LSTM in numpy
reads the whole sequence in both directions and labels every block as main text or not.

The network is trained on PAGES pages that rules make here, in many layouts, with menus, headers,
footers, sidebars, notices, adverts, forms and reader comments of known place; nothing is learned from
the table. Pages are read whole, blocks are neither dropped nor shortened but by their label. A head
ends with the first tag that may not stand in one, and an element that shows no text (svg, canvas ...)
counts as such only if it is closed further on, so broken pages keep their text.

Nulls: a null or empty page has an empty text; a page without blocks too. Rows are independent of each
other: repeated rows repeat their result, an empty table gives an empty one, other columns pass by.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vacantia.llm import common

#: Sizes of the path's and the words' vectors and of each direction's state.
PATH, WORDS, COUNTS, STATE = 48, 12, 8, 20
#: Pages that teach, passes over them, and pages that are labelled together.
PAGES, EPOCHS, RATE, SEED, TOGETHER = 1400, 9, 0.01, 23, 64
#: Bytes of pages at once; blocks that are labelled together (a longer page alone) and steps that are prepared.
SHARD_BYTES, BLOCKS, STEPS = 2 << 20, 1 << 14, 1 << 12

_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
_SILENT = frozenset("script style noscript template head title svg math object iframe canvas audio video".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An opening tag of the first kind ends an open element of the second kinds.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}, "body": {"head"}}
#: What may stand in a head, and what shows no text even where it isn't closed.
_IN_HEAD = frozenset("html head title meta link base script style noscript template".split())
_OPEN_SILENT = frozenset("script style head title".split())
#: Shapes of a drawing: they hold neither text nor structure.
_SHAPES = frozenset("path circle ellipse rect line polygon polyline g use defs symbol".split())
_CLOSERS = re.compile(r"</([a-z]+)", re.I)
_BOUNDS = frozenset("table ul ol dl select body html article section div main aside nav header footer form".split())


class Blocks(HTMLParser):
    """The leaf blocks of a page: (vector of the tag path, its length, text, characters in links).

    Linear in the page, however broken: what follows the last > holds no tag and is text; an end that was
    looked for once in vain (of a comment, of a marked section) is not looked for again; and where open
    elements of a name are is kept, so that none is searched for.
    """

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        #: Open elements with the sum of their own and their ancestors' vectors, and how many those are.
        self.stack: list[tuple[str, np.ndarray, int]] = []
        #: Places of the open elements by name, of those that bound others, and of those that are not inline.
        self.open: dict[str, list[int]] = defaultdict(list)
        self.bounds: list[int] = []
        self.outer: list[int] = []
        self.ends = Counter(t.lower() for t in _CLOSERS.findall(html))
        self.found: list[tuple[np.ndarray, int, str, int]] = []
        self.text: list[str] = []
        self.linked = self.links = self.silent = 0
        self.in_vain: set[str] = set()
        end = html.rfind(">") + 1
        self.rawdata = html[:end]
        self.close()
        if end < len(html):
            self.handle_data(unescape(html[end:]))
        self.flush()

    def parse_comment(self, i, report=1):
        if "comment" in self.in_vain:
            return -1
        end = super().parse_comment(i, report)
        if end < 0:
            self.in_vain.add("comment")
        return end

    def parse_marked_section(self, i, report=1):
        kind = "condition" if self.rawdata[i + 3 : i + 8].lower().startswith(("if", "else", "endif")) else "section"
        if kind in self.in_vain:
            return -1
        try:
            end = super().parse_marked_section(i, report)
        except AssertionError:  # no section that there is
            return self.parse_bogus_comment(i)
        if end < 0:
            self.in_vain.add(kind)
        return end

    def flush(self) -> None:
        if self.text:
            words = " ".join("".join(self.text).split())
            if words:
                _, path, n = self.stack[-1] if self.stack else ("", _NOWHERE, 0)
                self.found.append((path, n, words, self.linked))
        self.text, self.linked = [], 0

    def handle_starttag(self, tag, attrs):
        if tag not in _INLINE:
            self.flush()
            if self.open["head"] and tag not in _IN_HEAD:
                self._pop(self.open["head"][0])
            at = max((self.open[c][-1] for c in _CLOSES.get(tag, {"p"}) if self.open[c]), default=-1)
            if at >= 0 and (not self.bounds or at >= self.bounds[-1]):
                self._pop(at)
        elif tag in ("br", "wbr", "img"):
            self.text.append(" ")
        if tag in _VOID:
            return
        own = [tag]
        for name, value in attrs:
            if value and name in ("class", "id", "role"):
                own += [f"{name[0]}.{v}" for v in value.lower().replace("-", " ").replace("_", " ").split()]
        if tag in _SHAPES or (tag in _SILENT and tag not in _OPEN_SILENT and self.ends[tag] <= 0):
            return
        _, path, n = self.stack[-1] if self.stack else ("", _NOWHERE, 0)
        self.open[tag].append(len(self.stack))
        if tag in _BOUNDS:
            self.bounds.append(len(self.stack))
        if tag not in _INLINE:
            self.outer.append(len(self.stack))
        self.stack.append((tag, path + _own_vector(tuple(own)), n + len(own)))
        self.links += tag == "a"
        self.silent += tag in _SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.handle_endtag(tag)

    def _pop(self, at: int) -> None:
        for tag, _, _ in self.stack[at:]:
            self.open[tag].pop()
            self.links -= tag == "a"
            self.silent -= tag in _SILENT
        for places in (self.bounds, self.outer):
            while places and places[-1] >= at:
                places.pop()
        del self.stack[at:]

    def handle_endtag(self, tag):
        self.ends[tag] -= 1
        if tag not in _INLINE:
            self.flush()
        if not self.open[tag]:
            return
        at = self.open[tag][-1]
        if tag not in _INLINE or not self.outer or self.outer[-1] <= at:
            self._pop(at)

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)
            if self.links:
                self.linked += len(data)


def blocks(html: str) -> list[tuple[np.ndarray, int, str, int]]:
    return Blocks(html).found


@functools.lru_cache(maxsize=1 << 16)
def _hashed(token: str, size: int) -> np.ndarray:
    """A fixed random direction for a token."""
    return np.random.default_rng(zlib.crc32(token.encode("utf-8", "surrogatepass"))).choice(np.array([-1.0, 1.0], np.float32), size) / np.float32(np.sqrt(size) / 2)


@functools.lru_cache(maxsize=1 << 12)
def _own_vector(own: tuple[str, ...]) -> np.ndarray:
    return sum((_hashed(token, PATH) for token in own), np.zeros(PATH, np.float32))


_NOWHERE = np.zeros(PATH, np.float32)
_WORD_TABLE = np.random.default_rng(7).normal(0, 1, (1 << 13, WORDS)).astype(np.float32)


def features(found: list[tuple[np.ndarray, int, str, int]]) -> np.ndarray:
    out = np.zeros((len(found), PATH + WORDS + COUNTS), np.float32)
    for i, (path, depth, text, linked) in enumerate(found):
        words = text.split(" ")
        out[i, :PATH] = path
        ids = np.fromiter((zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) for w in words), np.int64, len(words)) % len(_WORD_TABLE)
        out[i, PATH : PATH + WORDS] = _WORD_TABLE[ids].mean(0)
        n = len(text)
        ends = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?…")
        out[i, PATH + WORDS :] = (np.log1p(n) / 5, np.log1p(len(words)) / 4, linked / n, min(ends, 4) / 4, i / len(found), 1 / (1 + i), text[0].isupper(), min(depth, 64) / 8)
    return out


class Labeller:
    """A bidirectional LSTM with one logit per block."""

    def __init__(self, rng: np.random.Generator):
        n = PATH + WORDS + COUNTS
        init = lambda *s: rng.normal(0, s[0] ** -0.5, s).astype(np.float32)
        self.p = {"o": init(2 * STATE, 1), "ob": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": init(n, 4 * STATE), f"h{d}": init(STATE, 4 * STATE), f"b{d}": np.repeat(np.array([0, 1, 0, 0], np.float32), STATE)}

    def _run(self, x, mask, d):
        """x: steps, pages, features. States stay as they are where a page has no block."""
        steps, n = x.shape[:2]
        z = x @ self.p[f"x{d}"] + self.p[f"b{d}"]
        h = c = np.zeros((n, STATE), np.float32)
        trace, hs = [], np.zeros((steps, n, STATE), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = z[t] + h @ self.p[f"h{d}"]
            s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * STATE], -30, 30)))
            i, f, o, g = s[:, :STATE], s[:, STATE : 2 * STATE], s[:, 2 * STATE :], np.tanh(a[:, 3 * STATE :])
            m = mask[t][:, None]
            new = f * c + i * g
            tc = np.tanh(new)
            trace.append((t, h, c, i, f, o, g, tc, m))
            c = m * new + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            hs[t] = h
        return hs, trace

    def logits(self, x, mask):
        runs = {d: self._run(x, mask, d) for d in "fb"}
        hs = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        return (hs @ self.p["o"] + self.p["ob"])[:, :, 0], hs, runs

    def labels(self, x, mask) -> np.ndarray:
        """Logits without what learning needs: STEPS steps are prepared at a time, and only the state is kept."""
        steps, n = x.shape[:2]
        out = np.full((steps, n), self.p["ob"][0], np.float32)
        for at, d in enumerate("fb"):
            h = c = np.zeros((n, STATE), np.float32)
            begins = range(0, steps, STEPS)
            for begin in begins if d == "f" else reversed(begins):
                part = slice(begin, begin + STEPS)
                z, m = x[part] @ self.p[f"x{d}"] + self.p[f"b{d}"], mask[part][:, :, None]
                hs = np.zeros((len(z), n, STATE), np.float32)
                for t in range(len(z)) if d == "f" else range(len(z) - 1, -1, -1):
                    a = z[t] + h @ self.p[f"h{d}"]
                    s = 1 / (1 + np.exp(-np.clip(a[:, : 3 * STATE], -30, 30)))
                    new = s[:, STATE : 2 * STATE] * c + s[:, :STATE] * np.tanh(a[:, 3 * STATE :])
                    c = m[t] * new + (1 - m[t]) * c
                    h = m[t] * (s[:, 2 * STATE :] * np.tanh(new)) + (1 - m[t]) * h
                    hs[t] = h
                out[part] += (hs @ self.p["o"][at * STATE : (at + 1) * STATE])[:, :, 0]
        return out

    def gradient(self, x, mask, labels):
        logit, hs, runs = self.logits(x, mask)
        d = (((1 / (1 + np.exp(-np.clip(logit, -30, 30)))) - labels) * mask / mask.sum())[:, :, None]
        g = {"o": np.einsum("tnk,tnj->kj", hs, d), "ob": d.sum((0, 1))}
        dhs = d @ self.p["o"].T
        for at, k in enumerate("fb"):
            w, dx = self.p[f"h{k}"], np.zeros((*x.shape[:2], 4 * STATE), np.float32)
            gh = np.zeros_like(w)
            dh = dc = np.zeros((x.shape[1], STATE), np.float32)
            for t, h, c, i, f, o, gate, tc, m in reversed(runs[k][1]):
                dh = dh + dhs[t, :, at * STATE : (at + 1) * STATE]
                do, dnew = dh * m * tc, dc * m + dh * m * o * (1 - tc * tc)
                da = np.concatenate([dnew * gate * i * (1 - i), dnew * c * f * (1 - f), do * o * (1 - o), dnew * i * (1 - gate * gate)], axis=1)
                dx[t] = da
                gh += h.T @ da
                dc = dnew * f + dc * (1 - m)
                dh = da @ w.T + dh * (1 - m)
            g |= {f"x{k}": np.einsum("tnf,tnk->fk", x, dx), f"h{k}": gh, f"b{k}": dx.sum((0, 1))}
        return g


def _batch(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((max(map(len, pages)), len(pages), PATH + WORDS + COUNTS), np.float32)
    mask = np.zeros(x.shape[:2], np.float32)
    for i, page in enumerate(pages):
        x[: len(page), i], mask[: len(page), i] = page, 1
    return x, mask


def layouts(rng: np.random.Generator) -> tuple[str, list[int]]:
    """A made-up page and the labels of its blocks."""
    pick = lambda options: str(rng.choice(options))
    syllables = "th er on an re he in ed nd ha at en es of ment tion eau que ch ung keit ver los ar pa vi le sch".split()
    word = lambda: "".join(rng.choice(syllables, rng.integers(1, 5)))
    phrase = lambda a, b: " ".join(word() for _ in range(rng.integers(a, b)))
    prose = lambda a, b: " ".join(f"{phrase(4, 14).capitalize()}{pick(['.', '.', '.', '?', '!'])}" for _ in range(rng.integers(a, b)))
    html, labels = [], []

    def block(tag: str, text: str, label: int, attrs: str = "", close: bool = True) -> None:
        html.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if close else ""))
        labels.append(label)

    def attr(names: str) -> str:
        kind = rng.integers(3)
        return "" if kind == 0 else f' {"class" if kind == 1 else "id"}="{pick(names.split())}"'

    def links(n: int, tag: str = "li") -> None:
        for _ in range(n):
            block(tag, f'<a href="/{word()}">{phrase(1, 4)}</a>', 0)

    def menu() -> None:
        tag, names = [("nav", "menu nav main-menu"), ("div", "menu nav navbar topnav"), ("ul", "menu nav navigation")][rng.integers(3)]
        html.append(f"<{tag}{attr(names) if tag == 'nav' else f' class="{pick(names.split())}"'}>" + ("<ul>" if tag != "ul" else ""))
        links(int(rng.integers(2, 9)))
        html.append(("</ul>" if tag != "ul" else "") + f"</{tag}>")

    def box(tags: str, names: str, fill, always: bool = True) -> None:
        tag = pick(tags.split())
        # Elements that say what they are may go without a class; a div may not.
        html.append(f"<{tag}{f' {pick(['class', 'id'])}="{pick(names.split())}"' if tag in ('div', 'section', 'ul', 'p') or rng.random() < 0.5 else ''}>")
        fill()
        html.append(f"</{tag}>")

    def some(label: int, n: int, tags: str, a: int, b: int):
        def fill() -> None:
            for _ in range(rng.integers(1, n + 1)):
                block(pick(tags.split()), prose(a, b) if rng.random() < 0.7 else phrase(2, 9), label)

        return fill

    def bare(label: int):
        def fill() -> None:
            html.append(prose(1, 3) if rng.random() < 0.6 else phrase(2, 12))
            labels.append(label)

        return fill

    def head() -> None:
        def fill() -> None:
            block(pick(["div", "p", "span", "h1", "h2"]), phrase(1, 5), 0) if rng.random() < 0.7 else menu()
            if html[-1].startswith("<span"):
                html.append("<hr>")
            if rng.random() < 0.4:
                links(int(rng.integers(1, 4)), "div")

        box("header header div", "header site-header top masthead", fill)

    def foot() -> None:
        fill = bare(0) if rng.random() < 0.6 else some(0, 3, "p div li", 1, 3)
        box("footer footer div", "footer site-footer bottom copyright", fill)

    def side() -> None:
        box("aside aside div", "sidebar side widget related aside", some(0, 4, "p li h3 div", 1, 4))

    def notice() -> None:
        box("div div section p", "notice cookie cookies banner alert consent gdpr cookie-notice", bare(0))

    def advert() -> None:
        box("div div section aside", "ad ads advert advertisement sponsored promo adbox", bare(0) if rng.random() < 0.7 else some(0, 2, "p div", 1, 3))

    def form() -> None:
        def fill() -> None:
            for _ in range(rng.integers(1, 4)):
                block(pick(["p", "div", "button", "legend", "option"]), phrase(1, 6), 0)

        box("form", "search login subscribe newsletter contact", fill)

    def comments() -> None:
        def fill() -> None:
            if rng.random() < 0.6:
                block(pick(["h2", "h3", "h4"]), phrase(1, 3), 0)
            for _ in range(rng.integers(1, 6)):
                tag = pick(["div", "li", "p", "article"])
                if tag == "p":
                    block("p", prose(1, 4), 0)
                else:
                    html.append(f'<{tag} class="{pick(["comment", "reply", "comment-body", "post-comment"])}">')
                    some(0, 2, "p p div", 1, 4)()
                    html.append(f"</{tag}>")

        box("section div div ol", "comments comment-list responses discussion reader-comments", fill)

    def extra() -> None:
        pick_one = [side, notice, advert, form, comments, advert, lambda: box("div", "share social tags breadcrumb pagination related", lambda: links(3, "li"))]
        pick_one[rng.integers(len(pick_one))]()

    def main() -> None:
        tag = pick(["article", "article", "main", "div", "section"])
        names = "content article post entry story main text body article-body entry-content post-content"
        html.append(f"<{tag}{attr(names) if tag in ('article', 'main') else f' class="{pick(names.split())}"'}>")
        title = phrase(2, 10).capitalize()
        if rng.random() < 0.85:
            wrap = rng.random() < 0.15
            html.append("<header>" if wrap else "")
            block("h1", title, 1)
            html.append("</header>" if wrap else "")
        inner = rng.random() < 0.2
        html.append(f'<div class="{pick(["text", "body", "inner", "entry-content"])}">' if inner else "")
        for _ in range(rng.integers(1, 22)):
            kind = rng.random()
            if kind < 0.55:
                block("p", prose(1, 7), 1, close=rng.random() < 0.9)
            elif kind < 0.7:
                block("p", phrase(1, 4).capitalize() + pick([".", ".", "", ","]), 1, close=rng.random() < 0.9)
            elif kind < 0.78:
                html.append("<p><b>" + prose(1, 2) + "<br>")
                labels.append(1)
            elif kind < 0.84:
                block(pick(["h2", "h3"]), phrase(1, 6), 1)
            elif kind < 0.9:
                html.append("<ul>")
                for _ in range(rng.integers(1, 5)):
                    block("li", phrase(2, 12), 1)
                html.append("</ul>")
            elif kind < 0.94:
                block(pick(["blockquote", "pre", "td", "figcaption"]), prose(1, 3), 1)
            elif kind < 0.97:
                block("p", f'{phrase(3, 9)} <a href="/">{phrase(1, 4)}</a> {prose(1, 2)}', 1)
            else:
                extra()
        html.append("</div>" if inner else "")
        if rng.random() < 0.1:
            extra()
        html.append(f"</{tag}>")

    html.append(f"<!DOCTYPE html><html><head><title>{phrase(2, 6)}</title><style>p{{}}</style></head><body>")
    depth = int(rng.integers(0, 3))
    html.extend(f'<div class="{pick(["wrap", "container", "page", "row", "site"])}">' for _ in range(depth))
    for part, chance in ((notice, 0.15), (head, 0.4), (menu, 0.7), (advert, 0.4), (form, 0.1), (side, 0.2)):
        if rng.random() < chance:
            part()
    if rng.random() < 0.97:
        main()
    for part, chance in ((side, 0.3), (comments, 0.35), (advert, 0.2), (form, 0.2), (notice, 0.15), (foot, 0.8)):
        if rng.random() < chance:
            part()
    html.extend("</div>" for _ in range(depth))
    if rng.random() < 0.9:
        html.append("</body></html>")
    return "".join(html), labels


@functools.lru_cache(maxsize=1)
def trained() -> Labeller:
    rng = np.random.default_rng(SEED)
    pages = []
    while len(pages) < PAGES:
        html, labels = layouts(rng)
        found = blocks(html)
        if found and len(found) == len(labels):
            pages.append((features(found), np.array(labels, np.float32)))
    net, m, step = Labeller(rng), {}, 0
    for epoch in range(EPOCHS):
        order = sorted(rng.permutation(PAGES).tolist(), key=lambda i: len(pages[i][1]) // 8)
        batches = [order[i : i + 16] for i in range(0, PAGES, 16)]
        for k in rng.permutation(len(batches)).tolist():
            x, mask = _batch([pages[i][0] for i in batches[k]])
            y = np.zeros_like(mask)
            for j, i in enumerate(batches[k]):
                y[: len(pages[i][1]), j] = pages[i][1]
            step += 1
            for name, g in net.gradient(x, mask, y).items():
                a, b = m.get(name, (0.0, 0.0))
                a, b = 0.9 * a + 0.1 * g, 0.999 * b + 0.001 * g * g
                m[name] = (a, b)
                net.p[name] = net.p[name] - (RATE * 0.75**epoch) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return net


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    found = [blocks(p) for p in pages]
    out = ["" for _ in pages]
    order = sorted((i for i, f in enumerate(found) if f), key=lambda i: len(found[i]))
    parts: list[list[int]] = []
    for i in order:  # pages of about one length; padded, a part holds no more than BLOCKS blocks or one page
        if not parts or len(parts[-1]) == TOGETHER or len(found[i]) * (len(parts[-1]) + 1) > BLOCKS:
            parts.append([])
        parts[-1].append(i)
    for part in parts:
        logit = net.labels(*_batch([features(found[i]) for i in part]))
        for j, i in enumerate(part):
            out[i] = "\n\n".join(text for (_, _, text, _), score in zip(found[i], logit[: len(found[i]), j].tolist(), strict=True) if score > 0)
    return out


def extract(pages: DataFrame, html="html", keep: list[str] | None = None) -> DataFrame:
    """The columns in `keep` (all but html) with text and n_chars of each page's main text."""
    common.bounded_batches(pages.sparkSession)
    net = trained()
    keep = [c for c in pages.columns if c != html] if keep is None else keep
    rows = pages.select(*keep, F.col(html).alias("__html"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in common.shards(batches, len(keep), SHARD_BYTES):
            texts = main_texts([h or "" for h in shard.column(len(keep)).to_pylist()], net)
            columns = [*(shard.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield from pa.table(columns, names=[*keep, "text", "n_chars"]).to_batches()

    schema = T.StructType([*rows.select(*keep).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return rows.mapInArrow(task, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """Main text of every page, by the contract of op5."""
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"), keep=["page_id", "url"])
