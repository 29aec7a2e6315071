"""HTML extraction with a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags, with the path of open
elements above. Each block becomes a vector of its hashed path (tags, classes, ids), its hashed words
and a few numbers; a bidirectional LSTM in numpy reads a page's whole sequence, so a block is judged
in the context of all others, and labels each block as main text or not. The blocks labelled main
are the page's text.

The model is trained where it is used, on the driver, in seconds: on TRAINING_PAGES pages that
synthetic_page() writes from random layouts with the label of every block known, a fixed number
whatever the size of the input. It has some thousand weights, which travel with the tasks.

Rules of parsing: character references are decoded; white space within a block is one space;
comments, scripts, styles and templates have no text; <br> is white space; end tags that HTML lets
authors leave out are implied.

Edge cases: a null or empty page has empty text; a page without any tag is its own main text; a tag that
never ends is text from its "<"; pages of any length, however broken, take time in proportion to it; pages are labelled each on its own, so repeated rows give equal
results; an empty table gives an empty result.
"""

from __future__ import annotations

import html as references
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_pass, blocks, texts_of

# ---- blocks ------------------------------------------------------------------------------------

#: Fixed values from the HTML standard: elements whose tags don't break a text, that have no end tag, and whose content is no text.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math iframe object".split())
#: An element that starts ends an open one of these, up to the container that bounds the search.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Block-level elements that end an open paragraph.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: A tag's inside ends at a "<" outside quotes too, and its parts are taken whole, so that a failed match reads no character twice.
_TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>""")
#: Elements open at once; those further down aren't kept in paths, as in browsers.
MOST_OPEN = 256
_ENDS = {name: re.compile(rf"</{name}\s*+>", re.I) for name in SILENT}
_NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
_PARTS = re.compile(r"[A-Za-z]+")


class Block:
    """A leaf: its path of elements (each a tuple of its tag and name parts), its text and how much of it is links."""

    __slots__ = ("linked", "path", "text")

    def __init__(self, path: tuple, text: str, linked: int):
        self.path, self.text, self.linked = path, text, linked


def page_blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in its order, without those that have no text."""
    out: list[Block] = []
    tags: list[str] = []
    opened: Counter[str] = Counter()
    path: list[tuple] = []
    parts: list[str] = []
    linked = anchors = at = 0

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            raw = "".join(parts)
            text = " ".join((references.unescape(raw) if "&" in raw else raw).split())
            if text:
                out.append(Block(tuple(path), text, linked))
            parts = []
        linked = 0

    def close(name: str) -> None:
        while tags:
            top = tags.pop()
            path.pop()
            opened[top] -= 1
            if top == name:
                return

    def text(stop: int) -> None:
        nonlocal at, linked
        if stop > at:
            parts.append(page[at:stop])
            linked += (stop - at) * (anchors > 0)
        at = stop

    end, last, sought = len(page), page.rfind(">"), 0
    while at < end:
        start = page.find("<", sought)
        if start < 0 or start > last:
            # Comments alone may end without a ">".
            start = page.find("<!--", max(sought, start)) if start >= 0 else -1
            text(start if start >= 0 else end)
            break
        if page.startswith("<!--", start):
            text(start)
            close_at = page.find("-->", start + 4)
            at = sought = close_at + 3 if close_at >= 0 else end
            continue
        if page[start + 1 : start + 2] in ("!", "?"):
            text(start)
            at = sought = page.find(">", start) + 1
            continue
        m = _TAG.match(page, start)
        if not m:
            sought = start + 1
            continue
        text(start)
        at = sought = m.end()
        name = m.group(2).lower()
        if name in INLINE:
            if name == "a":
                anchors = max(0, anchors + (-1 if m.group(1) else 1))
            elif name == "br":
                parts.append(" ")
            continue
        if name in SILENT and not m.group(1):
            if m.group(3).endswith("/"):
                continue
            done = _ENDS[name].search(page, at)
            at = sought = done.end() if done else end
            continue
        flush()
        anchors = 0
        if m.group(1):
            if opened[name]:
                close(name)
            continue
        if name in ENDS_P and opened["p"]:
            close("p")
        if name in IMPLIED:
            ends, bounds = IMPLIED[name]
            for depth in range(len(tags) - 1, -1, -1):
                if tags[depth] in bounds:
                    break
                if tags[depth] in ends:
                    opened.subtract(tags[depth:])
                    del tags[depth:], path[depth:]
                    break
        if name in VOID or m.group(3).endswith("/") or len(tags) >= MOST_OPEN:
            continue
        words = [w.lower() for x in _NAMES.finditer(m.group(3)) for w in _PARTS.findall(x.group(2) or x.group(3) or x.group(4) or "")] if m.group(3) else ()
        tags.append(name)
        opened[name] += 1
        path.append((name, *words))
    flush()
    return out


# ---- vectors -----------------------------------------------------------------------------------

PATH_SIZE, WORD_SIZE, NUMBERS = 128, 32, 8
SIZE = 2 * PATH_SIZE + WORD_SIZE + NUMBERS


def _slot(text: str, size: int) -> int:
    return zlib.crc32(text.encode("utf-8", "replace")) % size


def path_vector(path: tuple) -> np.ndarray:
    """Hashed tags and name parts: of the whole path, and of the innermost element."""
    out = np.zeros(2 * PATH_SIZE, dtype=np.float32)
    for element in path:
        for i, part in enumerate(element):
            out[_slot(f"{'.' if i else ''}{part}", PATH_SIZE)] = 1
    for i, part in enumerate(path[-1] if path else ("",)):
        out[PATH_SIZE + _slot(f"{'.' if i else ''}{part}", PATH_SIZE)] = 1
    return out


def page_vectors(page: list[Block], paths: dict[tuple, np.ndarray]) -> np.ndarray:
    """A vector for each block. paths keeps the vectors of paths."""
    out = np.zeros((len(page), SIZE), dtype=np.float32)
    for i, block in enumerate(page):
        known = paths.get(block.path)
        if known is None:
            if len(paths) > 20_000:
                paths.clear()
            known = paths[block.path] = path_vector(block.path)
        out[i, : 2 * PATH_SIZE] = known
        words = block.text.lower().encode("utf-8", "replace").split()
        slots = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % WORD_SIZE
        out[i, 2 * PATH_SIZE : -NUMBERS] = np.bincount(slots, minlength=WORD_SIZE) / (1 + len(words))
        size = len(block.text)
        stops = sum(block.text.count(x) for x in ".,;:!?")
        out[i, -NUMBERS:] = (
            np.log1p(len(words)) / 5, min(1.0, block.linked / size), min(1.0, 5 * stops / size), block.text[-1] in ".!?", len(words) < 4,
            i / len(page), len(path_depth := block.path) / 10, len(path_depth) < 3,
        )
    return out


# ---- the labeller ------------------------------------------------------------------------------

HIDDEN = 12


class Labeller:
    """A bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.w: dict[str, np.ndarray] = {"o": rng.normal(0, 0.3, (2 * HIDDEN, 1)), "c": np.zeros(1)}
        for way in "fb":
            self.w[f"x{way}"] = rng.normal(0, 0.1, (SIZE, 4 * HIDDEN))
            self.w[f"h{way}"] = rng.normal(0, 0.2, (HIDDEN, 4 * HIDDEN))
            self.w[f"v{way}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])  # the forget gate starts open
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @staticmethod
    def _gates(z: np.ndarray) -> tuple[np.ndarray, ...]:
        s = 1 / (1 + np.exp(-np.clip(z[:, : 3 * HIDDEN], -30, 30)))
        return s[:, :HIDDEN], s[:, HIDDEN : 2 * HIDDEN], s[:, 2 * HIDDEN :], np.tanh(z[:, 3 * HIDDEN :])

    def _run(self, way: str, x: np.ndarray, mask: np.ndarray, keep: list | None) -> np.ndarray:
        """Hidden states (pages, blocks, HIDDEN) of one direction; x is projected already, time runs forwards."""
        n, steps, _ = x.shape
        h = c = np.zeros((n, HIDDEN), dtype=np.float32)
        out = np.zeros((n, steps, HIDDEN), dtype=np.float32)
        for t in range(steps):
            i, f, o, g = self._gates(x[:, t] + h @ self.w[f"h{way}"])
            m = mask[:, t, None]
            new = f * c + i * g
            tanh = np.tanh(new)
            if keep is not None:
                keep.append((h, c, i, f, o, g, tanh, m))
            h, c = m * (o * tanh) + (1 - m) * h, m * new + (1 - m) * c
            out[:, t] = h
        return out

    def scores(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Log odds of main text (pages, blocks). x: (pages, blocks, SIZE), blocks from 0; mask: 1 where there is a block."""
        states = {}
        for way in "fb":
            z = x.reshape(-1, SIZE) @ self.w[f"x{way}"] + self.w[f"v{way}"]
            z, m = z.reshape(*x.shape[:2], -1), mask
            if way == "b":
                z, m = z[:, ::-1], m[:, ::-1]
            kept: list | None = None if keep is None else []
            h = self._run(way, z, m, kept)
            states[way] = h if way == "f" else h[:, ::-1]
            if keep is not None:
                keep[way] = kept
        both = np.concatenate([states["f"], states["b"]], axis=2)
        if keep is not None:
            keep["both"] = both
        return (both @ self.w["o"])[:, :, 0] + self.w["c"]

    def gradients(self, x: np.ndarray, mask: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        odds = self.scores(x, mask, keep)
        error = ((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - labels) * mask / mask.sum()).astype(np.float32)
        both = keep["both"]
        out = {"o": both.reshape(-1, 2 * HIDDEN).T @ error.reshape(-1, 1), "c": error.sum(keepdims=True)[0]}
        down = error[:, :, None] * self.w["o"][:, 0]
        for k, way in enumerate("fb"):
            own = down[:, :, k * HIDDEN : (k + 1) * HIDDEN]
            own, xs = (own, x) if way == "f" else (own[:, ::-1], x[:, ::-1])
            dz = np.zeros((*x.shape[:2], 4 * HIDDEN), dtype=np.float32)
            hidden = np.zeros((*x.shape[:2], HIDDEN), dtype=np.float32)
            dh = dc = np.zeros((len(x), HIDDEN), dtype=np.float32)
            for t in range(x.shape[1] - 1, -1, -1):
                h, c, i, f, o, g, tanh, m = keep[way][t]
                dh = dh + own[:, t]
                through = dc * m + dh * m * o * (1 - tanh**2)
                step = np.concatenate([through * g * i * (1 - i), through * c * f * (1 - f), dh * m * tanh * o * (1 - o), through * i * (1 - g**2)], axis=1)
                dz[:, t], hidden[:, t] = step, h
                dh, dc = step @ self.w[f"h{way}"].T + dh * (1 - m), through * f + dc * (1 - m)
            flat = dz.reshape(-1, 4 * HIDDEN)
            out[f"x{way}"] = np.ascontiguousarray(xs).reshape(-1, SIZE).T @ flat
            out[f"h{way}"] = hidden.reshape(-1, HIDDEN).T @ flat
            out[f"v{way}"] = flat.sum(axis=0)
        return out

    def main_blocks(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """For each page which of its blocks are main text. Pages of like lengths are read together."""
        out: list[np.ndarray] = [np.zeros(0, dtype=bool)] * len(pages)
        order = [i for i in sorted(range(len(pages)), key=lambda i: len(pages[i])) if len(pages[i])]
        at = 0
        while at < len(order):
            end, steps = at, len(pages[order[at]])
            while end < len(order) and end - at < 256 and len(pages[order[end]]) <= max(steps + 4, steps * 5 // 4):
                end += 1
            x, mask = padded([pages[i] for i in order[at:end]])
            odds = self.scores(x, mask)
            for row, i in enumerate(order[at:end]):
                out[i] = odds[row, : len(pages[i])] > 0
            at = end
        return out


def padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(pages), max(map(len, pages)), SIZE), dtype=np.float32)
    mask = np.zeros(x.shape[:2], dtype=np.float32)
    for i, page in enumerate(pages):
        x[i, : len(page)], mask[i, : len(page)] = page, 1
    return x, mask


# ---- training ----------------------------------------------------------------------------------

TRAINING_PAGES, EPOCHS, BATCH, RATE = 600, 16, 60, 0.03

#: How the parts of a page are marked up in the layouts that are trained on.
MAIN = ('<article>', '<main>', '<main><article>', '<div class="content">', '<div id="content">', '<div class="post-body">', '<section class="story">', '<article class="post">', '<div class="entry-content">', '<div class="article-text">', '<body-text>')
MENUS = ('<nav><ul>', '<ul class="menu">', '<div class="nav"><ul>', '<div id="navigation"><ul>', '<div role="navigation"><ul>', '<nav class="breadcrumb"><ul>', '<div class="breadcrumbs"><ul>', '<ul class="pagination">', '<ul class="tags">')
HEADS = ('<header>', '<div class="header">', '<div id="masthead">', '<div class="site-header">', '<header class="top">')
FOOTS = ('<footer>', '<div class="footer">', '<div id="footer">', '<div class="copyright">', '<footer class="site-footer">')
SIDES = ('<aside>', '<div class="sidebar">', '<div id="sidebar">', '<div class="related">', '<section class="related-posts">', '<div class="widget">', '<aside class="recommended">')
NOTICES = ('<div class="cookie">', '<div class="cookie-notice">', '<div class="banner">', '<div id="consent">', '<div class="notice">', '<div class="alert">', '<div role="alert">', '<div class="popup">', '<div class="modal">', '<div class="newsletter">', '<div class="share">', '<div class="social-links">')
ADVERTS = ('<div class="ad">', '<div class="ads">', '<div id="ad-top">', '<div class="advert">', '<div class="advertisement">', '<div class="sponsored">', '<div class="promo">', '<section class="sponsor">')
FORMS = ('<form>', '<form class="search">', '<form id="subscribe">', '<div class="login"><form>')
COMMENTS = ('<section class="comments">', '<div id="comments">', '<div class="comment">', '<ol class="comment-list">', '<div class="responses">', '<section id="disqus-thread">', '<div class="reader-comments">')


class _Writer:
    """A page as it is written: its HTML, and the label of each text that will be a block."""

    def __init__(self, rng: random.Random):
        self.rng, self.html, self.labels = rng, [], []

    def one(self, of: tuple | list) -> str:
        return self.rng.choice(of)

    def often(self, chance: float) -> bool:
        return self.rng.random() < chance

    def words(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        text = " ".join(self.rng.choices(_vocabulary(), k=n)).capitalize()
        noise = self.rng.random()
        if noise < 0.1:
            text = " &amp; ".join(text.split(" "))
        elif noise < 0.2:
            text = " | ".join(text.split(" "))
        elif noise < 0.3:
            text = text.upper().replace(" ", "!! ")
        return text + (self.one((".", ".", ".", "!", "?", ",", "")) if n > 3 else "")

    def text(self, tag: str, main: bool, low: int, high: int, close: bool = True) -> None:
        inner = self.words(low, high)
        if self.often(0.15):
            inner = f"<b>{inner}" + ("</b>" if self.often(0.5) else "<br>")
        if not main and self.often(0.4):
            inner = f'<a href="/x">{inner}</a>'
        self.html.append(f"<{tag}>{inner}" + (f"</{tag}>" if close else ""))
        self.labels.append(main)

    def inside(self, opening: str, fill) -> None:
        tags = re.findall(r"<([a-z-]+)", opening)
        self.html.append(opening)
        fill()
        self.html.append("".join(f"</{t}>" for t in reversed(tags)))

    def bare(self, main: bool, low: int, high: int) -> None:
        self.html.append(self.words(low, high))
        self.labels.append(main)

    def boilerplate(self, kind: int) -> None:
        rng, n = self.rng, self.rng.randrange(1, 7)
        if kind == 0:
            self.inside(self.one(MENUS), lambda: [self.text("li", False, 1, 3, self.often(0.8)) for _ in range(n)])
            return
        where = self.one((HEADS, FOOTS, SIDES, NOTICES, ADVERTS, FORMS, COMMENTS)[kind - 1])
        if kind == 6:
            self.inside(where, lambda: [self.text(self.one(("label", "p", "button", "div")) if i else "div", False, 1, 6) for i in range(1 + n // 3)])
        elif kind == 7:
            item = "li" if where.startswith("<ol") else self.one(("div", "p", 'div class="comment"'.split()[0]))
            self.inside(where, lambda: [self.text(item, False, 3, 60) for _ in range(n)])
        elif rng.random() < 0.6:
            self.inside(where, lambda: self.bare(False, 2, 25))
        else:
            self.inside(where, lambda: [self.text(self.one(("p", "h3", "h4", "div", "p")), False, 1, 25) for _ in range(1 + n // 2)])

    def article(self) -> None:
        if self.often(0.85):
            if self.often(0.2):
                self.inside("<header>", lambda: self.text("h1", True, 2, 14))
            else:
                self.text(self.one(("h1", "h1", "h2")), True, 2, 14)
        for _ in range(self.rng.randrange(1, 16)):
            kind = self.rng.random()
            if kind < 0.72:
                self.text("p", True, 1, 120, self.often(0.8))
            elif kind < 0.82:
                self.text(self.one(("h2", "h3", "h4")), True, 1, 9)
            elif kind < 0.88:
                self.inside(self.one(("<ul>", "<ol>")), lambda: [self.text("li", True, 2, 20) for _ in range(3)])
            elif kind < 0.92:
                self.inside("<blockquote>", lambda: self.text("p", True, 5, 40))
            elif kind < 0.95:
                self.text(self.one(("pre", "figcaption", "td", "div")), True, 2, 30)
            else:
                self.boilerplate(self.one((3, 4, 5, 5, 6)))


_SYLLABLES = ("th", "er", "an", "in", "re", "on", "at", "ti", "es", "or", "le", "ou", "en", "ch", "ai", "ung", "de", "la", "ment", "ción")


@lru_cache(maxsize=1)
def _vocabulary() -> list[str]:
    """Words of one to four syllables."""
    rng = random.Random(3)
    return ["".join(rng.choices(_SYLLABLES, k=rng.randrange(1, 5))) for _ in range(5000)]


def synthetic_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page of a random layout, and whether each of its blocks is main text."""
    page = _Writer(rng)
    page.html.append("<!DOCTYPE html><html><head>")
    page.text("title", False, 2, 14)
    page.labels[-1] = False
    page.html.append('<style>p{margin:0}</style><script>var t="</p>";</script></head><body>')
    wrap = page.often(0.4)
    page.html.append(page.one(('<div class="wrapper">', '<div id="page">', '<div class="container">')) if wrap else "")
    for _ in range(rng.randrange(4)):
        page.boilerplate(page.one((0, 0, 1, 3, 4, 5, 6)))
    layout = rng.random()
    if layout < 0.08:  # columns of a table
        page.html.append("<table><tr><td>")
        page.boilerplate(0)
        page.html.append(page.one(("</td><td>", '</td><td class="main">', "</td></tr><tr><td>")))
        page.article()
        page.html.append("</td></tr></table>")
    elif layout < 0.16:
        page.article()
    else:
        page.inside(page.one(MAIN), page.article)
    for _ in range(rng.randrange(4)):
        page.boilerplate(page.one((0, 2, 2, 3, 4, 5, 6, 7, 7)))
    page.html.append(("</div>" if wrap else "") + ("</body></html>" if page.often(0.8) else ""))
    return "".join(page.html), page.labels


def training_set(seed: int, pages: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    rng, x, y = random.Random(seed), [], []
    paths: dict[tuple, np.ndarray] = {}
    while len(x) < pages:
        text, labels = synthetic_page(rng)
        found = page_blocks(text)
        if len(found) == len(labels):  # layouts that HTML reads otherwise than written are left out
            x.append(page_vectors(found, paths))
            y.append(np.array(labels, dtype=np.float32))
    return x, y


@lru_cache(maxsize=2)
def trained(seed: int = 7, pages: int = TRAINING_PAGES, epochs: int = EPOCHS) -> Labeller:
    """The labeller fitted by Adam; the same for the same arguments."""
    model = Labeller(seed)
    x, y = training_set(seed, pages)
    order = sorted(range(len(x)), key=lambda i: len(x[i]))
    batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
    rng = np.random.default_rng(seed + 1)
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step, total = 0, epochs * len(batches)
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            xs, mask = padded([x[i] for i in batches[b]])
            labels = np.zeros(mask.shape, dtype=np.float32)
            for row, i in enumerate(batches[b]):
                labels[row, : len(y[i])] = y[i]
            step += 1
            rate = RATE * (1 - 0.95 * step / total)
            for k, g in model.gradients(xs, mask, labels).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g**2
                model.w[k] = (model.w[k] - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


# ---- the operator ------------------------------------------------------------------------------


def extract_text(pages: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(page_id, url, text) of each row: the blocks labelled main text, in the page's order, joined by one space."""
    model = model or trained()
    paths: dict[tuple, np.ndarray] = {}

    def work(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        pages, out = texts_of(batch.column(2)), []
        for a, b in blocks([len(x) for x in pages]):
            found = [page_blocks(x) for x in pages[a:b]]
            main = model.main_blocks([page_vectors(x, paths) for x in found])
            for page, labels in zip(found, main, strict=True):
                plain = len(page) == 1 and not page[0].path  # there is no layout to read
                out.append(" ".join([x.text for x, ok in zip(page, labels, strict=True) if ok or plain]))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=["page_id", "url", "text"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return arrow_pass(source, work, "page_id long, url string, text string")
