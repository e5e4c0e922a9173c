"""Main text of web pages by a recurrent block labeller.

A page is a sequence of leaf blocks.  Each block is a vector of its tag path (the open
elements and the parts of their class, id and role names, hashed), its words (hashed)
and a few measures.  A bidirectional LSTM in numpy reads the sequence both ways, so the
label of a block depends on the whole page, and a linear layer says text or not.

There are no labels, so the labeller is fitted on a bounded sample of the pages in two
ways: as they are, where their own elements say what a block is (an article, a menu), and
laid out anew, where the same blocks stand in generated layouts whose parts are known.
"""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from galeframe.llm.blocks import Leaf, leaves
from galeframe.llm.support import mapped
from galeframe.llm.words import letter_words, lowered, word_hashes

# Bounds of the sample: pages, and characters of a page that may be in it.
SAMPLE_PAGES = 160
SAMPLE_CHARS = 1 << 18
# Generated layouts, and characters of a line of text or of what is around it in these.
LAYOUTS = 700
TEXT_CHARS, AROUND_CHARS = 1500, 300
# Sampled pages are read whole, in windows of so many blocks while fitting.
WINDOW = 400
PATH_SLOTS, WORD_SLOTS, MEASURES = 160, 48, 8
WIDTH = PATH_SLOTS + WORD_SLOTS + MEASURES
HIDDEN = 20
EPOCHS, RATE, BATCH = 7, 0.008, 32

# Elements and names that say what a block is.
TEXT_PARTS = frozenset("article main content post entry story body text".split())
OTHER_PARTS = frozenset(
    "nav menu header footer aside sidebar form ad ads advert advertisement banner sponsored promo notice cookie consent "
    "newsletter subscribe popup modal alert comment comments respond disqus related share social breadcrumb breadcrumbs "
    "pagination pager widget login signup copyright legal toolbar tags author meta hidden button dialog".split()
)
# Lines that stand around articles, to lay out pages with.
AROUND = (
    "Home|About us|Contact|Sign in|Log in|Register|Search|Menu|Skip to content|Subscribe to our newsletter|"
    "We use cookies to improve your experience.|Accept all|Reject all|Privacy policy|Terms of use|"
    "All rights reserved.|Copyright 2024|Share this article|Tweet|Print|Email|Related stories|Most read|Read more|"
    "Leave a reply|Your email address will not be published.|Post comment|Reply|Report|Sponsored content|"
    "Advertisement|Buy now and save|Previous|Next|Follow us|Enter your email|Name|Submit|Comments|Trending now"
).split("|")


def _slot(token: str, slots: int) -> int:
    return zlib.crc32(token.encode()) % slots


_paths: dict[tuple[str, ...], np.ndarray] = {}


def _path(path: tuple[str, ...]) -> np.ndarray:
    """Hashed elements and names of a path; the two innermost elements count again."""
    found = _paths.get(path)
    if found is None:
        found = np.zeros(PATH_SLOTS, np.float32)
        for depth, element in enumerate(path):
            tag, *names = element.split(" ")
            for token in [tag, *("." + n for n in names)]:
                found[_slot(token, PATH_SLOTS)] = 1.0
            if depth >= len(path) - 2:
                found[_slot(f"{len(path) - depth}{tag}", PATH_SLOTS)] += 0.5
        if len(_paths) > 20_000:
            _paths.clear()
        _paths[path] = found
    return found


def vectors(pages: list[list[Leaf]]) -> np.ndarray:
    """A row for every leaf of every page."""
    every = [leaf for page in pages for leaf in page]
    out = np.zeros((len(every), WIDTH), np.float32)
    if not every:
        return out
    for k, leaf in enumerate(every):
        out[k, :PATH_SLOTS] = _path(leaf.path)
    raw = [leaf.text.encode() for leaf in every]
    offsets = np.append(0, np.cumsum([len(r) for r in raw])).astype(np.int64)
    text = lowered(np.frombuffer(b"".join(raw), np.uint8))
    begin, end = letter_words(text, offsets[:-1])
    owner = np.searchsorted(offsets, begin, "right") - 1
    slot = (word_hashes(text, begin, end) % np.uint64(WORD_SLOTS)).astype(np.int64)
    counts = np.bincount(owner * WORD_SLOTS + slot, minlength=len(every) * WORD_SLOTS).reshape(-1, WORD_SLOTS)
    words = counts.sum(1)
    out[:, PATH_SLOTS : PATH_SLOTS + WORD_SLOTS] = counts / np.sqrt(np.maximum(words, 1))[:, None]
    size = np.array([len(leaf.text) for leaf in every], np.float32)
    linked = np.array([leaf.linked for leaf in every], np.float32)
    stops = np.bincount(np.searchsorted(offsets, np.flatnonzero(np.isin(text, [33, 46, 63])), "right") - 1, minlength=len(every))
    place = np.concatenate([np.arange(len(page)) / max(1, len(page)) for page in pages])
    measures = [np.log1p(size) / 5, np.minimum(linked / np.maximum(size, 1), 1), np.log1p(words) / 4, np.log1p(stops), stops / np.maximum(words, 1), place, size > 80, np.ones(len(every))]
    out[:, PATH_SLOTS + WORD_SLOTS :] = np.stack(measures, 1)
    return out


class Lstm:
    """One direction; parameters for input, state and bias of four gates."""

    def __init__(self, rng: np.random.Generator):
        self.w = (rng.standard_normal((WIDTH + HIDDEN + 1, 4 * HIDDEN)) * 0.12).astype(np.float32)
        self.w[-1, HIDDEN : 2 * HIDDEN] = 1.0

    def forward(self, x: np.ndarray, keep: bool = False):
        """States for x (steps, pages, width); with ``keep`` what the slopes need."""
        steps, pages, _ = x.shape
        h, c = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
        inputs = x @ self.w[:WIDTH] + self.w[-1]
        states, kept = np.empty((steps, pages, HIDDEN), np.float32), []
        for t in range(steps):
            gate = inputs[t] + h @ self.w[WIDTH:-1]
            i, f, o = (1 / (1 + np.exp(-gate[:, k * HIDDEN : (k + 1) * HIDDEN])) for k in range(3))
            g = np.tanh(gate[:, 3 * HIDDEN :])
            before, c_before = h, c
            c = f * c + i * g
            squashed = np.tanh(c)
            h = o * squashed
            states[t] = h
            if keep:
                kept.append((i, f, o, g, before, c_before, squashed))
        return states, kept

    def slopes(self, x: np.ndarray, kept: list, d_states: np.ndarray) -> np.ndarray:
        out = np.zeros_like(self.w)
        d_h = d_c = np.zeros_like(d_states[0])
        for t in range(len(kept) - 1, -1, -1):
            i, f, o, g, before, c_before, squashed = kept[t]
            d_h = d_h + d_states[t]
            d_c = d_c + d_h * o * (1 - squashed**2)
            d_gate = np.concatenate([d_c * g * i * (1 - i), d_c * c_before * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g**2)], 1)
            out[:WIDTH] += x[t].T @ d_gate
            out[WIDTH:-1] += before.T @ d_gate
            out[-1] += d_gate.sum(0)
            d_h, d_c = d_gate @ self.w[WIDTH:-1].T, d_c * f
        return out


class Labeller:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.ahead, self.back = Lstm(rng), Lstm(rng)
        self.top = (rng.standard_normal(2 * HIDDEN + 1) * 0.1).astype(np.float32)

    @staticmethod
    def _padded(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(steps, pages, width) read forwards and backwards, zeros behind the end."""
        steps = max(map(len, rows))
        ahead = np.zeros((steps, len(rows), WIDTH), np.float32)
        back = np.zeros_like(ahead)
        for k, row in enumerate(rows):
            ahead[: len(row), k] = row
            back[: len(row), k] = row[::-1]
        return ahead, back

    def _joined(self, ahead: np.ndarray, back: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
        return [np.concatenate([ahead[:n, k], back[:n, k][::-1]], 1) for k, n in enumerate(sizes)]

    def predict(self, rows: list[np.ndarray]) -> list[np.ndarray]:
        """Probability of being main text for every block of every page."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(rows)
        order = sorted((k for k in range(len(rows)) if len(rows[k])), key=lambda k: len(rows[k]))
        a = 0
        while a < len(order):
            b = a + 1  # pages of like length, a bounded number of cells
            while b < len(order) and b - a < 128 and len(rows[order[b]]) <= 1.3 * len(rows[order[a]]) + 4 and len(rows[order[b]]) * (b - a) < 20_000:
                b += 1
            group = [rows[k] for k in order[a:b]]
            ahead, back = self._padded(group)
            states = self._joined(self.ahead.forward(ahead)[0], self.back.forward(back)[0], [len(r) for r in group])
            for k, s in zip(order[a:b], states):
                out[k] = 1 / (1 + np.exp(-(s @ self.top[:-1] + self.top[-1])))
            a = b
        return out

    def fit(self, rows: list[np.ndarray], labels: list[np.ndarray], seed: int = 6) -> None:
        """Adam on the cross entropy of all blocks, by back-propagation through time."""
        rng = np.random.default_rng(seed)
        parameters = [self.ahead.w, self.back.w, self.top]
        first, second = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        turn = 0
        for epoch in range(EPOCHS):
            by_size = sorted(range(len(rows)), key=lambda k: (len(rows[k]), k))
            groups = [by_size[k : k + BATCH] for k in range(0, len(by_size), BATCH)]
            for g in rng.permutation(len(groups)).tolist():
                group = groups[g]
                sizes = [len(rows[k]) for k in group]
                ahead, back = self._padded([rows[k] for k in group])
                states_a, kept_a = self.ahead.forward(ahead, True)
                states_b, kept_b = self.back.forward(back, True)
                d_a, d_b, d_top = np.zeros_like(states_a), np.zeros_like(states_b), np.zeros_like(self.top)
                for k, (page, s) in enumerate(zip(group, self._joined(states_a, states_b, sizes))):
                    error = (1 / (1 + np.exp(-(s @ self.top[:-1] + self.top[-1]))) - labels[page]) / sum(sizes)
                    d_top += np.append(error @ s, error.sum()).astype(np.float32)
                    d = error[:, None] * self.top[:-1]
                    d_a[: sizes[k], k] = d[:, :HIDDEN]
                    d_b[: sizes[k], k] = d[::-1, HIDDEN:]
                slopes = [self.ahead.slopes(ahead, kept_a, d_a), self.back.slopes(back, kept_b, d_b), d_top]
                turn += 1
                rate = RATE * (1 - 0.8 * epoch / EPOCHS) * np.sqrt(1 - 0.999**turn) / (1 - 0.9**turn)
                for p, m, v, s in zip(parameters, first, second, slopes):
                    m += 0.1 * (s - m)
                    v += 0.001 * (s * s - v)
                    p -= (rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)


# Fitting.


def own_labels(page: list[Leaf]) -> np.ndarray | None:
    """What the page's own elements say of its blocks; None if it names no text."""
    out = np.zeros(len(page), np.float32)
    named = False
    for k, leaf in enumerate(page):
        names = [set(e.split(" ")) for e in leaf.path]
        inside = any(n & TEXT_PARTS for n in names)
        named |= inside
        out[k] = inside and not any(n & OTHER_PARTS for n in names)
    return out if named else None


# Marks of generated text while a layout is read back.
_TEXT, _OTHER = "\ue000", "\ue001"


class _Layouts:
    """Pages laid out anew from blocks of text and blocks around it."""

    def __init__(self, text: list[str], around: list[str], seed: int = 4):
        self.around, self.rng = [*AROUND, *around], random.Random(seed)
        self.text = text or [self._made_up() for _ in range(300)]

    def _made_up(self) -> str:
        """A paragraph of invented words, where no text is known."""
        r = self.rng
        word = lambda: "".join(r.choice("aeiounrtlsdm") for _ in range(r.randint(2, 9)))
        return " ".join(" ".join(word() for _ in range(r.randint(4, 14))).capitalize() + "." for _ in range(r.randint(1, 8)))

    def _name(self, *names: str) -> str:
        r = self.rng
        name = r.choice(names)
        if r.random() < 0.3:
            name = r.choice(["site-", "page-", "c-", "the_", "js-"]) + name
        if r.random() < 0.2:
            name += r.choice(["-wrap", "-inner", "-box", "__list", " clearfix", "-1"])
        return f' {r.choice(["class", "class", "id"])}="{name}"'

    def _lines(self, most: int, text: bool = False) -> list[str]:
        r = self.rng
        some = [r.choice(self.around) for _ in range(r.randint(1, most))]
        if text:  # long lines around the article too: comments, teasers, notices
            some = [r.choice(self.text)[: r.randint(30, 400)] if r.random() < 0.7 else s for s in some]
        return [_OTHER + s for s in some]

    def _part(self) -> str:
        r = self.rng
        kind = r.randrange(11)
        if kind == 0:
            return f"<nav><ul>{''.join(f'<li><a href=#>{s}</a></li>' for s in self._lines(9))}</ul></nav>"
        if kind == 1:
            return f"<header{self._name('header', 'masthead', 'top')}><h1>{self._lines(1)[0]}</h1>{''.join(f'<div>{s}</div>' for s in self._lines(2))}</header>"
        if kind == 2:
            return f"<footer>{''.join(f'<p>{s}</p>' for s in self._lines(4, r.random() < 0.5))}</footer>"
        if kind == 3:
            return f"<aside{self._name('sidebar', 'related', 'widget', 'promo')}><h3>{self._lines(1)[0]}</h3>{''.join(f'<p>{s}</p>' for s in self._lines(4, True))}</aside>"
        if kind == 4:
            return f"<div{self._name('ad', 'ads', 'advert', 'advertisement', 'sponsored', 'banner', 'promo')}>{''.join(f'<p>{s}</p>' for s in self._lines(2, True))}</div>"
        if kind == 5:
            return f"<div{self._name('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'popup', 'newsletter')}>{''.join(f'<p>{s}</p>' for s in self._lines(3, True))}<button>{self._lines(1)[0]}</button></div>"
        if kind == 6:
            return f"<form action=#>{''.join(f'<label>{s}</label><input>' for s in self._lines(3))}<p>{self._lines(1, True)[0]}</p><button>{self._lines(1)[0]}</button></form>"
        if kind == 7:
            tag = r.choice(["div", "section", "ol"])
            inner = "li" if tag == "ol" else "div"
            rows = "".join(f"<{inner}{self._name('comment', 'reply', 'comment-body')}><p>{s}</p></{inner}>" for s in self._lines(5, True))
            return f"<{tag}{self._name('comments', 'comment-list', 'respond', 'disqus')}><h2>{self._lines(1)[0]}</h2>{rows}</{tag}>"
        if kind == 8:
            return f"<div{self._name('share', 'social', 'breadcrumbs', 'tags', 'pager', 'meta', 'toolbar')}>{''.join(f'<a href=#>{s}</a> ' for s in self._lines(5))}</div>"
        if kind == 9:
            return f"<div{self._name('menu', 'nav', 'topbar', 'navigation')}>{''.join(f'<a href=#>{s}</a><br>' for s in self._lines(6))}</div>"
        return f"<div{self._name('footer', 'copyright', 'legal', 'bottom')}>{''.join(f'<div>{s}</div>' for s in self._lines(3, r.random() < 0.5))}</div>"

    def _article(self) -> str:
        r = self.rng
        body = []
        if r.random() < 0.6:
            body.append(f"<h1>{_TEXT}{r.choice(self.text)[:60]}</h1>")
        for _ in range(r.randint(1, 14)):
            s = _TEXT + (r.choice(self.text) if r.random() < 0.75 else r.choice(self.text)[: r.randint(3, 60)])
            tag = r.choices(["p", "h2", "h3", "blockquote", "pre", "div", "li", "td", "section"], [16, 1, 1, 1, 1, 2, 1, 1, 1])[0]
            body.append({"li": f"<ul><li>{s}</li></ul>", "td": f"<table><tr><td>{s}</td></tr></table>", "section": f"<section><p>{s}</p></section>"}.get(tag, f"<{tag}>{s}</{tag}>"))
            if r.random() < 0.06:
                body.append(self._part())
        inner = "".join(body)
        kind = r.randrange(6)
        if kind < 3:
            return f"<article>{inner}</article>"
        if kind == 3:
            return f"<main>{inner}</main>"
        return f"<div{self._name('content', 'post', 'entry', 'story', 'article', 'main', 'body', 'text')}>{inner}</div>"

    def page(self) -> str:
        r = self.rng
        before, after = ([self._part() for _ in range(r.randint(0, 4))] for _ in range(2))
        core = self._article()
        if r.random() < 0.2:
            core = f"<div{self._name('container', 'wrapper', 'row', 'layout')}>{core}{self._part()}</div>"
        return "<body>" + "".join([*before, core, *after]) + "</body>"


def fit(pages: list[str], layouts: int = LAYOUTS) -> Labeller:
    """A labeller from a sample of pages; without pages it knows the layouts alone."""
    rows, labels, text, around = [], [], [], []
    for page in pages:
        found = leaves(page)
        own = own_labels(found) if found else None
        if own is None:
            continue
        x = vectors([found])
        for k in range(0, len(found), WINDOW):
            rows.append(x[k : k + WINDOW])
            labels.append(own[k : k + WINDOW])
        text += [leaf.text[:TEXT_CHARS] for leaf, y in zip(found, own) if y]
        around += [leaf.text[:AROUND_CHARS] for leaf, y in zip(found, own) if not y]
    maker = _Layouts([t for t in text if "<" not in t and "&" not in t], [t for t in around if "<" not in t and "&" not in t])
    for _ in range(layouts):
        found = leaves(maker.page())
        own = np.array([leaf.text.startswith(_TEXT) for leaf in found], np.float32)
        for leaf in found:
            leaf.text = leaf.text.replace(_TEXT, "").replace(_OTHER, "")
        if found:
            rows.append(vectors([found]))
            labels.append(own)
    out = Labeller()
    out.fit(rows, labels)
    return out


def train(pages: DataFrame, size: int = SAMPLE_PAGES) -> Labeller:
    """Fitted on about ``size`` pages chosen by a hash of page_id, none of more than
    ``SAMPLE_CHARS`` characters, each read whole."""
    spread = 1_000_000
    rows = pages.where(F.length("html") <= SAMPLE_CHARS)
    share = int(spread * min(1.0, size / max(1, rows.count())))
    chosen = rows.where(F.pmod(F.xxhash64("page_id", F.lit("html")), F.lit(spread)) < share)
    return fit([r[1] for r in sorted(chosen.select("page_id", "html").collect())])


def extract(pages: DataFrame, labeller: Labeller) -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks): the main text of every whole page.

    Blocks are joined by two newlines.  Null and empty pages, and pages without main
    text, have an empty text.  Repeated rows stay; other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(labeller)

    def step(batch: pa.RecordBatch) -> dict:
        cut = [leaves(page) if page else [] for page in batch.column(2).to_pylist()]
        rows = vectors(cut)
        ends = np.cumsum([len(c) for c in cut]).tolist()
        marks = shared.value.predict([rows[e - len(c) : e] for c, e in zip(cut, ends)])
        texts = ["\n\n".join(leaf.text for leaf, p in zip(c, m) if p >= 0.5) for c, m in zip(cut, marks)]
        return {"page_id": batch.column(0), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts], "n_blocks": [len(c) for c in cut]}

    return mapped(
        pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"),
        step,
        "page_id long, url string, text string, n_chars long, n_blocks long",
    )

