"""Main text of web pages by gradient-boosted trees over DOM nodes, decoded down the tree.

Each element and each block of text is a node with features: its tag, tokens of its attributes and of its ancestors'
(hashed, and by what designers use them for), depth, place among its siblings, and length, density and links of the text below it. Trees trained here, on pages
made from a rule (`training_pages`), give the probability that a node holds text of the article. The labelling of
highest likelihood in which no node holds such text unless its parent does is found from the leaves up; its blocks
are the main text.

Blocks end at elements that break the line and at br. Null and empty pages have an empty text, and so have pages
without article. Very long pages are read whole. Equal rows are extracted one by one. Columns are passed by name.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dom import Page

# Words that designers use in class, id and role, by what they mark.
MARKS = {
    "body": "article content entry post story body text main page hentry blog copy prose richtext",
    "menu": "nav navbar navigation menu menubar breadcrumb breadcrumbs toc tabs pager pagination skip",
    "head": "header masthead top topbar banner logo branding hero tagline",
    "foot": "footer foot bottom copyright legal colophon imprint",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending teaser more",
    "advert": "ad ads advert adverts advertisement advertising promo promoted promotion sponsor sponsored dfp banner adsense commercial",
    "notice": "cookie cookies consent gdpr notice notification alert popup modal overlay dialog disclaimer toast paywall",
    "form": "form search login signup subscribe subscription newsletter register input contact feedback poll",
    "comment": "comment comments commentlist reply replies respond responses disqus discussion thread reader readers review reviews",
    "share": "share sharing social follow facebook twitter tools toolbar print tags meta byline",
}
TAGS = ["#", "p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "ol", "li", "a", "h1", "h2", "h3", "table", "td", "blockquote", "figure", "figcaption", "span", "b", "body", "label", "button", "pre", "dialog", "noscript", "object", "svg", "math"]
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_VALUE = re.compile(r"""(?:class|id|role|itemprop|aria-label|data-role|name)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_WORDS: dict[str, int] = {}
for _k, _line in enumerate(MARKS.values()):
    for _w in _line.split():
        _WORDS[_w] = _WORDS.get(_w, 0) | 1 << _k
_TAG_MARK = {"nav": 1 << 1, "menu": 1 << 1, "footer": 1 << 3, "aside": 1 << 4, "form": 1 << 7, "fieldset": 1 << 7, "button": 1 << 7, "label": 1 << 7, "dialog": 1 << 6}
_TAG_AT = {t: k for k, t in enumerate(TAGS)}


#: Features for the hashes of any attribute tokens; their bits come behind those of MARKS.
HASHED = 24


@lru_cache(maxsize=20_000)
def _marks(attrs: str) -> int:
    found = 0
    for v in _VALUE.findall(attrs):
        for t in _TOKEN.findall(v):
            found |= _WORDS.get(t.lower(), 0) | 1 << len(MARKS) + zlib.crc32(t.lower().encode()) % HASHED
    return found


def features(pages: list[Page]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, parent (of the concatenated nodes) and depth."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.cumsum(sizes) - sizes
    shift = np.repeat(base, sizes)
    flat = lambda k, t: np.array([x for p in pages for x in getattr(p, k)], t)
    parent, end, depth = flat("parent", np.int64), flat("end", np.int64) + shift, flat("depth", np.int64)
    top = parent < 0
    parent = np.where(top, np.arange(parent.size), parent + shift)
    tag = np.array([_TAG_AT.get(t, len(TAGS)) for p in pages for t in p.tag])
    mark = np.array([(_marks(a) if a else 0) | _TAG_MARK.get(t, 0) for p in pages for a, t in zip(p.attrs, p.tag, strict=True)], np.int64)
    chars = np.array([len(t) for p in pages for t in p.text], np.float64)
    stops = np.array([t.count(".") + t.count(",") + t.count("!") + t.count("?") if t else 0 for p in pages for t in p.text], np.float64)
    linked = flat("linked", np.float64)
    here = np.arange(parent.size)
    below = lambda x: (c := np.r_[0.0, np.cumsum(x)])[end] - c[here]
    text, links, points = below(chars), below(linked), below(stops)
    blocks, nodes = below((chars > 0).astype(float)), (end - here).astype(float)
    headed = below((tag == _TAG_AT["p"]).astype(float))
    # What ancestors are marked as, and whether one is an article; down the tree, level by level.
    above = np.zeros(parent.size, np.int64)
    inside = np.zeros(parent.size, bool)
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if depth.size else []
    for d in range(1, len(cuts) - 1):
        k = order[cuts[d] : cuts[d + 1]]
        above[k] = above[parent[k]] | mark[parent[k]]
        inside[k] = inside[parent[k]] | np.isin(tag[parent[k]], (_TAG_AT["article"], _TAG_AT["main"]))
    rank = np.zeros(parent.size)
    by_parent = np.lexsort((here, parent))
    start = np.searchsorted(parent[by_parent], np.arange(parent.size))
    rank[by_parent] = np.arange(parent.size) - start[parent[by_parent]]
    family = np.bincount(parent[~top], minlength=parent.size).astype(float)
    page = np.repeat(text[base] if base.size else [], sizes)
    before = np.r_[0.0, np.cumsum(chars)][here] - np.repeat(np.r_[0.0, np.cumsum(chars)][base], sizes)
    up = parent[parent]
    x = [tag, tag[parent], tag[up], depth, rank, family[parent], family, np.log1p(text), np.log1p(text[parent]), text / np.maximum(page, 1), before / np.maximum(page, 1), links / np.maximum(text, 1), points / np.maximum(text, 1), points, text / nodes, text / np.maximum(blocks, 1), headed, links[parent] / np.maximum(text[parent], 1), text[parent] / np.maximum(blocks[parent], 1), inside]
    for k in range(len(MARKS)):
        x += [mark >> k & 1, above >> k & 1, mark[parent] >> k & 1]
    for k in range(len(MARKS), len(MARKS) + HASHED):
        x += [mark >> k & 1, above >> k & 1]
    for t in ("#", "p", "article", "main", "header", "footer", "nav", "aside", "form", "a", "li", "noscript"):
        x += [tag == _TAG_AT[t], tag[parent] == _TAG_AT[t]]
    return np.stack([np.asarray(v, np.float32) for v in x], 1), parent, depth


class Boosted:
    """Logistic gradient boosting over binned features; trees of one depth, as arrays."""

    def __init__(self, trees: int = 40, depth: int = 4, rate: float = 0.3, bins: int = 32, decay: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.decay = trees, depth, rate, bins, decay
        self.feature, self.cut, self.leaf = [], [], []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)])
        p0 = y.mean()
        self.start = float(np.log(p0 / (1 - p0)))
        f = np.full(y.size, self.start)
        width = self.bins
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(y.size, np.int64)
            feature, cut = [], []
            for d in range(self.depth):
                n = 1 << d
                best, pick = np.full(n, 1e-9), np.zeros((n, 2), np.int64)
                for j, b in enumerate(binned):
                    at = node * width + b
                    G = np.bincount(at, g, n * width).reshape(n, width).cumsum(1)
                    H = np.bincount(at, h, n * width).reshape(n, width).cumsum(1)
                    total_g, total_h = G[:, -1:], H[:, -1:]
                    gain = G**2 / (H + self.decay) + (total_g - G) ** 2 / (total_h - H + self.decay) - total_g**2 / (total_h + self.decay)
                    gain[:, len(edges[j]) :] = -1
                    k = gain.argmax(1)
                    better = gain[np.arange(n), k] > best
                    best = np.where(better, gain[np.arange(n), k], best)
                    pick[better] = np.stack([np.full(n, j), k], 1)[better]
                feature.append(pick[:, 0])
                value = np.array([edges[j][k] if b > 1e-9 else np.inf for (j, k), b in zip(pick, best, strict=True)], np.float32)
                cut.append(value)
                node = node * 2 + (x[np.arange(y.size), pick[node, 0]] > value[node])
            n = 1 << self.depth
            leaf = self.rate * np.bincount(node, g, n) / (np.bincount(node, h, n) + self.decay)
            f += leaf[node]
            self.feature.append(feature), self.cut.append(cut), self.leaf.append(leaf)
        return self

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        f, row = np.full(len(x), self.start), np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for a, c in zip(feature, cut, strict=True):
                node = node * 2 + (x[row, a[node]] > c[node])
            f += leaf[node]
        return f


def decode(odds: np.ndarray, parent: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """The likeliest labels in which a node is 1 only if its parent is: gain of 1 over 0 for each subtree, then downwards."""
    gain = odds.copy()
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(depth.max() + 2)) if depth.size else [0]
    for d in range(len(cuts) - 2, 0, -1):
        k = order[cuts[d] : cuts[d + 1]]
        np.add.at(gain, parent[k], np.maximum(gain[k], 0))
    on = gain > 0
    for d in range(1, len(cuts) - 1):
        k = order[cuts[d] : cuts[d + 1]]
        on[k] &= on[parent[k]]
    return on


def labels(page: Page, wanted: set[str]) -> np.ndarray:
    """1 for blocks whose text is in `wanted`, and for all that is above them."""
    y = np.zeros(len(page.parent), bool)
    for k, (tag, text) in enumerate(zip(page.tag, page.text, strict=True)):
        if tag == "#" and text in wanted:
            while k >= 0 and not y[k]:
                y[k] = True
                k = page.parent[k]
    return y


def training_pages(n: int, seed: int) -> Iterator[tuple[str, list[str]]]:
    """Pages and the blocks of their articles, from a rule: an article of varying make among what pages carry beside it."""
    rng = random.Random(seed)
    parts = ["an", "re", "to", "lin", "ver", "que", "os", "mi", "sch", "ta", "é", "or", "th", "ment", "il", "ga", "ou", "st"]
    serial = 0

    def word() -> str:
        return "".join(rng.choice(parts) for _ in range(rng.choice((1, 1, 2, 2, 3, 4))))

    def line(low: int, high: int, stop: str = ".") -> str:
        nonlocal serial
        serial += 1
        w = [word() for _ in range(rng.randint(low, high))]
        for k in range(rng.randint(6, 12), len(w), 13):
            w[k] += rng.choice((",", ".", "."))
        kind = rng.random()
        if kind < 0.06:
            w = [rng.choice(w)] * len(w)
        elif kind < 0.12:
            w = [x + rng.choice(("***", "###", "!!", " |")) for x in w]
        out = (" ".join(w) + (f" x{serial}" if rng.random() < 0.6 else "") + stop).capitalize()
        return out.upper() if kind > 0.96 else out

    def attr(kind: str, sure: float = 0.9) -> str:
        if rng.random() > sure:
            return rng.choice(("", ' class="row"', ' class="c1 wide"', f' id="b{rng.randint(1, 99)}"'))
        w = rng.choice(MARKS[kind].split())
        w = rng.choice((w, f"site-{w}", f"{w}-box", f"{w}_{rng.randint(1, 9)}", f"js-{w} wide", w.capitalize() + "Area"))
        return f' {rng.choice(("class", "class", "id"))}="{w}"'

    def links(k: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{word()}">{word().capitalize()}{rng.choice(("", " " + word()))}</a></{tag}>' for _ in range(k))

    def comments() -> str:
        tag = rng.choice(("section", "div", "div"))
        one = rng.choice(("div", "li", "article", "p"))
        body = "".join(f"<{one}{attr('comment', 0.7)}><b>{word().capitalize()}</b> <p>{line(4, 60, rng.choice(('.', '!', '?')))}</p></{one}>" for _ in range(rng.randint(1, 6)))
        return f"<{tag}{attr('comment', 0.97)}><h3>{word().capitalize()}</h3>{body}</{tag}>"

    def junk(kind: str) -> str:
        say = lambda: line(*rng.choice(((2, 6), (5, 15), (15, 60))))
        if kind == "menu":
            return rng.choice(("<nav{}><ul>{}</ul></nav>", "<div{}>{}</div>", "<ul{}>{}</ul>")).format(attr("menu", 0.8), links(rng.randint(3, 10), rng.choice(("li", "span", "li"))))
        if kind == "head":
            return f"<{(t := rng.choice(('header', 'header', 'div')))}{attr('head', 0.97 if t == 'div' else 0.5)}><{(u := rng.choice(('h1', 'p', 'div', 'span')))}>{say()}</{u}>{links(rng.randint(0, 3), 'span')}</{t}>"
        if kind == "foot":
            return f"<{(t := rng.choice(('footer', 'footer', 'div')))}{attr('foot', 0.97 if t == 'div' else 0.5)}>{rng.choice(('<p>{}</p>', '{}', '<div>{}</div>')).format('&copy; ' + say())}{links(rng.randint(0, 4), 'span')}</{t}>"
        if kind == "side":
            inner = rng.choice((f"<h3>{word()}</h3><ul>{links(4)}</ul>", f"<p>{say()}</p>", f"<h4>{line(2, 5)}</h4><p>{say()}</p><p>{say()}</p>", say()))
            return f"<{(t := rng.choice(('aside', 'div')))}{attr('side', 0.97 if t == 'div' else 0.5)}>{inner}</{t}>"
        if kind == "form":
            return f"<form{attr('form', 0.5)}><label>{line(1, 4)}</label><p>{say()}</p><input name=q><button>{word()}</button></form>"
        if kind == "comment":
            return comments()
        if kind == "notice" and rng.random() < 0.3:
            return rng.choice(("<noscript>{}</noscript>", "<noscript><p>{}</p></noscript>", "<noscript><div>{}</div></noscript>")).format(say())
        return f"<{(t := rng.choice(('div', 'div', 'section', 'p', 'aside')))}{attr(kind, 0.97)}>{rng.choice(('<p>{}</p>', '{}', '<span>{}</span>', '{} <a href=#>more</a>')).format(say())}</{t}>"

    for _ in range(n):
        main: list[str] = []

        def put(tag: str, text: str, main: list[str] = main) -> str:
            main.append(text)
            style = rng.random()
            if tag == "p" and style < 0.12:
                return f"<p><b>{text}<br>"
            if tag == "p" and style < 0.22:
                return f"<p>{text}"
            if tag == "p" and style < 0.26:
                w = text.split()
                k = rng.randrange(len(w))
                return f"<p>{' '.join(w[:k])} <{(t := rng.choice(('math', 'svg', 'object')))}><{(u := rng.choice(('mi', 'text', 'span')))}>{w[k]}</{u}></{t}> {' '.join(w[k + 1 :])}</p>"
            if tag == "p" and style < 0.3:
                w = text.split()
                k = rng.randrange(len(w))
                return f"<p>{' '.join(w[:k])} <{(t := rng.choice(('a href=/x', 'em', 'b', 'span')))}>{w[k]}</{t.split()[0]}> {' '.join(w[k + 1 :])}</p>"
            return f"<{tag}>{text}</{tag}>"

        body = []
        if rng.random() < 0.8:
            body.append(put(rng.choice(("h1", "h1", "h2")), line(*rng.choice(((1, 2), (2, 12), (2, 12))), rng.choice(("", ".")))))
        for _ in range(rng.choice((1, 1, 2, 4, 8, 15))):
            body.append(put("p", line(*rng.choice(((1, 3), (1, 12), (20, 80), (60, 200))), rng.choice((".", ".", ".", "", " |")))))
            r = rng.random()
            if r < 0.06:
                body.append(put("h2", line(1, 6, "")))
            elif r < 0.1:
                body.append("<ul>" + "".join(put("li", line(2, 20)) for _ in range(3)) + "</ul>")
            elif r < 0.13:
                body.append("<blockquote>" + put("p", line(8, 40)) + "</blockquote>")
            elif r < 0.15:
                body.append("<table><tr>" + "".join(put("td", line(1, 6)) for _ in range(3)) + "</tr></table>")
            elif r < 0.25:
                body.append(junk(rng.choice(("advert", "notice", "side", "form", "share"))))
        if rng.random() < 0.15:
            body.append(comments())
        if rng.random() < 0.1:
            body.append(junk("foot"))
        make = rng.random()
        if make < 0.5:
            article = f"<article{attr('body', 0.3)}>{''.join(body)}</article>"
        elif make < 0.65:
            article = f"<main{attr('body', 0.3)}>{''.join(body)}</main>"
        elif make < 0.9:
            article = f"<div{attr('body', 0.9)}>{''.join(body)}</div>"
        else:
            article = f"<div>{''.join(body)}</div>"
        if rng.random() < 0.3:
            article = f"<{(t := rng.choice(('main', 'div', 'section')))}{attr('body', 0.5)}>{article}{comments() if rng.random() < 0.2 else ''}</{t}>"
        if rng.random() < 0.1:
            deep = rng.randint(2, 40)
            article = f"{'<div>' * deep}{article}{'</div>' * deep}"
        front = [junk(rng.choice(("menu", "menu", "head", "head", "advert", "notice", "form", "share", "side"))) for _ in range(rng.randint(1, 5))]
        back = [junk(rng.choice(("foot", "foot", "side", "comment", "comment", "advert", "menu", "form", "share", "notice"))) for _ in range(rng.randint(1, 5))]
        end = rng.choice(("</body></html>", "</body></html>", ""))
        yield f"<html><head><title>{line(2, 6)}</title></head><body>{''.join(front)}{article}{''.join(back)}{end}", [" ".join(t.split()) for t in main]


@lru_cache(maxsize=2)
def trained(pages: int = 400, seed: int = 11) -> Boosted:
    """The model; it is the same whenever it is trained."""
    made = [(Page(source), set(blocks)) for source, blocks in training_pages(pages, seed)]
    x, _, _ = features([p for p, _ in made])
    y = np.concatenate([labels(p, b) for p, b in made]).astype(float)
    return Boosted().fit(x, y)


def main_texts(sources: list[str | None], model: Boosted) -> list[str]:
    pages = [Page(s) for s in sources]
    if not pages:
        return []
    x, parent, depth = features(pages)
    on = decode(model.log_odds(x), parent, depth)
    out, at = [], 0
    for p in pages:
        n = len(p.parent)
        out.append("\n".join(t for t, k in zip(p.text, on[at : at + n], strict=True) if k and t))
        at += n
    return out


def extract(pages: DataFrame, training: int = 400, seed: int = 11) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    model = pages.sparkSession.sparkContext.broadcast(trained(training, seed))  # some thousand numbers

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            sources, done = b.tolist(), []
            for at in range(0, len(sources), 256):
                done += main_texts(sources[at : at + 256], model.value)
            yield pd.Series(done, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    out = pages.select("page_id", "url", F.pandas_udf(run, "string")(F.col("html")).alias("text"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
