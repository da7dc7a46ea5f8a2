"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded down the tree.

A page is parsed into elements and text runs. Each node has features of its own (tag, learned weights of
the tokens of its class, id and role, depth), of its subtree (characters, links, density, how much of the page it holds)
and of its siblings. Boosted trees give the probability that a node belongs to the main text, and a
dynamic program over the page's tree picks the likeliest labelling in which no node is main text below
one that is not, so an ancestor and its descendants never contradict each other.

The trees are trained here, on pages that a seeded generator writes together with their labels: layouts
of many kinds with menus, headers, footers, sidebars, notices, adverts, forms, comments and an article.

Text: character references are decoded, white space inside a block becomes one space, blocks are trimmed
and joined by a newline. <br> counts as white space.

Defined cases: a null or empty html gives an empty text; a page that breaks off keeps what it has; a page
of any length and nesting is read whole, in linear time; text outside any element is a run of the root;
where a node is as likely main text as not, it is not; repeated rows and null ids each give a row; an empty table
gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pagequarry.functions.markup import Tokenizer
from pagequarry.llm.common import tidy

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is no text of the page.
SILENT = frozenset("script style noscript template svg math iframe object canvas head title select textarea".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: A start tag of the key closes an open element of the value, unless one of STOP is in between.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES_P = BLOCK - {"html", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "summary", "figcaption"}
STOP = frozenset("table ul ol dl td th div section article aside body html button".split())


class Parser(Tokenizer):
    """Nodes in document order as parallel lists: tag, class tokens, parent, text. The root is node 0.

    path holds the open elements from the root down, places the levels of path at which each tag is
    open, walls those of STOP elements: what an end tag closes is looked up and never searched for, so
    the time for a page is linear in its length, however deep it nests.
    """

    def __init__(self):
        self.tags, self.tokens, self.parent, self.texts = ["#root"], [()], [-1], [""]
        self.path = [0]
        self.places: dict[str, list[int]] = {}
        self.walls = [0]

    def _add(self, tag: str, tokens=(), text: str = "") -> None:
        self.tags.append(tag)
        self.tokens.append(tokens)
        self.parent.append(self.path[-1])
        self.texts.append(text)

    def _open(self, tag: str) -> None:
        level = len(self.path)
        self.path.append(len(self.tags) - 1)
        self.places.setdefault(tag, []).append(level)
        if tag in STOP:
            self.walls.append(level)

    def _close(self, level: int) -> None:
        """Close the element at this level of the path and all in it."""
        for n in self.path[level:]:
            self.places[self.tags[n]].pop()
        del self.path[level:]
        while self.walls[-1] >= level:
            self.walls.pop()

    def _level(self, tag: str) -> int:
        """The level of the innermost open element of this tag; 0 if there is none."""
        open_ = self.places.get(tag)
        return open_[-1] if open_ else 0

    def _end_implied(self, tags) -> None:
        level = max(map(self._level, tags))
        if level and level >= self.walls[-1]:
            self._close(level)

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES_P:
            self._end_implied(_P)
        if tag in CLOSES:
            self._end_implied(CLOSES[tag])
        tokens = ()
        if attrs:
            tokens = tuple(t for k, v in attrs if v and k in ("class", "id", "role") for t in _TOKEN.findall(v.lower()))
        self._add(tag, tokens)
        if tag not in VOID:
            self._open(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(len(self.path) - 1)

    def handle_endtag(self, tag):
        if level := self._level(tag):
            self._close(level)

    def handle_data(self, data):
        self._add("#text", (), data)


_P = frozenset({"p"})
_TOKEN = re.compile("[a-z0-9]+")


def parse(html: str) -> Parser:
    """The page's nodes in document order, the root first; a child comes after its parent."""
    p = Parser()
    p.read(html)
    return p


# ---------------------------------------------------------------- features
TAGS = ("nav", "header", "footer", "aside", "article", "main", "form", "p", "a", "li", "div", "section", "blockquote", "#text", "h", "silent", "ul", "button")
NAMES = [
    *(f"tag_{t}" for t in TAGS),
    *(f"in_{t}" for t in TAGS[:7]),
    "in_silent",
    "own_low",
    "own_high",
    "up_low",
    "up_high",
    "depth",
    "log_chars",
    "link_share",
    "page_share",
    "density",
    "punctuation",
    "p_share",
    "kids",
    "place",
    "sibling_chars",
    "sibling_same",
    "beside",
]
_TAG_BIT = {t: 1 << i for i, t in enumerate(TAGS)}
_TAG_BIT |= {t: _TAG_BIT["silent"] for t in SILENT} | {f"h{i}": _TAG_BIT["h"] for i in range(1, 7)}
_SILENT_BIT = 1 << 7


def features(pages: list[Parser], weights: dict[str, float] | None = None) -> np.ndarray:
    """One row per node of all pages, in order; weights: what each attribute token says for main text (token_weights)."""
    weights = token_weights() if weights is None else weights
    tag, own_low, own_high, within, low, high, chars, stops, parent, depth, kids, place, same, first = ([] for _ in range(14))
    for page in pages:
        base = len(tag)
        seen: dict[tuple[int, str], int] = {}
        for i, (name, tokens, up, text) in enumerate(zip(page.tags, page.tokens, page.parent, page.texts)):
            bit = _TAG_BIT.get(name, 0)
            least = most = 0.0
            if tokens:
                said = [weights.get(t, 0.0) for t in tokens]
                least, most = min(0.0, *said), max(0.0, *said)
            inside = (bit & 127) | (_SILENT_BIT if name in SILENT else 0)
            c = s = d = 0
            if i:
                p = base + up
                inside |= within[p]
                d = depth[p] + 1
                place.append(kids[p])
                kids[p] += 1
                key = (up, name)
                seen[key] = seen.get(key, 0) + 1
                if text and not inside & _SILENT_BIT:
                    c = len(text) - text.count(" ") - text.count("\n")
                    s = text.count(".") + text.count(",")
                low.append(min(least, low[p]))
                high.append(max(most, high[p]))
            else:
                p = base
                place.append(0)
                low.append(least)
                high.append(most)
            tag.append(bit)
            own_low.append(least)
            own_high.append(most)
            within.append(inside)
            chars.append(c)
            stops.append(s)
            parent.append(p)
            depth.append(d)
            kids.append(0)
            first.append(base)
        same += [seen.get((up, name), 1) for up, name in zip(page.parent, page.tags)]
    n = len(tag)
    linked, paragraph, under, holds = [0] * n, [0] * n, [0] * n, [False] * n
    core = _TAG_BIT["article"] | _TAG_BIT["main"]
    a_bit, p_bit = _TAG_BIT["a"], _TAG_BIT["p"]
    for i in range(n - 1, -1, -1):
        p = parent[i]
        if p == i:
            continue
        c = chars[i]
        if c:
            if holds[i] or tag[i] & core:
                holds[i] = holds[p] = True
            if tag[i] & a_bit:
                linked[i] = c
            elif tag[i] & p_bit:
                paragraph[i] = c
            chars[p] += c
            linked[p] += linked[i]
            paragraph[p] += paragraph[i]
            stops[p] += stops[i]
        under[p] += under[i] + 1
    out = np.empty((n, len(NAMES)), np.float32)
    col = 0
    for bits, width in ((tag, len(TAGS)), (within, 8)):
        out[:, col : col + width] = np.array(bits)[:, None] >> np.arange(width) & 1
        col += width
    chars, linked, paragraph, stops, under, parent, kids = map(np.array, (chars, linked, paragraph, stops, under, parent, kids))
    some = np.maximum(chars, 1)
    holds, inner = np.array(holds), np.array(within) & core != 0
    siblings = np.maximum(kids[parent], 1)
    for x in (
        own_low,
        own_high,
        low,
        high,
        depth,
        np.log1p(chars),
        linked / some,
        chars / np.maximum(chars[np.array(first, np.int64)], 1),
        np.log1p(chars / (under + 1)),
        stops / some,
        paragraph / some,
        np.minimum(kids, 50),
        np.array(place) / siblings,
        chars / np.maximum(chars[parent], 1),
        np.minimum(same, 50),
        holds[np.array(first, np.int64)] & ~holds & ~inner,  # the page has an article or main with text, and this lies beside it
    ):
        out[:, col] = x
        col += 1
    return out


# ---------------------------------------------------------------- boosted trees
DEPTH, TREES, RATE, CUTS, LEAST = 4, 60, 0.2, 16, 5.0


class Boosted:
    """Trees of DEPTH levels as arrays: feature, threshold and leaf values of each."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray, base: float, weights: dict[str, float] | None = None):
        self.feature, self.threshold, self.leaf, self.base, self.weights = feature, threshold, leaf, base, weights

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf):
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += leaf[at - (1 << DEPTH) + 1]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Second-order boosting of the logistic loss; a split is the best of CUTS quantiles of a feature."""
    cuts = [np.unique(np.quantile(np.unique(x[:, j]), np.linspace(0, 1, CUTS + 1)[:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    width = max(len(c) for c in cuts) + 1
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    margin = np.full(len(y), base)
    features_, thresholds, leaves = [], [], []
    inner = (1 << DEPTH) - 1
    columns = np.arange(x.shape[1])
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf, np.float32)
        at = np.zeros(len(y), np.int64)
        for node in range(inner):
            rows = np.flatnonzero(at == node)
            if len(rows):
                flat = (binned[rows] + columns * width).ravel()
                size = x.shape[1] * width
                gs = np.bincount(flat, np.repeat(g[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)
                hs = np.bincount(flat, np.repeat(h[rows], x.shape[1]), size).reshape(-1, width).cumsum(1)
                whole_g, whole_h = gs[0, -1], hs[0, -1]
                gain = gs**2 / (hs + 1) + (whole_g - gs) ** 2 / (whole_h - hs + 1) - whole_g**2 / (whole_h + 1)
                gain[(hs < LEAST) | (whole_h - hs < LEAST)] = 0
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-6 and b < len(cuts[j]):
                    feature[node], threshold[node] = j, cuts[j][b]
            right = x[rows, feature[node]] > threshold[node]
            at[rows] = 2 * node + 1 + right
        leaf_at = at - inner
        gs, hs = np.bincount(leaf_at, g, inner + 1), np.bincount(leaf_at, h, inner + 1)
        leaf = -RATE * gs / (hs + 1)
        margin += leaf[leaf_at]
        features_.append(feature)
        thresholds.append(threshold)
        leaves.append(leaf)
    return Boosted(np.array(features_), np.array(thresholds), np.array(leaves), base)


# ---------------------------------------------------------------- training pages
#: Pages for the trees and for the weights of tokens, and the seeds of both.
TRAIN_PAGES, SEED = 420, 20
TOKEN_PAGES, TOKEN_SEED = 250, 21
#: Names that the written pages give to parts of each kind. Features know none of them: what a token says is learned.
CLASSES = {
    "menu": "nav navigation navbar menu menubar breadcrumb breadcrumbs tabs toolbar pagination pager toc",
    "edge": "header head masthead banner top footer foot bottom copyright legal colophon",
    "side": "sidebar side aside rail widget widgets related recommended more popular tags share social",
    "ad": "ad ads advert advertisement adverts sponsor sponsored promo promotion banner affiliate adsense",
    "notice": "notice cookie cookies consent gdpr alert popup modal overlay newsletter subscribe signup login paywall disclaimer",
    "comment": "comment comments disqus reply replies respond discussion thread reactions",
    "main": "article main content post entry body story text page blog single",
}


class _Writer:
    """Writes random pages; text of the article is between the marks \\x02 and \\x03, which are taken out again."""

    def __init__(self, seed: int, classes: dict[str, str] = CLASSES):
        self.r = np.random.default_rng(seed)
        self.classes = {k: v.split() for k, v in classes.items()}

    def pick(self, xs):
        return xs[int(self.r.integers(len(xs)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def words(self, low: int, high: int) -> str:
        n = int(self.r.integers(low, high + 1))
        letters = "abcdefghijklmnoprstuvwéäñ"
        out = []
        for i in range(n):
            w = "".join(self.pick(letters) for _ in range(int(self.r.integers(1, 10))))
            out.append(w.capitalize() if i % 9 == 0 else w + self.pick(["", "", "", "", ",", "."]))
        return " ".join(out)

    def main(self, s: str) -> str:
        return f"\x02{s}\x03"

    def named(self, kind: str) -> str:
        if self.chance(0.2):  # a name that says nothing, or none
            return self.pick(["", f' class="c{self.r.integers(1000)}"', f' class="css box{self.r.integers(20)}"'])
        word = self.pick(self.classes[kind])
        return self.pick([f' class="{word}"', f' id="{word}"', f' class="x-{word} y"'])

    def links(self, n: int) -> str:
        return "".join(f'<li><a href="/x">{self.words(1, 3)}</a></li>' for _ in range(n))

    def paragraph(self) -> str:
        t = self.words(*self.pick([(2, 8), (10, 40), (30, 160)]))
        if self.chance(0.3):
            t = t.replace(" ", f' <{(g := self.pick(["b", "i", "em", "a"]))}>{self.words(1, 2)}</{g}> ', 1)
        kind = self.pick(["p"] * 8 + ["h2", "h3", "blockquote", "li", "links", "open", "open"])
        if kind == "links":
            return "<ul>" + "".join(f'<li><a href="/x">{self.main(self.words(1, 7))}</a></li>' for _ in range(int(self.r.integers(1, 5)))) + "</ul>"
        if kind == "li":
            return f"<ul><li>{self.main(t)}</li><li>{self.main(self.words(2, 9))}</li></ul>"
        if kind == "open":
            return f"<p><b>{self.main(t)}<br>"
        return f"<{kind}>{self.main(t)}</{kind}>"

    def boiler(self) -> str:
        kind = self.pick(["ad", "ad", "menu", "side", "notice", "comment", "form", "script", "style", "share", "comment_block"])
        t = self.words(*self.pick([(1, 6), (4, 25), (10, 60)]))
        box = self.pick(["div", "div", "section", "aside"])
        if kind == "form":
            return f"<form><label>{self.words(1, 3)}</label><input name=q><button>{self.words(1, 2)}</button></form>"
        if kind in ("script", "style"):
            return f'<{kind}>var a="</p>";{self.words(1, 9)}</{kind}>'
        if kind == "menu":
            return f"<{self.pick(['nav', 'div'])}{self.named('menu')}><ul>{self.links(5)}</ul></div>".replace("</div>", "") + "</nav></div>"
        if kind == "share":
            return f"<ul{self.named('side')}>{self.links(3)}</ul>"
        if kind == "comment_block":
            inner = "".join(f"<div{self.named('comment')}><p>{self.words(3, 40)}</p></div>" for _ in range(3))
            return f"<{box}{self.named('comment')}><h3>{self.words(1, 3)}</h3>{inner}</{box}>"
        inner = self.pick([t, f"<p>{t}</p>", f"<p>{t}</p><p>{self.words(3, 20)}</p>", f"<h3>{self.words(1, 3)}</h3><p>{t}</p>"])
        return f"<{box}{self.named(kind)}>{inner}</{box}>"

    def edge(self, tag: str, inside: str) -> str:
        if self.chance(0.7):
            return f"<{tag}>{inside}</{tag}>"
        return f"<div{self.named('edge')}>{inside}</div>"

    def page(self) -> str:
        body = [f"<h1>{self.main(self.words(2, 12))}</h1>"] if self.chance(0.9) else []
        for _ in range(int(self.r.integers(0, 14))):
            body.append(self.paragraph() if self.chance(0.9) else self.boiler())
        inside = "".join(body)
        style = self.pick(["article"] * 6 + ["main", "mainarticle", "div", "sectiondiv"] + ["plain"] * 3 + ["nested", "blocks", "blocks", "bare"])
        if style == "bare":
            inside = self.pick(["\n", "<br><br>", " "]).join(self.main(self.words(10, 90)) for _ in range(int(self.r.integers(1, 5))))
        article = {
            "plain": f"<div>{inside}</div>",
            "nested": f"<div><div>{inside}</div></div>",
            "blocks": inside,
            "bare": inside,
            "article": f"<article>{inside}</article>",
            "main": f"<main>{inside}</main>",
            "mainarticle": f"<main><article{self.named('main')}>{inside}</article></main>",
            "div": f"<div{self.named('main')}>{inside}</div>",
            "sectiondiv": f"<div id=wrap><section{self.named('main')}>{inside}</section></div>",
        }[style]
        top = []
        if self.chance(0.5):
            top.append(self.edge("header", f"<a href='/'>{self.words(1, 3)}</a><p>{self.words(1, 8)}</p>"))
        if self.chance(0.8):
            top.append(f"<nav><ul>{self.links(int(self.r.integers(2, 9)))}</ul></nav>")
        top += [self.boiler() for _ in range(int(self.r.integers(0, 3)))]
        end = [self.boiler() for _ in range(int(self.r.integers(0, 3)))]
        if self.chance(0.4):
            end.append(f"<aside><h3>{self.words(1, 3)}</h3><ul>{self.links(4)}</ul><p>{self.words(2, 30)}</p></aside>")
        if self.chance(0.8):
            end.append(self.edge("footer", f"&copy; {self.words(2, 30)}"))
        whole = "".join([*top, article, *end])
        if self.chance(0.3):
            whole = f"<div class='{self.pick(['wrap', 'container', 'site'])}'>{whole}</div>"
        return f"<html><head><title>{self.words(2, 9)}</title></head><body>{whole}</body></html>"


def labelled(w: _Writer, pages: int):
    """Parsed pages with, for each node, whether it is main text and how much text it has. An element is if it holds any; a run, if most of it is."""
    for _ in range(pages):
        page = parse(w.page())
        n = len(page.tags)
        good, size = np.zeros(n), np.zeros(n)
        inside = False
        for i in range(n):
            if page.tags[i] != "#text":
                continue
            for part in re.split("([\x02\x03])", page.texts[i]):
                if part in ("\x02", "\x03"):
                    inside = part == "\x02"
                else:
                    size[i] += len(part)
                    good[i] += len(part) * inside
            page.texts[i] = page.texts[i].replace("\x02", "").replace("\x03", "")
        run = np.array([t == "#text" for t in page.tags])
        for i in range(n - 1, 0, -1):
            good[page.parent[i]] += good[i]
            size[page.parent[i]] += size[i]
        yield page, (good > 0) & (2 * good >= np.where(run, size, 0)), size


def learned_weights(w: _Writer, pages: int) -> dict[str, float]:
    """The log-odds that an element with a token of its class, id or role is main text, over those of all named elements."""
    counts: dict[str, list[int]] = {}
    whole = [0, 0]
    for page, label, size in labelled(w, pages):
        for tokens, good, n in zip(page.tokens, label.tolist(), size.tolist()):
            if n:
                for t in set(tokens):
                    counts.setdefault(t, [0, 0])[good] += 1
                    whole[good] += 1
    base = np.log((whole[1] + 1) / (whole[0] + 1))
    return {t: float(np.log((yes + 1) / (no + 1)) - base) for t, (no, yes) in counts.items() if yes + no >= LEAST}


@lru_cache(maxsize=1)
def token_weights() -> dict[str, float]:
    """Learned from pages that the trees are not trained on."""
    return learned_weights(_Writer(TOKEN_SEED), TOKEN_PAGES)


def training_pages(
    pages: int = TRAIN_PAGES, seed: int = SEED, classes: dict[str, str] = CLASSES, weights: dict[str, float] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes with text of generated pages."""
    xs, ys = [], []
    for page, label, size in labelled(_Writer(seed, classes), pages):
        used = size > 0
        xs.append(features([page], weights)[used])
        ys.append(label[used].astype(float))
    return np.concatenate(xs), np.concatenate(ys)


def train(pages: int = TRAIN_PAGES, seed: int = SEED, classes: dict[str, str] = CLASSES) -> Boosted:
    """Trees and token weights; the weights come from other pages than the trees."""
    weights = token_weights() if classes is CLASSES else learned_weights(_Writer(TOKEN_SEED, classes), TOKEN_PAGES)
    model = boost(*training_pages(pages, seed, classes, weights))
    model.weights = weights
    return model


# ---------------------------------------------------------------- decoding
def decode(parent: list[int], margin: np.ndarray) -> list[bool]:
    """The likeliest labels in which a node is main text only if its parent is; the root always may be.

    off[v] is the log-likelihood of v and all below it as not main text, on[v] that of v as main text
    with the better of the two for each node below it.
    """
    on, off = (-np.logaddexp(0, -margin)).tolist(), (-np.logaddexp(0, margin)).tolist()
    take = [True] * len(parent)
    for i in range(len(parent) - 1, 0, -1):
        p = parent[i]
        take[i] = on[i] > off[i]
        on[p] += max(on[i], off[i])
        off[p] += off[i]
    for i in range(1, len(parent)):
        take[i] = take[i] and take[parent[i]]
    return take


def text_of(page: Parser, keep: list[bool]) -> str:
    """The kept runs; a block's start and end, kept or not, end the block before."""
    blocks: list[str] = []
    held: list[str] = []

    def end():
        if held:
            t = " ".join("".join(held).split())
            if t:
                blocks.append(t)
            held.clear()

    open_: list[int] = []
    tags, parent = page.tags, page.parent
    for i in range(1, len(tags)):
        while open_ and open_[-1] != parent[i]:
            if tags[open_.pop()] in BLOCK:
                end()
        tag = tags[i]
        if tag == "#text":
            if keep[i]:
                held.append(page.texts[i])
            continue
        if tag == "br":
            held.append(" ")
        elif tag in BLOCK:
            end()
        open_.append(i)
    end()
    return "\n".join(blocks)


#: Pages whose nodes go through the trees together.
AT_ONCE = 64


def main_texts(htmls: list[str | None], model: Boosted) -> list[str]:
    out: list[str] = []
    for at in range(0, len(htmls), AT_ONCE):
        pages = [parse(h or "") for h in htmls[at : at + AT_ONCE]]
        margin = model.margin(features(pages, model.weights))
        ends = np.cumsum([len(p.tags) for p in pages])
        for page, stop in zip(pages, ends):
            out.append(text_of(page, decode(page.parent, margin[stop - len(page.tags) : stop])))
    return out


# ---------------------------------------------------------------- the job
def _extracted(model: Boosted):
    def run(batches):
        for b in batches:
            texts = main_texts(b.column("html").to_pylist(), model)
            arrays = [b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["page_id", "url", "text", "n_chars"])

    return tidy(run)


def extract(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return narrow.mapInArrow(_extracted(model or train()), "page_id long, url string, text string, n_chars long")
