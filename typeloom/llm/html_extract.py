"""Main text of web pages: gradient-boosted trees over DOM-node features, decoded hierarchically.

The page is parsed into a tree of block elements (and of inline ones that carry attributes); a run of text right in the
body, up to the next block, is a node too. Each node has features of
its subtree (text, links, tags, paragraphs, marks per character), its attribute tokens, depth and siblings. Boosted
trees, trained here on generated pages whose parts are known, give the log-odds that a node holds main text. Decoding
maximises the sum of scores over the tree where a dropped node drops all below it, so no node contradicts its
ancestors. Text of kept nodes is given in page order: character references decoded, white space inside a block one
space, blocks joined by one space.

Edge cases: a null or empty html, or a page without main text, gives an empty text; unclosed and stray tags are
accepted; nothing is cut off in long pages; repeated rows are extracted each; a null page_id or url is kept; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from typeloom.llm.kernels import chunks

#: Element names by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style".split())
SKIPPED = frozenset("script style noscript template svg math iframe object canvas head title select textarea button audio video map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
TAGS = "nav header footer aside article main section form p h1 h2 h3 ul ol li table td blockquote figure pre div body a span #text".split()
TOKENS = "ad ads advert advertisement promo sponsor sponsored banner cookie consent notice alert nav menu navbar header footer sidebar side related widget comment comments reply disqus share social form search subscribe newsletter login breadcrumb breadcrumbs popup modal hidden article content main post entry body story text page meta byline tag tags copyright legal".split()
#: A tag with its quoted values; a tag of a page whose quotes do not close, which ends at the first ">".
_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAME = re.compile(r"</?[a-zA-Z]")
_ATTR = re.compile(r"(class|id|role|style|aria-label|aria-hidden|hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_PART = re.compile(r"[a-z]+")
_MARKS = re.compile(r"[.,;:!?]")
_TOKEN_AT = {t: i for i, t in enumerate(TOKENS)}
_TAG_AT = {t: i for i, t in enumerate(TAGS)}


@dataclass
class Tree:
    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    tokens: list[tuple[int, ...]] = field(default_factory=list)
    own: list[list[int]] = field(default_factory=list)  # text, text in links, marks, inline tags, number of runs
    runs: list[tuple[int, str]] = field(default_factory=list)  # node and text; node -1: a block begins or ends
    names: list[str] = field(default_factory=list)

    def add(self, parent: int, tag: str, tokens: tuple[int, ...], name: str = "") -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(tokens)
        self.names.append(name)
        self.own.append([0, 0, 0, 0, 0])
        return len(self.parent) - 1


def attribute_tokens(attrs: str) -> tuple[int, ...]:
    found = set()
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            found.add(_TOKEN_AT["hidden"])
        elif name in ("class", "id", "role", "aria-label"):
            found.update(_TOKEN_AT[t] for t in _PART.findall(value) if t in _TOKEN_AT)
    return tuple(sorted(found))


class Markup:
    """Finds the markup of a page in time that grows with its length: once a tag's quotes do not close, tags end at the
    first ">"."""

    def __init__(self, page: str):
        self.page, self.last, self.tag = page, page.rfind(">"), _TAG

    def next(self, at: int) -> tuple[int, int, re.Match | None]:
        """Begin and end of the next markup, and its tag (none for comments and declarations); else the page's end."""
        page = self.page
        while 0 <= (at := page.find("<", at)):
            if at > self.last:
                # only a comment needs no ">"
                at = page.find("<!--", at)
                return (at, len(page), None) if at >= 0 else (len(page), len(page), None)
            if page.startswith("<!--", at):
                end = page.find("-->", at + 4)
                return at, end + 3 if end >= 0 else len(page), None
            if page.startswith(("<!", "<?"), at):
                return at, page.index(">", at) + 1, None
            if _NAME.match(page, at):
                m = self.tag.match(page, at)
                if not m:
                    self.tag = _LOOSE
                    m = self.tag.match(page, at)
                if m:
                    return at, m.end(), m
            at += 1
        return len(page), len(page), None


def parse(page: str) -> Tree:
    """The tree of a page. Skipped elements and comments leave no text."""
    tree = Tree()
    node = tree.add(-1, "body", ())
    stack: list[tuple[str, int, bool]] = []  # element, node before it, whether it is a link
    skip, links, at = 0, 0, 0
    run = -1  # the node of the present run of text right in the body

    def here() -> int:
        return run if node == 0 and run >= 0 else node

    def text(raw: str) -> None:
        nonlocal run
        if skip or not raw:
            return
        value = entities.unescape(raw) if "&" in raw else raw
        if node == 0 and run < 0 and value.strip():
            run = tree.add(0, "#text", ())
        tree.runs.append((here(), value))
        if n := len(value.strip()):
            own = tree.own[here()]
            own[0] += n
            own[1] += n if links else 0
            own[2] += len(_MARKS.findall(value))
            own[4] += 1

    open_at: dict[str, list[int]] = {}  # places of open elements in the stack, by name; "": of all that aren't inline
    blocks = open_at.setdefault("", [])

    def latest(names: Iterable[str]) -> int:
        return max((open_at[x][-1] for x in names if open_at.get(x)), default=-1)

    def close(k: int) -> None:
        """Pops the open elements from place k on."""
        nonlocal node, skip, links, run
        while len(stack) > k:
            name, before, link = stack.pop()
            open_at[name].pop()
            links -= link
            if name in SKIPPED:
                skip -= 1
            if name not in INLINE:
                blocks.pop()
                tree.runs.append((-1, ""))
                run = run if name in SKIPPED else -1
            node = before

    scan = Markup(page)
    while True:
        begin, end, m = scan.next(at)
        text(page[at:begin])
        if begin == len(page):
            break
        at = end
        if not m:
            continue
        name = m[2].lower()
        if m[1]:
            # an inline element is not closed across a block
            k = latest((name,))
            if k >= 0 and (name not in INLINE or k > latest(("",))):
                close(k)
            continue
        if name in ("html", "body"):
            continue
        if name in CLOSES_P and blocks and stack[blocks[-1]][0] == "p":
            close(blocks[-1])
        if name in SIBLINGS and (k := latest(SIBLINGS[name])) > latest(SCOPES[name]):
            close(k)
        if name in VOID or m[3].endswith("/"):
            if name in ("br", "hr"):
                tree.runs.append((-1, ""))
            tree.own[here()][3] += 1
            continue
        tokens = attribute_tokens(m[3]) if m[3] else ()
        before = node
        tree.own[here()][3] += 1
        if name not in INLINE:
            tree.runs.append((-1, ""))
            run = run if name in SKIPPED else -1
        if name in SKIPPED:
            skip += 1
        elif not skip and (name not in INLINE or tokens):
            node = tree.add(here(), name, tokens)
        links += name == "a"
        open_at.setdefault(name, []).append(len(stack))
        if name not in INLINE:
            blocks.append(len(stack))
        stack.append((name, before, name == "a"))
        if name in RAW:
            end = re.compile(rf"</{name}", re.I).search(page, at)
            at = end.start() if end else len(page)
    return tree


FEATURES = 16 + len(TAGS) + 2 * len(TOKENS)


def features(tree: Tree) -> np.ndarray:
    """Features of every node: subtree sums, densities, depth, siblings, tag, own and inherited attribute tokens."""
    n = len(tree.parent)
    own = np.array(tree.own, float)
    parent = np.array(tree.parent)
    sums = np.zeros((n, 7))
    sums[:, :5] = own
    sums[:, 5] = [t == "p" for t in tree.tag]
    sums[:, 6] = 1
    children, place, depth, inherited = np.zeros(n), np.zeros(n), np.zeros(n), [()] * n
    for i in range(n - 1, 0, -1):
        sums[parent[i]] += sums[i]
    for i in range(1, n):
        p = tree.parent[i]
        place[i] = children[p]
        children[p] += 1
        depth[i] = depth[p] + 1
        inherited[i] = tuple({*inherited[p], *tree.tokens[p], *((_TOKEN_AT[tree.tag[p]],) if tree.tag[p] in _TOKEN_AT else ())})
    up = np.maximum(parent, 0)
    text = sums[:, 0]
    total = max(text[0], 1.0)
    x = np.zeros((n, FEATURES), np.float32)
    x[:, 0], x[:, 1], x[:, 2] = np.log1p(text), sums[:, 1] / np.maximum(text, 1), sums[:, 2] / np.maximum(text, 1)
    x[:, 3], x[:, 4] = np.log1p(text / np.maximum(sums[:, 3] + sums[:, 6], 1)), sums[:, 5]
    x[:, 5], x[:, 6], x[:, 7] = depth, place, children
    x[:, 8], x[:, 9], x[:, 10] = text / total, text / np.maximum(text[up], 1), place / np.maximum(children[up], 1)
    x[:, 11], x[:, 12], x[:, 13] = np.log1p(own[:, 0]), text / np.maximum(sums[:, 4], 1), children[up]
    x[:, 14], x[:, 15] = sums[up, 1] / np.maximum(text[up], 1), sums[up, 5]
    at = 16 + len(TAGS)
    for i, t in enumerate(tree.tag):
        if t in _TAG_AT:
            x[i, 16 + _TAG_AT[t]] = 1
        for k in tree.tokens[i]:
            x[i, at + k] = 1
        for k in inherited[i]:
            x[i, at + len(TOKENS) + k] = 1
    return x


@dataclass
class Boosted:
    """Trees of equal depth as arrays: feature and threshold of each inner node, value of each leaf."""

    depth: int
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (len(f))]
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.3, penalty: float = 1.0, bins: int = 24) -> Boosted:
    """Second-order boosting of the logistic loss on binned features."""
    two = [f for f in range(x.shape[1]) if set(np.unique(x[:, f]).tolist()) <= {0.0, 1.0}]
    cuts = {f: np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1]) if f not in two}
    binned = {f: np.searchsorted(c, x[:, f], "left") for f, c in cuts.items()}
    flags = np.ascontiguousarray(x[:, two].T, np.float64)
    base = float(np.log(y.mean() / (1 - y.mean())))
    score = np.full(len(x), base)
    inner = 2**depth - 1
    feats, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(len(x), np.int64)
        f_of, t_of = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, wide = 2**level - 1, 2**level
            here = at - first
            gain_best = np.full(wide, 1e-6)
            choices = []
            for f, c in cuts.items():
                k = len(c) + 1
                cell = here * k + binned[f]
                gs = np.bincount(cell, g, wide * k).reshape(wide, k).cumsum(1)
                hs = np.bincount(cell, h, wide * k).reshape(wide, k).cumsum(1)
                choices.append((np.full(k - 1, f), c, gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]))
            if two:
                # flags all at once: sums where the flag is unset
                spread = np.zeros((len(x), 2 * wide))
                spread[np.arange(len(x)), here], spread[np.arange(len(x)), wide + here] = g, h
                all_sums, set_sums = spread.sum(0), flags @ spread
                gt, ht = all_sums[:wide, None], all_sums[wide:, None]
                choices.append((np.array(two), np.full(len(two), 0.5), gt - set_sums[:, :wide].T, ht - set_sums[:, wide:].T, gt, ht))
            for fs, c, gl, hl, gt, ht in choices:
                gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
                b = gain.argmax(1)
                top = gain[np.arange(wide), b]
                better = top > gain_best
                gain_best[better] = top[better]
                f_of[first : first + wide][better], t_of[first : first + wide][better] = fs[b][better], c[b][better]
            at = 2 * at + 1 + (x[np.arange(len(x)), f_of[at]] > t_of[at])
        leaf = at - inner
        v = rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + penalty)
        score += v[leaf]
        feats.append(f_of)
        thresholds.append(t_of)
        values.append(v)
    return Boosted(depth, np.array(feats), np.array(thresholds), np.array(values), base)


class Pages:
    """Generated pages for training. Main parts carry a mark in their text that tells them from the rest."""

    MARK = "⁠"

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = ["".join(r.choice("ba re ti on he th er an is ou la mi".split()) for _ in range(r.randint(1, 4))) for _ in range(r.randint(low, high))]
        for i in range(len(out)):
            if r.random() < 0.1:
                out[i] += r.choice([".", ",", ".", "!", "?"])
        return " ".join(out).capitalize() + r.choice([".", "", "."])

    def list_of_links(self) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{self.words(1, 3)}</a></li>' for i in range(self.r.randint(2, 9))) + "</ul>"

    def boiler(self) -> str:
        r = self.r
        cls = lambda *names: r.choice([f' class="{r.choice(names)}"', f' id="{r.choice(names)}"', f' class="x {r.choice(names)} y"'])
        few, some, much = self.words(1, 6), self.words(5, 20), self.words(15, 60)
        kind = r.randrange(16)
        if kind == 0:
            return f"<nav{r.choice(['', cls('menu', 'navbar', 'main-menu')])}>{self.list_of_links()}</nav>"
        if kind == 1:
            return f"<div{cls('nav', 'menu', 'navbar', 'breadcrumb', 'breadcrumbs')}>{r.choice([self.list_of_links(), few])}</div>"
        if kind == 2:
            return f"<header{r.choice(['', cls('header', 'page-header')])}><a href='/'>{few}</a>{r.choice(['', f'<p>{some}</p>', self.list_of_links()])}</header>"
        if kind == 3:
            return f"<footer{r.choice(['', cls('footer')])}>{r.choice(['&copy; ', '', '<p>'])}{some} {r.choice(['', '<p>' + much + '</p>'])}</footer>"
        if kind == 4:
            return f"<div{cls('footer', 'copyright', 'legal')}><p>{some}</p></div>"
        if kind == 5:
            return f"<aside{r.choice(['', cls('sidebar', 'related', 'widget')])}><h3>{few}</h3>{r.choice([self.list_of_links(), f'<p>{much}</p>'])}</aside>"
        if kind == 6:
            return f"<div{cls('sidebar', 'side', 'related', 'widget', 'related-posts')}><h3>{few}</h3>{r.choice([self.list_of_links(), f'<p>{some}</p>'])}</div>"
        if kind in (7, 8, 9):
            return f"<{(t := r.choice(['div', 'section', 'p', 'div']))}{cls('ad', 'ads', 'advert', 'advertisement', 'promo', 'sponsored', 'banner', 'ad-slot')}>{r.choice([few, some, much, f'<p>{some}</p>'])}</{t}>"
        if kind == 10:
            return f"<div{cls('cookie', 'cookie-notice', 'consent', 'notice', 'alert', 'popup', 'modal')}>{r.choice(['', '<p>'])}{r.choice([some, much])}<button>{few}</button></div>"
        if kind == 11:
            return f"<form{r.choice(['', cls('search', 'newsletter', 'login', 'subscribe')])}><label>{few}</label><input name='q'><p>{some}</p><select><option>{few}</option></select></form>"
        if kind == 12:
            t, c = r.choice(["section", "div"]), r.choice(["div", "article", "li"])
            said = "".join(f"<{c}{r.choice(['', cls('comment', 'reply')])}><p>{self.words(5, 60)}</p></{c}>" for _ in range(r.randint(1, 5)))
            return f"<{t}{cls('comments', 'comment-list', 'disqus')}><h2>{few}</h2>{said}</{t}>"
        if kind == 13:
            return f"<div{cls('share', 'social')}><a href='#'>{few}</a> <a href='#'>{few}</a></div>"
        if kind == 14:
            return f"<div{r.choice([' hidden', ' style=\"display:none\"'])}><p>{much}</p></div>"
        return f"<div{cls('subscribe', 'newsletter', 'login', 'meta', 'tags')}><p>{some}</p></div>"

    def article(self) -> str:
        r, k = self.r, self.MARK
        parts = [f"<h1>{k}{self.words(2, 10)}</h1>"] if r.random() < 0.85 else []
        for _ in range(r.choice([1, 1, 1, 2, 2, 3, 5, 8, 14])):
            kind = r.random()
            body = k + self.words(1, 4 if kind < 0.15 else 90)
            if r.random() < 0.2:
                body += f" <a href='/x'>{self.words(1, 3)}</a> {self.words(1, 9)}"
            if kind < 0.72:
                parts.append(f"<p>{r.choice(['', '<b>'])}{body}{r.choice(['</p>', '</p>', '<br>', ''])}")
            elif kind < 0.78:
                parts.append(f"<h{r.choice('234')}>{k}{self.words(1, 6)}</h2>".replace("</h2>", "</h2>"))
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{k}{self.words(1, 14)}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.92:
                parts.append(f"<blockquote><p>{body}</p></blockquote>")
            elif kind < 0.96:
                parts.append(f"<table><tr><td>{k}{self.words(1, 5)}</td><td>{k}{self.words(1, 5)}</td></tr></table>")
            else:
                parts.append(f"<div>{body}</div>")
            if r.random() < 0.06:
                parts.append("</p>" + self.boiler())
        if r.random() < 0.1:
            return "".join(parts)
        rest = ""
        if len(parts) > 1 and r.random() < 0.06:
            # a stray closing tag leaves the rest in the body
            cut = r.randrange(1, len(parts))
            parts, rest = parts[:cut], r.choice(["", self.bare()]) + "".join(parts[cut:])
        body = "".join(parts)
        name = r.choice(["content", "main-content", "post", "entry", "article", "story", "entry-content", "post-body", "text"])
        return rest and f"<{(t := r.choice(['article', 'main', 'div']))}>{body}</{t}>{rest}</{t}>" or r.choice([f"<article>{body}</article>"] * 3 + [f"<article class='{name}'>{body}</article>", f"<main>{body}</main>", f"<main><article>{body}</article></main>", f"<div class='{name}'>{body}</div>", f"<div id='{name}'>{body}</div>", f"<div>{body}</div>", f"<section>{body}</section>"])

    def bare(self) -> str:
        """A main part whose text is right in the body."""
        r, k = self.r, self.MARK
        lines = []
        for _ in range(r.choice([1, 1, 2, 2, 3, 5, 8])):
            line = k + self.words(1, r.choice([3, 20, 90]))
            if r.random() < 0.3:
                line += r.choice([f" <a href='/x'>{self.words(1, 3)}</a> ", f" <b>{self.words(1, 4)}</b> ", f" <em>{self.words(1, 4)}</em> "]) + self.words(1, 20)
            lines.append(f"<p>{line}</p>" if r.random() < 0.15 else line)
        head = r.choice(["", "", f"<h1>{k}{self.words(2, 10)}</h1>"])
        return head + r.choice(["<br>", "<br><br>", "<br>\n", "\n"]).join(lines)

    def stray(self) -> str:
        """Text right in the body that belongs to no main part."""
        r = self.r
        return r.choice([self.words(1, 4), f"&copy; {self.words(1, 6)}", " | ".join(f"<a href='/{i}'>{self.words(1, 3)}</a>" for i in range(r.randint(1, 6)))])

    def page(self) -> str:
        r = self.r
        before = "".join(self.boiler() for _ in range(r.randint(0, 4)))
        after = "".join(self.boiler() for _ in range(r.randint(0, 4)))
        before = before and r.choice(["", "", "", self.stray()]) + before
        after = after and after + r.choice(["", "", "", self.stray()])
        if r.random() < 0.2:
            return f"<html><head><title>{self.words(2, 6)}</title></head><body>{before}{self.bare()}{after}{r.choice(['</body></html>', ''])}"
        main = self.article()
        if r.random() < 0.3:
            main = f"<div class='{r.choice(['wrap', 'page', 'container', 'row'])}'>{main}{r.choice(['', self.boiler()])}</div>"
        return f"<html><head><title>{self.words(2, 6)}</title></head><body>{before}{main}{after}{r.choice(['</body></html>', ''])}"


@lru_cache(maxsize=1)
def model(pages: int = 1400, seed: int = 11) -> Boosted:
    """The trees, trained on generated pages; the same at every call."""
    maker, xs, ys = Pages(seed), [], []
    for _ in range(pages):
        tree = parse(maker.page())
        y = np.zeros(len(tree.parent))
        for node, value in tree.runs:
            while node >= 0 and Pages.MARK in value and not y[node]:
                y[node] = 1
                node = tree.parent[node]
        xs.append(features(tree))
        ys.append(y)
    return boost(np.concatenate(xs), np.concatenate(ys))


def decode(parent: list[int], score: np.ndarray) -> list[bool]:
    """Kept nodes of the best tree labelling in which nothing below a dropped node is kept."""
    n = len(parent)
    keep = score.tolist()
    for i in range(n - 1, 0, -1):
        keep[parent[i]] += max(keep[i], 0.0)
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and keep[i] > 0
    return kept


def page_text(tree: Tree, kept: list[bool]) -> str:
    blocks, block = [], []
    for node, value in (*tree.runs, (-1, "")):
        if node >= 0:
            if kept[node]:
                block.append(value)
        elif block:
            blocks.append(" ".join("".join(block).split()))
            block = []
    return " ".join(b for b in blocks if b)


def extract_all(pages: list[str | None], trees: Boosted) -> list[str]:
    parsed = [parse(p or "") for p in pages]
    scores = trees.score(np.concatenate([features(t) for t in parsed])) if parsed else np.zeros(0)
    out, at = [], 0
    for t in parsed:
        n = len(t.parent)
        kept = decode(t.parent, scores[at : at + n])
        # a page without elements is all main text
        if all(tag == "#text" for tag in t.tag[1:]):
            kept = [True] * n
        out.append(page_text(t, kept))
        at += n
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars: the main text of every page."""
    trees = model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html"):
            texts = extract_all(batch.column(2).to_pylist(), trees)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
