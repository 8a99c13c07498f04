"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element of a page is a node that is content or not. A node's features give its own log-odds, and each child
has a two by two table of potentials with its parent. Sum-product messages, once up and once down the tree, give every
node's exact probability of being content; text goes with the element that holds it. The weights are those of greatest
conditional likelihood on labelled pages, whose gradient comes from the same messages.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLE = 60
"""Pages of the corpus that lend their blocks to labelled pages, and that are labelled pages themselves where they mark their article."""
LAYOUTS = 2000
"""Pages laid out for training."""
ROUNDS, RATE, DECAY = 300, 0.12, 5e-5
STRETCH = 2_000_000

# HTML's elements by how they are parsed.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("head title script style template noscript svg iframe object canvas".split())
IN_HEAD = set("title meta link script style base noscript template".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY = {  # an element that its like, or one of these, ends; and where the search stops
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
}
KINDS = {  # kinds of child for the potentials
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "text": "p pre blockquote",
    "list": "ul ol dl li dt dd menu",
    "table": "table thead tbody tfoot tr td th caption",
    "figure": "figure figcaption details summary",
    "part": "article main section div body center",
    "landmark": "nav aside header footer form dialog address fieldset",
}
NAMED_PART, NAMED_TEXT, OTHER_KIND = len(KINDS), len(KINDS) + 1, len(KINDS) + 2
KIND = {tag: k for k, tags in enumerate(KINDS.values()) for tag in tags.split()}
PARTS, TEXTS = set(KINDS["part"].split()), set(KINDS["text"].split())
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


class Page(HTMLParser):
    """A page's nodes in page order, a parent before its children, and its text with the node that each part belongs to."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.parent, self.names, self.label = [-1], [["tag=body"]], [0]  # html and body are one node, the root
        self.own, self.linked, self.kind = [0], [0], [OTHER_KIND]
        self.parts: list[tuple[int, str]] = []
        self.open: list[tuple[str, int]] = [("body", 0)]
        self.links, self.skipping = 0, 0
        self.feed(html)
        self.close()

    def _cut(self) -> None:
        self.parts.append((-1, " "))

    def _pop(self, to: int) -> None:
        """Close the open elements from place ``to`` on."""
        for tag, _ in self.open[to:]:
            self.links -= tag == "a"
            self.skipping -= tag in SKIPPED
            if tag not in INLINE:
                self._cut()
        del self.open[to:]

    def _end(self, tags: set[str], stop: set[str]) -> None:
        """Close the outermost of ``tags`` above the innermost open ``stop``."""
        found = None
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in stop:
                break
            if self.open[i][0] in tags:
                found = i
        if found:
            self._pop(found)

    def _out_of_head(self, tag: str) -> None:
        if self.open[-1][0] == "head" and tag not in IN_HEAD:
            self._pop(len(self.open) - 1)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self._out_of_head(tag)
        if tag == "br" or tag == "hr":
            self._cut()
        if tag in VOID or tag == "head" and len(self.open) > 1:
            return
        if tag in ("html", "body"):
            given = self._given(attrs)
            self.names[0], self.label[0] = self._names("body", given), max(self.label[0], int(given.get("data-y") == "1"))
            return
        inline = tag in INLINE
        if not inline and tag not in SKIPPED:
            self._end({"p"}, {"table", "td", "th", "caption", "button", "object", "template", *(KINDS["landmark"].split()), "div", "section", "article", "main", "li", "dd"})
        if tag in CLOSED_BY:
            self._end(*CLOSED_BY[tag])
        node = self.open[-1][1]
        given = self._given(attrs) if attrs else {}
        if tag not in SKIPPED and not self.skipping and (not inline or "class" in given or "id" in given or "role" in given):
            node = self._node(tag, node, given)
        self.open.append((tag, node))
        self.links += tag == "a"
        self.skipping += tag in SKIPPED
        if not inline:
            self._cut()

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # "/" means nothing in HTML

    @staticmethod
    def _given(attrs: list[tuple[str, str | None]]) -> dict[str, str]:
        return {k: v or "" for k, v in attrs if k in ("class", "id", "role", "aria-label", "hidden", "style", "data-y")}

    @staticmethod
    def _names(tag: str, given: dict[str, str]) -> list[str]:
        names = {f"tag={tag}"}
        for k in ("class", "id", "role", "aria-label"):
            for word in _WORD.findall(given.get(k, "")):
                names.add(f"name={word.lower()}")
                names.add(f"name={word.lower()[:5]}*")
        if "hidden" in given or "style" in given and re.search(r"display\s*:\s*none", given["style"]):
            names.add("hidden")
        return sorted(names)

    def _node(self, tag: str, parent: int, given: dict[str, str]) -> int:
        above = next((t for t, _ in reversed(self.open) if t not in INLINE), "")
        place = f"tag={tag} in {above}" if above in ("body", "article", "main", "header", "footer", "aside", "nav", "form") else f"tag={tag} elsewhere"
        self.parent.append(parent)
        self.names.append([*(self._names(tag, given) if given else (f"tag={tag}",)), place])
        self.label.append(int(given["data-y"] == "1") if "data-y" in given else self.label[parent])
        self.own.append(0)
        self.linked.append(0)
        self.kind.append((NAMED_PART if tag in PARTS else NAMED_TEXT) if given and (tag in PARTS or tag in TEXTS or tag in INLINE) else KIND.get(tag, OTHER_KIND))
        return len(self.parent) - 1

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                self._pop(i)
                return
            if tag in INLINE and self.open[i][0] not in INLINE or self.open[i][0] in ("td", "th", "table") and tag in ("p", "li", "b"):
                return

    def handle_data(self, data: str) -> None:
        if self.open[-1][0] == "head" and data.strip():
            self._out_of_head("#text")
        if self.skipping:
            return
        node, size = self.open[-1][1], len(data) if not data.isspace() else 0
        self.own[node] += size
        self.linked[node] += size * (self.links > 0)
        self.parts.append((node, data))

    def text(self, kept: np.ndarray) -> str:
        """The parts of the kept nodes, one space for any white space and between blocks."""
        return " ".join("".join(p for node, p in self.parts if node < 0 or kept[node]).split())

    def features(self) -> list[list[str]]:
        """The names of each node, and its sizes on a scale of powers of two: own text, all text below, shares of links."""
        n = len(self.parent)
        total, links, kids = list(self.own), list(self.linked), [0] * n
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            total[p] += total[i]
            links[p] += links[i]
            kids[p] += 1
        out = []
        for i in range(n):
            own, share, below = self.own[i], _share(self.linked[i], self.own[i]), _share(links[i], total[i])
            out.append([*self.names[i], f"own={min(10, own.bit_length())}", f"links={share}", f"below={min(12, total[i].bit_length())} {below}", f"kids={min(5, kids[i].bit_length())}"])
        return out


def _share(part: int, whole: int) -> str:
    return "none" if not whole else "few" if 5 * part < whole else "some" if 5 * part < 4 * whole else "most"


class Forest:
    """Pages as one forest: node levels for messages, features as numbers of a vocabulary."""

    def __init__(self, pages: list[Page], known: dict[str, int], grow: bool = False):
        parent, kind, label, node, feature, first = [], [], [], [], [], [0]
        for p in pages:
            base = first[-1]
            parent += [x + base if x >= 0 else -1 for x in p.parent]
            kind += p.kind
            label += p.label
            for i, names in enumerate(p.features()):
                for name in names:
                    j = known.setdefault(name, len(known)) if grow else known.get(name)
                    if j is not None:
                        node.append(base + i)
                        feature.append(j)
            first.append(len(parent))
        self.parent, self.kind, self.label, self.first = np.array(parent, np.int64), np.array(kind, np.int64), np.array(label, np.int64), first
        self.node, self.feature = np.array(node, np.int64), np.array(feature, np.int64)
        level = [0] * len(parent)
        for i, x in enumerate(parent):
            if x >= 0:
                level[i] = level[x] + 1
        order = np.argsort(np.array(level, np.int64), kind="stable")
        cuts = np.cumsum(np.bincount(np.array(level, np.int64), minlength=1))
        self.levels = np.split(order, cuts[:-1])
        """Nodes by depth, in page order and so by parent."""
        self.runs = [np.flatnonzero(np.diff(self.parent[at], prepend=-2)) for at in self.levels]

    def messages(self, unary: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(marginals [node], pair marginals [node, of parent, own]): sum-product, from the leaves up and back down.

        ``unary`` is a node's log-odds, ``edges`` [kind of child, of parent, own] the log potentials.
        """
        n = len(self.parent)
        belief = np.zeros((n, 2))
        belief[:, 1] = unary
        up, down = np.zeros((n, 2)), np.zeros((n, 2))
        for at, run in zip(self.levels[:0:-1], self.runs[:0:-1], strict=True):
            both = belief[at][:, None, :] + edges[self.kind[at]]
            up[at] = np.logaddexp(both[:, :, 0], both[:, :, 1])
            belief[self.parent[at][run]] += np.add.reduceat(up[at], run)
        pairs = np.zeros((n, 2, 2))
        for at in self.levels[1:]:
            p = self.parent[at]
            above = (belief[p] - up[at] + down[p])[:, :, None] + edges[self.kind[at]]
            down[at] = np.logaddexp(above[:, 0], above[:, 1])
            pairs[at] = above + belief[at][:, None, :]
        both = belief + down
        marginal = 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -700, 700)))
        pairs = np.exp(pairs - pairs.max(axis=(1, 2), keepdims=True))
        return marginal, pairs / pairs.sum(axis=(1, 2), keepdims=True)

    def unary(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.node, weights[self.feature], len(self.parent))


@dataclass
class Model:
    """Weights of features by name, and log potentials [kind of child, of parent, own]."""

    known: dict[str, int]
    weights: np.ndarray
    edges: np.ndarray

    def contents(self, pages: list[Page]) -> list[np.ndarray]:
        """The content marginals of every page's nodes."""
        forest = Forest(pages, self.known)
        marginal, _ = forest.messages(forest.unary(self.weights), self.edges)
        return [marginal[a:b] for a, b in zip(forest.first, forest.first[1:], strict=False)]


def fit(pages: list[Page], rounds: int = ROUNDS) -> Model:
    """The model of greatest conditional likelihood of the pages' labels: observed less expected counts, by Adam."""
    known: dict[str, int] = {}
    f = Forest(pages, known, grow=True)
    weights, edges = np.zeros(len(known)), np.zeros((OTHER_KIND + 1, 2, 2))
    children = np.flatnonzero(f.parent >= 0)
    seen_edges = np.zeros_like(edges)
    np.add.at(seen_edges, (f.kind[children], f.label[f.parent[children]], f.label[children]), 1)
    by_kind = (f.kind[children] == np.arange(len(edges))[:, None]).astype(float)
    first, second = np.zeros(weights.size + edges.size), np.zeros(weights.size + edges.size)
    for step in range(1, rounds + 1):
        marginal, pairs = f.messages(f.unary(weights), edges)
        g = np.bincount(f.feature, (f.label - marginal)[f.node], len(known)) / len(pages) - DECAY * weights
        expected = (by_kind @ pairs[children].reshape(-1, 4)).reshape(edges.shape)
        g = np.concatenate((g, ((seen_edges - expected) / len(pages) - DECAY * edges).ravel()))
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = RATE * first / (1 - 0.9**step) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
        weights, edges = weights + move[: len(known)], edges + move[len(known) :].reshape(edges.shape)
    return Model(known, weights, edges)


# Names that page authors give to the parts of a page.
CONTENT_NAMES = "article content main post entry story body text article-body post-content entry-content story-body main-content articleBody content-main prose".split()
PLAIN_NAMES = "hl x1 c-2 lead intro first dropcap highlight big center paragraph".split()
FRAME_NAMES = "wrapper container page site row inner outer layout wrap grid app root col column".split()
OTHER_NAMES = {
    "menu": "nav navbar menu navigation main-nav breadcrumb breadcrumbs toc tabs topbar pagination pager links share social sharing follow tags".split(),
    "header": "header masthead site-header top branding logo page-header hero-bar".split(),
    "footer": "footer site-footer copyright colophon legal bottom footnotes-site page-footer".split(),
    "sidebar": "sidebar side aside widget related recommended popular trending secondary rail more-stories".split(),
    "notice": "notice cookie cookies cookie-banner consent alert popup modal newsletter subscribe signup message warning gdpr paywall overlay toast disclaimer banner".split(),
    "advert": "ad ads advert advertisement adsense sponsor sponsored promo promotion ad-slot banner-ad dfp teaser".split(),
    "comments": "comments comment comment-list commentlist replies reply discussion respond disqus reader-comments responses user-comments thread".split(),
    "form": "form search login searchform contact-form search-box signin".split(),
}


class _Layout:
    """A page laid out at random from blocks of text; elements carry their label in ``data-y``."""

    def __init__(self, rnd: random.Random, blocks: list[str]):
        self.rnd, self.blocks = rnd, blocks

    def words(self, most: int) -> str:
        """A few words, as in a menu or a title."""
        words = self.rnd.choice(self.blocks).split() or ["more"]
        return escape(" ".join(words[: self.rnd.randint(1, most)]))

    def prose(self) -> str:
        text = self.rnd.choice(self.blocks)
        words = text.split()
        if self.rnd.random() < 0.4:
            words = words[: self.rnd.randint(2, 25)]
            text = " ".join(words)
        if len(words) > 3 and self.rnd.random() < 0.3:
            i = self.rnd.randrange(len(words) - 1)
            mark = self.rnd.choice(["a href='/x'", "b", "em", "span", "strong", *(f"span class={c}" for c in PLAIN_NAMES[:3])])
            return f"{escape(' '.join(words[:i]))} <{mark}>{escape(' '.join(words[i : i + 3]))}</{mark.split()[0]}> {escape(' '.join(words[i + 3 :]))}"
        return escape(text)

    def element(self, tag: str, name: str, y: int | None, inside: str) -> str:
        by = self.rnd.choice(["class", "class", "id"])
        attrs = f' {by}="{name}"' if name else ""
        return f"<{tag}{attrs}" + (f' data-y="{y}"' if y is not None else "") + f">{inside}</{tag}>"

    def link(self) -> str:
        return f'<a href="/y">{self.words(6)}</a>'

    def links(self) -> str:
        found = [f'<a href="/{i}">{self.words(3)}</a>' for i in range(self.rnd.randint(2, 8))]
        kind = self.rnd.random()
        return "<ul>" + "".join(f"<li>{x}</li>" for x in found) + "</ul>" if kind < 0.6 else " | ".join(found) if kind < 0.8 else "".join(f"<div>{x}</div>" for x in found)

    def other(self, kind: str, bare: bool = True) -> str:
        """A part of the page that is no content."""
        r = self.rnd
        own = {"menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "form": "form", "comments": "section"}.get(kind, "div")
        tag = own if r.random() < 0.5 else r.choice(["div", "section"] if kind != "form" else ["form", "div"])
        if kind in ("advert", "notice") and r.random() < 0.15:
            return self.element(r.choice(["p", "p", "span"]), r.choice(OTHER_NAMES[kind]), 0, self.words(15))
        name = r.choice(OTHER_NAMES[kind])
        if tag not in ("div", "section") and bare and r.random() < 0.5:
            name = ""
        lines = {
            "menu": lambda: self.links(),
            "header": lambda: r.choice([f"<h1>{self.words(4)}</h1>", f"<a href='/'>{self.words(3)}</a>", f"<p>{self.words(8)}</p>", f"<h2>{self.words(4)}</h2><p>{self.words(9)}</p>"]) + (self.links() if r.random() < 0.3 else ""),
            "footer": lambda: r.choice([f"&copy; {self.words(9)}", f"<p>{self.words(15)}</p>", self.links(), f"<p>{self.prose()}</p>", f"<div>{self.words(6)}</div>{self.links()}"]),
            "sidebar": lambda: r.choice([f"<h3>{self.words(3)}</h3>{self.links()}", f"<h2>{self.words(3)}</h2><p>{self.prose()}</p>", f"<p>{self.prose()}</p>", self.links(), self.words(12)]),
            "notice": lambda: r.choice([self.words(15), f"<p>{self.prose()}</p>", f"<p>{self.words(12)}</p><button>{self.words(1)}</button>", f"<strong>{self.words(2)}</strong> {self.words(12)}"]),
            "advert": lambda: r.choice([self.words(12), f"<p>{self.words(20)}</p>", f"<a href='/b'>{self.words(8)}</a>", f"<h4>{self.words(4)}</h4><p>{self.prose()}</p>", self.prose()]),
            "comments": lambda: r.choice([f"<h2>{self.words(2)}</h2>", f"<h3>{self.words(2)}</h3>", ""]) + self.remarks(),
            "form": lambda: f"<label>{self.words(2)}</label><input name=q><button>{self.words(1)}</button>" + (f"<select><option>{self.words(2)}<option>{self.words(2)}</select>" if r.random() < 0.3 else f"<p>{self.words(10)}</p>" if r.random() < 0.4 else ""),
        }
        return self.element(tag, name, 0, lines[kind]())

    def remarks(self) -> str:
        r, out = self.rnd, []
        tag = r.choice(["div", "li", "article", "p"])
        for _ in range(r.randint(1, 5)):
            body = self.prose() if r.random() < 0.3 else f"<p>{self.prose()}</p>" if tag != "p" else self.prose()
            who = r.choice(["", f"<b>{self.words(2)}</b> ", f"<span class='author'>{self.words(2)}</span> "])
            out.append(self.element(tag, r.choice(["comment", "", "reply", "comment-body"]), None, who + body))
        return "".join(out) if tag != "li" else "<ol>" + "".join(out) + "</ol>"

    def article(self, framed: bool = True) -> str:
        """The blocks of the article, with parts that are no content among them now and then; a header only in an element of its own."""
        r, out = self.rnd, []
        if r.random() < 0.8:
            title = f"<h1>{self.words(12)}</h1>"
            out.append(title if r.random() < 0.85 or not framed else self.element("header", "", 1, title))
        for _ in range(r.choice([1, 2, 4, 7, 12])):
            k = r.random()
            if k < 0.62:
                name = f' class="{r.choice(PLAIN_NAMES)}"' if r.random() < 0.08 else ""
                out.append(f"<p{name}>{self.prose()}" + ("</p>" if r.random() < 0.8 else "<br>"))
            elif k < 0.68:
                out.append(f"<p>{self.words(2) if r.random() < 0.8 else self.link()}</p>")
            elif k < 0.74:
                out.append(f"<h{r.choice('234')}>{self.words(6)}</h2>".replace("</h2>", "") + "</h2></h3></h4>")
            elif k < 0.79:
                out.append("<ul>" + "".join(f"<li>{r.choice([self.prose, self.prose, lambda: self.words(5), self.link])()}" for _ in range(r.randint(1, 5))) + "</ul>")
            elif k < 0.83:
                out.append(f"<blockquote>{r.choice(['<p>', ''])}{self.prose()}</blockquote>")
            elif k < 0.87:
                out.append("<table>" + "".join(f"<tr><td>{self.words(3)}<td>{self.words(6)}" for _ in range(r.randint(1, 4))) + "</table>")
            elif k < 0.9:
                out.append(f"<figure><img src=x><figcaption>{self.words(9)}</figcaption></figure>")
            elif k < 0.93:
                out.append(f"<pre>{self.prose()}</pre>")
            elif k < 0.95:
                out.append(f"<div>{self.prose()}</div>")
            elif k < 0.97:
                out.append(f"{self.prose()}<br>")
            else:
                out.append(f"<section><h2>{self.words(4)}</h2><p>{self.prose()}</p></section>")
        for _ in range(r.choice([0, 0, 1, 2])):
            out.insert(r.randrange(len(out) + 1), self.other(r.choice(["advert", "sidebar", "menu", "notice", "form"])))
        if r.random() < 0.4:
            out.append(self.other("comments", False))
        return "".join(out) if r.random() < 0.9 else f"{self.prose()} <b>{self.words(3)}</b> {self.words(4)}"

    def page(self) -> str:
        r, k = self.rnd, self.rnd.random()
        if k < 0.07:  # the blocks stand in the body
            middle = self.article(False)
        else:
            tag, name = ("article", r.choice(["", "", "post", "article"])) if k < 0.45 else ("main", r.choice(["", "content"])) if k < 0.55 else ("section", r.choice(CONTENT_NAMES)) if k < 0.62 else ("div", r.choice(["", r.choice("abcdxyz") + str(r.randint(1, 99))])) if k < 0.72 else ("div", r.choice(CONTENT_NAMES))
            middle = self.element(tag, name, 1, self.article())
        if k >= 0.07 and r.random() < 0.3:
            middle = self.element(r.choice(["div", "div", "main", "section"]), r.choice([*FRAME_NAMES * 2, "content", "main", ""]), 0, middle + (self.other("sidebar") if r.random() < 0.4 else "") + (self.other("comments") if r.random() < 0.2 else ""))
        before = [self.other(kind) for kind in r.sample(["header", "menu", "notice", "advert", "form", "sidebar"], r.randint(0, 4))]
        after = [self.other(kind) for kind in r.sample(["footer", "comments", "sidebar", "notice", "advert", "menu", "form"], r.randint(0, 4))]
        body = "".join([*before, middle, *after])
        for _ in range(r.choice([0, 0, 1, 2]) if k >= 0.07 else 0):
            body = self.element("div", r.choice([*FRAME_NAMES, ""]), 0, body)
        return f"<html><head><title>{self.words(8)}</title></head><body data-y={int(k < 0.07)}>{body}</body></html>"


FILLER = ["one two three", "a short line of text", "some longer text that stands for a block of a page and goes on for a while " * 4, "yes", "text " * 60]


def labelled_pages(pages: list[str], count: int = LAYOUTS, seed: int = 11) -> list[Page]:
    """Pages with labels: those of ``pages`` that mark one article, and ``count`` laid out from the blocks of them all."""
    out, blocks = [], []
    for html in pages:
        p = Page(html)
        text = [" ".join("".join(x for n, x in p.parts if n == i).split()) for i, names in enumerate(p.names) if "tag=p" in names or "tag=div" in names]
        blocks += [t[:2000] for t in text if t]
        if html.lower().count("<article") == 1:
            out.append(Page(re.sub("(?i)<article", "<article data-y=1", html, count=1)))
    rnd = random.Random(seed)
    layout = _Layout(rnd, sorted(set(blocks)) or FILLER)
    return out + [Page(layout.page()) for _ in range(count)]


def train(pages: DataFrame, html: str = "html", key: str = "page_id") -> Model:
    """The model fitted on ``labelled_pages`` of SAMPLE pages, those of the smallest hash of ``key``; fitted on the driver.

    A page of the sample is read whole, up to a million characters. Without pages, blocks of filler are laid out.
    """
    order = F.xxhash64(F.col(key).cast("string"))
    ids = pages.select(order.alias("at")).orderBy("at").limit(SAMPLE)
    last = ids.agg(F.max("at")).head()[0]
    if last is None:
        return fit(labelled_pages([]))
    some = pages.filter((order <= last) & F.col(html).isNotNull() & (F.length(html) <= 1_000_000)).select(html).limit(SAMPLE)
    return fit(labelled_pages(sorted(r[0] for r in some.collect())))


def extract(pages: DataFrame, model: Model, html: str = "html", text: str = "text") -> DataFrame:
    """``pages`` with ``text``, the text of the nodes whose probability of being content is over a half.

    Blocks are in page order, white space is one space, character references are decoded; scripts, styles, comments in the
    markup and the head are never text. A null or empty page has an empty text, and one without elements is its body's
    text, kept or not as a whole. Row-wise and without a shuffle; repeated rows get a row each; a column of that name is replaced.
    """
    out = pages.drop(text)
    at = out.columns.index(html)
    schema = T.StructType([*out.schema, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[str] = []
            for stretch in _stretches(b.column(at)):
                parsed = [Page(h) for h in stretch]
                found += [p.text(m > 0.5) for p, m in zip(parsed, model.contents(parsed), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], schema.names)

    return out.mapInArrow(run, schema)


def _stretches(column: pa.Array) -> Iterator[list[str]]:
    held: list[str] = []
    size = 0
    for x in column:
        held.append(x.as_py() or "")
        size += len(held[-1])
        if size > STRETCH:
            yield held
            held, size = [], 0
    if held:
        yield held
