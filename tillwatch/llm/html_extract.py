"""Main text of web pages: boosted trees judge the nodes of the page, and a consistent choice of nodes is decoded.

A page is read into a tree of its block elements, of inline elements that carry a class, id or role, and of labels and elements
that HTML does not know; other inline markup belongs to the node around it. Scripts, styles and the like are left out. Each
node gets features: its kind, words in its class, id, role and own name and those of its ancestors, depth, size and density of its
subtree, links, and how it compares with its siblings. Boosted trees, trained on pages written by rule, give the probability
that the subtree holds main text. Dropping a node drops all below it and keeping a node keeps all above it, so the best choice
under this condition is found bottom up over the tree: no node is kept inside a dropped one.

The text is the blocks in page order, without the pieces of dropped nodes; a block is a stretch of text between two block tags.
Reading takes time in proportion to the page, also where elements are nested deep or never closed.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from html import escape, unescape
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.llm import gbt
from tillwatch.llm.memory import small_batches, tidied, trim

# HTML's elements by role.
BLOCKS = (
    "html body main article section div header footer nav aside form fieldset ul ol li dl dt dd table thead tbody tfoot tr td th caption "
    "p h1 h2 h3 h4 h5 h6 blockquote pre figure figcaption address details summary dialog menu center hgroup search"
).split()
INLINE = (
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd map mark meter nobr output picture progress q rp rt ruby s samp slot "
    "small span strike strong sub sup time tt u var"
).split()
SKIPPED = "script style template noscript title iframe object svg canvas audio video select textarea button option datalist".split()
NESTED = "template noscript object svg canvas audio video".split()  # one may hold another of its kind
ENDED = "button option datalist".split()  # the end of an element around them ends them
VOID = "area base br col embed hr img input link meta source track wbr".split()
CLOSES_P = set(BLOCKS) - {"html", "body", "td", "th", "tr", "thead", "tbody", "tfoot", "caption", "li", "dt", "dd", "summary", "figcaption"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
ATTRIBUTE_WORDS = (
    "ad ads advert advertisement advertising banner promo promotion sponsor sponsored nav navigation navbar menu breadcrumb breadcrumbs toolbar "
    "header masthead logo footer copyright legal sidebar side aside widget rail related recommended popular trending share social follow "
    "comment comments reply respond discussion disqus form login search subscribe newsletter signup cookie consent notice alert warning popup modal "
    "content article post entry story main body text page blog wrapper container row column inner hidden pagination pager tags tag meta author byline"
).split()

BLOCK_NAMES, INLINE_NAMES, SKIPPED_NAMES = set(BLOCKS) - {"html", "body"}, set(INLINE), set(SKIPPED)
IGNORED = {"html", "head", "body", *VOID}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
GROUPS = ["article", "main", "section", "div", "header", "footer", "nav", "aside", "form", "ul", "ol", "li", "table", "p", "blockquote", "figure", "body", "inline", "custom", "label"]
GROUP_BITS = {name: 1 << k for k, name in enumerate(GROUPS)}
WORD_BITS = {name: 1 << (len(GROUPS) + k) for k, name in enumerate(ATTRIBUTE_WORDS)}
BITS = len(GROUPS) + len(ATTRIBUTE_WORDS)
NUMBERS = 22
ROWS = 20_000  # nodes whose features are held at a time
RESULT = T.StringType()


class Page(HTMLParser):
    """The tree of a page, as flat lists in page order.

    ``marks`` and ``above`` are bits: the kind and words of a node, and those of the nodes around it. A block is a list of
    pieces [node, text, characters within links].
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.kind, self.parent, self.depth, self.marks, self.above, self.inputs = ["body"], [-1], [0], [GROUP_BITS["body"]], [0], [0]
        self.blocks: list[list[list]] = []
        self.parts: list[list] = []
        self.open = [0]  # nodes
        self.solid = [(0, 0)]  # open blocks: place in open, and how much inline markup was open before
        self.at = defaultdict(list)  # places in open by kind, of blocks
        self.inline: list[tuple[str, int]] = []  # open inline markup, and its place in open or -1
        self.inline_at = defaultdict(list)
        self.skip, self.deep, self.inner, self.links = "", 0, Counter(), 0

    def flush(self) -> None:
        if self.parts and any(text and not text.isspace() for _, text, _ in self.parts):
            self.blocks.append(self.parts)
        self.parts = []

    def add(self, text: str) -> None:
        node, linked = self.open[-1], len(text) if self.links else 0
        if self.parts and self.parts[-1][0] == node:
            self.parts[-1][1] += text
            self.parts[-1][2] += linked
        else:
            self.parts.append([node, text, linked])

    def forget(self, size: int) -> None:
        """Inline markup beyond the first ``size`` is no longer open."""
        while len(self.inline) > size:
            self.inline_at[self.inline.pop()[0]].pop()

    def close_to(self, place: int) -> None:
        self.flush()
        while self.solid[-1][0] >= place:
            at, size = self.solid.pop()
            self.at[self.kind[self.open[at]]].pop()
            self.forget(size)
        del self.open[place:]
        self.links = 0

    def node(self, kind: str, tag: str, attrs) -> None:
        marks = GROUP_BITS.get(kind, 0)
        named = " ".join(v for k, v in attrs if v and k in ("class", "id", "role"))
        if named or kind == "custom":
            if kind == "custom":
                named = f"{tag} {named}"
            for word in re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()):
                marks |= WORD_BITS.get(word, 0)
        up = self.open[-1]
        self.open.append(len(self.kind))
        self.kind.append(kind)
        self.parent.append(up)
        self.depth.append(self.depth[up] + 1)
        self.marks.append(marks)
        self.above.append(self.above[up] | self.marks[up])
        self.inputs.append(0)

    def handle_starttag(self, tag, attrs):
        if self.skip:
            if tag == self.skip and tag in NESTED:
                self.deep += 1
            elif tag in BLOCK_NAMES:
                self.inner[tag] += 1
            elif self.skip == "select" and tag in ("input", "textarea"):
                self.skip = ""
                self.handle_starttag(tag, attrs)
        elif tag in SKIPPED_NAMES:
            self.skip, self.deep, self.inner = tag, 1, Counter()
            if tag in ("button", "select", "textarea"):
                self.inputs[self.open[-1]] += 1
        elif tag in BLOCK_NAMES:
            self.start_block(tag, attrs)
        elif tag in IGNORED:
            if tag == "br":
                self.add(" ")
            elif tag == "hr":
                self.flush()
            elif tag == "input":
                self.inputs[self.open[-1]] += 1
        else:
            kind = "label" if tag == "label" else "inline" if tag in INLINE_NAMES else "custom"
            own = kind != "inline" or any(v for k, v in attrs if k in ("class", "id", "role"))
            if own:
                self.node(kind, tag, attrs)
            self.inline_at[tag].append(len(self.inline))
            self.inline.append((tag, len(self.open) - 1 if own else -1))
            if tag == "a":
                self.links += 1

    def handle_startendtag(self, tag, attrs):
        if tag in IGNORED or self.skip:
            self.handle_starttag(tag, attrs)
        else:  # as browsers do, the slash is not seen, but in svg and unknown elements that hold nothing
            self.handle_starttag(tag, attrs)
            if tag in SKIPPED_NAMES and tag in NESTED:
                self.handle_endtag(tag)

    def start_block(self, tag, attrs):
        self.flush()
        if tag in CLOSES_P and self.kind[self.open[self.solid[-1][0]]] == "p":
            self.close_to(self.solid[-1][0])
        if tag in CLOSED_BY:
            scope = max((self.at[s][-1] for s in SCOPES[tag] if self.at[s]), default=-1)
            ends = [self.at[e][-1] for e in CLOSED_BY[tag] if self.at[e] and self.at[e][-1] > scope]
            if ends:
                self.close_to(min(ends))
        self.node(tag, tag, attrs)
        self.at[tag].append(len(self.open) - 1)
        self.solid.append((len(self.open) - 1, len(self.inline)))
        self.links = 0

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip:
                self.deep -= 1
                if not self.deep:
                    self.skip = ""
            elif tag in BLOCK_NAMES and self.inner[tag]:
                self.inner[tag] -= 1
            elif self.skip in ENDED and tag in BLOCK_NAMES and self.at[tag]:
                self.skip = ""
                self.handle_endtag(tag)
        elif tag in BLOCK_NAMES:
            if self.at[tag]:
                self.close_to(self.at[tag][-1])
        else:
            places = self.inline_at.get(tag)
            if places and places[-1] >= self.solid[-1][1]:
                ended = [at for _, at in self.inline[places[-1] :] if at >= 0]
                self.forget(places[-1])
                if ended:
                    del self.open[ended[0] :]
                if tag == "a":
                    self.links = max(0, self.links - 1)

    def handle_data(self, data):
        if not self.skip:
            self.add(data)

    def finish(self, html: str) -> "Page":
        self.feed(html)
        self.close()
        self.flush()
        return self


class Features:
    """The features of all nodes of some pages, one row per node; rows are made some at a time."""

    def __init__(self, pages: Sequence[Page]):
        sizes = np.array([len(p.kind) for p in pages])
        heads = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        root = np.repeat(heads, sizes)
        parent = np.array([x for p in pages for x in p.parent]) + root
        parent[heads] = -1
        depth = np.array([x for p in pages for x in p.depth])
        kinds = [k for p in pages for k in p.kind]
        # sums over subtrees: characters, in links, blocks, marks, words, inputs, nodes, items, paragraphs, headings, inline nodes
        sums = np.zeros((n, 11))
        for head, page in zip(heads.tolist(), pages, strict=True):
            for block in page.blocks:
                for node, text, linked in joined(block):
                    sums[head + node, :5] += (len(text), min(linked, len(text)), 1, sum(text.count(m) for m in ".,;!?"), text.count(" ") + 1)
        own = sums[:, 0].copy()
        sums[:, 5] = [x for p in pages for x in p.inputs]
        sums[:, 6] = 1
        for column, wanted in ((7, {"li"}), (8, {"p"}), (9, HEADINGS), (10, {"inline"})):
            sums[:, column] = [k in wanted for k in kinds]
        order = np.argsort(depth, kind="stable")
        starts = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
        for a, b in zip(starts[-2::-1].tolist(), starts[:0:-1].tolist(), strict=True):  # deepest first
            level = order[a:b]
            np.add.at(sums, parent[level], sums[level])
        chars, linked, blocks, marks, words, inputs, size, items, paragraphs, heads_below, inline = sums.T
        inner = np.flatnonzero(parent >= 0)
        count = np.bincount(parent[inner], minlength=n).astype(float)
        place = np.zeros(n)
        by_parent = inner[np.argsort(parent[inner], kind="stable")]
        family = parent[by_parent]
        first = np.append(True, family[1:] != family[:-1]) if len(family) else np.zeros(0, dtype=bool)
        place[by_parent] = np.arange(len(by_parent)) - np.maximum.accumulate(np.where(first, np.arange(len(by_parent)), 0))
        up = np.maximum(parent, 0)
        up[heads] = heads
        self.numbers = np.stack([
            np.log1p(chars), np.log1p(words), chars / np.maximum(chars[root], 1), chars / np.maximum(chars[up], 1), linked / np.maximum(chars, 1), marks / np.maximum(words, 1),
            chars / np.maximum(blocks, 1), np.log1p(blocks), np.log1p(size), chars / size, np.log1p(own), depth, place, place / np.maximum(count[up], 1), count[up],
            (chars[up] - chars) / np.maximum(count[up] - 1, 1) / np.maximum(chars, 1), inputs, items / size, paragraphs / size, heads_below, [k in HEADINGS for k in kinds], inline / size,
        ], axis=1).astype(np.float32)
        low = (1 << 64) - 1
        marks_of = [[x for p in pages for x in getattr(p, name)] for name in ("marks", "above")]
        self.bits = [[np.array([(x >> shift) & low for x in own], dtype=np.uint64) for shift in (0, 64)] for own in marks_of]

    def __len__(self) -> int:
        return len(self.numbers)

    def rows(self, a: int, b: int) -> np.ndarray:
        out = np.empty((min(b, len(self)) - a, NUMBERS + 2 * BITS), dtype=np.float32)
        out[:, :NUMBERS] = self.numbers[a:b]
        for k, own in enumerate(self.bits):
            for bit in range(BITS):
                out[:, NUMBERS + k * BITS + bit] = (own[bit // 64][a:b] >> np.uint64(bit % 64)) & np.uint64(1)
        return out

    def score(self, model: dict) -> np.ndarray:
        return np.concatenate([gbt.score(model, self.rows(a, a + ROWS)) for a in range(0, len(self), ROWS)] or [np.zeros(0)])


def joined(block: list[list]) -> list[tuple[int, str, int]]:
    """The text of each node in a block, white space made one space, and its characters in links; nodes without text are left out."""
    if len(block) == 1:
        node, text, linked = block[0]
        return [(node, " ".join(text.split()), linked)]
    texts, links = defaultdict(list), Counter()
    for node, text, linked in block:
        texts[node].append(text)
        links[node] += linked
    found = ((node, " ".join("".join(parts).split()), links[node]) for node, parts in texts.items())
    return [x for x in found if x[1]]


def text_of(block: list[list], kept: Callable[[int], bool]) -> str:
    return " ".join("".join(text if kept(node) else " " for node, text, _ in block).split())


def decode(parent: list[int], odds: np.ndarray) -> list[bool]:
    """The likeliest choice of nodes in which every kept node's parent is kept. The root is always kept; ties keep."""
    n = len(parent)
    keep, drop = -np.logaddexp(0, -odds), -np.logaddexp(0, odds)
    best_kept, all_dropped = keep.copy(), drop.copy()
    for i in range(n - 1, 0, -1):
        best_kept[parent[i]] += max(best_kept[i], all_dropped[i])
        all_dropped[parent[i]] += all_dropped[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and bool(best_kept[i] >= all_dropped[i])
    return kept


# --- pages to learn from -------------------------------------------------------------------------


def labelled_page(rng: random.Random) -> tuple[str, set[str]]:
    """A page written by rule, and its blocks of main text."""
    syllables = "the an on ing tion er re st ou ent sch lich keit ung ver que eau ment aux ción os ra do mente es en".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    mark = rng.choice(["", "", "", "", "%%%", "&&&", "###"])
    phrase = lambda n: " ".join(word() + (mark if mark and rng.random() < 0.9 else "") for _ in range(n))
    numbered = iter(range(10**6))
    main: set[str] = set()

    def sentence(low: int = 1, high: int = 30) -> str:
        return (phrase(rng.randint(low, high)) + f" x{next(numbered)}.").capitalize()

    def told(low: int = 1, high: int = 60) -> str:
        if rng.random() < 0.1:  # short blocks
            text = f"{phrase(rng.randint(1, 3))} x{next(numbered)}{rng.choice([',', '.', '', '|'])}"
            main.add(" ".join(text.split()))
            return escape(text, quote=False)
        text = " ".join(sentence() for _ in range(rng.randint(1, 4))) if rng.random() < 0.7 else sentence(low, high)
        main.add(" ".join(text.split()))
        return escape(text, quote=False)

    def title(low: int, high: int) -> str:
        """Most headings have no full stop."""
        if rng.random() < 0.4:
            return told(low, high)
        text = f"{phrase(rng.randint(low, high))} x{next(numbered)}{rng.choice(['', '', '', '?'])}".capitalize()
        main.add(" ".join(text.split()))
        return escape(text, quote=False)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{phrase(rng.choice([1, 1, 2, 4]))}{rng.choice(["", "", ",", "."])}</a></li>' for _ in range(n))

    def named(tag: str, names: list[str], inner: str) -> str:
        name = rng.choice(names)
        attr = f' class="{name}"' if rng.random() < 0.7 else f' id="{name}"'
        return f"<{tag}{attr if name else ''}>{inner}</{tag}>"

    strange = lambda: rng.choice(["c", "x1", "col-8", "b2", "left", "u-1", "grid", "box", "layer", "wide", "area", word(), word() + str(rng.randint(1, 9))])
    prose = lambda: escape(" ".join(sentence(2, 14) for _ in range(rng.randint(1, 3))), quote=False)
    clutter = [
        lambda: f"<nav><ul>{links(rng.randint(3, 9))}</ul></nav>",
        lambda: named("div", ["nav", "menu", "main-menu", "navbar", "breadcrumbs", "pagination"], f"<ul>{links(rng.randint(2, 8))}</ul>"),
        lambda: named("div", ["ad", "ads", "ad-banner", "advert", "sponsored", "promo-box"], prose()),
        lambda: named("aside", ["sidebar", "related", "widget", ""], f"<h3>{phrase(2)}</h3><ul>{links(rng.randint(2, 6))}</ul>"),
        lambda: named("aside", ["sidebar", "side-bar", "promo", ""], f"<h4>{phrase(3)}</h4><p>{prose()}</p>"),
        lambda: named("div", ["sidebar", "right-rail", "related-posts", "popular"], f"<h3>{phrase(2)}</h3><p>{prose()}</p><ul>{links(4)}</ul>"),
        lambda: named("div", ["cookie-notice", "notice", "cookie-consent", "alert", "newsletter", "popup"], f"<p>{prose()}</p><button>OK</button>"),
        lambda: f'<form action="/s"><label>{phrase(2)}</label><input name="q"><p>{prose()}</p><button>Go</button></form>',
        lambda: named("div", ["share", "social-links", "follow"], f'<a href="#">{phrase(1)}</a> <a href="#">{phrase(1)}</a>'),
        lambda: named(rng.choice(["div", "section", "td"][:2]), [strange(), ""], rng.choice([f"<ul>{links(rng.randint(3, 9))}</ul>", " | ".join(f'<a href="/{word()}">{phrase(rng.randint(1, 3))}</a>' for _ in range(rng.randint(3, 8)))])),
        lambda: f"<ul>{links(rng.randint(3, 9))}</ul>",
        lambda: "<p>" + rng.choice([" | ", " ", " &middot; "]).join(f'<a href="/{word()}">{phrase(rng.randint(1, 2))}</a>' for _ in range(rng.randint(3, 8))) + "</p>",
        lambda: (lambda tag: f"<{tag}>{rng.choice([prose(), f'<p>{prose()}</p>', f'<ul>{links(4)}</ul>'])}</{tag}>")(rng.choice(["cookie-banner", "site-nav", "app-header", "site-footer", "ad-slot", "x-promo", "share-bar", "news-letter-signup"])),
        lambda: named(rng.choice(["span", "a"]), ["ad", "advert", "sponsored", "promo", "share", "cookie-notice"], prose()),
    ]
    comments = [
        lambda: named("section", ["comments", "comment-list", "discussion"], f"<h2>{phrase(2)}</h2>" + "".join(named("div", ["comment", "reply"], f"<p><b>{word()}</b> {prose()}</p>") for _ in range(rng.randint(1, 5)))),
        lambda: named("div", ["comments", "disqus", "respond"], "<ul>" + "".join(f"<li><p>{prose()}</p></li>" for _ in range(rng.randint(1, 5))) + "</ul>"),
        lambda: named("div", ["comments", "comment-list", "reader-comments", "discussion"], f"<h3>{rng.randint(1, 9)} {phrase(1)}</h3>" + "".join(f"<p>{prose()}</p>" for _ in range(rng.randint(1, 5)))),
    ]
    foot = [
        lambda: f"<footer>&copy; {word()}.example.com &middot; {prose()}</footer>",
        lambda: named("div", ["footer", "site-footer", "copyright"], f"<p>&copy; {prose()}</p><ul>{links(3)}</ul>"),
        lambda: f"<footer><p>{prose()}</p><ul>{links(3)}</ul></footer>",
    ]
    def within(html: str) -> str:
        """Inline markup in a paragraph: kept words with names of their own, or clutter."""
        kind = rng.random()
        if kind < 0.06:
            tag, name = rng.choice(["span", "em", "a", "b", "mark", "code"]), rng.choice(["hl", "term", "ref", "note-1", "u", "link", "first", strange()])
            words = phrase(rng.randint(1, 5))
            main.add(" ".join((unescape(html) + " " + words).split()))
            return f'{html} <{tag} class="{name}">{escape(words, quote=False)}</{tag}>'
        if kind < 0.12:
            tag, name = rng.choice(["span", "a", "b"]), rng.choice(["ad", "advert", "ads", "sponsored", "promo", "share-link", "social", "cookie-notice", "popup", "newsletter"])
            return f'{html} <{tag} class="{name}">{rng.choice([prose(), phrase(rng.randint(1, 4))])}</{tag}>'
        if kind < 0.14:
            return f"{html} <label>{phrase(2)}</label>"
        return html

    paragraphs = []
    loose = rng.random() < 0.4
    for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 4, 5, 6, 8, 10, 12])):
        kind = rng.random()
        if kind < 0.75:
            paragraphs.append(f"<p><b>{told()}<br>" if loose and rng.random() < 0.3 else f"<p>{within(told())}</p>")
        elif kind < 0.82:
            paragraphs.append("<{0}>{1}</{0}>".format(rng.choice(["h2", "h2", "h3", "h4"]), title(1, 6)) if rng.random() < 0.6 else f'<p><a href="/{word()}">{told(1, 6)}</a></p>')
        elif kind < 0.88:
            paragraphs.append("<ul>" + "".join(f"<li>{told(1, 12)}</li>" if rng.random() < 0.6 else f'<li><a href="/{word()}">{told(1, 4)}</a></li>' for _ in range(rng.randint(2, 5))) + "</ul>")
        elif kind < 0.92:
            paragraphs.append(f"<blockquote><p>{told()}</p></blockquote>")
        elif kind < 0.95:
            paragraphs.append(f"<figure><img src='a.png'><figcaption>{told(2, 10)}</figcaption></figure>")
        elif kind < 0.97:
            paragraphs.append("<table><tr>" + "".join(f"<td>{told(1, 4)}</td>" for _ in range(3)) + "</tr></table>")
        else:
            paragraphs.append(rng.choice(clutter[2:])())
    story = f"<h1>{title(2, 12)}</h1>" + "".join(paragraphs)
    if not paragraphs:  # a title, and little or nothing below it
        short = rng.choice([f"{phrase(rng.randint(1, 3))} x{next(numbered)}.", f"{word()[:2]}{next(numbered)}{rng.choice(['', '&', '.'])}"])
        main.add(" ".join(short.split()))
        head, below = f"<h1>{escape(short, quote=False)}</h1>", f"<p>{escape(short, quote=False)}</p>"
        story = rng.choice([head, below, head + below, f"{head}<p><b>{escape(short, quote=False)}<br>"])
    article = rng.choice([
        *[lambda: f"<article>{story}</article>"] * 5,
        lambda: f"<main><article>{story}</article></main>",
        lambda: f"<main>{story}</main>",
        lambda: named("div", ["content", "post-content", "article-body", "entry", "story", "main-text"], story),
        lambda: f'<div class="wrapper"><section class="article">{story}</section></div>',
        lambda: f"<div>{story}</div>",
        lambda: named("div", [strange(), strange(), "post", "page", "main", "inner"], story),
        lambda: f'<div class="{strange()}"><div id="{strange()}">{story}</div></div>',
        lambda: named("section", [strange(), ""], story),
        *[lambda: story] * 3,
        lambda: f"<div>{story}</div>",
        lambda: (lambda tag: f"<{tag}>{story}</{tag}>")(rng.choice(["app-content", "x-story", "my-article", "page-view", f"x-{word()}"])),
        lambda: f"<table><tr><td><ul>{links(rng.randint(3, 6))}</ul></td><td>{story}</td></tr></table>",
        lambda: f"<table><tr><td>{story}</td></tr></table>",
    ])()
    some = lambda pool, most: "".join(rng.choice(pool)() for _ in range(rng.randint(0, most)))
    top = rng.choice(["", f"<header><h2>{phrase(2)}</h2><p>{prose()}</p></header>", f"<header>{clutter[0]()}</header>", clutter[0]()])
    body = top + some(clutter, 3) + article + some(clutter, 2) + (rng.choice(comments)() if rng.random() < 0.4 else "") + (rng.choice(foot)() if rng.random() < 0.85 else "")
    return f"<!DOCTYPE html><html><head><title>{phrase(4)}</title><style>p{{}}</style></head><body>{body}</body></html>", main


def holding(block: list[list], main: set[str]) -> list[int]:
    """The nodes of a block that hold its main text: all of them, or all but one, or none."""
    nodes = sorted({node for node, text, _ in block if text.strip()})
    for without in (-1, *nodes):
        if text_of(block, lambda node, x=without: node != x) in main:
            return [node for node in nodes if node != without]
    return []


def fit(pages: int = 900, seed: int = 11, trees: int = 60, depth: int = 6, **options) -> dict:
    """Trees that tell nodes with main text below them from others."""
    rng, read, labels = random.Random(seed), [], []
    for _ in range(pages):
        html, main = labelled_page(rng)
        page = Page().finish(html)
        holds = [False] * len(page.kind)
        for block in page.blocks:
            for node in holding(block, main):
                while node >= 0 and not holds[node]:
                    holds[node] = True
                    node = page.parent[node]
        read.append(page)
        labels += holds
    made = Features(read)
    del read
    model = gbt.fit(made.rows(0, len(made)), np.array(labels, dtype=float), trees=trees, depth=depth, **options)
    del made
    trim()
    return model


# --- extraction ----------------------------------------------------------------------------------


def chosen(page: Page, odds: np.ndarray) -> str:
    kept = decode(page.parent, odds)
    return "\n\n".join(filter(None, (text_of(block, kept.__getitem__) for block in page.blocks)))


def extract_all(htmls, model: dict, most_nodes: int = ROWS) -> Iterator[str]:
    """Main texts, judged for several pages at a time."""
    waiting: list[Page] = []
    size = 0

    def flush() -> Iterator[str]:
        if waiting:
            odds = Features(waiting).score(model)
            for page, own in zip(waiting, np.split(odds, np.cumsum([len(p.kind) for p in waiting])[:-1]), strict=True):
                yield chosen(page, own)

    for html in htmls:
        waiting.append(Page().finish(html or ""))
        size += len(waiting[-1].kind)
        if size >= most_nodes:
            yield from flush()
            waiting, size = [], 0
    yield from flush()


def with_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The pages with their main text as ``out``; empty where there is none, and for null and empty pages. Other columns are kept."""
    small_batches(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(fit())

    @F.pandas_udf(RESULT)
    def extract(htmls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in tidied(htmls):
            yield pd.Series(list(extract_all(batch, shared.value)), dtype=object)

    return pages.withColumn(out, extract(F.col(html).cast("string")))


def main_texts(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, number of code points. Repeated rows are extracted alike; an empty table gives no rows."""
    found = with_main_text(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
