"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page is parsed into block nodes (inline markup belongs to its block). Features of a node: subtree text and
tag density, link density, attribute tokens (its own and its ancestors'), tag, depth, sibling position. Trees
give each node the log-odds that it is main text. Decoding then chooses, for every subtree, to keep all of
it, to drop all of it, or to leave the choice to the children at a price; so a kept node never lies in a
dropped one. The trees are trained on generated pages of many layouts (``training_pages``), whose nodes carry
their label; no table is read for it, and the seed is fixed.

Null and empty html give the empty text. Character references are decoded in each piece of text between tags, white
space inside a block becomes one space, blocks are joined by two newlines in page order. Unclosed and crossing tags are
tolerated; pages that break off are read to their end. Parsing takes time in proportion to the page, however deep its
tags are nested and however many are never closed; very long pages are taken whole. Repeated rows give repeated results;
without pages there is no row. Other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import html as _html
import math
import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_columns
from .gbt import Boosted

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?", re.IGNORECASE)
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*")
_SPACE = re.compile(r"[ \t\n\r\f\v]+")

#: fixed values of HTML: blocks, elements without content, elements whose content is raw text or is not shown
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre search section summary table caption thead tbody "
    "tfoot tr td th ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math object select button head".split())
_SHUT = {  # a start tag ends an open element of these kinds
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"),
}
_SCOPE = frozenset("ul ol dl menu table tr tbody thead tfoot td th article section div main aside nav body form".split())

TAGS = ("p", "div", "article", "main", "section", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "body", "h1", "h2", "blockquote", "pre", "figure", "#text")
GOOD = frozenset("article content post story entry main text body prose page".split())
BAD = frozenset(
    "ad ads advert advertisement sponsored promo banner sidebar side nav navigation navbar menu breadcrumb breadcrumbs footer foot header masthead "
    "comment comments reply replies discussion disqus cookie cookies consent notice notices alert gdpr popup modal share social sharing related "
    "recommended newsletter subscribe signup widget form search login copyright legal toolbar pagination pager tags meta".split()
)
_SMALL = frozenset(("ul", "ol", "li", "dl", "dt", "dd", "tr", "td", "th", "thead", "tbody", "table"))


class Node:
    __slots__ = ("tag", "parent", "kids", "good", "bad", "text", "chars", "linked", "links", "depth", "order", "tags", "commas", "blocks", "hidden")

    def __init__(self, tag, parent, good=0, bad=0):
        self.tag, self.parent, self.good, self.bad = tag, parent, good, bad
        self.kids: list[Node] = []
        self.text: str | None = None
        self.chars = self.linked = self.links = self.tags = self.commas = self.blocks = 0
        self.depth = parent.depth + 1 if parent else 0
        self.order = 0
        self.hidden = False


def _attributes(raw: str) -> tuple[int, int, bool]:
    good = bad = 0
    hidden = False
    for name, *values in _ATTRIBUTE.findall(raw):
        value = "".join(values)
        name = name.lower()
        if name in ("hidden", "aria-hidden"):
            hidden |= name == "hidden" or value.lower() == "true"
            continue
        for w in _WORDS.findall(value):
            w = w.lower()
            good += w in GOOD
            bad += w in BAD
    return good, bad, hidden


def parse(page: str) -> Node:
    """The tree of blocks. Text is in leaves only: the block itself, or a #text child where blocks are mixed in."""
    root = Node("html", None)
    at = root
    #: open nodes below the root, the places of each tag among them, and those of the tags in _SCOPE
    opened: list[Node] = []
    places: dict[str, list[int]] = {}
    scopes: list[int] = []
    endless: set[str] = set()
    run: list[str] = []
    link = 0
    linked = 0

    def flush():
        nonlocal run, linked
        if run:
            text = _SPACE.sub(" ", "".join(run).replace("\xa0", " ")).strip()
            run = []
            if text:
                leaf = Node("#text", at)
                leaf.text, leaf.chars = text, len(text)
                leaf.linked = min(linked, len(text))
                leaf.commas = text.count(",") + text.count(".")
                at.kids.append(leaf)
            linked = 0

    def add(text):
        nonlocal linked
        run.append(_html.unescape(text) if "&" in text else text)
        if link:
            linked += len(text)

    def enter(node):
        nonlocal at
        at.kids.append(node)
        at = node
        places.setdefault(node.tag, []).append(len(opened))
        if node.tag in _SCOPE:
            scopes.append(len(opened))
        opened.append(node)

    def close(tag) -> bool:
        """Ends the innermost open ``tag`` and all that is open inside it."""
        nonlocal at
        if not places.get(tag):
            return False
        place = places[tag][-1]
        if tag in ("p", "li", "dt", "dd") and scopes and scopes[-1] > place:
            return False
        flush()
        at = opened[place].parent
        while len(opened) > place:
            gone = opened.pop().tag
            places[gone].pop()
            if gone in _SCOPE:
                scopes.pop()
        return True

    pos = 0
    size = len(page)
    while pos < size:
        lt = page.find("<", pos)
        if lt < 0:
            add(page[pos:])
            break
        if lt > pos:
            add(page[pos:lt])
        m = _TOKEN.match(page, lt)
        if not m:
            add("<")
            pos = lt + 1
            continue
        pos = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        ending = (m[1] or m[4]) == "/"
        attributes = m[3] or m[6] or ""
        if tag in RAW:
            if not ending and not attributes.endswith("/"):
                end = None if tag in endless else re.compile(f"</{tag}(?=[\\s/>])[^>]*+(?:>|\\Z)", re.IGNORECASE).search(page, pos)
                if end:
                    pos = end.end()
                    continue
                endless.add(tag)
                if tag not in ("head", "template", "svg", "math", "object", "select", "button"):
                    pos = size
            continue
        if tag in VOID:
            if tag == "br":
                add("\n")
            elif tag == "hr":
                flush()
            continue
        if tag not in BLOCKS:
            if tag == "a":
                if ending:
                    link = max(0, link - 1)
                else:
                    link = 1
                    at.links += 1
            at.tags += 1
            continue
        link = 0
        if ending:
            if not close(tag):
                flush()
            continue
        flush()
        if tag in ("html", "body"):
            if tag == "body" and at is root:
                enter(Node("body", root, *_attributes(attributes)[:2]))
            continue
        close("p")
        for other in _SHUT.get(tag, ()):
            close(other)
        good, bad, hidden = _attributes(attributes) if attributes else (0, 0, False)
        node = Node(tag, at, good, bad)
        node.hidden = hidden
        enter(node)
    flush()
    return root


def nodes_of(root: Node) -> list[Node]:
    """All nodes in page order, with the sums of their subtrees filled in."""
    out = [root]
    todo = [root]
    out = []
    while todo:
        node = todo.pop()
        out.append(node)
        for k, kid in enumerate(node.kids):
            kid.order = k
        todo.extend(reversed(node.kids))
    for node in reversed(out):
        up = node.parent
        node.blocks += 1
        if up is not None:
            up.chars += node.chars
            up.linked += node.linked
            up.links += node.links
            up.commas += node.commas
            up.tags += node.tags + 1
            up.blocks += node.blocks
    return out


_TAG = {t: i for i, t in enumerate(TAGS)}
WIDTH = len(TAGS) + 18


def features(nodes: list[Node]) -> np.ndarray:
    x = np.zeros((len(nodes), WIDTH), dtype=np.float32)
    total = max(1, nodes[0].chars)
    inside: dict[int, tuple[int, int, int, int]] = {}
    k = len(TAGS)
    for i, n in enumerate(nodes):
        up = n.parent
        tag = up.tag if n.tag == "#text" and up is not None else n.tag
        hit = _TAG.get(tag)
        if hit is not None:
            x[i, hit] = 1
        if n.tag == "#text":
            x[i, _TAG["#text"]] = 1
        bads, goods, sem, main = inside[id(up)] if up is not None else (0, 0, 0, 0)
        bads, goods = bads + n.bad, goods + n.good
        sem += tag in ("nav", "header", "footer", "aside", "form")
        main += tag in ("article", "main")
        inside[id(n)] = bads, goods, sem, main
        siblings = len(up.kids) if up is not None else 1
        x[i, k:] = (
            n.good, n.bad, goods, bads, sem, main,
            math.log1p(n.chars), n.chars / total, n.linked / (n.chars + 1), math.log1p(n.links),
            n.chars / (n.tags + 1), n.commas / (n.chars + 1) * 100, n.depth, n.order / siblings,
            math.log1p(siblings), math.log1p(n.blocks), math.log1p(up.chars if up is not None else n.chars), n.hidden,
        )
    return x


#: price of a mixed subtree, in the unit of the log-odds of one node
MIXED = 0.4


def decode(nodes: list[Node], margin: np.ndarray) -> list[Node]:
    """The kept text leaves: for each subtree keep all, drop all or leave it to the children, whichever is likeliest."""
    place = {id(n): i for i, n in enumerate(nodes)}
    size = len(nodes)
    odds = np.clip(margin, -6, 6) * (1 + np.log1p([n.chars / 40 for n in nodes]))
    keep, drop = np.zeros(size), np.zeros(size)
    best = np.zeros(size)
    choice = np.zeros(size, dtype=np.int8)
    for i in range(size - 1, -1, -1):
        n = nodes[i]
        kids = [place[id(c)] for c in n.kids]
        if n.hidden:
            odds[i] = -1e6
        keep[i] = odds[i] + sum(keep[c] for c in kids)
        drop[i] = -odds[i] + sum(drop[c] for c in kids)
        options = [drop[i], keep[i]]
        if kids:
            options.append(sum(best[c] for c in kids) - MIXED)
        choice[i] = int(np.argmax(options))
        best[i] = options[choice[i]]
    out = []
    todo = [(0, 2)]
    while todo:
        i, state = todo.pop()
        n = nodes[i]
        mine = int(choice[i]) if state == 2 else state
        if n.text is not None and mine == 1:
            out.append(n)
        if mine == 0:
            continue
        todo.extend((place[id(c)], mine) for c in reversed(n.kids))
    return out


def extract(page: str | None, model: Boosted) -> str:
    if not page:
        return ""
    nodes = nodes_of(parse(page))
    if len(nodes) < 2:
        return ""
    return "\n\n".join(n.text for n in decode(nodes, model.margin(features(nodes))))


# ---------------------------------------------------------------- training pages


def training_pages(count: int, seed: int = 11):
    """(html, set of texts that are main text). Every text is distinct, so leaves can be labelled by their text."""
    rng = random.Random(seed)
    syllables = ["".join(p) for p in zip("bcdfghklmnprstvz" * 3, "aeiouaeiou" * 5)]
    serial = 0

    def words(a, b):
        nonlocal serial
        serial += 1
        out = ["".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(rng.randint(a, b))]
        text = f"{out[0].capitalize()}{serial} {' '.join(out[1:])}".strip()
        return text + rng.choice([".", "", ".", "?"]) if rng.random() < 0.8 else text.replace(" ", ", ", 2)

    def links(n):
        return "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(n))

    def box(kind):
        name = rng.choice(kind)
        return rng.choice([f'class="{name}"', f'id="{name}"', f'class="{name} wide"', f'class="x-{name}"'])

    def sentence_or_links():
        return rng.choice([f"<p>{words(3, 14)}</p>", words(2, 14), f"<ul>{links(rng.randint(2, 6))}</ul>"])

    for _ in range(count):
        main: set[str] = set()

        def good(tag, a, b, main=main):
            text = words(a, b)
            main.add(text)
            close = f"</{tag}>" if rng.random() < 0.9 else ""
            shown = f"<b>{text}<br>" if tag == "p" and rng.random() < 0.15 else text
            return f"<{tag}>{shown}{close}"

        ad = lambda: f"<div {box(['ad', 'ads', 'advert', 'promo', 'sponsored', 'banner'])}>{sentence_or_links()}</div>"
        notice = lambda: f"<div {box(['cookie-notice', 'notice', 'consent', 'alert', 'newsletter', 'popup'])}>{sentence_or_links()}</div>"
        form = lambda: f'<form action="/s"><p>{words(2, 8)}</p><input name="q"><label>{words(1, 3)}</label></form>'
        social = lambda: f"<div {box(['share', 'social', 'related', 'recommended', 'tags'])}><ul>{links(rng.randint(2, 5))}</ul></div>"
        aside = lambda: rng.choice([f"<aside>{sentence_or_links()}<p>{words(4, 20)}</p></aside>", f"<div {box(['sidebar', 'side', 'widget'])}><p>{words(4, 20)}</p>{sentence_or_links()}</div>"])
        comment = lambda: f"<{(t := rng.choice(['div', 'li', 'article', 'p']))}{rng.choice(['', ' class=comment'])}>{words(4, 40)}</{t}>"

        def comments():
            inner = "".join(comment() for _ in range(rng.randint(1, 6)))
            tag = rng.choice(["section", "div", "ol"])
            return f"<{tag} {box(['comments', 'discussion', 'replies', 'comment-list'])}><h2>{words(1, 3)}</h2>{inner}</{tag}>"

        body = [good("h1", 2, 10)] if rng.random() < 0.8 else []
        for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 14])):
            part = rng.random()
            if part < 0.72:
                body.append(good("p", 1, rng.choice([3, 12, 40, 120])))
            elif part < 0.8:
                body.append(good(rng.choice(["h2", "h3"]), 1, 6))
            elif part < 0.86:
                body.append(f"<ul>{''.join(good('li', 2, 15) for _ in range(rng.randint(2, 5)))}</ul>")
            elif part < 0.9:
                body.append(good("blockquote", 4, 30))
            elif part < 0.92:
                body.append(f"<table><tr>{good('td', 1, 4)}{good('td', 1, 4)}</tr></table>")
            elif part < 0.94:
                body.append(good("pre", 3, 20))
            else:
                body.append(rng.choice([ad, social, notice, form])())
        if not any("<p" in b for b in body):
            body.append(good("p", 5, 60))
        inner = "".join(body)
        if rng.random() < 0.2:
            inner = f"<div>{inner}</div>"
        shape = rng.random()
        wrap = box(["content", "post", "article", "entry-content", "story", "main", "text", "article-body"])
        if shape < 0.45:
            core = f"<article>{inner}</article>"
        elif shape < 0.6:
            core = f"<main>{inner}</main>"
        elif shape < 0.7:
            core = f"<main><article {wrap}>{inner}</article></main>"
        elif shape < 0.92:
            core = f"<div {wrap}>{inner}</div>"
        else:
            core = inner
        nav = f"<nav><ul>{links(rng.randint(3, 8))}</ul></nav>" if rng.random() < 0.7 else f"<div {box(['menu', 'nav', 'navbar', 'breadcrumbs'])}><ul>{links(rng.randint(2, 8))}</ul></div>"
        head = [nav]
        if rng.random() < 0.4:
            head = [rng.choice([f"<header><p>{words(1, 6)}</p>{nav}</header>", f"<div {box(['header', 'masthead'])}>{words(1, 5)}{nav}</div>"])]
        for part, share in ((ad, 0.5), (notice, 0.3), (aside, 0.15), (form, 0.15)):
            if rng.random() < share:
                head.insert(rng.randint(0, len(head)), part())
        tail = [p() for p, share in ((comments, 0.35), (aside, 0.3), (social, 0.3), (ad, 0.3), (form, 0.15), (notice, 0.2)) if rng.random() < share]
        rng.shuffle(tail)
        copyright_ = f"&copy; {words(1, 12)}"
        tail.append(rng.choice([f"<footer>{copyright_}</footer>", f"<footer><p>{copyright_}</p><ul>{links(3)}</ul></footer>", f"<div {box(['footer', 'copyright', 'legal'])}>{copyright_}</div>"]))
        end = "</body></html>" if rng.random() < 0.9 else ""
        yield f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{''.join(head)}{core}{''.join(tail)}{end}", main


@functools.cache
def train(pages: int = 500, seed: int = 11) -> Boosted:
    """The trees; equal arguments give equal trees, so a process trains them once. A node is labelled 1 if all texts below it are main text, and is left out where they differ."""
    xs, ys = [], []
    for page, main in training_pages(pages, seed):
        nodes = nodes_of(parse(page))
        label: dict[int, int] = {}
        for n in reversed(nodes):
            if n.text is not None:
                label[id(n)] = int(n.text in main)
            else:
                kinds = {label[id(c)] for c in n.kids if id(c) in label}
                label[id(n)] = kinds.pop() if len(kinds) == 1 else -1
        y = np.array([label[id(n)] for n in nodes])
        x = features(nodes)
        xs.append(x[y >= 0])
        ys.append(y[y >= 0])
    return Boosted().fit(np.concatenate(xs), np.concatenate(ys).astype(float))


def extracted(pages: DataFrame, model: Boosted | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or train())

    def start():
        def work(ids, urls, htmls):
            text: list[str] = []
            for k in range(0, len(htmls), 200):
                trees = [nodes_of(parse(h)) if h else [] for h in htmls[k : k + 200]]
                live = [t for t in trees if len(t) > 1]
                margins = shared.value.margin(np.concatenate([features(t) for t in live])) if live else []
                at = 0
                for t in trees:
                    if len(t) > 1:
                        text.append("\n\n".join(n.text for n in decode(t, margins[at : at + len(t)])))
                        at += len(t)
                    else:
                        text.append("")
            return [ids, urls, text, list(map(len, text))]

        return work

    return map_columns(
        pages,
        [F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html"],
        "page_id long, url string, text string, n_chars long",
        start,
    )
