"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded over the tree.

A tolerant parser keeps the structural elements as nodes; inline ones only mark links and breaks. Each node gets features of its
tag, its attribute tokens, its ancestors, its subtree's text, link and paragraph density, its depth and its siblings. The trees give
each node the log probabilities of three states: around the article, of the article, removed. A maximum over the tree
chooses states such that below a removed node all is removed and below a node of the article all is of the article or
removed, so that no choice contradicts that of an ancestor. The model is trained on pages written by a rule from a fixed
seed (TRAINING_PAGES of them); no corpus row is needed.
"""

from __future__ import annotations

import html
import math
import re
from functools import lru_cache
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import BoostedTrees

TRAINING_PAGES = 220
AROUND, ARTICLE, REMOVED = range(3)
#: Nodes whose features go to the trees together.
NODES_AT_ONCE = 20_000

#: Element groups.
_GROUPS = (
    ("html", "body"), ("head", "title", "meta", "link", "base"), ("div", "center"), ("section",), ("main",), ("article",), ("nav", "menu"), ("header", "hgroup"), ("footer",), ("aside",),
    ("form", "fieldset", "select", "textarea", "button", "option", "label", "datalist", "output"), ("script", "style", "noscript", "template", "iframe", "svg", "object", "canvas", "video", "audio", "dialog"),
    ("p", "address"), ("h1", "h2", "h3", "h4", "h5", "h6"), ("ul", "ol", "dl"), ("li", "dt", "dd"), ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption"), ("blockquote", "pre", "figure", "figcaption", "details", "summary", "hr"),
)
_GROUP = {t: k for k, ts in enumerate(_GROUPS) for t in ts}
_VOID = frozenset("meta link base hr br img input wbr area col embed source track param".split())
_RAW = frozenset("script style template iframe svg textarea title noscript".split())
_CLOSES_P = frozenset(t for t, k in _GROUP.items() if k not in (1, 10, 11)) | {"form", "fieldset"}
_CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

#: Words of classes, ids and roles.
_TOKENS = (
    "ad ads adv advert adverts advertisement advertising banner promo promotion sponsor sponsored adsense",
    "nav navbar navigation menu breadcrumb breadcrumbs pagination pager toc tabs",
    "footer foot copyright legal colophon contentinfo bottom",
    "header masthead topbar logo site brand top",
    "sidebar side aside widget widgets related recommended trending popular more teaser teasers complementary",
    "comment comments reply replies respond disqus discussion thread",
    "cookie cookies consent notice gdpr popup modal overlay newsletter subscribe subscription alert paywall signup login search",
    "share sharing social follow tags meta byline author",
    "content article post entry main body story text page prose",
)
_TOKEN = {w: k for k, ws in enumerate(_TOKENS) for w in ws.split()}

_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none", re.I)


class Node:
    __slots__ = ("tag", "parent", "tokens", "hidden", "items", "depth", "children")

    def __init__(self, tag, parent, attributes=""):
        self.tag, self.parent, self.items, self.children = tag, parent, [], []
        self.depth = parent.depth + 1 if parent else 0
        self.tokens = 0
        if attributes:
            for a, b, c in _ATTRIBUTE.findall(attributes):
                for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower()):
                    if w in _TOKEN:
                        self.tokens |= 1 << _TOKEN[w]
        self.hidden = bool(attributes and _HIDDEN.search(attributes))


def parse(page: str) -> list[Node]:
    """Nodes in page order, the root first. items: (text, in a link) runs and child nodes, in order."""
    root = Node("html", None)
    nodes, stack, link, at = [root], [root], 0, 0

    def close(tags, stops):
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                del stack[k:]
                return
            if stack[k].tag in stops:
                return

    while at < len(page):
        m = _MARKUP.search(page, at)
        text = page[at : m.start() if m else len(page)]
        if text:
            stack[-1].items.append((text, link > 0))
        if not m:
            break
        at = m.end()
        end, tag = m[1], (m[2] or "").lower()
        if not tag:
            continue
        if end:
            if tag == "a":
                link = max(0, link - 1)
            elif tag in _GROUP and any(n.tag == tag for n in stack[1:]):
                close({tag}, ())
            continue
        if tag == "a":
            link = 1
        elif tag == "br":
            stack[-1].items.append((" ", link > 0))
        elif tag in _GROUP and tag not in ("html", "body") or tag == "body":
            if tag in _CLOSES_P:
                close({"p"}, {"article", "div", "section", "td", "li", "blockquote", "button"})
                link = 0
            if tag in _CLOSED_BY:
                close(_CLOSED_BY[tag], _STOPS[tag])
            if tag == "body":
                close({"head"}, ())
            node = Node(tag, stack[-1], m[3])
            stack[-1].items.append(node)
            stack[-1].children.append(node)
            nodes.append(node)
            if tag in _RAW:
                stop = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                node.items.append((page[at : stop.start() if stop else len(page)], False))
                at = stop.end() if stop else len(page)
            elif tag not in _VOID:
                stack.append(node)
    return nodes


N_GROUPS, N_TOKENS = len(_GROUPS) + 1, len(_TOKENS)
N_FEATURES = 2 * N_GROUPS + 2 * N_TOKENS + 18


def features(nodes: list[Node]) -> np.ndarray:
    n = len(nodes)
    at = {id(x): k for k, x in enumerate(nodes)}
    own = np.zeros((n, 5))  # characters, link characters, marks, paragraphs, nodes
    parent = np.zeros(n, np.int64)
    x = np.zeros((n, N_FEATURES))
    for k, node in enumerate(nodes):
        parent[k] = at[id(node.parent)] if node.parent else 0
        if _GROUP.get(node.tag) not in (1, 11):
            for item in node.items:
                if type(item) is tuple:
                    size = len(item[0].strip())
                    own[k, 0] += size
                    own[k, 1] += size * item[1]
                    own[k, 2] += item[0].count(".") + item[0].count(",")
        own[k, 3] = node.tag == "p"
        own[k, 4] = 1
    total = own.copy()
    for k in range(n - 1, 0, -1):
        total[parent[k]] += total[k]
    page = max(total[0, 0], 1)
    base = 2 * N_GROUPS + 2 * N_TOKENS
    above_tokens = [0] * n
    in_article = [0] * n
    in_side = [0] * n
    place = [0] * n
    for node in nodes:
        for i, child in enumerate(node.children):
            place[at[id(child)]] = i
    for k, node in enumerate(nodes):
        group = _GROUP.get(node.tag, N_GROUPS - 1)
        x[k, group] = 1
        up = parent[k]
        x[k, N_GROUPS + _GROUP.get(nodes[up].tag, N_GROUPS - 1)] = k > 0
        if k:
            above_tokens[k] = above_tokens[up] | nodes[up].tokens
            in_article[k] = in_article[up] or nodes[up].tag in ("article", "main")
            in_side[k] = in_side[up] or _GROUP.get(nodes[up].tag) in (1, 6, 8, 9, 10, 11)
        for b in range(N_TOKENS):
            x[k, 2 * N_GROUPS + b] = node.tokens >> b & 1
            x[k, 2 * N_GROUPS + N_TOKENS + b] = above_tokens[k] >> b & 1
        chars, links, marks, paragraphs, size = total[k]
        siblings = len(node.parent.children) if node.parent else 1
        x[k, base:] = (
            node.depth, math.log1p(chars), links / (chars + 1), math.log1p(size), math.log1p(chars / size), math.log1p(paragraphs), chars / page,
            100 * marks / (chars + 20), math.log1p(siblings), place[k] / siblings, in_article[k], in_side[k], node.hidden,
            math.log1p(own[k, 0]), own[k, 1] / (own[k, 0] + 1), total[up, 1] / (total[up, 0] + 1), total[up, 3] / total[up, 4], total[up, 0] / page,
        )
    return x


def decode(nodes: list[Node], logp: np.ndarray) -> list[int]:
    """The states of greatest total log probability among those that agree along every path."""
    allowed = {AROUND: (AROUND, ARTICLE, REMOVED), ARTICLE: (ARTICLE, REMOVED), REMOVED: (REMOVED,)}
    at = {id(x): k for k, x in enumerate(nodes)}
    best, take = logp.copy(), np.zeros((len(nodes), 3), np.int64)
    for k in range(len(nodes) - 1, 0, -1):
        up = at[id(nodes[k].parent)]
        for s, options in allowed.items():
            y = max(options, key=lambda o: best[k, o])
            take[k, s] = y
            best[up, s] += best[k, y]
    state = [int(best[0].argmax())] + [0] * (len(nodes) - 1)
    for k in range(1, len(nodes)):
        state[k] = int(take[k, state[at[id(nodes[k].parent)]]])
    return state


def text_of(nodes: list[Node], state: list[int]) -> str:
    """Text of the article's nodes: one block between any two structural bounds, blocks joined by a blank."""
    kept = {id(x) for x, s in zip(nodes, state) if s == ARTICLE}
    blocks, run = [], []

    def close():
        if run:
            block = " ".join(html.unescape("".join(run)).split())
            if block:
                blocks.append(block)
            run.clear()

    todo = [(nodes[0], 0)]  # an explicit stack: pages may nest deeply
    while todo:
        node, k = todo.pop()
        if k == 0:
            close()
        while k < len(node.items):
            item = node.items[k]
            k += 1
            if type(item) is tuple:
                if id(node) in kept:
                    run.append(item[0])
            else:
                todo += [(node, k), (item, 0)]
                break
        else:
            close()
    return " ".join(blocks)


# --- training pages -----------------------------------------------------------------------------------------------


def _written_page(r: Random) -> tuple[str, list[int]]:
    """A page and its nodes' states, in page order."""
    out: list[str] = []
    states: list[int] = []
    word = lambda: "".join(r.choice("etaoinshrdlu") for _ in range(r.randint(2, 9)))

    def sentence(a=4, b=18):
        return " ".join(word() for _ in range(r.randint(a, b))).capitalize() + "."

    def prose(k):
        return " ".join(sentence() for _ in range(k))

    def link(text):
        return f'<a href="/{word()}">{text}</a>'

    def element(tag, state, inside="", attributes="", closed=True):
        states.append(state)
        out.append(f"<{tag}{' ' + attributes if attributes else ''}>")
        if callable(inside):
            inside()
        else:
            out.append(inside)
        if closed and tag not in _VOID:
            out.append(f"</{tag}>")

    def named(words):
        return r.choice(('class="{}"', "id='{}'", 'class="x-{} c1"', 'class="{}-box"')).format(r.choice(words.split()))

    def listed(state, links=True, k=None):
        def items():
            for _ in range(k or r.randint(2, 8)):
                element("li", state, link(word()) if links else sentence(2, 10), closed=r.random() < 0.8)

        element(r.choice(("ul", "ul", "ol")), state, items)

    def junk(place):
        kind = r.randrange(12)
        X = REMOVED

        def paragraphs(a, b):
            for _ in range(r.randint(a, b)):
                element("p", X, prose(r.randint(1, 3)))

        some = lambda: paragraphs(1, 3)
        bare = prose(r.randint(1, 3))
        if kind == 0:
            r.choice((lambda: element("nav", X, lambda: listed(X)), lambda: element("div", X, lambda: listed(X), named(_TOKENS[1]))))()
        elif kind == 1:
            element(r.choice(("div", "div", "section", "aside")), X, r.choice((bare, some)), named(_TOKENS[0]))
        elif kind == 2:
            element("footer", X, r.choice((f"&copy; {bare}", some, lambda: listed(X)))) if place != "in" or r.random() < 0.5 else element("div", X, bare, named(_TOKENS[2]))
        elif kind == 3 and place == "out":
            element(r.choice(("header", "header", "div")), X, r.choice((bare, lambda: element("h1", X, sentence(1, 4)), lambda: element("h2", X, word()))), r.choice(("", named(_TOKENS[3])))) if r.random() < 0.7 else element("header", X, lambda: (element("p", X, sentence()), listed(X)))
        elif kind in (3, 4):
            element("aside", X, r.choice((some, lambda: listed(X), bare)), r.choice(("", named(_TOKENS[4]))))
        elif kind == 5:
            element(r.choice(("div", "section")), X, r.choice((some, lambda: listed(X), lambda: (element("h3", X, word()), listed(X)))), named(_TOKENS[4]))
        elif kind in (6, 7):

            def comments():
                element(r.choice(("h2", "h3")), X, r.choice(("Comments", sentence(1, 3))))
                for _ in range(r.randint(1, 4)):
                    r.choice((lambda: element("div", X, some, 'class="comment"'), lambda: element("p", X, prose(2)), lambda: element("article", X, some, 'class="comment"')))()

            element(r.choice(("section", "div", "ol" if False else "div")), X, comments, named("comments comment discussion replies respond"))
        elif kind == 8:
            element(r.choice(("div", "section", "div", "p")), X, bare, named(_TOKENS[6]))
        elif kind == 9:
            element("form", X, r.choice((bare + "<input>", lambda: (element("label", X, word()), element("button", X, "Send")), lambda: element("p", X, bare))))
        elif kind == 10:
            element(r.choice(("div", "ul" if False else "div")), X, r.choice((link("a") + link("b"), bare)), named("share sharing social follow"))
        else:
            element(r.choice(("script", "style", "noscript")), X, r.choice(("var a=1;track(2);", "p{margin:0}", "on")))

    def body_part(k):
        what = r.randrange(12)
        A = ARTICLE
        if what <= 6:
            element("p", A, r.choice(("", "", "<b>")) + prose(r.randint(1, 6)) + r.choice(("", "", "<br>", link(word()))), closed=r.random() < 0.9)
        elif what == 7:
            element(r.choice(("h2", "h3")), A, sentence(1, 6))
        elif what == 8:
            listed(A, links=r.random() < 0.15)
        elif what == 9:
            element("blockquote", A, r.choice((prose(2), lambda: element("p", A, prose(2)))))
        elif what == 10:
            r.choice((lambda: element("pre", A, prose(1)), lambda: element("figure", A, lambda: element("figcaption", A, sentence()))))()
        else:

            def rows():
                for _ in range(r.randint(1, 3)):
                    element("tr", A, lambda: [element("td", A, word()) for _ in range(2)])

            element("table", A, rows)

    def article():
        inner = r.random() < 0.35
        if r.random() < 0.85:
            element("h1", ARTICLE, sentence(2, 10)) if r.random() < 0.85 else element("header", ARTICLE, lambda: element("h1", ARTICLE, sentence(2, 8)))
        for k in range(r.choice((1, 1, 2, 3, 5, 9, 14))):
            body_part(k)
            if inner and r.random() < 0.2:
                junk("in")
        if inner and r.random() < 0.6:
            junk("in")

    def main():
        kind = r.randrange(8)
        if kind <= 4:
            element("article", ARTICLE, article, r.choice(("", "", named(_TOKENS[8]))))
        elif kind == 5:
            element("div", ARTICLE, article, named("content article post entry story prose"))
        elif kind == 6:
            element("main", ARTICLE, article)
        else:
            element("section", ARTICLE, article, named("content post entry story"))

    def middle():
        wraps = r.choice((0, 0, 0, 0, 1, 2))

        def level(k):
            if k == 0:
                main()
                return

            def inside():
                for _ in range(r.randint(0, 1)):
                    junk("out")
                level(k - 1)
                for _ in range(r.randint(0, 2)):
                    junk("out")

            element(r.choice(("div", "div", "section", "main")), AROUND, inside, r.choice(("", 'class="wrapper"', 'id="page"', 'class="container"', 'class="row"')))

        level(wraps)

    states.append(AROUND)
    out.append(f'<!DOCTYPE html><html lang="en">')

    def head():
        states.append(REMOVED)
        out.append('<meta charset="utf-8">')
        element("title", REMOVED, sentence(2, 8))
        for _ in range(r.randint(0, 2)):
            element(r.choice(("style", "script")), REMOVED, "p{margin:0}")

    element("head", REMOVED, head)

    def body():
        for _ in range(r.randint(0, 4)):
            junk("out")
        middle()
        for _ in range(r.randint(0, 4)):
            junk("out")

    element("body", AROUND, body, closed=r.random() < 0.8)
    return "".join(out), states


@lru_cache(maxsize=1)
def trained(seed: int = 11) -> BoostedTrees:
    r = Random(seed)
    xs, ys = [], []
    while len(xs) < TRAINING_PAGES:
        page, states = _written_page(r)
        nodes = parse(page)
        if len(nodes) == len(states):
            xs.append(features(nodes))
            ys.append(states)
    return BoostedTrees(3).fit(np.concatenate(xs), np.concatenate([np.array(y) for y in ys]))


def extract(pages: list[str | None], model: BoostedTrees) -> list[str]:
    out: list[str] = []
    held: list = []

    def flush():
        sizes = [len(x) for _, x in held]
        if not sizes:
            return
        logp = model.log_probabilities(np.concatenate([x for _, x in held]))
        for (nodes, _), p in zip(held, np.split(logp, np.cumsum(sizes)[:-1])):
            out.append(text_of(nodes, decode(nodes, p)))
        held.clear()

    count = 0
    for page in pages:
        nodes = parse(page or "")
        held.append((nodes, features(nodes)))
        count += len(nodes)
        if count >= NODES_AT_ONCE:
            flush()
            count = 0
    flush()
    return out


def main_text(pages: DataFrame, model: BoostedTrees | None = None) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages.

    A null or empty html has an empty text, as has a page without an article. Repeated rows and null ids or urls stay. Other
    columns are ignored. An empty table gives an empty one."""
    model = model or trained()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = extract(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
