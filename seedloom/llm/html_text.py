"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text. A classifier gives each block the cost of calling it content and of calling it
boilerplate; these are the capacities of its edges to the two terminals, at most CERTAIN each, so that no block is beyond
doubt. Blocks that follow each other, and blocks next to each other under one parent, are joined by smoothness edges,
weaker the further apart they stand in the tree. The minimum cut (Dinic's maximum flow) is the labelling of least total
cost: a short heading or line goes with what surrounds it, although it says little by itself. Of cuts of equal cost the
one with the fewest blocks of content is taken.

The classifier is a logistic regression over where a block stands and what it looks like, fitted once on made-up pages.
Null and empty pages have an empty text, an empty table an empty result. Markup that is cut off or not closed is read as
far as it goes. Repeated rows are read each on its own; very long pages are read whole. Extra columns are kept by
extract(); if they clash with the added name, the added one gets a suffix.
"""

from __future__ import annotations

import functools
import html as entities
import random
import re
from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seedloom.llm import trees
from seedloom.llm.common import fresh, table

TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?>[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
TAG_START = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)")
ATTRIBUTE = re.compile(r"(?i)(?<![\w-])(class|id|role|aria-label|style|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
#: Elements whose content is no markup: it isn't text of the page, or it is (LITERAL).
RAW = {"script", "style", "title", "textarea", "iframe", "noembed", "noframes"}
LITERAL = {"xmp", "listing"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "td", "th", "img", "wbr", "br", "input",
    "noscript", "object", "svg", "g", "text", "tspan", "math", "mrow", "mi", "mn", "mo", "ms", "mtext", "msup", "msub", "msubsup", "mfrac", "msqrt", "mroot", "mstyle", "mover", "munder", "mtable", "mtr", "mtd", "semantics", "annotation",
}
#: Elements that make a gap between words although they are inline.
GAP = {"br", "td", "th", "img", "input"}
#: Opening one of these closes an open one of the same group.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}}
CLOSES |= {f"h{k}": {"p"} for k in range(1, 7)} | {k: {"p"} for k in ("div", "ul", "ol", "section", "article", "aside", "nav", "header", "footer", "form", "table", "blockquote", "main", "pre")}

#: Words in names of boilerplate, and words that say nothing beside them. A name with any other word says nothing either.
BAD = set("""ad ads advert adverts advertisement banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login register
sidebar rail widget comment comments reply replies respond disqus related recommended recommendations share sharing social follow nav navbar navigation menu breadcrumb breadcrumbs topbar toolbar pager pagination
footer foot masthead search form complementary contentinfo dialog skip legal copyright disclaimer teaser header""".split())
NEUTRAL = set("""site page main global top bottom left right inner outer wrap wrapper container box block area section list item items bar links link buttons button text content body inline unit slot module group row
column col primary secondary small large fixed sticky js the and v2""".split())
GOOD = set("article content post entry story main body text page".split())
NAME = re.compile(r"[a-z]+|[0-9]+")
HIDDEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")


@functools.lru_cache(4096)
def says(names: str) -> tuple[bool, bool]:
    """Whether names of an element tell of boilerplate, and of content."""
    bad = good = False
    for name in names.split():
        words = [w for w in NAME.findall(re.sub("([a-z])([A-Z])", r"\1 \2", name).lower()) if not w.isdigit()]
        bad |= any(w in BAD for w in words) and all(w in BAD or w in NEUTRAL for w in words)
        good |= bool(words) and all(w in GOOD for w in words)
    return bad, good


FEATURES = ["article", "outside", "nav", "footer", "aside", "form", "header", "bad_name", "good_name", "hidden", "links", "words", "ends", "heading", "item"]


ARTICLE_TAGS, FORM_TAGS = {"article", "main"}, {"form", "button", "select", "fieldset", "dialog"}
#: What an element is inside of, as bits.
ARTICLE, NAV, FOOTER, ASIDE, FORM, HEADER, BAD_NAME, GOOD_NAME, HIDDEN_IN, HEAD = (1 << k for k in range(10))
OF_TAG = {"nav": NAV, "menu": NAV, "footer": FOOTER, "aside": ASIDE, "header": HEADER, "head": HEAD} | dict.fromkeys(ARTICLE_TAGS, ARTICLE) | dict.fromkeys(FORM_TAGS, FORM)


class Element:
    """An element on the way from the root to a block: it knows its parent and, in bits, what it is inside of."""

    __slots__ = ("tag", "number", "parent", "depth", "own", "inside")

    def __init__(self, tag: str, number: int, parent: Element | None, own: int) -> None:
        self.tag, self.number, self.parent, self.own = tag, number, parent, own
        self.depth = parent.depth + 1 if parent else 0
        self.inside = own | (parent.inside if parent else 0)


class Block:
    __slots__ = ("text", "links", "at")

    def __init__(self, text: str, links: int, at: Element) -> None:
        self.text, self.links, self.at = text, links, at

    def features(self, has_article: bool) -> list[float]:
        i, last, words = self.at.inside, self.at.tag, self.text.split()
        article = bool(i & ARTICLE)
        return [
            article, has_article and not article, bool(i & NAV), bool(i & FOOTER), bool(i & ASIDE), bool(i & FORM), bool(i & HEADER) and not article, bool(i & BAD_NAME), bool(i & GOOD_NAME), bool(i & HIDDEN_IN),
            min(1.0, self.links / max(1, len(self.text))), min(4.0, np.log1p(len(words))), self.text[-1:] in ".!?:…”\"", last in {"h1", "h2", "h3", "h4", "h5", "h6"}, last in {"li", "option"},
        ]


def features(found: list[Block]) -> np.ndarray:
    has_article = any(b.at.inside & ARTICLE for b in found)
    return np.array([b.features(has_article) for b in found], dtype=float).reshape(-1, len(FEATURES))


def attributes(raw: str) -> tuple[str, bool]:
    names, hidden = [], False
    if "=" in raw or "hidden" in raw:
        for m in ATTRIBUTE.finditer(raw):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "style":
                hidden |= bool(HIDDEN.search(value))
            elif key == "hidden":
                hidden = True
            elif key == "aria-hidden":
                hidden |= value.lower() == "true"
            else:
                names.append(value)
    return " ".join(names), hidden


def tag_end(page: str, at: int) -> int:
    """Where a tag ends in which a quote isn't closed: after the first > behind that quote. Each kind of quote can be so once."""
    while m := re.compile("[>\"']").search(page, at):
        if m[0] == ">":
            return m.end()
        close = page.find(m[0], m.end())
        if close < 0:
            close = page.find(">", m.end())
            return len(page) if close < 0 else close + 1
        at = close + 1
    return len(page)


def blocks(page: str) -> list[Block]:
    """The page's blocks of text, in order."""
    out: list[Block] = []
    root = Element("", 0, None, 0)
    stack: list[Element] = [root]
    #: How many open elements each tag has, and raw elements that nothing closes any more.
    open_tags: Counter[str] = Counter()
    unclosed: set[str] = set()
    parts: list[str] = []
    links = number = at = 0
    in_link = False
    end = len(page)

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, links, stack[-1]))
            parts.clear()
        links = 0

    while at < end:
        lt = page.find("<", at)
        lt = end if lt < 0 else lt
        if lt > at:
            piece = page[at:lt]
            parts.append(piece)
            if in_link:
                links += len(piece)
        if lt == end:
            break
        following = page[lt + 1 : lt + 2]
        if following == "!" or following == "?":
            comment = page.startswith("<!--", lt)
            close = page.find("-->" if comment else ">", lt + (4 if comment else 2))
            at = end if close < 0 else close + (3 if comment else 1)
            continue
        m = TAG.match(page, lt) or TAG_START.match(page, lt)
        if m is None:
            if following == "/":
                at = page.find(">", lt)
                at = end if at < 0 else at + 1
            else:
                parts.append("<")
                at = lt + 1
            continue
        closing, tag = m[1], m[2].lower()
        at = m.end() if m.re is TAG else tag_end(page, m.end())
        inside = m[3] if m.re is TAG else page[m.end() : at].rstrip(">")
        if tag in LITERAL or (tag in RAW and not open_tags["svg"]):
            if not closing and not inside.endswith("/"):
                close = None if tag in unclosed else re.compile(rf"(?i)</{tag}(?=[\s>/])[^>]*>").search(page, at)
                if close is not None:
                    if tag in LITERAL:
                        flush()
                        out.extend(Block(t, 0, Element(tag, number, stack[-1], 0)) for t in [" ".join(page[at : close.start()].split())] if t)
                    at = close.end()
                elif tag in ("script", "style"):
                    at = end
                else:
                    unclosed.add(tag)
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            elif tag in GAP:
                parts.append(" ")
            continue
        flush()
        if tag in VOID:
            continue
        if closing:
            if open_tags[tag]:
                while stack[-1].tag != tag:
                    open_tags[stack.pop().tag] -= 1
                open_tags[stack.pop().tag] -= 1
                in_link = False
        else:
            if stack[-1].tag in CLOSES.get(tag, ()):
                open_tags[stack.pop().tag] -= 1
                in_link = False
            names, hidden = attributes(inside)
            bad, good = says(names) if names else (False, False)
            number += 1
            if tag == "body" and open_tags["head"]:
                # What was open inside the head goes on without it.
                above = []
                while open_tags["head"]:
                    x = stack.pop()
                    open_tags[x.tag] -= 1
                    if x.tag != "head":
                        above.append(x)
                for x in reversed(above):
                    stack.append(Element(x.tag, x.number, stack[-1], x.own))
                    open_tags[x.tag] += 1
            if not inside.endswith("/"):
                own = OF_TAG.get(tag, 0) | BAD_NAME * bad | GOOD_NAME * good | HIDDEN_IN * (hidden or tag == "template")
                stack.append(Element(tag, number, stack[-1], own))
                open_tags[tag] += 1
    flush()
    return [b for b in out if not b.at.inside & HEAD]


#: Room that the flow takes for none.
TINY = 1e-9


def maximum_flow(n: int, edges: list[tuple[int, int, float, float]], source: int, sink: int) -> list[bool]:
    """Which nodes stand on the source's side of the minimum cut. edges: from, to, capacity, capacity back."""
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n)]
    for a, b, c, back in edges:
        out[a].append(len(to))
        to.append(b)
        room.append(c)
        out[b].append(len(to))
        to.append(a)
        room.append(back)
    tiny = TINY
    while True:
        level = [-1] * n
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in out[u]:
                if room[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [x >= 0 for x in level]
        seen = [0] * n
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if room[e] <= tiny)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while seen[u] < len(out[u]):
                e = out[u][seen[u]]
                if room[e] > tiny and level[to[e]] == level[u] + 1:
                    break
                seen[u] += 1
            if seen[u] < len(out[u]):
                path.append(out[u][seen[u]])
                u = to[path[-1]]
            elif u == source:
                break
            else:
                u = to[path.pop() ^ 1]
                seen[u] += 1


#: Weight of an edge between neighbours under one parent; it falls by FADE for each step in the tree.
SMOOTH, FADE = 1.6, 0.5
#: Greatest capacity of an edge to a terminal.
CERTAIN = 5.0


#: Steps from which an edge weighs less than the flow takes for nothing.
FAR = 32


def apart(a: Block, b: Block) -> int:
    """Steps between two blocks in the tree, beyond those of siblings; FAR if there are more."""
    x, y = a.at, b.at
    deepest = max(x.depth, y.depth)
    while x is not y and deepest - min(x.depth, y.depth) <= FAR:
        if x.depth >= y.depth:
            x = x.parent
        else:
            y = y.parent
    return max(0, deepest - x.depth - 1) if x is y else FAR


def content(found: list[Block], weights: tuple[float, np.ndarray], smooth: float = SMOOTH) -> list[Block]:
    if not found:
        return []
    z = np.clip(weights[0] + features(found) @ weights[1], -CERTAIN, CERTAIN)
    n = len(found)
    edges = [(n, i, float(v), 0.0) if v > 0 else (i, n + 1, float(-v), 0.0) for i, v in enumerate(z)]
    last_under: dict[int, int] = {}
    for i, b in enumerate(found):
        near = set()
        if i:
            near.add(i - 1)
        parent = b.at.parent.number if b.at.parent else 0
        if parent in last_under:
            near.add(last_under[parent])
        last_under[parent] = i
        for j in near:
            w = smooth * FADE ** apart(found[j], b)
            edges.append((j, i, w, w))
    side = maximum_flow(n + 2, edges, n, n + 1)
    return [b for i, b in enumerate(found) if side[i]]


def main_text(page: str | None, weights: tuple[float, np.ndarray] | None = None) -> str:
    return "\n".join(b.text for b in content(blocks(page or ""), weights or fit()))


def made_up_page(seed: int) -> tuple[str, list[str]]:
    """A page and the blocks of its article."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice(["an", "er", "th", "on", "re", "ed", "ti", "es", "or", "la"]) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    sentence = lambda: words(1, 16).capitalize() + r.choice([".", ".", "", ",", "!"])
    para = lambda: " ".join(sentence() for _ in range(r.randint(1, 5)))
    item = lambda: f'<li><a href="/{word()}">{words(1, 3)}</a></li>'
    items = lambda: "<ul>" + "".join(item() for _ in range(r.randint(3, 8))) + "</ul>"
    # Names tell what an element is, or nothing.
    named = lambda *names: f'{r.choice(["class", "id"])}="{r.choice(names) if r.random() < 0.6 else word()}"'
    top = [
        f"<nav>{items()}</nav>", f"<div {named('nav', 'menu', 'main-menu', 'breadcrumbs')}>{items()}</div>", f"<header><h2>{words(1, 3)}</h2><p>{sentence()}</p></header>",
        f"<div {named('header', 'masthead')}><p>{words(2, 5)}</p></div>", f"<div {named('ad', 'advert', 'banner', 'promo')}>{sentence()}</div>", f"<div {named('cookie-notice', 'consent', 'notice')}><p>{sentence()}</p><a href='/'>{word()}</a></div>",
    ]
    low = [
        f"<footer>&copy; {words(2, 9)}</footer>", f"<div {named('footer', 'legal')}><p>&copy; {words(2, 9)}</p></div>", f"<aside><h3>{words(1, 3)}</h3>{items()}<p>{para()}</p></aside>",
        f"<div {named('sidebar', 'widget', 'related')}><h3>{words(1, 3)}</h3>{items()}</div>",
        f"<section class={r.choice(['comments', 'comment-list', 'replies'])}><h3>{words(1, 2)}</h3>" + "".join(f'<div class="comment"><p>{para()}</p></div>' for _ in range(r.randint(1, 4))) + "</section>",
        f"<form><label>{words(1, 3)}</label><input type=text><button>{word()}</button><p>{sentence()}</p></form>", f"<div {named('newsletter', 'share', 'social')}><p>{words(1, 4)}</p><a href='/'>{words(1, 3)}</a></div>",
        f"<div hidden><p>{para()}</p></div>", f'<div style="display:none"><p>{para()}</p></div>', f'<div role="{r.choice(["complementary", "navigation", "contentinfo", "alert"])}"><p>{para()}</p></div>',
    ]
    title, text = words(2, 9).capitalize(), [para() if r.random() < 0.85 else sentence() for _ in range(r.randint(1, 12))]
    inside = [f"<h1>{title}</h1>" if r.random() < 0.8 else f"<header><h1>{title}</h1></header>"]
    for t in text:
        odd = f'<div class="{r.choice(["social-history", "banner-years", "share-of-trade", "comment-on-law", word()])}"><p>{t}</p></div>'
        inside.append(r.choice([f"<p>{t}</p>", f"<p>{t}", f"<p><b>{t}<br>", f"<h2>{t}</h2>", f"<ul><li>{t}</li></ul>", f"<p>{t}</p>", f"<blockquote>{t}</blockquote>", odd]))
    if r.random() < 0.3:
        inside.insert(r.randint(1, len(inside)), r.choice(top[4:] + low[3:]))
    open_, close = r.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class=content>", "</div>"), ('<div id="main"><div class="post">', "</div></div>"), ("<main><article>", "</article></main>"), ("<div>", "</div>"), (f"<div><div id={word()}>", "</div></div>")])
    page = "".join(r.sample(top, r.randint(1, 3))) + open_ + "".join(inside) + close + "".join(r.sample(low, r.randint(1, 4)))
    return f"<!DOCTYPE html><html><head><title>{title}</title><script>var t = '</p>';</script></head><body>{page}</body></html>", [title, *text]


#: Made-up pages that the classifier is fitted on.
PAGES, LASSO = 600, 0.0005


@functools.cache
def fit() -> tuple[float, np.ndarray]:
    x, y = [], []
    for seed in range(PAGES):
        page, wanted = made_up_page(seed)
        found = blocks(page)
        x.append(features(found))
        y += [b.text in wanted for b in found]
    return trees.lasso(np.vstack(x), np.array(y, dtype=float), LASSO, 1500)


def extractor(weights: tuple[float, np.ndarray], at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array((main_text(p.as_py(), weights) for p in batch.column(at)), pa.string(), size=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names[:], "main"])

    return run


def extract(pages: DataFrame, html_col: str = "html") -> tuple[DataFrame, str]:
    """pages with the main text, and that column's name."""
    (name,) = fresh(pages, "text")
    at = next(i for i, c in enumerate(pages.columns) if c.lower() == html_col.lower())
    kept = T.StructType([*pages.schema.fields, T.StructField(name, T.StringType())])
    return pages.mapInArrow(extractor(fit(), at), kept), name


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, name = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return rows.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))
