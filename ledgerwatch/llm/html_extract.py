"""Main text of web pages by gradient-boosted trees over DOM nodes.

Every block element of a page is described by its own measures and those of its subtree, its siblings, ancestors and attribute
tokens; boosted trees give the probability that it is main content. Decoding goes down the tree with three states -
outside, content, rubbish - where rubbish holds rubbish only, and nothing outside lies below content. The best assignment of
the whole page is found by dynamic programming, so an ancestor and its descendants never contradict each other.

No page of the tables is labelled. The trees learn from a bounded sample of pages whose markup names its parts (article or
main, nav, header, footer, aside, form and telling class names), each also in rewritten forms without those names or with
further parts, so that structure and density must carry the decision where names are missing. If no page of a table names any,
the sample is made of pages put together from the table's own words.

Text. Elements of the block list break lines, others run on; white space in a block becomes one space, blocks are joined
by one line end, character references are decoded. Script, style, template, noscript and head never count.

Defined results: null and empty html give ''. A page in which no element is content gives ''. Markup may be cut or nested
badly: open elements end where their parent does. Order and repetition of rows don't matter.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import column

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style template noscript head title iframe svg object select option textarea button".split())
BLOCK = frozenset(
    "html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th "
    "figure figcaption nav header footer aside form fieldset address details summary hr dialog menu".split())
CLOSES_P = BLOCK - {"html", "body"}
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}
TAGS = ["html", "body", "main", "article", "section", "div", "p", "h1", "h2", "ul", "li", "table", "td", "blockquote", "pre",
        "nav", "header", "footer", "aside", "form"]
GOOD = ["article", "content", "main", "post", "entry", "story", "text", "body"]
BAD = ["nav", "menu", "footer", "header", "sidebar", "side", "widget", "ad", "ads", "advert", "banner", "promo", "sponsor", "cookie", "notice", "consent",
       "popup", "modal", "newsletter", "subscribe", "share", "social", "related", "comment", "comments", "reply", "respond", "form", "breadcrumb",
       "breadcrumbs", "copyright", "login", "search", "pagination", "tags", "disclaimer", "alert"]
TOKEN = re.compile(r"[a-z]+")
SPACES = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "tokens", "parent", "parts", "children", "at")

    def __init__(self, tag: str, tokens: frozenset[str], parent: "Node | None"):
        self.tag, self.tokens, self.parent = tag, tokens, parent
        self.parts: list = []  # texts, "\n" marks by None, and block children in page order
        self.children: list[Node] = []
        self.at = -1


class Tree(HTMLParser):
    """Block elements of a page. Texts of inline elements belong to the block around them, link texts marked."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", frozenset(), None)
        self.stack: list[tuple[str, Node | None]] = [("#root", self.root)]
        self.node, self.hidden, self.links = self.root, 0, 0

    def end(self, k: int) -> None:
        """Ends the open elements from place k on."""
        for tag, node in self.stack[k:]:
            if tag in HIDDEN:
                self.hidden -= 1
            if tag == "a":
                self.links -= 1
            if node is not None:
                self.node = node.parent
        del self.stack[k:]

    def place(self, tags: tuple[str, ...], limits: frozenset[str]) -> int:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] in tags:
                return k
            if self.stack[k][0] in limits:
                return 0
        return 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P and (k := self.place(("p",), BLOCK - {"p"})):
            self.end(k)
        if tag in ENDS and (k := self.place(ENDS[tag], frozenset(("ul", "ol", "dl", "table")))):
            self.end(k)
        if tag == "body" and (k := self.place(("head",), frozenset())):
            self.end(k)
        if tag in VOID:
            if not self.hidden:
                self.node.parts.append((" ", 0))
            return
        node = None
        if tag in HIDDEN:
            self.hidden += 1
        if tag == "a":
            self.links += 1
        if tag in BLOCK:
            words = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role", "itemprop")).lower()
            node = Node(tag, frozenset(TOKEN.findall(words)), self.node)
            self.node.parts.append(node)
            self.node.children.append(node)
            self.node = node
        self.stack.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HIDDEN:  # nothing is in it, so nothing is hidden
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag not in VOID and (k := self.place((tag,), frozenset() if tag in BLOCK or tag in HIDDEN else BLOCK)):
            self.end(k)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.node.parts.append((data, 1 if self.links else 0))


def nodes_of(html: str | None) -> list[Node]:
    """Block elements in page order, parents first; the first one is the page."""
    tree = Tree()
    tree.feed(html or "")
    tree.close()
    out, todo = [], [tree.root]
    while todo:
        node = todo.pop()
        node.at = len(out)
        out.append(node)
        todo.extend(reversed(node.children))
    return out


def described(nodes: list[Node]) -> np.ndarray:
    """One row of measures per node."""
    n = len(nodes)
    own = np.zeros((n, 4))  # characters, characters in links, sentence ends, links
    parent = np.array([x.parent.at if x.parent else 0 for x in nodes])
    depth, order = np.zeros(n), np.zeros(n)
    siblings = np.ones(n)
    good, bad = np.zeros(n), np.zeros(n)
    tags = np.zeros((n, len(TAGS)))
    good_words, bad_words, tag_place = set(GOOD), set(BAD), {t: i for i, t in enumerate(TAGS)}
    for i, x in enumerate(nodes):
        for part in x.parts:
            if type(part) is tuple:
                text, link = part
                size = len(text)
                own[i, 0] += size
                own[i, 1] += size * link
                own[i, 2] += text.count(".")
                own[i, 3] += link
        if x.tag in tag_place:
            tags[i, tag_place[x.tag]] = 1
        good[i], bad[i] = len(x.tokens & good_words), len(x.tokens & bad_words)
        if x.parent:
            depth[i] = depth[x.parent.at] + 1
            siblings[i] = len(x.parent.children)
        for k, child in enumerate(x.children):
            order[child.at] = k
    total = own.copy()
    count = np.ones(n)
    paragraphs = np.array([x.tag == "p" for x in nodes], float)
    inner_bad = bad + tags[:, tag_place["nav"] :].sum(axis=1)
    over_good, over_bad = good + tags[:, 2] + tags[:, 3], inner_bad.copy()
    for i in range(n - 1, 0, -1):
        p = parent[i]
        total[p] += total[i]
        count[p] += count[i]
        paragraphs[p] += paragraphs[i]
    for i in range(1, n):
        over_good[i] += over_good[parent[i]]
        over_bad[i] += over_bad[parent[i]]
    page = np.maximum(total[0], 1)
    around = np.maximum(total[parent][:, 0], 1)
    text = np.maximum(total[:, 0], 1)
    place = np.arange(n) / max(1, n - 1)
    before = np.concatenate([[0], np.cumsum(own[:-1, 0])]) / page[0]
    before_text = np.zeros(n)
    behind_text = np.zeros(n)
    for x in nodes:
        for a, b in zip(x.children, x.children[1:]):
            before_text[b.at], behind_text[a.at] = total[a.at, 0], total[b.at, 0]
    rest = np.stack([
        np.log1p(own[:, 0]), np.log1p(total[:, 0]), total[:, 1] / text, own[:, 1] / np.maximum(own[:, 0], 1), np.log1p(total[:, 2]), total[:, 2] / text * 100,
        np.log1p(total[:, 3]), np.log1p(count), total[:, 0] / count, total[:, 0] / page[0], total[:, 0] / around, np.log1p(paragraphs),
        depth, siblings, order / siblings, place, before, good, bad, over_good - good, over_bad - inner_bad, np.log1p(before_text), np.log1p(behind_text),
        tags[parent].argmax(axis=1)], axis=1)
    return np.concatenate([tags, rest], axis=1)


# Boosted trees --------------------------------------------------------------------------------


class Trees:
    """Regression trees of fixed depth on binned measures, boosted on the logistic loss."""

    def __init__(self, depth: int = 4, rounds: int = 40, rate: float = 0.3, bins: int = 32):
        self.depth, self.rounds, self.rate, self.bins = depth, rounds, rate, bins
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        cuts = [np.unique(np.quantile(c, np.arange(1, self.bins) / self.bins)) for c in x.T]
        binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(len(y), self.base)
        inner = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
            node = np.zeros(len(y), np.int64)
            for level in range(self.depth):
                base, width = (1 << level) - 1, 1 << level
                best = np.full(width, 1e-6)
                local = node - base
                whole_g = np.bincount(local, g, width)
                whole_h = np.bincount(local, h, width)
                for f, c in enumerate(cuts):
                    if not len(c):
                        continue
                    key = local * (len(c) + 1) + binned[:, f]
                    left_g = np.cumsum(np.bincount(key, g, width * (len(c) + 1)).reshape(width, -1), axis=1)[:, :-1]
                    left_h = np.cumsum(np.bincount(key, h, width * (len(c) + 1)).reshape(width, -1), axis=1)[:, :-1]
                    right_g, right_h = whole_g[:, None] - left_g, whole_h[:, None] - left_h
                    gain = left_g**2 / (left_h + 1) + right_g**2 / (right_h + 1) - (whole_g**2 / (whole_h + 1))[:, None]
                    gain[(left_h < 1) | (right_h < 1)] = 0
                    at = gain.argmax(axis=1)
                    value = gain[np.arange(width), at]
                    for k in np.flatnonzero(value > best):
                        best[k], feature[base + k], limit[base + k] = value[k], f, c[at[k]]
                node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
            leaf = node - inner
            sums_g, sums_h = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
            values = -self.rate * sums_g / (sums_h + 1)
            self.trees.append((feature, limit, values))
            margin += values[leaf]
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows, inner = np.arange(len(x)), (1 << self.depth) - 1
        for feature, limit, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            out += values[node - inner]
        return out


# Decoding and text ------------------------------------------------------------------------------


def contents(nodes: list[Node], margin: list[float]) -> list[bool]:
    """Content or not, for every node: the assignment of highest probability in which rubbish holds rubbish only and
    content holds content or rubbish. Per node, the log odds of content count once; ties go against content."""
    n = len(nodes)
    inside, outside = [0.0] * n, [0.0] * n  # best sums below and at a node that is content, or outside
    for i in range(n - 1, -1, -1):
        a, b = margin[i], 0.0
        for child in nodes[i].children:
            best = inside[child.at]
            a += best if best > 0 else 0.0
            b += max(best, outside[child.at], 0.0)
        inside[i], outside[i] = a, b
    state = [0] * n  # 1 content, 0 outside, -1 rubbish
    for i, x in enumerate(nodes):
        above = state[x.parent.at] if x.parent else 0
        if above == -1:
            state[i] = -1
        elif above == 1:
            state[i] = 1 if inside[i] > 0 else -1
        else:
            state[i] = 1 if inside[i] > 0 and inside[i] >= outside[i] and x.parent else 0
    return [s == 1 for s in state]


def text_of(nodes: list[Node], content: list[bool]) -> str:
    """Blocks of the content in page order."""
    blocks: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACES.sub(" ", "".join(held)).strip()
        if text:
            blocks.append(text)
        held.clear()

    todo: list = [nodes[0]]
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif type(part) is tuple:
            if part[1]:
                held.append(part[0])
        else:
            flush()
            own = content[part.at]
            todo.append(None)
            todo.extend((x[0], own) if type(x) is tuple else x for x in reversed(part.parts))
    flush()
    return "\n".join(blocks)


# Training pages -----------------------------------------------------------------------------------


def named(nodes: list[Node]) -> np.ndarray | None:
    """Labels from markup that names its parts: content is what lies in article or main, without parts whose tag or
    class says otherwise; the page's elements around it aren't. None where nothing is named."""
    if not any(x.tag in ("article", "main") for x in nodes):
        return None
    state = np.zeros(len(nodes), np.int64)
    for i, x in enumerate(nodes[1:], 1):
        above = state[x.parent.at]
        rubbish = x.tag in ("nav", "footer", "aside", "form", "menu", "dialog") or x.tag == "header" and above == 0 or x.tokens & set(BAD)
        state[i] = -1 if above == -1 or rubbish else 1 if above == 1 or x.tag in ("article", "main") else 0
    return (state == 1).astype(float)


def rewritten(html: str, draw: random.Random) -> str:
    """The page in another dress: parts renamed to plain elements or other names, and further parts around or
    in its article made of its own texts. Labels are taken over by marks that are removed before anything is measured."""
    words = re.sub(r"<[^>]*>", " ", html).split() or ["a"]

    def some(low: int, high: int) -> str:
        at = draw.randrange(len(words))
        return " ".join(words[at : at + draw.randint(low, high)]) or words[0]

    pick = draw.choice
    menu = "".join(f'<li><a href="/{k}">{some(1, 3)}</a></li>' for k in range(draw.randint(3, 9)))
    links = "".join(f'<li><a href="/r{k}">{some(3, 9)}</a></li>' for k in range(draw.randint(2, 6)))
    wrap = lambda names, tags, inner: (lambda t: f'<{t}{pick(["", *[f" class={chr(34)}{n}{chr(34)}" for n in names], f" id={chr(34)}{names[0]}{chr(34)}"])} data-rubbish>{inner}</{t}>')(pick(tags))
    top = [
        wrap(["site-header", "header", "banner"], ["header", "div"], f"<p>{some(1, 6)}</p>" + f"<ul>{menu}</ul>"),
        wrap(["cookie-notice", "consent", "notice"], ["div", "section"], f"<p>{some(8, 25)}</p><p><a href='/ok'>{some(1, 2)}</a></p>"),
        wrap(["breadcrumbs", "menu"], ["div", "nav"], f"<ul>{menu}</ul>"),
        wrap(["search", "login"], ["form", "div"], f"<form><p>{some(1, 4)}</p><label>{some(1, 2)}</label></form>")]
    comments = "".join(f'<div class="comment"><p>{some(1, 2)}</p><p>{some(5, 60)}</p></div>' for _ in range(draw.randint(1, 4)))
    bottom = [
        wrap(["sidebar", "widget", "related"], ["aside", "div"], f"<h2>{some(1, 4)}</h2><ul>{links}</ul>"),
        wrap(["comments", "responses"], ["section", "div"], f"<h2>{some(1, 3)}</h2>{comments}"),
        wrap(["newsletter", "subscribe", "promo"], ["div", "form"], f"<p>{some(5, 20)}</p>"),
        wrap(["ad", "advert", "sponsor"], ["div", "aside"], f"<p>{some(3, 20)}</p>"),
        wrap(["footer", "copyright"], ["footer", "div"], f"&copy; <p>{some(3, 15)}</p>")]
    html = re.sub(r"<(article|main)\b", r"<\1 data-content", html)
    before = "".join(x for x in top if draw.random() < 0.4)
    behind = "".join(x for x in bottom if draw.random() < 0.4)
    within = "".join(x for x in bottom[:4] if draw.random() < 0.2)
    html = re.sub(r"(?=<article data-content)", lambda m: before, html, count=1)
    html = re.sub(r"(?=</article>)", lambda m: within, html, count=1)
    html = re.sub(r"(?<=</article>)", lambda m: behind, html, count=1)
    if draw.random() < 0.6:
        tag = pick(["div", "section", "main"])
        name = pick(["", ' class="content"', ' class="post"', ' id="main"', ' class="entry-content"', ' class="c1"'])
        html = re.sub(r"<article data-content[^>]*>", f"<{tag}{name} data-content>", html).replace("</article>", f"</{tag}>")
    if draw.random() < 0.4:
        html = html.replace("<nav>", "<div data-rubbish>").replace("</nav>", "</div>")
    if draw.random() < 0.4:
        html = html.replace("<footer>", '<div data-rubbish class="bottom">').replace("</footer>", "</div>")
    if draw.random() < 0.3:
        html = html.replace('<div class="ad">', "<div data-rubbish>")
    return html


class Marked(Tree):
    """A tree that remembers the training marks."""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        super().handle_starttag(tag, attrs)
        marks = {k for k, _ in attrs}
        if tag in BLOCK and marks & {"data-content", "data-rubbish"}:
            self.marks = getattr(self, "marks", {})
            self.marks[id(self.node)] = 1 if "data-content" in marks else -1


def examples(html: str, draw: random.Random, dresses: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    nodes = nodes_of(html)
    labels = named(nodes)
    if labels is None:
        return
    yield described(nodes), labels
    for _ in range(dresses):
        tree = Marked()
        tree.feed(rewritten(html, draw))
        tree.close()
        marks, nodes, todo = getattr(tree, "marks", {}), [], [tree.root]
        while todo:
            node = todo.pop()
            node.at = len(nodes)
            nodes.append(node)
            todo.extend(reversed(node.children))
        state = [0] * len(nodes)
        for i, x in enumerate(nodes[1:], 1):
            above, mark = state[x.parent.at], marks.get(id(x), 0)
            rubbish = mark == -1 or x.tag in ("nav", "footer", "aside", "form") or not mark and x.tokens & set(BAD)
            state[i] = -1 if above == -1 or rubbish else 1 if above == 1 or mark == 1 else 0
        yield described(nodes), (np.array(state) == 1).astype(float)


def made(html: str, draw: random.Random) -> str:
    """A page of named parts out of another page's words, for tables in which no page names any."""
    words = re.sub(r"<[^>]*>", " ", html).split() or ["a"]

    def some(low: int, high: int) -> str:
        at = draw.randrange(len(words))
        return " ".join(words[at : at + draw.randint(low, high)]) or words[0]

    links = "".join(f'<li><a href="/{k}">{some(1, 3)}</a></li>' for k in range(draw.randint(3, 9)))
    body = "".join(f"<p>{some(20, 90)}.</p>" for _ in range(draw.randint(2, 12)))
    return f"<html><body><nav><ul>{links}</ul></nav><article><h1>{some(3, 9)}</h1>{body}</article><footer><p>{some(3, 15)}</p></footer></body></html>"


def chosen(pages: DataFrame, sample: int, key: str) -> list[tuple[object, str]]:
    """At most ``sample`` pages (id, html) by hash of their id: the ids first, so that no other page's html leaves its task."""
    rows = pages.select(column(key).alias("id"), "html", F.xxhash64("html").alias("h"))
    ids = rows.select("id", "h").distinct().orderBy(F.xxhash64("id"), "id", "h").limit(sample).select(F.col("id").alias("own"), F.col("h").alias("mark"))
    of_ids = rows.join(F.broadcast(ids), F.col("id").eqNullSafe(F.col("own")) & (F.col("h") == F.col("mark")))  # ``sample`` rows
    once = of_ids.groupBy("id", "h").agg(F.min("html").alias("html"))
    return [(r.id, r.html) for r in sorted(once.collect(), key=lambda r: (str(r.id), r.h))]


def trained(pages: DataFrame, sample: int = 300, dresses: int = 3, key: str = "page_id") -> Trees | None:
    """Trees from at most ``sample`` pages, chosen by hash of their id, with named parts. Where no page has any, from pages made of the words
    of as many others; None for a table without html."""
    some = chosen(pages.where(F.lower("html").rlike("<(article|main)[ >]")), sample, key)
    found = [e for i, html in some for e in examples(html, random.Random(str(i)), dresses)]
    if not found:
        some = chosen(pages.where("html IS NOT NULL AND html <> ''"), sample, key)
        found = [e for i, html in some for e in examples(made(html, random.Random(str(i))), random.Random(str(i)), dresses)]
    if not found:
        return None
    return Trees().fit(np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found]))


def extracted(html: list[str | None], model: Trees | None) -> list[str]:
    pages = [nodes_of(h) for h in html]
    if not pages or model is None:
        return [""] * len(pages)
    margins = model.margins(np.concatenate([described(p) for p in pages])).tolist()
    out, at = [], 0
    for nodes in pages:
        out.append(text_of(nodes, contents(nodes, margins[at : at + len(nodes)])))
        at += len(nodes)
    return out


def main_text(pages: DataFrame, sample: int = 300, key: str = "page_id", size: int = 64) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``; html goes."""
    model = trained(pages, sample, key=key)
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                texts = extracted(part.column("html").to_pylist(), model)
                yield pa.RecordBatch.from_arrays(
                    [part.column(key), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                    names=[key, "url", "text", "n_chars"])

    return pages.select(key, "url", "html").mapInArrow(run, f"`{key}` {kinds[key]}, url string, text string, n_chars bigint")
