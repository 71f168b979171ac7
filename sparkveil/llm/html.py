"""Main text of web pages: flat text blocks, classified by a decision tree from their neighbourhood."""

from __future__ import annotations

import html
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkveil.llm.common import slices, workers

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<data>.*?)(?:\]\]>|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^<>]*\Z|(?P<text>[^<]+|<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
_WORD = re.compile(r"\S+")
#: Content of these is no text of the page: it is code, names the page, stands in for a script, or is part of a form.
_RAW = {"script", "style", "noscript", "template", "title", "iframe", "textarea", "select", "button", "noframes", "noembed"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Tags at which a block ends and another begins.
_BREAKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
_HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
_PROSE = {*_HEADINGS, "p", "pre", "blockquote", "figcaption", "dd", "dt", "caption"}
#: A weak hint: elements, roles and whole class names or ids that usually surround an article, and those that usually hold one.
_AROUND_TAGS, _MAIN_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "head", "fieldset"}, {"article", "main"}
_AROUND_NAMES = set("ad ads advert advertisement banner nav navbar navigation menu breadcrumb breadcrumbs sidebar footer header masthead cookie-notice cookies consent notice modal popup newsletter subscribe login share sharing related comment search contentinfo complementary dialog".split())
#: Names of what readers wrote, which holds inside an article, too; other names tell less there, as the article may be of such things.
_READER_NAMES = {"comments", "respond", "replies"}
_MAIN_NAMES = set("article content main post entry story main-content post-content entry-content article-body".split())


@dataclass(slots=True)
class Block:
    text: str
    words: int
    link_density: float
    hint: float  # of the nearest element that gives one: 1 an article, -1 what surrounds one, -0.5 a name of such inside an article, 0 none does
    heading: bool
    prose: bool  # a paragraph, heading or the like, not a bare box or list


def _hint(name: str, rest: str) -> float:
    """What an element's tag, role, class and id suggest of its content: 1, -1, -0.5 by name only, -2 hidden, or 0."""
    names = set()
    if rest and not rest.isspace():
        found = {}
        for m in _ATTRIBUTE.finditer(rest):
            found.setdefault(m[1].lower(), m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or "")
        if "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", "")):
            return -2
        names = set(f"{found.get('class', '')} {found.get('role', '')} {found.get('id', '')}".lower().split())
    if name in ("body", "html") or name in _HEADINGS:
        return 0
    if name in _MAIN_TAGS:
        return -1 if names & {"comment", "comments"} else 1
    if name in _AROUND_TAGS or names & _READER_NAMES:
        return -1
    if names & _AROUND_NAMES:
        return -0.5
    return 1 if names & _MAIN_NAMES else 0


def _within(said: float, name: str, hint: float) -> float:
    """What is told inside an element, from what is told around it and its own hint: the innermost one's, but a box inside a
    menu or the like is still part of it, a header or footer inside an article belongs to the article, a name of what surrounds
    articles tells less inside one, and what is hidden stays hidden."""
    if said == -2 or hint == 0 or (hint == 1 and said < 0 and name not in _MAIN_TAGS):
        return said
    if hint == -0.5:
        return -0.5 if said in (1, -0.5) else -1
    return said if hint == -1 and said == 1 and name in ("header", "footer") else hint


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. Unclosed elements end with the element around them. Time is linear in the page."""
    out: list[Block] = []
    stack: list[tuple[str, float]] = []  # open block elements and what is told inside each
    counts: dict[str, int] = {}  # of the names in it
    unended: set[str] = set()  # raw elements of which no end follows
    parts: list[str] = []
    linked: list[str] = []
    anchors, heading = 0, False

    def flush() -> None:
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = len(text.split(" "))
                in_links = len(_WORD.findall(html.unescape(" ".join(linked))))
                hint = stack[-1][1] if stack else 0
                if hint > -2:
                    out.append(Block(text, words, min(1.0, in_links / words), hint, heading, stack[-1][0] in _PROSE if stack else False))
            parts.clear()
            linked.clear()

    def push(name: str, hint: float) -> None:
        stack.append((name, _within(stack[-1][1] if stack else 0, name, hint)))
        counts[name] = counts.get(name, 0) + 1

    def pop() -> str:
        name, _ = stack.pop()
        counts[name] -= 1
        return name

    at, n, last = 0, len(page), page.rfind(">")
    while at < n:
        if at > last:  # no tag ends any more: the rest is text, but for a tag that was cut off
            rest = re.sub(r"</?[a-zA-Z!?][^<]*\Z", "", page[at:])
            parts.append(rest)
            if anchors:
                linked.append(rest)
            break
        m = _TAG.match(page, at)
        at = m.end()
        if (text := m["text"]) is not None:
            parts.append(text)
            if anchors:
                linked.append(text)
            continue
        if m["data"] is not None:
            parts.append(html.escape(m["data"], quote=False))
            continue
        if m["name"] is None:
            continue
        name = m["name"].lower()
        if not m["end"] and name in _RAW:
            if not m["rest"].endswith("/") or name in ("script", "style", "title", "textarea"):
                close = None if name in unended else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                if close is None:
                    unended.add(name)
                at = close.end() if close else (n if name in ("script", "style", "textarea") else at)
            parts.append(" ")
            continue
        if name == "a":
            anchors = 0 if m["end"] else 1
        if name in ("br", "td", "th", "wbr", "img", "input"):
            parts.append(" " if name != "wbr" else "")
        if name not in _BREAKS and not (not m["end"] and name not in _VOID and m["rest"] and _hint(name, m["rest"])):
            if m["end"] and stack and stack[-1][0] == name:
                flush()
                pop()
            continue
        flush()
        anchors = 0 if name != "a" else anchors
        if name in _HEADINGS:
            heading = not m["end"]
        elif not m["end"]:
            heading = False
        if m["end"]:
            while counts.get(name) and pop() != name:
                pass
        elif name not in _VOID and not m["rest"].endswith("/"):
            if name in ("p", *_HEADINGS) and stack and stack[-1][0] == "p":
                pop()
            if name in ("body", "main", "article"):  # these end a head or menu that was left open
                while stack and stack[-1][0] in ("head", "p", "li", "ul", "ol"):
                    pop()
            push(name, _hint(name, m["rest"]))
    flush()
    return out


#: The features of a block, in this order.
FEATURES = ("words", "density", "words before", "density before", "words after", "density after", "words two before", "words two after", "longest near", "heading", "prose", "hint")
_NEAR = 3


def features(found: list[Block]) -> np.ndarray:
    """For each block its word count and link density, those of its neighbours, the most words of an unlinked block near it, and its kind."""
    n = len(found)
    words, density = np.zeros(n + 2 * _NEAR), np.zeros(n + 2 * _NEAR)
    words[_NEAR : n + _NEAR], density[_NEAR : n + _NEAR] = [b.words for b in found], [b.link_density for b in found]
    plain = words * (density < 0.5)
    at = [slice(_NEAR + k, _NEAR + k + n) for k in range(-_NEAR, _NEAR + 1)]
    near = np.max([plain[at[_NEAR + k]] for k in range(-_NEAR, _NEAR + 1)], axis=0) if n else np.zeros(0)
    here, before, after, before2, after2 = at[_NEAR], at[_NEAR - 1], at[_NEAR + 1], at[_NEAR - 2], at[_NEAR + 2]
    kinds = [[b.heading for b in found], [b.prose for b in found], [b.hint for b in found]]
    return np.column_stack([words[here], density[here], words[before], density[before], words[after], density[after], words[before2], words[after2], near, *np.array(kinds, float).reshape(3, n)])


#: The labelled pages. ``+3..80`` stands for so many words of main text, ``-3..80`` for others, short ones more often; each page is drawn
#: several times: with its tags as they are, and, but for those that begin with ``!`` (their comments, notices and asides read like an
#: article), with tags of layout and names taken away, and with paragraphs and lists turned into plain boxes, too.
LABELLED = (
    "<nav><ul><li><a>-1..2</a><li><a>-1</a><li><a>-1..3</a><li><a>-1</a></ul></nav><div class='ad'>-6..14</div><article><h1>+4..12</h1><p>+4..14<p>+20..140</p><p>+2..30</p><p>+2..90</p><p>+1..60</p><p>+3..120</p></article><footer>-5..16</footer>",
    "<nav><a>-1</a> <a>-1..2</a></nav><article><h1>+2..12</h1><p>+1..200</p><p>+1..200</p><p>+1..200</p><p>+1..200</p><p>+1..200</p><p>+1..200</p><p>+1..200</p></article><footer>-3..16</footer>",
    "<div><a>-1</a></div><h1>+2..12</h1><p>+1..200</p><p>+1..200</p><p>+1..200</p><p>+1..200</p><p>+1..200</p><p>+1..200</p><div>-3..14</div>",
    "<article><h1>+2..12</h1><p>+1..30</p><p>+1..30</p><p>+1..200</p><p>+1..30</p><p>+1..30</p></article>",
    "!<nav><ul><li><a>-1..2</a><li><a>-1</a><li><a>-1..3</a></ul></nav><div class='ad'>-3..16</div><article><h1>+2..12</h1><p>+2..12<p>+1..30</p></article><footer>-5..16</footer>",
    "!<header><a>-2</a><form>-1..3</form></header><nav><a>-1</a> <a>-1</a> <a>-2</a></nav><main><h1>+3..9</h1><p>+30..90</p><p>+25..70</p><h2>+2..5</h2><p>+12..60</p><ul><li>+3..12</li><li>+4..14</li><li>+5..9</li></ul><p>+20..60</p></main><aside><h3>-2</h3><ul><li><a>-4..9</a></li><li><a>-3..8</a></li><li><a>-5..9</a></li></ul></aside><footer><p>-6..14</p><a>-1</a> <a>-2</a></footer>",
    "!<div class='header'><h1><a>-2..3</a></h1><p>-4..8</p></div><div class='content'><h2>+4..9</h2><p>+2..5</p><p>+50..150</p><p>+40..120</p><blockquote>+10..40</blockquote><p>+8..60</p></div><div class='related'><h3>-2</h3><a>-3..8</a><a>-4..8</a></div><div class='comments'><h3>-2</h3><p>-8..40</p><p>-5..30</p><p>-12..50</p></div><div class='footer'>-6..12</div>",
    "!<article><header><h1>+3..9</h1><p>+3..7</p></header><p>+25..80</p><p><a>+3..6</a></p><p>+30..70</p><pre>+8..40</pre><p>+10..50</p><footer><p>+3..9</p></footer></article><section class='comments'><h2>-1..2</h2><div>-10..40</div><div>-6..30</div></section>",
    "<nav><div class='main'>-1 <a>-1</a> <a>-2</a></div></nav><div class='post-header'><h1>+4..8</h1></div><div class='footer-post'><p>+30..90</p><p>+20..70</p><p>+5..30</p></div><ul><li><a>-1</a></li><li><a>-2</a></li></ul>",
    "<div><a>-1</a> <a>-1..2</a></div><div>-2..12</div><div><a>-1</a> <a>-1..3</a></div><div>+20..120</div><div>+3..90</div><div>+3..90</div>",
    "<div>+20..120</div><div>+3..90</div><div><a>-1</a> <a>-1..2</a></div><div>-2..12</div><div><a>-1</a> <a>-1..3</a></div>",
    "<h1>+2..6</h1><p>+4..9</p><p>+3..8</p>", "<h1>+2..6</h1><p>+3..12</p><p>+4..12</p><p>+2..10</p><p>+3..9</p>",
    "<ul><li><a>-1</a></li><li><a>-2</a></li><li><a>-1</a></li></ul><h1>+3..8</h1><p>+4..60</p><p>+3..60</p><ul><li><a>-2</a></li><li><a>-1..3</a></li></ul><div>-4..9</div>",
    "!<div class='notice'>-10..30 <a>-1..2</a></div><nav><a>-1</a> <a>-1</a></nav><article><h1>+5..10</h1><p>+60..160</p><p>+40..120</p><p>+50..200</p></article><div class='newsletter'><h3>-3..6</h3><p>-8..16</p></div><footer>-8..20</footer>",
    "<div><a>-1</a> <a>-2</a> <a>-1</a></div><div>+3..8</div><div>+20..150</div><div>+5..90</div><div>+5..110</div><div><a>-2</a> <a>-1</a> -1 <a>-2</a></div><div>-4..10</div>",
    "<table><tr><td><a>-1</a></td><td><a>-1</a></td></tr></table><p>+25..60</p><p>+30..90</p><table><tr><td>+2</td><td>+3</td></tr><tr><td>+2</td><td>+4</td></tr></table><p>+15..60</p><p>-1 <a>-1</a> <a>-2</a></p>",
    "!<main><article><h1>+3..9</h1><p>+10..40</p></article></main><aside><p>-20..60</p></aside><div class='ad'>-5..40</div><footer><p>-10..40</p></footer>",
    "!<div class='sidebar'><h3>-2</h3><p>-10..40</p><a>-3</a></div><div class='post'><h1>+4..9</h1><p>+30..80</p><div class='ad'>-4..12</div><p>+20..80</p><p>+3..8</p></div>",
    "!<nav><a>-1</a> <a>-1..2</a></nav><article><h1>+4..12</h1><p>+1..9</p><p><a>+2..6</a></p><p>+1..9</p></article><footer>-5..16</footer>",
    "!<article><p>+2..60</p><p><a>+3..7</a></p><p>+2..60</p></article>", "!<article><div class='post-header'><h1>+1..8</h1></div><p>+1..40</p></article>", "!<article><header><h1>+1..8</h1><p>+1..6</p></header><p>+2..40</p></article>",
    "!<article><h2>+1..4</h2><p>+2..40</p><h2>+1..4</h2><p>+2..40</p></article>", "!<article><p>+1..3</p></article>", "!<article><h1>+1..4</h1></article>", "!<main>+1..30</main>",
    "!<nav><a>-1</a></nav><main><p>+1..8</p><aside>-2..9</aside></main><footer>-1..6</footer>", "!<header><h1>-1..4</h1></header><article>+1..9</article><form>-1..4</form>",
    "!<article><p>+1..6</p><div class='ad'>-1..9</div><p>+1..6</p></article><div id='cookie-notice'>-5..20</div>",
    "!<article><h1>+3..9</h1><p>+5..60</p><section class='related'><h2>+1..6</h2><p>+25..150</p><p>+25..90</p></section><p>+5..60</p></article>",
    "!<article><h1>+3..9</h1><p>+5..80</p><section class='search'><h2>+1..6</h2><p>+25..150</p></section></article>", "!<main><h1>+2..8</h1><section class='notice'><h2>+1..6</h2><p>+25..150</p></section></main>",
    "!<article><h1>+1..9</h1><p>+1..80</p><div class='banner'><h2>+1..6</h2><p>+25..150</p></div></article>", "!<article><h1>+1..9</h1><p>+1..80</p><div class='share'>+30..150</div></article>",
    "!<article><h1>+3..9</h1><p>+5..80</p><div class='share'>-1..12</div><p>+5..80</p><div class='related'><h3>-1..3</h3><a>-3..8</a><a>-3..8</a></div></article>",
    "!<article><p>+5..80</p><div class='notice'>-2..14</div><p>+5..60</p><div class='newsletter'><h3>-2..6</h3><p>-4..14</p></div></article>",
)
_FILL = re.compile(r"([+-])(\d+)(?:\.\.(\d+))?")
_LAYOUT = re.compile(r"<(/?)(?:nav|header|footer|main|article|aside|section|form)\b[^>]*>")
_PROSE_TAGS = re.compile(r"<(/?)(?:p|blockquote|pre|ul|li)\b[^>]*>")


def labelled_rows(draws: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels (1 main text) of the blocks of the labelled pages. Words are drawn from the ranges by a fixed seed.
    """
    r = random.Random(6)
    rows, labels = [], []
    for page in LABELLED:
        for _ in range(draws):
            drawn = _FILL.sub(lambda m: " ".join(["m" if m[1] == "+" else "x"] * int(math.exp(r.uniform(math.log(int(m[2])), math.log(int(m[3] or m[2]) + 0.99))))), page.removeprefix("!"))
            unnamed = _LAYOUT.sub(r"<\1div>", re.sub(r" (?:class|id)='[^']*'", "", drawn))
            for kind in (drawn,) if page[0] == "!" else (drawn, unnamed, _PROSE_TAGS.sub(r"<\1div>", unnamed)):
                found = blocks(kind)
                rows.append(features(found))
                labels += [b.text.count("m") > b.text.count("x") for b in found]
    return np.concatenate(rows), np.array(labels, float)


class Tree:
    """A binary decision tree by Gini impurity; no leaf holds fewer than ``least`` rows."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 16, least: int = 5):
        self.least = least
        self.node = self._grow(x, y, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        n, ones = len(y), float(y.sum())
        if depth == 0 or ones in (0.0, float(n)):
            return ones / n
        best = None
        for f in range(x.shape[1]):
            order = np.argsort(x[:, f], kind="stable")
            v, below = x[order, f], np.cumsum(y[order])
            k = np.arange(1, n)
            impurity = below[:-1] * (1 - below[:-1] / k) + (ones - below[:-1]) * (1 - (ones - below[:-1]) / (n - k))
            impurity[(v[1:] == v[:-1]) | (k < self.least) | (n - k < self.least)] = np.inf
            at = int(np.argmin(impurity))
            if np.isfinite(impurity[at]) and (best is None or impurity[at] < best[0] - 1e-9):
                best = (impurity[at], f, float(v[at] + v[at + 1]) / 2)
        if best is None or best[0] > ones * (1 - ones / n) - 1e-9:
            return ones / n
        _, f, cut = best
        low = x[:, f] <= cut
        return (f, cut, self._grow(x[low], y[low], depth - 1), self._grow(x[~low], y[~low], depth - 1))

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """The share of main text in the leaf of each row."""
        out = np.empty(len(rows))
        todo = [(self.node, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if isinstance(node, tuple):
                low = rows[at, node[0]] <= node[1]
                todo += [(node[2], at[low]), (node[3], at[~low])]
            else:
                out[at] = node
        return out

    def said(self, node=None, indent: str = "") -> str:
        """The tree as text."""
        node = self.node if node is None else node
        if not isinstance(node, tuple):
            return f"{indent}{node:.2f}\n"
        return f"{indent}{FEATURES[node[0]]} <= {node[1]:g}\n" + self.said(node[2], indent + "  ") + f"{indent}else\n" + self.said(node[3], indent + "  ")


@lru_cache(maxsize=1)
def train() -> Tree:
    """The tree of the labelled pages. Blocks that a name inside an article is told of have a branch of their own: there are few of
    them, and they are to be told by their words and neighbours alone."""
    x, y = labelled_rows()
    named = x[:, -1] == -0.5
    tree, own = Tree(x[~named], y[~named]), Tree(x[named], y[named])
    hint = len(FEATURES) - 1
    tree.node = (hint, -0.75, tree.node, (hint, -0.25, own.node, tree.node))
    return tree


def chosen(pages: list[list[Block]], tree: Tree) -> list[list[bool]]:
    """For each page's blocks whether the tree takes them for main text."""
    said = (tree.predict(np.concatenate([features(found) for found in pages])) >= 0.5).tolist() if pages else []
    out, at = [], 0
    for found in pages:
        out.append(said[at : at + len(found)])
        at += len(found)
    return out


def joined(found: list[Block], taken: list[bool]) -> str:
    return "\n".join(b.text for b, c in zip(found, taken, strict=True) if c)


def main_text(page: str | None, tree: Tree) -> tuple[str, list[tuple[Block, bool]]]:
    """The main text, blocks joined by a line feed, and every block with the tree's decision."""
    found = blocks(page or "")
    (taken,) = chosen([found], tree)
    return joined(found, taken), list(zip(found, taken, strict=True))


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url"), tree: Tree | None = None) -> DataFrame:
    """Main text of every whole page: ``keep``, text, n_chars (code points), n_blocks and n_kept.

    Null html counts as empty: an empty text. Repeated rows give repeated rows, an empty table an empty
    one; other columns of ``pages`` are not read. What is hidden by attribute or inline style is left out. Pages
    without a telling element are judged by the word counts and link densities of neighbouring blocks alone.
    """
    tree = tree or train()
    source = pages.select(*keep, F.coalesce(F.col(html_column), F.lit("")).alias("_sv_html"))
    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "_sv_html", 4 << 20):
            found = [blocks(h.as_py()) for h in batch.columns[-1]]
            taken = chosen(found, tree)
            texts = [joined(f, c) for f, c in zip(found, taken, strict=True)]
            arrays = [pa.array(texts, pa.string()), *(pa.array(list(map(f, v)), pa.int64()) for f, v in ((len, texts), (len, found), (sum, taken)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *arrays], [*batch.schema.names[:-1], "text", "n_chars", "n_blocks", "n_kept"])

    return workers(source).mapInArrow(run, head + "text string, n_chars long, n_blocks long, n_kept long")
