"""Main-text extraction by composite text density.

A page becomes a tree of nodes.  Page parts that are never article text go first: by element (menus,
footers, sidebars, forms, scripts, styles ...), or by the names an element gives itself (comments,
adverts, notices ...) when it holds no article.  For every node C characters, T tags, LC characters in
links and LT link tags of its subtree give its link-adjusted density

    C / T * log_{ln(C * LC / (C - LC) + C * LCb / Cb + e)} (C / LC * T / LT)     (b: the body)

and the density sum of its children.  The node with the largest sum is found; the least density on its
path from the body is the threshold; every node at or over it that isn't marked yet marks the subtree
with the largest sum inside it.  Marked subtrees, whole up to an enclosing article, are the text.  Where a page marks
any text inside an article or main element, only text inside such elements counts (all of them).

Pages are independent rows in Arrow batches; a task holds one page's tree at a time, time and memory
follow the page length however deep its elements are nested, and nothing is shuffled.

Defined results: a null or empty html, or one without article text, gives an empty text; broken markup
is repaired as far as needed (unclosed elements end with their parent, an unterminated comment or
script runs to the end); repeated rows get equal results; an empty table gives an empty table; other
columns are not read; null page_id and url are passed on.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"<!--|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>|<[!?][^>]*>?")
ATTR = re.compile(r"([a-zA-Z_:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")

#: HTML elements by role.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript textarea title iframe xmp noembed noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre "
            "search section summary table caption colgroup tbody td tfoot th thead tr ul".split())
NOISE = set("head nav footer aside form script style noscript textarea title iframe template svg math canvas object "
            "button select dialog menu search audio video map datalist".split())
#: Words in an element's class, id or role that name a page part, and those that name the article.
PARTS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar "
            "navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead topbar toolbar cookie cookies "
            "consent notice notices alert popup modal overlay newsletter subscribe subscription signup login share "
            "sharing social related recommended recommendations pagination pager widget widgets comment comments "
            "disqus respond replies reply complementary contentinfo dialog search".split())
COMMENTS = {"comment", "comments", "disqus", "respond", "replies"}
ARTICLE = set("article content main post entry story body text".split())
#: Elements that start tags of the same kind (or blocks, for p) close.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"),
          "th": ("td", "th"), "option": ("option",)}
HEAD = set("title meta link style script base noscript template".split())
LIMITS = set("ul ol dl table body html article section div".split())


class Node:
    __slots__ = ("tag", "parent", "kids", "noise", "holds", "link", "chars", "tags", "lchars", "ltags", "density", "sum", "mark", "own", "article", "main", "top")

    def __init__(self, tag: str, parent: "Node | None", noise: bool = False):
        self.tag, self.parent, self.kids, self.noise, self.holds = tag, parent, [], noise, False
        self.link = tag == "a" or (parent is not None and parent.link)
        self.chars = self.tags = self.lchars = self.ltags = 0
        self.density = self.sum = 0.0
        self.mark = self.own = False
        # the outermost article and the innermost main around the element
        self.article = parent.article if parent and parent.article else self if tag == "article" else None
        self.main = self if tag == "main" else parent.main if parent else None
        self.top = self


def named(attrs: str) -> tuple[bool, bool]:
    """Whether an element's own names mark it as a part of the page around the article, or as the article."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, False
    got = {m[0].lower(): (m[1] or m[2] or m[3]).lower() for m in ATTR.findall(attrs)}
    if re.search(r"display\s*:\s*none", got.get("style", "")) or re.search(r"(?:^|\s)hidden(?:\s|/|$|=)", attrs.lower()):
        return True, False
    words = set(re.split(r"[^a-z0-9]+", f"{got.get('class', '')} {got.get('id', '')} {got.get('role', '')}"))
    hit = words & PARTS
    noise = bool(hit and (not words & ARTICLE or hit & COMMENTS))
    return noise, bool(words & ARTICLE) and not noise


def tree(page: str) -> tuple[Node, list[Node], list[tuple[Node, str, int]]]:
    """(root, nodes in page order, text segments as (node, text, block number))."""
    root = Node("#root", None)
    nodes, texts, stack, block = [root], [], [root], 0
    at, end, opened = 0, len(page), Counter()

    def close_from(i: int) -> None:
        opened.subtract(n.tag for n in stack[i:])
        del stack[i:]

    def add_text(raw: str) -> None:
        texts.append((stack[-1], html.unescape(raw) if "&" in raw else raw, block))

    while at < end:
        m = TOKEN.search(page, at)
        if m is None:
            add_text(page[at:])
            break
        if m.start() > at:
            add_text(page[at:m.start()])
        at = m.end()
        if m[0] == "<!--":
            close = page.find("-->", at)
            at = end if close < 0 else close + 3
            continue
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag in BLOCK:
            block += 1
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if opened[tag] > 0 else ():
                if stack[i].tag == tag:
                    close_from(i)
                    break
                if stack[i].tag in LIMITS and tag not in BLOCK:  # a stray inline end tag closes no block
                    break
            continue
        if tag in ("html", "body") and opened[tag] > 0:
            continue
        if opened["head"] > 0 and tag not in HEAD:
            close_from(next(i for i, n in enumerate(stack) if n.tag == "head"))
        closes = CLOSES.get(tag, ())
        if tag in BLOCK and tag != "body":
            closes = (*closes, "p")
        for i in range(len(stack) - 1, 0, -1) if any(opened[c] > 0 for c in closes) else ():
            if stack[i].tag in closes:
                close_from(i)
                break
            if stack[i].tag in LIMITS:
                break
        parent = stack[-1]
        in_article = parent.own
        noise = parent.noise or tag in NOISE or (tag == "header" and not in_article)
        node = Node(tag, parent, noise)
        node.own = in_article or tag in ("article", "main")
        if not noise and tag not in ("html", "body", "article", "main"):
            node.mark, article = named(m[3])  # the mark is settled when its subtree is known
            node.own = node.own or article
        parent.kids.append(node)
        nodes.append(node)
        if tag in ("article", "main"):
            up = parent
            while up is not None and not up.holds:
                up.holds, up = True, up.parent
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if close is None:
                at = end
            else:
                stop = page.find(">", close.end())
                at = end if stop < 0 else stop + 1
        elif tag == "br":
            texts.append((parent, " ", block))
        elif tag not in VOID:  # a slash before the bracket closes nothing in html
            stack.append(node)
            opened[tag] += 1
    return root, nodes, texts


def measure(nodes: list[Node], texts: list[tuple[Node, str, int]]) -> None:
    for n in nodes[1:]:  # parents come before children
        if n.parent.noise or (n.mark and not n.holds):
            n.noise = True
        n.mark = False
    for node, text, _ in texts:
        if not node.noise:
            size = len("".join(text.split()))
            node.chars += size
            if node.link:
                node.lchars += size
    for n in reversed(nodes[1:]):
        if n.noise:
            continue
        p = n.parent
        p.chars += n.chars
        p.lchars += n.lchars
        p.tags += n.tags + 1
        p.ltags += n.ltags + (n.tag == "a")
    for n in nodes:  # lists of links inside the text are menus
        if (n.parent is not None and n.parent.noise) or (
                n.tag in ("ul", "ol", "div", "table", "section", "dl") and n.ltags >= 3 and n.lchars > 0.8 * n.chars and not n.holds):
            n.noise = True
    body = next((n for n in nodes if n.tag == "body"), nodes[0])
    share = body.lchars / max(body.chars, 1)
    for n in nodes:
        if n.noise or not n.chars:
            continue
        c, t, lc, lt = n.chars, max(n.tags, 1), max(n.lchars, 1), max(n.ltags, 1)
        base = math.log(c * lc / max(c - lc, 1) + share * c + math.e)
        n.density = c / t * math.log(max(c / lc * t / lt, 1.0)) / math.log(base)
    for n in nodes:
        n.sum = sum(k.density for k in n.kids if not k.noise) or n.density
    for n in reversed(nodes):  # the node with the largest sum in every subtree, the first of equal ones
        for k in n.kids:
            if not k.noise and k.top.sum > n.top.sum:
                n.top = k.top


def mark_all(n: Node) -> None:
    """Mark the subtree of n; below a marked node everything is marked already."""
    todo = [n]
    while todo:
        x = todo.pop()
        if not x.noise and not x.mark:
            x.mark = True
            todo.extend(x.kids)


def main_text(page: str | None) -> str:
    """The page's article text, one line per block."""
    if not page:
        return ""
    root, nodes, texts = tree(page)
    measure(nodes, texts)
    body = next((n for n in nodes if n.tag == "body" and not n.noise), root)
    best = body.top
    if not best.chars or best.noise:
        return ""
    limit, up = best.density, best
    while up is not None:
        limit = min(limit, up.density)
        if up is body:
            break
        up = up.parent

    todo = [body]
    while todo:
        n = todo.pop()
        if n.mark or n.noise or n.density < limit:
            continue
        mark_all(n.top.article or n.top.main or n.top)  # the largest sum in n, whole up to an enclosing article
        todo.extend(reversed(n.kids))
    inside = any(n.mark and (n.article or n.main) for n in nodes)
    lines, block, parts = [], -1, []

    def flush() -> None:
        line = " ".join("".join(parts).split())
        if line:
            lines.append(line)
        parts.clear()

    for node, text, b in texts:
        if b != block:
            flush()
            block = b
        if node.mark and not node.noise and (not inside or node.article or node.main):
            parts.append(text)
    flush()
    return "\n".join(lines)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                ids, urls, pages_ = (c.slice(at, 256) for c in batch.columns)
                texts = [main_text(p) for p in pages_.to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [ids, urls, pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())],
                    ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op2_density(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
