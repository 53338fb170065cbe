"""Main text of web pages by consensus paths of a host.

Each page names the lowest container that holds all its running text, links and furniture
apart, or all that of its articles where these hold most. The containers' tag and class
paths, numbers generalised, are voted on by all pages of a host. Then each page is read
again: the text is that of the elements on the path that its host prefers, widened to the
page's own container where that lies around it, or is the latter where it has none of those.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyvec.sources.stage import write_stage

PATHS = 5  # paths of a host tried in turn before a page's own container
ENOUGH = 0.3  # share of the text of the page's own container that a path's must reach
MOST = 0.5  # share of a page's text from which its articles are the page
WHOLE = frozenset(("", ">html", ">body", ">html>body"))

_token = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S
)
_attribute = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_digits = re.compile(r"\d+")

# Elements of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template svg iframe object select option button canvas math".split())
ASIDE = frozenset("nav footer aside form dialog menu head header label".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rp rt s samp small span strike"
    " strong sub sup time tt u var wbr".split()
)
CONTAINER = frozenset("article main section div td body center blockquote".split())
ENDS_P = frozenset(
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hr main menu nav ol p pre section table ul".split()
)
_furniture = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|newsletter|subscri\w*"
    r"|signup|sign-up|login|share|sharing|social|related|recommend\w*|sidebar|side|menu|nav\w*|breadcrumbs?|masthead"
    r"|header|footer|comments?|replies|reply|respond|disqus|popup|modal|overlay|pagination|pager|widget|toolbar|skip"
    r"|copyright|legal|disclaimer|alert|outbrain|taboola)(?:$|[\s_-])",
    re.I,
)
_roles = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


class _Node:
    __slots__ = ("tag", "path", "parent", "aside", "link", "order", "prose", "score")

    def __init__(self, tag, path, parent, aside, link):
        self.tag, self.path, self.parent, self.aside, self.link = tag, path, parent, aside, link
        self.prose = self.score = 0.0


def _kind(tag: str, attributes: str) -> tuple[str, bool]:
    """The generalised step of a path, and whether the element is page furniture."""
    furniture = tag in ASIDE
    name = tag
    if attributes and not attributes.isspace():
        for m in _attribute.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                if tag not in ("html", "body", "article", "main") and _furniture.search(value):
                    furniture = True
                if key == "class":
                    name += "." + ".".join(sorted(_digits.sub("#", value).split()))
            elif key == "role":
                furniture = furniture or value.lower() in _roles
            elif value.lower() != "false":
                furniture = True
    return name, furniture


def _pieces(page: str) -> Iterator[tuple[str, _Node]]:
    """Texts of a page in order, with the element that holds each; a block's start gives ''."""
    root = _Node("", "", None, False, False)
    stack, at, raw = [root], 0, ""
    while True:
        if raw:
            end = re.compile(rf"</{re.escape(raw)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            at, raw = end.end(), ""
            continue
        m = _token.search(page, at)
        if m is None:
            yield page[at:], stack[-1]
            return
        if m.start() > at:
            yield page[at : m.start()], stack[-1]
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    if any(n.tag not in INLINE for n in stack[i:]):
                        yield "", stack[i]
                    del stack[i:]
                    break
            else:
                if tag not in INLINE:
                    yield "", stack[-1]
            continue
        if tag not in INLINE:
            yield "", stack[-1]
        if tag in RAW:
            if not m[3].endswith("/"):
                raw = tag
            continue
        if tag in VOID:
            continue
        if tag in ENDS_P or tag in ("li", "td", "th", "tr", "dt", "dd"):
            for i in range(len(stack) - 1, 0, -1):
                above = stack[i].tag
                if (above == "p" and tag in ENDS_P) or above == tag in ("li", "td", "th", "tr", "dt", "dd"):
                    del stack[i:]
                    break
                if above not in INLINE and above != "p":
                    break
        top = stack[-1]
        name, furniture = _kind(tag, m[3])
        path = f"{top.path}>{name}" if tag in CONTAINER or furniture else top.path
        stack.append(_Node(tag, path, top, top.aside or furniture, top.link or tag == "a"))


def _holder(node: _Node) -> _Node | None:
    while node is not None and node.tag not in CONTAINER:
        node = node.parent
    return node


def read(page: str | None) -> tuple[list[tuple[str, str]], dict[str, float]]:
    """The prose pieces of a page with the paths of their containers, and the length of each path's prose."""
    pieces: list[tuple[str, str]] = []
    scores: dict[str, float] = {}
    for text, node in _pieces(page or ""):
        if node.aside:
            if not text:
                pieces.append(("", ""))
            continue
        holder = _holder(node)
        path = holder.path if holder else ""
        pieces.append((text, path))
        if text and not node.link and (size := len(text.strip())):
            scores[path] = scores.get(path, 0.0) + size
    return pieces, scores


def _under(path: str, above: str) -> bool:
    return path == above or path.startswith(above + ">") or not above


def _size(scores: dict[str, float], path: str) -> float:
    return sum(s for p, s in scores.items() if _under(p, path))


def _article(path: str) -> str | None:
    """The outermost article or main element on a path."""
    steps = path.split(">")
    for i, step in enumerate(steps):
        if step.split(".")[0] in ("article", "main"):
            return ">".join(steps[: i + 1])
    return None


def container(scores: dict[str, float]) -> str:
    """The path of the lowest container of all prose, or of that in articles if it is most."""
    articles = {a for p in scores if (a := _article(p)) is not None}
    inside = [p for p in scores if _article(p) is not None]
    if sum(scores[p] for p in inside) >= MOST * sum(scores.values()):
        paths = list(articles) if len(articles) > 1 else inside
    else:
        paths = list(scores)
    shared = paths[0].split(">")
    for path in paths[1:]:
        steps = path.split(">")
        n = next((i for i, (a, b) in enumerate(zip(shared, steps)) if a != b), min(len(shared), len(steps)))
        shared = shared[:n]
    return ">".join(shared)


def chosen(scores: dict[str, float], paths: list[str]) -> str:
    """A page's path: the first of its host's that holds enough, or its own; the wider of the two below the body."""
    own = container(scores)
    most = _size(scores, own)
    path = next((p for p in paths if _size(scores, p) >= ENOUGH * most), own)
    return own if own not in WHOLE and _under(path, own) else path


def text_of(pieces: list[tuple[str, str]], path: str) -> str:
    """The text under ``path``: blocks trimmed, white space made one space."""
    inside = path + ">"
    parts = [html.unescape(t) if t else " " for t, p in pieces if p == path or p.startswith(inside) or not path or not t]
    return " ".join("".join(parts).split())


def host_of(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def vote(pages: DataFrame) -> DataFrame:
    """``(host, paths)``: the paths that a host's pages prefer, best first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths, shares = [], [], []
            for host, page in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, scores = read(page.as_py())
                if scores:
                    hosts.append(host)
                    paths.append(container(scores))
                    shares.append(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array(hosts, pa.string()), pa.array(paths, pa.string()), pa.array(shares, pa.int64())],
                ["host", "path", "votes"],
            )

    cast = pages.select(host_of(F.col("url")).alias("host"), "html").mapInArrow(work, "host string, path string, votes long")
    summed = cast.groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    best = Window.partitionBy("host").orderBy(F.desc("votes"), "path")
    ranked = summed.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PATHS)
    paths = F.transform(F.array_sort(F.collect_list(F.struct("rank", "path"))), lambda x: x["path"])
    return ranked.groupBy("host").agg(paths.alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text)``: the article text of every page.

    Takes ``page_id, url, html``; other columns are ignored. A null page is empty, a page
    without prose has an empty text; a null or odd url is of the host ``''``; repeated rows
    vote and come back like others; no rows give none. Nothing is cut or dropped by size.
    """
    # Written, so that its true size decides how it meets the pages: sent whole if it is small.
    winners = write_stage(vote(pages), "html-paths")
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    schema = f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, paths in zip(batch.column(2), batch.column(3).to_pylist()):
                pieces, scores = read(page.as_py())
                if not scores:
                    texts.append("")
                    continue
                texts.append(text_of(pieces, chosen(scores, paths or [])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
            )

    met = named.join(winners, "host", "left").select("page_id", "url", "html", "paths")
    return met.mapInArrow(work, schema)
