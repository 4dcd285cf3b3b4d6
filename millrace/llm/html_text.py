"""Main text of web pages by the line-block distribution.

Mark-up is stripped to lines, one for each block element, in page order.  What lies in scripts,
styles, forms, menus, headers, footers, sidebars, notices, adverts and comments, and lists of links,
becomes lines without text (names of elements tell it; inside an article only names all words of
which say so, while its own header, which may be its title, is text).  Over windows of ``window`` lines the text lengths are summed; the sum
surges where main text begins and dives to nothing where it ends.  The text between the surge and
the dive with the most text is kept, with every other such stretch of at least ``share`` of it and
every shorter one near a kept one.  Where article or main elements hold most of the page's text, their
borders are surges and dives too, and text inside them counts 1 / ``share`` times.

Inside a block white space becomes one space; blocks are joined by an empty line; character
references are decoded.

Defined results: null and empty pages have the empty text; text outside any element is a block; an
element that is never closed ends with its parent; pages that repeat give a row each; an empty table
gives an empty result; other columns than page_id, url and html are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces

# No part scans past the next "<" but for quoted values and what a comment or a CDATA section opens, so a page is read in linear time.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^<>]*>|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<rest>(?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_ARTICLE = re.compile(r"<article[\s/>]", re.I)
_WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")

# Element names of HTML by what they mean for text.
_RAW = {"script", "style", "noscript", "template", "iframe", "object", "svg", "textarea", "select", "canvas", "audio", "video", "map"}
_BOILERPLATE = {"nav", "footer", "aside", "form", "menu", "dialog", "head"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
    "th", "thead", "title", "tr", "ul",
}
# Words of class, id and role that name what is no main text.
_NAMED = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "complementary", "consent", "contentinfo",
    "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "pagination", "popup",
    "promo", "promotion", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget",
}
# Those of them that may name a part of an article's text, and words of class and id that say nothing of what is held.
_NAMED_OUTSIDE = {"header", "complementary", "masthead"}
_HOLDERS = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "close", "col", "container", "content", "field", "form", "group", "holder", "icons", "inline", "inner", "item", "items", "layer",
    "left", "link", "links", "list", "main", "message", "outer", "overlay", "panel", "right", "root", "row", "section", "slot", "text", "thread", "top", "unit", "wrap", "wrapper",
}
_CLOSED_BY = {"p": _BLOCKS, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "tr": {"tr"}, "option": {"option"}}


def _boilerplate(tag: str, rest: str, inside_article: bool, only_article: bool) -> bool:
    """Whether an element holds no main text.  Inside an article all words of a class or id must say so: an "ad-slot" or
    "comment-list" there is none, an "article-header" or "related-work" is text, and so is the article's own header."""
    if tag in _BOILERPLATE or tag in ("header", "button") and not inside_article:
        return True
    if tag in ("html", "body", "main") or tag == "article" and only_article or not rest:
        return False
    names = (next(filter(None, found.groups()), "") for found in _NAMES.finditer(rest))
    if inside_article and tag != "article":
        return any(_names_no_part([w.lower() for w in _WORDS.findall(name)]) for found in names for name in found.split())
    return any(word.lower() in _NAMED for found in names for word in _WORDS.findall(found))


def _names_no_part(words: list[str]) -> bool:
    told = [w in _NAMED and w not in _NAMED_OUTSIDE for w in words]
    return any(told) and all(t or w in _HOLDERS for t, w in zip(told, words, strict=True))


def lines(page: str) -> list[tuple[str, bool]]:
    """Text of every block ("" for what is no main text) and whether it lies in an article element."""
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool]] = []  # tag, dropped, in an article
    depth: Counter[str] = Counter()  # open elements by tag
    at, end, raw = 0, len(page), None
    only_article = len(_ARTICLE.findall(page)) < 2

    def flush() -> None:
        nonlocal linked
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
            out.append(("" if dropped or linked >= 0.8 * len(block) and not article else block, article))
        linked = 0

    def pop(to: int) -> None:
        depth.subtract(tag for tag, _, _ in stack[to:])
        del stack[to:]

    while at < end:
        if raw:
            close = re.compile(rf"</{re.escape(raw)}\s*>", re.I).search(page, at)
            at, raw = (close.end() if close else end), None
            continue
        found = _TOKEN.search(page, at)
        chunk = page[at : found.start() if found else end]
        if chunk and not (stack and stack[-1][0] == "button" and stack[-1][1]):
            text.append(chunk)
            if any(tag == "a" for tag, _, _ in stack[-4:]):
                linked += len(chunk.strip())
        if not found:
            break
        at = found.end()
        if found["cdata"]:
            text.append(html.escape(found["cdata"]))
        if not found["tag"]:
            continue
        tag, rest = found["tag"].lower(), found["rest"]
        if tag == "br":
            text.append(" ")
            continue
        if tag in _BLOCKS:
            flush()
        if found["close"]:
            if depth[tag] > 0:
                pop(next(k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag))
            continue
        if tag in _RAW:
            if not rest.endswith("/"):
                raw = tag
            continue
        if tag in _VOID or rest.endswith("/") and tag not in _BLOCKS:
            continue
        for k in range(len(stack) - 1, max(-1, len(stack) - 6), -1):  # end tags that may be left out
            if tag in _CLOSED_BY.get(stack[k][0], ()):
                pop(k)
                break
            if stack[k][0] in ("ul", "ol", "dl", "table", "div", "section", "article"):
                break
        dropped, article = (stack[-1][1], stack[-1][2]) if stack else (False, False)
        article = article or tag in ("article", "main")
        stack.append((tag, dropped or _boilerplate(tag, rest, article, only_article), article))
        depth[tag] += 1
    flush()
    return out


def main_blocks(found: list[tuple[str, bool]], window: int = 3, share: float = 0.25) -> list[str]:
    """Blocks between surges and dives of the line-block distribution."""
    if not found:
        return []
    lengths = np.array([len(block) for block, _ in found], dtype=np.int64)
    inside = np.array([x for _, x in found])
    if lengths[inside].sum() <= lengths[~inside].sum():
        inside[:] = False
    sums = np.convolve(lengths, np.ones(window, dtype=np.int64))  # sums[i]: lines i - window + 1 .. i
    full = np.flatnonzero(sums > 0)
    if not len(full):
        return []
    runs = np.split(full, np.flatnonzero(np.diff(full) > 1) + 1)
    stretches = []  # surge, dive
    for run in runs:
        a, b = int(run[0]), min(int(run[-1]) - window + 2, len(found))
        borders = [a, *(a + 1 + np.flatnonzero(np.diff(inside[a:b]))).tolist(), b]
        stretches += zip(borders, borders[1:], strict=False)
    totals = [lengths[a:b].sum() / (share if inside[a] else 1) for a, b in stretches]
    kept = [n > 0 and n >= share * max(totals) for n in totals]
    for order in (range(1, len(stretches)), range(len(stretches) - 2, -1, -1)):  # what is near, downwards and upwards
        for i in order:
            j = i - 1 if order.step > 0 else i + 1
            (a, b), (c, d) = stretches[i], stretches[j]
            kept[i] = kept[i] or kept[j] and inside[a] == inside[c] and max(a - d, c - b) <= 2 * window
    return [found[i][0] for (a, b), keep in zip(stretches, kept, strict=True) if keep for i in range(a, b) if found[i][0]]


def extract(page: str | None) -> str:
    return "\n\n".join(main_blocks(lines(page or "")))


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in pieces(batches, 512):
            texts = [extract(page) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    chosen = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"], F.lit("")).alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(spark.read.parquet(f"{sf_dir}/pages.parquet"))
