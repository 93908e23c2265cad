"""Words and links of HTML pages, and URL resolution, as Arrow functions around the standard library's parsers."""

from __future__ import annotations

import re
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit, urlunsplit

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .counts import runs
from .text import TERM

#: Bytes of pages that are parsed at a time.
PART = 1 << 20
_TERM = re.compile(TERM)


class _Words(HTMLParser):
    """Takes a page's terms node by node, as no term goes from one node to the next, and its anchors' targets."""

    def __init__(self, html: str, words: bool = True):
        super().__init__()
        if not words:
            self.handle_data = lambda data: None
        self.words: list[str] = []
        self.links: list[str] = []
        self.feed(html)

    def handle_data(self, data):
        self.words += map(str.lower, _TERM.findall(data))

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.links += (value for name, value in attrs if value and name == "href")


def words_and_links(html: str | None) -> tuple[list[str], list[str]]:
    """Terms of all text nodes (scripts and styles too), and raw href values of anchors, both in page order.

    The parser isn't closed: text after the last tag that could still become a character reference is not seen.
    """
    page = _Words(html or "")
    return page.words, page.links


def resolve(base: str | None, href: str | None) -> str | None:
    """The absolute http(s) URL without its fragment, or None; a malformed one is None too."""
    try:
        url = urlsplit(urljoin(base or "", (href or "").strip()))
    except ValueError:
        return None
    whole = url.netloc and url.scheme in {"http", "https"}
    return urlunsplit(url._replace(fragment="")) if whole else None


def _lists(source: pa.Array, found) -> pa.Array:
    """A list of strings for each page, made of PART bytes of pages at a time, as Python's strings take many times what Arrow's do."""
    sizes, kind = pc.fill_null(pc.binary_length(source), 0).to_numpy(zero_copy_only=False).astype(np.int64), pa.list_(pa.string())
    return pa.concat_arrays([pa.array([], kind), *(pa.array([found(h) for h in source.slice(a, b - a).to_pylist()], kind) for a, b in runs(sizes, PART))])


def page_words(html: Column) -> Column:
    @F.arrow_udf("array<string>")
    def words(source: pa.Array) -> pa.Array:
        return _lists(source, lambda h: _Words(h or "").words)

    return words(html)


def page_links(html: Column) -> Column:
    @F.arrow_udf("array<string>")
    def links(source: pa.Array) -> pa.Array:
        return _lists(source, lambda h: _Words(h or "", words=False).links)

    return links(html)


def resolve_url(base: Column, href: Column) -> Column:
    @F.arrow_udf("string")
    def join(b: pa.Array, h: pa.Array) -> pa.Array:
        return pa.array([resolve(x, y) for x, y in zip(b.to_pylist(), h.to_pylist())], pa.string())

    return join(base, href)
