"""Entity decoding, visible text and links of HTML, as vectorised functions."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements that start a new line, and elements whose content isn't visible.
BLOCKS = frozenset("p br div li ul ol h1 h2 h3 h4 h5 h6 tr table section article blockquote pre".split())
HIDDEN = frozenset("head noscript script style template".split())


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0
        self.links: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        if tag in BLOCKS:
            self.out.append("\n")
        if tag == "a":
            self.links += [v for k, v in attrs if k == "href" and v is not None][:1]

    def handle_endtag(self, tag):
        if tag in HIDDEN and self.hidden:
            self.hidden -= 1
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def visible_text(markup: str) -> str:
    """Lines of visible text: white space collapsed, empty lines dropped."""
    parser = _Text()
    parser.feed(markup)
    parser.close()
    lines = (" ".join(line.split()) for line in "".join(parser.out).split("\n"))
    return "\n".join(line for line in lines if line)


def link_targets(markup: str) -> list[str]:
    parser = _Text()
    parser.feed(markup)
    parser.close()
    return parser.links


def to_text(markup: Column, escaped: bool = False) -> Column:
    """Visible text of an HTML fragment; escaped: it is entity-escaped once more. Null stays null."""

    @F.pandas_udf("string")
    def text(s: pd.Series) -> pd.Series:
        return s.map(lambda m: None if m is None else visible_text(html.unescape(m) if escaped else m))

    return text(markup)


def unescape(text: Column) -> Column:
    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else html.unescape(t))

    return decode(text)


def links(markup: Column) -> Column:
    """array<string> of every a[href] in order, decoded."""

    @F.pandas_udf("array<string>")
    def hrefs(s: pd.Series) -> pd.Series:
        return s.map(lambda m: None if m is None else link_targets(m))

    return hrefs(markup)


_TAG = re.compile(r"<[^<>]*>")


def tags_to_breaks(text: str) -> str:
    """Each tag as a line break; enough where only sentences matter."""
    return _TAG.sub("\n", text)
