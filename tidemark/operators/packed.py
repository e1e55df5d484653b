"""Several values packed in one field → one row per value, by a quote-aware finite-state tokenizer.

The machine reads a text once and knows three things: whether it is inside a quoted value, how
deep it is inside brackets, and whether it stands at the start of a value (only there does a quote
mark open a quoted value; elsewhere it is a plain character). It notes every delimiter outside
quotes and brackets. Strong delimiters (; | newline tab • · and spaced / — or, where asked for,
" or ") split whenever one is there. A comma splits only where no strong one does, and then
  * every comma, if a quoted value stands next to one (the writer quoted what holds commas);
  * else, with ``regions``: every comma, unless the text is one place followed by its own region,
    its own country or both, so that "Town, Region" stays whole and "Town, Town" doesn't;
  * else every comma, unless the text is a plain sentence.

Defined results
  null or empty text      → no pieces
  one value               → one piece (position 0); callers that want packed fields only ask for two
  unclosed quote/bracket  → read as a plain character
  empty values            → skipped, positions count the kept pieces
  very long texts         → read whole, linear time
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.folding import fold

STRONG = set(";|\n\t•·")
SPACED = set("/—–")
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, set(")]}")
_ENTITY = re.compile(r"&(?:#\d+|#x[0-9a-fA-F]+|[A-Za-z]\w*);")
_EDGES = re.compile(r"^[\s;|•·]+|[\s;|•·]+$")
_LEAD_MODE = re.compile(r"^(?:(?:remote|hybrid|on-?site)\s*[-–—:]\s*|(?:remote\s+)?(?:based in|in)\s+)(?=\S)")
# Parts that name no place, folded.
_NO_PLACE = frozenset(["remote", "hybrid", "onsite", "on-site", "anywhere", "worldwide", "distributed", "multiple locations", "tbd", "global"])
_MODE = re.compile(r"\s*(?:\([^()]*\)|[-–—]\s*(?:onsite|on-site|remote|hybrid|in office))\s*$")
_POSTCODE = re.compile(r"\s+\d[\d -]*$")


def _scan(text: str, words: tuple[str, ...], quotes: bool, brackets: bool) -> tuple[list[tuple[int, int]], list[tuple[int, int]], bool, bool, list[tuple[int, int]]]:
    """Strong cuts, commas, whether a quote and a bracket stayed open, and the quoted spans."""
    strong, commas, spans, closers, at_start, i, n = [], [], [], [], True, 0, len(text)
    opened = -1
    while i < n:
        c = text[i]
        if opened >= 0:
            if c == "\\" and i + 1 < n and text[i + 1] in '"\\':
                i += 2
                continue
            if c == '"':
                if i + 1 < n and text[i + 1] == '"':
                    i += 2
                    continue
                spans.append((opened, i + 1))
                opened = -1
            i += 1
            continue
        if c == '"' and at_start and quotes:
            opened, at_start = i, False
        elif brackets and c in OPEN:
            closers.append(OPEN[c])
            at_start = False
        elif brackets and c in CLOSE and closers:
            if c == closers[-1]:
                closers.pop()
        elif closers:
            pass
        elif c == "&" and (m := _ENTITY.match(text, i)):
            i, at_start = m.end(), False
            continue
        elif c in STRONG:
            strong.append((i, i + 1))
            at_start = True
        elif c in SPACED and 0 < i < n - 1 and text[i - 1].isspace() and text[i + 1].isspace():
            strong.append((i, i + 1))
            at_start = True
        elif c == ",":
            commas.append((i, i + 1))
            at_start = True
        elif c.isspace():
            word = next((w for w in words if text.startswith(w, i + 1) and i + 1 + len(w) < n and text[i + 1 + len(w)].isspace()), None) if i else None
            if word:
                strong.append((i, i + 1 + len(word)))
                i, at_start = i + 1 + len(word), True
                continue
        else:
            at_start = False
        i += 1
    return strong, commas, opened >= 0, bool(closers), spans


def _value(raw: str) -> str:
    raw = raw.strip()
    if len(raw) >= 2 and raw[0] == raw[-1] == '"':
        inner = raw[1:-1]
        if re.fullmatch(r'(?:[^"\\]|""|\\.)*', inner, re.S):
            raw = re.sub(r'\\(["\\])', r"\1", inner.replace('""', '"')).strip()
    return raw


def _is_sentence(text: str) -> bool:
    words = re.findall(r"[^\W\d_][\w'’-]*", text)
    small = sum(w[0].islower() for w in words)
    return len(words) >= 4 and small > len(words) / 2


class Regions:
    """Which regions and countries a comma may stand before: names and codes, and which of them a known place has."""

    def __init__(self, rows: Iterable[tuple]):
        """rows: place name, ASCII name, region code, region name, country code, country name; any may be null."""
        self.countries: set[str] = set()
        self.of_region: dict[str, set[str]] = {}
        self.of_place: dict[str, set[str]] = {}
        for name, ascii_name, *own in rows:
            admin, country = ({fold(q) for q in pair if q} for pair in (own[:2], own[2:]))
            self.countries |= country
            for q in admin:
                self.of_region.setdefault(q, set()).update(country)
            for n in {fold(n) for n in (name, ascii_name) if n}:
                self.of_place.setdefault(n, set()).update(admin | country)

    def known(self, text: str) -> bool:
        return text in self.countries or text in self.of_region

    def is_one(self, parts: list[str]) -> bool:
        """Whether comma-separated parts are one place with its own region or country, or both."""
        first = _bare(parts[0])
        rest = [_bare(p, lead=False) for p in parts[1:]]
        if not first or self.known(first) or first in _NO_PLACE or len(rest) > 2:
            return False
        own = self.of_place.get(first)
        if own is not None and not own.issuperset(rest):
            return False
        if len(rest) == 1:
            return self.known(rest[0])
        return rest[1] in self.of_region.get(rest[0], ())


def _bare(part: str, lead: bool = True) -> str:
    """A part without work mode (in front only with lead), wrapping brackets and postcode, folded."""
    text = fold(part)
    while True:
        less = _POSTCODE.sub("", _MODE.sub("", _LEAD_MODE.sub("", text) if lead else text)).strip()
        if lead and (m := re.fullmatch(r"(?:remote|hybrid|on-?site)?\s*\(([^()]*)\)", less)) is not None:
            less = m[1].strip()
        if less == text:
            return text
        text = less


def tokenize(text: str | None, words: tuple[str, ...] = (), regions: Regions | None = None) -> list[str]:
    """The values of one packed text in order; see the module's rules."""
    if not text:
        return []
    text = _EDGES.sub("", text)
    quotes = brackets = True
    while True:
        strong, commas, open_quote, open_bracket, spans = _scan(text, words, quotes, brackets)
        if open_quote and quotes:
            quotes = False
        elif open_bracket and brackets:
            brackets = False
        else:
            break
    if strong:
        cuts = strong
    elif not commas:
        cuts = []
    else:
        beside = lambda a, b: any(not text[e:a].strip() for _, e in spans if e <= a) or any(not text[b:s].strip() for s, _ in spans if s >= b)
        if any(beside(a, b) for a, b in commas):
            cuts = commas
        elif regions is None:
            cuts = [] if _is_sentence(text) else commas
        else:
            starts, ends = [0, *[b for _, b in commas]], [*[a for a, _ in commas], len(text)]
            cuts = [] if regions.is_one([text[a:b] for a, b in zip(starts, ends)]) else commas
    pieces, at = [], 0
    for a, b in [*cuts, (len(text), len(text))]:
        if value := _value(text[at:a]):
            pieces.append(value)
        at = b
    return pieces


def pieces(text: Column, words: Iterable[str] = (), regions: Regions | None = None, entities: bool = True) -> Column:
    """array<string> of the values in a packed text. entities: decode HTML entities first."""
    words = tuple(words)

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else tokenize(html.unescape(t) if entities and "&" in t else t, words, regions))

    return split(text)


def explode_pieces(df: DataFrame, pieces_col: str, pos: str, piece: str, least: int = 1) -> DataFrame:
    """One row per piece with its position; rows with fewer than ``least`` pieces are left out."""
    keep = [F.col(f"`{c}`") for c in df.columns if c != pieces_col]
    return df.where(F.size(F.col(f"`{pieces_col}`")) >= least).select(*keep, F.posexplode(F.col(f"`{pieces_col}`")).alias(pos, piece))
