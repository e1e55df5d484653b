"""Location text → entries with work modes, scope and place parts, before any gazetteer.

Defined results: null gives null, empty text no entries; a mode word counts wherever it stands as a
whole word; parts that carry no place are dropped; entries keep the order of the text.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that state a work mode ('' for words that only widen the scope).
MODE_WORDS = {
    "work from home": "remote", "remote first": "remote", "fully remote": "remote", "remotely": "remote", "remote": "remote", "wfh": "remote", "hybrid": "hybrid", "on site": "onsite", "onsite": "onsite",
    "in office": "onsite", "in person": "onsite", "office based": "onsite", "home based": "remote", "distributed": "remote", "anywhere": "", "worldwide": "", "world wide": "", "global": "",
}
ANYWHERE = {"anywhere", "worldwide", "world wide", "global"}
# Endings that name a site, and parts that name nothing.
SITES = ["office", "offices", "hq", "headquarters", "metropolitan area", "metro area", "metro"]
NOTHING = {"n/a", "na", "tbd", "hq"}

_ENTRY = re.compile(r"[;|\n]| / | or ")
_PART = re.compile(r"[,()–—•·]| - ")
_MODE = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(w.replace(" ", "[ -]+") for w in sorted(MODE_WORDS, key=len, reverse=True)) + ")(?![A-Za-z0-9])", re.I)
_LEAD, _SITE = re.compile(r"^(?:based )?in\s+(?=\S)", re.I), re.compile(rf"(?<=\S)\s+(?:{'|'.join(sorted(SITES, key=len, reverse=True))})$", re.I)
ENTRY = "struct<raw string, modes array<string>, anywhere boolean, parts array<string>>"


def parse_entry(raw: str) -> tuple[str, list[str], bool, list[str]]:
    words = [" ".join(re.split(r"[ -]+", m.lower())) for m in _MODE.findall(raw)]
    modes = list(dict.fromkeys(MODE_WORDS[w] for w in sorted(words, key=list(MODE_WORDS).index) if MODE_WORDS[w]))
    parts = (_SITE.sub("", _LEAD.sub("", p.strip(" \t-/:."))).strip() for p in _PART.split(_MODE.sub(",", raw)))
    return raw, modes, any(w in ANYWHERE for w in words), [p for p in parts if p and p.lower() not in NOTHING]


def parse_locations(text: str | None) -> list[tuple] | None:
    return None if text is None else [parse_entry(e.strip()) for e in _ENTRY.split(text) if e.strip()]


def locations(text: Column) -> Column:
    """array<ENTRY> of a typed location."""

    @F.pandas_udf(f"array<{ENTRY}>")
    def parse(s: pd.Series) -> pd.Series:
        names = ("raw", "modes", "anywhere", "parts")
        return s.map(lambda t: None if t is None else [dict(zip(names, e)) for e in parse_locations(t)])

    return parse(text)
