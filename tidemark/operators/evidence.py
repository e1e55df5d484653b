"""Facts read out of running text, each with the sentence that shows it.

A text is cut into clauses, a clause into tokens. A requirement of experience is a number token, its
unit and the subject word, in that order in one clause; what stands between and before them decides
whether it is a requirement, somebody's age, a team's total or the employer's own history.

Defined results: null or empty text gives null; a rule that isn't met gives null, never a guess;
evidence is cut at EVIDENCE characters; very long texts are read whole, in linear time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EVIDENCE = 240
#: Characters that end a clause.
CLAUSE_ENDS = ".\n!?;"
#: Characters between the unit and the subject, an "of" right behind the unit aside.
REACH = 60
# Units, the subject, and words around them that make the number something else.
UNITS = frozenset(["year", "years", "yr", "yrs"])
SUBJECT = "experience"
TEAM_TOTALS = frozenset(["combined", "collective", "cumulative"])
OWN_HISTORY = [("our",), ("we've",), ("we’ve",), ("we", "have"), ("we", "bring"), ("we", "boast"), ("for", "over"), ("for", "more", "than"), ("for", "nearly"), ("for", "almost")]
SOFTENERS = [("more", "than"), ("over",), ("nearly",), ("almost",)]
WISHES = ["preferred", "nice to have", "a plus", "bonus", "ideally", "desired", "desirable"]

_TOKEN = re.compile(r"\d+|\w+(?:['’]\w+)*|[+–-]|\S")
_WISH = re.compile(r"\b(?:" + "|".join(WISHES) + r")\b", re.I)


def clauses(text: str) -> Iterator[tuple[int, int]]:
    """Start and end of every clause."""
    start = 0
    for m in re.finditer("[" + re.escape(CLAUSE_ENDS) + "]", text):
        yield start, m.start()
        start = m.end()
    yield start, len(text)


def words_around(text: str, start: int, end: int, most: int = 6) -> tuple[str, str]:
    """The last words before text[start:end] and the first ones behind it, within its clause."""
    low = max(text.rfind(c, 0, start) for c in CLAUSE_ENDS) + 1
    high = min((k for c in CLAUSE_ENDS if (k := text.find(c, end)) >= 0), default=len(text))
    return " ".join(text[low:start].split()[-most:]), " ".join(text[end:high].split()[:most])


def _ends_with(words: list[str], tails: list[tuple[str, ...]]) -> tuple[str, ...] | None:
    return next((t for t in tails if tuple(words[-len(t) :]) == t), None)


def _is_history(before: list[str]) -> bool:
    """Whether the words before a number say that it is the employer's own past."""
    if _ends_with(before, OWN_HISTORY):
        return True
    if soft := _ends_with(before, SOFTENERS):
        before = before[: -len(soft)]
    return before == ["with"] or _ends_with(before, OWN_HISTORY) is not None


def _number_before(words: list[str], unit: int) -> int | None:
    """Where the smaller number of a statement such as "3", "3+", "3 plus" or "3 to 5+" stands, read leftwards from its unit."""
    k = unit - 1
    if k >= 0 and words[k] == "+":
        k -= 1
    if k >= 2 and words[k].isdigit() and len(words[k]) <= 2 and words[k - 1] in ("-", "–", "to"):
        left = k - 2
        if words[left] in ("+", "plus"):
            left -= 1
        if left >= 0 and words[left].isdigit():
            k = left
    elif k >= 0 and words[k] == "plus":
        k -= 1
    return k if k >= 0 and words[k].isdigit() and len(words[k]) <= 2 else None


def stated_years(clause: str) -> Iterator[int]:
    """Every required number of years of experience in a clause."""
    found = [(m[0].lower(), m.start(), m.end()) for m in _TOKEN.finditer(clause)]
    words = [w for w, _, _ in found]
    subjects = [i for i, w in enumerate(words) if w == SUBJECT]
    for unit, word in enumerate(words):
        if word.rstrip("'’") not in UNITS or (number := _number_before(words, unit)) is None:
            continue
        subject = next((i for i in subjects if i > unit), None)
        if subject is None:
            continue
        # an apostrophe and an "of" right behind the unit don't count against the reach
        of = next((i for i in range(unit + 1, min(unit + 3, len(words))) if words[i] == "of"), unit)
        if found[subject][1] - found[of][2] > REACH + 1:
            continue
        between = words[unit + 1 : subject]
        is_age = between[:1] == ["old"] or between[:2] == ["of", "age"]
        if not is_age and not TEAM_TOTALS.intersection(between) and not _is_history(words[:number]):
            yield int(words[number])


def min_years(text: str | None) -> tuple[int | None, bool | None, str | None]:
    """(years, preferred, evidence) of the smallest required figure, a preferred one only where none is required."""
    best, text = None, text or ""
    for start, end in clauses(text):
        clause = text[start:end].strip()
        if SUBJECT not in clause.lower():
            continue
        wished = _WISH.search(clause) is not None
        for years in stated_years(clause):
            if best is None or (wished, years) < best[:2]:
                best = wished, years, clause[:EVIDENCE]
    return (best[1], best[0], best[2]) if best else (None, None, None)


def required_years(text: Column) -> Column:
    """struct<years, preferred, evidence>; years is null where none are stated."""

    @F.pandas_udf("struct<years int, preferred boolean, evidence string>")
    def read(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([min_years(t) for t in s], columns=["years", "preferred", "evidence"]).astype({"years": "Int32", "preferred": "boolean"})

    return read(text)


def fill(stated: Column, detected: Column) -> Column:
    """A structured fact wins over one read from text."""
    return F.coalesce(stated, detected)
