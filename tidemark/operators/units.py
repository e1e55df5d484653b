"""Quantities in different units → common units.

Conversions are edges of a graph, each an affine function y = a·x + b. The shortest composition
from every unit to the canonical one is worked out once, exactly, on the driver (the graph is a
dictionary of units, its size doesn't follow the data); every cycle must come back to the
identity. Values then meet their conversion in one equi-join on the source unit.

Defined results
  null or unknown unit, no path    → no conversion, null
  null value                       → null
  contradicting edges              → ValueError that names the unit
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.evidence import words_around
from tidemark.session import free_name


@dataclass(frozen=True)
class Affine:
    """y = a·x + b."""

    a: Fraction
    b: Fraction = Fraction(0)

    def then(self, after: Affine) -> Affine:
        return Affine(after.a * self.a, after.a * self.b + after.b)

    def inverse(self) -> Affine:
        return Affine(1 / self.a, -self.b / self.a)


Edge = tuple[str, str, Affine]


def shortest_compositions(edges: Iterable[Edge], target: str) -> dict[str, Affine]:
    """unit → affine function to target over the fewest edges; each edge can be walked both ways."""
    beside: dict[str, list[tuple[str, Affine]]] = {}
    for source, to, f in edges:
        if f.a == 0:
            raise ValueError(f"the conversion of {source} to {to} can't be undone")
        beside.setdefault(source, []).append((to, f))
        beside.setdefault(to, []).append((source, f.inverse()))
    found, queue = {target: Affine(Fraction(1))}, deque([target])
    while queue:
        unit = queue.popleft()
        for neighbour, f in beside.get(unit, []):
            if neighbour not in found:
                found[neighbour] = f.inverse().then(found[unit])
                queue.append(neighbour)
    # every edge that isn't in the tree closes a cycle
    for unit, out in beside.items():
        for neighbour, f in out:
            if unit in found and f.then(found[neighbour]) != found[unit]:
                raise ValueError(f"conversions of {unit} contradict each other")
    return found


def conversion_table(spark: SparkSession, compositions: dict[str, Affine]) -> DataFrame:
    """unit, factor, shift as decimals, for convert()."""
    rows = [(u, f"{float(f.a):.12f}" if f.a.denominator != 1 else str(f.a.numerator), str(float(f.b))) for u, f in compositions.items()]
    return spark.createDataFrame(rows, "unit string, factor string, shift string").select("unit", F.col("factor").cast("decimal(28,12)"), F.col("shift").cast("decimal(20,6)"))


def convert(df: DataFrame, conversions: DataFrame, unit: str, values: dict[str, str]) -> DataFrame:
    """df with each column of ``values`` (new name → value column) in the canonical unit, as a decimal.

    The conversions are as many as there are units, thousands of rows at most, so they are broadcast.
    """
    key, factor, shift = (free_name(df, f"_u_{c}") for c in ("unit", "factor", "shift"))
    small = conversions.select(F.col("unit").alias(key), F.col("factor").alias(factor), F.col("shift").alias(shift))
    joined = df.join(F.broadcast(small), df[unit] == small[key], "left")
    exact = lambda v: F.col(f"`{v}`").cast("decimal(20,4)") * F.col(factor) + F.col(shift)
    return joined.withColumns({out: exact(v) for out, v in values.items()}).drop(key, factor, shift)


# Spellings of currencies.
CURRENCY_NAMES = {
    "$": "USD", "us$": "USD", "us dollar": "USD", "us dollars": "USD", "dollar": "USD", "dollars": "USD",
    "€": "EUR", "euro": "EUR", "euros": "EUR", "£": "GBP", "pound sterling": "GBP", "pounds sterling": "GBP", "british pounds": "GBP", "pounds": "GBP",
    "c$": "CAD", "ca$": "CAD", "canadian dollar": "CAD", "canadian dollars": "CAD", "a$": "AUD", "au$": "AUD", "australian dollar": "AUD", "australian dollars": "AUD",
    "₹": "INR", "rs.": "INR", "rs": "INR", "indian rupee": "INR", "indian rupees": "INR", "rupees": "INR", "¥": "JPY", "yen": "JPY", "japanese yen": "JPY",
    "kr": "SEK", "swedish krona": "SEK", "swedish kronor": "SEK", "kronor": "SEK", "fr.": "CHF", "swiss franc": "CHF", "swiss francs": "CHF",
}
# Spellings of pay periods.
PERIOD_NAMES = {
    "hour": ["hour", "hr", "h", "hourly", "1 hour", "/hr", "/hour", "per hour", "an hour", "hourly rate", "per-hour-wage"],
    "day": ["day", "daily", "1 day", "/day", "per day", "a day", "daily-rate", "day rate", "daily rate", "per-day-wage"],
    "week": ["week", "wk", "weekly", "1 week", "/wk", "/week", "per week", "a week", "per-week-salary"],
    "two_weeks": ["two_weeks", "two weeks", "2 week", "2 weeks", "fortnight", "fortnightly", "biweekly", "bi-weekly", "every two weeks", "per two weeks", "per fortnight", "a fortnight", "per-two-weeks-salary", "bi-weekly (every two weeks)", "biweekly (every two weeks)"],
    "month": ["month", "mo", "monthly", "1 month", "/mo", "/month", "per month", "a month", "per-month-salary"],
    "quarter": ["quarter", "quarterly", "3 month", "3 months", "per quarter", "a quarter", "/quarter", "per-quarter-salary"],
    "year": ["year", "yr", "yearly", "annual", "annually", "pa", "p.a.", "p.a", "1 year", "12 month", "12 months", "/yr", "/year", "per year", "a year", "per annum", "annum", "per-year-salary"],
}
# How many periods make a year.
PERIODS_A_YEAR = {"hour": 2080, "day": 260, "week": 52, "two_weeks": 26, "month": 12, "quarter": 4, "year": 1}
# Words behind an amount that multiply it.
MULTIPLIERS = {"k": 1000, "lakh": 100_000, "lakhs": 100_000, "lac": 100_000, "lacs": 100_000, "crore": 10_000_000, "crores": 10_000_000}
# Words for the hundredth part of a currency.
HUNDREDTHS = ["cents", "pence", "paise", "öre", "rappen", "centimes", "hundredths", "minor units"]


def money_period_edges(usd_per_unit: dict[str, Fraction]) -> list[Edge]:
    """Edges between units such as 'EUR|thousand|month'; the canonical unit is 'USD|one|year'."""
    edges: list[Edge] = []
    scales = {"thousand": Fraction(1000), "hundredth": Fraction(1, 100), "lakh": Fraction(100_000), "crore": Fraction(10_000_000)}
    for currency, rate in usd_per_unit.items():
        for period, n in PERIODS_A_YEAR.items():
            at = lambda c=currency, s="one", p=period: f"{c}|{s}|{p}"
            edges += [(at(s=s), at(), Affine(f)) for s, f in scales.items()]
            if period != "year":
                edges.append((at(), at(p="year"), Affine(Fraction(n))))
            if currency != "USD":
                edges.append((at(), at(c="USD"), Affine(rate)))
    return edges


_PERIOD_OF = {spelling: period for period, all_of in PERIOD_NAMES.items() for spelling in all_of}
_SCALED = re.compile(r"^k(?=[A-Z]{3}$)|\s*(?:'000|\(k\)|\bthousands?)$")


def currency_of(stated: str | None, known: frozenset[str]) -> tuple[str | None, str]:
    """(code or None, scale) of a stored currency such as "kUSD", "EUR '000" or "US Dollar"."""
    if not stated or not stated.strip():
        return None, "one"
    text = stated.strip()
    bare = _SCALED.sub("", text).strip()
    code = bare.upper() if bare.upper() in known else CURRENCY_NAMES.get(bare.lower())
    return (code, "thousand" if bare != text else "one") if code in known else (None, "one")


def period_of(stated: str | None) -> str | None:
    return _PERIOD_OF.get(" ".join(stated.lower().split())) if stated else None


def number_of(text: str) -> float | None:
    """'89.000', '1,700,000', '55,25', '62 000' and '19.75' by their groups of digits."""
    t = re.sub(r"[\s  '’]", "", text).strip(".,")
    marks = [c for c in t if c in ".,"]
    if len(set(marks)) == 2:
        last = marks[-1]
        t = t.replace("," if last == "." else ".", "").replace(last, ".")
    elif marks:
        groups = re.split(r"[.,]", t)
        whole = all(len(g) == 3 for g in groups[1:]) and groups[0] not in ("", "0")
        t = "".join(groups) if whole else f"{''.join(groups[:-1])}.{groups[-1]}"
    try:
        return float(t)
    except ValueError:
        return None


def _any(spellings: Iterable[str]) -> str:
    return "|".join(re.escape(s) for s in sorted(spellings, key=len, reverse=True))


class PayReader:
    """Reads pay statements and hints about currency, period and scale out of a text, which may be (escaped) HTML."""

    def __init__(self, codes: Iterable[str]):
        self.known = frozenset(codes)
        words = [s for s, c in CURRENCY_NAMES.items() if c in self.known]
        cur = rf"(?:(?<![A-Za-z])(?:{_any(self.known)})(?![A-Za-z])|(?<![A-Za-z$€£])(?:{_any(words)})(?![A-Za-z]))"
        spoken = [s for s in _PERIOD_OF if not re.fullmatch(r"h|hr|mo|wk|yr|pa|p\.a|annual|annum|hour|day|week|month|quarter|year|\d+ \w+|.*-(?:wage|salary|rate)|two_weeks", s)]
        per = rf"(?<![\w])(?:{_any(spoken)})(?!\w)"
        num = r"\d[\d.,'’  ]*(?:[  ]\d{3}(?!\d))*"
        one = lambda n, before, after: rf"(?:(?P<c{before}>{cur})\s?)?(?P<n{n}>{num})\s?(?P<k{n}>(?:{_any(MULTIPLIERS)})(?!\w))?(?:\s?(?P<c{after}>{cur}))?"
        first, second = one(1, 1, 2), one(2, 3, 4)
        self.statement = re.compile(rf"(?P<only>\bfrom\s+|\bup to\s+|\bat least\s+|\bstarting at\s+)?{first}(?:\s*(?:[-–—]|\bto\b|\band\b)\s*{second})?(?:,?\s*(?P<p>{per}))?", re.I)
        self.cur, self.per = re.compile(cur, re.I), re.compile(per, re.I)
        self.sentence = re.compile(r"[\n<>]+|(?<!p\.a\.)(?<=[.!?])\s+|(?<=\))\s+(?=[A-Z])")
        self.head = re.compile(r"\b(?:range|figures?|rates?|amounts?|numbers|quoted|we pay|paid in|compensation|salary|base pay|pay values?|pay:|we offer)\b|\bpay:", re.I)
        self.noise = re.compile(r"\b(?:budget|stipend|pass|round|million|billion|bonus|equity|allowance|fund(?:ing|s)?|reimburse\w*|raised|revenue|turnover)\b", re.I)
        # words before an amount that make it pay, whatever else the sentence says
        self.paid = re.compile(r"\b(?:salar(?:y|ies)|wages?|earn(?:s|ings?)?|compensation|remuneration|base(?: pay)?|we pay|pays|rate|pay range|pay:)(?!\w)", re.I)
        self.thousands = re.compile(r"\bin (?:thousands|k)\b|'000", re.I)
        self.larger = re.compile(r"\bin (?:lakhs?|lacs?|crores?)\b", re.I)
        self.hundredths = re.compile(rf"\bin (?:{_any(HUNDREDTHS)})(?!\w)", re.I)

    def code(self, text: str | None) -> str | None:
        if not text:
            return None
        return text.upper() if text.upper() in self.known else CURRENCY_NAMES.get(text.lower())

    def _is_pay(self, sentence: str, m: re.Match) -> bool:
        """Whether the words around an amount say that it is pay: one of pay before it, or nothing but the amount."""
        before, after = words_around(sentence, m.start(), m.end())
        if self.paid.search(before + ":" if before.endswith("pay") else before):
            return not self.noise.search(before)
        return not (before + after).strip(" .,;:-–—()")

    def _statements(self, sentence: str, plain: bool) -> Iterator[tuple[float | None, float | None, str, str | None]]:
        """(low, high, currency, period) of every amount with its currency and period; unless plain, only where its own words say pay."""
        for m in self.statement.finditer(sentence):
            code = self.code(m["c1"] or m["c2"] or m["c3"] or m["c4"])
            if not code or not m["p"] or not (plain or self._is_pay(sentence, m)):
                continue
            low, high = number_of(m["n1"]), number_of(m["n2"]) if m["n2"] else None
            # "120–150 lakh": one multiplier stands for both bounds
            k1 = m["k1"] or (m["k2"] if m["n2"] and low is not None and low < 1000 else None)
            times = lambda v, k: v * MULTIPLIERS[k.lower()] if v is not None and k else v
            low, high = times(low, k1), times(high, m["k2"])
            if not m["n2"]:
                word = (m["only"] or "").strip().lower()
                low, high = (None, low) if word == "up to" else (low, None) if word else (low, low)
            yield low, high, code, period_of(m["p"].strip())

    def read(self, text: str | None) -> tuple:
        """(currency, period, scale, low, high, currency and period of the statement); all but scale may be None."""
        currency = period = stated = None
        scale = "one"
        plain = re.sub(r"<[^<>]*>", "\n", html.unescape(html.unescape(text)) if "&" in text else text) if text else ""
        for sentence in self.sentence.split(plain):
            has_digit = any(c.isdigit() for c in sentence)
            if not self.head.search(sentence) or self.noise.search(sentence):
                if has_digit and stated is None:
                    stated = next(self._statements(sentence, plain=False), None)
                continue
            if self.thousands.search(sentence):
                scale = "thousand"
                continue
            if m := self.larger.search(sentence):
                scale = "crore" if m[0].lower().endswith(("crore", "crores")) else "lakh"
                continue
            if self.hundredths.search(sentence):
                scale = "hundredth"
                continue
            if has_digit:
                if stated is None:
                    stated = next(self._statements(sentence, plain=True), None)
                continue
            if currency is None and (m := self.cur.search(sentence)):
                currency = self.code(m[0])
            if period is None and (m := self.per.search(sentence)):
                period = period_of(m[0].strip())
        return (currency, period, scale, *(stated or (None, None, None, None)))


PAY_FACTS = "struct<currency string, period string, scale string, low double, high double, said_currency string, said_period string>"


def pay_facts(text: Column, codes: Iterable[str]) -> Column:
    """PAY_FACTS out of a plain text, read whole."""
    codes = sorted(codes)

    @F.pandas_udf(PAY_FACTS)
    def read(texts: pd.Series) -> pd.DataFrame:
        reader = PayReader(codes)
        return pd.DataFrame([reader.read(t) for t in texts], columns=[x.split()[0] for x in PAY_FACTS[7:-1].split(", ")])

    return read(text)


UNIT_PARTS = "struct<currency string, scale string, period string>"


def unit_parts(currency: Column, period: Column, codes: Iterable[str]) -> Column:
    """The code, scale and period that two stored unit texts mean, null where they leave it open."""
    known = frozenset(codes)

    @F.pandas_udf(UNIT_PARTS)
    def parse(currencies: pd.Series, periods: pd.Series) -> pd.DataFrame:
        money = [currency_of(c if isinstance(c, str) else None, known) for c in currencies]
        return pd.DataFrame({"currency": [m[0] for m in money], "scale": [m[1] for m in money], "period": [period_of(p if isinstance(p, str) else None) for p in periods]})

    return parse(currency, period)
