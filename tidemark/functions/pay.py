"""Pay periods, yearly amounts and short forms; all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of a stated period in the order they are looked for, and how many periods make a year.
PERIOD_WORDS = [("year", "year"), ("annual", "year"), ("month", "month"), ("week", "week"), ("day", "day"), ("hour", "hour")]
A_YEAR = {"hour": 2080, "day": 260, "week": 52, "month": 12, "year": 1}
#: Kilometres in a mile.
MILE = 1.609344


def pay_period(stated: Column) -> Column:
    """The period that a text such as "per-year-salary" or "1 YEAR" names; null where it names none."""
    text, chain = F.lower(stated), F
    for word, period in PERIOD_WORDS:
        chain = chain.when(text.contains(word), period)
    return chain.otherwise(F.lit(None).cast("string"))


def per_year(amount: Column, period: Column) -> Column:
    """The amount a year; null for an unknown period."""
    return amount * F.element_at(F.create_map(*[F.lit(x) for kv in A_YEAR.items() for x in kv]), period)


def pay(low: Column, high: Column, currency: Column, stated_period: Column) -> Column:
    """struct<low, high, currency, period, ceiling>, null without a period or without both amounts; US dollars where no currency is stated. ceiling: the most a year."""
    period = pay_period(stated_period)
    made = F.struct(low.alias("low"), high.alias("high"), F.coalesce(currency, F.lit("USD")).alias("currency"), period.alias("period"), per_year(F.coalesce(high, low), period).alias("ceiling"))
    return F.when(period.isNotNull() & (low.isNotNull() | high.isNotNull()), made)


def short_pay(p: Column) -> Column:
    """"90k-120k usd/year"; amounts from a thousand on in thousands."""
    one = lambda v: F.when(v >= 1000, F.concat(F.round(v / 1000).cast("bigint").cast("string"), F.lit("k"))).otherwise(F.regexp_replace(v.cast("string"), r"\.0$", ""))
    return F.lower(F.concat(F.concat_ws("-", one(p["low"]), one(p["high"])), F.lit(" "), p["currency"], F.lit("/"), p["period"]))


def km(value: Column, unit: Column) -> Column:
    """A distance in kilometres; null for an unknown unit."""
    return F.when(unit == "km", value).when(unit == "mi", value * MILE)
