from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tidemark.operators.units import Affine, PayReader, conversion_table, convert, currency_of, money_period_edges, number_of, pay_facts, period_of, shortest_compositions, unit_parts

CODES = ["USD", "EUR", "GBP", "SEK", "JPY", "AUD", "INR"]


def test_affine_paths_and_cycles():
    edges = [("C", "F", Affine(Fraction(9, 5), Fraction(32))), ("K", "C", Affine(Fraction(1), Fraction(-27315, 100)))]
    to_f = shortest_compositions(edges, "F")
    assert to_f["K"].a * Fraction("273.15") + to_f["K"].b == 32
    assert shortest_compositions(edges, "K")["F"].a * 32 + shortest_compositions(edges, "K")["F"].b == Fraction("273.15")
    with pytest.raises(ValueError, match="contradict"):
        shortest_compositions([*edges, ("K", "F", Affine(Fraction(2)))], "F")
    with pytest.raises(ValueError, match="undone"):
        shortest_compositions([("A", "B", Affine(Fraction(0)))], "B")


def test_conversion_join(spark):
    table = conversion_table(spark, shortest_compositions(money_period_edges({"USD": Fraction(1), "EUR": Fraction("1.1")}), "USD|one|year"))
    rows = [("EUR|one|hour", 10.0, 1), ("USD|thousand|year", 95.0, 1), ("USD|hundredth|month", 500000.0, 1), ("XXX|one|year", 1.0, 1), (None, 1.0, 1), ("USD|one|year", None, 1), ("USD|one|year", 7.0, 1), ("USD|one|year", 7.0, 1)]
    df = spark.createDataFrame(rows, "unit string, v double, factor int")
    got = [(r.unit, None if r.out is None else float(r.out), r.factor) for r in convert(df, table, "unit", {"out": "v"}).collect()]
    want = [("EUR|one|hour", 22880.0), ("USD|thousand|year", 95000.0), ("USD|hundredth|month", 60000.0), ("XXX|one|year", None), (None, None), ("USD|one|year", None), ("USD|one|year", 7.0), ("USD|one|year", 7.0)]
    assert sorted(got, key=str) == sorted([(u, v, 1) for u, v in want], key=str)
    assert convert(df.limit(0), table, "unit", {"out": "v"}).count() == 0


@pytest.mark.parametrize(("text", "want"), [
    ("Pay: $390 - $540 a day", (None, None, "one", 390.0, 540.0, "USD", "day")), ("Compensation: 55,25 €–61,50 € an hour.", (None, None, "one", 55.25, 61.5, "EUR", "hour")),
    ("Expected base pay is 88.000 €-126.000 € /yr, plus benefits", (None, None, "one", 88000.0, 126000.0, "EUR", "year")), ("We offer from £20k per annum depending on level.", (None, None, "one", 20000.0, None, "GBP", "year")),
    ("We offer ₹1.5–₹2 lakh p.a. depending on level.", (None, None, "one", 150000.0, 200000.0, "INR", "year")), ("Pay: 160 to 180 USD day rate", (None, None, "one", 160.0, 180.0, "USD", "day")), ("All figures are in lakhs.", (None, None, "lakh", None, None, None, None)),
    ("Compensation: up to $92,000 p.a..", (None, None, "one", None, 92000.0, "USD", "year")), ("Pay: 1700k to 2500k SEK annually", (None, None, "one", 1.7e6, 2.5e6, "SEK", "year")),
    ("You will be paid in EUR; the stated range is /mo.", ("EUR", "month", "one", None, None, None, None)), ("Pay is quoted biweekly (every two weeks).", (None, "two_weeks", "one", None, None, None, None)),
    ("(pay values in hundredths of a yen) We closed a $30 million round last spring.", (None, None, "hundredth", None, None, None, None)), ("Range shown in thousands.", (None, None, "thousand", None, None, None, None)),
    ("We sponsor a $75 monthly commuter pass. There is a one-time relocation stipend of £3,000.", (None, None, "one", None, None, None, None)), ("&lt;p&gt;All figures are in &lt;b&gt;USD&lt;/b&gt;.&lt;/p&gt;", (None, None, "one", None, None, None, None)),
    ("Annual earnings are $120,000 per year", (None, None, "one", 120000.0, 120000.0, "USD", "year")), ("Base: $95,000 per annum", (None, None, "one", 95000.0, 95000.0, "USD", "year")), ("Earn $25 per hour", (None, None, "one", 25.0, 25.0, "USD", "hour")),
    ("Salary: $100,000 per year plus bonus", (None, None, "one", 100000.0, 100000.0, "USD", "year")), ("$25 - $30 per hour", (None, None, "one", 25.0, 30.0, "USD", "hour")), ("A training budget of $2,000 per year.", (None, None, "one", None, None, None, None)), ("Plans start at $20 per month for teams", (None, None, "one", None, None, None, None)),
    ("&lt;p&gt;All figures are in USD.&lt;/p&gt;", ("USD", None, "one", None, None, None, None)), ("", (None, None, "one", None, None, None, None)), (None, (None, None, "one", None, None, None, None)),
])
def test_statements(text, want):
    assert PayReader(CODES).read(text) == want


@pytest.mark.parametrize(("text", "want"), [("1,700,000", 1700000.0), ("89.000", 89000.0), ("55,25", 55.25), ("1.234,50", 1234.5), ("62 000", 62000.0), ("19.75", 19.75), ("0.500", 0.5), ("x", None)])
def test_numbers(text, want):
    assert number_of(text) == want


def test_stored_units(spark):
    known = frozenset(CODES)
    assert [currency_of(c, known) for c in ("kUSD", "EUR '000", "USD (k)", "sek", "US Dollar", "yen", "$", "", None, "pts")] == [("USD", "thousand"), ("EUR", "thousand"), ("USD", "thousand"), ("SEK", "one"), ("USD", "one"), ("JPY", "one"), ("USD", "one"), (None, "one"), (None, "one"), (None, "one")]
    assert [period_of(p) for p in ("1 HOUR", "per-year-salary", "12 MONTH", "NONE", "", None, "fortnight")] == ["hour", "year", "year", None, None, None, "two_weeks"]
    df = spark.createDataFrame([("usd", "hr"), (None, None), ("", "other")], "c string, p string")
    assert sorted((tuple(r.u) for r in df.select(unit_parts(F.col("c"), F.col("p"), CODES).alias("u")).collect()), key=str) == sorted([("USD", "one", "hour"), (None, "one", None), (None, "one", None)], key=str)
    facts = spark.createDataFrame([("Figures: US dollars hourly " + "word " * 200_000,), (None,), ("",)], "t string").select(pay_facts(F.col("t"), CODES).alias("f")).collect()
    assert [r.f.currency for r in facts] == ["USD", None, None]
