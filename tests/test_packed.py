import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.operators.packed import Regions, explode_pieces, pieces, tokenize

REGIONS = Regions([("Town", "Town", "OR", "Oregon", "US", "Freeland"), ("City", None, "OH", "Ohio", "US", "Freeland"), ("Há", "Ha", None, "Ostria", "XX", None)])
CASES = [
    ("A | B;C", ["A", "B", "C"]), ("A\tB\nC", ["A", "B", "C"]), ("A — B • C", ["A", "B", "C"]), ("A / B", ["A", "B"]), ("CI/CD | A-B", ["CI/CD", "A-B"]), ("A||B |", ["A", "B"]),
    ('"A, ""x"" B","C"', ['A, "x" B', "C"]), ('"a|b" | c', ["a|b", "c"]), (r'"a\"|b" | c', ['a"|b', "c"]), ('Growth "CI/CD" Lead | X', ['Growth "CI/CD" Lead', "X"]), ("R (L; (M)) ; N", ["R (L; (M))", "N"]),
    ("R (L ; N", ["R (L", "N"]), ('"open | x', ['"open', "x"]), ("We hire, and we answer.", ["We hire, and we answer."]), ("Acme,Remote,Visa", ["Acme", "Remote", "Visa"]), ('Acme, "Remote"\n', ["Acme", "Remote"]),
    ("A &amp; B; C", ["A &amp; B", "C"]), ("", []), (None, []), (" ; | ", []), ("A", ["A"]),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_rules(text, want):
    assert tokenize(text) == want


@pytest.mark.parametrize(("text", "want"), [
    ("Town, OR or City, Ohio", ["Town, OR", "City, Ohio"]), ("Town, Oregon, US", ["Town, Oregon, US"]), ("Town,City,Hill", ["Town", "City", "Hill"]), ("Town, OH-IO", ["Town", "OH-IO"]), ("Tonw, Ohio 12345 (Hybrid)", ["Tonw, Ohio 12345 (Hybrid)"]),
    ("Town, US - Remote", ["Town, US - Remote"]), ('Town,"City, US"', ["Town", "City, US"]), ("Oregon or", ["Oregon or"]), ("Town, Ohio", ["Town", "Ohio"]), ("Hybrid - Town, OR", ["Hybrid - Town, OR"]), ("Remote,Freeland", ["Remote", "Freeland"]),
    ("Oregon, Ohio", ["Oregon", "Ohio"]), ("Remote (US), XX", ["Remote (US)", "XX"]), ("Elsewhere, Ohio, XX", ["Elsewhere", "Ohio", "XX"]), ("Elsewhere, XX", ["Elsewhere, XX"]), ("Ha, Ostria", ["Ha, Ostria"]), ("Elsewhere office, Remote - Freeland", ["Elsewhere office", "Remote - Freeland"]), ("Town, OR, US, XX", ["Town", "OR", "US", "XX"]),
])
def test_places(text, want):
    assert tokenize(text, ("or",), REGIONS) == want


def test_long_text_is_read_whole():
    assert len(tokenize("value; " * 100_000)) == 100_000


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.characters(blacklist_categories=["Cs", "Cc"]), min_size=1).map(str.strip).filter(bool), min_size=1, max_size=6))
def test_round_trip_of_quoted_values(values):
    packed = " | ".join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values)
    assert tokenize(packed) == values


def test_column_and_rows(spark):
    df = spark.createDataFrame([(1, "A &amp; B; C", 9), (2, None, 9), (3, "", 9), (4, "A", 9), (4, "A", 9)], "k int, t string, piece int")
    out = explode_pieces(df.select("k", pieces(F.col("t")).alias("p")), "p", "pos", "piece").collect()
    assert sorted(map(tuple, out)) == [(1, 0, "A & B"), (1, 1, "C"), (4, 0, "A"), (4, 0, "A")]
    assert explode_pieces(df.limit(0).select("k", pieces(F.col("t")).alias("p")), "p", "pos", "piece", least=2).count() == 0
