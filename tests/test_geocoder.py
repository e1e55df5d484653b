import pytest
from pyspark.sql import functions as F

from tidemark.operators.geocoder import Dimensions, describe_place, locate, resolve

PLACES = [
    (1, "Seattle", "Seattle", "Emerald City", "WA", "Washington", "US", "United States", 737_000), (2, "Washington", "Washington", None, "DC", "District of Columbia", "US", "United States", 689_000), (3, "Portland", "Portland", None, "OR", "Oregon", "US", "United States", 650_000),
    (4, "Portland", "Portland", None, "ME", "Maine", "US", "United States", 68_000), (5, "London", "London", None, "ENG", "England", "GB", "United Kingdom", 8_900_000), (6, "London", "London", None, "ON", "Ontario", "CA", "Canada", 400_000), (7, "Ontario", "Ontario", None, "CA", "California", "US", "United States", 175_000),
    (8, "Toronto", "Toronto", None, "ON", "Ontario", "CA", "Canada", 2_700_000), (9, "Zürich", "Zurich", None, "ZH", "Zurich", "CH", "Switzerland", 400_000), (10, "Atlanta", "Atlanta", None, "GA", "Georgia", "US", "United States", 498_000), (11, "Tbilisi", "Tbilisi", None, "51", "Tbilisi", "GE", "Georgia", 1_100_000),
    (12, "Fort Meade", "Fort Meade", None, "MD", "Maryland", "US", "United States", None), (13, "New York", "New York", "NYC", "NY", "New York", "US", "United States", 8_800_000),
]
SCHEMA = "place_id bigint, place_name string, ascii_name string, alternates string, admin_code string, admin_name string, country_code string, country_name string, population bigint"
CASES = [
    (["Seattle", "WA"], [(1, None, None)]), (["Seattle WA"], [(1, None, None)]), (["Emerald City"], [(1, None, None)]), (["Seattle", "Washington", "United States"], [(1, None, None)]), (["US-WA-Seattle"], [(1, None, None)]), (["GB-London"], [(5, None, None)]),
    (["Portland"], [(None, None, "Portland")]), (["Portland", "Maine"], [(4, None, None)]), (["London"], [(5, None, None)]), (["London", "Canada"], [(6, None, None)]), (["Ontario"], [(None, "region:CA-ON", None)]), (["Ontario", "CA"], [(7, None, None)]),
    (["Washington"], [(None, None, "Washington")]), (["Georgia"], [(None, None, "Georgia")]), (["Georgia", "United States"], [(None, "region:US-GA", None)]), (["Switzerland"], [(None, "country:CH", None)]), (["Europe"], [(None, "continent:EU", None)]), (["WA"], [(None, "region:US-WA", None)]),
    (["Starbase", "OR"], [(None, "region:US-OR", "Starbase, OR")]), (["Nowhere"], [(None, None, "Nowhere")]), (["San Nowhere", "Seattle", "WA", "Toronto"], [(None, None, "San Nowhere"), (1, None, None), (8, None, None)]), (["zurich"], [(None, "region:CH-ZH", None)]), (["Ft Meade", "MD"], [(12, None, None)]),
    (["New York"], [(13, None, None)]), (["NYC"], [(13, None, None)]), (["98101"], [(None, "zip:98101", None)]), (["Annapolis Junction", "MD"], [(None, "small:md-annapolis junction", None)]), ([], []), (None, []),
]


@pytest.fixture(scope="module")
def got(spark):
    places = spark.createDataFrame([*PLACES, PLACES[0], (None, *PLACES[0][1:])], SCHEMA)
    postal = spark.createDataFrame([("98101", "Seattle", "WA"), ("20701", "Annapolis Junction", "MD")], "zip string, place string, state string")
    entries = spark.createDataFrame([(k, parts) for k, (parts, _) in enumerate(CASES)] + [(1000, CASES[0][0])], "k int, parts array<string>")
    found = resolve(entries, ["k"], "parts", Dimensions(places, postal))
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.k, r.at)):
        out.setdefault(r.k, []).append((r.place_id, r.area, r.unresolved))
    first = {r.k: r.place_id for r in locate(found, ["k"]).collect()}
    assert resolve(entries.limit(0), ["k"], "parts", Dimensions(places)).count() == 0
    assert {r.unresolved for r in resolve(entries.where("k = 0"), ["k"], "parts", Dimensions(places.limit(0))).collect()} == {"Seattle", "WA"}
    return out, first


@pytest.mark.parametrize("k", range(len(CASES)))
def test_cases(got, k):
    assert got[0].get(k, []) == CASES[k][1]


def test_repeats_and_first_places(got):
    assert got[0][1000] == got[0][0]
    assert got[1][0] == 1 and got[1][20] == 1 and 6 not in got[1]


def test_descriptions(spark):
    df = spark.createDataFrame([("Seattle", "WA", "US"), ("Tbilisi", "51", "GE"), ("X", None, "GE")], "n string, a string, c string")
    assert [r.o for r in df.select(describe_place(F.col("n"), F.col("a"), F.col("c")).alias("o")).collect()] == ["Seattle, WA, US", "Tbilisi, GE", "X, GE"]
