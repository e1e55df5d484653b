import random
import string

import pytest
from pyspark.sql import functions as F

from tidemark.llm.gazetteer import PLACE, Gazetteer, map_places, place_ids
from tidemark.llm.strings import edits

ROWS = [
    (1, "Mount Jarolvwick", "Mount Jarolvwick", "JRL2", "RR", "Rimapmarch", "QN", "Tarsland", 5788), (2, "Brénudstead", "Brenudstead", None, "VE", "Vekerland", "QN", "Tarsland", 34456),
    (3, "Saint Zanudmere", "Saint Zanudmere", "The Copper of Zanu4", "BE", "Brenanmarch", "QP", "Ebradia", 11028), (4, "Saint Zanudmere", "Saint Zanudmere", None, "OL", "Ostilland", "QM", "Norvenia", 183554),
    (5, "Winilcroft", "Winilcroft", "", "OI", "Ostanria", "QS", "Kaldovar", None),
]
CASES = [
    ("Mount Jarolvwick, RR", 1), ("Mt. Jarolvwick", 1), ("mt jarolvwick HQ, Rimapmarch", 1), ("JRL2", 1), ("Hybrid - Mount Jarolvwick, RR, QN", 1), ("Remote (Mount Jarolvwick (RR))", 1), ("Greater Mount Jarolvwick Area, RR", 1), ("Mount Jarolwvick", 1), ("MOUNT JAROLVWICK office", 1),
    ("Brenudstead VE", 2), ("Brénudstead, VE 12345", 2), ("based in Brenudstead", 2), ("Tarsland - Brenudstead", 2), ("Brenuds., VE", 2), ("Brenudsetad - Onsite", 2), ("Saint Zanudmere, BE", 3), ("St Zanudmere, Norvenia", 4), ("Saint Zanudmere", 4), ("The Copper of Zanu4", 3), ("The Copper of Zanu5", -1),
    ("Wnilcoft, OI", 5), ("Winilcroft, RR", -1), ("Winilcroft, Elsewhere", 5), ("Winilcrof, Elsewhere", -1), ("Tarsland", -1), ("Remote", -1), ("REMOTE (QN)", -1), ("", -1), (" ; ", -1), ("Borgolopur, OI", -1), ("x" * 100_000, -1), ("JRL3", -1), (None, None),
]


@pytest.mark.parametrize(("value", "want"), CASES)
def test_values(value, want):
    assert Gazetteer(ROWS).find(value) == want


def test_automaton_against_brute_force():
    r = random.Random(3)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(3, 9))) for _ in range(150)]
    trie = Gazetteer([(i, w, w, None, None, None, None, None, 0) for i, w in enumerate(words)])
    for _ in range(150):
        q = list(r.choice(words))
        for _ in range(r.randint(0, 3)):
            k = r.randrange(len(q) + 1)
            q[k : k + r.randint(0, 1)] = r.choice(["", r.choice(string.ascii_lowercase[:6])])
        q = "".join(q)
        for most in (0, 1, 2):
            assert {s for _, s in trie.within(q, most)} == {w for w in words if edits(q, w, most) <= most}, (q, most)


def test_column(spark):
    places = spark.createDataFrame([(*r, "x") for r in [*ROWS, ROWS[0], (None, *ROWS[0][1:])]], ", ".join(f"{c} {'bigint' if c in ('place_id', 'population') else 'string'}" for c in PLACE) + ", value string")
    df = spark.createDataFrame([(v,) for v, _ in CASES for _ in range(2)], "value string")
    assert [r.p for r in df.select(place_ids(F.col("value"), places).alias("p")).collect()] == [w for _, w in CASES for _ in range(2)]
    assert df.limit(0).select(place_ids(F.col("value"), places)).count() == 0
    assert {r.p for r in df.limit(3).select(place_ids(F.col("value"), places.limit(0)).alias("p")).collect()} == {-1}
    # a list too long for a trie gives the same by a join
    for most in (10, 2):
        got = map_places(df, "value", places, "place_id", most=most).collect()
        assert sorted(((r.value, r.place_id) for r in got), key=str) == sorted([(v, w) for v, w in CASES for _ in range(2)], key=str)
    with pytest.raises(ValueError, match="map_places"):
        import tidemark.llm.gazetteer as module

        module.MAX_REFERENCE, kept = 2, module.MAX_REFERENCE
        try:
            place_ids(F.col("value"), places)
        finally:
            module.MAX_REFERENCE = kept


def test_beginnings_need_a_mark_or_a_region():
    rows = [*ROWS, (6, "Parisvilleton", "Parisvilleton", None, "RR", "Rimapmarch", "QN", "Tarsland", 100)]
    assert [Gazetteer(rows).find(v) for v in ("Parisvi", "Paris, RR", "Paris., RR", "Parisvi, RR", "Parisvi.", "Brenuds, VE", "Brenuds", "Brenuds, RR")] == [-1, -1, 6, 6, 6, 2, -1, -1]
