import random
from itertools import groupby

from pyspark.sql import functions as F

from tidemark.operators.snapshots import change_events

SCHEMA = "snap int, board string, job bigint, title string, closed bigint, v bigint, _s string, _k0 string"


def events(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = change_events(df, "snap", "board", ["job"], ["title", "closed"], F.col("v"))
    assert out.columns == ["snap", "board", "job", "change_kind"]
    return sorted(map(tuple, out.collect()))


def brute(rows):
    best, out = {}, []
    for s, b, j, t, c, v in rows:
        if s is not None and b is not None and j is not None:
            best.setdefault((b, s), {}).setdefault(j, []).append((-(2**63) if v is None else v, (t, c)))
    given = sorted({(r[1], r[0]) for r in rows if r[0] is not None and r[1] is not None})
    for b, group in groupby(given, key=lambda x: x[0]):
        snaps = [s for _, s in group]
        for before, now in zip(snaps, snaps[1:]):
            pick = [{j: max(vs, key=lambda x: x[0])[1] for j, vs in best.get((b, s), {}).items()} for s in (before, now)]
            out += [(now, b, j, "added") for j in pick[1].keys() - pick[0].keys()] + [(now, b, j, "removed") for j in pick[0].keys() - pick[1].keys()]
            out += [(now, b, j, "changed") for j in pick[0].keys() & pick[1].keys() if pick[0][j] != pick[1][j]]
    return sorted(out)


def test_kinds_of_change(spark):
    rows = [
        (1, "a", 1, "t", None, 1), (1, "a", 2, "t", None, 1), (3, "a", 1, "t", 5, 2), (3, "a", 3, None, None, 2), (4, "a", 1, "t", 5, 3), (4, "a", 3, "u", None, 3),
        (2, "b", 1, "t", None, 1), (1, None, 9, "t", None, 1), (None, "a", 9, "t", None, 1), (5, "a", None, "t", None, 1),
    ]
    assert events(spark, rows) == [(3, "a", 1, "changed"), (3, "a", 2, "removed"), (3, "a", 3, "added"), (4, "a", 3, "changed"), (5, "a", 1, "removed"), (5, "a", 3, "removed")]


def test_versions_ties_and_repeats(spark):
    rows = [(1, "a", 1, "old", None, 1), (1, "a", 1, "new", None, 9), (1, "a", 1, "new", None, 9), (2, "a", 1, "new", None, None), (2, "a", 1, "new", None, None)]
    assert events(spark, rows) == []
    tie = [(1, "a", 1, "x", None, 1), (1, "a", 1, "y", None, 1)]
    again = [*tie, *[(2, *r[1:]) for r in reversed(tie)]]
    assert events(spark, again) == []


def test_null_is_a_value_and_not_its_text(spark):
    assert events(spark, [(1, "a", 1, None, None, 1), (2, "a", 1, "null", None, 1), (3, "a", 1, None, None, 1)]) == [(2, "a", 1, "changed"), (3, "a", 1, "changed")]


def test_empty_and_long(spark):
    assert events(spark, []) == []
    assert events(spark, [(1, "a", 1, "x" * 200_000, None, 1), (2, "a", 1, "x" * 200_000 + "y", None, 1)]) == [(2, "a", 1, "changed")]


def test_against_brute_force(spark):
    r = random.Random(5)
    rows = [(r.randint(1, 6), r.choice("abb"), r.randint(1, 12), r.choice(["t", "u", None]), r.choice([None, 1]), k) for k in range(300)]
    assert events(spark, rows) == brute(rows)
