from datetime import datetime, timezone

import pytest

from tidemark.operators.instants import epoch_number_ms, with_instant


def ms(*parts, off=0):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp() * 1000) - off * 60000


CASES = [
    ("2025-10-18T06:32:56-04:00", None, None, ms(2025, 10, 18, 10, 32, 56)),
    ("2025-10-18t06:32:56z", None, None, ms(2025, 10, 18, 6, 32, 56)),
    ("2026-08-24T18:12:00.018999Z", None, None, ms(2026, 8, 24, 18, 12) + 18),
    ("20260225T051037Z", None, None, ms(2026, 2, 25, 5, 10, 37)),
    ("2026-03-09 00:05:04", "America/Chicago", None, ms(2026, 3, 9, 5, 5, 4)),
    ("2026-01-29 06:14 UTC-05:00", None, None, ms(2026, 1, 29, 11, 14)),
    ("15/10/2025 10:06", "Europe/London", "DMY", ms(2025, 10, 15, 9, 6)),
    ("10/11/2026 1:39 PM", "America/Los_Angeles", "MDY", ms(2026, 10, 11, 20, 39)),
    ("10/11/2026 12:00 AM", "UTC", "MDY", ms(2026, 10, 11)),
    ("05/05/2026 12:00 PM", "UTC", None, ms(2026, 5, 5, 12)),
    ("05/06/2026 12:00 PM", "UTC", None, None),
    ("30.07.2026 00:40", "Europe/Berlin", "DMY", ms(2026, 7, 29, 22, 40)),
    ("6 September 2026, 15:46", "America/New_York", "MDY", ms(2026, 9, 6, 19, 46)),
    ("Sep 8, 2025 7:17 AM EDT", "Asia/Tokyo", "DMY", ms(2025, 9, 8, 11, 17)),
    ("Mon, 16 Feb 2026 13:11:05 +0900", None, None, ms(2026, 2, 16, 4, 11, 5)),
    ("1774727238", None, None, 1774727238000),
    ("1774727238123456", None, None, 1774727238123),
    ("2026-02-30T09:00:00Z", None, None, None),
    ("0000-00-00T00:00:00Z", None, None, None),
    ("2024-02-29", "UTC", None, ms(2024, 2, 29)),
    ("2023-02-29", "UTC", None, None),
    ("1969-07-20T20:17:40Z", None, None, ms(1969, 7, 20, 20, 17, 40)), ("2150-01-01 00:00", "UTC", None, ms(2150, 1, 1)), ("14 July 1789", "UTC", None, ms(1789, 7, 14)),
    ("1970-01-01T00:00:00Z", None, None, None), ("9999-12-31 23:59:59", "UTC", None, None), ("0001-01-01", "UTC", None, None),
    ("2026-01-01 25:00:00", "UTC", None, None),
    ("2026-01-01 00:00:00 +15:00", "UTC", None, None),
    # inside the gap of 8 March 2026, and both readings of 1 November 2026
    ("2026-03-08 02:30:00", "America/New_York", None, None),
    ("2026-11-01 01:30:00", "America/New_York", None, ms(2026, 11, 1, 5, 30)),
    ("2026-01-01 10:00:00", None, None, None),
    ("rolling", "UTC", "MDY", None), ("", "UTC", "MDY", None), (None, "UTC", "MDY", None), ("-", "UTC", "MDY", None), ("0", None, None, None), ("-1", None, None, None),
    ("9" * 5000, "UTC", "MDY", None), ("2026-01-01T00:00:00Z" + " x" * 5000, "UTC", "MDY", None),
]


def test_every_notation_and_fault(spark):
    rows = [(i, t, z, o, 7) for i, (t, z, o, _) in enumerate(CASES)]
    df = spark.createDataFrame(rows, "k int, t string, z string, o string, _i_y int")
    got = {r.k: r for r in with_instant(df, "t", "out", "z", "o").collect()}
    assert {k: r.out for k, r in got.items()} == {i: c[3] for i, c in enumerate(CASES)}
    assert {r._i_y for r in got.values()} == {7}


def test_empty_table_and_repeats(spark):
    df = spark.createDataFrame([], "t string")
    assert with_instant(df, "t", "out").count() == 0
    twice = spark.createDataFrame([("1774727238",)] * 2, "t string")
    assert [r.out for r in with_instant(twice, "t", "out").collect()] == [1774727238000] * 2


@pytest.mark.parametrize(("n", "want"), [(1774727238, 1774727238000), (1774727238123, 1774727238123), (1774727238123456, 1774727238123), (1774727238123456789, 1774727238123), (1774727238122999999, 1774727238122), (1774727238123000001, 1774727238123), (0, None), (-1, None), (None, None), (5, None)])
def test_numbers(spark, n, want):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(n,)], "n bigint").select(epoch_number_ms(F.col("n")).alias("m")).first().m == want
