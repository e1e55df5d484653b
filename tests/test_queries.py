"""Every query of the core runs on the smallest tables, and those with SQL agree with it."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from tests.conftest import SMALL
from tidemark.plans import catalogue

pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test tables here")


def canonical(v):
    return None if isinstance(v, float) and math.isnan(v) else round(float(v), 5) if isinstance(v, float) or type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        c.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    rows = [tuple(canonical(r[c]) for c in columns) for r in df.collect()]
    if name in catalogue.ORACLES:
        result = duck.execute(catalogue.ORACLES[name])
        theirs = [d[0] for d in result.description]
        assert sorted(theirs) == columns
        wanted = [tuple(canonical(r[theirs.index(c)]) for c in columns) for r in result.fetchall()]
        assert sorted(rows, key=str) == sorted(wanted, key=str)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["snapshot_no", "board_token", "job_id", "change_kind"]
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
