"""Every registered query of the library against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from tarnwick.plans import catalogue

FOLDER = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="the test tables are not here")


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    for path in FOLDER.glob("*.parquet"):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path / '*.parquet' if path.is_dir() else path}')")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, database, name):
    df = catalogue.queries()[name](spark, str(FOLDER))
    columns = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    if name not in catalogue.oracle_sql():
        assert got
        return
    result = database.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in result.fetchall())
