"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from speechlake.model_queries import ORACLE_SQL, QUERIES

FOLDER = os.environ.get("SPEECHLAKE_TABLES", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x) or str(x) in ("NaT", "<NA>"):
        return None
    if isinstance(x, bool) or type(x).__name__ == "bool":
        return bool(x)
    return int(x) if isinstance(x, float) and x == int(x) else str(x)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(([plain(x) for x in r] for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    if name in ORACLE_SQL:
        want = duck.execute(ORACLE_SQL[name]).df()
        (columns, a), (wanted, b) = rows(got), rows(want)
        assert columns == wanted
        assert [list(map(str, r)) for r in a] == [list(map(str, r)) for r in b]
    else:
        assert len(got)
