"""Every registered query with SQL gives the SQL's rows, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from seqframe.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    if not Path(SF).exists():
        pytest.skip("the given tables are not here")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)):
        return "nan" if isinstance(v, float) and math.isnan(v) else f"{float(v):.9g}"
    return str(v)


def sorted_rows(rows):
    return sorted((tuple(map(plain, r)) for r in rows), key=repr)


def test_names_agree():
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    ours = sorted_rows(df.select(*cols).collect())
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    theirs = sorted_rows([[r[names.index(c)] for c in cols] for r in cursor.fetchall()])
    assert ours == theirs
