"""Every query of the library against its SQL over the same tables."""

import math

import duckdb
import pytest

from spanloom import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v:.9g}"
    return v if v is None or isinstance(v, (bool, str)) else str(int(v)) if isinstance(v, int) else f"{float(v):.9g}" if v.__class__.__name__ == "Decimal" and v != int(v) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalog.ORACLE_SQL:
        want = duck.execute(catalog.ORACLE_SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, got) == rows(names, want.fetchall())
    else:
        assert got
