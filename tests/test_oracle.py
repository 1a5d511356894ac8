"""Every query that has SQL gives what DuckDB gives; those without give rows of a stable schema."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from filigree.queries import ORACLE_SQL, QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return c


def plain(rows) -> list[tuple]:
    def one(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else f"{v:.7g}"
        return str(v)

    return sorted(tuple(one(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = plain(tuple(r) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        return
    assert sorted(duck.sql(ORACLE_SQL[name]).columns) == cols
    quoted = ", ".join(f'"{c}"' for c in cols)
    assert got == plain(duck.sql(f"SELECT {quoted} FROM ({ORACLE_SQL[name]})").fetchall())
