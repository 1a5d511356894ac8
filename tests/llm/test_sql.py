"""The SQL of the queries that have it, on rows with ids of their own."""

from __future__ import annotations

import math
import sys
from pathlib import Path

import duckdb
import pandas as pd
import pytest

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import DOCS, documents, page_rows

from filigree.llm import queries

EXTRA = [
    "my IBAN is GB82 WEST 1234 5698 7654 32.",
    "GB82 WEST 1234 5698 7654 33",
    "social security 123-45-6789",
    "part 123-45-6789 of it, ssn 000-45-6789",
    "a.b@c.d@e.f a@b.c_x@d.e ü",
    "999.1.2.3.4 001.2.3.0004 1.2.3.4.5.6.7.8",
    "4111  1111 1111 1111 4111 1111-1111 1111 +1 (988) 555-2485",
]


def plain(rows) -> list[tuple]:
    return sorted(tuple(f"{v:.9g}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_agrees(spark, monkeypatch, name):
    seen: set = set()
    docs = [r for r in documents() if r[0] is not None and len(r[1] or "") < 5000 and not (r[0] in seen or seen.add(r[0]))]
    docs += [(10_000 + i, t, "en", "s", len(t)) for i, t in enumerate(EXTRA)]
    pages, seen = [], set()
    for r in page_rows():
        if r[0] is not None and r[0] not in seen:
            seen.add(r[0])
            pages.append(r)
    tables = {"documents": spark.createDataFrame(docs, DOCS), "pages": spark.createDataFrame(pages, "page_id long, url string, html string")}
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, table: tables[table])
    c = duckdb.connect()
    c.register("documents", pd.DataFrame(docs, columns=[x.split()[0] for x in DOCS.split(", ")]))
    c.register("pages", pd.DataFrame(pages, columns=["page_id", "url", "html"]))
    got = queries.QUERIES[name](spark, "")
    cols = sorted(got.columns)
    want = c.sql(f"SELECT {', '.join(cols)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain(tuple(r) for r in got.select(*cols).collect()) == plain(want)
