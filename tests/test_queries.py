"""Every query gives the rows of its SQL on the smallest tables; the entry query has rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__
from quantweave import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in SF.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.6g}") + 0.0
    if isinstance(x, list | tuple):
        return tuple(_plain(y) for y in x)
    return str(x)[:19] if hasattr(x, "isoformat") else x


def _rows(names, rows):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=str)


def _close(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-5, abs_tol=2e-6)
    return a == b


NAMES = sorted(catalog.oracles())


@pytest.mark.skipif(not SF.is_dir(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    got = catalog.queries()[name](spark, str(SF))
    want = tables.execute(catalog.oracles()[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    ours, theirs = _rows(got.columns, got.collect()), _rows(names, want.fetchall())
    assert len(ours) == len(theirs)
    assert all(_close(x, y) for a, b in zip(ours, theirs, strict=True) for x, y in zip(a, b, strict=True))


@pytest.mark.skipif(not SF.is_dir(), reason="the driver's tables are not here")
def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
