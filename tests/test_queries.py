"""Every query with SQL against DuckDB on the smallest tables, where they are."""

import os
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _rows(t: pa.Table) -> list[tuple]:
    one = lambda x: "" if x is None or x != x else repr(round(x, 8)) if isinstance(x, float) else str(x)
    return sorted(tuple(map(one, r.values())) for r in t.select(sorted(t.column_names)).to_pylist())


def _kinds(t: pa.Table) -> dict[str, str]:
    """Types by name; widths of integers and zones of times are left out."""
    kind = lambda x: "int" if pa.types.is_integer(x) else "time" if pa.types.is_timestamp(x) else "text" if "string" in str(x) else str(x)
    return {f.name: kind(f.type) for f in t.schema}


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, db, name):
    got = entry.queries()[name](spark, str(DATA)).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql:
        want = db.execute(sql).to_arrow_table()
        assert _kinds(got) == _kinds(want)
        assert _rows(got) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
