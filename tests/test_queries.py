"""Every query of the catalogue against its SQL on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from loomtrail import catalog


def text(value) -> str:
    return repr(value) if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_against_sql(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    cur = duck.execute(catalog.ORACLE[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted(tuple(map(text, row)) for row in cur.fetchall())
    assert sorted(tuple(text(r[c]) for c in names) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_rows(spark, data, name):
    assert catalog.QUERIES[name](spark, data).count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["c_custkey", "n_runs", "solved", "score"]
