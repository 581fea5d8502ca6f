"""Every registered query against its SQL twin on the smallest tables."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from registry.oracle import ORACLE
from registry.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in sorted(Path(SF).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def canonical(rows, columns):
    """Rows as sorted tuples; floats come last, so that they hardly decide the order."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        ([repr(r[i]) for i in order if not isinstance(r[i], float)], [r[i] + 0.0 for i in order if isinstance(r[i], float)])
        for r in rows
    )


def differences(got, expected):
    """The pairs of rows that differ; a float that is rounded to six digits may round either way."""
    pairs = list(zip(got, expected))
    same = lambda a, b: a[0] == b[0] and a[1] == pytest.approx(b[1], rel=0, abs=1.5e-6, nan_ok=True)
    return [pair for pair in pairs if not same(*pair)] + [len(got)] * (len(got) != len(expected))


def test_every_query_has_a_twin():
    assert set(ORACLE) == set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLE) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, SF)
    cursor = duck.execute(entry_points.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert differences(canonical(df.collect(), df.columns), canonical(cursor.fetchall(), columns)) == []


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0
