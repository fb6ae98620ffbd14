"""Every registered query against the same question in SQL, run by another engine."""

import math
from pathlib import Path

import pytest

import __spark_entry__ as driver
from almagest.queries import catalogs, search
from conftest import plan_text

duckdb = pytest.importorskip("duckdb")
DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="test tables not present")

@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value)


@pytest.mark.parametrize("name", sorted({**search.QUERIES, **catalogs.QUERIES}))
def test_query(spark, database, name):
    frame = driver.queries()[name](spark, str(DATA))
    columns = sorted(frame.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())
    assert rows
    text = plan_text(frame)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    answer = database.execute(driver.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[k]) for k in order) for r in answer.fetchall())


def test_every_query_of_the_catalogs_has_sql():
    assert set(search.QUERIES) | set(catalogs.QUERIES) <= set(driver.oracle_sql())


def test_entry(spark):
    assert driver.entry(spark).count() == 54
