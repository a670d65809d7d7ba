import pytest

import __spark_entry__
from depthframe.plans import catalog

from .conftest import duck_rows, rows_of


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_its_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    got = rows_of(df)
    assert got == duck_rows(duck, catalog.ORACLE[name], df.columns) and got


def test_entry(spark, sf_dir):
    rows = {r["name"]: r for r in __spark_entry__.entry(spark).collect()}
    assert len(rows) == 25
    one = rows["Brand#1"]
    assert (one["region_length"], one["mean"], one["stddev"], one["q1"], one["median"], one["q3"], one["min"], one["max"]) == (171, 30.076023, 6.89945, 25, 29, 34, 16, 44)


def test_every_query_of_the_engine_is_registered():
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLE) <= set(__spark_entry__.oracle_sql())
    assert len(catalog.QUERIES) == len(catalog.ORACLE) == 42
