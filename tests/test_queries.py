"""Every query with a DuckDB statement equals it; every other one runs with a stable schema."""


import pytest

from tests import compare

import __spark_entry__ as entry

Q, SQL = entry.queries(), entry.oracle_sql()
CORE = [n for n in Q if not (n[0] == "p" and n[1].isdigit() and n[2] == "_") or n[1] in "234"]


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", [n for n in CORE if n in SQL])
def test_equals_sql(spark, sf, con, name):
    got, want = compare.both(spark, sf, Q[name], SQL[name], con)
    assert got == want


@pytest.mark.parametrize("name", [n for n in CORE if n not in SQL])
def test_runs(spark, sf, name):
    df = Q[name](spark, sf)
    assert df.columns == Q[name](spark, sf).columns
    assert df.count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = Q["threshold_and"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity,30.0)" in plan and "l_extendedprice" not in plan


def test_unicode_fold_keeps_every_title(spark, tmp_path):
    from folioworks.plans.library_queries import unicode_fold

    spark.createDataFrame([(1, "Die Straße"), (2, None), (3, "ÉTÉ")], "book_key long, title string").write.parquet(f"{tmp_path}/library_books.parquet")
    assert {(r.book_key, r.folded) for r in unicode_fold(spark, str(tmp_path)).collect()} == {(1, "die strasse"), (2, None), (3, "été")}
