"""Every core query on empty tables and on tables of nothing but nulls and repeated rows: a defined result, no failure."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry

Q = {n: q for n, q in entry.queries().items() if not (n[0] == "p" and n[1].isdigit() and n[1] in "15678")}


@pytest.fixture(scope="module")
def odd(spark, sf, tmp_path_factory):
    """Two folders with the tables of ``sf``: without rows, and with five equal rows of nulls."""
    empty, nulls = tmp_path_factory.mktemp("empty"), tmp_path_factory.mktemp("nulls")
    for f in os.listdir(sf):
        df = spark.read.parquet(f"{sf}/{f}")
        df.limit(0).coalesce(1).write.parquet(f"{empty}/{f}")
        spark.range(5).select(*[F.lit(None).cast(s.dataType).alias(s.name) for s in df.schema]).coalesce(1).write.parquet(f"{nulls}/{f}")
    return str(empty), str(nulls)


@pytest.mark.parametrize("name", sorted(Q))
def test_empty_and_null_tables(spark, odd, name):
    for folder in odd:
        Q[name](spark, folder).collect()


def test_names_are_unique():
    names = [n for m in entry._modules() for n in m.queries()]
    assert len(names) == len(set(names))
