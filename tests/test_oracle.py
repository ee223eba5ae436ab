"""Every core query against its SQL, as the driver compares them."""

import os

import pyarrow.parquet as pq
import pytest
from compare import differs, views

from verslog.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return views(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_same_rows(spark, con, name):
    assert differs(spark, con, registry.QUERIES[name], registry.ORACLE[name], SF) == ""


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, con, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    folder = tmp_path_factory.mktemp("empty")
    for f in os.listdir(SF):
        pq.write_table(pq.read_table(f"{SF}/{f}").slice(0, 0), f"{folder}/{f}")
    return str(folder)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    always = {"oldest_pinned": 1, "memtable_size": 1, "cf_list": 3}  # figures over nothing, and fixed names
    assert registry.QUERIES[name](spark, empty).count() == always.get(name, 0)


def test_entry_point(spark, con):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
