"""Every query of the subpackage against its SQL, or that it gives rows."""

import os

import pyarrow.parquet as pq
import pytest
from compare import differs, views

from verslog.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return views(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_rows(spark, con, name):
    if name in queries.ORACLE:
        assert differs(spark, con, queries.QUERIES[name], queries.ORACLE[name], SF) == ""
    else:
        assert queries.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    for f in os.listdir(SF) if os.path.isdir(SF) else []:
        pq.write_table(pq.read_table(f"{SF}/{f}").slice(0, 0), f"{tmp_path}/{f}")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    assert queries.QUERIES[name](spark, str(tmp_path)).count() == 0
