"""Operators that SQL can state give the same rows in both engines on the smallest tables."""

import os

import duckdb
import pytest

from sieveworks.llm import registry
from sieveworks.llm.oracles import ORACLE

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, name):
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    want = c.execute(ORACLE[name]).df()
    got = registry.queries()[name](spark, DATA).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    rows = lambda p: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in p[cols].itertuples(index=False))
    assert rows(got) == rows(want)
