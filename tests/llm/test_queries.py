"""Registered queries against their SQL, at the smallest scale."""

import os

import duckdb
import pandas as pd
import pytest

from quotecast.llm.queries import ORACLES, QUERIES
from tools.check_oracles import TABLES, normal

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, FOLDER).toPandas()
    cur = duck.execute(ORACLES[name])
    want = pd.DataFrame(cur.fetchall(), columns=[c[0] for c in cur.description])
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_operator_has_a_query():
    assert sorted({int(n[2:].split("_")[0]) for n in QUERIES}) == list(range(1, 14))
