"""Every plan with an oracle gives the oracle's rows."""

import duckdb
import pandas as pd
import pytest

from glossmill.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in registry.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    text = lambda v: "NULL" if v is None or v is pd.NA or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return list(frame.columns), sorted(tuple(map(text, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_plan_equals_oracle(spark, duck, name):
    got = rows(registry.queries()[name](spark, SF).toPandas())
    assert got == rows(duck.execute(registry.oracles()[name]).fetchdf())


#: Queries that SQL cannot express; other tests hold them against brute force.
WITHOUT_ORACLE = {"noise_dispatch"}


def test_every_other_query_has_an_oracle():
    assert set(registry.queries()) - set(registry.oracles()) == WITHOUT_ORACLE
