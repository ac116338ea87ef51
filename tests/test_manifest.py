"""The manifest of published links covers every line of lineitem, once per repeat."""

from collections import Counter

import duckdb

from glossmill.plans import registry

SF = "/root/testdata/sf0.001"


def test_every_experiment_is_linked_once_per_repeat(spark):
    lines = duckdb.sql(f"SELECT l_orderkey, l_partkey, l_quantity FROM '{SF}/lineitem.parquet'").fetchall()
    want = Counter((order, slot, f"data/{part}") for order, part, repeat in lines for slot in range(int(repeat)))
    got = Counter((r["experiment"], r["slot"], r["path"]) for r in registry.queries()["sink_symlink_publish"](spark, SF).collect())
    assert got == want
    assert {e for e, _, _ in got} == {order for order, _, _ in lines}
