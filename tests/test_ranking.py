"""Orders and budgets over tables of many ranges: the same in every run, with adaptive plans and without."""

import pytest
from pyspark.sql import functions as F

from glossmill.operators import mixture, ranking

N = 300_000


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "t")
    key = F.xxhash64("id")
    spark.range(0, N, numPartitions=7).select(key.alias("k"), (F.pmod(key, F.lit(97)) + 1).alias("tokens"), F.md5(F.col("id").cast("string")).alias("pad")).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    names = {"spark.sql.adaptive.enabled": request.param, "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_places_have_no_gaps_and_no_doubles(rows, adaptive):
    for _ in range(3):
        got = ranking.global_places(rows, F.col("k").desc()).select("k", "place").toPandas().sort_values("place")
        assert got["place"].tolist() == list(range(1, N + 1))
        assert got["k"].is_monotonic_decreasing


def test_ties_and_nulls_are_numbered_too(spark, adaptive):
    tied = spark.range(0, 50_000, numPartitions=5).select(F.when(F.col("id") % 3 > 0, F.col("id") % 5).alias("k"))
    got = ranking.global_places(tied, F.col("k")).toPandas().sort_values("place")
    assert got["place"].tolist() == list(range(1, 50_001))
    keys = got["k"].fillna(-1).tolist()
    assert keys == sorted(keys) and keys.count(-1) == 16_667


def test_stored_order_is_read_alike_twice(rows, adaptive):
    stored = ranking.stored_order(rows, "k")
    assert stored.select(ranking.range_of("_row")).distinct().count() > 5
    assert stored.agg(F.sum(F.xxhash64("k", "_row") % 1000)).collect() == stored.agg(F.sum(F.xxhash64("k", "_row") % 1000)).collect()


@pytest.mark.parametrize("budget", [1, 5_000_000, 20_000_000, 44_000_000])
def test_budgets_equal_a_loop_over_all_rows(rows, adaptive, budget):
    ordered = rows.select("k", "tokens").toPandas().sort_values("k").itertuples(index=False)
    want, total, cycle = [], 0, 0
    ordered = [(r.k, r.tokens) for r in ordered]
    while total < budget:
        for k, n in ordered:
            if total >= budget:
                break
            want.append((k, cycle))
            total += n
        cycle += 1
    got = mixture.budget_prefix(rows, "tokens", budget, "k").toPandas()
    assert sorted(zip(got["k"], got["cycle"], strict=True)) == sorted(want)


def test_budgets_of_several_sources_in_one_order(rows, adaptive):
    own = rows.withColumn("lang", F.when(F.col("k") % 3 == 0, "a").when(F.col("k") % 7 == 0, "b").otherwise("c"))
    budgets = {"a": 3_000_000, "b": mixture.percent(230), "c": mixture.percent(100)}
    got = mixture.budget_prefixes(own, "lang", "tokens", budgets, "k").select("k", "lang", "cycle").toPandas()
    table = own.select("k", "lang", "tokens").toPandas().sort_values("k")
    for lang, budget in budgets.items():
        part = table[table["lang"] == lang]
        all_tokens = int(part["tokens"].sum())
        budget = budget(all_tokens) if callable(budget) else budget
        want, total, cycle = [], 0, 0
        while total < budget:
            for k, n in zip(part["k"], part["tokens"], strict=True):
                if total >= budget:
                    break
                want.append((k, cycle))
                total += n
            cycle += 1
        mine = got[got["lang"] == lang]
        assert sorted(zip(mine["k"], mine["cycle"], strict=True)) == sorted(want)


def test_a_source_without_tokens_raises(spark):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 2, 0)], "lang string, k bigint, tokens bigint")
    with pytest.raises(ValueError, match="'b', 'c'"):
        mixture.budget_prefixes(rows, "lang", "tokens", {"a": 5, "b": 5, "c": 5}, "k")
