import os
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import history as H
from tapeloom.sources.pointstore import PERIOD_SECONDS, PointStore

SCHEMA = "token_id string, resolution string, extract_ord bigint, t bigint, price double"


def extract(spark, number, rows):
    return spark.createDataFrame([(k, r, number, t, p) for k, r, t, p in rows], SCHEMA)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture()
def extracts(spark):
    week = PERIOD_SECONDS
    first = [("a", "1m", i * week // 3, 0.1 + i / 100) for i in range(30)]
    first += [("a", "1h", i * week, 0.5) for i in range(8)] + [("b", "max", 5, 0.2), ("b", "1h", 5, 0.3)]
    second = [("a", "1m", i * week // 3, 0.6) for i in range(25, 40)] + [("b", "1h", 9, 0.4), ("c", "1h", 1, 0.9)]
    second += [("a", "1m", None, 0.5), (None, "1m", 3, 0.5), ("a", "1m", 7, None), ("c", None, 1, 0.1)]
    return extract(spark, 1, first), extract(spark, 2, second)


@pytest.fixture()
def store(extracts, tmp_path):
    store = PointStore(str(tmp_path / "points"), 4)
    for e in extracts:
        store.add(e)
    return store


@pytest.fixture()
def markets(spark):
    end = datetime(1970, 1, 20)
    return spark.createDataFrame(
        [("m", "a", end), ("n", "b", end), ("o", "zz", end)], "market_id string, token_id string, end_ts timestamp"
    )


def test_a_store_equals_all_extracts_at_once(spark, extracts, store, markets):
    points = extracts[0].union(extracts[1]).dropna()
    assert rows_of(store.finest_resolution(spark)) == rows_of(H.finest_resolution(points))
    assert rows_of(store.merge_resolutions(markets)) == rows_of(H.merge_resolutions(points, markets))
    assert {r.price for r in store.finest_resolution(spark).where("t >= 25 * 604800 div 3 and token_id = 'a'").collect()} == {0.6}


def test_points_are_not_shuffled(spark, store, markets):
    for rows in (store.finest_resolution(spark, 3), store.merge_resolutions(markets, max_markets=3)):
        shuffles = [
            line for line in rows._jdf.queryExecution().executedPlan().toString().splitlines()
            if "Exchange hashpartitioning" in line
        ]
        # What is shuffled are the tasks' partial results of one row per token or market.
        assert all(" t#" not in line and "period#" not in line for line in shuffles), shuffles
    points = store.points(spark).groupBy("token_id", "period", "resolution", "t").count()
    assert "Exchange" not in points._jdf.queryExecution().executedPlan().toString()


def test_adding_leaves_what_is_there(spark, extracts, store):
    folder = f"{store.path}/buckets-4"

    def files():
        return {f: os.path.getmtime(f"{folder}/{f}") for f in os.listdir(folder) if f.endswith(".parquet")}

    before, known = files(), rows_of(store.finest_resolution(spark))
    assert len(before) <= 8  # a file a bucket and extract
    store.add(extracts[1])
    store.add(extracts[0].limit(0))
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    assert rows_of(store.finest_resolution(spark)) == known


def test_a_store_keeps_its_buckets(spark, store, tmp_path):
    with pytest.raises(ValueError):
        PointStore(store.path, 5).points(spark)
    known = rows_of(store.finest_resolution(spark))
    for n in (4, 7):
        other = store.compacted(spark, PointStore(str(tmp_path / f"compact-{n}"), n))
        assert rows_of(other.finest_resolution(spark)) == known
        held = other.points(spark)
        assert held.count() == held.dropDuplicates(["token_id", "resolution", "t"]).count()
        with pytest.raises(ValueError):
            store.compacted(spark, other)


def test_an_empty_store(spark, tmp_path):
    empty = PointStore(str(tmp_path / "none"), 3)
    assert empty.points(spark).count() == 0 and empty.finest_resolution(spark).count() == 0


def test_a_hot_token_is_spread_over_its_periods(spark, tmp_path):
    store = PointStore(str(tmp_path / "hot"), 8)
    store.add(
        spark.range(4000).select(
            F.lit("hot").alias("token_id"), F.lit("1m").alias("resolution"), F.lit(1).alias("extract_ord"),
            (F.col("id") * (PERIOD_SECONDS // 50)).alias("t"), F.lit(0.5).alias("price"),
        )
    )
    held = store.points(spark).groupBy(F.input_file_name()).count().collect()
    assert len(held) == 8 and max(r["count"] for r in held) < 2000
    assert spark.catalog.listTables() == []
