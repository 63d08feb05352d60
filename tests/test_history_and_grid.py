import numpy as np
from conftest import all_near, near
from pyspark.sql import functions as F

from tapeloom.operators import grid as G
from tapeloom.operators import history as H
from tapeloom.operators import jumps as JU
from tapeloom.operators import series as R

H10 = 10 * 3600


def prints(spark, rows, key="m"):
    return spark.createDataFrame([(key, t, p) for t, p in rows], "market_id string, t bigint, price double")


def points(spark, rows):
    return spark.createDataFrame(rows, "token_id string, resolution string, extract_ord bigint, t bigint, price double")


def values(df, *names, order="unix_ts"):
    return [tuple(r[n] for n in names) if len(names) > 1 else r[names[0]] for r in df.orderBy(order).collect()]


def test_last_extract_wins_per_second(spark):
    df = points(spark, [("a", "1m", 1, 5, 0.1), ("a", "1m", 2, 5, 0.2), ("a", "1m", 3, 5, None), ("a", "1m", 1, 6, 0.3)])
    assert values(H.dedupe_history(df, ["token_id"]), "t", "price", order="t") == [(5, 0.2), (6, 0.3)]


def test_finest_resolution_never_mixes(spark):
    df = points(spark, [
        ("a", "1m", 1, 1, 0.1), ("a", "max", 1, 1, 0.2), ("a", "max", 1, 2, 0.2), ("a", "1h", 1, 9, 0.3),
        ("b", "1m", 1, 1, 0.1), ("b", "1h", 1, 2, 0.2),
        ("c", "1m", 1, 1, 0.1), ("c", "1m", 2, 1, 0.1),
    ])
    got = sorted((r.token_id, r.resolution, r.t) for r in H.finest_resolution(df).collect())
    assert got == [("a", "max", 1), ("a", "max", 2), ("b", "1h", 2), ("c", "1m", 1)]


def test_merge_resolutions(spark):
    end = 1_000_000
    markets = spark.createDataFrame([("m", "a", end), ("n", "b", end), ("o", "c", end)], "market_id string, token_id string, e bigint").withColumn("end_ts", F.timestamp_seconds("e"))
    early = end - 241 * 3600
    df = points(spark, [
        ("a", "1h", 9, end, 0.1), ("a", "1m", 1, end, 0.2), ("a", "1h", 1, end + 3600, 0.3), ("a", "1h", 1, end + 3601, 0.4),
        ("b", "1m", 1, end, 0.5), ("b", "1h", 1, early, 0.6), ("b", "1h", 2, end, 0.7),
        ("c", "max", 1, end, 0.9),
    ])
    got = sorted((r.market_id, r.t, r.price) for r in H.merge_resolutions(df, markets).collect())
    # b has one second near its end, so its whole hourly history is laid over it.
    assert got == [("m", end, 0.2), ("m", end + 3600, 0.3), ("n", early, 0.6), ("n", end, 0.7)]


def test_history_window_includes_both_ends(spark):
    now = F.timestamp_seconds(F.lit(100_000))
    markets = spark.createDataFrame([("m", "a", 96_400), ("n", "b", None)], "market_id string, token_id string, s bigint").withColumn("start_ts", F.timestamp_seconds("s"))
    df = points(spark, [(k, "1m", 1, t, 0.5) for k in "ab" for t in (92_799, 92_800, 96_399, 96_400, 100_000, 100_001)])
    got = sorted((r.market_id, r.t) for r in H.in_history_window(df, markets, now, 2.0).collect())
    assert got == [("m", 96_400), ("m", 100_000), ("n", 92_800), ("n", 96_399), ("n", 96_400), ("n", 100_000)]


def test_coverage(spark):
    tokens = spark.createDataFrame([("a",), ("b",), ("a",)], "token_id string")
    row = H.history_coverage(tokens, points(spark, [("a", "1m", 1, 1, 0.1), ("b", "1m", 1, 1, None), ("z", "1m", 1, 1, 0.2)])).first()
    assert (row.tokens_with_data, row.tokens_total) == (1, 2)


def test_bucket_and_as_of(spark):
    df = prints(spark, [(H10 + 300, 0.4), (H10 + 3000, 0.9), (H10 + 7200 + 1200, 0.7)])
    assert values(G.bucket_last(df, ["market_id"], 3600), "unix_ts", "price_yes") == [(H10, 0.9), (H10 + 7200, 0.7)]
    labels = R.as_of_labels(df, ["market_id"], 3600, "floor")
    assert values(labels, "unix_ts", "price_yes") == [(H10, None), (H10 + 3600, 0.9), (H10 + 7200, 0.9)]
    up = R.as_of_labels(df, ["market_id"], 3600, "ceil")
    assert values(up, "unix_ts", "price_yes")[-1] == (H10 + 10800, 0.7)
    held = R.hold_forward(df, ["market_id"], 3600)
    assert values(held, "unix_ts", "price_yes") == [(H10, 0.9), (H10 + 3600, 0.9), (H10 + 7200, 0.7)]


def test_as_of_on_the_label_and_single_print(spark):
    on = prints(spark, [(H10, 0.4), (H10 + 3600, 0.5)])
    assert values(R.as_of_labels(on, ["market_id"], 3600, "floor"), "price_yes") == [0.4, 0.5]
    one = prints(spark, [(H10 + 5, 0.4)])
    assert values(R.as_of_labels(one, ["market_id"], 3600, "floor"), "unix_ts", "price_yes") == [(H10, None)]
    assert R.as_of_labels(one.limit(0), ["market_id"], 3600, "floor").count() == 0


def test_bucket_stats(spark):
    df = prints(spark, [(1, 0.40), (2, 0.50), (3, 0.45), (3601, 0.2), (7300, None)])
    got = values(G.bucket_stats(df, ["market_id"], 3600), "raw_prints_in_bucket", "intrabucket_price_range", "intrabucket_price_stdev")
    assert got[0][0] == 3 and all_near(got[0][1:], (0.10, 0.040824829))
    assert got[1] == (1, 0.0, None) and len(got) == 2


def grid_of(spark, prices):
    rows = [("m", i * 3600, p) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "market_id string, unix_ts bigint, price_yes double")


PRICES = [0.40, None, 0.50, 0.45, 0.45, 0.95, 0.95]


def test_anchor(spark):
    df = G.anchor_prices(grid_of(spark, PRICES), ["market_id"])
    assert all_near(values(df, "price_yes_norm"), [0, None, 0.10, 0.05, 0.05, 0.55, 0.55])
    none = G.anchor_prices(grid_of(spark, [0.0, 1.0, None]), ["market_id"])
    assert values(none, "price_yes_norm") == [None] * 3


def test_jump_features(spark):
    row = JU.jump_features(G.anchor_prices(grid_of(spark, PRICES), ["market_id"]), ["market_id"]).first()
    want = {
        "feat_return_volatility": 0.200997512, "feat_jump_max_abs": 0.5, "feat_jump_top3_sum_abs": 0.65,
        "feat_jump_top3_frac_total_move": 1.0, "feat_jump_zcount_ge_2": 1, "feat_jump_zrate_ge_2": 0.2,
        "feat_jump_zcount_ge_3": 0, "feat_jump_zrate_ge_3": 0, "feat_jump_count_ge_p95": 1,
        "feat_jump_rate_ge_p95": 0.2, "feat_jump_count_ge_p99": 1, "feat_jump_rate_ge_p99": 0.2,
    }
    assert all(near(row[k], v) for k, v in want.items())


def test_jump_edges(spark):
    flat = JU.jump_features(grid_of(spark, [0.5, 0.5, 0.5]), ["market_id"]).first()
    assert flat.feat_jump_zcount_ge_2 == 0.0 and flat.feat_jump_top3_frac_total_move is None
    assert flat.feat_jump_count_ge_p95 == 2.0
    single = JU.jump_features(grid_of(spark, [0.5, None, 1.0]), ["market_id"]).first()
    assert single.n_valid == 1 and single.feat_return_volatility is None and single.feat_jump_zcount_ge_2 is None
    assert JU.jump_features(grid_of(spark, [None, 0.0]), ["market_id"]).count() == 0


def test_jump_features_against_plain_quantiles(spark):
    rng = np.random.default_rng(2)
    rows, plain = [], {}
    for key, n in enumerate([2, 3, 21, 101, 800]):
        prices = np.round(rng.uniform(0.01, 0.99, n), 1 if key % 2 else 6).clip(0.01, 0.99)
        rows += [(str(key), i * 60, float(p)) for i, p in enumerate(prices)]
        plain[str(key)] = np.abs(np.diff(prices))
    grid = spark.createDataFrame(rows, "market_id string, unix_ts long, price_yes double")
    got = {r.market_id: r for r in JU.jump_features(grid.repartition(5), ["market_id"]).collect()}
    assert got.keys() == plain.keys()
    for key, sizes in plain.items():
        r = got[key]
        # Spark's own exact percentile on the same sizes, ties included.
        p95, p99 = spark.createDataFrame([(float(a),) for a in sizes], "a double").selectExpr(
            "percentile(a, 0.95)", "percentile(a, 0.99)"
        ).first()
        assert r.feat_jump_count_ge_p95 == (sizes >= p95).sum()
        assert r.feat_jump_count_ge_p99 == (sizes >= p99).sum()
        assert near(r.feat_jump_top3_sum_abs, np.sort(sizes)[-3:].sum(), 1e-12)
        assert near(r.feat_jump_max_abs, sizes.max(), 1e-12)


def test_jump_features_hold_no_list_and_shuffle_once(spark):
    grid = spark.createDataFrame([("a", 0, 0.5)], "market_id string, unix_ts long, price_yes double")
    rows = JU.jump_features(grid, ["market_id"])
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "collect_list" not in plan and "percentile" not in plan


def test_grid_covers_floor_to_ceil_and_keeps_gaps(spark):
    markets = spark.createDataFrame([("m", 3700, 10_801), ("n", 20_000, 10_000)], "market_id string, s bigint, e bigint")
    lines = G.spine(markets, F.timestamp_seconds("s"), F.timestamp_seconds("e"), 3600)
    buckets = G.bucket_stats(prints(spark, [(3800, 0.5), (11_000, 0.6)]), ["market_id"], 3600)
    grid = G.fill_grid(lines, buckets, ["market_id"])
    assert values(grid, "unix_ts", "lookback_step", "price_yes", "raw_prints_in_bucket") == [
        (3600, 0, 0.5, 1), (7200, 1, None, 0), (10_800, 2, 0.6, 1), (14_400, 3, None, 0)
    ]
    axes = G.grid_axes(grid, F.timestamp_seconds("s"), 3600)
    assert values(axes, "normalized_step") == [0, 1, 2, 3]
    assert all_near(values(axes, "hours_since_market_start"), [-100 / 3600, 3500 / 3600, 7100 / 3600, 10_700 / 3600])
    noted = G.with_placeholders(markets.select("market_id"), grid.drop("s", "e"), ["market_id"], "none")
    assert {(r.market_id, r.note) for r in noted.collect()} == {("m", ""), ("n", "none")}


def test_rolling_and_fill(spark):
    df = grid_of(spark, [1.0, 2.0, 4.0, 8.0])
    line = R.along(["market_id"], "unix_ts")
    rolled = df.withColumn("r", R.rolling_deviation(F.col("price_yes"), line))
    assert all_near(values(rolled, "r"), [None, 0.707106781, 1.527525232, 3.095695937])
    assert near(rolled.agg(F.avg("r")).first()[0], 1.776775983)
    filled = grid_of(spark, [None, 0.3, None, 0.5, None]).withColumn("f", R.fill_both_ways(F.col("price_yes"), line, 0.5))
    assert values(filled, "f") == [0.3, 0.3, 0.3, 0.5, 0.5]
    empty = grid_of(spark, [None, None]).withColumn("f", R.fill_both_ways(F.col("price_yes"), line, 0.5))
    assert values(empty, "f") == [0.5, 0.5]
    diffs = grid_of(spark, [0.4, 0.1, 0.5]).withColumn("d", R.difference_or_zero(F.col("price_yes"), line))
    assert all_near(values(diffs, "d"), [0, -0.3, 0.4])
