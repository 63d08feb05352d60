import math

import numpy as np
import pytest
from conftest import near
from pyspark.sql import functions as F

from tapeloom.operators import closedfeatures as CF
from tapeloom.operators import streaks as S

H = 3600


def minutes(*rows):
    return [(h * H + m * 60, p) for h, m, p in rows]


def token_prints(spark, rows):
    return spark.createDataFrame([("a", t, p) for t, p in rows], "token_id string, t bigint, price double")


def market(spark, end):
    return spark.createDataFrame([("m", "a", end)], "market_id string, token_id string, e bigint").withColumn("end_ts", F.timestamp_seconds("e"))


def detect(spark, rows, end, **options):
    r = S.detect_streaks(token_prints(spark, rows), market(spark, end), **options).first()
    return r.status, r.segment_start, r.segment_end


def test_no_streak_when_a_mid_price_breaks_it(spark):
    rows = minutes((0, 10, 0.5), (2, 50, 0.96), (3, 5, 0.97), (3, 40, 0.5), (6, 59, 0.02))
    assert detect(spark, rows, 7 * H) == ("no_skew_streak", None, None)


def test_streak_across_a_held_hour(spark):
    rows = minutes((0, 10, 0.5), (2, 50, 0.96), (4, 10, 0.97))
    assert detect(spark, rows, 5 * H) == ("ok", 0, 2 * H)


def test_streak_at_the_last_pair_and_low_side(spark):
    rows = minutes((0, 10, 0.5), (1, 0, 0.05), (2, 0, 0.0))
    assert detect(spark, rows, 3 * H) == ("ok", -H, H)
    assert detect(spark, rows, 3 * H, segment_hours=1) == ("ok", 0, H)


def test_statuses(spark):
    assert detect(spark, minutes((1, 0, 0.99)), 3 * H)[0] == "insufficient_hourly_clob"
    assert detect(spark, [], 3 * H)[0] == "insufficient_hourly_clob"
    assert detect(spark, minutes((1, 0, 0.99), (1, 5, 0.99)), 3 * H)[0] == "sparse_hourly_resample"
    late = minutes((5, 0, 0.99), (6, 0, 0.99))
    assert detect(spark, late, 3 * H, lookback_hours=None)[0] == "no_hourly_before_gamma_end"
    assert detect(spark, late, 3 * H)[0] == "insufficient_hourly_clob"
    mixed = minutes((1, 0, 0.99), (5, 0, 0.99))
    assert detect(spark, mixed, 3 * H, lookback_hours=None)[0] == "sparse_hourly_resample"


def brute_streak(rows, end):
    """Hour by hour on an explicit held series."""
    rows = sorted(r for r in rows if end - 336 * H <= r[0] <= end)
    if len(rows) < 2:
        return "insufficient_hourly_clob", None
    last = {}
    for t, p in rows:
        last[t // H] = p
    hours, held = range(min(last), max(last) + 1), []
    for h in hours:
        held.append(last.get(h, held[-1] if held else None))
    if len(held) < 2:
        return "sparse_hourly_resample", None
    for h, a, b in zip(hours, held, held[1:]):
        if (a >= 0.95 or a <= 0.05) and (b >= 0.95 or b <= 0.05):
            return "ok", h * H
    return "no_skew_streak", None


@pytest.mark.parametrize("seed", range(3))
def test_streaks_agree_with_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    data, want = [], {}
    ends = {}
    for k in range(40):
        n = int(rng.integers(0, 12))
        ts = rng.choice(30 * H, size=n, replace=False)
        ps = rng.choice([0.01, 0.5, 0.97], size=n, p=[0.3, 0.4, 0.3])
        rows = [(int(t), float(p)) for t, p in zip(ts, ps)]
        ends[k] = int(rng.integers(10, 31)) * H
        want[str(k)] = brute_streak(rows, ends[k])
        data += [(str(k), t, p) for t, p in rows]
    prints = spark.createDataFrame(data, "token_id string, t bigint, price double")
    markets = spark.createDataFrame([(str(k), str(k), e) for k, e in ends.items()], "market_id string, token_id string, e bigint").withColumn("end_ts", F.timestamp_seconds("e"))
    got = {r.market_id: (r.status, r.segment_end) for r in S.detect_streaks(prints, markets).collect()}
    assert got == want


def test_segment_keeps_both_ends(spark):
    segments = spark.createDataFrame([("m", "a", 100, 200), ("n", "a", None, None)], "market_id string, token_id string, segment_start bigint, segment_end bigint")
    rows = S.prints_in_segment(token_prints(spark, [(99, 0.1), (100, 0.2), (200, 0.3), (201, 0.4)]), segments)
    got = sorted((r.t, r.seconds_since_window_start, r.seconds_until_window_end) for r in rows.collect())
    assert got == [(100, 0.0, 100.0), (200, 100.0, 0.0)]


def closed(spark, rows, end, volume=10.0, start=0, **options):
    prints = spark.createDataFrame([("m", t, p) for t, p in rows], "market_id string, t bigint, price double")
    markets = spark.createDataFrame([("m", volume, start, end)], "market_id string, volume_num double, s bigint, e bigint").select(
        "market_id", "volume_num", F.timestamp_seconds("s").alias("start_ts"), F.timestamp_seconds("e").alias("end_ts"))
    return CF.closed_features(prints, markets, **options).first()


def brute_closed(rows, end):
    """As-of on each of the 73 hours, straight from the definition."""
    rows = sorted(r for r in rows if r[0] <= end)
    lo, hi = rows[0][0] // H * H, rows[-1][0] // H * H
    series = []
    for h in range(end - 72 * H, end + 1, H):
        seen = [p for t, p in rows if t <= h]
        series.append(seen[-1] if seen and lo <= h <= hi else None)
    for i in range(1, 73):
        if series[i] is None:
            series[i] = series[i - 1]
    for i in range(71, -1, -1):
        if series[i] is None:
            series[i] = series[i + 1]
    if series[0] is None:
        return None
    level = [math.log(min(max(p, 0.001), 0.999) / (1 - min(max(p, 0.001), 0.999))) for p in series]
    core = level[24:]
    rolls = [np.std(core[max(0, i - 23): i + 1], ddof=1) for i in range(1, len(core))]
    width = max(max(series[24:]) - min(series[24:]), 1e-6)
    return (level[72] - level[71], level[72] - level[66], level[72] - level[48], float(np.mean(rolls)), 10.0 / width)


@pytest.mark.parametrize("seed", range(4))
def test_closed_features_agree_with_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    end = 200 * H
    rows = [(int(t), float(p)) for t, p in zip(rng.choice(210 * H, 25, replace=False), rng.uniform(0, 1, 25))]
    row = closed(spark, rows, end)
    want = brute_closed(rows, end)
    got = (row.momentum_1h, row.momentum_6h, row.momentum_24h, row.volatility_24h, row.efficiency_ratio)
    assert all(near(a, b) for a, b in zip(got, want)) and row.ripeness_hours == 200.0


def test_closed_edges(spark):
    end = 200 * H
    assert closed(spark, [], end) is None
    assert closed(spark, [(end + 5, 0.5)], end) is None
    assert closed(spark, [(end - 3600, 0.5), (end, 0.6)], end + 60) is None
    floored = closed(spark, [(end - 3600, 0.5), (end, 0.6)], end + 60, anchor="floor_hour")
    assert near(floored.momentum_1h, math.log(0.6 / 0.4))
    assert closed(spark, [(100 * H, 0.5)], end) is None
    missing_volume = closed(spark, [(end - 3600, 0.5), (end, 0.6)], end, volume=None)
    assert missing_volume.efficiency_ratio is None and missing_volume.momentum_1h is not None
    with pytest.raises(ValueError):
        closed(spark, [], end, anchor="start")


def test_segments_join_by_time_bins(spark):
    """One token with most prints and many segments, bounds on and off the bins, empty segments."""
    prints = spark.range(4000).selectExpr(
        "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('t', id % 5) END AS token_id", "id * 7 - 9000 AS t", "0.5D AS price"
    )
    segments = spark.range(60).selectExpr(
        "concat('m', id) AS market_id", "CASE WHEN id % 2 = 0 THEN 'hot' ELSE concat('t', id % 7) END AS token_id",
        "id * 300 - 9000 AS segment_start",
        "CASE WHEN id % 11 = 0 THEN NULL WHEN id % 13 = 0 THEN id * 300 - 9001 ELSE id * 300 - 9000 + id * 60 END AS segment_end",
    )
    plain = prints.join(segments, "token_id").where("t BETWEEN segment_start AND segment_end").select("market_id", "t")
    for width in (60, 3600, 10**6):
        got = S.prints_in_segment(prints, segments, bin_seconds=width)
        assert sorted(map(tuple, got.select("market_id", "t").collect())) == sorted(map(tuple, plain.collect()))
        assert "_bin" not in got.columns
