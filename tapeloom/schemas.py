"""Explicit schemas of the landed inputs and the published outputs."""

from __future__ import annotations

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


# Numbers arrive as text or as numbers; text takes both and is cast leniently later.
MARKET = T.StructType(
    _strings(
        "id", "question", "startDate", "endDate", "clobTokenIds", "outcomes", "outcomePrices",
        "sportsMarketType", "category", "volumeNum", "liquidityNum", "volume", "liquidity",
        "liquidityClob", "liquidityAmm", "volumeClob", "volume1wkClob", "bestBid", "bestAsk",
    )
    + [T.StructField("active", T.BooleanType()), T.StructField("closed", T.BooleanType())]
)

EVENT = T.StructType(
    _strings("title", "series_id") + [T.StructField("markets", T.ArrayType(MARKET))]
)

POINT = T.StructType(_strings("t", "p"))
# Points are first read as raw text, so that one element of another shape spoils only itself.
RAW_POINTS = T.ArrayType(T.StringType())
HISTORY = T.StructType([T.StructField("history", RAW_POINTS)])
CLEAN_HISTORY = T.StructType([T.StructField("history", T.ArrayType(POINT))])
BATCH_KEYS = ("token_id", "market", "asset_id")
BATCH_ITEM = T.StructType(_strings(*BATCH_KEYS) + [T.StructField("history", RAW_POINTS)])
BATCH_HISTORY = T.StructType(
    [
        T.StructField("history", T.MapType(T.StringType(), RAW_POINTS)),
        T.StructField("data", RAW_POINTS),
    ]
)

LEVEL = T.StructType(_strings("price", "size"))
BOOK = T.StructType(
    _strings("timestamp")
    + [T.StructField("bids", T.ArrayType(LEVEL)), T.StructField("asks", T.ArrayType(LEVEL))]
)

# Published feature names, in output order.
ACTIVE_FEATURES = (
    "feat_jump_zcount_ge_2",
    "feat_jump_zrate_ge_2",
    "feat_jump_zcount_ge_3",
    "feat_jump_zrate_ge_3",
    "feat_jump_count_ge_p95",
    "feat_jump_rate_ge_p95",
    "feat_jump_count_ge_p99",
    "feat_jump_rate_ge_p99",
    "feat_jump_max_abs",
    "feat_jump_top3_sum_abs",
    "feat_jump_top3_frac_total_move",
    "feat_return_volatility",
    "feat_time_to_close_hours",
    "feat_raw_prints_per_hour",
    "feat_ob_spread",
    "feat_ob_spread_over_mid",
    "feat_ob_imbalance_topn",
    "feat_ob_mid",
    "feat_ob_log_bid_ask_depth_ratio",
)
CLOSED_FEATURES = (
    "momentum_1h",
    "momentum_6h",
    "momentum_24h",
    "volatility_24h",
    "efficiency_ratio",
    "ripeness_hours",
)

IDENTITY = ("market_id", "classifier_label", "tag_id", "tag_slug")

FEATURES = T.StructType(_strings(*IDENTITY) + _doubles(*ACTIVE_FEATURES))

RAW_GRID = T.StructType(
    _strings(*IDENTITY, "question", "timestamp_iso")
    + [T.StructField("unix_ts", T.LongType())]
    + _doubles("price_yes", "price_yes_norm")
    + [T.StructField("normalized_step", T.LongType()), T.StructField("lookback_step", T.LongType())]
    + _doubles("hours_since_market_start")
    + _strings("gamma_market_start_iso", "grid_interval")
    + _doubles("interval_hours", "lookback_days")
    + [T.StructField("raw_prints_in_bucket", T.LongType())]
    + _doubles(
        "intrabucket_price_range", "intrabucket_price_stdev",
        "gamma_volume_num", "gamma_liquidity_num", "gamma_volume", "gamma_liquidity_clob",
        "ob_best_bid", "ob_best_ask", "ob_mid", "ob_spread",
        "ob_imbalance_topn", "ob_bid_depth_topn", "ob_ask_depth_topn",
    )
    + _strings("ob_timestamp_ms", "note")
)
