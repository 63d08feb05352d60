"""Cleaning and choosing price histories.

Points are rows (token_id, resolution, extract_ord, t, price) with ``t`` in epoch seconds.
Every step first reduces points to one row per (key, second) with map-side partial aggregation,
so a token that holds a large share of the rows is spread over its seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.timegrid import ceil_second, floor_second
from tapeloom.session import broadcast_bytes, join_small, row_bytes

# Resolutions from finest to coarsest, as they are tried.
RESOLUTIONS = ("1m", "max", "1h")
# Lookback of the merged history and the slack after the end time.
MERGE_LOOKBACK_HOURS, MERGE_TAIL_SECONDS = 240.0, 3600


def dedupe_history(points: DataFrame, keys: list[str]) -> DataFrame:
    """One price per key and whole second; the last extract wins."""
    return (
        points.where(F.col("price").isNotNull() & F.col("t").isNotNull())
        .groupBy(*keys, "t")
        .agg(F.max_by("price", "extract_ord").alias("price"))
    )


def window_start(start: Column, as_of: Column, lookback_hours: float) -> Column:
    """Later of the market start and ``as_of`` minus the lookback; unknown starts use the latter."""
    reach = F.timestamp_micros(F.unix_micros(as_of) - F.lit(int(lookback_hours * 3_600_000_000)))
    return F.greatest(F.coalesce(start, reach), reach)


def in_history_window(
    points: DataFrame,
    markets: DataFrame,
    as_of: Column,
    lookback_hours: float,
    max_markets: int | None = None,
) -> DataFrame:
    """Points of known markets inside [window start, as_of], both ends included.

    ``markets`` has one row per market with ``token_id`` and ``start_ts``. The constant bounds are
    also applied before the join as plain comparisons with ``t``, which reach the file scan.
    """
    no_start = F.lit(None).cast("timestamp")
    reach = ceil_second(window_start(no_start, as_of, lookback_hours))
    recent = points.where((F.col("t") >= reach) & (F.col("t") <= floor_second(as_of)))
    windows = markets.select(
        "market_id", "token_id",
        ceil_second(window_start(F.col("start_ts"), as_of, lookback_hours)).alias("_from"),
    )
    joined = join_small(recent, windows, ["token_id"], "inner", max_markets)
    return joined.where(F.col("t") >= F.col("_from")).drop("_from")


def _finest(stats: dict[str, tuple[Column, Column]]) -> Column:
    """First resolution with two seconds, else the coarsest that has any."""
    tried = [F.when(stats[r][0], F.lit(r)) for r in RESOLUTIONS]
    tried += [F.when(stats[r][1], F.lit(r)) for r in reversed(RESOLUTIONS)]
    return F.coalesce(*tried)


def resolution_to_use(points: DataFrame, key: str) -> DataFrame:
    """(key, resolution): the one resolution each key should use.

    Two different seconds are a first and a last one that differ, so raw points are reduced within
    each task to one row per key; nothing needs to be deduplicated to choose.
    """
    priced = F.col("price").isNotNull() & F.col("t").isNotNull()
    own = [
        (F.min(F.when(priced & (F.col("resolution") == r), F.col("t"))).alias(f"first_{r}"),
         F.max(F.when(priced & (F.col("resolution") == r), F.col("t"))).alias(f"last_{r}"))
        for r in RESOLUTIONS
    ]
    per_key = points.groupBy(key).agg(*[c for pair in own for c in pair])
    stats = {
        r: (F.col(f"first_{r}") < F.col(f"last_{r}"), F.col(f"first_{r}").isNotNull())
        for r in RESOLUTIONS
    }
    return per_key.select(key, _finest(stats).alias("resolution")).where("resolution IS NOT NULL")


def finest_resolution(
    points: DataFrame, key: str = "token_id", max_keys: int | None = None, layout: tuple[str, ...] = ()
) -> DataFrame:
    """Deduplicated points of the one resolution each key should use; never a mix.

    The resolution is chosen first, so only its points are shuffled by second. ``layout`` names
    columns that follow from key and time; points bucketed by key and these are not shuffled.
    """
    use = resolution_to_use(points, key)
    chosen = join_small(points, use, [key, "resolution"], "left_semi", max_keys)
    return dedupe_history(chosen, [key, "resolution", *layout]).drop(*layout)


def near_ends(
    points: DataFrame, markets: DataFrame, lookback: int, tail: int, max_markets: int | None = None
) -> DataFrame:
    """Points of the markets' tokens within [end - lookback, end + tail] seconds of an end time.

    A filter on raw points, to be put before they are deduplicated. ``markets`` has one row per
    market with ``token_id`` and ``end_ts``; a point is kept once, however many markets it serves.
    """
    ends = markets.select(
        F.col("token_id").alias("_token"), F.unix_seconds("end_ts").alias("_end")
    ).distinct()
    reach = (
        (F.col("token_id") == F.col("_token"))
        & (F.col("t") >= F.col("_end") - lookback)
        & (F.col("t") <= F.col("_end") + tail)
    )
    small = max_markets is not None and max_markets * row_bytes(ends.schema) <= broadcast_bytes(
        points.sparkSession
    )
    return points.join(F.broadcast(ends) if small else ends, reach, "left_semi")


def _merge_inputs(points: DataFrame, markets: DataFrame, lookback_hours: float, max_markets: int | None):
    """Hourly and minute points of the markets with ``_near``: within reach of the end time."""
    ends = markets.select("market_id", "token_id", F.unix_seconds("end_ts").alias("_end"))
    usable = points.where(F.col("resolution").isin("1h", "1m") & F.col("price").isNotNull())
    reach = int(lookback_hours * 3600)
    near = (F.col("t") >= F.col("_end") - reach) & (F.col("t") <= F.col("_end") + MERGE_TAIL_SECONDS)
    return join_small(usable, ends, ["token_id"], "inner", max_markets).withColumn("_near", near)


def sparse_markets(
    points: DataFrame,
    markets: DataFrame,
    lookback_hours: float = MERGE_LOOKBACK_HOURS,
    max_markets: int | None = None,
) -> DataFrame:
    """(market_id) with prints in fewer than two seconds near the end time."""
    span = (
        _merge_inputs(points, markets, lookback_hours, max_markets)
        .where("_near")
        .groupBy("market_id")
        .agg((F.min("t") < F.max("t")).alias("_dense"))
    )
    return markets.select("market_id").join(span.where("_dense"), "market_id", "left_anti")


def merge_resolutions(
    points: DataFrame,
    markets: DataFrame,
    lookback_hours: float = MERGE_LOOKBACK_HOURS,
    max_markets: int | None = None,
    layout: tuple[str, ...] = (),
) -> DataFrame:
    """(market_id, t, price): hourly prints overwritten by minute prints before the end time.

    Where that leaves fewer than two seconds, the whole hourly history is laid over it.
    ``markets`` has one row per market with ``token_id`` and ``end_ts``. The sparse markets are
    found first, by one row per market and task, so that only points that count are shuffled.
    ``layout`` names columns that follow from market and time; points bucketed by these are not shuffled.
    """
    sparse = sparse_markets(points, markets, lookback_hours, max_markets)
    joined = _merge_inputs(points, markets, lookback_hours, max_markets)
    marked = join_small(
        joined, sparse.withColumn("_sparse", F.lit(True)), ["market_id"], "left", max_markets
    )
    is_sparse = F.coalesce(F.col("_sparse"), F.lit(False))
    # A minute print outranks any hourly print of the same second.
    rank = F.when(F.col("resolution") == "1m", F.lit(1 << 62)).otherwise(F.lit(0)) + F.col("extract_ord")
    near, wide = F.col("_near"), is_sparse & (F.col("resolution") == "1h")
    return (
        marked.where(near | wide)
        .groupBy("market_id", "t", *layout)
        .agg(
            F.coalesce(
                F.max_by(F.when(wide, F.col("price")), F.when(wide, F.col("extract_ord"))),
                F.max_by(F.when(near, F.col("price")), F.when(near, rank)),
            ).alias("price")
        )
        .drop(*layout)
    )


def history_coverage(tokens: DataFrame, points: DataFrame) -> DataFrame:
    """One row: how many of the wanted tokens have any point.

    Points shrink to one row per token before they meet the wanted list.
    """
    have = points.where(F.col("price").isNotNull()).select("token_id").distinct()
    marked = tokens.select("token_id").distinct().join(
        have.withColumn("_hit", F.lit(1)), "token_id", "left"
    )
    return marked.agg(
        F.count("_hit").alias("tokens_with_data"), F.count(F.lit(1)).alias("tokens_total")
    )
