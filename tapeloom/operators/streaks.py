"""When an outcome looks decided, and the segment before that moment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.prices import clip
from tapeloom.functions.timegrid import HOUR, floor_to
from tapeloom.operators.series import along
from tapeloom.session import join_small

# Extreme prices, search span and segment length in hours, status texts.
SKEW_HIGH, SKEW_LOW = 0.95, 0.05
SKEW_LOOKBACK_HOURS, SEGMENT_HOURS = 336.0, 2.0
TOO_FEW, NONE_BEFORE_END, TOO_SHORT, NO_STREAK, FOUND = (
    "insufficient_hourly_clob",
    "no_hourly_before_gamma_end",
    "sparse_hourly_resample",
    "no_skew_streak",
    "ok",
)


def detect_streaks(
    prints: DataFrame,
    markets: DataFrame,
    segment_hours: float = SEGMENT_HOURS,
    high: float = SKEW_HIGH,
    low: float = SKEW_LOW,
    lookback_hours: float | None = SKEW_LOOKBACK_HOURS,
    max_markets: int | None = None,
) -> DataFrame:
    """(market_id, segment_start, segment_end, status) for every market; bounds in epoch seconds.

    ``markets`` has one row per market with ``token_id`` and ``end_ts``. The segment ends at the
    first of two hours in a row with an extreme price, on the hourly last price held over empty
    hours. A held hour repeats its price, so a pair shows as an extreme hour that is followed by
    a gap or by another extreme hour: no hour needs to be made up.
    """
    ends = markets.select("market_id", "token_id", F.unix_seconds("end_ts").alias("_end"))
    joined = join_small(
        prints.where(F.col("price").isNotNull()), ends, ["token_id"], "inner", max_markets
    )
    if lookback_hours is not None:
        joined = joined.where(
            (F.col("t") >= F.col("_end") - int(lookback_hours * HOUR)) & (F.col("t") <= F.col("_end"))
        )
    before = F.col("t") <= F.col("_end")
    hours = joined.groupBy("market_id", floor_to(F.col("t"), HOUR).alias("hour")).agg(
        F.max_by(F.when(before, F.col("price")), F.when(before, F.col("t"))).alias("price"),
        F.count(F.lit(1)).alias("n"),
    )
    held = clip(F.col("price"), 0.0, 1.0)
    known = F.when(F.col("price").isNotNull(), F.col("hour"))
    extreme = (held >= high) | (held <= low)
    line = along(["market_id"], "hour")
    next_hour, next_extreme = F.lead(known).over(line), F.lead(extreme).over(line)
    pair = extreme & ((next_hour > F.col("hour") + HOUR) | next_extreme)
    found = (
        hours.withColumn("_pair", pair)
        .groupBy("market_id")
        .agg(
            F.sum("n").alias("n"),
            F.count("price").alias("n_before"),
            ((F.max(known) - F.min(known)) / HOUR + 1).alias("n_hours"),
            F.min(F.when(F.col("_pair"), F.col("hour"))).alias("segment_end"),
        )
    )
    status = (
        F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, TOO_FEW)
        .when(F.col("n_before") == 0, NONE_BEFORE_END)
        .when(F.col("n_hours") < 2, TOO_SHORT)
        .when(F.col("segment_end").isNull(), NO_STREAK)
        .otherwise(FOUND)
    )
    return (
        markets.select("market_id")
        .join(found, "market_id", "left")
        .withColumn("status", status)
        .withColumn("segment_end", F.when(F.col("status") == FOUND, F.col("segment_end")))
        .withColumn("segment_start", F.col("segment_end") - int(segment_hours * HOUR))
        .select("market_id", "segment_start", "segment_end", "status")
    )


def prints_in_segment(
    prints: DataFrame, segments: DataFrame, max_markets: int | None = None, bin_seconds: int = HOUR
) -> DataFrame:
    """Prints inside [segment_start, segment_end], with seconds to both bounds.

    ``segments`` has one row per market with ``token_id``; markets without bounds drop out. Each
    segment is unfolded over the time bins it touches, and joined on token and bin: a token with a
    third of all prints, or with many segments, is spread over its bins, and only prints of a bin's
    own length of time are compared with a segment. A print is in one bin, so no pair meets twice.
    """
    bins = F.sequence(_bin(F.col("segment_start"), bin_seconds), _bin(F.col("segment_end"), bin_seconds))
    bounded = segments.where(F.col("segment_end") >= F.col("segment_start")).select(
        "market_id", "token_id", "segment_start", "segment_end", F.explode(bins).alias("_bin")
    )
    binned = prints.withColumn("_bin", _bin(F.col("t"), bin_seconds))
    inside = join_small(binned, bounded, ["token_id", "_bin"], "inner", max_markets).where(
        F.col("t").between(F.col("segment_start"), F.col("segment_end"))
    ).drop("_bin")
    return inside.withColumn(
        "seconds_since_window_start", (F.col("t") - F.col("segment_start")).cast("double")
    ).withColumn("seconds_until_window_end", (F.col("segment_end") - F.col("t")).cast("double"))


def _bin(t: Column, seconds: int) -> Column:
    return F.floor(t / F.lit(seconds)).cast("long")


def segment_note(status: Column, has_prints: Column) -> Column:
    """Why a market has no segment rows; blank where it has."""
    return (
        F.when(status != FOUND, status)
        .when(~has_prints, F.lit("no_1m_points_in_segment"))
        .otherwise(F.lit(""))
    )
