"""Features of a closed market from the hours before its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.prices import logit
from tapeloom.functions.timegrid import HOUR, ceil_to, floor_to
from tapeloom.operators.series import along, fill_both_ways, rolling_deviation
from tapeloom.session import join_small

# Analysed hours before the end, extra hours read before them, rolling rows.
CORE_HOURS, LEAD_HOURS, ROLLING_ROWS = 48, 24, 24
# Fixed value: hours a market of unknown start is taken to have been open.
UNKNOWN_LIFETIME = 24.0
# Smallest price span and lifetime used as divisors or results.
MIN_SPAN, MIN_LIFETIME = 1e-6, 1e-6


def closed_features(
    prints: DataFrame,
    markets: DataFrame,
    anchor: str = "end",
    max_markets: int | None = None,
) -> DataFrame:
    """One row per market that can be described; others are absent.

    ``prints`` has (market_id, t, price), one price per second; ``markets`` one row per market
    with ``start_ts``, ``end_ts`` and ``volume_num``. With ``anchor='end'`` hourly points sit at
    the end time and whole hours before it, and as hourly labels are whole hours, a market that
    ends between two hours has no features. ``anchor='floor_hour'`` moves such ends to the hour.
    """
    if anchor not in ("end", "floor_hour"):
        raise ValueError("anchor must be 'end' or 'floor_hour'")
    end = F.unix_seconds("end_ts")
    top = end if anchor == "end" else floor_to(end, HOUR)
    facts = markets.select(
        "market_id",
        "volume_num",
        F.coalesce(
            F.abs(F.unix_micros("end_ts") - F.unix_micros("start_ts")) / F.lit(3.6e9),
            F.lit(UNKNOWN_LIFETIME),
        ).alias("_life"),
        top.alias("_top"),
        end.alias("_end"),
        F.pmod(F.unix_micros("end_ts"), F.lit(HOUR * 1_000_000)).alias("_off"),
    )
    if anchor == "end":
        facts = facts.where("_off = 0")
    facts = facts.drop("_off")
    span = (CORE_HOURS + LEAD_HOURS) * HOUR
    # Each print is first seen by the next whole hour; everything older than the analysed hours
    # collapses into the first of them. At most 73 rows per market leave this aggregate.
    joined = join_small(
        prints.where(F.col("price").isNotNull()),
        facts.select("market_id", "_top", "_end"),
        ["market_id"], "inner", max_markets,
    ).where(F.col("t") <= F.col("_end"))
    slot = F.greatest(ceil_to(F.col("t"), HOUR), F.col("_top") - span)
    seen = (
        joined.groupBy("market_id", "_top", slot.alias("unix_ts"))
        .agg(F.max_by("price", "t").alias("price"), F.max("t").alias("_t1"))
    )
    whole = along(["market_id"], "unix_ts").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    # Labels stop at the whole hour before the last print; later prints are not seen.
    known = (
        seen.withColumn("_hi", floor_to(F.max("_t1").over(whole), HOUR))
        .where(F.col("unix_ts") <= F.col("_hi"))
        .select("market_id", "unix_ts", "price")
    )
    hours = facts.select(
        "market_id", "_top",
        F.explode(F.sequence(F.col("_top") - span, F.col("_top"), F.lit(HOUR).cast("bigint"))).alias("unix_ts"),
    )
    line = along(["market_id"], "unix_ts")
    filled = (
        hours.join(known, ["market_id", "unix_ts"], "left")
        .withColumn("price", fill_both_ways(F.col("price"), line))
        .where(F.col("price").isNotNull())
        .withColumn("level", logit(F.col("price")))
        .withColumn("back", ((F.col("_top") - F.col("unix_ts")) / HOUR).cast("int"))
    )
    # The rolling window starts afresh inside the core hours.
    core = F.col("back") <= CORE_HOURS
    in_core = F.when(core, F.col("level"))
    rolled = filled.withColumn("roll", F.when(core, rolling_deviation(in_core, line, ROLLING_ROWS)))
    per_market = rolled.groupBy("market_id").agg(
        *[
            F.max(F.when(F.col("back") == b, F.col("level"))).alias(f"l{b}")
            for b in (0, 1, 6, 24)
        ],
        F.avg("roll").alias("volatility_24h"),
        F.max(F.when(core, F.col("price"))).alias("hi"),
        F.min(F.when(core, F.col("price"))).alias("lo"),
    )
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(MIN_SPAN))
    return per_market.join(facts, "market_id").select(
        "market_id",
        (F.col("l0") - F.col("l1")).alias("momentum_1h"),
        (F.col("l0") - F.col("l6")).alias("momentum_6h"),
        (F.col("l0") - F.col("l24")).alias("momentum_24h"),
        "volatility_24h",
        (F.col("volume_num") / width).alias("efficiency_ratio"),
        F.greatest(F.col("_life"), F.lit(MIN_LIFETIME)).alias("ripeness_hours"),
    )
