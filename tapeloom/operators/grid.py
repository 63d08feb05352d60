"""Regular grids from irregular prints.

Prints are rows (keys..., t, price). They are reduced to one row per (key, bucket) by a hash
aggregate with map-side combine; only then does anything run per key, over at most
``lookback / step + 2`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.prices import is_valid_price
from tapeloom.functions.timegrid import ceil_second, ceil_to, floor_second, floor_to


def bucket_last(prints: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Last price per bucket; buckets without prints have no row."""
    return (
        prints.where(F.col("price").isNotNull())
        .groupBy(*keys, floor_to(F.col("t"), step).alias("unix_ts"))
        .agg(F.max_by("price", "t").alias("price_yes"))
    )


def bucket_stats(prints: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Last price, print count, price range and population deviation (from two prints on)."""
    return (
        prints.where(F.col("price").isNotNull())
        .groupBy(*keys, floor_to(F.col("t"), step).alias("unix_ts"))
        .agg(
            F.max_by("price", "t").alias("price_yes"),
            F.count("price").alias("raw_prints_in_bucket"),
            (F.max("price") - F.min("price")).alias("intrabucket_price_range"),
            F.when(F.count("price") >= 2, F.stddev_pop("price")).alias("intrabucket_price_stdev"),
        )
    )


def spine(markets: DataFrame, win_start: Column, win_end: Column, step: int) -> DataFrame:
    """One row per market and step from floor(start) to ceil(end); none if the window is empty."""
    first = floor_to(floor_second(win_start), step)
    last = ceil_to(ceil_second(win_end), step)
    return (
        markets.withColumn("_first", first)
        .withColumn("_last", last)
        .where(F.col("_last") > F.col("_first"))
        .select(
            *markets.columns,
            F.posexplode(F.sequence("_first", "_last", F.lit(step).cast("bigint"))).alias(
                "_step", "unix_ts"
            ),
        )
        .withColumn("lookback_step", F.col("_step").cast("bigint"))
        .drop("_step")
    )


def spine_rows(win_start: Column, win_end: Column, step: int) -> Column:
    """How many rows :func:`spine` has for a market."""
    first = floor_to(floor_second(win_start), step)
    last = ceil_to(ceil_second(win_end), step)
    return F.when(last > first, ((last - first) / step).cast("bigint") + 1).otherwise(F.lit(0))


def fill_grid(lines: DataFrame, buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Spine with bucket values. Gaps stay NULL, nothing is carried forward."""
    grid = lines.join(buckets, [*keys, "unix_ts"], "left")
    if "raw_prints_in_bucket" in buckets.columns:
        grid = grid.withColumn(
            "raw_prints_in_bucket", F.coalesce(F.col("raw_prints_in_bucket"), F.lit(0))
        )
    return grid


def grid_axes(grid: DataFrame, start: Column, step: int) -> DataFrame:
    """Steps and hours since the market start."""
    origin = floor_to(floor_second(start), step)
    steps = (F.col("unix_ts") - origin - F.pmod(F.col("unix_ts") - origin, F.lit(step))) / step
    hours = (F.col("unix_ts") * 1_000_000 - F.unix_micros(start)) / F.lit(3.6e9)
    return grid.withColumn("normalized_step", steps.cast("bigint")).withColumn(
        "hours_since_market_start", hours
    )


def anchor_prices(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Price minus the first valid grid price of the market, on every row that has a price."""
    whole = (
        Window.partitionBy(*keys)
        .orderBy("unix_ts")
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    price = F.col("price_yes")
    anchor = F.first(F.when(is_valid_price(price), price), ignorenulls=True).over(whole)
    return grid.withColumn("price_norm_anchor", anchor).withColumn(
        "price_yes_norm", price - F.col("price_norm_anchor")
    )


def with_placeholders(markets: DataFrame, grid: DataFrame, keys: list[str], note: str) -> DataFrame:
    """Every market keeps at least one row; those without grid rows carry ``note``."""
    body = grid.withColumn("_has", F.lit(True))
    return (
        markets.join(body, keys, "left")
        .withColumn("note", F.when(F.col("_has").isNull(), F.lit(note)).otherwise(F.lit("")))
        .drop("_has")
    )
