"""Sequence operators on per-step rows.

All windows here run on rows already reduced to one per (key, step): their size follows the
calendar span divided by the step, not the number of prints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.timegrid import ceil_to, floor_to


def along(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def difference(value: Column, window: WindowSpec) -> Column:
    return value - F.lag(value).over(window)


def difference_or_zero(value: Column, window: WindowSpec) -> Column:
    return F.coalesce(difference(value, window), F.lit(0.0))


def fill_both_ways(value: Column, window: WindowSpec, default: float | None = None) -> Column:
    """Last known value, else the next known one, else ``default``."""
    before = F.last(value, ignorenulls=True).over(
        window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    after = F.first(value, ignorenulls=True).over(
        window.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    known = [before, after] if default is None else [before, after, F.lit(default)]
    return F.coalesce(*known)


def rolling_deviation(value: Column, window: WindowSpec, rows: int = 24) -> Column:
    """Sample deviation over the last ``rows`` rows; NULL for a single observation."""
    return F.stddev_samp(value).over(window.rowsBetween(-(rows - 1), Window.currentRow))


def hold_forward(prints: DataFrame, keys: list[str], step: int) -> DataFrame:
    """Last print of each bucket, carried over empty buckets from first to last bucket.

    A lead over the bucket rows gives the length of each run, so no spine and no join are needed.
    """
    last_in_bucket = (
        prints.where(F.col("price").isNotNull())
        .groupBy(*keys, floor_to(F.col("t"), step).alias("unix_ts"))
        .agg(F.max_by("price", "t").alias("price_yes"))
    )
    upcoming = F.lead("unix_ts").over(along(keys, "unix_ts"))
    runs = last_in_bucket.withColumn("_until", F.coalesce(upcoming - step, F.col("unix_ts")))
    labels = F.explode(F.sequence("unix_ts", "_until", F.lit(step).cast("bigint")))
    return runs.select(*keys, labels.alias("unix_ts"), "price_yes")


def as_of_labels(prints: DataFrame, keys: list[str], step: int, last_label: str) -> DataFrame:
    """Value at each regular label: the last print at or before it.

    Labels start at floor(first print), which has no value unless that print is on the label.
    They end at floor(last print) or ceil(last print), as ``last_label`` says.
    """
    if last_label not in ("floor", "ceil"):
        raise ValueError("last_label must be 'floor' or 'ceil'")
    # A print is first seen by the next label at or after it.
    seen = (
        prints.where(F.col("price").isNotNull())
        .groupBy(*keys, ceil_to(F.col("t"), step).alias("unix_ts"))
        .agg(
            F.max_by("price", "t").alias("price_yes"),
            F.min("t").alias("_t0"),
            F.max("t").alias("_t1"),
        )
    )
    whole = along(keys, "unix_ts").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    end = F.max("_t1").over(whole)
    bounds = seen.withColumn("_lo", floor_to(F.min("_t0").over(whole), step)).withColumn(
        "_hi", floor_to(end, step) if last_label == "floor" else ceil_to(end, step)
    )
    # The label before the first full one, when the first print lies between two labels.
    is_first = F.row_number().over(along(keys, "unix_ts")) == 1
    bounds = bounds.withColumn(
        "_from", F.when(is_first & (F.col("_lo") < F.col("unix_ts")), F.col("_lo")).otherwise(F.col("unix_ts"))
    )
    upcoming = F.lead("unix_ts").over(along(keys, "unix_ts"))
    runs = bounds.withColumn("_until", F.least(F.coalesce(upcoming - step, F.col("_hi")), F.col("_hi")))
    return (
        runs.where(F.col("_from") <= F.col("_until"))
        .withColumn("_label", F.explode(F.sequence("_from", "_until", F.lit(step).cast("bigint"))))
        .select(
            *keys,
            F.col("_label").alias("unix_ts"),
            F.when(F.col("_label") >= F.col("unix_ts"), F.col("price_yes")).alias("price_yes"),
        )
    )
