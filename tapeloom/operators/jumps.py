"""Change and jump features of each series on its grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.lenient import safe_ratio
from tapeloom.functions.prices import is_valid_price
from tapeloom.operators.series import along, difference

# Below this a deviation or a total move counts as none.
TINY = 1e-12


def price_changes(grid: DataFrame, keys: list[str]) -> DataFrame:
    """Valid grid rows with the change from the previous valid row; gaps are skipped over.

    ``grid`` needs ``price_yes``; ``price_yes_norm`` is used when present.
    """
    level = "price_yes_norm" if "price_yes_norm" in grid.columns else "price_yes"
    valid = grid.where(is_valid_price(F.col("price_yes")))
    return valid.withColumn("change", difference(F.col(level), along(keys, "unix_ts")))


def ranked_changes(grid: DataFrame, keys: list[str], quantiles: dict[str, float]) -> DataFrame:
    """The valid rows of each key as ``_size`` (of the change) and ``_rank`` (1 is the largest change).

    ``_sd`` and one column per quantile, linear between the two nearest sizes, repeat per row. Rows
    are sorted by size inside the partitions that the changes have anyway, and windows over that
    order spill, so a key's changes are never held as one value, however many they are.
    """
    sizes = price_changes(grid, keys).select(*keys, "change", F.abs("change").alias("_size"))
    by_size = Window.partitionBy(*keys).orderBy(F.col("_size").desc_nulls_last())
    all_sizes = by_size.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = sizes.withColumns(
        {
            "_rank": F.row_number().over(by_size),
            "_n": F.count("_size").over(all_sizes),
            "_sd": F.stddev_pop("change").over(all_sizes),
        }
    )
    below = F.col("_n") - F.col("_rank")  # how many sizes come before this one, smallest first

    def quantile(q: float) -> Column:
        place = F.lit(q) * (F.col("_n") - 1)
        low = F.max(F.when(below == F.floor(place), F.col("_size"))).over(all_sizes)
        high = F.max(F.when(below == F.ceil(place), F.col("_size"))).over(all_sizes)
        between = (F.ceil(place) - place) * low + (place - F.floor(place)) * high
        return F.when(low == high, low).otherwise(between)

    return ranked.withColumns({name: quantile(q) for name, q in quantiles.items()})


def jump_features(grid: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with at least one valid price; all features NULL below two valid prices.

    One shuffle by key; quantiles are exact, and what a task holds does not grow with a key's rows.
    """
    size, sd = F.col("_size"), F.col("_sd")
    moving = sd > TINY

    def beyond(sigmas: float) -> Column:
        return F.count_if(moving & (F.try_divide(size, sd) >= sigmas)).cast("double")

    per_key = (
        ranked_changes(grid, keys, {"_p95": 0.95, "_p99": 0.99})
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_valid"),
            F.count(size).cast("double").alias("n"),
            F.max(sd).alias("sd"),
            F.max(size).alias("top"),
            F.sum(size).alias("total"),
            F.coalesce(F.sum(F.when(F.col("_rank") <= 3, size)), F.lit(0.0)).alias("top3"),
            beyond(2.0).alias("z2"),
            beyond(3.0).alias("z3"),
            F.count_if(size >= F.col("_p95")).cast("double").alias("h95"),
            F.count_if(size >= F.col("_p99")).cast("double").alias("h99"),
        )
    )
    values = {
        "feat_jump_zcount_ge_2": F.col("z2"),
        "feat_jump_zrate_ge_2": F.try_divide("z2", "n"),
        "feat_jump_zcount_ge_3": F.col("z3"),
        "feat_jump_zrate_ge_3": F.try_divide("z3", "n"),
        "feat_jump_count_ge_p95": F.col("h95"),
        "feat_jump_rate_ge_p95": F.try_divide("h95", "n"),
        "feat_jump_count_ge_p99": F.col("h99"),
        "feat_jump_rate_ge_p99": F.try_divide("h99", "n"),
        "feat_jump_max_abs": F.col("top"),
        "feat_jump_top3_sum_abs": F.col("top3"),
        "feat_jump_top3_frac_total_move": safe_ratio(F.col("top3"), F.col("total"), TINY),
        "feat_return_volatility": F.col("sd"),
    }
    enough = F.col("n_valid") >= 2
    return per_key.select(
        *keys, "n_valid", *[F.when(enough, v).alias(k) for k, v in values.items()]
    )


def prints_per_hour(count: Column, lookback_hours: float) -> Column:
    return count / F.lit(max(float(lookback_hours), 1e-9))
