"""Price paths as vectors: one row per market, levels followed by differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.lenient import to_double
from tapeloom.functions.prices import clip
from tapeloom.operators.components import global_rank
from tapeloom.operators.scaling import scaled, spread
from tapeloom.sources.tables import require_columns

# Fewest points of a usable path, price of an empty path, bound of scaled inputs.
MIN_POINTS, EMPTY_PRICE, SCALED_BOUND = 8, 0.5, 6.0


def step_column(df: DataFrame, explicit: str | None = None) -> str:
    """The sequence axis: the one asked for, else the first known one."""
    names = [explicit] if explicit else ["lookback_step", "normalized_step"]
    for name in names:
        if name in df.columns:
            return name
    raise ValueError(f"no step column among {names}")


def dedupe_steps(raw: DataFrame, step: str, order: list[str]) -> DataFrame:
    """One row per (market, step), the last one by ``order``; its price may be missing.

    ``order`` is explicit because a distributed table has no file order: the time, then the
    category position, so the last category wins. Rows without a market or a readable step go.
    """
    require_columns(raw, {"market_id", "classifier_label", "tag_slug", "price_yes", step, *order})
    last = F.struct(
        *order,
        to_double(F.col("price_yes")).alias("price_yes"),
        F.coalesce(F.col("classifier_label").cast("string"), F.lit("Unknown")).alias("classifier_label"),
    )
    return (
        raw.withColumn("_step", to_double(F.col(step)).cast("bigint"))
        .where(F.col("market_id").isNotNull() & F.col("_step").isNotNull())
        .groupBy(F.col("market_id").cast("string").alias("market_id"), F.col("_step").alias("step"))
        .agg(F.max(last).alias("last"))
        .select("market_id", "step", "last.*")
    )


def market_labels(raw: DataFrame, step: str, order: list[str]) -> DataFrame:
    """Label, slug and question of each market, from its last row of the last step.

    One row per market and task is shuffled; the texts never travel with every step.
    """
    question = F.col("question") if "question" in raw.columns else F.lit("")
    facts = F.struct(
        to_double(F.col(step)).cast("bigint").alias("_step"),
        *order,
        to_double(F.col("price_yes")).alias("price_yes"),
        F.coalesce(F.col("classifier_label").cast("string"), F.lit("Unknown")).alias("classifier_label"),
        F.coalesce(F.col("tag_slug").cast("string"), F.lit("")).alias("tag_slug"),
        F.coalesce(question.cast("string"), F.lit("")).alias("question"),
    )
    return (
        raw.where(F.col("market_id").isNotNull() & to_double(F.col(step)).cast("bigint").isNotNull())
        .groupBy(F.col("market_id").cast("string").alias("market_id"))
        .agg(F.max(facts).alias("f"))
        .select("market_id", "f.classifier_label", "f.tag_slug", "f.question")
    )


def enough_points(steps: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """Markets with at least ``min_points`` prices, counted before any fill."""
    return (
        steps.groupBy("market_id")
        .agg(F.count("price_yes").alias("n_points"))
        .where(F.col("n_points") >= min_points)
    )


def market_paths(steps: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(market_id, steps, levels, diffs): one row per market, over the union of all steps.

    The steps of dropped markets count too. The distinct steps form one array, bounded by the grid
    length, that reaches the rows as a scalar subquery. A market's own steps are gathered by the one
    shuffle there is; prices are put in their places and carried on and back inside arrays.
    """
    all_steps = steps.agg(F.sort_array(F.collect_set("step")).alias("s"))
    priced = steps.where(F.col("price_yes").isNotNull())
    own = F.collect_list(F.struct("step", "price_yes"))
    kept = priced.groupBy("market_id").agg(own.alias("own")) if min_points > 0 else (
        steps.groupBy("market_id").agg(F.filter(own, lambda p: p["price_yes"].isNotNull()).alias("own"))
    )
    kept = kept.where(F.size("own") >= min_points).withColumn("steps", all_steps.scalar())

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            axis = batch.column("steps")[0].values.to_numpy()
            levels = _filled(batch.column("own"), axis)
            diffs = np.diff(levels, axis=1, prepend=levels[:, :1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("market_id"), batch.column("steps"), _lists(levels), _lists(diffs)],
                names=["market_id", "steps", "levels", "diffs"],
            )

    return kept.select("market_id", "steps", "own").mapInArrow(
        fill, "market_id string, steps array<bigint>, levels array<double>, diffs array<double>"
    )


def _filled(own: pa.ListArray, axis: np.ndarray) -> np.ndarray:
    """(markets x steps): each market's prices at their steps, carried on, then back."""
    points = own.flatten()
    row = np.repeat(np.arange(len(own)), pc.list_value_length(own).to_numpy())
    place = np.searchsorted(axis, points.field("step").to_numpy())
    out = np.full((len(own), len(axis)), np.nan)
    out[row, place] = points.field("price_yes").to_numpy()
    known = ~np.isnan(out)
    here = np.arange(len(axis))
    last = np.maximum.accumulate(np.where(known, here, -1), axis=1)
    following = np.minimum.accumulate(np.where(known, here, len(axis))[:, ::-1], axis=1)[:, ::-1]
    source = np.where(last >= 0, last, following)
    empty = source == len(axis)
    filled = np.take_along_axis(out, np.where(empty, 0, source), axis=1)
    return np.where(empty, EMPTY_PRICE, filled)


def _lists(values: np.ndarray) -> pa.ListArray:
    bounds = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.ascontiguousarray(values).ravel()))


def filled_paths(steps: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(market_id, position, step, level, diff): :func:`market_paths`, one row per step."""
    points = F.arrays_zip("steps", "levels", "diffs")
    rows = market_paths(steps, min_points).select("market_id", F.posexplode(points).alias("position", "p"))
    return rows.select(
        "market_id", "position", F.col("p.steps").alias("step"), F.col("p.levels").alias("level"),
        F.col("p.diffs").alias("diff"),
    )


def path_vectors(steps: DataFrame, min_points: int = MIN_POINTS) -> DataFrame:
    """(market_id, x): one array per market, all levels in step order, then all differences."""
    return market_paths(steps, min_points).select("market_id", F.concat("levels", "diffs").alias("x"))


def scale_vectors(vectors: DataFrame, bound: float = SCALED_BOUND) -> DataFrame:
    """Vectors z-scored per slot and clipped.

    The statistics are combined per task, end up as one array as long as a vector, and reach the
    rows as a scalar subquery: the vectors themselves are not shuffled.
    """
    per_slot = (
        vectors.select(F.posexplode("x").alias("slot", "value"))
        .groupBy("slot")
        .agg(F.avg("value").alias("mean"), spread(F.col("value")).alias("sd"))
    )
    stats = per_slot.agg(F.array_sort(F.collect_list(F.struct("slot", "mean", "sd"))).alias("s"))
    fitted = F.zip_with(
        "x", "_stats", lambda v, s: clip(scaled(v, s["mean"], s["sd"]), -bound, bound)
    )
    return vectors.withColumn("_stats", stats.scalar()).withColumn("x", fitted).drop("_stats")


def label_index(labels: DataFrame, column: str = "classifier_label") -> DataFrame:
    """(label_class_index, label_class): sorted distinct labels numbered from 0, however many."""
    names = labels.select(F.col(column).alias("label_class")).where("label_class IS NOT NULL").distinct()
    ranked = global_rank(names, [F.col("label_class").asc()], "label_class_index")
    return ranked.select(F.col("label_class_index").cast("int"), "label_class")


def one_hot(index: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: (i == index).cast("double"))
