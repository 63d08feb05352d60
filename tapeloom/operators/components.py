"""Principal components of a feature table and the report tables built from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.lenient import finite_or_zero
from tapeloom.schemas import IDENTITY
from tapeloom.session import staged

# Most components, and how many the reports show.
COMPONENT_CAP, SHOWN_SCORES, SHOWN_FEATURES = 20, 8, 8
TINY = 1e-12
# Triangles that reach the driver at most.
LAST_MERGE = 32


def numeric_columns(df: DataFrame) -> list[str]:
    """Numeric and boolean columns except ids and labels, else everything after ``tag_slug``."""
    numeric = [
        f.name
        for f in df.schema
        if f.name not in IDENTITY and isinstance(f.dataType, (T.NumericType, T.BooleanType))
    ]
    return numeric or columns_after(df, "tag_slug")


def columns_after(df: DataFrame, name: str) -> list[str]:
    if name not in df.columns:
        raise ValueError(f"expected column {name!r}")
    rest = df.columns[df.columns.index(name) + 1 :]
    if not rest:
        raise ValueError(f"no columns after {name!r}")
    return rest


def component_count(n_rows: int, n_columns: int, cap: int = COMPONENT_CAP) -> int:
    return max(1, min(n_rows, n_columns, max(1, cap)))


@dataclass(frozen=True)
class Components:
    """A fitted rotation; every field is of the size of the column list, not of the data."""

    spark: SparkSession
    columns: list[str]
    centre: np.ndarray
    loadings: np.ndarray  # components x columns
    variance_ratio: list[float]

    def scores(self, df: DataFrame) -> DataFrame:
        """``df`` with one column PC1..PCk per component; PC2 is 0 if there is only one."""
        centre, rotation, shown = self.centre, self.loadings.T, len(self.loadings)

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def rotate(*columns: pd.Series) -> pd.Series:
            return pd.Series(list((np.column_stack(columns) - centre) @ rotation))

        rotated = df.withColumn("_rotated", rotate(*[finite_or_zero(F.col(c)) for c in self.columns]))
        out = rotated.select(
            *df.columns, *[F.get("_rotated", F.lit(i)).alias(f"PC{i + 1}") for i in range(shown)]
        )
        return out if shown > 1 else out.withColumn("PC2", F.lit(0.0))

    def scree(self) -> DataFrame:
        """Variance ratio and running total per component."""
        rows = self.spark.createDataFrame(
            [(i + 1, f"PC{i + 1}", v) for i, v in enumerate(self.variance_ratio)],
            "component int, label string, variance_ratio double",
        )
        # One row per component: the window covers at most the component cap.
        running = Window.partitionBy(F.lit(1)).orderBy("component")
        return rows.withColumn("cumulative_ratio", F.sum("variance_ratio").over(running))

    def loading_table(self) -> DataFrame:
        """One row per feature and component."""
        return self.spark.createDataFrame(
            [
                (feature, k + 1, float(self.loadings[k, j]))
                for k in range(len(self.loadings))
                for j, feature in enumerate(self.columns)
            ],
            "feature string, component int, loading double",
        )

    def top_features(self, n: int = SHOWN_FEATURES) -> DataFrame:
        """Features with the largest loading norm over all components; ties go by name."""
        norms = zip(self.columns, np.linalg.norm(self.loadings, axis=0))
        rows = self.spark.createDataFrame(
            [(feature, float(norm)) for feature, norm in norms], "feature string, loading_norm double"
        )
        return rows.orderBy(F.desc("loading_norm"), "feature").limit(n)


@dataclass(frozen=True)
class Triangle:
    """What a set of rows says about its spread: count, mean, and R of a QR of the centred rows."""

    count: int
    mean: np.ndarray
    r: np.ndarray

    @staticmethod
    def of(rows: np.ndarray) -> Triangle:
        mean = rows.mean(axis=0)
        return Triangle(len(rows), mean, np.linalg.qr(rows - mean, mode="r"))

    def merged(self, other: Triangle) -> Triangle:
        """Of both sets; one more row carries the distance of their means."""
        count = self.count + other.count
        apart = other.mean - self.mean
        between = np.sqrt(self.count * (other.count / count)) * apart
        r = np.linalg.qr(np.vstack([self.r, other.r, between]), mode="r")
        return Triangle(count, self.mean + apart * (other.count / count), r)

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict(
            {"count": [self.count], "mean": [self.mean.tolist()], "r": [self.r.ravel().tolist()]}
        )


def _triangles(batch: pa.RecordBatch) -> Iterator[Triangle]:
    for row in batch.to_pylist():
        mean = np.array(row["mean"])
        yield Triangle(row["count"], mean, np.array(row["r"]).reshape(-1, len(mean)))


def _merged(parts: Iterator[Triangle]) -> Iterator[pa.RecordBatch]:
    """One row for all parts, none for none."""
    total = None
    for part in parts:
        total = part if total is None else total.merged(part)
    if total is not None:
        yield total.batch()


def _reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _merged(
        Triangle.of(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
        for batch in batches
        if batch.num_rows
    )


def _reduce_triangles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from _merged(t for batch in batches for t in _triangles(batch))


def spread(df: DataFrame, columns: list[str]) -> Triangle | None:
    """The triangle of all rows, by a tall-skinny QR; None for no rows.

    Each task reduces its rows, batch by batch, to a triangle of columns x columns; triangles are
    merged in as many tasks as the session has shuffle partitions, then in at most ``LAST_MERGE``,
    and the driver merges those. The rows are read once and never squared, so components far
    smaller than the largest keep their digits, as they would not in a covariance matrix.
    """
    schema = "count long, mean array<double>, r array<double>"
    parts = df.select(*[finite_or_zero(F.col(c)).alias(c) for c in columns]).mapInArrow(_reduce_rows, schema)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for n in dict.fromkeys((tasks, min(tasks, LAST_MERGE))):
        parts = parts.repartition(n).mapInArrow(_reduce_triangles, schema)
    found = parts.toArrow().to_batches()
    last = next(_merged(t for batch in found for t in _triangles(batch)), None)
    return None if last is None else next(_triangles(last))


def fit_components(df: DataFrame, columns: list[str], cap: int = COMPONENT_CAP) -> Components:
    """Centre (never rescale) and rotate.

    The rotation is that of the triangle's singular vectors (:func:`spread`); only a bounded number of
    columns x columns triangles reaches the driver. Each component's largest loading is made positive, as
    the sign is arbitrary. Where nothing varies all variance ratios are 0.
    """
    whole = spread(df, columns)
    if whole is None or whole.count < 2:
        raise ValueError("principal components need at least 2 rows")
    k = component_count(whole.count, len(columns), cap)
    _, sizes, rotation = np.linalg.svd(whole.r, full_matrices=False)
    rotation, total = rotation[:k], float((sizes**2).sum())
    strongest = np.abs(rotation).argmax(axis=1)
    signs = np.where(rotation[np.arange(k), strongest] < 0, -1.0, 1.0)
    return Components(
        df.sparkSession,
        list(columns),
        whole.mean,
        rotation * signs[:, None],
        [float(v) for v in (sizes[:k] ** 2 / total if total > 0 else np.zeros(k))],
    )


def scores_by_order(scores: DataFrame, order_column: str, shown: int = SHOWN_SCORES) -> DataFrame:
    """Rows ranked by a time column, missing last, with the first components.

    The rank over all rows is built without one global window: rows are range-partitioned by the
    sort key, counted per partition, and numbered from the running count of earlier partitions.
    Ids complete the sort key, so rows with equal or missing times spread over partitions too.
    """
    kept = [c for c in scores.columns if c.startswith("PC") and c[2:].isdigit()][:shown]
    key = [F.col(order_column).asc_nulls_last(), F.col("market_id").asc(), F.col("tag_id").asc()]
    return global_rank(scores.select("market_id", "tag_id", order_column, *kept), key, "rank")


def global_rank(df: DataFrame, order: list[Column], rank: str) -> DataFrame:
    """Position of each row in a total order, from 0.

    The range partitioning is written once with its partition numbers, because its bounds come
    from a sample and a second run of the same plan could draw other bounds.
    """
    ranged = staged(
        df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged"
    )
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    # One row per partition: small whatever the table size.
    earlier = Window.partitionBy(F.lit(1)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        ranged.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(rank, F.col("_base") + F.col("_row") - 1)
        .drop("_part", "_row", "_base")
    )


def correlations(df: DataFrame, features: list[str], targets: list[str]) -> DataFrame:
    """Pearson correlation of each feature with each target; constant columns and fewer than
    three rows give none.

    One row per feature is made per input row and partially aggregated where it is made, so the
    shuffle carries one row per feature and task.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("feature"), finite_or_zero(F.col(c)).alias("x")) for c in features])
    )
    long = df.select(pairs.alias("p"), *targets).select("p.feature", "p.x", *targets)
    per_feature = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_pop("x").alias("sx"),
        *[F.stddev_pop(t).alias(f"sd_{t}") for t in targets],
        *[F.covar_pop("x", t).alias(f"cov_{t}") for t in targets],
    )
    one_row_each = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(t).alias("target"),
                    F.when(
                        (F.col("sx") > TINY) & (F.col(f"sd_{t}") > TINY) & (F.col("n") >= 3),
                        F.try_divide(F.col(f"cov_{t}"), F.col("sx") * F.col(f"sd_{t}")),
                    ).alias("correlation"),
                )
                for t in targets
            ]
        )
    )
    return (
        per_feature.select("feature", one_row_each.alias("c"))
        .select("feature", "c.target", "c.correlation")
        .where(F.col("correlation").isNotNull())
    )


def top_correlations(table: DataFrame, n: int = SHOWN_FEATURES) -> DataFrame:
    """Largest absolute correlations per target; the table has one row per feature and target."""
    place = Window.partitionBy("target").orderBy(F.abs("correlation").desc(), "feature")
    return table.withColumn("place", F.row_number().over(place)).where(F.col("place") <= n)
