"""Scaling by the mean and population deviation of whole columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.lenient import finite_or_zero


def scaled(value: Column, mean: Column, deviation: Column) -> Column:
    """(value - mean) / deviation; a column without spread becomes 0."""
    return F.when(deviation > 0, F.try_divide(value - mean, deviation)).otherwise(F.lit(0.0))


def spread(value: Column) -> Column:
    """Population deviation as an aggregate, exactly 0 where all values are equal."""
    return F.when(F.max(value) > F.min(value), F.stddev_pop(value)).otherwise(F.lit(0.0))


def zscore(df: DataFrame, columns: list[str]) -> DataFrame:
    """Z-scores with missing and infinite values as 0; unchanged below two rows.

    All statistics come from one aggregate and reach the rows as one scalar subquery, so the
    table is read twice and never shuffled or joined.
    """
    clean = {c: finite_or_zero(F.col(c)) for c in columns}
    stats = df.agg(
        F.struct(
            F.count(F.lit(1)).alias("n"),
            *[F.avg(v).alias(f"m_{c}") for c, v in clean.items()],
            *[spread(v).alias(f"s_{c}") for c, v in clean.items()],
        ).alias("stats")
    )
    own = df.columns
    with_stats = df.withColumn("_stats", stats.scalar())

    def result(c: str) -> Column:
        if c not in clean:
            return F.col(c)
        s = F.col("_stats")
        z = scaled(clean[c], s[f"m_{c}"], s[f"s_{c}"])
        return F.when(s["n"] >= 2, z).otherwise(F.col(c).cast("double")).alias(c)

    return with_stats.select(*[result(c) for c in own])
