"""Top-N per group that holds when one group has most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n_per_group(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    n: int,
    rank: str,
    spread_by: list[str],
    slices_of: int | None = None,
) -> DataFrame:
    """The first ``n`` rows of each group, with their position from 1 in ``rank``.

    Ranked twice: first inside slices of a group (as many as the session has shuffle partitions),
    then among the at most slices x ``n`` survivors. The result is exact because a row in the top
    ``n`` of its group is in the top ``n`` of its slice. ``order`` must be total for a repeatable
    result.
    """
    salts = slices_of or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = df.withColumn("_slice", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))
    local = Window.partitionBy(*group, "_slice").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    survivors = slices.withColumn(rank, F.row_number().over(local)).where(F.col(rank) <= n)
    return (
        survivors.drop(rank, "_slice")
        .withColumn(rank, F.row_number().over(whole))
        .where(F.col(rank) <= n)
    )


def hash_sample(df: DataFrame, id_column: str, n: int, ties: list[str] | None = None) -> DataFrame:
    """At most ``n`` rows, the same ones on every run: smallest md5 of the id first, then ``ties``.

    Plans as a top-N per task and one merge of at most ``n`` rows per task.
    """
    draw = F.md5(F.col(id_column).cast("string"))
    return df.withColumn("_draw", draw).orderBy("_draw", id_column, *(ties or [])).limit(n).drop("_draw")
