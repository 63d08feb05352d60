"""Id lists in text: ``#`` starts a comment, commas and blanks separate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_ids(lines: DataFrame, column: str = "value") -> DataFrame:
    """Distinct ids, one per row, as ``market_id``."""
    body = F.regexp_replace(F.col(column), "#.*", "")
    return (
        lines.select(F.explode(F.split(body, r"[,\s]+")).alias("market_id"))
        .where(F.col("market_id") != "")
        .distinct()
    )


def read_ids(spark: SparkSession, path: str | None, inline: str | None = None) -> DataFrame:
    """Ids of a text file joined with ids given directly."""
    given = spark.createDataFrame([(inline or "",)], "value string")
    body = F.split(F.col("value"), r"[,\s]+")
    ids = given.select(F.explode(body).alias("market_id")).where(F.col("market_id") != "")
    if path is not None:
        ids = ids.unionByName(parse_ids(spark.read.text(path)))
    return ids.distinct()
