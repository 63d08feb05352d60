"""Keeping, dropping and describing rows by category or id."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.lenient import strip


def parse_categories(text: str | None) -> set[str] | None:
    """Lower-cased names from a ``,`` or ``;`` list; None means all."""
    names = {part.strip().lower() for part in re.split("[,;]", text or "")} - {""}
    return names or None


def _is_kept(allowed: set[str]) -> Column:
    label = F.lower(strip(F.coalesce(F.col("classifier_label"), F.lit(""))))
    return label.isin(*sorted(allowed))


def split_by_category(df: DataFrame, allowed: set[str] | None) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): two filters over the same input."""
    if allowed is None:
        return df, df.limit(0)
    return df.where(_is_kept(allowed)), df.where(~_is_kept(allowed))


def category_labels(df: DataFrame) -> DataFrame:
    """Distinct labels, sorted."""
    return df.select(F.col("classifier_label").cast("string")).distinct().orderBy("classifier_label")


def exclude_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose market is not listed. Spark broadcasts the list if its measured size allows."""
    return df.join(ids.select("market_id").distinct(), "market_id", "left_anti")


def excluded_count(df: DataFrame, ids: DataFrame) -> DataFrame:
    """One row: how many rows the list takes out."""
    hit = df.join(ids.select("market_id").distinct(), "market_id", "left_semi")
    return hit.agg(F.count(F.lit(1)).alias("n_excluded"))


def with_question(df: DataFrame, metadata: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``question`` by market: the first metadata row's, "" if there is none.

    Metadata has one row per market and category, so a market has few rows.
    """
    first = Window.partitionBy("market_id").orderBy(*order)
    lookup = (
        metadata.select("market_id", "question", *order)
        .withColumn("_n", F.row_number().over(first))
        .where("_n = 1")
        .select("market_id", "question")
    )
    return (
        df.drop("question")
        .join(lookup, "market_id", "left")
        .withColumn("question", F.coalesce(F.col("question"), F.lit("")))
    )
