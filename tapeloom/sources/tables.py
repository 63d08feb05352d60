"""Published tables read back: features, metadata, raw grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.lenient import no_nan


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType, line_breaks: bool = False
) -> DataFrame:
    """CSV with a header and a declared schema; NaN cells become NULL.

    Files are split over tasks. ``line_breaks`` allows breaks inside quoted text, at the price of
    one task per file.
    """
    rows = (
        spark.read.schema(schema)
        .option("header", True)
        .option("multiLine", line_breaks)
        .option("escape", '"')
        .option("enforceSchema", False)
        .csv(path)
    )
    doubles = {f.name for f in schema if isinstance(f.dataType, T.DoubleType)}
    return rows.select(
        *[no_nan(F.col(c)).alias(c) if c in doubles else F.col(c) for c in rows.columns]
    )


def require_columns(df: DataFrame, names: set[str]) -> DataFrame:
    missing = sorted(names - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
