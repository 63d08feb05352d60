"""Costly expressions evaluated once per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_evaluated(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` with the given columns added (or replaced), each computed exactly once per row.

    The optimizer copies a plain projected expression into every later filter and projection that
    uses it, so JSON parsed once in the text would be parsed many times in the plan. A generator
    over a one-row array is not copied or moved.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
