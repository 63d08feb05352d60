"""Price predicates and transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bounds a price is held to before the logit.
LOGIT_LOW, LOGIT_HIGH = 0.001, 0.999


def clip(value: Column, low: float, high: float) -> Column:
    """Hold a value to [low, high]; a missing value stays missing."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(value, F.lit(high))))


def is_valid_price(price: Column) -> Column:
    return price.isNotNull() & (price > 0) & (price < 1)


def logit(price: Column) -> Column:
    held = clip(price, LOGIT_LOW, LOGIT_HIGH)
    return F.ln(held / (1 - held))
