"""JSON held in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TEXT_ARRAY = "array<string>"


def text_array(text: Column) -> Column:
    """Array of text from JSON, also when the JSON was encoded twice; NULL if it is neither."""
    inner = F.get_json_object(text, "$")
    return F.coalesce(F.from_json(text, TEXT_ARRAY), F.from_json(inner, TEXT_ARRAY))


def first_item(text: Column) -> Column:
    item = F.get(text_array(text), 0)
    return F.when(item != "", item)
