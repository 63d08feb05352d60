"""Price histories: one row per point, whatever the payload shape."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.lenient import to_double
from tapeloom.operators.once import with_evaluated
from tapeloom.schemas import BATCH_HISTORY, BATCH_ITEM, BATCH_KEYS, CLEAN_HISTORY, HISTORY, POINT


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Landed payloads, one JSON object per line, with ``history`` as an array of points."""
    return spark.read.schema(HISTORY).json(path)


def landed_points(spark: SparkSession, path: str) -> DataFrame:
    """The points the jobs read: token_id, resolution, extract_ord, t, price.

    Payloads lie in folders ``resolution=...``, one JSON object per line with the token, the number
    of its extract, and ``history`` as an array of points; unreadable points are left out.
    """
    fields = [
        T.StructField("token_id", T.StringType()),
        T.StructField("extract_ord", T.LongType()),
        *HISTORY.fields,
        T.StructField("resolution", T.StringType()),
    ]
    rows = spark.read.schema(T.StructType(fields)).json(path)
    keep = ["token_id", "resolution", "extract_ord"]
    points = rows.select(*keep, F.inline(_points(_parsed(F.col("history")))))
    return points.select(*keep, "t", "price")


def _parsed(texts: Column) -> Column:
    return F.transform(texts, lambda text: F.from_json(text, POINT))


def _points(parsed: Column) -> Column:
    """(position, t, price) of every element that is a readable point."""
    typed = F.transform(
        parsed,
        lambda point, i: F.struct(
            i.alias("position"),
            to_double(point["t"]).try_cast("bigint").alias("t"),
            to_double(point["p"]).alias("price"),
        ),
    )
    return F.filter(typed, lambda point: point["t"].isNotNull() & point["price"].isNotNull())


def history_points(payloads: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Points of ``{"history": [{t, p}]}`` text; malformed payloads and points yield no rows."""
    whole = F.from_json(F.col(column), CLEAN_HISTORY)["history"]
    # An element of another shape voids the whole array: only then is it read element by element.
    by_element = _parsed(F.from_json(F.col(column), HISTORY)["history"])
    return payloads.select(*keep, F.inline(_points(F.coalesce(whole, by_element))))


def _item_token(item: Column, text: Column) -> Column:
    """First key that is neither missing, empty text nor the number zero (the text "0" counts)."""
    numbers = F.from_json(text, ", ".join(f"{k} double" for k in BATCH_KEYS))
    usable = [(item[k] != "") & ~F.coalesce(numbers[k] == 0, F.lit(False)) for k in BATCH_KEYS]
    return F.coalesce(*[F.when(ok, item[k]) for ok, k in zip(usable, BATCH_KEYS)])


def batch_points(payloads: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """Points per token from a batch payload: the map shape, or the array shape if that is empty.

    Both shapes become one array of (token, history), so a payload is read and exploded once.
    """
    parsed = F.from_json(F.col(column), BATCH_HISTORY)
    body = with_evaluated(payloads.select(*keep, column), {"b": parsed})
    by_map = F.transform(
        F.filter(F.map_entries(F.col("b.history")), lambda e: e["value"].isNotNull()),
        lambda e: F.struct(e["key"].alias("token_id"), e["value"].alias("history")),
    )

    def entry(text: Column) -> Column:
        item = F.from_json(text, BATCH_ITEM)
        return F.struct(_item_token(item, text).alias("token_id"), item["history"].alias("history"))

    body = with_evaluated(
        body,
        {
            "items": F.filter(
                F.transform(F.col("b.data"), entry),
                lambda d: d["token_id"].isNotNull() & d["history"].isNotNull(),
            )
        },
    )
    by_array = F.col("items")
    # The last entry of a token in one payload replaces earlier ones.
    last_of_token = F.filter(
        by_array,
        lambda d, i: ~F.exists(
            F.slice(by_array, i + 2, F.size(by_array)), lambda later: later["token_id"] == d["token_id"]
        ),
    )
    merged = F.when(F.size(by_map) > 0, by_map).otherwise(last_of_token)
    return body.select(*keep, F.inline(merged)).select(
        *keep, "token_id", F.inline(_points(_parsed(F.col("history"))))
    )
