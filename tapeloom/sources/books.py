"""Order-book snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.books import book_side, book_summary
from tapeloom.operators.once import with_evaluated
from tapeloom.operators.ranking import top_n_per_group
from tapeloom.schemas import BOOK

# Fixed value: levels per side that enter the depth.
TOP_LEVELS = 5


def read_books(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BOOK).json(path)


def read_token_books(spark: SparkSession, path: str) -> DataFrame:
    """Landed books that name their token, as the jobs read them."""
    return spark.read.schema(T.StructType([T.StructField("token_id", T.StringType()), *BOOK.fields])).json(path)


def parse_books(payloads: DataFrame, column: str, keep: list[str]) -> DataFrame:
    parsed = with_evaluated(payloads.select(*keep, column), {"b": F.from_json(F.col(column), BOOK)})
    return parsed.select(*keep, "b.*")


def summarize_books(books: DataFrame, top_n: int = TOP_LEVELS) -> DataFrame:
    """Best prices, spread, mid, depth and imbalance; a narrow step, no shuffle."""
    keep = [c for c in books.columns if c not in ("bids", "asks", "timestamp")]
    sides = with_evaluated(
        books, {"_bid": book_side(F.col("bids"), top_n), "_ask": book_side(F.col("asks"), top_n)}
    )
    summary = book_summary(F.col("_bid"), F.col("_ask"))
    return sides.select(
        *keep,
        *[c.alias(name) for name, c in summary.items()],
        F.coalesce(F.col("timestamp"), F.lit("")).alias("ob_timestamp_ms"),
    )


def stamp_number(stamp: Column) -> Column:
    """The number in a timestamp; null where it is unreadable."""
    return stamp.try_cast("decimal(38,0)")


def latest_books(books: DataFrame) -> DataFrame:
    """One snapshot per token: the one of the highest number in its timestamp.

    Unreadable timestamps come last; of equal ones the greatest text, then the greatest sides, so that
    the choice repeats.
    """
    order = [stamp_number(F.col("timestamp")).alias("_number"), "timestamp", "bids", "asks"]
    latest = books.groupBy("token_id").agg(F.max(F.struct(*order)).alias("_b"))
    return latest.select("token_id", "_b.bids", "_b.asks", "_b.timestamp")


def books_from_levels(levels: DataFrame, order: list[str], top_n: int = TOP_LEVELS) -> DataFrame:
    """The latest snapshot of each token with ``bids``/``asks`` arrays from one row per level.

    A snapshot is a token's levels of one ``timestamp``, the latest by number; unreadable stamps
    count only where a token has no other. Only the first
    ``top_n`` levels of a side are ever collected, so an array is bounded however many levels a
    token has; summarise such books with the same ``top_n``, or with :func:`summarize_levels`.
    """
    number = stamp_number(F.col("timestamp"))
    latest = levels.groupBy("token_id").agg(F.max(number).alias("_latest"))
    current = levels.join(latest, "token_id").where(number.eqNullSafe(F.col("_latest")))
    first = top_n_per_group(
        current.drop("_latest"), ["token_id", "side"], [F.col(c) for c in order], top_n, "level", order
    )
    level = F.struct(
        "level", F.col("price").cast("string").alias("price"), F.col("size").cast("string").alias("size")
    )
    array = "array<struct<price:string,size:string>>"

    def side(name: str):
        ranked = F.array_sort(F.collect_list(F.when(F.col("side") == name, level)))
        plain = F.transform(
            ranked, lambda x: F.struct(x["price"].alias("price"), x["size"].alias("size"))
        )
        return plain.cast(array)

    return first.groupBy("token_id").agg(
        side("bid").alias("bids"),
        side("ask").alias("asks"),
        F.max(number).cast("string").alias("timestamp"),
    )


def summarize_levels(levels: DataFrame, order: list[str], top_n: int = TOP_LEVELS) -> DataFrame:
    """Summary of each token's latest snapshot, with one depth for collecting and summing."""
    return summarize_books(books_from_levels(levels, order, top_n), top_n)
