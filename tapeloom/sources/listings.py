"""Market listings: flat rows, or events with nested markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.lenient import blank_to_null, strip, to_timestamp
from tapeloom.operators.once import with_evaluated
from tapeloom.schemas import EVENT, MARKET


def read_markets(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MARKET).json(path)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)


def landed_markets(spark: SparkSession, path: str, categories: DataFrame) -> DataFrame:
    """The listing the jobs read, from folders ``tag_id=...`` of market payloads.

    ``categories`` is the dimension (tag_id, and the columns that name a category); listings of
    tags outside it are left out.
    """
    rows = spark.read.schema(T.StructType([*MARKET.fields, T.StructField("tag_id", T.StringType())])).json(path)
    return rows.join(categories, "tag_id")


def landed_events(spark: SparkSession, path: str) -> DataFrame:
    """Events with event_id, end_ts, title, series_id and nested markets, from landed payloads."""
    schema = T.StructType([*EVENT.fields, T.StructField("id", T.StringType()), T.StructField("endDate", T.StringType())])
    rows = spark.read.schema(schema).json(path)
    return rows.select(
        F.col("id").alias("event_id"), to_timestamp(F.col("endDate")).alias("end_ts"),
        "title", "series_id", "markets",
    )


def parse_events(payloads: DataFrame, column: str) -> DataFrame:
    """Event rows from JSON text, beside the other columns."""
    parsed = with_evaluated(payloads, {"e": F.from_json(F.col(column), EVENT)})
    return parsed.select(*[c for c in payloads.columns if c != column], "e.*")


def active_markets(listing: DataFrame, tag_id: str | None = None) -> DataFrame:
    """Open, active listings, of one tag if given; plain predicates that reach the scan."""
    rows = listing.where(~F.col("closed") & F.col("active"))
    return rows if tag_id is None else rows.where(F.col("tag_id") == tag_id)


def closed_markets(listing: DataFrame, tag_id: str | None = None) -> DataFrame:
    rows = listing.where("closed")
    return rows if tag_id is None else rows.where(F.col("tag_id") == tag_id)


def event_markets(events: DataFrame) -> DataFrame:
    """One row per nested market; the event title stands in for a blank question."""
    keep = [c for c in events.columns if c != "markets"]
    own = [n for n in MARKET.names if n != "question"]
    question = F.coalesce(blank_to_null(F.col("market.question")), strip(F.col("title")))
    return (
        events.select(*keep, F.posexplode("markets").alias("position", "market"))
        .where(F.col("market").isNotNull())
        .select(*keep, "position", question.alias("question"), *[f"market.{n}" for n in own])
    )
