"""Which markets enter a run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions import listing as L
from tapeloom.functions.jsontext import first_item, text_array
from tapeloom.functions.lenient import blank_to_null, strip, to_double, to_timestamp
from tapeloom.operators.once import with_evaluated
from tapeloom.operators.ranking import top_n_per_group

# Category dimension (label, tag id, slug), in scan order.
CATEGORIES = (
    ("Sports", "1", "sports"),
    ("Politics", "2", "politics"),
    ("Crypto", "21", "crypto"),
    ("Pop culture", "596", "pop-culture"),
    ("Tech", "1401", "tech"),
    ("Finance", "120", "finance"),
    ("Business", "107", "business"),
    ("Geopolitics", "100265", "geopolitics"),
)
# Sport dimension (label, tag id, series ids), in scan order.
SPORTS = (
    ("NBA", "745", ("10345",)),
    ("NFL", "450", ("10187",)),
    ("MLB", "100381", ("3",)),
    ("NHL", "899", ("10346",)),
    ("Soccer", "100350", ("10188", "10193", "10204", "10189", "10194")),
)
# Listing pages are whole, so a scan cap is rounded up to them.
ACTIVE_PAGE, CLOSED_PAGE, EVENT_PAGE = 100, 200, 80
# Columns that hold the scan order of candidates: newest end first, then the id.
SCAN = ("_scan_0", "_scan_1", "_scan_2")


def _whole_pages(cap: int, page: int) -> int:
    return math.ceil(cap / page) * page


def _scanned(
    rows: DataFrame, group: list[str], order: dict[str, Column], cap: int | None, page: int, key: str
) -> DataFrame:
    """``rows`` with their scan order as ``_scan_0..n``; only the first ``cap`` of a group if given.

    Without a cap no position is counted: the order columns themselves rank the rows later.
    """
    ordered = rows.withColumns(order)
    if cap is None:
        return ordered
    by = [F.col(c).asc_nulls_last() for c in order]
    return top_n_per_group(ordered, group, by, _whole_pages(cap, page), "_position", [key]).drop("_position")


def category_table(spark, rows=CATEGORIES) -> DataFrame:
    """(classifier_label, tag_id, tag_slug, category_ord); as many rows as constants given."""
    return spark.createDataFrame(
        [(*row, i) for i, row in enumerate(rows)],
        "classifier_label string, tag_id string, tag_slug string, category_ord int",
    )


def sport_table(spark, rows=SPORTS) -> DataFrame:
    """(sport, sport_ord, tag_id, series_id, series_ord), one row per series."""
    specs = spark.createDataFrame(
        [(label, i, tag, list(series)) for i, (label, tag, series) in enumerate(rows)],
        "sport string, sport_ord int, tag_id string, series array<string>",
    )
    return specs.select(
        "sport", "sport_ord", "tag_id", F.posexplode("series").alias("series_ord", "series_id")
    )


def with_yes_token(listing: DataFrame) -> DataFrame:
    """Rows with an id and a first token; adds trimmed ``market_id`` and ``token_id``."""
    parsed = {"market_id": blank_to_null(F.col("id")), "token_id": first_item(F.col("clobTokenIds"))}
    return with_evaluated(listing, parsed).where(
        F.col("market_id").isNotNull() & F.col("token_id").isNotNull()
    )


def top_markets_per_category(
    listing: DataFrame,
    per_category: int,
    min_volume: float,
    min_liquidity: float,
    max_scan: int | None = None,
) -> DataFrame:
    """First ``per_category`` acceptable markets of each tag by volume, each id once.

    All listings are looked at. ``max_scan`` restates the paging limit of a remote listing: the
    first so many listings of a tag, rounded up to whole pages and counted before any is refused.
    """
    order = {"_scan_0": -to_double(F.col("volumeNum")), "_scan_1": F.col("id")}
    by = [F.col(c).asc_nulls_last() for c in order]
    scanned = _scanned(listing, ["tag_id"], order, max_scan, ACTIVE_PAGE, "id")
    fit = with_yes_token(scanned).where(
        L.passes_prefilter(F.col("volumeNum"), F.col("liquidityNum"), min_volume, min_liquidity)
    )
    once = Window.partitionBy("tag_id", "market_id").orderBy(*by)
    first_seen = fit.withColumn("_seen", F.row_number().over(once)).where("_seen = 1").drop("_seen")
    picked = top_n_per_group(first_seen, ["tag_id"], by, per_category, "pick", ["market_id"])
    return picked.drop(*order)


def shortfall(selected: DataFrame, dimension: DataFrame, key: str, wanted: int) -> DataFrame:
    """Found and wanted per category; categories without any market count 0.

    ``dimension`` is the constant category table, so its broadcast has a fixed size.
    """
    found = selected.groupBy(key).agg(F.count(F.lit(1)).alias("found"))
    return (
        dimension.join(found, key, "left")
        .withColumn("found", F.coalesce(F.col("found"), F.lit(0)))
        .withColumn("wanted", F.lit(wanted).cast("bigint"))
        .withColumn("short", F.col("found") < F.col("wanted"))
    )


def with_outcomes(listing: DataFrame) -> DataFrame:
    """Adds the parsed arrays, the primary outcome and the resolved label."""
    arrays = with_evaluated(
        listing,
        {
            "outcome_names": text_array(F.col("outcomes")),
            "outcome_values": text_array(F.col("outcomePrices")),
            "tokens": text_array(F.col("clobTokenIds")),
        },
    )
    names, values = F.col("outcome_names"), F.col("outcome_values")
    return with_evaluated(
        arrays,
        {
            "primary_index": L.primary_index(names),
            "primary_outcome": L.primary_label(names),
            "resolved_yes": L.resolved_primary(names, values),
            "is_moneyline": L.is_moneyline(names),
        },
    )


def in_end_window(
    start: Column,
    end: Column,
    as_of: Column,
    within_days: float = 30.0,
    after: Column | None = None,
    before: Column | None = None,
) -> Column:
    """Both times known, ended before ``as_of``, and inside the optional bounds."""
    fits = start.isNotNull() & end.isNotNull() & (end < as_of)
    if within_days > 0:
        reach = F.timestamp_micros(F.unix_micros(as_of) - F.lit(int(within_days * 86_400_000_000)))
        fits = fits & (end >= reach)
    if after is not None:
        fits = fits & (end >= after)
    if before is not None:
        fits = fits & (end < before)
    return fits


def closed_candidates(
    events: DataFrame, listing: DataFrame, sports: DataFrame, max_scan: int | None = None
) -> DataFrame:
    """Nested event markets of each sport's series, then its tag listing, in scan order.

    ``events`` has one row per event with ``title``, ``series_id``, ``end_ts`` and nested
    ``markets``; ``listing`` one row per market and tag. All of them are candidates; ``max_scan``
    restates the paging limit of a remote listing, per series and per tag.
    """
    sport_series = sports.select("series_id", "sport", "series_ord")
    # Text ids are ordered as text, numbers as numbers.
    numbered = not isinstance(events.schema["event_id"].dataType, T.StringType)
    event_id, none = F.col("event_id"), F.lit(None)
    sport_tags = sports.select("tag_id", "sport").distinct()
    newest_events = _scanned(
        events,
        ["series_id"],
        {"_scan_0": -F.unix_micros(F.col("end_ts")),
         "_scan_1": none.cast("string") if numbered else event_id,
         "_scan_2": event_id.cast("bigint") if numbered else none.cast("bigint")},
        max_scan, EVENT_PAGE, "event_id",
    )
    newest_markets = _scanned(
        listing,
        ["tag_id"],
        {"_scan_0": -F.unix_micros(to_timestamp(F.col("endDate"))), "_scan_1": F.col("id")},
        max_scan, CLOSED_PAGE, "id",
    ).withColumn("_scan_2", F.lit(None).cast("bigint"))
    fields = [
        "id", "question", "startDate", "endDate", "clobTokenIds", "outcomes", "outcomePrices",
        "sportsMarketType", "category", "volumeNum", "liquidityNum", "volume", "liquidity",
        "liquidityClob", "liquidityAmm", "volumeClob", "volume1wkClob", "bestBid", "bestAsk",
    ]
    from_events = (
        newest_events.join(sport_series, "series_id")
        .select(
            "sport", F.lit(0).alias("source_ord"), "series_ord", *SCAN, "title",
            F.posexplode("markets").alias("nested_ord", "m"),
        )
        .select("sport", "source_ord", "series_ord", *SCAN, "nested_ord", "title",
                *[F.col(f"m.{f}") for f in fields])
    )
    from_listing = newest_markets.join(sport_tags, "tag_id").select(
        "sport", F.lit(1).alias("source_ord"), F.lit(0).alias("series_ord"), *SCAN,
        F.lit(0).alias("nested_ord"), F.lit(None).cast("string").alias("title"), *fields,
    )
    return from_events.unionByName(from_listing)


def select_closed_markets(
    candidates: DataFrame,
    per_sport: int,
    as_of: Column,
    within_days: float = 30.0,
    after: Column | None = None,
    before: Column | None = None,
) -> DataFrame:
    """First ``per_sport`` distinct resolved match-ups of each sport, in scan order."""
    title = F.coalesce(blank_to_null(F.col("question")), strip(F.coalesce(F.col("title"), F.lit(""))))
    named = with_evaluated(
        candidates,
        {
            "market_id": blank_to_null(F.col("id")),
            "title_used": title,
            "start_ts": to_timestamp(F.col("startDate")),
            "end_ts": to_timestamp(F.col("endDate")),
        },
    )
    parsed = with_outcomes(
        named.where(
            F.col("market_id").isNotNull()
            & L.is_plain_market_type(F.col("sportsMarketType"))
            & L.is_head_to_head(F.col("title_used"))
            & in_end_window(F.col("start_ts"), F.col("end_ts"), as_of, within_days, after, before)
        )
    )
    fit = (
        parsed.where(
            F.col("is_moneyline") & F.col("resolved_yes").isNotNull() & (F.size("tokens") >= 2)
        )
        .withColumn("token_id", F.get("tokens", F.col("primary_index")))
        .withColumn("volume_num", to_double(F.col("volumeNum")))
    )
    scan = [
        F.col(c).asc_nulls_last() for c in ("source_ord", "series_ord", *SCAN, "nested_ord")
    ]
    once = Window.partitionBy("sport", "market_id").orderBy(*scan)
    first_seen = fit.withColumn("_seen", F.row_number().over(once)).where("_seen = 1")
    return top_n_per_group(
        first_seen.drop("_seen"),
        ["sport"],
        [*scan, F.col("market_id")],
        per_sport,
        "pick",
        ["market_id"],
    ).drop(*SCAN)
