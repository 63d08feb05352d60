"""One query per operator and per composed job, each over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog import tables as X
from tapeloom.functions import jsontext as J
from tapeloom.functions import lenient as C
from tapeloom.functions import listing as L
from tapeloom.functions import prices as P
from tapeloom.functions import timegrid as TG
from tapeloom.functions.books import BOOK_COLUMNS, book_features
from tapeloom.operators import categories as K
from tapeloom.operators import components as PC
from tapeloom.operators import grid as G
from tapeloom.operators import history as H
from tapeloom.operators import jumps as JU
from tapeloom.operators import networks as N
from tapeloom.operators import scaling as Z
from tapeloom.operators import selection as S
from tapeloom.operators import sequences as Q
from tapeloom.operators import series as R
from tapeloom.operators import streaks as T
from tapeloom.operators.closedfeatures import closed_features as closed_feature_rows
from tapeloom.operators.distances import pairwise_distances
from tapeloom.operators.ranking import hash_sample
from tapeloom.plans import active, closed, components, embeddings
from tapeloom.schemas import ACTIVE_FEATURES, CLOSED_FEATURES, MARKET, RAW_GRID
from tapeloom.session import join_small, scratch, shared_dir, staged
from tapeloom.sinks import publish as W
from tapeloom.sources import books as B
from tapeloom.sources import histories as SH
from tapeloom.sources import idlists, listings
from tapeloom.sources.pointstore import PointStore
from tapeloom.sources.tables import read_csv

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

SIX_HOURS = 6 * TG.HOUR
MONTH_HOURS = 30 * 24.0


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def r6(value: Column | str) -> Column:
    """Rounded for comparison across engines; adding zero turns -0.0 into 0.0."""
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def r6s(names) -> list[Column]:
    return [r6(n).alias(n) for n in names]


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def prints(spark, sf) -> DataFrame:
    return H.dedupe_history(X.points(spark, sf), ["token_id"])


def market_prints(spark, sf) -> DataFrame:
    return prints(spark, sf).withColumnRenamed("token_id", "market_id")


def month_grid(spark, sf, markets: DataFrame | None = None) -> DataFrame:
    """All markets on a six-hour grid over the month before the reference time."""
    rows = markets if markets is not None else X.market_times(spark, sf)
    start = F.coalesce(F.col("start_ts"), H.window_start(F.lit(None).cast("timestamp"), X.as_of(), MONTH_HOURS))
    known = rows.select("market_id", start.alias("start_ts"))
    lines = G.spine(
        known, H.window_start(F.col("start_ts"), X.as_of(), MONTH_HOURS), X.as_of(), SIX_HOURS
    )
    return G.fill_grid(lines, G.bucket_stats(market_prints(spark, sf), ["market_id"], SIX_HOURS), ["market_id"])


def raw_rows(spark, sf) -> DataFrame:
    """Grid rows of markets that have any history, once per category."""
    have = market_prints(spark, sf).select("market_id").distinct()
    grid = month_grid(spark, sf, X.market_times(spark, sf).join(have, "market_id", "left_semi"))
    tags = X.listing(spark, sf).select(
        F.col("k").cast("string").alias("market_id"), "classifier_label", "tag_slug", "category_ord", "question"
    )
    return grid.select("market_id", "unix_ts", "lookback_step", "price_yes").join(tags, "market_id")


# ---- scans -------------------------------------------------------------------------------


@query
def scan_active_markets(spark, sf):
    return listings.active_markets(X.listing(spark, sf)).select(
        "k", "id", "tag_id", r6(C.to_double(F.col("volumeNum"))).alias("volume")
    )


@query
def scan_closed_markets(spark, sf):
    return listings.closed_markets(X.closed_listing(spark, sf)).select("k", "id", "tag_id", "endDate")


@query
def scan_event_markets(spark, sf):
    events = listings.parse_events(X.event_payloads(spark, sf).select("payload"), "payload")
    return listings.event_markets(events).select(
        "title", "series_id", F.col("position").cast("bigint").alias("position"), "id", "question"
    )


@query
def scan_price_history(spark, sf):
    payload = """CASE WHEN extract_ord % 50 = 0 THEN 'oops' ELSE concat(
        '{"history":[{"t":', t, ',"p":', coalesce(CAST(price AS STRING), 'null'),
        '},{"t":null,"p":0.5},{"t":', t + 1, ',"p":"bad"}',
        CASE WHEN extract_ord % 9 = 4 THEN ',7' ELSE '' END, ',{"t":"', t + 2, '","p":"0.25"}]}') END"""
    rows = X.points(spark, sf).selectExpr("token_id", "extract_ord", f"{payload} AS payload")
    return SH.history_points(rows, "payload", ["token_id", "extract_ord"]).select(
        "token_id", "extract_ord", "t", r6("price").alias("price")
    )


@query
def normalize_batch_history(spark, sf):
    one = """concat('[{"t":', t, ',"p":', coalesce(CAST(price AS STRING), 'null'), '}]')"""
    payload = f"""CASE extract_ord % 4
        WHEN 0 THEN concat('{{"history":{{"', token_id, '":', {one}, '}}}}')
        WHEN 1 THEN concat('{{"data":[{{"token_id":"', token_id, '","history":', {one}, '}}]}}')
        WHEN 2 THEN concat('{{"history":{{}},"data":[{{"token_id":0,"market":"","asset_id":"a', token_id, '","history":', {one}, '}}]}}')
        ELSE concat('{{"history":{{"', token_id, '":', {one}, '}},"data":[{{"token_id":"other","history":', {one}, '}}]}}') END"""
    rows = X.points(spark, sf).selectExpr("extract_ord", f"{payload} AS payload")
    return SH.batch_points(rows, "payload", ["extract_ord"]).select(
        "extract_ord", "token_id", "t", r6("price").alias("price")
    )


@query
def scan_features_csv(spark, sf):
    table = X.embedding_features(spark, sf)
    path = W.publish(table, scratch(spark, "features-csv"), "csv")
    back = read_csv(spark, path, table.schema)
    numbers = PC.columns_after(back, "tag_slug")
    return back.select("market_id", "classifier_label", "tag_id", "tag_slug", *r6s(numbers))


@query
def parse_id_list(spark, sf):
    lines = X.table(spark, sf, "orders").selectExpr(
        """CASE o_orderkey % 4 WHEN 0 THEN concat('# ', o_orderkey) WHEN 1 THEN concat(o_custkey, ',m', o_orderkey, ' # ', o_orderpriority)
             WHEN 2 THEN concat('  ', o_custkey, '\t', o_custkey, ' ') ELSE '' END AS value"""
    )
    return idlists.parse_ids(lines)


# ---- sinks -------------------------------------------------------------------------------


@query
def atomic_write_roundtrip(spark, sf):
    rows = X.customers(spark, sf).select("k", "id", "seg", r6(C.to_double(F.col("volume"))).alias("volume"))
    path = scratch(spark, "atomic")
    W.publish(rows.limit(0), path)
    W.publish(rows, path)
    return spark.read.schema(rows.schema).parquet(W.current(spark, path))


@query
def check_alignment(spark, sf):
    features = prints(spark, sf).select(F.col("token_id").alias("market_id")).distinct()
    return W.alignment(features, X.market_times(spark, sf), ["market_id"])


@query
def dropped_ids(spark, sf):
    rows = X.listing(spark, sf).withColumn("market_id", F.col("k").cast("string"))
    _, dropped = K.split_by_category(rows, K.parse_categories("Building; MACHINERY ,"))
    path = W.publish_ids(dropped, scratch(spark, "dropped"))
    return spark.read.text(path).withColumnRenamed("value", "market_id")


# ---- filters and projections ---------------------------------------------------------------


@query
def prefilter_markets(spark, sf):
    fit = L.passes_prefilter(F.col("volumeNum"), F.col("liquidityNum"), 1000.0, 600.0)
    return X.customers(spark, sf).where(fit).select("k", "id")


@query
def prefilter_markets_at_zero(spark, sf):
    """Missing counts as 0 and passes, text that reads as NaN does not."""
    fit = L.passes_prefilter(F.col("volumeNum"), F.col("liquidityNum"), 0.0, 0.0)
    return X.customers(spark, sf).where(fit).select("k", "id")


@query
def yes_token(spark, sf):
    return S.with_yes_token(X.customers(spark, sf)).select("k", "market_id", "token_id")


@query
def market_type_filter(spark, sf):
    rows = X.customers(spark, sf).where(L.is_plain_market_type(F.col("sportsMarketType")))
    return rows.select("k", "sportsMarketType")


@query
def head_to_head_filter(spark, sf):
    return X.customers(spark, sf).where(L.is_head_to_head(F.col("question"))).select("k", "question")


@query
def moneyline_filter(spark, sf):
    return X.customers(spark, sf).where(L.is_moneyline(J.text_array(F.col("outcomes")))).select("k")


@query
def resolved_label(spark, sf):
    rows = S.with_outcomes(X.customers(spark, sf)).where(F.col("resolved_yes").isNotNull())
    return rows.select("k", "resolved_yes")


@query
def end_date_window(spark, sf):
    day = lambda text: F.to_timestamp(F.lit(text))
    fits = S.in_end_window(
        C.to_timestamp(F.col("startDate")), C.to_timestamp(F.col("endDate")), X.as_of(), 25.0,
        day("2024-01-08 00:00:00"), day("2024-01-28 00:00:00"),
    )
    return X.customers(spark, sf).where(fits).select("k", "endDate")


@query
def valid_price_filter(spark, sf):
    rows = X.points(spark, sf).where(P.is_valid_price(F.col("price")))
    return rows.select("extract_ord", "token_id", r6("price").alias("price"))


@query
def history_window(spark, sf):
    rows = H.in_history_window(X.points(spark, sf), X.market_times(spark, sf), X.as_of(), 20 * 24.0)
    return rows.select("market_id", "extract_ord", "t")


@query
def category_split(spark, sf):
    rows = X.listing(spark, sf)
    kept, dropped = K.split_by_category(rows, K.parse_categories(" Household;furniture"))
    return kept.select("k", "tag_id", F.lit("kept").alias("part")).unionByName(
        dropped.select("k", "tag_id", F.lit("dropped").alias("part"))
    )


@query
def min_points_filter(spark, sf):
    return Q.enough_points(Q.dedupe_steps(raw_rows(spark, sf), "lookback_step", ["unix_ts", "category_ord"]), 40)


@query
def select_numeric(spark, sf):
    rows = X.table(spark, sf, "customer").selectExpr(
        "c_custkey AS market_id", "c_nationkey AS tag_id", "c_name AS classifier_label",
        "c_mktsegment AS tag_slug", "c_acctbal", "c_nationkey", "c_acctbal > 0 AS in_credit",
    )
    return rows.select(*PC.numeric_columns(rows))


@query
def liquidity_snapshot(spark, sf):
    rows = X.customers(spark, sf).select("k", *active.liquidity_snapshot())
    return rows.select("k", *r6s(rows.columns[1:]))


@query
def trade_context(spark, sf):
    rows = X.customers(spark, sf).select("k", *closed.trade_context())
    return rows.select("k", *r6s(rows.columns[1:-2]), "best_bid", "best_ask")


@query
def closed_metadata(spark, sf):
    rows = S.with_outcomes(X.closed_listing(spark, sf)).withColumn("market_id", F.col("id"))
    out = rows.select("k", *closed.metadata_columns(F.lower("seg"), F.lit("untitled")))
    return out.withColumns({c: r6(c) for c in ("volumeNum", "liquidityNum")})


@query
def primary_outcome(spark, sf):
    return S.with_outcomes(X.customers(spark, sf)).select("k", "primary_index", "primary_outcome")


@query
def grid_axes(spark, sf):
    grid = G.grid_axes(month_grid(spark, sf), F.col("start_ts"), SIX_HOURS)
    return grid.select(
        "market_id", "unix_ts", "lookback_step", "normalized_step", *r6s(["hours_since_market_start"])
    )


@query
def time_to_close(spark, sf):
    hours = TG.hours_between(X.as_of(), C.to_timestamp(F.col("endDate")))
    return X.customers(spark, sf).select("k", r6(hours).alias("time_to_close_hours"))


# ---- grids and as-of -----------------------------------------------------------------------


@query
def bucket_last(spark, sf):
    return G.bucket_last(prints(spark, sf), ["token_id"], TG.HOUR).select(
        "token_id", "unix_ts", *r6s(["price_yes"])
    )


@query
def bucket_stats(spark, sf):
    rows = G.bucket_stats(prints(spark, sf), ["token_id"], SIX_HOURS)
    return rows.select(
        "token_id", "unix_ts", "raw_prints_in_bucket",
        *r6s(["price_yes", "intrabucket_price_range", "intrabucket_price_stdev"]),
    )


@query
def price_grid(spark, sf):
    return month_grid(spark, sf).select("market_id", "unix_ts", *r6s(["price_yes"]))


@query
def grid_bucket_stats(spark, sf):
    return month_grid(spark, sf).select(
        "market_id", "unix_ts", "raw_prints_in_bucket",
        *r6s(["intrabucket_price_range", "intrabucket_price_stdev"]),
    )


@query
def grid_with_placeholder(spark, sf):
    """Days after the end of each market; open markets have none and keep a noted row."""
    markets = X.market_times(spark, sf).select("market_id", "end_ts")
    day = 24 * TG.HOUR
    lines = G.spine(markets, F.col("end_ts"), X.as_of(), day).drop("end_ts")
    grid = G.fill_grid(lines, G.bucket_last(market_prints(spark, sf), ["market_id"], day), ["market_id"])
    rows = G.with_placeholders(markets.select("market_id"), grid, ["market_id"], "no_clob_in_window")
    return rows.select("market_id", "unix_ts", "note", *r6s(["price_yes"]))


@query
def normalized_price(spark, sf):
    rows = G.anchor_prices(month_grid(spark, sf), ["market_id"])
    return rows.select("market_id", "unix_ts", *r6s(["price_yes_norm", "price_norm_anchor"]))


@query
def asof_hourly(spark, sf):
    rows = R.as_of_labels(prints(spark, sf), ["token_id"], TG.HOUR, "floor")
    return rows.select("token_id", "unix_ts", *r6s(["price_yes"]))


def prints_near_end(spark, sf, hours: float = T.SKEW_LOOKBACK_HOURS) -> DataFrame:
    """Points are bounded before they are deduplicated."""
    near = H.near_ends(X.points(spark, sf), X.market_times(spark, sf), int(hours * TG.HOUR), 0)
    return H.dedupe_history(near, ["token_id"])


def segments(spark, sf, hours: float) -> DataFrame:
    markets = X.market_times(spark, sf)
    found = T.detect_streaks(prints_near_end(spark, sf), markets, segment_hours=hours)
    return staged(found.join(markets.select("market_id", "token_id"), "market_id"), "segments")


def segment_prints(spark, sf, hours: float) -> DataFrame:
    found = segments(spark, sf, hours)
    ends = found.where("segment_end IS NOT NULL").select(
        "token_id", F.timestamp_seconds("segment_end").alias("end_ts")
    )
    near = H.near_ends(X.points(spark, sf), ends, int(hours * TG.HOUR), 0)
    return T.prints_in_segment(H.dedupe_history(near, ["token_id"]), found)


@query
def asof_minute(spark, sf):
    inside = segment_prints(spark, sf, 48.0)
    rows = R.as_of_labels(inside, ["market_id"], TG.MINUTE, "ceil").where("price_yes IS NOT NULL")
    return rows.select("market_id", "unix_ts", *r6s(["price_yes"]))


@query
def segment_before_streak(spark, sf):
    rows = segment_prints(spark, sf, 48.0)
    return rows.select(
        "market_id", "t", *r6s(["price", "seconds_since_window_start", "seconds_until_window_end"])
    )


# ---- features ------------------------------------------------------------------------------


@query
def price_diff(spark, sf):
    rows = JU.price_changes(G.anchor_prices(month_grid(spark, sf), ["market_id"]), ["market_id"])
    return rows.select("market_id", "unix_ts", *r6s(["change"]))


@query
def jump_features(spark, sf):
    grid = G.anchor_prices(month_grid(spark, sf), ["market_id"])
    rows = JU.jump_features(grid, ["market_id"])
    return rows.select("market_id", "n_valid", *r6s([c for c in rows.columns if c.startswith("feat_")]))


@query
def prints_per_hour(spark, sf):
    counts = prints(spark, sf).groupBy("token_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(
        "token_id", r6(JU.prints_per_hour(F.col("n"), MONTH_HOURS)).alias("feat_raw_prints_per_hour")
    )


def books(spark, sf) -> DataFrame:
    return B.books_from_levels(X.levels(spark, sf), X.LEVEL_ORDER)


@query
def order_book_summary(spark, sf):
    rows = B.summarize_books(books(spark, sf))
    return rows.select("token_id", *r6s(BOOK_COLUMNS), "ob_timestamp_ms")


@query
def latest_order_books(spark, sf):
    """The latest of several snapshots of each token, some with a stamp that is no number."""
    levels = X.levels(spark, sf).withColumn("token", F.col("token_id"))
    apart = levels.withColumn("token_id", F.concat_ws("@", "token", F.col("timestamp").cast("string")))
    snapshots = B.books_from_levels(apart, X.LEVEL_ORDER).withColumn("token_id", F.substring_index("token_id", "@", 1))
    broken = snapshots.withColumn("timestamp", F.lit("n/a")).withColumn("bids", F.slice("bids", 1, 1))
    rows = B.summarize_books(B.latest_books(snapshots.unionByName(broken)))
    return rows.select("token_id", *r6s(BOOK_COLUMNS), "ob_timestamp_ms")


@query
def scan_order_books(spark, sf):
    """Book payloads as JSON text, one per line item: two levels a side, some unreadable."""
    def level(price: str, size: str) -> str:
        return f"""concat('{{"price":"', {price}, '","size":', {size}, '}}')"""

    broken = """'{"price":"x","size":1}'"""
    sides = {
        "bids": (level("0.5D - l_discount", "l_quantity"), level("0.4D - l_discount", "l_quantity * 2D")),
        "asks": (
            f"CASE WHEN l_partkey % 5 = 0 THEN {broken} ELSE {level('0.5D + l_tax', 'l_quantity')} END",
            level("0.6D + l_tax", "l_quantity * 4D"),
        ),
    }
    arrays = {k: f"concat('[', {a}, ',', {b}, ']')" for k, (a, b) in sides.items()}
    asks = f"CASE WHEN l_linenumber = 7 THEN '[]' ELSE {arrays['asks']} END"
    payload = f"""concat('{{"timestamp":"', l_orderkey, '","bids":', {arrays['bids']}, ',"asks":', {asks}, '}}')"""
    rows = X.table(spark, sf, "lineitem").selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS token_id", f"{payload} AS payload"
    )
    found = B.summarize_books(B.parse_books(rows, "payload", ["token_id"]))
    return found.select("token_id", *r6s(BOOK_COLUMNS), "ob_timestamp_ms")


@query
def book_features_query(spark, sf):
    rows = B.summarize_books(books(spark, sf))
    names = ("ob_mid", "ob_spread", "ob_imbalance_topn", "ob_bid_depth_topn", "ob_ask_depth_topn")
    features = book_features(*[F.col(n) for n in names])
    return rows.select("token_id", *[r6(v).alias(k) for k, v in features.items()])


QUERIES["book_features"] = QUERIES.pop("book_features_query")


@query
def closed_features(spark, sf):
    rows = closed_feature_rows(market_prints(spark, sf), X.market_times(spark, sf))
    return rows.select("market_id", *r6s(CLOSED_FEATURES))


@query
def zscore(spark, sf):
    rows = X.customers(spark, sf).select(
        "k", *active.liquidity_snapshot(""), C.to_double(F.col("liquidityAmm")).alias("liquidity_amm")
    )
    return Z.zscore(rows, rows.columns[1:]).select("k", *r6s(rows.columns[1:]))


# ---- sequences and windows -----------------------------------------------------------------


@query
def hourly_ffill(spark, sf):
    return R.hold_forward(prints(spark, sf), ["token_id"], TG.HOUR).select(
        "token_id", "unix_ts", *r6s(["price_yes"])
    )


@query
def rolling_volatility(spark, sf):
    hourly = R.hold_forward(prints(spark, sf), ["token_id"], TG.HOUR)
    line = R.along(["token_id"], "unix_ts")
    rolled = hourly.withColumn("roll", R.rolling_deviation(P.logit(F.col("price_yes")), line, 24))
    return rolled.groupBy("token_id").agg(r6(F.avg("roll")).alias("volatility"))


@query
def detect_streak(spark, sf):
    return T.detect_streaks(prints_near_end(spark, sf), X.market_times(spark, sf))


def steps(spark, sf) -> DataFrame:
    return Q.dedupe_steps(raw_rows(spark, sf), "lookback_step", ["unix_ts", "category_ord"])


def staged_steps(spark, sf) -> DataFrame:
    """The filled paths read the steps three times, so they are written once."""
    return staged(steps(spark, sf), "steps")


@query
def sequence_dedup(spark, sf):
    return steps(spark, sf).select("market_id", "step", "classifier_label", *r6s(["price_yes"]))


@query
def fill_sequence(spark, sf):
    return Q.filled_paths(staged_steps(spark, sf)).select("market_id", "step", *r6s(["level"]))


@query
def rich_features(spark, sf):
    return Q.filled_paths(staged_steps(spark, sf)).select("market_id", "step", *r6s(["level", "diff"]))


@query
def sequence_matrix(spark, sf):
    paths = staged(Q.path_vectors(staged_steps(spark, sf)), "paths")
    vectors = Q.scale_vectors(paths)
    return vectors.select("market_id", F.posexplode("x").alias("slot", "value")).select(
        "market_id", F.col("slot").cast("bigint").alias("slot"), *r6s(["value"])
    )


@query
def label_index(spark, sf):
    return Q.label_index(X.embedding_features(spark, sf)).select(
        F.col("label_class_index").cast("bigint").alias("label_class_index"), "label_class"
    )


@query
def label_one_hot(spark, sf):
    rows = X.embedding_features(spark, sf).select("market_id", F.col("classifier_label").alias("label_class"))
    index = staged(Q.label_index(rows, "label_class"), "labels")
    n = index.count()
    marked = join_small(rows, index, ["label_class"], max_rows=n)
    return marked.select(
        "market_id", F.posexplode(Q.one_hot(F.col("label_class_index"), n)).alias("slot", "hot")
    ).withColumn("slot", F.col("slot").cast("bigint"))


# ---- selection and sets --------------------------------------------------------------------


@query
def top_markets_per_category(spark, sf):
    rows = S.top_markets_per_category(X.listing(spark, sf), 30, 1000.0, 600.0)
    return rows.select("tag_id", "market_id", "token_id", F.col("pick").cast("bigint").alias("pick"))


@query
def selection_shortfall(spark, sf):
    rows = S.top_markets_per_category(X.listing(spark, sf), 150, 1000.0, 600.0)
    dims = S.category_table(spark, X.CATEGORIES)
    return S.shortfall(rows, dims, "tag_id", 150).select("tag_id", "tag_slug", "found", "wanted", "short")


@query
def select_closed_markets(spark, sf):
    candidates = S.closed_candidates(
        X.events(spark, sf), X.closed_listing(spark, sf), S.sport_table(spark, X.SPORTS)
    )
    return _closed_picks(candidates)


def _closed_picks(candidates: DataFrame) -> DataFrame:
    rows = S.select_closed_markets(candidates, 20, X.as_of())
    return rows.select(
        "sport", "market_id", F.col("title_used").alias("question"), "token_id",
        "resolved_yes", F.col("pick").cast("bigint").alias("pick"),
    )


@query
def select_closed_markets_paged(spark, sf):
    """With an explicit paging limit: 50 is one whole page of 80 events, and one of 200 listings."""
    candidates = S.closed_candidates(
        X.events(spark, sf), X.closed_listing(spark, sf), S.sport_table(spark, X.SPORTS), 50
    )
    return _closed_picks(candidates)


@query
def top_markets_paged(spark, sf):
    """With an explicit paging limit: 150 listings of a tag are two whole pages of 100."""
    rows = S.top_markets_per_category(X.listing(spark, sf), 120, 1000.0, 600.0, 150)
    return rows.select("tag_id", "market_id", "token_id", F.col("pick").cast("bigint").alias("pick"))


@query
def list_categories(spark, sf):
    return K.category_labels(X.listing(spark, sf))


@query
def history_coverage(spark, sf):
    wanted = S.with_yes_token(listings.active_markets(X.listing(spark, sf)))
    return H.history_coverage(wanted, X.points(spark, sf))


@query
def enrich_question(spark, sf):
    rows = X.listing(spark, sf).withColumn("market_id", F.col("k").cast("string"))
    return K.with_question(
        rows.select("market_id", "tag_id"), listings.active_markets(rows), ["category_ord"]
    )


@query
def exclude_ids(spark, sf):
    rows = X.listing(spark, sf).withColumn("market_id", F.col("k").cast("string"))
    ids = listings.closed_markets(rows).select("market_id")
    return K.exclude_ids(rows.select("market_id", "tag_id"), ids)


@query
def excluded_count(spark, sf):
    rows = X.listing(spark, sf).withColumn("market_id", F.col("k").cast("string"))
    return K.excluded_count(rows, listings.closed_markets(rows).select("market_id"))


@query
def hash_sample_query(spark, sf):
    return hash_sample(X.customers(spark, sf).select("k", "seg"), "k", 80)


QUERIES["hash_sample"] = QUERIES.pop("hash_sample_query")


@query
def dedupe_history(spark, sf):
    return prints(spark, sf).select("token_id", "t", *r6s(["price"]))


@query
def merge_resolutions(spark, sf):
    rows = H.merge_resolutions(X.points(spark, sf), X.market_times(spark, sf))
    return rows.select("market_id", "t", *r6s(["price"]))


@query
def finest_resolution(spark, sf):
    rows = H.finest_resolution(X.points(spark, sf))
    return rows.select("token_id", "resolution", "t", *r6s(["price"]))


def point_store(spark, sf) -> PointStore:
    """Two extracts added one after the other, the later one first."""
    store, points = PointStore(scratch(spark, "points"), 8), X.points(spark, sf)
    store.add(points.where(F.col("extract_ord") % 2 == 1))
    store.add(points.where(F.col("extract_ord") % 2 == 0))
    return store


@query
def stored_merge_resolutions(spark, sf):
    markets = X.market_times(spark, sf)
    rows = point_store(spark, sf).merge_resolutions(markets, max_markets=markets.count())
    return rows.select("market_id", "t", *r6s(["price"]))


@query
def stored_finest_resolution(spark, sf):
    rows = point_store(spark, sf).finest_resolution(spark)
    return rows.select("token_id", "resolution", "t", *r6s(["price"]))


# ---- scalars -------------------------------------------------------------------------------


@query
def parse_json_field(spark, sf):
    def joined(name: str) -> Column:
        return F.concat_ws("|", J.text_array(F.col(name))).alias(name)

    def known(name: str) -> Column:
        return J.text_array(F.col(name)).isNotNull().cast("int").alias(f"has_{name}")

    return X.customers(spark, sf).select(
        "k", joined("clobTokenIds"), known("clobTokenIds"), joined("outcomes"), joined("outcomePrices")
    )


@query
def lenient_cast(spark, sf):
    names = ("volumeNum", "liquidityNum", "liquidityClob", "volume1wkClob", "bestBid")
    return X.customers(spark, sf).select("k", *[r6(C.to_double(F.col(n))).alias(n) for n in names])


@query
def lenient_timestamp(spark, sf):
    return X.customers(spark, sf).select(
        "k", *[F.unix_seconds(C.to_timestamp(F.col(n))).alias(n) for n in ("startDate", "endDate")]
    )


@query
def logit(spark, sf):
    return prints(spark, sf).select("token_id", "t", r6(P.logit(F.col("price"))).alias("logit"))


@query
def floor_ceil_ts(spark, sf):
    t = F.col("t")
    return X.points(spark, sf).select(
        "extract_ord",
        TG.floor_to(t, 7 * TG.HOUR).alias("floor_7h"),
        TG.ceil_to(t, 30 * TG.MINUTE).alias("ceil_30min"),
    )


# ---- components and distances --------------------------------------------------------------


def fitted(spark, sf):
    table = X.embedding_features(spark, sf)
    return table, PC.fit_components(table, PC.numeric_columns(table))


@query
def pca_scores(spark, sf):
    table, model = fitted(spark, sf)
    names = [f"PC{i + 1}" for i in range(len(model.loadings))]
    return model.scores(table).select("market_id", "classifier_label", *r6s(names))


@query
def pca_scree(spark, sf):
    rows = fitted(spark, sf)[1].scree()
    return rows.select("component", "label", *r6s(["variance_ratio", "cumulative_ratio"]))


@query
def pca_loadings(spark, sf):
    return fitted(spark, sf)[1].loading_table().select("feature", "component", *r6s(["loading"]))


@query
def pca_top_features(spark, sf):
    return fitted(spark, sf)[1].top_features().select("feature", *r6s(["loading_norm"]))


def half_correlations(spark, sf) -> DataFrame:
    """The operator on two projections that SQL can state: the two halves' mean."""
    table = X.embedding_features(spark, sf)
    names = PC.numeric_columns(table)

    def mean_of(part: list[str]) -> Column:
        return F.aggregate(F.array(*part), F.lit(0.0), lambda a, b: a + b) / len(part)

    scored = table.withColumn("PC1", mean_of(names[:32])).withColumn("PC2", mean_of(names[32:]))
    return PC.correlations(scored, names, ["PC1", "PC2"])


@query
def feature_correlations(spark, sf):
    return half_correlations(spark, sf).select("feature", "target", *r6s(["correlation"]))


@query
def top_correlations(spark, sf):
    rows = PC.top_correlations(half_correlations(spark, sf))
    return rows.select("target", F.col("place").cast("bigint").alias("place"), "feature", *r6s(["correlation"]))


@query
def scores_by_time_to_close(spark, sf):
    hours = TG.hours_between(X.as_of(), C.to_timestamp(F.col("endDate")))
    rows = X.listing(spark, sf).select(
        F.col("k").cast("string").alias("market_id"), "tag_id", hours.alias("hours"),
        C.to_double(F.col("volume")).alias("PC1"), C.to_double(F.col("liquidity")).alias("PC2"),
    )
    return PC.scores_by_order(rows, "hours").select(
        "rank", "market_id", "tag_id", *r6s(["hours", "PC1", "PC2"])
    )


@query
def pairwise_distance(spark, sf):
    table = X.embedding_features(spark, sf)
    return pairwise_distances(table, PC.numeric_columns(table)).withColumn("distance", r6("distance"))


# ---- embeddings ----------------------------------------------------------------------------

TRAINING = embeddings.EmbeddingSettings(mode="all")


def _embedding(kind: str):
    def run(spark, sf):
        seq = embeddings.prepare_sequences(raw_rows(spark, sf), TRAINING)
        return embeddings.embed(seq, kind, TRAINING)[0]

    return run


QUERIES["ae_embed"] = _embedding("ae")
QUERIES["ae_semi_embed"] = _embedding("semi")
QUERIES["cvae_embed"] = _embedding("cvae")


@query
def ae_metrics(spark, sf):
    seq = embeddings.prepare_sequences(raw_rows(spark, sf), TRAINING)
    model = N.fit("ae", seq.rows, TRAINING.training, seq.n_classes)
    return N.metrics(model, seq.rows)


# The networks with weights from a formula, which SQL can state as well.
FORMULA = N.Training(h1=8, h2=4, latent=2, epochs=1, learning_rate=0.05, batch=1 << 30)
FORMULA_CLASSES = 3


def _formula_model(kind: str):
    if kind == "cvae":
        model = N.ConditionalVae.fresh(64, FORMULA, FORMULA_CLASSES)
    else:
        model = N.Autoencoder.fresh(64, FORMULA, FORMULA_CLASSES if kind == "semi" else 0)
    for place, layer in enumerate(model.layers()):
        i, j = np.indices(layer.weight.shape)
        layer.weight = ((i * 7 + j * 13 + place * 5) % 23 - 11) / 40
        layer.bias = ((np.arange(layer.bias.size) * 3 + place) % 7 - 3) / 20
    return model


def _formula_rows(spark, sf) -> DataFrame:
    vectors = X.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("market_id"),
        F.col("embedding").cast("array<double>").alias("x"),
        F.pmod("label", F.lit(FORMULA_CLASSES)).alias("label_class_index"),
    )
    rows = N.training_rows(vectors.select("market_id", "x"), vectors.drop("x"))
    # The noise of a row hangs on its key: a number that SQL has as well.
    return rows.withColumn("row_key", F.col("market_id").cast("long"))


def _encoded(kind: str, steps: int):
    def run(spark, sf):
        rows, model = _formula_rows(spark, sf), _formula_model(kind)
        if steps:
            model = N.train(model, rows, FORMULA)
        return N.embed(model, rows).select("market_id", *r6s(["z1", "z2"]))

    return run


for _kind in ("ae", "cvae"):
    QUERIES[f"{_kind}_encode"] = _encoded(_kind, 0)
for _kind in ("ae", "semi", "cvae"):
    QUERIES[f"{_kind}_one_step"] = _encoded(_kind, 1)


def _measured(kind: str):
    def run(spark, sf):
        found = N.metrics(_formula_model(kind), _formula_rows(spark, sf))
        return found.select("n_rows", *r6s(["mse", "mean_kl"]))

    return run


for _kind in ("ae", "cvae"):
    QUERIES[f"{_kind}_reconstruction"] = _measured(_kind)


# ---- composed jobs -------------------------------------------------------------------------

ACTIVE = active.ActiveSettings(
    as_of=X.AS_OF, per_category=200, lookback_days=10.0, interval_hours=6.0, min_volume=1000.0,
    min_liquidity=600.0, use_books=True,
)


def _open(spark, sf) -> DataFrame:
    return listings.active_markets(X.listing(spark, sf))


def active_tables(spark, sf) -> active.ActiveTables:
    return active.build(_open(spark, sf), X.points(spark, sf), books(spark, sf), ACTIVE)


@query
def active_features(spark, sf):
    rows = active_tables(spark, sf).scaled_features()
    return rows.select("market_id", "classifier_label", "tag_id", "tag_slug", *r6s(ACTIVE_FEATURES))


@query
def active_metadata(spark, sf):
    rows = active_tables(spark, sf).metadata()
    doubles = [n for n, t in rows.dtypes if t == "double"]
    return rows.withColumns({n: r6(n) for n in doubles})


@query
def active_raw_grid(spark, sf):
    rows = active_tables(spark, sf).raw_grid()
    doubles = [n for n, t in rows.dtypes if t == "double"]
    return rows.withColumns({n: r6(n) for n in doubles}).select(*RAW_GRID.names)


CLOSED = closed.ClosedSettings(as_of=X.AS_OF, segment_hours=48.0)


def closed_tables(spark, sf) -> closed.ClosedTables:
    return closed.build(
        X.events(spark, sf), X.closed_listing(spark, sf), X.points(spark, sf),
        S.sport_table(spark, X.SPORTS), CLOSED,
    )


@query
def closed_pipeline(spark, sf):
    rows = closed_tables(spark, sf).scaled_features()
    return rows.select("market_id", "sport", "resolved_yes", *r6s(CLOSED_FEATURES))


@query
def closed_pipeline_metadata(spark, sf):
    rows = closed_tables(spark, sf).metadata()
    return rows.withColumns({c: r6(c) for c in ("volumeNum", "liquidityNum")})


@query
def closed_pipeline_segments(spark, sf):
    rows = closed_tables(spark, sf).raw_segments()
    doubles = [n for n, t in rows.dtypes if t == "double"]
    return rows.withColumns({n: r6(n) for n in doubles})


# ---- jobs from landed files ---------------------------------------------------------------


def _landed_points(spark, sf) -> DataFrame:
    """Points written as payloads per extract and read back by the library."""
    path = scratch(spark, "landed-points")
    point = F.struct("t", F.col("price").alias("p"))
    rows = X.points(spark, sf).where("price IS NOT NULL").select(
        "token_id", "resolution", "extract_ord", F.array(point).alias("history")
    )
    rows.write.partitionBy("resolution").json(path)
    return SH.landed_points(spark, path)


def _landed_listing(spark, sf, rows: DataFrame, dimension: DataFrame) -> DataFrame:
    path = scratch(spark, "landed-listing")
    rows.select(*MARKET.names, "tag_id").write.partitionBy("tag_id").json(path)
    return listings.landed_markets(spark, path, dimension)


def _landed_active(spark, sf) -> active.ActiveTables:
    listing = _landed_listing(spark, sf, X.listing(spark, sf), S.category_table(spark, X.CATEGORIES))
    path = scratch(spark, "landed-books")
    books(spark, sf).write.json(path)
    landed = B.read_token_books(spark, path)
    return active.build(
        listings.active_markets(listing), _landed_points(spark, sf), landed, ACTIVE
    )


@query
def landed_active_features(spark, sf):
    rows = _landed_active(spark, sf).scaled_features()
    return rows.select("market_id", "classifier_label", "tag_id", "tag_slug", *r6s(ACTIVE_FEATURES))


@query
def landed_grid_paths(spark, sf):
    """The published raw grid read back and turned into paths, as the embedding job does."""
    path = scratch(spark, "published-grid")
    W.publish(_landed_active(spark, sf).raw_grid(), path)
    cfg = embeddings.EmbeddingSettings(categories=X.CATEGORIES)
    raw = embeddings.with_category_order(spark.read.parquet(W.current(spark, path)), cfg)
    steps = staged(Q.dedupe_steps(raw, "lookback_step", list(cfg.order)), "steps")
    return Q.filled_paths(steps).select("market_id", "step", *r6s(["level", "diff"]))


@query
def landed_closed_pipeline(spark, sf):
    """Events and closed listings as payloads; ids of landed events are text."""
    path = scratch(spark, "landed-events")
    rows = X.events(spark, sf)
    rows.select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("id"),
        F.date_format("end_ts", X.ISO).alias("endDate"), "title", "series_id", "markets",
    ).write.json(path)
    tags = S.sport_table(spark, X.SPORTS).select("tag_id").distinct()
    listing = _landed_listing(spark, sf, X.closed_listing(spark, sf), tags)
    tables = closed.build(
        listings.landed_events(spark, path), listings.closed_markets(listing),
        _landed_points(spark, sf), S.sport_table(spark, X.SPORTS), CLOSED,
    )
    return tables.scaled_features().select("market_id", "sport", "resolved_yes", *r6s(CLOSED_FEATURES))


@query
def pca_report(spark, sf):
    """Scores of the active features, best correlated features beside them in a long table."""
    features = active_tables(spark, sf).scaled_features()
    report = components.build(features, components.ReportSettings())
    points = report.points().select(
        "market_id", "tag_id", F.explode(F.array(*[
            F.struct(F.lit(n).alias("item"), F.col(n).alias("value")) for n in ("PC1", "PC2")
        ])).alias("p"),
    ).select(F.lit("score").alias("part"), F.concat_ws(":", "market_id", "tag_id").alias("key"), "p.item", "p.value")
    top = report.correlations().select(
        F.lit("correlation").alias("part"), F.col("feature").alias("key"),
        F.col("target").alias("item"), F.col("correlation").alias("value"),
    )
    scree = report.fitted.scree().select(
        F.lit("scree").alias("part"), F.col("label").alias("key"), F.lit("ratio").alias("item"),
        F.col("variance_ratio").alias("value"),
    )
    distances = report.distances().select(
        F.lit("distance").alias("part"), F.col("label_a").alias("key"),
        F.col("label_b").alias("item"), F.col("distance").alias("value"),
    )
    rows = points.unionByName(top).unionByName(scree).unionByName(distances)
    return rows.select("part", "key", "item", *r6s(["value"]))


@query
def embedding_report(spark, sf):
    return embeddings.report(raw_rows(spark, sf), TRAINING)
