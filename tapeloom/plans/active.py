"""Active markets: selection, price grid, metadata and scaled features."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.books import BOOK_COLUMNS, book_features
from tapeloom.functions.lenient import to_double, to_timestamp
from tapeloom.functions.timegrid import (
    hours_between, iso_of_seconds, iso_utc, step_label, step_seconds,
)
from tapeloom.operators import grid as G
from tapeloom.operators.history import finest_resolution, in_history_window, window_start
from tapeloom.operators.jumps import jump_features, prints_per_hour
from tapeloom.operators.scaling import zscore
from tapeloom.operators.selection import shortfall, top_markets_per_category
from tapeloom.schemas import ACTIVE_FEATURES, FEATURES, IDENTITY, RAW_GRID
from tapeloom.session import join_small, prepare, staged, staged_with_counts, staging
from tapeloom.sinks.publish import publish, publish_aligned
from tapeloom.sources.books import latest_books, summarize_books


@dataclass(frozen=True)
class ActiveSettings:
    """Knobs of the job with their usual defaults; ``as_of`` is explicit so results repeat."""

    as_of: datetime
    per_category: int = 5
    lookback_days: float = 1.0
    interval_hours: float = 0.5
    # Paging limit of a remote listing; none by default: all listings are looked at.
    max_scan: int | None = None
    min_volume: float = 10_000.0
    min_liquidity: float = 1_000.0
    use_books: bool = False

    @property
    def step(self) -> int:
        return step_seconds(self.interval_hours)

    @property
    def lookback_hours(self) -> float:
        return float(self.lookback_days) * 24.0

    def moment(self) -> Column:
        return F.to_timestamp(F.lit(self.as_of.strftime("%Y-%m-%d %H:%M:%S.%f")))


def liquidity_snapshot(prefix: str = "gamma_") -> list[Column]:
    """Volume and liquidity at listing time; unreadable or blank is missing."""
    names = {
        "volume_num": "volumeNum", "liquidity_num": "liquidityNum",
        "volume": "volume", "liquidity_clob": "liquidityClob",
    }
    return [to_double(F.col(raw)).alias(prefix + name) for name, raw in names.items()]


def select_markets(listing: DataFrame, cfg: ActiveSettings) -> DataFrame:
    """One row per selected (market, category), with everything later steps need."""
    picked = top_markets_per_category(
        listing, cfg.per_category, cfg.min_volume, cfg.min_liquidity, cfg.max_scan
    )
    now = cfg.moment()
    start = to_timestamp(F.col("startDate"))
    return picked.select(
        *IDENTITY, "category_ord", "token_id", "question", "startDate", "endDate",
        "volumeNum", "liquidityNum", *liquidity_snapshot(),
        F.coalesce(start, window_start(F.lit(None).cast("timestamp"), now, cfg.lookback_hours)).alias("start_ts"),
        to_timestamp(F.col("endDate")).alias("end_ts"),
    ).withColumn("line", F.concat_ws("|", "token_id", F.unix_micros("start_ts")))


def listed_categories(listing: DataFrame) -> DataFrame:
    """The category columns of all listings, once each, whether any of them is acceptable or not."""
    return listing.select("tag_id", "classifier_label", "tag_slug").distinct()


def price_lines(selected: DataFrame) -> DataFrame:
    """What history work depends on, once each: the token and the start of the selected rows.

    One market id may be listed under several categories with other tokens or times. Rows that
    share both share one line, whose key stands as ``market_id`` in the operators on histories.
    """
    return selected.select(
        F.col("line").alias("market_id"), "token_id", "start_ts"
    ).dropDuplicates(["market_id"])


def market_buckets(points: DataFrame, markets: DataFrame, n_markets: int, cfg: ActiveSettings) -> DataFrame:
    """Bucket rows of each market in the one resolution it should use, chosen on raw points."""
    inside = in_history_window(points, markets, cfg.moment(), cfg.lookback_hours, n_markets)
    clean = finest_resolution(inside, "market_id", n_markets)
    return G.bucket_stats(clean, ["market_id", "resolution"], cfg.step)


def market_grid(markets: DataFrame, buckets: DataFrame, cfg: ActiveSettings) -> DataFrame:
    """Grid rows per market with axes, anchored prices and bucket activity."""
    now = cfg.moment()
    lines = G.spine(
        markets.select("market_id", "start_ts"),
        window_start(F.col("start_ts"), now, cfg.lookback_hours), now, cfg.step,
    )
    grid = G.fill_grid(lines, buckets.drop("resolution"), ["market_id"])
    return G.anchor_prices(G.grid_axes(grid, F.col("start_ts"), cfg.step), ["market_id"])


def market_features(
    markets: DataFrame, n_markets: int, buckets: DataFrame, books: DataFrame | None,
    cfg: ActiveSettings,
) -> DataFrame:
    """One row per price line with its unscaled features and book summary.

    All joins here are between tables of one row per line. The time to close is left to the
    selected row, whose end date it needs.
    """
    raw = buckets.groupBy("market_id").agg(F.sum("raw_prints_in_bucket").alias("clob_points_raw"))
    # Only rows with a price count here, and every bucket lies on the grid: no spine is unfolded.
    priced = G.anchor_prices(buckets, ["market_id"])
    anchors = priced.groupBy("market_id").agg(F.max("price_norm_anchor").alias("price_norm_anchor"))
    jumps = jump_features(priced, ["market_id"])
    now = cfg.moment()
    opens = window_start(F.col("start_ts"), now, cfg.lookback_hours)
    out = (
        markets.select(
            "market_id", "token_id", G.spine_rows(opens, now, cfg.step).alias("grid_rows")
        )
        .join(raw, "market_id", "left")
        .join(anchors, "market_id", "left")
        .join(jumps, "market_id", "left")
        .withColumn("clob_points_raw", F.coalesce(F.col("clob_points_raw"), F.lit(0)))
    )
    if books is not None and cfg.use_books:
        wanted = out.select("token_id").distinct()
        held = join_small(books, wanted, ["token_id"], "left_semi", n_markets)
        out = out.join(summarize_books(latest_books(held)), "token_id", "left")
    else:
        out = out.withColumns({c: F.lit(None).cast("double") for c in BOOK_COLUMNS}).withColumn(
            "ob_timestamp_ms", F.lit("")
        )
    features = {
        "feat_raw_prints_per_hour": prints_per_hour(F.col("clob_points_raw"), cfg.lookback_hours),
        **book_features(
            F.col("ob_mid"), F.col("ob_spread"), F.col("ob_imbalance_topn"),
            F.col("ob_bid_depth_topn"), F.col("ob_ask_depth_topn"),
        ),
    }
    return (
        out.withColumns(features)
        .withColumn("ob_timestamp_ms", F.coalesce(F.col("ob_timestamp_ms"), F.lit("")))
        .drop("token_id")
        .withColumnRenamed("market_id", "line")
    )


# What is counted over the price lines.
COVERAGE = {"lines_with_data": "clob_points_raw > 0", "lines_total": "true"}


@dataclass(frozen=True)
class ActiveTables:
    """Outputs over staged tables; ``grid`` and ``features`` are per price line and unscaled."""

    selected: DataFrame
    grid: DataFrame
    features: DataFrame
    n_selected: int
    cfg: ActiveSettings
    categories: DataFrame
    counts: dict[str, int]

    def _with_market_columns(self, columns: list[str]) -> DataFrame:
        """Selected rows with columns of their price line and their own time to close."""
        own = [c for c in columns if c != "feat_time_to_close_hours"]
        joined = join_small(
            self.selected, self.features.select("line", "n_valid", *own), ["line"], "left",
            self.n_selected,
        )
        to_close = hours_between(self.cfg.moment(), F.col("end_ts"))
        # Below two valid prices the time to close is missing too.
        return joined.withColumn("feat_time_to_close_hours", F.when(F.col("n_valid") >= 2, to_close))

    def shortfall(self) -> DataFrame:
        """Found and wanted markets of each category; those without an acceptable market count 0."""
        return shortfall(self.selected, self.categories, "tag_id", self.cfg.per_category)

    def coverage(self) -> DataFrame:
        """One row: how many price lines of the selection have any print in the window.

        They were counted while the features were written.
        """
        names = list(COVERAGE)
        return self.selected.sparkSession.createDataFrame(
            [tuple(self.counts[n] for n in names)], ", ".join(f"{n} long" for n in names)
        )

    def scaled_features(self) -> DataFrame:
        own = self._with_market_columns(list(ACTIVE_FEATURES)).select(*IDENTITY, *ACTIVE_FEATURES)
        return zscore(own, list(ACTIVE_FEATURES))

    def metadata(self) -> DataFrame:
        cfg = self.cfg
        note = "snapshot_at_fetch_not_historical" if cfg.use_books else "disabled"
        extra = ["clob_points_raw", "grid_rows", "price_norm_anchor", *BOOK_COLUMNS, "ob_timestamp_ms",
                 *ACTIVE_FEATURES]
        return self._with_market_columns(extra).select(
            *IDENTITY, "question", "startDate", "endDate",
            to_double(F.col("volumeNum")).alias("volumeNum"),
            to_double(F.col("liquidityNum")).alias("liquidityNum"),
            F.lit(float(cfg.interval_hours)).alias("interval_hours"),
            F.lit(float(cfg.lookback_days)).alias("lookback_days"),
            F.lit(cfg.lookback_hours).alias("lookback_hours_used"),
            "clob_points_raw", "grid_rows",
            F.lit(step_label(cfg.step)).alias("grid_freq"),
            F.lit(note).alias("ob_note"),
            "price_norm_anchor",
            "gamma_volume_num", "gamma_liquidity_num", "gamma_volume", "gamma_liquidity_clob",
            *BOOK_COLUMNS, "ob_timestamp_ms", *ACTIVE_FEATURES,
        )

    def raw_grid(self) -> DataFrame:
        """One row per (market, category, step); markets without a grid get a noted placeholder."""
        cfg = self.cfg
        books = [*BOOK_COLUMNS, "ob_timestamp_ms"]
        heads = self._with_market_columns(books)
        body = self.grid.drop("start_ts", "price_norm_anchor").withColumnRenamed("market_id", "line")
        rows = G.with_placeholders(heads, body, ["line"], "no_clob_in_window")
        return rows.withColumns(
            {
                "timestamp_iso": iso_of_seconds(F.col("unix_ts")),
                "gamma_market_start_iso": iso_utc(F.col("start_ts")),
                "grid_interval": F.lit(step_label(cfg.step)),
                "interval_hours": F.lit(float(cfg.interval_hours)),
                "lookback_days": F.lit(float(cfg.lookback_days)),
            }
        ).select(*RAW_GRID.names)


def build(
    listing: DataFrame, points: DataFrame, books: DataFrame | None, cfg: ActiveSettings,
    categories: DataFrame | None = None,
) -> ActiveTables:
    """All outputs as tables over one staged selection; the staging jobs run here.

    ``listing`` is one row per (market, tag) with the category columns, ``points`` the price
    history, ``books`` snapshots, of which the latest of each token counts. ``categories`` (``tag_id``, ``classifier_label``,
    ``tag_slug``) are those wanted, by default all that the listing has. Three tables feed several branches and are written
    once: the selection and the features (one row per selected market) and the buckets (at most
    one row per selected market and step). The counted selection is the size bound that later
    joins check before they broadcast it. History work runs once per distinct token and start.
    """
    prepare(listing.sparkSession)
    wanted = staged(listed_categories(listing if categories is None else categories), "categories")
    selected = staged(select_markets(listing, cfg), "selected")
    markets = price_lines(selected)
    n = selected.count()
    buckets = staged(market_buckets(points, markets, n, cfg), "buckets")
    grid = market_grid(markets, buckets, cfg)
    features, counts = staged_with_counts(
        market_features(markets, n, buckets, books, cfg), "features",
        {name: F.count_if(F.expr(rule)) for name, rule in COVERAGE.items()},
    )
    return ActiveTables(selected, grid, features, n, cfg, wanted, counts)


def run(
    listing: DataFrame, points: DataFrame, books: DataFrame | None, cfg: ActiveSettings, out: str,
    categories: DataFrame | None = None, resume: str | None = None,
) -> None:
    """Publish raw grid, metadata and scaled features under ``out``; empty tables keep their schema.

    ``resume`` (:func:`tapeloom.session.job_name`) lets a run that was killed go on where it was.
    """
    spark = listing.sparkSession
    with staging(spark, resume):
        tables = build(listing, points, books, cfg, categories)
        scaled, metadata = tables.scaled_features(), tables.metadata()
        if not tables.n_selected:
            scaled = spark.createDataFrame([], FEATURES)
        keys = ["market_id", "tag_id"]
        publish_aligned(scaled, metadata, (f"{out}/features", f"{out}/metadata"), keys)
        publish(tables.shortfall(), f"{out}/shortfall")
        publish(tables.coverage(), f"{out}/coverage")
        publish(tables.raw_grid(), f"{out}/raw_grid")
