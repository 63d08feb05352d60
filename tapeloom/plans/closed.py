"""Closed match-ups: selection, features, streak segments and the segment's prints."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.lenient import blank_to_null, to_double
from tapeloom.functions.timegrid import HOUR, MINUTE, iso_of_seconds, iso_utc
from tapeloom.operators.closedfeatures import closed_features
from tapeloom.operators.history import MERGE_TAIL_SECONDS, dedupe_history, merge_resolutions, sparse_markets
from tapeloom.operators.scaling import zscore
from tapeloom.operators.selection import closed_candidates, select_closed_markets, shortfall
from tapeloom.operators.series import as_of_labels
from tapeloom.operators.streaks import (
    FOUND, SEGMENT_HOURS, SKEW_HIGH, SKEW_LOOKBACK_HOURS, SKEW_LOW,
    detect_streaks, prints_in_segment, segment_note,
)
from tapeloom.schemas import CLOSED_FEATURES
from tapeloom.session import join_small, prepare, staged, staging
from tapeloom.sinks.publish import publish, publish_aligned


@dataclass(frozen=True)
class ClosedSettings:
    """Knobs of the job with their usual defaults; ``as_of`` is explicit so results repeat."""

    as_of: datetime
    per_sport: int = 20
    # Paging limit of a remote listing; none by default: all listings are looked at.
    max_scan: int | None = None
    lookback_hours: float = 72.0
    minute_grid: bool = False
    within_days: float = 30.0
    end_after: datetime | None = None
    end_before: datetime | None = None
    skew_lookback_hours: float = SKEW_LOOKBACK_HOURS
    skew_high: float = SKEW_HIGH
    skew_low: float = SKEW_LOW
    segment_hours: float = SEGMENT_HOURS

    @property
    def merge_hours(self) -> float:
        """The history reaches back ten days at least."""
        return max(float(self.lookback_hours), 240.0)


def _moment(when: datetime | None) -> Column | None:
    return None if when is None else F.to_timestamp(F.lit(when.strftime("%Y-%m-%d %H:%M:%S.%f")))


def metadata_columns(sport: Column, fallback_question: Column) -> list[Column]:
    """Identity and listing facts; a blank category becomes the sport."""
    return [
        F.col("market_id").alias("id"),
        F.coalesce(blank_to_null(F.col("question")), fallback_question).alias("question"),
        F.coalesce(F.when(blank_to_null(F.col("category")).isNotNull(), F.col("category")), sport).alias("category"),
        to_double(F.col("volumeNum")).alias("volumeNum"),
        to_double(F.col("liquidityNum")).alias("liquidityNum"),
        "startDate", "endDate",
        F.to_json("tokens").alias("clobTokenIds"),
        sport.alias("sport_bucket"),
    ]


def trade_context() -> list[Column]:
    """Eight numbers, missing if unreadable, and both best prices as they came."""
    numbers = {
        "volume_num": "volumeNum", "liquidity_num": "liquidityNum", "liquidity": "liquidity",
        "liquidity_clob": "liquidityClob", "liquidity_amm": "liquidityAmm", "volume": "volume",
        "volume_clob": "volumeClob", "volume_1wk_clob": "volume1wkClob",
    }
    return [
        *[to_double(F.col(raw)).alias(name) for name, raw in numbers.items()],
        F.coalesce(F.col("bestBid"), F.lit("")).alias("best_bid"),
        F.coalesce(F.col("bestAsk"), F.lit("")).alias("best_ask"),
    ]


@dataclass(frozen=True)
class ClosedTables:
    """Outputs over staged tables; ``features``, ``streaks`` and ``segment`` are per ``line``."""

    selected: DataFrame
    features: DataFrame
    streaks: DataFrame
    segment: DataFrame
    cfg: ClosedSettings

    def feature_rows(self) -> DataFrame:
        """One row per selected market, features missing where the market cannot be described."""
        heads = self.selected.select(
            "line", "market_id", "sport", F.col("resolved_yes").cast("int").alias("resolved_yes")
        )
        return heads.join(self.features, "line", "left").select(
            "market_id", "sport", "resolved_yes", *CLOSED_FEATURES
        )

    def scaled_features(self) -> DataFrame:
        return zscore(self.feature_rows(), list(CLOSED_FEATURES))

    def metadata(self) -> DataFrame:
        heads = self.selected.join(self.streaks, "line", "left")
        return heads.select(
            *metadata_columns(F.col("sport"), F.col("title_used")),
            F.col("status").alias("skew_segment_status"),
            F.coalesce(iso_of_seconds(F.col("segment_start")), F.lit("")).alias("inferred_game_start_iso"),
            F.coalesce(iso_of_seconds(F.col("segment_end")), F.lit("")).alias("inferred_game_end_iso"),
        )

    def raw_segments(self) -> DataFrame:
        """Segment prints; a market without any keeps one row that says why."""
        found = F.col("status") == FOUND
        heads = self.selected.join(self.streaks, "line").select(
            "line", "market_id", "sport", F.col("title_used").alias("question"), "primary_outcome",
            iso_utc(F.col("start_ts")).alias("gamma_listing_start_iso"),
            iso_utc(F.col("end_ts")).alias("gamma_listing_end_iso"),
            F.coalesce(iso_of_seconds(F.col("segment_start")), F.lit("")).alias("inferred_game_start_iso"),
            F.coalesce(iso_of_seconds(F.col("segment_end")), F.lit("")).alias("inferred_game_end_iso"),
            F.col("status").alias("skew_segment_status"),
            F.when(found, F.lit("1m_after_skew_detect")).otherwise(F.lit("no_1m_segment")).alias("clob_sources"),
            F.lit(self.cfg.minute_grid).alias("minute_grid_ffill"),
            *trade_context(),
        )
        rows = self.segment.select(
            "line",
            iso_of_seconds(F.col("t")).alias("timestamp_iso"),
            F.col("t").alias("unix_ts"),
            F.col("price").alias("price_primary_token"),
            "seconds_since_window_start",
            "seconds_until_window_end",
        )
        note = segment_note(F.col("skew_segment_status"), F.col("unix_ts").isNotNull())
        return heads.join(rows, "line", "left").withColumn("note", note).drop("line")


def _reach_back(cfg: ClosedSettings) -> int:
    """Seconds before an end time from which any step reads points."""
    hours = max(cfg.merge_hours, cfg.skew_lookback_hours + cfg.segment_hours)
    return int(hours * HOUR) + MINUTE


def selected_history(points: DataFrame, markets: DataFrame, n: int, cfg: ClosedSettings) -> DataFrame:
    """Points of the selected tokens, written once.

    The main read takes the hourly and minute points between two constant times, so the bound
    reaches the scan. A second read fetches the older and later hourly points of the sparse
    markets alone, which need their whole hourly history.
    """
    ends = markets.agg(F.min(F.unix_seconds("end_ts")), F.max(F.unix_seconds("end_ts"))).first()
    low, high = (ends[0] or 0) - _reach_back(cfg), (ends[1] or 0) + MERGE_TAIL_SECONDS
    inside = (F.col("t") >= low) & (F.col("t") <= high)
    wanted = markets.select("token_id").distinct()
    near = staged(
        join_small(
            points.where(inside & F.col("resolution").isin("1h", "1m") & F.col("price").isNotNull()),
            wanted, ["token_id"], "left_semi", n,
        ),
        "closed-points",
    )
    sparse = sparse_markets(near, markets, cfg.merge_hours, n)
    tokens = staged(
        markets.join(sparse, "market_id", "left_semi").select("token_id").distinct(), "sparse-tokens"
    )
    if tokens.isEmpty():
        return near
    far = join_small(
        points.where(~inside & (F.col("resolution") == "1h") & F.col("price").isNotNull()),
        tokens, ["token_id"], "left_semi", n,
    )
    return near.unionByName(staged(far, "closed-far-points"))


def build(events: DataFrame, listing: DataFrame, points: DataFrame, sports: DataFrame, cfg: ClosedSettings) -> ClosedTables:
    """All outputs as tables over one staged selection; the staging jobs run here.

    Work on histories is per selected row (market and sport), whose key ``line`` stands as
    ``market_id`` in the operators: one id may be listed with other tokens and times elsewhere.
    """
    prepare(listing.sparkSession)
    candidates = closed_candidates(events, listing, sports, cfg.max_scan)
    selected = staged(
        select_closed_markets(
            candidates, cfg.per_sport, _moment(cfg.as_of), cfg.within_days,
            _moment(cfg.end_after), _moment(cfg.end_before),
        ),
        "closed-selected",
    )
    selected = selected.withColumn("line", F.concat_ws("|", "market_id", "sport"))
    # The counted selection is the size bound that later joins check before they broadcast it.
    n = selected.count()
    markets = selected.select(F.col("line").alias("market_id"), "token_id", "start_ts", "end_ts", "volume_num")
    history = selected_history(points, markets, n, cfg)
    merged = merge_resolutions(history, markets, cfg.merge_hours, n)
    features = staged(closed_features(merged, markets, max_markets=n), "closed-features")
    hourly = history.where("resolution = '1h'")
    minute = history.where("resolution = '1m'")
    streaks = detect_streaks(
        dedupe_history(hourly, ["token_id"]), markets, cfg.segment_hours, cfg.skew_high,
        cfg.skew_low, cfg.skew_lookback_hours, n,
    )
    streaks = staged(streaks, "streaks")
    bounded = streaks.join(markets.select("market_id", "token_id"), "market_id")
    segment = prints_in_segment(dedupe_history(minute, ["token_id"]), bounded, n)
    if cfg.minute_grid:
        segment = _minute_rows(segment, bounded, n)
    by_line = [t.withColumnRenamed("market_id", "line") for t in (features, streaks, segment)]
    return ClosedTables(selected, *by_line, cfg)


def _minute_rows(segment: DataFrame, bounded: DataFrame, max_markets: int) -> DataFrame:
    """Segment prints on a full minute grid, each minute holding the last print before it."""
    held = as_of_labels(segment, ["market_id"], MINUTE, "ceil").where(F.col("price_yes").isNotNull())
    bounds = bounded.select("market_id", "segment_start", "segment_end")
    return join_small(
        held.select("market_id", F.col("unix_ts").alias("t"), F.col("price_yes").alias("price")),
        bounds, ["market_id"], "inner", max_markets,
    ).withColumns(
        {
            "seconds_since_window_start": (F.col("t") - F.col("segment_start")).cast("double"),
            "seconds_until_window_end": (F.col("segment_end") - F.col("t")).cast("double"),
        }
    )


def run(
    events: DataFrame, listing: DataFrame, points: DataFrame, sports: DataFrame, cfg: ClosedSettings, out: str,
    resume: str | None = None,
) -> None:
    """Publish scaled features, metadata and segment rows under ``out``.

    ``resume`` (:func:`tapeloom.session.job_name`) lets a run that was killed go on where it was.
    """
    with staging(events.sparkSession, resume):
        tables = build(events, listing, points, sports, cfg)
        if tables.selected.isEmpty():
            raise ValueError("no closed match-up passed the filters")
        scaled, metadata = tables.scaled_features(), tables.metadata()
        publish_aligned(scaled, metadata, (f"{out}/features", f"{out}/metadata"), ["market_id"], ["id"])
        publish(tables.raw_segments(), f"{out}/raw_segments")
        wanted = sports.select("sport").distinct()
        publish(shortfall(tables.selected, wanted, "sport", cfg.per_sport), f"{out}/shortfall")
