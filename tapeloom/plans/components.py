"""Component report on a feature table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tapeloom.operators.categories import exclude_ids, split_by_category, with_question
from tapeloom.operators.components import (
    COMPONENT_CAP, Components, correlations, fit_components, numeric_columns,
    scores_by_order, top_correlations,
)
from tapeloom.operators.distances import SAMPLE_ROWS, SCORE_DIMENSIONS, pairwise_distances
from tapeloom.schemas import IDENTITY
from tapeloom.session import prepare, staged, staging
from tapeloom.sinks.publish import publish, publish_ids


@dataclass(frozen=True)
class ReportSettings:
    categories: set[str] | None = None
    component_cap: int = COMPONENT_CAP
    distance_space: str = "latent"
    distance_dimensions: int = SCORE_DIMENSIONS
    distance_rows: int = SAMPLE_ROWS
    time_column: str = "feat_time_to_close_hours"

    def __post_init__(self):
        if self.distance_space not in ("latent", "raw"):
            raise ValueError("distance_space must be 'latent' or 'raw'")


@dataclass(frozen=True)
class Report:
    """Lazy report tables."""

    fitted: Components
    scored: DataFrame
    dropped: DataFrame
    cfg: ReportSettings

    def points(self) -> DataFrame:
        """First two scores with identity and question, one row per market and category."""
        return self.scored.select("PC1", "PC2", *IDENTITY, "question")

    def correlations(self) -> DataFrame:
        return top_correlations(correlations(self.scored, self.fitted.columns, ["PC1", "PC2"]))

    def time_ordered(self) -> DataFrame:
        """Scores ranked by time to close; without that column, the strongest features instead."""
        if self.cfg.time_column in self.scored.columns:
            return scores_by_order(self.scored, self.cfg.time_column)
        return self.fitted.top_features()

    def distances(self) -> DataFrame:
        k = max(1, min(self.cfg.distance_dimensions, len(self.fitted.loadings)))
        latent = [f"PC{i + 1}" for i in range(k)]
        columns = latent if self.cfg.distance_space == "latent" else self.fitted.columns
        return pairwise_distances(self.scored, columns, self.cfg.distance_rows)


def build(
    features: DataFrame,
    cfg: ReportSettings,
    excluded: DataFrame | None = None,
    metadata: DataFrame | None = None,
    metadata_order: list[str] | None = None,
) -> Report:
    """Keep categories, drop listed ids, fit, score.

    The kept rows and their scores feed several jobs, so each is written once.
    """
    prepare(features.sparkSession)
    kept, dropped = split_by_category(features, cfg.categories)
    used = kept if excluded is None else exclude_ids(kept, excluded)
    # The fit and the scores both read the rows.
    used = staged(used, "report-rows")
    fitted = fit_components(used, numeric_columns(used), cfg.component_cap)
    if metadata is not None:
        used = with_question(used, metadata, metadata_order or ["tag_id"])
    elif "question" not in used.columns:
        used = used.selectExpr("*", "'' AS question")
    return Report(fitted, staged(fitted.scores(used), "scores"), dropped, cfg)


def run(features: DataFrame, cfg: ReportSettings, out: str, resume: str | None = None, **inputs) -> None:
    with staging(features.sparkSession, resume):
        report = build(features, cfg, **inputs)
        publish(report.points(), f"{out}/points")
        publish(report.fitted.scree(), f"{out}/scree")
        publish(report.fitted.loading_table(), f"{out}/loadings")
        publish(report.correlations(), f"{out}/correlations")
        publish(report.time_ordered(), f"{out}/time_ordered")
        publish(report.distances(), f"{out}/distances")
        publish_ids(report.dropped, f"{out}/dropped_ids")
