"""The composed jobs end to end on the shared tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from catalog import queries as CQ
from catalog import tables as X
from tapeloom.sinks.publish import current
from tapeloom.operators import networks as N
from tapeloom.operators import selection as S
from tapeloom.plans import active, closed, components, embeddings
from tapeloom.schemas import ACTIVE_FEATURES, IDENTITY, RAW_GRID


@pytest.fixture(scope="module")
def published(spark, sf, tmp_path_factory):
    """The active job's outputs, which the two report jobs read."""
    out = str(tmp_path_factory.mktemp("active"))
    cfg = replace(CQ.ACTIVE, per_category=100, lookback_days=30.0)
    active.run(X.listing(spark, sf), X.points(spark, sf), CQ.books(spark, sf), cfg, out)
    return out, cfg


def read(spark, path):
    return spark.read.parquet(current(spark, path))


def test_active_outputs(spark, published):
    out, cfg = published
    features, metadata, grid = (read(spark, f"{out}/{n}") for n in ("features", "metadata", "raw_grid"))
    assert features.columns == [*IDENTITY, *ACTIVE_FEATURES]
    assert grid.columns == RAW_GRID.names
    assert [(f.name, f.dataType) for f in grid.schema] == [(f.name, f.dataType) for f in RAW_GRID]
    assert features.count() == metadata.count() > 10
    per_market = metadata.groupBy("market_id", "tag_id").count().agg(F.max("count")).first()[0]
    assert per_market == 1
    sizes = grid.groupBy("market_id", "tag_id").count()
    wrong = sizes.join(metadata, ["market_id", "tag_id"]).where("count <> grid_rows").count()
    assert wrong == 0
    top = features.agg(*[F.round(F.avg(c), 6).alias(c) for c in ACTIVE_FEATURES]).first()
    assert all(abs(top[c]) < 1e-6 for c in ACTIVE_FEATURES)


def test_active_without_books_or_markets(spark, sf):
    cfg = replace(CQ.ACTIVE, use_books=False, per_category=5)
    row = active.build(CQ._open(spark, sf), X.points(spark, sf), None, cfg).metadata().first()
    assert row.ob_note == "disabled" and row.ob_mid is None and row.ob_timestamp_ms == ""
    none = active.build(CQ._open(spark, sf).limit(0), X.points(spark, sf), None, cfg)
    assert none.scaled_features().count() == 0 and none.raw_grid().count() == 0


def test_closed_outputs(spark, sf, tmp_path):
    out = str(tmp_path)
    sports = S.sport_table(spark, X.SPORTS)
    inputs = (X.events(spark, sf), X.closed_listing(spark, sf), X.points(spark, sf), sports)
    cfg = replace(CQ.CLOSED, minute_grid=True)
    closed.run(*inputs, cfg, out)
    features, metadata, rows = (read(spark, f"{out}/{n}") for n in ("features", "metadata", "raw_segments"))
    assert features.count() == metadata.count() > 5
    # A market may be picked for two sports.
    assert rows.select("market_id", "sport").distinct().count() == metadata.count()
    found = rows.where("unix_ts IS NOT NULL")
    assert found.where("unix_ts % 60 <> 0 OR price_primary_token IS NULL").count() == 0
    assert rows.where("(note = '') <> (unix_ts IS NOT NULL)").count() == 0
    with pytest.raises(ValueError):
        closed.run(inputs[0].limit(0), inputs[1].limit(0), *inputs[2:], cfg, out)


def test_component_report(spark, published, tmp_path):
    out, _ = published
    features, metadata = read(spark, f"{out}/features"), read(spark, f"{out}/metadata")
    excluded = features.select("market_id").limit(1)
    cfg = components.ReportSettings(categories={"building", "furniture"}, distance_rows=10)
    components.run(features, cfg, str(tmp_path), excluded=excluded, metadata=metadata)
    kept = features.where("lower(classifier_label) IN ('building', 'furniture')").join(excluded, "market_id", "left_anti")
    points = read(spark, f"{tmp_path}/points")
    assert points.count() == kept.count()
    dropped = spark.read.text(current(spark, f"{tmp_path}/dropped_ids")).count()
    assert dropped == features.where("lower(classifier_label) NOT IN ('building', 'furniture')").count()
    scree = read(spark, f"{tmp_path}/scree")
    assert scree.count() == 19 and abs(scree.agg(F.max("cumulative_ratio")).first()[0] - 1) < 1e-9
    assert read(spark, f"{tmp_path}/loadings").count() == 19 * 19
    assert read(spark, f"{tmp_path}/distances").count() == 100
    ordered = read(spark, f"{tmp_path}/time_ordered")
    assert sorted(r["rank"] for r in ordered.collect()) == list(range(kept.count()))
    best = read(spark, f"{tmp_path}/correlations").groupBy("target").count().collect()
    assert all(r["count"] <= 8 for r in best)
    with pytest.raises(ValueError):
        components.ReportSettings(distance_space="other")


def test_embedding_job_reads_the_published_grid(spark, published, tmp_path):
    out, _ = published
    raw = read(spark, f"{out}/raw_grid")
    cfg = embeddings.EmbeddingSettings(
        mode="all", training=N.Training(h1=6, h2=4, epochs=2), categories=X.CATEGORIES
    )
    embeddings.run(raw, cfg, str(tmp_path))
    sizes = {kind: read(spark, f"{tmp_path}/{kind}_embeddings").count() for kind in ("ae", "semi", "cvae")}
    kept = raw.where("price_yes IS NOT NULL").groupBy("market_id").agg(F.countDistinct("lookback_step").alias("n"))
    assert set(sizes.values()) == {kept.where("n >= 8").count()}
    assert read(spark, f"{tmp_path}/cvae_metrics").first().mse > 0


def test_one_id_under_two_categories_with_other_payloads(spark, sf):
    """Each listed row is described by its own token, times and book."""
    row = dict(id="m", question="q", startDate="2024-01-20T00:00:00Z", volumeNum="9", liquidityNum="9",
               volume="1", liquidityClob="1")
    one = {**row, "clobTokenIds": '["x"]', "endDate": "2024-02-01T00:00:00Z", "tag_id": "1", "classifier_label": "A", "tag_slug": "a", "category_ord": 0}
    two = {**row, "clobTokenIds": '["y"]', "endDate": "2024-03-01T00:00:00Z", "tag_id": "2", "classifier_label": "B", "tag_slug": "b", "category_ord": 1}
    listing = spark.createDataFrame([one, two])
    base = 1706600000
    points = spark.createDataFrame(
        [(tok, "1m", i, base + i * 1800, p + i / 100) for tok, p in (("x", 0.1), ("y", 0.8)) for i in range(4)],
        "token_id string, resolution string, extract_ord bigint, t bigint, price double",
    )
    cfg = active.ActiveSettings(as_of=X.AS_OF, min_volume=0.0, min_liquidity=0.0)
    tables = active.build(listing, points, None, cfg)
    rows = {r.tag_id: r for r in tables.metadata().collect()}
    assert (rows["1"].price_norm_anchor, rows["2"].price_norm_anchor) == (0.1, 0.8)
    assert (rows["1"].feat_time_to_close_hours, rows["2"].feat_time_to_close_hours) == (24.0, 720.0)
    grid = tables.raw_grid().where("price_yes IS NOT NULL").groupBy("tag_id").agg(F.min("price_yes").alias("p")).collect()
    assert {r.tag_id: r.p for r in grid} == {"1": 0.1, "2": 0.8}


def test_jobs_report_shortfall_and_coverage(spark, published):
    out, _ = published
    short = read(spark, f"{out}/shortfall")
    assert {"classifier_label", "found", "wanted", "short"} <= set(short.columns) and short.count() > 0
    seen = read(spark, f"{out}/coverage").first()
    assert 0 < seen.lines_with_data <= seen.lines_total


def test_a_category_of_refused_listings_is_short(spark, tmp_path):
    row = dict(question="q", startDate="2024-01-20T00:00:00Z", endDate="2024-02-01T00:00:00Z", volumeNum="9",
               liquidityNum="9", volume="1", liquidityClob="1", clobTokenIds='["x"]')
    one = {**row, "id": "m", "tag_id": "1", "classifier_label": "A", "tag_slug": "a", "category_ord": 0}
    low = {**row, "id": "n", "tag_id": "2", "classifier_label": "B", "tag_slug": "b", "category_ord": 1, "volumeNum": "1"}
    listing = spark.createDataFrame([one, low, {**low, "id": "o", "volumeNum": None}])
    points = spark.createDataFrame([], "token_id string, resolution string, extract_ord bigint, t bigint, price double")
    cfg = active.ActiveSettings(as_of=X.AS_OF, min_volume=5.0, min_liquidity=0.0, per_category=1)
    found = {"1": (1, 1, False), "2": (0, 1, True)}
    none = spark.createDataFrame([("3", "C", "c", 2)], "tag_id string, classifier_label string, tag_slug string, category_ord int")
    given = listing.select(none.columns).unionByName(none)
    for i, (categories, want) in enumerate([(None, found), (given, {**found, "3": (0, 1, True)})]):
        active.run(listing, points, None, cfg, f"{tmp_path}/{i}", categories)
        rows = read(spark, f"{tmp_path}/{i}/shortfall").collect()
        assert len(rows) == len(want)
        assert {r.tag_id: (r.found, r.wanted, r.short) for r in rows} == want
