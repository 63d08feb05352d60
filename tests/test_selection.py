import json

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import categories as K
from tapeloom.operators import selection as S
from tapeloom.operators.ranking import hash_sample, top_n_per_group
from tapeloom.schemas import MARKET


def listing(spark, rows):
    """Rows of (tag, id, volume, tokens)."""
    data = [(t, i, v, "5000", k if k is None else json.dumps(k)) for t, i, v, k in rows]
    return spark.createDataFrame(data, "tag_id string, id string, volumeNum string, liquidityNum string, clobTokenIds string")


def test_top_markets_skip_refused_rows_and_keep_order(spark):
    df = listing(spark, [
        ("1", "a", "900", ["ta"]), ("1", "b", "800", None), ("1", " c ", "700", ["tc"]), ("1", "d", "600", ["td"]),
        ("1", " ", "950", ["tx"]), ("1", "e", "n/a", ["te"]), ("2", "a", "900", ["ta"]), ("1", "f", "500", ["tf"]),
    ])
    rows = S.top_markets_per_category(df, 3, 550, 0).orderBy("tag_id", "pick").collect()
    assert [(r.tag_id, r.market_id, r.token_id, r.pick) for r in rows] == [
        ("1", "a", "ta", 1), ("1", "c", "tc", 2), ("1", "d", "td", 3), ("2", "a", "ta", 1)
    ]


def test_repeated_listing_counts_once(spark):
    df = listing(spark, [("1", "a", "900", ["x"]), ("1", "a", "800", ["y"]), ("1", "b", "700", ["z"])])
    rows = S.top_markets_per_category(df, 2, 0, 0).orderBy("pick").collect()
    assert [(r.market_id, r.token_id) for r in rows] == [("a", "x"), ("b", "z")]


def test_scan_cap_counts_refused_rows(spark):
    df = listing(spark, [("1", f"{i:04d}", str(10_000 - i), ["t"] if i >= 150 else None) for i in range(260)])
    assert S.top_markets_per_category(df, 500, 0, 0, 150).count() == 50  # 150 rounds up to 200
    assert S.top_markets_per_category(df, 500, 0, 0, 100).count() == 0


def test_shortfall(spark):
    dims = S.category_table(spark)
    assert dims.count() == 8
    got = S.shortfall(spark.createDataFrame([("1",), ("1",), ("2",)], "tag_id string"), dims, "tag_id", 2)
    found = {r.tag_id: (r.found, r.short) for r in got.collect()}
    assert found["1"] == (2, False) and found["2"] == (1, True) and found["21"] == (0, True)


def test_top_n_of_one_hot_group(spark):
    df = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 7919 % 20_011).alias("v"), "id")
    rows = top_n_per_group(df, ["g"], [F.col("v").desc()], 50, "rank", ["id"]).orderBy("rank").collect()
    want = sorted((i * 7919 % 20_011 for i in range(20_000)), reverse=True)[:50]
    assert [r.v for r in rows] == want and [r["rank"] for r in rows] == list(range(1, 51))


def test_hash_sample_repeats(spark):
    a = {r.id for r in hash_sample(spark.range(500), "id", 80).collect()}
    b = {r.id for r in hash_sample(spark.range(500).repartition(7), "id", 80).collect()}
    assert a == b and len(a) == 80
    assert hash_sample(spark.range(5), "id", 80).count() == 5


BASE = dict(
    question="Lakers vs. Celtics", outcomes='["Lakers","Celtics"]', outcomePrices='["1","0"]',
    clobTokenIds='["t1","t2"]', startDate="2024-01-01T00:00:00Z", endDate="2024-01-20T00:00:00Z", volumeNum="5",
)


def market(**changes):
    row = {**BASE, **changes}
    return tuple(row.get(n) for n in MARKET.names)


def pick(spark, events, markets, per_sport=20, **window):
    sports = S.sport_table(spark, (("nba", "745", ("s1", "s2")),))
    ev = spark.createDataFrame(
        [(i, title, series, end, ms) for i, (title, series, end, ms) in enumerate(events)],
        spark.createDataFrame([], MARKET).select(F.lit(0).alias("event_id"), F.lit("").alias("title"), F.lit("").alias("series_id"), F.lit("").alias("e"), F.array(F.struct(*MARKET.names)).alias("markets")).schema,
    ).withColumn("end_ts", F.to_timestamp("e"))
    ls = spark.createDataFrame(markets, MARKET).withColumn("tag_id", F.lit("745"))
    as_of = F.to_timestamp(F.lit("2024-01-31 00:00:00"))
    rows = S.select_closed_markets(S.closed_candidates(ev, ls, sports), per_sport, as_of, **window)
    return [r.market_id for r in rows.orderBy("pick").collect()]


def test_closed_selection_order_and_dedupe(spark):
    events = [
        ("A1 vs. B1", "s2", "2024-01-09 00:00:00", [market(id="4")]),
        ("Old vs. Game", "s1", "2024-01-05 00:00:00", [market(id="3", question=None)]),
        ("New vs. Game", "s1", "2024-01-09 00:00:00", [market(id="1"), market(id="2", question=" ")]),
        ("Other", "s9", "2024-01-09 00:00:00", [market(id="9")]),
    ]
    markets = [market(id="1"), market(id="6", endDate="2024-01-18T00:00:00Z"), market(id="5", endDate="2024-01-19T00:00:00Z")]
    assert pick(spark, events, markets) == ["1", "2", "3", "4", "5", "6"]
    assert pick(spark, events, markets, per_sport=2) == ["1", "2"]


@pytest.mark.parametrize("changes", [
    dict(sportsMarketType="Spreads "), dict(question="Will Lakers win?"), dict(outcomes='["Yes","No"]'),
    dict(outcomePrices='["0.5","0.5"]'), dict(outcomePrices='["1"]'), dict(outcomePrices="not json"),
    dict(clobTokenIds='["t1"]'), dict(startDate=None), dict(endDate="soon"), dict(endDate="2024-01-31T00:00:00Z"),
    dict(endDate="2023-12-31T23:59:59Z"), dict(id=" "),
])
def test_closed_selection_refuses(spark, changes):
    assert pick(spark, [], [market(**{"id": "1", **changes})]) == []


def test_closed_end_bounds_are_half_open(spark):
    at = lambda text: F.to_timestamp(F.lit(text))
    one = [market(id="1")]
    assert pick(spark, [], one, after=at("2024-01-20 00:00:00")) == ["1"]
    assert pick(spark, [], one, before=at("2024-01-20 00:00:00")) == []
    old = [market(id="1", endDate="2020-01-01T00:00:00Z")]
    assert pick(spark, [], old) == [] and pick(spark, [], old, within_days=0) == ["1"]


def test_categories(spark):
    assert K.parse_categories(" Pop culture;TECH ,, ") == {"pop culture", "tech"}
    assert K.parse_categories(" ; ") is None and K.parse_categories(None) is None
    df = spark.createDataFrame([("1", " Tech "), ("2", "Sports"), ("3", None)], "market_id string, classifier_label string")
    kept, dropped = K.split_by_category(df, {"tech"})
    assert [r.market_id for r in kept.collect()] == ["1"]
    assert sorted(r.market_id for r in dropped.collect()) == ["2", "3"]
    everything, nothing = K.split_by_category(df, None)
    assert everything.count() == 3 and nothing.count() == 0


def test_exclusion_and_questions(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "a")], "market_id string, tag_id string")
    ids = spark.createDataFrame([("1",), ("1",), ("7",)], "market_id string")
    assert [r.market_id for r in K.exclude_ids(df, ids).collect()] == ["2"]
    assert K.excluded_count(df, ids).first().n_excluded == 2
    meta = spark.createDataFrame([("1", "second", 1), ("1", "first", 0)], "market_id string, question string, o int")
    got = {(r.market_id, r.tag_id, r.question) for r in K.with_question(df, meta, ["o"]).collect()}
    assert got == {("1", "a", "first"), ("1", "b", "first"), ("2", "a", "")}
