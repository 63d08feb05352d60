import pytest
from conftest import all_near
from pyspark.sql import functions as F

from tapeloom.functions import jsontext as J
from tapeloom.functions import lenient as C
from tapeloom.functions import listing as L
from tapeloom.functions import prices as P
from tapeloom.functions import timegrid as TG


def texts(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")


def column(df, expr):
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def test_to_double_is_lenient(spark):
    df = texts(spark, ["1.5", " 2 ", "", None, "n/a", "nan", "1d", "3f", "-1e3", "inf"])
    assert column(df, C.to_double(F.col("s"))) == [
        1.5, 2.0, None, None, None, None, None, None, -1000.0, float("inf")
    ]


def test_to_timestamp_is_lenient(spark):
    df = texts(spark, ["2024-01-31T00:00:00Z", "2024-01-31T02:00:00+02:00", "soon", "", None])
    assert column(df, F.unix_seconds(C.to_timestamp(F.col("s")))) == [1706659200, 1706659200, None, None, None]


def test_finite_or_zero(spark):
    df = texts(spark, ["1", "nan", "inf", "-inf", None])
    assert column(df, C.finite_or_zero(F.col("s").try_cast("double"))) == [1.0, 0.0, 0.0, 0.0, 0.0]


def test_text_array_reads_json_encoded_once_or_twice(spark):
    df = texts(spark, ['["a","b"]', '"[1,2]"', "not json", "", None, "[]"])
    assert column(df, J.text_array(F.col("s"))) == [["a", "b"], ["1", "2"], None, None, None, []]
    assert column(df, J.first_item(F.col("s"))) == ["a", "1", None, None, None, None]


def test_logit_clips(spark):
    df = spark.createDataFrame([(0, 0.2), (1, 0.6), (2, 0.9995), (3, None)], "i int, p double")
    got = column(df, P.logit(F.col("p")))
    assert all_near(got, [-1.386294361, 0.405465108, 6.906754779, None])


def test_valid_price_excludes_bounds_and_missing(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 0.5), (3, None)], "i int, p double")
    assert column(df, P.is_valid_price(F.col("p"))) == [False, False, True, False]


def test_steps():
    assert TG.step_seconds(0.5) == 1800 and TG.step_label(1800) == "30min"
    assert TG.step_seconds(2) == 7200 and TG.step_label(7200) == "2h"
    for bad in (0, -1, 0.0001, 1 / 7):
        with pytest.raises(ValueError):
            TG.step_seconds(bad)


def test_floor_and_ceil(spark):
    df = spark.createDataFrame([(0, 3600), (1, 3601), (2, 7199)], "i int, t bigint")
    assert column(df, TG.floor_to(F.col("t"), 3600)) == [3600, 3600, 3600]
    assert column(df, TG.ceil_to(F.col("t"), 3600)) == [3600, 7200, 7200]
    parts = spark.sql("SELECT 0 i, timestamp'2024-01-01 00:00:00.5' ts UNION ALL SELECT 1, timestamp'2024-01-01 00:00:01'")
    assert column(parts, TG.ceil_second(F.col("ts"))) == [1704067201, 1704067201]
    assert column(parts, TG.floor_second(F.col("ts"))) == [1704067200, 1704067201]


def test_head_to_head_titles(spark):
    titles = [
        "Lakers vs. Celtics", "A vs B", "Will X win?", "Spread: Lakers vs. Celtics",
        "Lakers vs. Celtics: O/U 220", None, "Lakers VS Celtics vs Heat", "o/u game vs. other",
        "Lakers versus Celtics", "Lakers vs. Spread: Celtics", "  Jazz vs. Heat  ",
    ]
    want = [True, False, False, False, False, False, True, False, False, False, True]
    assert column(texts(spark, titles), L.is_head_to_head(F.col("s"))) == want


def outcomes(spark):
    rows = [
        (0, ["Yes", "No"], ["0.9", "0.1"]),
        (1, ["no", "YES"], ["0.9", "0.1"]),
        (2, ["Lakers", "Heat"], ["0.5", "0.5"]),
        (3, ["Lakers", " "], ["1", "0"]),
        (4, ["Lakers", "Heat"], ["0", "1"]),
        (5, ["Lakers", "Heat"], ["1"]),
        (6, ["A", "B", "C"], ["x", "1", "0"]),
        (7, None, None),
    ]
    return spark.createDataFrame(rows, "i int, o array<string>, p array<string>")


def test_outcome_rules(spark):
    df = outcomes(spark)
    o, p = F.col("o"), F.col("p")
    assert column(df, L.is_yes_no(o)) == [True, True] + [False] * 6
    assert column(df, L.is_moneyline(o)) == [False, False, True, False, True, True, False, False]
    assert column(df, L.primary_index(o)) == [0, 1, 0, 0, 0, 0, 0, 0]
    assert column(df, L.primary_label(o)) == ["Yes", "YES", "Lakers", "Lakers", "Lakers", "Lakers", "A", ""]
    assert column(df, L.resolved_primary(o, p)) == [1, 0, None, 1, 0, None, None, None]


def test_prefilter_counts_unreadable_as_zero(spark):
    df = spark.createDataFrame([(0, "10", "10"), (1, "n/a", "10"), (2, None, None)], "i int, v string, l string")
    assert column(df, L.passes_prefilter(F.col("v"), F.col("l"), 10, 10)) == [True, False, False]
    assert column(df, L.passes_prefilter(F.col("v"), F.col("l"), 0, 0)) == [True, True, True]


def test_market_types(spark):
    df = texts(spark, [" Spreads ", "TOTAL", "moneyline", None])
    assert column(df, L.is_plain_market_type(F.col("s"))) == [False, False, True, True]
