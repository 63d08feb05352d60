"""The shared test tables read as the engine's inputs.

Everything is derived row by row from the given tables, plus one aggregate for the first event
of each customer. ``catalog.oracles`` states the same mapping in SQL.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.lenient import to_double, to_timestamp
from tapeloom.operators.once import with_evaluated
from tapeloom.session import prepare
from tapeloom.sources.listings import parse_events

AS_OF = datetime(2024, 1, 31)
AS_OF_S = 1706659200
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
ISO = "yyyy-MM-dd'T'HH:mm:ss'Z'"
CATEGORIES = tuple((s, str(10 + i), s.lower()) for i, s in enumerate(SEGMENTS))
SPORTS = tuple((s.lower(), str(10 + i), (f"s{i}", f"s{i + 5}")) for i, s in enumerate(SEGMENTS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    return F.to_timestamp(F.lit("2024-01-31 00:00:00"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History points: a customer is a token, an event is a print."""
    return table(spark, sf_dir, "events").selectExpr(
        "CAST(user_id AS STRING) AS token_id",
        """CASE WHEN event_type IN ('view', 'click') THEN '1m'
                WHEN event_type = 'purchase' THEN 'max' ELSE '1h' END AS resolution""",
        "event_id AS extract_ord",
        "unix_seconds(CAST(ts AS TIMESTAMP)) AS t",
        """CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 0D
                WHEN event_id % 89 = 0 THEN 1D ELSE value / (value + 50D) END AS price""",
    )


def _other_tokens():
    """Tokens of another market as JSON text."""
    return F.to_json(F.array((F.col("k") + 7).cast("string"), F.concat(F.col("k"), F.lit("a"))))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One market per customer, with the raw text fields of a listing payload."""
    first = (
        table(spark, sf_dir, "events")
        .groupBy(F.col("user_id").alias("c_custkey"))
        .agg(F.min(F.unix_seconds(F.col("ts").cast("timestamp"))).alias("first_s"))
    )
    base = (
        table(spark, sf_dir, "customer")
        .join(first, "c_custkey", "left")
        .selectExpr(
            "c_custkey AS k", "c_name AS name", "c_nationkey AS nk", "c_acctbal AS bal",
            "c_mktsegment AS seg",
            "coalesce(first_s, 1704067200 + (c_custkey % 20) * 86400) AS start_s",
        )
        .selectExpr(
            "*",
            """start_s - start_s % 3600 + (5 + k % 26) * 86400
               + CASE WHEN k % 4 = 3 THEN 1020 ELSE 0 END AS end_s""",
            "concat('Nation ', nk) AS rival",
        )
    )
    start = F.date_format(F.timestamp_seconds("start_s"), ISO)
    end = F.date_format(F.timestamp_seconds("end_s"), ISO)
    named = base.withColumn("iso_start", start).withColumn("iso_end", end).selectExpr(
        "*",
        """CASE k % 6 WHEN 0 THEN (CASE WHEN k % 5 = 1 THEN concat(name, '\u00a0vs.\u00a0', rival)
             ELSE concat(name, ' vs. ', rival) END) WHEN 1 THEN concat(name, ' vs ', rival)
             WHEN 2 THEN concat('Will ', name, ' win?')
             WHEN 3 THEN concat('Spread: ', name, ' vs. ', rival)
             WHEN 4 THEN concat(name, ' vs. ', rival, ': O/U 5') END AS question""",
        """CASE WHEN (k DIV 6) % 4 = 0 THEN (CASE WHEN k % 2 = 0 THEN array('Yes', 'No') ELSE array('No', 'Yes') END)
             WHEN k % 29 = 3 THEN array(' ', rival) ELSE array(name, rival) END AS names""",
        """CASE WHEN k % 11 = 0 THEN array('0.5', '0.5') WHEN k % 11 = 1 THEN array('1')
             WHEN k % 11 = 2 THEN array('x', '1') WHEN k % 11 BETWEEN 3 AND 6 THEN array('0', '1')
             ELSE array('1', '0') END AS finals""",
        """CASE WHEN k % 19 = 6 THEN CAST(array() AS ARRAY<STRING>) WHEN k % 19 = 7 THEN array(CAST(k AS STRING))
             ELSE array(CAST(k AS STRING), concat(k, 'n')) END AS toks""",
    )
    twice = r"""concat('"', replace(to_json({c}), '"', '\\"'), '"')"""

    def text(column: str, odd: int) -> str:
        return f"CASE WHEN k % 2 = {odd} THEN {twice.format(c=column)} ELSE to_json({column}) END"

    rows = named.selectExpr(
        "k", "nk", "seg", "name", "rival", "start_s", "end_s",
        "CASE WHEN k % 211 = 0 THEN ' ' ELSE CAST(k AS STRING) END AS id",
        "question",
        "CASE WHEN k % 20 = 7 THEN NULL WHEN k % 20 = 8 THEN 'soon' ELSE iso_start END AS startDate",
        "CASE WHEN k % 20 = 9 THEN '' ELSE iso_end END AS endDate",
        f"CASE WHEN k % 19 = 5 THEN NULL WHEN k % 19 = 8 THEN 'not json' ELSE {text('toks', 1)} END AS clobTokenIds",
        f"{text('names', 1)} AS outcomes",
        f"{text('finals', 0)} AS outcomePrices",
        "CASE k % 9 WHEN 0 THEN 'spreads' WHEN 1 THEN ' Totals ' WHEN 2 THEN NULL ELSE 'moneyline' END AS sportsMarketType",
        "CASE k % 8 WHEN 0 THEN ' ' WHEN 1 THEN NULL ELSE lower(seg) END AS category",
        """CASE WHEN k % 17 = 4 THEN '' WHEN k % 23 = 9 THEN 'n/a' WHEN k % 31 = 7 THEN 'nan'
             ELSE CAST(bal AS STRING) END AS volumeNum""",
        "CASE WHEN k % 13 = 5 THEN NULL ELSE CAST(bal / 2D AS STRING) END AS liquidityNum",
        "CAST(bal * 2D AS STRING) AS volume",
        "CAST(bal / 4D AS STRING) AS liquidity",
        "CASE WHEN k % 14 = 3 THEN '' ELSE CAST(bal / 8D AS STRING) END AS liquidityClob",
        "'0' AS liquidityAmm",
        "CAST(bal * 4D AS STRING) AS volumeClob",
        "CASE WHEN k % 15 = 2 THEN 'x' ELSE CAST(bal * 8D AS STRING) END AS volume1wkClob",
        "CASE k % 12 WHEN 1 THEN '' WHEN 2 THEN NULL ELSE concat('0.', lpad(k % 90 + 5, 2, '0')) END AS bestBid",
        "CASE k % 12 WHEN 3 THEN '' WHEN 4 THEN NULL ELSE concat('0.', lpad(k % 90 + 8, 2, '0')) END AS bestAsk",
        "k % 7 <> 0 AS active",
        "k % 5 IN (0, 1, 2) AS closed",
    )
    # A listing payload holds these as stored text; here they are made once per row.
    made = ("clobTokenIds", "outcomes", "outcomePrices", "startDate", "endDate")
    return with_evaluated(rows, {c: F.col(c) for c in made})


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (market, category): the customer's segment and one picked by nation."""
    names = F.array(*[F.lit(s) for s in SEGMENTS])
    labels = F.array_distinct(F.array("seg", F.get(names, F.pmod("nk", F.lit(5)))))
    rows = customers(spark, sf_dir).withColumn("classifier_label", F.explode(labels))
    # Under its second category a third of the markets is listed with other tokens and another end.
    other = (F.col("classifier_label") != F.col("seg")) & (F.col("k") % 3 == 0)
    return (
        rows.withColumn("clobTokenIds", F.when(other, _other_tokens()).otherwise(F.col("clobTokenIds")))
        .withColumn(
            "endDate",
            F.when(other, F.date_format(F.timestamp_seconds(F.col("end_s") + 43200), ISO)).otherwise(
                F.col("endDate")
            ),
        )
        .withColumn("category_ord", F.array_position(names, F.col("classifier_label")).cast("int") - 1)
        .withColumn("tag_id", (F.col("category_ord") + 10).cast("string"))
        .withColumn("tag_slug", F.lower("classifier_label"))
    )


def closed_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed markets under the tag of the customer's segment; a quarter with other tokens there."""
    names = F.array(*[F.lit(s) for s in SEGMENTS])
    tag = (F.array_position(names, F.col("seg")) + 9).cast("string")
    tokens = F.when(F.col("k") % 4 == 1, _other_tokens()).otherwise(F.col("clobTokenIds"))
    rows = customers(spark, sf_dir).where("closed").withColumn("tag_id", tag)
    return rows.withColumn("clobTokenIds", tokens)


def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per customer as JSON text, with the market and a variant without a question."""
    rows = customers(spark, sf_dir)
    fields = ["question", "startDate", "endDate", "clobTokenIds", "outcomes", "outcomePrices",
              "sportsMarketType", "category", "volumeNum", "liquidityNum", "volume", "liquidity",
              "liquidityClob", "liquidityAmm", "volumeClob", "volume1wkClob", "bestBid", "bestAsk",
              "active", "closed"]
    main = F.struct("id", *fields)
    variant = F.struct(
        F.concat(F.col("k"), F.lit("x")).alias("id"),
        F.lit(None).cast("string").alias("question"),
        *fields[1:],
    )
    title = F.when(F.col("k") % 16 == 3, F.lit(" ")).otherwise(F.concat("name", F.lit(" vs. "), "rival"))
    return rows.select(
        "k", "end_s", "closed",
        F.to_json(
            F.struct(
                title.alias("title"),
                F.concat(F.lit("s"), F.col("nk") % 10).alias("series_id"),
                F.array(main, variant).alias("markets"),
            )
        ).alias("payload"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed events with nested markets, for the closed-market job."""
    rows = event_payloads(spark, sf_dir).where("closed").select(
        F.col("k").alias("event_id"), F.timestamp_seconds("end_s").alias("end_ts"), "payload"
    )
    return parse_events(rows, "payload")


def market_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(market_id, token_id, start_ts, end_ts, volume_num), one row per customer."""
    return customers(spark, sf_dir).select(
        F.col("k").cast("string").alias("market_id"),
        F.col("k").cast("string").alias("token_id"),
        to_timestamp(F.col("startDate")).alias("start_ts"),
        F.timestamp_seconds("end_s").alias("end_ts"),
        to_double(F.col("volumeNum")).alias("volume_num"),
    )


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-book levels: a supplier is a token, a line item is a level of one of three snapshots."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(l_suppkey AS STRING) AS token_id",
        "CASE WHEN l_linestatus = 'O' THEN 'bid' ELSE 'ask' END AS side",
        """CASE WHEN l_partkey % 37 = 0 THEN NULL WHEN l_linestatus = 'O' THEN 0.5D - l_discount
             ELSE 0.5D + l_tax END AS price""",
        "l_quantity AS size",
        "700 + 500 * (l_orderkey % 3) AS timestamp",
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
    )


LEVEL_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feature table: 64 numeric columns per vector, its label as the category."""
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(
        F.col("vec_id").cast("string").alias("market_id"),
        F.concat(F.lit("label "), F.col("label")).alias("classifier_label"),
        F.col("label").cast("string").alias("tag_id"),
        F.concat(F.lit("label-"), F.col("label")).alias("tag_slug"),
        *[F.get("embedding", i).cast("double").alias(f"f{i + 1}") for i in range(64)],
    )
