"""A store of price points that new extracts are added to.

The store is a bucketed Parquet table: points of one token and period share a bucket, and each
added extract is sorted by token and time inside its bucket. Adding reads, shuffles and writes the new
points only. Reading groups by columns that include the bucket's, so deduplicating a store of any
size, choosing a token's resolution and merging resolutions move no points between tasks. A token
with a third of all points is spread over its periods.

Points without a token, resolution, time, order or price say nothing and are not kept. Of equal
(token, resolution, second) the last extract wins; an extract that is added twice changes nothing.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators import history
from tapeloom.session import folder_names

# The columns that the store is laid out by; the second follows from ``t``.
LAYOUT = ("token_id", "period")
COLUMNS = "token_id STRING, resolution STRING, extract_ord BIGINT, t BIGINT, price DOUBLE, period BIGINT"
PERIOD_SECONDS = 7 * 24 * 3600


@dataclass(frozen=True)
class PointStore:
    """``buckets`` is fixed when a store begins; :meth:`compacted` writes one with another number."""

    path: str
    buckets: int = 200

    def _folder(self, spark: SparkSession) -> str:
        name = f"buckets-{self.buckets}"
        others = [n for n in folder_names(spark, self.path) if n.startswith("buckets-") and n != name]
        if others:
            raise ValueError(f"the store at {self.path} has {others[0]}, not {name}")
        return f"{self.path}/{name}"

    def _named(self, spark: SparkSession) -> str:
        """The table under a name of this session; only the name is dropped after use."""
        name = f"tapeloom_points_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} ({COLUMNS}) USING parquet CLUSTERED BY ({', '.join(LAYOUT)}) "
            f"SORTED BY (token_id, t) INTO {self.buckets} BUCKETS LOCATION '{self._folder(spark)}'"
        )
        return name

    def add(self, points: DataFrame) -> None:
        """Add an extract: (token_id, resolution, extract_ord, t, price)."""
        rows = points.select(
            "token_id", "resolution", F.col("extract_ord").cast("long"), F.col("t").cast("long"),
            F.col("price").cast("double"), F.floor(F.col("t") / PERIOD_SECONDS).alias("period"),
        ).dropna()
        self._write(rows.repartition(self.buckets, *LAYOUT))

    def _write(self, rows: DataFrame) -> None:
        spark = rows.sparkSession
        name = self._named(spark)
        try:
            rows.write.insertInto(name)
        finally:
            spark.sql(f"DROP TABLE {name}")

    def points(self, spark: SparkSession) -> DataFrame:
        """All points as added, with ``period``; no rows where nothing was added."""
        name = self._named(spark)
        try:
            return spark.table(name)
        finally:
            spark.sql(f"DROP TABLE {name}")

    def finest_resolution(self, spark: SparkSession, max_keys: int | None = None) -> DataFrame:
        return history.finest_resolution(self.points(spark), "token_id", max_keys, ("period",))

    def merge_resolutions(
        self, markets: DataFrame, lookback_hours: float = history.MERGE_LOOKBACK_HOURS,
        max_markets: int | None = None,
    ) -> DataFrame:
        stored = self.points(markets.sparkSession)
        return history.merge_resolutions(stored, markets, lookback_hours, max_markets, LAYOUT)

    def compacted(self, spark: SparkSession, into: PointStore) -> PointStore:
        """Write another store with one point per (token, resolution, second); readers of this one go on."""
        if folder_names(spark, into.path):
            raise ValueError(f"there is a store at {into.path}")
        last = F.max(F.struct("extract_ord", "price")).alias("last")
        rows = self.points(spark).groupBy(*LAYOUT, "resolution", "t").agg(last)
        rows = rows.select("token_id", "resolution", "last.extract_ord", "t", "last.price", "period")
        into._write(rows if into.buckets == self.buckets else rows.repartition(into.buckets, *LAYOUT))
        return into
