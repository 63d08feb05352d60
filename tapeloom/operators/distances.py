"""Distance matrix of a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators.ranking import hash_sample

# Most rows in a distance matrix, and score dimensions used by default.
SAMPLE_ROWS, SCORE_DIMENSIONS = 80, 10
# The sample is one array in one row, and the result its square.
MOST_ROWS = 2000


def pairwise_distances(
    df: DataFrame, columns: list[str], max_rows: int = SAMPLE_ROWS, label: str = "classifier_label"
) -> DataFrame:
    """Euclidean distance between all rows of a sample of at most ``max_rows`` markets.

    The sample is the operator's feature: the result has ``max_rows`` squared rows at most. The
    sampled rows form one small array, which each sampled row is unfolded against, so ``max_rows``
    is bounded by ``MOST_ROWS``.
    """
    if max_rows > MOST_ROWS:
        raise ValueError(f"a distance matrix of more than {MOST_ROWS} rows is no report")
    point = F.array(*[F.col(c).cast("double") for c in columns])
    name = F.concat_ws(": ", F.col(label).cast("string"), F.col("market_id").cast("string"))
    sample = hash_sample(df.select("market_id", name.alias("name"), point.alias("at")), "market_id", max_rows, ["name"])
    rows = sample.agg(F.collect_list(F.struct("market_id", "name", "at")).alias("rows"))
    left = rows.select(F.explode("rows").alias("a"), "rows")
    both = left.select("a", F.explode("rows").alias("b"))
    squares = F.aggregate(
        F.zip_with("a.at", "b.at", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v
    )
    return both.select(
        F.col("a.market_id").alias("market_a"),
        F.col("b.market_id").alias("market_b"),
        F.col("a.name").alias("label_a"),
        F.col("b.name").alias("label_b"),
        F.sqrt(squares).alias("distance"),
    )
