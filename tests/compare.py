"""Runs registered queries against their SQL on the shared tables.

    python tests/compare.py [tables folder] [query ...]
"""

from __future__ import annotations

import glob
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import numpy as np  # noqa: E402
import pandas as pd  # noqa: E402


def normal(frame: pd.DataFrame) -> pd.DataFrame:
    frame = frame[sorted(frame.columns)].copy()
    for c in frame.columns:
        kind = frame[c].dtype
        if pd.api.types.is_bool_dtype(kind):
            frame[c] = frame[c].astype(object)
        elif pd.api.types.is_numeric_dtype(kind):
            frame[c] = frame[c].astype(float)
        frame[c] = frame[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else v)
    text = frame.astype(object).map(repr)
    return text.sort_values(list(text.columns)).reset_index(drop=True)


def views(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def difference(spark, con, sf_dir: str, name: str) -> str:
    """Empty if both sides agree."""
    from catalog.oracles import ORACLES
    from catalog.queries import QUERIES

    df = QUERIES[name](spark, sf_dir)
    got = df.toPandas()
    result = con.execute(ORACLES[name])
    kinds = {d[0]: str(d[1]) for d in result.description}
    want = result.df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(set(got.columns) ^ set(want.columns))}"
    spell = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    kinds_off = {c: (t, kinds[c]) for c, t in df.dtypes if spell.get(t, t).upper() != kinds[c].upper()}
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    a, b = normal(got), normal(want)
    off = [c for c in a.columns if not a[c].equals(b[c])]
    if off:
        rows = (a != b).any(axis=1)
        return f"{int(rows.sum())} rows differ in {off[:6]}:\n{a[rows].head(3)[off[:6]]}\n{b[rows].head(3)[off[:6]]}"
    return f"types {kinds_off}" if kinds_off else ""


def main() -> int:
    from pyspark.sql import SparkSession

    from catalog.oracles import ORACLES

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = views(sf_dir), []
    for name in sys.argv[2:] or ORACLES:
        start = time.time()
        try:
            report = difference(spark, con, sf_dir, name)
        except Exception as error:  # noqa: BLE001
            report = f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok ' if not report else 'BAD'} {name} {time.time() - start:.1f}s {report}", flush=True)
        bad += [name] if report else []
    print(f"{len(bad)} of {len(sys.argv[2:] or ORACLES)} differ: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
