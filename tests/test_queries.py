"""Every registered query against its SQL; queries without SQL must run and repeat."""

import importlib.util
import os

import pytest
from compare import difference, views

from catalog.oracles import ORACLES
from catalog.queries import QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return views(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, sf, con, name):
    assert difference(spark, con, sf, name) == ""


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, sf, name):
    rows = QUERIES[name](spark, sf).toPandas()
    assert len(rows) and not rows.isna().any().any()


def test_entry_points(spark):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    spec = importlib.util.spec_from_file_location("spark_entry", f"{root}/__spark_entry__.py")
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    assert set(module.oracle_sql()) <= set(module.queries())
    assert module.entry(spark).count() > 0


def test_no_rdd_cross_join_or_local_checkpoint_in_the_library():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for folder, _, files in os.walk(f"{root}/tapeloom"):
        for file in files:
            if file.endswith(".py"):
                text = open(os.path.join(folder, file)).read()
                for word in ("crossJoin", "localCheckpoint", ".rdd.map", "F.udf"):
                    assert word not in text, f"{word} in {file}"
