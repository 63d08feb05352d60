import numpy as np
import pytest
from conftest import all_near, near
from pyspark.sql import functions as F

from tapeloom.operators import components as PC
from tapeloom.operators.distances import pairwise_distances
from tapeloom.operators.scaling import zscore


def frame(spark, rows):
    names = [f"f{i + 1}" for i in range(len(rows[0]))]
    data = [(str(i), "c", "1", "s", *[None if v is None else float(v) for v in r]) for i, r in enumerate(rows)]
    schema = "market_id string, classifier_label string, tag_id string, tag_slug string, " + ", ".join(f"{n} double" for n in names)
    return spark.createDataFrame(data, schema), names


def test_zscore(spark):
    df, names = frame(spark, [(1, None, 5), (3, 2, 5), (8, 4, 5)])
    rows = zscore(df, names).orderBy("market_id").collect()
    assert all_near([r.f1 for r in rows], [-1.019049331, -0.33968311, 1.358732441])
    assert all_near([r.f2 for r in rows], [-1.224744871, 0, 1.224744871])
    assert [r.f3 for r in rows] == [0.0, 0.0, 0.0]


def test_zscore_edges(spark):
    df, names = frame(spark, [(1, None)])
    row = zscore(df, names).first()
    assert row.f1 == 1.0 and row.f2 is None
    assert zscore(df.limit(0), names).count() == 0
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (3.0,)], "x double")
    assert all_near(sorted(r.x for r in zscore(odd, ["x"]).collect()), [-0.707106781, -0.707106781, 1.414213562])
    tenth = spark.range(1000).select(F.lit(0.1).alias("x")).repartition(7)
    assert {r.x for r in zscore(tenth, ["x"]).collect()} == {0.0}


def test_known_components(spark):
    df, names = frame(spark, [(1, 2), (2, 1), (4, 3)])
    model = PC.fit_components(df, names)
    assert all_near(model.variance_ratio, [0.860555128, 0.139444872])
    assert all_near(list(model.loadings[0]), [0.881674599, 0.471857926])
    scores = [r.PC1 for r in model.scores(df).orderBy("market_id").collect()]
    assert all_near(scores, [-1.175566132, -0.765749458, 1.94131559])
    got = {(r.feature, r.target): r.correlation for r in PC.correlations(model.scores(df), names, ["PC1"]).collect()}
    assert near(got["f1", "PC1"], 0.977572) and near(got["f2", "PC1"], 0.799171)
    scree = model.scree().orderBy("component").collect()
    assert near(scree[-1].cumulative_ratio, 1.0)


def test_components_agree_with_svd(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 6)) @ rng.normal(size=(6, 6)) + 3.0
    x[:, 4] = 2.0
    df, names = frame(spark, x.tolist())
    model = PC.fit_components(df, names)
    centred = x - x.mean(axis=0)
    u, s, vt = np.linalg.svd(centred, full_matrices=False)
    ratios = s**2 / (s**2).sum()
    assert all_near(model.variance_ratio, list(ratios), 1e-9)
    assert all(a >= b - 1e-12 for a, b in zip(model.variance_ratio, model.variance_ratio[1:]))
    scored = model.scores(df).toPandas().assign(k=lambda d: d.market_id.astype(int)).sort_values("k")
    for i in range(5):
        sign = 1.0 if vt[i][np.abs(vt[i]).argmax()] > 0 else -1.0
        assert np.allclose(model.loadings[i], sign * vt[i], atol=1e-7)
        assert np.allclose(scored[f"PC{i + 1}"], sign * u[:, i] * s[i], atol=1e-7)
    norms = np.linalg.norm(model.loadings, axis=0)
    assert {r.feature for r in model.top_features(3).collect()} == {names[i] for i in np.argsort(-norms, kind="stable")[:3]}


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_small_components_keep_their_digits(spark, parts):
    rng = np.random.default_rng(8)
    turn, _ = np.linalg.qr(rng.normal(size=(4, 4)))
    x = (rng.normal(size=(400, 4)) * [1.0, 1e-3, 1e-6, 1e-8]) @ turn
    df, names = frame(spark, x.tolist())
    model = PC.fit_components(df.repartition(parts), names)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    assert np.allclose(model.variance_ratio, s**2 / (s**2).sum(), rtol=1e-6, atol=0)
    assert np.allclose(np.abs(model.loadings @ vt.T), np.eye(4), atol=1e-6)
    squared = np.linalg.eigvalsh(np.cov(x.T))[0] / np.trace(np.cov(x.T))  # a covariance loses the last one
    assert abs(squared / model.variance_ratio[3] - 1) > 1e-3


def test_triangles_merge_in_any_order():
    x = np.random.default_rng(3).normal(size=(50, 3)) + [5.0, 0.0, -2.0]
    parts = [PC.Triangle.of(p) for p in np.split(x, [1, 2, 30])]
    centred = x - x.mean(axis=0)
    for order in ([0, 1, 2, 3], [3, 1, 0, 2]):
        whole = parts[order[0]]
        for i in order[1:]:
            whole = whole.merged(parts[i])
        assert whole.count == 50 and np.allclose(whole.mean, x.mean(axis=0), atol=1e-12)
        assert np.allclose(whole.r.T @ whole.r, centred.T @ centred, atol=1e-10)


def test_rows_without_spread(spark):
    df, names = frame(spark, [(1.0, 2.0)] * 3)
    model = PC.fit_components(df, names)
    assert model.variance_ratio == [0.0, 0.0]
    assert {(r.PC1, r.PC2) for r in model.scores(df).collect()} == {(0.0, 0.0)}


def test_component_limits(spark):
    assert PC.component_count(3, 10, 20) == 3 and PC.component_count(50, 64, 20) == 20 and PC.component_count(5, 5, 0) == 1
    df, names = frame(spark, [(1,), (2,)])
    assert {r.PC2 for r in PC.fit_components(df, names).scores(df).collect()} == {0.0}
    with pytest.raises(ValueError):
        PC.fit_components(df.limit(1), names)


def test_numeric_columns(spark):
    df, _ = frame(spark, [(1, 2)])
    assert PC.numeric_columns(df.withColumn("b", F.lit(True)).withColumn("t", F.lit("x"))) == ["f1", "f2", "b"]
    text = spark.createDataFrame([("1", "s", "2")], "market_id string, tag_slug string, v string")
    assert PC.numeric_columns(text) == ["v"]
    with pytest.raises(ValueError):
        PC.numeric_columns(spark.createDataFrame([("1", "s")], "market_id string, tag_slug string"))


def test_correlations_skip_constants_and_tiny_tables(spark):
    df, names = frame(spark, [(1, 5, 1), (2, 5, 4), (4, 5, 9)])
    table = PC.correlations(df, names, ["f1"])
    assert {r.feature for r in table.collect()} == {"f1", "f3"}
    assert PC.correlations(df.limit(2), names, ["f1"]).count() == 0
    assert [r.feature for r in PC.top_correlations(table, 1).collect()] == ["f1"]


def test_distances(spark):
    df, names = frame(spark, [(1, 2), (4, 3)])
    got = {(r.market_a, r.market_b): r.distance for r in pairwise_distances(df, names).collect()}
    assert near(got["0", "1"], 3.16227766) and got["0", "1"] == got["1", "0"] and got["0", "0"] == 0.0
    many, names = frame(spark, [(i, i * i % 7) for i in range(100)])
    assert pairwise_distances(many, names).count() == 6400
    assert pairwise_distances(many, names, max_rows=3).first().label_a.startswith("c: ")


def test_rank_by_time_puts_missing_last(spark):
    rows = [("a", "1", 5.0), ("b", "1", None), ("c", "1", -2.0), ("c", "2", -2.0)]
    df = spark.createDataFrame(rows, "market_id string, tag_id string, h double").withColumn("PC1", F.lit(1.0))
    got = [(r.market_id, r.tag_id, r["rank"]) for r in PC.scores_by_order(df, "h").orderBy("rank").collect()]
    assert got == [("c", "1", 0), ("c", "2", 1), ("a", "1", 2), ("b", "1", 3)]


def test_global_rank_over_many_partitions(spark):
    df = spark.range(3000).select((F.col("id") * 7919 % 3001).alias("v")).repartition(9)
    got = PC.global_rank(df, [F.col("v")], "rank").orderBy("v").collect()
    assert [r["rank"] for r in got] == list(range(3000))
