import threading
from dataclasses import replace

import numpy as np
import pytest
from conftest import near
from pyspark.sql import functions as F

from tapeloom.operators import networks as N
from tapeloom.operators import sequences as Q
from tapeloom.plans import embeddings as E

RAW = "market_id string, classifier_label string, tag_slug string, question string, price_yes double, lookback_step int, unix_ts bigint, category_ord int"
ORDER = ["unix_ts", "category_ord"]


def raw(spark, rows):
    return spark.createDataFrame(rows, RAW)


def test_last_category_wins_even_without_a_price(spark):
    df = raw(spark, [
        ("m", "A", "a", "q", 0.1, 0, 10, 0), ("m", "B", "b", "q", None, 0, 10, 1),
        ("m", "A", "a", "q", 0.3, 1, 20, 0), (None, "A", "a", "q", 0.3, 1, 20, 0), ("m", "A", "a", "q", 0.9, None, 20, 0),
    ])
    steps = Q.dedupe_steps(df, "lookback_step", ORDER)
    assert sorted((r.step, r.price_yes, r.classifier_label) for r in steps.collect()) == [(0, None, "B"), (1, 0.3, "A")]
    assert Q.market_labels(df, "lookback_step", ORDER).first().classifier_label == "A"


def test_paths_cover_steps_of_dropped_markets(spark):
    rows = [("m", "A", "a", "q", p, s, s, 0) for s, p in [(0, 0.1), (2, 0.2)]] + [("n", "A", "a", "q", None, 1, 1, 0)]
    steps = Q.dedupe_steps(raw(spark, rows), "lookback_step", ORDER)
    paths = Q.filled_paths(steps, min_points=2)
    got = [(r.market_id, r.step, r.level, round(r["diff"], 9)) for r in paths.orderBy("step").collect()]
    assert got == [("m", 0, 0.1, 0.0), ("m", 1, 0.1, 0.0), ("m", 2, 0.2, 0.1)]
    empty = Q.filled_paths(steps, min_points=0).where("market_id = 'n'").collect()
    assert [r.level for r in empty] == [0.5, 0.5, 0.5]
    assert Q.path_vectors(steps, min_points=2).first().x[:3] == [0.1, 0.1, 0.2]


def test_scaled_vectors(spark):
    rows = [(str(i), [float(i), 2.0, 1000.0 if i == 0 else 0.0]) for i in range(50)]
    x = np.array([r.x for r in Q.scale_vectors(spark.createDataFrame(rows, "market_id string, x array<double>")).orderBy(F.col("market_id").cast("int")).collect()])
    assert near(x[:, 0].mean(), 0) and near(x[:, 0].std(), 1) and (x[:, 1] == 0).all() and x[0, 2] == 6.0


def test_step_column(spark):
    df = spark.createDataFrame([(1, 2)], "normalized_step int, other int")
    assert Q.step_column(df) == "normalized_step" and Q.step_column(df, "other") == "other"
    for bad in (lambda: Q.step_column(df, "none"), lambda: Q.step_column(df.select("other"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        Q.dedupe_steps(df, "normalized_step", [])


def test_label_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("C",)], "classifier_label string")
    assert sorted((r.label_class_index, r.label_class) for r in Q.label_index(df).collect()) == [(0, "C"), (1, "a"), (2, "b")]


def flat(model, x, labels, keys, n):
    found = model.gradients(x, labels, keys, float(n), 3)
    return np.concatenate([part.ravel() for pair in found for part in pair])


def shift(model, at, by):
    for layer in model.layers():
        for name in ("weight", "bias"):
            block = getattr(layer, name)
            if at < block.size:
                block.reshape(-1)[at] += by
                return
            at -= block.size


def sample(seed=1, n=9, d=5):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, d)), rng.integers(0, 3, n), rng.integers(0, 2**62, n)


@pytest.mark.parametrize("kind", ["ae", "cvae"])
def test_gradients_match_finite_differences(kind):
    x, labels, keys = sample()
    cfg = N.Training(h1=4, h2=3, latent=2, beta_kl=0.7)
    model = N.Autoencoder.fresh(5, cfg) if kind == "ae" else N.ConditionalVae.fresh(5, cfg, 3)
    rng = np.random.default_rng(0)
    for layer in model.layers():
        layer.weight = rng.normal(0, 0.5, layer.weight.shape)
        layer.bias = rng.normal(0, 0.1, layer.bias.shape)

    def loss():
        if kind == "ae":
            return model.report(x, labels)[0].mean()
        given, _, mean, _, logvar = model._posterior(x, labels)
        z = mean[-1] + np.exp(0.5 * logvar) * N._row_noise(keys, 2, model.seed, 3)
        out = N._run(model.decoder, np.hstack([z, given]))[-1]
        kl = -0.5 * (1 + logvar - mean[-1] ** 2 - np.exp(logvar)).sum(axis=1)
        return ((out - x) ** 2).sum(axis=1).mean() + model.beta * kl.mean()

    grad = flat(model, x, labels, keys, len(x))
    for at in range(0, grad.size, 3):
        shift(model, at, 1e-6)
        up = loss()
        shift(model, at, -2e-6)
        down = loss()
        shift(model, at, 1e-6)
        assert abs((up - down) / 2e-6 - grad[at]) < 1e-4 * max(1.0, abs(grad[at]))


def test_class_weight_reaches_the_encoder_only():
    x, labels, keys = sample()
    cfg = N.Training(h1=4, h2=3, latent=2)
    plain, heavy = N.Autoencoder.fresh(5, cfg, 3), N.Autoencoder.fresh(5, cfg, 3)
    plain.alpha, heavy.alpha = 0.0, 5.0
    a, b = plain.gradients(x, labels, keys, 9.0, 0), heavy.gradients(x, labels, keys, 9.0, 0)
    assert np.allclose(a[-1][0], b[-1][0]) and not np.allclose(a[0][0], b[0][0])
    assert all(np.allclose(p[0], q[0]) for p, q in zip(a[3:6], b[3:6]))


def test_noise_is_normal_and_depends_on_the_row_only():
    keys = np.random.default_rng(2).integers(-(2**62), 2**62, 20_000)
    noise = N._row_noise(keys, 2, 42, 7)
    assert abs(noise.mean()) < 0.02 and abs(noise.std() - 1) < 0.02 and abs(np.corrcoef(noise.T)[0, 1]) < 0.03
    assert np.array_equal(noise[100:200], N._row_noise(keys[100:200], 2, 42, 7))
    assert not np.allclose(noise, N._row_noise(keys, 2, 42, 8))


def test_weights_are_bounded_and_steps_clipped():
    cfg = N.Training(h1=4, h2=3, latent=2, learning_rate=1.0, l2=0.0)
    model = N.Autoencoder.fresh(5, cfg, 3)
    before = [layer.weight.copy() for layer in model.layers()]
    size = sum(layer.weight.size + layer.bias.size for layer in model.layers())
    N._apply(model, np.full(size, 100.0), cfg)
    move = np.sqrt(sum(((a - layer.weight) ** 2).sum() for a, layer in zip(before, model.layers())))
    assert near(move, N.GRADIENT_NORM, 1e-9)
    for layer in model.layers():
        layer.weight = layer.weight * 0 + 50.0
    N._apply(model, np.zeros(size), cfg)
    assert model.encoder[0].weight.max() == N.WEIGHT_BOUND and model.head[0].weight.max() == 50.0


def vectors(spark, n=60, d=6, parts=3):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 2)) @ rng.normal(size=(2, d))
    rows = [(str(i), [float(v) for v in r], i % 3) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "market_id string, x array<double>, label_class_index int").withColumn("row_key", F.xxhash64("market_id")).repartition(parts)


@pytest.mark.parametrize("kind", ["ae", "semi", "cvae"])
def test_training_lowers_the_error_and_ignores_partitioning(spark, kind):
    cfg = N.Training(h1=8, h2=4, latent=2, epochs=6, learning_rate=0.05)
    one, many = vectors(spark, parts=1), vectors(spark, parts=5)
    a, b = N.fit(kind, one, cfg, 3), N.fit(kind, many, cfg, 3)
    assert all(np.allclose(p.weight, q.weight) for p, q in zip(a.layers(), b.layers()))
    start = N.Autoencoder.fresh(6, cfg, 3 if kind == "semi" else 0) if kind != "cvae" else N.ConditionalVae.fresh(6, cfg, 3)
    before, after = N.metrics(start, one).first(), N.metrics(a, one).first()
    assert after.mse < before.mse and after.n_rows == 60 and (after.mean_kl > 0) == (kind == "cvae")
    z = N.embed(a, many)
    assert z.columns == ["market_id", "z1", "z2"] and z.count() == 60


def test_many_partitions_are_added_tree_wise(spark):
    cfg = N.Training(h1=4, h2=3, latent=2, epochs=2, learning_rate=0.05)
    a, b = N.fit("ae", vectors(spark, parts=1), cfg), N.fit("ae", vectors(spark, parts=40), cfg)
    assert all(np.allclose(p.weight, q.weight) for p, q in zip(a.layers(), b.layers()))


def test_training_settings_are_checked(spark):
    for bad in (dict(latent=0), dict(h2=1), dict(h1=1)):
        with pytest.raises(ValueError):
            N.Training(**bad)
    with pytest.raises(ValueError):
        N.fit("cvae", vectors(spark), N.Training(h1=4, h2=3), 1)
    with pytest.raises(ValueError):
        N.fit("other", vectors(spark), N.Training(h1=4, h2=3), 1)
    with pytest.raises(ValueError):
        N.fit("ae", vectors(spark).limit(0), N.Training(h1=4, h2=3), 1)


def test_embedding_tables(spark):
    rng = np.random.default_rng(0)
    rows = [
        (f"m{i}", f"label {i % 2}", "slug", "q", float(rng.uniform()), s, s * 60, 0)
        for i in range(12) for s in range(10)
    ]
    cfg = E.EmbeddingSettings(mode="all", training=N.Training(h1=6, h2=4, epochs=2), epochs_cvae=1)
    seq = E.prepare_sequences(raw(spark, rows), cfg)
    base = ["market_id", "classifier_label", "tag_slug", "question", "z1", "z2"]
    assert E.embed(seq, "ae", cfg)[0].columns == base
    semi, _ = E.embed(seq, "semi", cfg)
    assert semi.columns == base + ["label_class_index", "label_class"]
    assert {(r.label_class_index, r.label_class) for r in semi.collect()} == {(0, "label 0"), (1, "label 1")}
    cvae, _ = E.embed(seq, "cvae", cfg)
    assert cvae.columns[-1] == "latent_is_cvae_mu" and cvae.count() == 12
    assert cfg.training_for("cvae").epochs == 1 and cfg.training_for("ae").epochs == 2


def plain_loop(kind, rows, cfg):
    """The rule restated: shuffled batches, mean gradients, decay, clip, bound."""
    held = sorted(rows.collect(), key=lambda r: r.row_key)
    x = np.array([r.x for r in held])
    labels = np.array([r.label_class_index for r in held])
    keys = np.array([r.row_key for r in held])
    model = N.ConditionalVae.fresh(6, cfg, 3) if kind == "cvae" else N.Autoencoder.fresh(6, cfg, 3 if kind == "semi" else 0)
    for epoch in range(cfg.epochs):
        order = np.argsort(N.batch_places(np.arange(len(x)), len(x), cfg.seed, epoch))
        for at in range(0, len(x), cfg.batch):
            take = order[at : at + cfg.batch]
            grads = model.gradients(x[take], labels[take], keys[take], len(take), epoch)
            decayed = [w + cfg.l2 * layer.weight for layer, (w, _) in zip(model.layers(), grads)]
            norm = np.sqrt(sum((w**2).sum() for w in decayed))
            rate = cfg.learning_rate * min(1.0, 5.0 / norm)
            for layer, w, (_, b) in zip(model.layers(), decayed, grads):
                layer.weight = layer.weight - rate * w
                layer.bias = layer.bias - rate * b
                if not layer.free:
                    layer.weight = np.clip(layer.weight, -4, 4)
    return model


@pytest.mark.parametrize("kind", ["ae", "semi", "cvae"])
@pytest.mark.parametrize("task_rows, round_epochs", [(1000, 50), (80, 3), (40, 50), (10, 2)])
def test_any_number_of_tasks_is_the_plain_mini_batch_loop(spark, kind, task_rows, round_epochs):
    cfg = N.Training(
        h1=8, h2=4, latent=2, epochs=5, learning_rate=0.05, task_rows=task_rows, round_epochs=round_epochs
    )
    rows = vectors(spark, n=150)
    fitted, model = N.fit(kind, rows, cfg, 3), plain_loop(kind, rows, cfg)
    for a, b in zip(fitted.layers(), model.layers()):
        assert np.abs(a.weight - b.weight).max() < 1e-9 and np.abs(a.bias - b.bias).max() < 1e-9


def test_gradients_are_exchanged_in_pieces(spark, monkeypatch):
    class Context:
        def __init__(self):
            self.sent = []

        def allGather(self, message):
            self.sent.append(message)
            return [message, "", message]

    monkeypatch.setattr(N, "EXCHANGE_BYTES", 11 * 3 * 4)
    context = Context()
    add = N._gathered(context, 3)
    flat = np.arange(10.0)
    assert (add(flat, 10) == 2 * flat).all() and len(context.sent) == 3
    assert (add(None, 10) == 0).all()


def test_batch_places_are_a_shuffle():
    for n in (1, 2, 3, 5, 64, 1000):
        one, two = (N.batch_places(np.arange(n), n, 42, e) for e in (0, 1))
        assert sorted(one) == sorted(two) == list(range(n))
        assert n < 64 or (one != two).mean() > 0.9
        some = np.arange(0, n, 3)
        assert (N.batch_places(some, n, 42, 0) == one[some]).all()


def test_published_grids_get_their_category_order(spark):
    df = spark.createDataFrame([("Tech",), ("Sports",), ("Other",), ("Another",)], "classifier_label string")
    rows = E.with_category_order(df, E.EmbeddingSettings()).orderBy("category_ord").collect()
    assert [r.classifier_label for r in rows] == ["Sports", "Tech", "Another", "Other"]


def test_a_step_makes_no_unused_products_and_no_copies_of_the_model():
    x, labels, keys = sample()
    cfg = N.Training(h1=4, h2=3, latent=2)
    for model in (N.Autoencoder.fresh(5, cfg, 3), N.ConditionalVae.fresh(5, cfg, 3)):
        first, inputs = model.layers()[0], []
        kept = first.backward
        first.backward = lambda *a: inputs.append(kept(*a)[2]) or kept(*a)
        found = model.gradients(x, labels, keys, 9.0, 0)
        assert inputs == [None]  # nobody asks for the gradient of the rows themselves
        held = [(layer.weight, layer.bias) for layer in model.layers()]
        N._apply(model, np.concatenate([p.ravel() for pair in found for p in pair]), cfg)
        assert all(w is layer.weight and b is layer.bias for (w, b), layer in zip(held, model.layers()))


def test_values_that_are_not_finite_count_as_none_in_a_step():
    x, labels, keys = sample()
    cfg = N.Training(h1=4, h2=3, latent=2, batch=9, epochs=1)
    own, plain = N.Autoencoder.fresh(5, cfg), N.Autoencoder.fresh(5, cfg)
    size = N._flat(own).size
    for odd in (np.nan, np.inf, -np.inf):
        sent = np.full(size, 0.5)
        sent[::7] = odd
        N.train_epochs(own, x, labels, keys, np.arange(9), 9, cfg, 0, 1, lambda flat, size: sent.copy())
        N._apply(plain, np.where(np.isfinite(sent), sent, 0.0), cfg)
        assert (N._flat(own) == N._flat(plain)).all()


def test_models_are_trained_side_by_side(spark, monkeypatch):
    rows = vectors(spark, n=90)
    kinds = {k: N.Training(h1=8, h2=4, latent=2, epochs=3 + i, learning_rate=0.05) for i, k in enumerate(("ae", "semi", "cvae"))}
    alone = {kind: N.fit(kind, rows, cfg, 3) for kind, cfg in kinds.items()}
    met, one_round = threading.Barrier(3, timeout=60), N._round

    def together(*args):
        met.wait()  # breaks unless three models are trained at a time
        one_round(*args)

    monkeypatch.setattr(N, "_round", together)
    found = N.fit_all(kinds, rows, 3)
    assert list(found) == list(kinds)
    assert all((N._flat(found[k]) == N._flat(alone[k])).all() for k in kinds)
    monkeypatch.setattr(N, "_round", one_round)
    many = {k: replace(cfg, task_rows=30) for k, cfg in kinds.items()}  # three of the four slots each: one at a time
    assert all(np.abs(N._flat(m) - N._flat(alone[k])).max() < 1e-9 for k, m in N.fit_all(many, rows, 3).items())


def test_unknown_models_and_no_rows_are_errors_for_all(spark):
    cfg = N.Training(h1=4, h2=3, epochs=1)
    with pytest.raises(ValueError):
        N.fit_all({"ae": cfg, "other": cfg}, vectors(spark), 3)
    with pytest.raises(ValueError):
        N.fit_all({"ae": cfg}, vectors(spark).limit(0), 3)


def test_tanh_keeps_its_digits():
    size = 10.0 ** np.random.default_rng(5).uniform(-300, 2, 20_000)
    odd = [0.0, -0.0, np.inf, -np.inf, np.nan, 19.9, 20.1, 800.0, -800.0]
    for u in (size, -size, np.array(odd)):
        with np.errstate(all="ignore"):
            found, exact = N._tanh(u.copy()), np.tanh(u)
        known = ~np.isnan(u)
        assert (np.isnan(found) == np.isnan(u)).all() and (np.signbit(found) == np.signbit(exact))[known].all()
        assert (np.abs(found - exact) <= 4 * np.spacing(np.abs(exact)))[known].all()


def steps_of(model, x, labels, keys, cfg, epochs):
    N.train_epochs(model, x, labels, keys, np.arange(len(x)), len(x), cfg, 0, epochs, N._alone)
    return model


@pytest.mark.parametrize("kind", ["ae", "semi", "cvae"])
def test_steps_write_to_the_same_arrays(monkeypatch, kind):
    x, labels, keys = sample(n=40)
    cfg, targets, steps = N.Training(h1=4, h2=3, latent=2, batch=16), set(), []
    apply, model = N._apply, N.fresh(kind, 5, N.Training(h1=4, h2=3, latent=2), 3)
    monkeypatch.setattr(N, "_apply", lambda m, flat, *a: steps.append(0) or targets.add(flat.ctypes.data) or apply(m, flat, *a))
    steps_of(model, x, labels, keys, cfg, 4)
    assert len(steps) == 12 and len(targets) == 1


def test_weights_are_compared_with_the_bound_only_within_reach(monkeypatch):
    x, labels, keys = sample(n=40)
    apply, clip, calls = N._apply, np.clip, []
    for rate, weight, often in ((0.001, 0.0, False), (0.5, 3.5, True)):
        cfg = N.Training(h1=4, h2=3, latent=2, batch=8, learning_rate=rate)
        own, plain = N.Autoencoder.fresh(5, cfg, 3), N.Autoencoder.fresh(5, cfg, 3)
        for model in (own, plain):
            model.encoder[0].weight[:] += weight
            model.head[0].weight[:] += 9.0
        calls.clear()
        with monkeypatch.context() as m:
            m.setattr(np, "clip", lambda *a, **k: calls.append(a[1] == -N.WEIGHT_BOUND) or clip(*a, **k))
            steps_of(own, 9 * x, labels, keys, cfg, 30)
        assert sum(calls) > 12 if often else sum(calls) == 6  # 150 steps, 6 weights with a bound
        with monkeypatch.context() as m:
            m.setattr(N, "_apply", lambda model, flat, cfg, *a: apply(model, flat, cfg))
            steps_of(plain, 9 * x, labels, keys, cfg, 30)
        assert (N._flat(own) == N._flat(plain)).all()


def test_noise_of_an_epoch_is_drawn_once(monkeypatch):
    x, labels, keys = sample(n=40)
    cfg, draws = N.Training(h1=4, h2=3, latent=2, batch=8), []
    noise = N._row_noise
    monkeypatch.setattr(N, "_row_noise", lambda keys, *a: draws.append(len(keys)) or noise(keys, *a))
    steps_of(N.ConditionalVae.fresh(5, cfg, 3), x, labels, keys, cfg, 3)
    assert draws == [40, 40, 40]


def test_the_raw_grid_is_read_once_for_steps_and_once_for_labels(spark):
    rows = [(f"m{i}", f"label {i % 2}", "slug", "q", 0.1 * s, s, s * 60, 0) for i in range(6) for s in range(8)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    seq = E.prepare_sequences(raw(spark, rows).mapInArrow(seen, RAW), E.EmbeddingSettings())
    assert read.value == 2 * len(rows) and seq.n_classes == 2 and seq.rows.count() == seq.labels.count() == 6
