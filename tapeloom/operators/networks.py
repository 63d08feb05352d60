"""Sequence embeddings trained on rows that stay where they are.

The rows are a table (market_id, x[, label_class_index]), numbered once by row key and dealt over
tasks. One rule holds at any size: in each epoch the row numbers are permuted by a keyed bijection,
which every task computes for its own rows, and consecutive places make up the mini-batches. The tasks
of a barrier stage add their parts of a mini-batch's gradient up (``allGather``, in pieces) and all
take the same step, so the number of tasks changes nothing but the order of a sum.

A stage runs ``round_epochs`` epochs; then one task hands the weights to the driver, and the next
stage starts from them. A lost executor costs the current round at most. A step exchanges one gradient
per task that holds rows of its mini-batch: on many executors, take larger mini-batches.

Vector arithmetic inside a task is numpy on Arrow batches.
"""

from __future__ import annotations

import base64
import copy
import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import BarrierTaskContext, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.session import staged

# Guards of the training rule. (Bounding the input of tanh by 20 changes no value: it is 1 there.)
LOGIT_INPUT, LOG_VARIANCE, TANH_INPUT = 30.0, 8.0, 20.0
GRADIENT_NORM, WEIGHT_BOUND = 5.0, 4.0
AE_SCALE, CLASSIFIER_SCALE, CVAE_SCALE = 0.08, 0.02, 0.06
# Bytes that one exchange brings to a task, within Spark's bound on a message.
EXCHANGE_BYTES = 32 << 20


@dataclass(frozen=True)
class Training:
    """Training settings with the usual defaults."""

    h1: int = 128
    h2: int = 64
    latent: int = 2
    epochs: int = 1200
    learning_rate: float = 0.001
    l2: float = 1e-4
    semi_weight: float = 0.75
    beta_kl: float = 0.5
    seed: int = 42
    batch: int = 64
    # Rows a task should have (there are at most as many tasks as the session runs at once), and
    # epochs between two hand-overs of the weights. Neither changes the result.
    task_rows: int = 16_384
    round_epochs: int = 50

    def __post_init__(self):
        if self.latent < 1:
            raise ValueError("latent must be at least 1")
        if min(self.h1, self.h2) < self.latent:
            raise ValueError("hidden layers must be at least as wide as the latent space")


def replace_epochs(cfg: Training, epochs: int | None) -> Training:
    return cfg if epochs is None else replace(cfg, epochs=epochs)


@dataclass
class Dense:
    """One layer; ``free`` weights are exempt from the weight bound."""

    weight: np.ndarray
    bias: np.ndarray
    squash: bool
    free: bool = False

    def forward(self, x: np.ndarray) -> np.ndarray:
        u = x @ self.weight
        u += self.bias
        return _tanh(u) if self.squash else u

    def backward(self, x: np.ndarray, y: np.ndarray, upstream: np.ndarray, inward: bool = True, into=(None, None)):
        """(weight gradient, bias gradient, gradient of the input or, unless ``inward``, None).

        The gradients of weight and bias are written to the two arrays of ``into``, if there are any.
        """
        du = upstream
        if self.squash:
            du = y * y
            np.subtract(1.0, du, out=du)
            du *= upstream
        return (
            np.matmul(x.T, du, out=into[0]),
            np.add.reduce(du, axis=0, out=into[1]),
            du @ self.weight.T if inward else None,
        )


def _tanh(u: np.ndarray) -> np.ndarray:
    """tanh in place, to a few units in the last digit: expm1 takes a third of the time of np.tanh."""
    np.minimum(u, TANH_INPUT, out=u)
    u *= 2.0
    np.expm1(u, out=u)
    u /= u + 2.0
    return u


def _run(stack: list[Dense], x: np.ndarray) -> list[np.ndarray]:
    values = [x]
    for layer in stack:
        values.append(layer.forward(values[-1]))
    return values


def _pull_back(
    stack: list[Dense], values: list[np.ndarray], upstream: np.ndarray, inward: bool = True, into: dict | None = None
):
    """Gradients per layer in stack order, and the gradient of the stack's input if ``inward``.

    ``into`` has the arrays that a layer's gradients are written to, by the layer's ``id``.
    """
    found = []
    for place in reversed(range(len(stack))):
        layer = stack[place]
        target = into[id(layer)] if into else (None, None)
        dw, db, upstream = layer.backward(values[place], values[place + 1], upstream, inward or place > 0, target)
        found.append((dw, db))
    return found[::-1], upstream


def _stack(rng, widths: list[int], scale: float, linear_end: bool) -> list[Dense]:
    last = len(widths) - 2
    return [
        Dense(rng.normal(0.0, scale, (a, b)), np.zeros(b), not (linear_end and i == last))
        for i, (a, b) in enumerate(zip(widths, widths[1:]))
    ]


def _miss(found: np.ndarray, x: np.ndarray, n_rows: float) -> np.ndarray:
    """The gradient of the mean squared error summed over a row."""
    out = found - x
    out *= 2.0
    out /= n_rows
    return out


def _softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.clip(logits - logits.max(axis=1, keepdims=True), -LOGIT_INPUT, LOGIT_INPUT)
    weights = np.exp(shifted)
    return weights / (weights.sum(axis=1, keepdims=True) + 1e-12)


def _one_hot(labels: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((len(labels), n))
    out[np.arange(len(labels)), labels] = 1.0
    return out


def _row_noise(keys: np.ndarray, width: int, seed: int, epoch: int) -> np.ndarray:
    """Standard normal noise that depends on the row key, the seed and the epoch alone.

    Two mixed 64-bit counters give two uniforms per value, turned normal by Box-Muller.
    """
    mask = (1 << 64) - 1
    column = np.arange(width, dtype=np.uint64)[None, :]
    start = np.uint64((seed * 0x9E3779B97F4A7C15 + epoch * 0xD1B54A32D192ED03) & mask)
    base = keys.astype(np.uint64)[:, None] + start + column * np.uint64(0x632BE59BD9B4E019)

    def uniform(offset: int) -> np.ndarray:
        h = base + np.uint64(offset)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
        h ^= h >> np.uint64(31)
        return ((h >> np.uint64(11)).astype(float) + 0.5) / float(1 << 53)

    return np.sqrt(-2.0 * np.log(uniform(0x2545F4914F6CDD1D))) * np.cos(2.0 * np.pi * uniform(0x1F83D9AB))


@dataclass
class Autoencoder:
    """x -> h1 -> h2 -> z and back, with an optional linear classifier on z."""

    encoder: list[Dense]
    decoder: list[Dense]
    head: list[Dense] = field(default_factory=list)
    n_classes: int = 0
    alpha: float = 0.0

    @classmethod
    def fresh(cls, width: int, cfg: Training, n_classes: int = 0) -> "Autoencoder":
        rng = np.random.default_rng(cfg.seed)
        scale = AE_SCALE / max(math.sqrt(width), 1.0)
        down = _stack(rng, [width, cfg.h1, cfg.h2, cfg.latent], scale, linear_end=False)
        up = _stack(rng, [cfg.latent, cfg.h2, cfg.h1, width], scale, linear_end=True)
        head = []
        if n_classes:
            head = _stack(rng, [cfg.latent, n_classes], CLASSIFIER_SCALE, linear_end=True)
            head[0].free = True
        return cls(down, up, head, n_classes, cfg.semi_weight if n_classes else 0.0)

    def layers(self) -> list[Dense]:
        return [*self.encoder, *self.decoder, *self.head]

    def encode(self, x, labels):
        return _run(self.encoder, x)[-1]

    def noise(self, keys, epoch):
        """What an epoch needs for each row besides the rows: nothing."""

    def gradients(self, x, labels, keys, n_rows, epoch, into=None, noise=None):
        down = _run(self.encoder, x)
        up = _run(self.decoder, down[-1])
        dec, dz = _pull_back(self.decoder, up, _miss(up[-1], x, n_rows), into=into)
        head = []
        if self.head:
            out = _run(self.head, down[-1])
            miss = (_softmax(out[-1]) - _one_hot(labels, self.n_classes)) / n_rows
            head, dz_class = _pull_back(self.head, out, miss, into=into)
            # The weight of the class loss reaches the encoder only, not the classifier itself.
            dz = dz + self.alpha * dz_class
        enc, _ = _pull_back(self.encoder, down, dz, inward=False, into=into)
        return [*enc, *dec, *head]

    def report(self, x, labels):
        up = _run(self.decoder, self.encode(x, labels))
        return ((up[-1] - x) ** 2).sum(axis=1), np.zeros(len(x))


@dataclass
class ConditionalVae:
    """q(z | x, label) and p(x | z, label); the exported embedding is the mean of z."""

    trunk: list[Dense]
    mean: list[Dense]
    log_variance: list[Dense]
    decoder: list[Dense]
    n_classes: int
    beta: float
    seed: int

    @classmethod
    def fresh(cls, width: int, cfg: Training, n_classes: int) -> "ConditionalVae":
        if n_classes < 2:
            raise ValueError("a conditional model needs at least 2 labels")
        rng = np.random.default_rng(cfg.seed)
        scale = CVAE_SCALE / max(math.sqrt(width + n_classes), 1.0)
        return cls(
            _stack(rng, [width + n_classes, cfg.h1, cfg.h2], scale, linear_end=False),
            _stack(rng, [cfg.h2, cfg.latent], scale, linear_end=True),
            _stack(rng, [cfg.h2, cfg.latent], scale, linear_end=True),
            _stack(rng, [cfg.latent + n_classes, cfg.h2, cfg.h1, width], scale, linear_end=True),
            n_classes,
            cfg.beta_kl,
            cfg.seed,
        )

    def layers(self) -> list[Dense]:
        return [*self.trunk, *self.mean, *self.log_variance, *self.decoder]

    def _posterior(self, x, labels):
        given = _one_hot(labels, self.n_classes)
        trunk = _run(self.trunk, np.hstack([x, given]))
        mean, spread = _run(self.mean, trunk[-1]), _run(self.log_variance, trunk[-1])
        return given, trunk, mean, spread, np.clip(spread[-1], -LOG_VARIANCE, LOG_VARIANCE)

    def encode(self, x, labels):
        return self._posterior(x, labels)[2][-1]

    def noise(self, keys, epoch):
        """The noise of an epoch, a row each."""
        return _row_noise(keys, self.mean[-1].bias.size, self.seed, epoch)

    def gradients(self, x, labels, keys, n_rows, epoch, into=None, noise=None):
        given, trunk, mean, spread, logvar = self._posterior(x, labels)
        noise = self.noise(keys, epoch) if noise is None else noise
        deviation = np.exp(0.5 * logvar)
        up = _run(self.decoder, np.hstack([mean[-1] + deviation * noise, given]))
        dec, d_in = _pull_back(self.decoder, up, _miss(up[-1], x, n_rows), into=into)
        dz = d_in[:, : logvar.shape[1]]
        # The clip of the log variance does not stop its gradient.
        d_mean = dz + self.beta * mean[-1] / n_rows
        d_logvar = dz * 0.5 * deviation * noise + self.beta * 0.5 * (np.exp(logvar) - 1.0) / n_rows
        mu, d_trunk_a = _pull_back(self.mean, mean, d_mean, into=into)
        lv, d_trunk_b = _pull_back(self.log_variance, spread, d_logvar, into=into)
        enc, _ = _pull_back(self.trunk, trunk, d_trunk_a + d_trunk_b, inward=False, into=into)
        return [*enc, *mu, *lv, *dec]

    def report(self, x, labels):
        given, _, mean, _, logvar = self._posterior(x, labels)
        up = _run(self.decoder, np.hstack([mean[-1], given]))
        kl = -0.5 * (1.0 + logvar - mean[-1] ** 2 - np.exp(logvar)).sum(axis=1)
        return ((up[-1] - x) ** 2).sum(axis=1), kl


def _batch(batch: pa.RecordBatch):
    """(rows x width matrix, labels, row keys) of one Arrow batch."""
    width = len(batch.column("x")[0])
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return (
        np.asarray(x, dtype=float),
        batch.column("label_class_index").to_numpy(zero_copy_only=False).astype(int),
        batch.column("row_key").to_numpy(zero_copy_only=False),
    )


def _one_list(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values))


def _flat(model) -> np.ndarray:
    return np.concatenate([p.ravel() for layer in model.layers() for p in (layer.weight, layer.bias)])


def _set_flat(model, values: np.ndarray) -> None:
    at = 0
    for layer in model.layers():
        for name in ("weight", "bias"):
            old = getattr(layer, name)
            setattr(layer, name, values[at : at + old.size].reshape(old.shape).copy())
            at += old.size


def batch_places(numbers: np.ndarray, n: int, seed: int, epoch: int) -> np.ndarray:
    """The epoch's place of each row number below ``n``: a shuffle without any exchange.

    Four Feistel rounds permute the numbers of 2h bits, the fewest that hold ``n``; a place beyond
    ``n`` is permuted again until it falls below, which keeps this a bijection.
    """
    half = np.uint64(max(1, ((n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    keys = np.arange(1, 5, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    keys += np.uint64((seed * 0xD1B54A32D192ED03 + epoch * 0x8CB92BA72F3D8DD7) & ((1 << 64) - 1))
    out = numbers.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for key in keys:
            h = (right + key) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((h >> np.uint64(32)) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def train_epochs(
    model, x, labels, keys, numbers, n: int, cfg: Training, first: int, last: int,
    add: Callable[[np.ndarray | None, int], np.ndarray],
) -> None:
    """Mini-batch descent, epochs ``first`` to ``last`` - 1, over the rows a task holds of all ``n``.

    ``add`` gives the sum over all tasks of a mini-batch's gradient; None stands for no rows.
    """
    size = sum(layer.weight.size + layer.bias.size for layer in model.layers())
    # The products of a step are written where they are added up, into the same arrays each time.
    own, spare = np.empty(size), np.empty(max(layer.weight.size for layer in model.layers()))
    into = {id(layer): pair for layer, pair in zip(model.layers(), _parts(model, own))}
    batch, room = min(cfg.batch, n), 0.0
    with np.errstate(all="ignore"):
        for epoch in range(first, last):
            places = batch_places(numbers, n, cfg.seed, epoch)
            order = np.argsort(places)
            bounds = np.searchsorted(places[order], np.arange(0, n + batch, batch)).tolist()
            noise = model.noise(keys, epoch)
            for k, at in enumerate(range(0, n, batch)):
                rows, flat = order[bounds[k] : bounds[k + 1]], None
                if len(rows):
                    flat, some = own, float(min(batch, n - at))
                    drawn = None if noise is None else noise[rows]
                    model.gradients(x[rows], labels[rows], keys[rows], some, epoch, into, drawn)
                total = add(flat, size)
                # One product tells whether any value has to be replaced (or two finite ones overflow: none is then).
                if not math.isfinite(total @ total):
                    total = np.nan_to_num(total, nan=0.0, posinf=0.0, neginf=0.0)
                room = _apply(model, total, cfg, room, spare)


def _alone(flat: np.ndarray | None, size: int) -> np.ndarray:
    return flat


def _gathered(context: BarrierTaskContext, n_tasks: int):
    """Sums over the tasks of a barrier stage, in the tasks' order, so that all get the same."""
    piece = max(1, EXCHANGE_BYTES // (11 * n_tasks))

    def add(flat: np.ndarray | None, size: int) -> np.ndarray:
        total = np.zeros(size)
        for at in range(0, size, piece):
            own = b"" if flat is None else flat[at : at + piece].astype("<f8").tobytes()
            for sent in context.allGather(base64.b64encode(own).decode("ascii")):
                if sent:
                    total[at : at + piece] += np.frombuffer(base64.b64decode(sent), "<f8")
        return total

    return add


def _round(model, rows: DataFrame, n: int, n_parts: int, first: int, last: int, cfg: Training) -> None:
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        context = BarrierTaskContext.get() if n_parts > 1 else None
        own = copy.deepcopy(sent.value)
        held = [(*_batch(b), b.column("number").to_numpy()) for b in batches if b.num_rows]
        if not held:
            x = np.empty((0, _width(own)))
            held = [(x, np.empty(0, int), np.empty(0, np.int64), np.empty(0, np.int64))]
        x, labels, keys, numbers = (np.concatenate(parts) for parts in zip(*held, strict=True))
        add = _gathered(context, n_parts) if context else _alone
        train_epochs(own, x, labels, keys, numbers, n, cfg, first, last, add)
        if context is None or context.partitionId() == 0:
            yield pa.RecordBatch.from_arrays([_one_list(_flat(own))], names=["v"])

    found = rows.mapInArrow(task, "v array<double>", barrier=n_parts > 1).toArrow()
    sent.destroy()
    _set_flat(model, found.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False))


def _width(model) -> int:
    return (model.encoder if isinstance(model, Autoencoder) else model.trunk)[0].weight.shape[0]


def _parts(model, flat: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The parts of ``flat`` that belong to each layer's weight and bias, without copies."""
    out, at = [], 0
    for layer in model.layers():
        end = at + layer.weight.size
        out.append((flat[at:end].reshape(layer.weight.shape), flat[end : end + layer.bias.size]))
        at = end + layer.bias.size
    return out


def _apply(model, flat: np.ndarray, cfg: Training, room: float = 0.0, spare: np.ndarray | None = None) -> float:
    """Descend once: decay and norm look at weights only, the clip factor scales biases too.

    Parameters change in place, and ``flat`` is used up: a step makes no copies of the model. No
    weight moves by more than the length of the step, so weights that are known to be at least
    ``room`` away from the bound need not be compared with it until steps add up to that. Returns
    the room that is left. ``spare`` may be as long as the largest weight, for values in between.
    """
    grads, squares = _parts(model, flat), 0.0
    for layer, (w, _) in zip(model.layers(), grads):
        decay = None if spare is None else spare[: w.size].reshape(w.shape)
        w += np.multiply(layer.weight, cfg.l2, out=decay)
        squares += float(np.dot(w.reshape(-1), w.reshape(-1)))
    if not squares < (1.0 - 1e-9) * GRADIENT_NORM**2:
        # Here the sum counts to the last digit; a shorter gradient is not scaled, whatever its norm is.
        squares = sum(float((w * w).sum()) for w, _ in grads)
    norm = math.sqrt(max(squares, 1e-12))
    rate = cfg.learning_rate * min(1.0, GRADIENT_NORM / norm)
    flat *= rate
    for layer, (w, b) in zip(model.layers(), grads):
        layer.weight -= w
        layer.bias -= b
    # Twice the length allows for the rounding of sums.
    room -= 2.0 * abs(rate) * norm
    if not room > 0.0:
        bounded = [layer.weight for layer in model.layers() if not layer.free]
        for weight in bounded:
            np.clip(weight, -WEIGHT_BOUND, WEIGHT_BOUND, out=weight)
        room = WEIGHT_BOUND - max(max(weight.max(), -weight.min()) for weight in bounded)
    return room


def training_rows(vectors: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Vectors with a label index (0 without labels) and a row key, written once for all epochs."""
    keyed = vectors.withColumn("row_key", F.xxhash64("market_id"))
    if labels is None:
        keyed = keyed.withColumn("label_class_index", F.lit(0))
    else:
        keyed = keyed.join(labels.select("market_id", "label_class_index"), "market_id")
    return staged(
        keyed.select("market_id", "x", F.col("label_class_index").cast("int"), "row_key"), "vectors"
    )


def fresh(kind: str, width: int, cfg: Training, n_classes: int = 0):
    """An untrained ``'ae'``, ``'semi'`` or ``'cvae'``."""
    if kind == "ae":
        return Autoencoder.fresh(width, cfg)
    if kind == "semi":
        return Autoencoder.fresh(width, cfg, n_classes)
    if kind == "cvae":
        return ConditionalVae.fresh(width, cfg, n_classes)
    raise ValueError(f"unknown model {kind!r}")


def _x_width(rows: DataFrame) -> int:
    first = rows.select(F.size("x").alias("width")).first()
    if first is None:
        raise ValueError("no sequences to train on")
    return first["width"]


def fit(kind: str, rows: DataFrame, cfg: Training, n_classes: int = 0):
    """Train ``'ae'``, ``'semi'`` or ``'cvae'`` on rows from :func:`training_rows`."""
    return train(fresh(kind, _x_width(rows), cfg, n_classes), rows, cfg)


def fit_all(settings: dict[str, Training], rows: DataFrame, n_classes: int = 0) -> dict:
    """The models of :func:`fit` by kind, trained side by side on rows that are numbered once.

    Models do not wait for each other: each has its own jobs, from a thread of its own, as many at
    a time as have slots for all of their tasks.
    """
    width = _x_width(rows)
    models = {kind: fresh(kind, width, cfg, n_classes) for kind, cfg in settings.items()}
    rows, n = numbered(rows)
    spark = rows.sparkSession
    most = max(_tasks(spark, n, cfg) for cfg in settings.values())
    at_once = max(1, min(len(models), spark.sparkContext.defaultParallelism // most))
    with ThreadPoolExecutor(at_once) as pool:
        work = inheritable_thread_target(spark)(train_numbered)
        runs = [pool.submit(work, m, rows, n, settings[kind], kind) for kind, m in models.items()]
        for run in runs:
            run.result()
    return models


def numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """Rows with a dense ``number`` from 0 in the order of their keys, and how many there are."""
    order = ["row_key", "market_id", F.xxhash64("x")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = ranged.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    ranged = staged(ranged, "numbered")
    # One row per part of the range partitioning, whatever the rows.
    sizes = sorted(ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    before, n = [], 0
    for part, size in sizes:
        before.append((part, n))
        n += size
    starts = rows.sparkSession.createDataFrame(before, "_part int, _before long")
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return ranged.join(F.broadcast(starts), "_part").withColumn("number", place).drop("_part", "_at", "_before"), n


def _tasks(spark: SparkSession, n: int, cfg: Training) -> int:
    """Tasks that train a model on ``n`` rows."""
    return max(1, min(math.ceil(n / cfg.task_rows), spark.sparkContext.defaultParallelism))


def train(model, rows: DataFrame, cfg: Training):
    """Train ``model`` in place on all rows; see the module text."""
    return train_numbered(model, *numbered(rows), cfg)


def train_numbered(model, rows: DataFrame, n: int, cfg: Training, name: str = ""):
    """:func:`train` on rows from :func:`numbered`; a model of another ``name`` deals them for itself."""
    n_parts = _tasks(rows.sparkSession, n, cfg)
    dealt = rows.withColumn("model", F.lit(name)).repartition(n_parts, "row_key").persist()
    epochs, step = max(1, cfg.epochs), max(1, cfg.round_epochs)
    try:
        for first in range(0, epochs, step):
            _round(model, dealt, n, n_parts, first, min(epochs, first + step), cfg)
    finally:
        dealt.unpersist()
    return model


def embed(model, rows: DataFrame) -> DataFrame:
    """(market_id, z1..zk); a narrow step."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    k = (model.encoder if isinstance(model, Autoencoder) else model.mean)[-1].bias.size
    names = [f"z{i + 1}" for i in range(k)]

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                x, labels, _ = _batch(batch)
                z = np.nan_to_num(sent.value.encode(x, labels), nan=0.0, posinf=0.0, neginf=0.0)
                columns = {"market_id": batch.column("market_id")}
                columns.update({n: pa.array(z[:, i]) for i, n in enumerate(names)})
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(task, "market_id string, " + ", ".join(f"{n} double" for n in names))


def metrics(model, rows: DataFrame) -> DataFrame:
    """One row: reconstruction error per value and mean KL (0 for plain autoencoders)."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for batch in batches:
            if batch.num_rows:
                x, labels, _ = _batch(batch)
                error, kl = sent.value.report(x, labels)
                yield pa.RecordBatch.from_pydict(
                    {"e": pa.array(error), "w": pa.array(np.full(len(x), float(x.shape[1]))), "kl": pa.array(kl)}
                )

    per_row = rows.mapInArrow(task, "e double, w double, kl double")
    return per_row.agg(
        (F.sum("e") / F.sum("w")).alias("mse"),
        F.avg("kl").alias("mean_kl"),
        F.count(F.lit(1)).alias("n_rows"),
    )
