"""Quality scores: random-indexing word vectors, pooled per document, under a two-layer network.

Tokens are runs of letters, of digits, or of other signs, lower-cased, hashed into ``buckets`` rows.
Every bucket has a sparse random index vector (one +1 and one -1 of ``width`` places). Over the whole
corpus, each token adds the index vectors of its neighbours within ``window`` to its own context
vector; the sums are whole numbers, so their order does not matter. The table of buckets x width
numbers has a fixed size and is sent to every task. A document is the mean and the spread of its
tokens' unit vectors and the logarithms of its tokens and of its distinct tokens.

The network (tanh, logistic) is trained on the driver with numpy on the pooled vectors of at most
``sample`` labelled documents, those of least hash, never on held-out ones; four fifths of them fit
the weights, one fifth the temperature that divides the logit. Scoring runs over all documents.

Defined results: missing and empty texts are scored from the zero vector; a missing id is never
labelled and not held out; repeated ids share their labels, and contradicting labels are averaged
and taken as 1 from a half up; without labels of both classes every score is the share of label 1,
or a half without any label; an empty table gives no rows; other columns, whatever their names, are
ignored by ``score`` and carried whole by ``keep``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.hashing import Words, mix
from tapeloom.llm.rows import parts, staged, text_of

# Letters (and all bytes beyond ASCII) 1, digits 2, other signs 3, blanks 0.
SIGNS = np.full(256, 3, np.uint8)
SIGNS[[32, 9, 10, 11, 12, 13]] = 0
SIGNS[[*range(48, 58)]] = 2
SIGNS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1
SLOT = 64
# Pooled numbers beside mean and spread.
SCALARS = 2


@dataclass(frozen=True)
class Quality:
    buckets: int = 1 << 14
    width: int = 32
    window: int = 2
    hidden: int = 32
    epochs: int = 40
    rate: float = 0.003
    sample: int = 20_000
    threshold: float = 0.3
    seed: int = 7


def index_vectors(cfg: Quality) -> tuple[np.ndarray, np.ndarray]:
    """Place of the +1 and of the -1 of each bucket's index vector; they differ."""
    bits = mix(np.arange(cfg.buckets, dtype=np.uint64) + np.uint64(cfg.seed << 32))
    plus = (bits % np.uint64(cfg.width)).astype(np.int64)
    step = (bits >> np.uint64(32)) % np.uint64(cfg.width - 1)
    return plus, (plus + 1 + step.astype(np.int64)) % cfg.width


def context_sums(buckets: np.ndarray, first: np.ndarray, cfg: Quality) -> np.ndarray:
    """Sums of the neighbours' index vectors per bucket; texts are apart."""
    plus, minus = index_vectors(cfg)
    size = cfg.buckets * cfg.width
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.zeros(size, np.int64)
    for step in range(1, cfg.window + 1):
        near = np.flatnonzero(text[step:] == text[:-step])
        left, right = buckets[near], buckets[near + step]
        for of, by in ((left, right), (right, left)):
            row = of * cfg.width
            out += np.bincount(row + plus[by], minlength=size)
            out -= np.bincount(row + minus[by], minlength=size)
    return out.reshape(cfg.buckets, cfg.width)


def _buckets(texts: pa.Array, cfg: Quality) -> tuple[np.ndarray, np.ndarray]:
    words = Words(texts, SIGNS)
    return (words.hash % np.uint64(cfg.buckets)).astype(np.int64), words.first


def word_vectors(rows: DataFrame, cfg: Quality) -> np.ndarray:
    """Unit context vectors of all buckets, from every text of ``rows(text)``."""
    slots = cfg.buckets // SLOT

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((cfg.buckets, cfg.width), np.int64)
        for batch in batches:
            for part in parts(batch):
                total += context_sums(*_buckets(part.column("text"), cfg), cfg)
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        sums = total.reshape(slots, -1)
        used = np.flatnonzero(sums.any(1))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(used),
                pa.array(np.full(len(used), part)),
                pa.array([s.tobytes() for s in sums[used]], pa.binary()),
            ],
            names=["slot", "part", "sums"],
        )

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py(), np.int64) for s in group.column("sums"))
        return pa.table(
            {
                "slot": group.column("slot")[:1],
                "part": pa.array([0], pa.int64()),
                "sums": pa.array([total.tobytes()], pa.binary()),
            }
        )

    schema = "slot long, part long, sums binary"
    sums = rows.select("text").mapInArrow(task, schema)
    # Two rounds, so that no group holds a row of every task.
    fan = max(1, math.isqrt(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    sums = sums.withColumn("part", F.pmod("part", F.lit(fan)))
    sums = sums.groupBy("slot", "part").applyInArrow(add, schema)
    sums = sums.groupBy("slot").applyInArrow(add, schema)
    table = np.zeros((slots, SLOT * cfg.width))
    for row in sums.select("slot", "sums").toLocalIterator():  # buckets x width numbers
        table[row["slot"]] = np.frombuffer(row["sums"], np.int64)
    table = table.reshape(cfg.buckets, cfg.width)
    norm = np.linalg.norm(table, axis=1, keepdims=True)
    return np.divide(table, norm, out=np.zeros_like(table), where=norm > 0).astype(np.float32)


# Tokens whose vectors are held at a time.
SLICE_TOKENS = 1 << 17


def pooled(buckets: np.ndarray, first: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, spread and logarithms of all and of distinct tokens per text."""
    counts = np.diff(first)
    width = vectors.shape[1]
    out = np.zeros((len(counts), 2 * width + SCALARS), np.float32)
    out[:, -1] = np.log1p(counts)
    for i in np.flatnonzero(counts):
        own = buckets[first[i] : first[i + 1]]
        out[i, -2] = math.log1p(len(np.unique(own)))
        total, square = np.zeros(width, np.float32), np.zeros(width, np.float32)
        for at in range(0, len(own), SLICE_TOKENS):
            rows = vectors[own[at : at + SLICE_TOKENS]]
            total += rows.sum(0)
            square += np.einsum("ij,ij->j", rows, rows)
        mean, square = total / len(own), square / len(own)
        out[i, :width] = mean
        out[i, width:-SCALARS] = np.sqrt(np.maximum(square - mean * mean, 0))
    return out


def _features(rows: DataFrame, vectors: np.ndarray, cfg: Quality) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(vectors)
    keep = [c for c in rows.columns if c != "text"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                pools = pooled(*_buckets(part.column("text"), cfg), shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep],
                     pa.array([p.tobytes() for p in pools], pa.binary())],
                    names=[*keep, "features"],
                )

    fields = [rows.schema[c] for c in keep]
    return rows.mapInArrow(task, T.StructType([*fields, T.StructField("features", T.BinaryType())]))


@dataclass(frozen=True)
class Network:
    """Weights of the two layers, the scaling of the inputs, and the temperature."""

    shift: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh((x - self.shift) / self.scale @ self.w1 + self.b1)
        return _sigmoid((hidden @ self.w2 + self.b2) / self.temperature)


@dataclass(frozen=True)
class Constant:
    share: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.share)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def train(x: np.ndarray, y: np.ndarray, cfg: Quality) -> Network | Constant:
    """Adam on mini-batches over four fifths; the temperature of least loss on the others."""
    if not len(y):
        return Constant(0.5)
    if y.min() == y.max():
        return Constant(float(y[0]))
    x = x.astype(np.float64)
    shift, scale = x.mean(0), x.std(0) + 1e-6
    rng = np.random.default_rng(cfg.seed)
    w1 = rng.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1], cfg.hidden))
    w2 = rng.normal(0, 1 / math.sqrt(cfg.hidden), cfg.hidden)
    weights = [w1, np.zeros(cfg.hidden), w2, np.zeros(1)]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    held = np.arange(len(y)) % 5 == 4
    inputs = (x - shift) / scale
    fit = np.flatnonzero(~held)
    step = 0
    for _ in range(cfg.epochs):
        for rows in np.array_split(rng.permutation(fit), max(1, len(fit) // 128)):
            a, target = inputs[rows], y[rows]
            hidden = np.tanh(a @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3]) - target) / len(rows)
            back = error[:, None] * weights[2] * (1 - hidden**2)
            slopes = [a.T @ back + 1e-4 * weights[0], back.sum(0), hidden.T @ error, error.sum()]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * np.square(slope)
                move = first[i] / (1 - 0.9**step)
                weights[i] = weights[i] - cfg.rate * move / (
                    np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8
                )
    temperature = 1.0
    if held.any():
        hidden = np.tanh(inputs[held] @ weights[0] + weights[1])
        logit = hidden @ weights[2] + weights[3]
        tried = np.exp(np.linspace(-2, 3, 101))
        temperature = float(min(tried, key=lambda t: _loss(logit / t, y[held])))
    return Network(shift, scale, weights[0], weights[1], weights[2], float(weights[3][0]), temperature)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder modulo 5; false for a missing id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(features: DataFrame, labels: DataFrame, cfg: Quality) -> Network | Constant:
    """The network of at most ``sample`` labelled rows of ``features(doc_id, features)``.

    The rows of least hash are taken. A bound on the hash, from their count, leaves one and a half
    times as many before anything is sorted, so no task reads more than that.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL")
        .groupBy("doc_id")
        .agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    )
    labelled = staged(
        features.filter(~held_out(F.col("doc_id")))
        .join(known, "doc_id")
        .select(F.xxhash64("doc_id", "features").alias("draw"), "doc_id", "features", "label"),
        "labelled",
    )
    share = min(1.0, 1.5 * cfg.sample / max(1, labelled.count()))
    bound = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    rows = (
        labelled.filter(F.col("draw") <= bound)
        .orderBy("draw", "doc_id")
        .limit(cfg.sample)
        .select("features", "label")
        .toArrow()
    )
    data = b"".join(rows.column("features").to_pylist())
    x = np.frombuffer(data, np.float32).reshape(rows.num_rows, 2 * cfg.width + SCALARS)
    return train(x, rows.column("label").to_numpy().astype(np.float64), cfg)


def _scored(rows: DataFrame, labels: DataFrame, cfg: Quality) -> DataFrame:
    """The columns of ``rows`` but the text, and ``score``."""
    vectors = word_vectors(rows, cfg)
    features = staged(_features(rows, vectors, cfg), "features")
    model = fitted(features.select("doc_id", "features"), labels, cfg)
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in features.columns if c != "features"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join(batch.column("features").to_pylist())
            x = np.frombuffer(data, np.float32).reshape(batch.num_rows, 2 * cfg.width + SCALARS)
            scores = shared.value.scores(x.astype(np.float64))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(scores, pa.float64())],
                names=[*keep, "score"],
            )

    fields = [features.schema[c] for c in keep]
    return features.mapInArrow(task, T.StructType([*fields, T.StructField("score", T.DoubleType())]))


def score(
    docs: DataFrame,
    labels: DataFrame,
    cfg: Quality = Quality(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; ``labels`` has doc_id and quality."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    return _scored(rows, labels, cfg).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= cfg.threshold).cast("int").alias("predicted"),
    )


def keep(
    docs: DataFrame,
    labels: DataFrame,
    cfg: Quality = Quality(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` with a score of at least the threshold, all columns as they are."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        text_of(text_col).alias("text"),
    )
    vectors = word_vectors(rows, cfg)
    plain = rows.select("doc_id", "text")
    features = staged(_features(plain, vectors, cfg), "features")
    model = fitted(features, labels, cfg)
    shared = docs.sparkSession.sparkContext.broadcast((vectors, model))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, network = shared.value
        for batch in batches:
            for part in parts(batch):
                x = pooled(*_buckets(part.column("text"), cfg), table)
                good = network.scores(x.astype(np.float64)) >= cfg.threshold
                yield part.filter(pa.array(good, pa.bool_())).select(["row"])

    rows = rows.select("row", "text")
    return rows.mapInArrow(task, rows.select("row").schema).select("row.*")
