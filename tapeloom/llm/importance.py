"""Importance resampling towards a target text distribution by hashed n-grams.

Texts are lower-cased (A-Z only) and cut at every ASCII character that is no letter or digit, by Arrow
kernels: ``ascii_lower``, ``split_pattern_regex``, ``list_flatten``, ``dictionary_encode``. Runs of one
to ``width`` words come from shifting the dictionary's indices: a run of k words is a pair of a run of
k - 1 words and a word, and only distinct pairs are hashed, by carrying the shorter run's CRC on. Each
task adds its features up in one array of ``buckets`` counts; the sums, and the target's, give one gain
per bucket. A second pass over the texts takes the gains by bucket and adds them up per document.

The draw is a Gumbel top-k: the weight plus a noise that the document's id and the seed decide. Ranks
come from a range partitioning by score and the sizes of its parts; nothing is ranked in one task.

What crosses the network: ``buckets`` counts a task, the gains, and five numbers a document. A text
above ``slice_bytes`` is counted in pieces cut between words, each with the words before it that its
first runs need, so memory does not grow with a text (a single word is never cut).

Defined results: a missing or empty text has no features and the weight 0; a missing id counts as the
empty one in the noise and sorts before all others; ties go to the smaller id, then to fewer features;
repeated rows are documents of their own, count each, and of equal ones either comes first; without
documents there are no rows; without a target all its counts are 0; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.rows import parts, staged, text_of

# Characters between words, of lower-cased texts: ASCII without digits and small letters.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_CUT = re.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@dataclass(frozen=True)
class Resampling:
    """``percent`` of the documents with at least ``least_words`` words are drawn."""

    buckets: int = 10_000
    width: int = 3
    percent: int = 5
    least_words: int = 20
    seed: int = 42
    slice_bytes: int = 4 << 20


class Features:
    """Words of an array of texts, and the buckets of all their runs of up to ``width`` words.

    ``levels`` holds, for each run length: the text of each run, its index among the distinct runs,
    and the bucket of each distinct run.
    """

    def __init__(self, texts: pa.Array, cfg: Resampling):
        lists = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=BETWEEN)
        words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
        some = pc.not_equal(pc.binary_length(words), 0)
        coded = words.filter(some).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        self.owner = owner.filter(some).to_numpy()
        self.n_words = np.bincount(self.owner, minlength=len(texts))
        spelled = [w.encode() for w in coded.dictionary.to_pylist()]
        crc = [zlib.crc32(w) for w in spelled]
        follows = [b" " + w for w in spelled]
        runs, at = codes, np.arange(len(codes))
        self.levels = [(self.owner, codes, self._bucket(crc, cfg))]
        for k in range(1, cfg.width):
            go = np.flatnonzero(self.owner[k:] == self.owner[: len(codes) - k]) if k < len(codes) else at[:0]
            # ``at`` says where the runs of k words start; those that can grow are among them.
            before = runs[np.searchsorted(at, go)]
            last = codes[go + k]
            pairs = before * max(1, len(spelled)) + last
            _, first, runs = np.unique(pairs, return_index=True, return_inverse=True)
            crc = [
                zlib.crc32(follows[w], crc[r])
                for r, w in zip(before[first].tolist(), last[first].tolist(), strict=True)
            ]
            at = go
            self.levels.append((self.owner[go], runs, self._bucket(crc, cfg)))

    @staticmethod
    def _bucket(crc: list[int], cfg: Resampling) -> np.ndarray:
        return np.array(crc, np.int64) % cfg.buckets

    def histogram(self, cfg: Resampling, sign: np.ndarray) -> np.ndarray:
        total = np.zeros(cfg.buckets, np.int64)
        for owner, runs, bucket in self.levels:
            each = np.bincount(runs, weights=sign[owner], minlength=len(bucket)).astype(np.int64)
            np.add.at(total, bucket, each)
        return total

    def sums(self, gains: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
        """Per text: number of runs, and the sum of their buckets' gains."""
        count, weight = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64)
        for owner, runs, bucket in self.levels:
            taken = pc.take(pa.array(gains[bucket]), pa.array(runs)).to_numpy()
            ends = np.searchsorted(owner, np.arange(n_texts + 1))
            count += np.diff(ends)
            weight += np.diff(np.concatenate([[0], np.cumsum(taken)])[ends])
        return count, weight


def _pieces(text: bytes, cfg: Resampling) -> Iterator[tuple[bytes, int]]:
    """A long text in pieces cut between words: (piece with the words before it, 1), and for what
    was counted twice (those words alone, -1)."""
    text = text.lower()
    at, carried = 0, b""
    while at < len(text):
        cut = _CUT.search(text, min(len(text), at + cfg.slice_bytes))
        stop = cut.start() if cut else len(text)
        yield carried + text[at:stop], 1
        if carried:
            yield carried, -1
        # Words before the cut, from as far back as they need; most often from the last bytes.
        span = 256
        while True:
            found = _WORD.findall(text, max(0, stop - span), stop)
            if len(found) >= cfg.width or span >= stop:
                break
            span *= 4
        kept = found[-(cfg.width - 1) :] if cfg.width > 1 else []
        carried = b"".join(w + b" " for w in kept)
        at = stop


def _slices(batches: Iterator[pa.RecordBatch], cfg: Resampling):
    """(rows, texts, row of each text, sign of each text) in bounded slices."""
    for batch in (p for b in batches for p in parts(b, rows=1024, size=cfg.slice_bytes)):
        texts = batch.column("text")
        one = np.ones(len(texts), np.int64)
        if len(texts) == 1 and len(raw := texts.cast(pa.binary())[0].as_py()) > cfg.slice_bytes:
            for piece, sign in _pieces(raw, cfg):
                yield batch, pa.array([piece.decode()]), np.zeros(1, np.int64), one * sign
            yield batch, None, None, None
        else:
            yield batch, texts, np.arange(len(texts)), one
            yield batch, None, None, None


def bucket_counts(docs: DataFrame, cfg: Resampling, text_col: str = "text") -> DataFrame:
    """``bucket, n``: how many features of all documents fall into each bucket that has any."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cfg.buckets, np.int64)
        for _, texts, _, sign in _slices(batches, cfg):
            if texts is not None:
                total += Features(texts, cfg).histogram(cfg, sign)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(text_of(text_col).alias("text"))
    return rows.mapInArrow(task, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _counted(docs: DataFrame, cfg: Resampling, text_col: str) -> np.ndarray:
    total = np.zeros(cfg.buckets, np.int64)
    for bucket, n in bucket_counts(docs, cfg, text_col).collect():  # at most ``buckets`` rows
        total[bucket] = n
    return total


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of the smoothed target and source shares of each bucket, in thousandths."""
    n = len(source)
    ratio = (target + 1.0) * float(source.sum() + n) / ((source + 1.0) * float(target.sum() + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(doc_id, seed: int) -> int:
    """A Gumbel draw in thousandths that the id and the seed decide."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, cfg: Resampling, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, n_words, n_features, weight, score`` of every row."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    id_type = source.schema["doc_id"].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = count = weight = None
        for batch, texts, rows, sign in _slices(batches, cfg):
            if texts is not None:
                if words is None:
                    words, count, weight = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
                found = Features(texts, cfg)
                n, w = found.sums(gain, len(texts))
                words[rows] += sign * found.n_words
                count[rows] += sign * n
                weight[rows] += sign * w
                continue
            drawn = np.array([noise(i, cfg.seed) for i in batch.column("doc_id").to_pylist()], np.int64)
            columns = [batch.column("doc_id"), *map(pa.array, (words, count, weight, weight + drawn))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight", "score"])
            words = None

    return source.mapInArrow(
        task, f"doc_id {id_type}, n_words long, n_features long, weight long, score long"
    )


def _order() -> list[Column]:
    return [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features").asc(), F.col("weight").asc()]


def draw(weighed: DataFrame, cfg: Resampling) -> DataFrame:
    """Adds ``rank``: the place of a drawn row in the order of scores, from 1; else null.

    ``weighed`` is read more than once and should be staged.
    """
    spark = weighed.sparkSession
    fit = weighed.where(F.col("n_words") >= cfg.least_words)
    unfit = weighed.where(F.col("n_words") < cfg.least_words)
    ranged = fit.repartitionByRange(*_order()).withColumn("_part", F.spark_partition_id())
    ranged = staged(ranged, "ranged")
    # One row per part of the range partitioning, whatever the documents.
    sizes = sorted(ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())
    wanted = cfg.percent * sum(n for _, n in sizes) // 100
    before, total = [], 0
    for part, n in sizes:
        if total < wanted:
            before.append((part, total))
        total += n
    starts = spark.createDataFrame(before, "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*_order()))
    placed = ranged.join(F.broadcast(starts), "_part").withColumn("rank", place + F.col("_before"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= wanted, F.col("rank")))
    after = ranged.join(F.broadcast(starts), "_part", "left_anti")
    none = F.lit(None).cast("long")
    columns = [*weighed.columns, "rank"]
    return (
        placed.select(*columns)
        .unionByName(after.withColumn("rank", none).select(*columns))
        .unionByName(unfit.withColumn("rank", none).select(*columns))
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    cfg: Resampling = Resampling(),
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text: str = "text",
) -> DataFrame:
    """Every document's n_words, n_features, weight, score and, where drawn, rank."""
    gain = gains(_counted(docs, cfg, text_col), _counted(target, cfg, target_text))
    return draw(staged(weigh(docs, gain, cfg, id_col, text_col), "weighed"), cfg)


def drawn(docs: DataFrame, target: DataFrame, cfg: Resampling = Resampling(), id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose ids are drawn, whole."""
    ids = resample(docs, target, cfg, id_col).where(F.col("rank").isNotNull())
    ids = ids.select(F.col("doc_id").alias("_drawn")).distinct()
    return docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(F.col("_drawn")), "left_semi")
