"""Removal of long repeated byte strings by bucket-pointer refinement over sampled suffixes.

A byte goes if a string of ``length`` bytes that covers it also starts earlier (in a document of a
smaller id, or earlier in the same one). Suffixes are put into buckets of equal beginnings, and buckets
are refined until their members share ``length`` bytes; only members that still have company go on.

1. *Sampling.* Of the q-grams of each string of ``length`` bytes the one of least hash is its anchor
   (of equal ones the first). Equal strings have their anchors at equal places, so only anchors, about
   one place in forty, need to be sorted. The strings that share an anchor start at consecutive places:
   a *stretch* of bytes holds them all, around its anchor.
2. *Initial buckets* are the anchors' q-grams. One aggregate per bucket tells how many stretches it
   holds, whether they differ, and the least document. Buckets of one stretch are left.
3. *Equal stretches.* Where all stretches of a bucket are equal, all but the least document's go whole.
   Other buckets are refined by the whole stretch; again all but the least document's go whole, and
   the least ones, which differ from each other, stay open.
4. *Refinement.* An open stretch is a range of strings, from anchor at their end to anchor at their
   start. The range is split, by ``steps``: the strings of a part all hold the q-gram, the bytes before it
   from some offset on and the bytes behind it up to another. A part's bucket is this longer common part:
   its parent's bucket and those of the suffixes at the earlier and later offsets. Parts alone in their
   bucket are dropped, the others are split further, until each is a single string.
   A part whose members are also equal in all bytes of its strings is judged whole, as in step 3:
   the least document of its bucket keeps its first place; all others are repeated.

Buckets are fingerprints, two polynomials of 64 bits each: a q-gram has the first, a stretch the second
within its q-gram's bucket, parts and single strings have both. A bucket is never gathered: it is
an aggregate with map-side sums, and a join of its members with that one row, which adaptive execution
splits where a bucket has most rows. Within one document later repeats are found before any shuffle, so
a document sends each stretch once.

What crosses the network: 40 bytes an anchor, twice; the texts that have open stretches or removed
ranges, compressed; open parts. Texts are hashed in blocks of ``block`` bytes that overlap by a string,
so memory beside the text itself does not grow with it; a stretch that a block's end cuts is only another
stretch to the refinement, and the result stays the same.

Defined results: a missing text is empty; texts shorter than ``length`` lose nothing; a missing id sorts
before all others; rows of one id do not remove bytes of each other, each is judged against smaller ids
and itself, and repeated rows give the same result each; an empty table gives no rows; other columns are
ignored, whatever their names. Ids are whole numbers.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.hashing import mix
from tapeloom.llm.rows import parts, staged, text_of, with_fields
from tapeloom.session import drop_staged, staged_mark

_U = np.uint64
BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
_HIGH, _LOW = _U(0xFFFFFFFF00000000), _U(0xFFFFFFFF)
# Strings whose anchors are found in one go.
_PIECE = 1 << 15


@dataclass(frozen=True)
class Repeats:
    """``steps``: into how many parts a range is split in each refinement; ``gram``: the q of the
    initial buckets; ``block``: bytes hashed in one go."""

    length: int = 100
    gram: int = 24
    steps: tuple[int, ...] = (4, 5)
    block: int = 1 << 20

    def __post_init__(self):
        if not 0 < self.gram <= self.length or self.length - self.gram >= 256:
            raise ValueError("a string must hold its q-gram, and at most 255 bytes more")


class Sums:
    """Fingerprints of any stretch of some bytes, from one running sum for each polynomial."""

    _tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    _codes: dict[int, np.ndarray] = {}

    def __init__(self, raw: np.ndarray, number: int):
        self.up, self.down = self._powers(number, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, _U)
        # Bytes as an index of any other kind would be checked and copied first.
        codes = self._code(number).take(raw.astype(np.intp, copy=False), mode="wrap")
        with np.errstate(over="ignore"):
            np.multiply(codes, self.up[: len(raw)], out=codes)
            np.cumsum(codes, out=self.sums[1:])

    @classmethod
    def _code(cls, number: int) -> np.ndarray:
        if number not in cls._codes:
            with np.errstate(over="ignore"):
                cls._codes[number] = mix((np.arange(256, dtype=_U) + _U(1 + (number << 32))) * _U(0x9E3779B97F4A7C15))
        return cls._codes[number]

    @classmethod
    def _powers(cls, number: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        have = cls._tables.get(number)
        if have is None or len(have[0]) < n:
            made = []
            for base in (BASES[number], pow(BASES[number], -1, 1 << 64)):
                steps = np.full(max(n, 1 << 16), base, _U)
                steps[0] = 1
                with np.errstate(over="ignore"):
                    made.append(np.multiply.accumulate(steps))
            have = cls._tables[number] = (made[0], made[1])
        return have

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, q: int) -> np.ndarray:
        """Of all stretches of ``q`` bytes, not yet mixed."""
        out = self.sums[q:] - self.sums[:-q]
        with np.errstate(over="ignore"):
            return np.multiply(out, self.down[: len(out)], out=out)


def least_grams(grams: np.ndarray, window: int) -> np.ndarray:
    """For each run of ``window`` q-grams, hash and place of the one of least hash, of equal ones the first.

    Both share a number, the place in its lower half. Least numbers of runs that double in length
    give the least of every run.
    """
    value = grams & _HIGH
    value |= np.arange(len(grams), dtype=_U)
    spare = np.empty_like(value)
    length = 1
    while length < window:
        step = min(length, window - length)
        out = spare[: len(value) - step]
        np.minimum(value[:-step], value[step:], out=out)
        value, spare = out, value
        length += step
    return value


def stretches(raw: np.ndarray, cfg: Repeats, bounds: np.ndarray):
    """Of texts side by side: (text, bucket, fingerprint, start, strings, anchor) of each stretch.

    ``bounds`` are the texts' ends from 0 on. ``strings`` is the number of strings, and ``anchor`` the
    anchor's offset in the stretch. The bytes are taken piece by piece, so that the numbers of a
    piece stay in the processor's cache; a piece yields the stretches that start in it, whole.
    """
    size, q = cfg.length, cfg.gram
    window = size - q + 1
    places = len(raw) - size + 1
    lows = bounds[:-1]
    # Strings do not leave their text.
    stops = np.maximum(lows, bounds[1:] - size + 1)
    found = [tuple(np.empty(0, np.int64) for _ in range(6))]
    for first in range(0, places, _PIECE):
        # One place before tells whether the first string has a new anchor; no stretch has more
        # strings than ``window``.
        base, last = max(0, first - 1), min(places, first + _PIECE + window)
        piece = raw[base : last + size - 1].astype(np.intp)
        sums = Sums(piece, 0)
        at = least_grams(sums.grams(q), window)
        new = np.ones(len(at), bool)
        np.not_equal(at[1:], at[:-1], out=new[1:])
        low, high = np.searchsorted(lows, (base, last))
        new[lows[low:high] - base] = True
        start = np.flatnonzero(new) + base
        text = np.searchsorted(bounds, start, "right") - 1
        stop = np.minimum(np.r_[start[1:], last], stops[text])
        own = np.flatnonzero((stop > start) & (start >= first) & (start < first + _PIECE))
        text, start, stop = text[own], start[own], stop[own]
        count = stop - start
        begin = start - base
        anchor = (at[begin] & _LOW).astype(np.int64)
        with np.errstate(over="ignore"):
            shape = mix(((anchor - begin) << 32 | count).astype(_U))
        key = Sums(piece, 1).of(begin, begin + count + (size - 1)) ^ shape
        bucket = sums.of(anchor, anchor + q)
        found.append((text, bucket.view(np.int64), key.view(np.int64), start - bounds[text], count, anchor - begin))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def _again(text: np.ndarray, bucket: np.ndarray, key: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether a stretch stands earlier in its text, by rows."""
    again = np.zeros(len(text), bool)
    with np.errstate(over="ignore"):
        tag = mix(bucket.view(_U) + text.astype(_U) * _U(BASES[1])) ^ key.view(_U)
    held = np.sort(tag)
    held = held[1:][held[1:] == held[:-1]]
    if not len(held):
        return again
    # Only rows of a tag that occurs twice can be equal, and few rows have one.
    near = np.searchsorted(held, tag)
    rows = np.flatnonzero(held[np.minimum(near, len(held) - 1)] == tag)
    order = rows[np.lexsort((start[rows], key[rows], bucket[rows], text[rows]))]
    same = np.ones(len(order) - 1, bool)
    for column in (text, bucket, key):
        same &= column[order[1:]] == column[order[:-1]]
    again[order[1:][same]] = True
    return again


def _blocks(data: bytes, cfg: Repeats) -> Iterator[tuple[int, np.ndarray]]:
    """A text in blocks that overlap by all but one byte of a string."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, max(1, len(raw) - cfg.length + 1), cfg.block):
        yield at, raw[at : at + cfg.block + cfg.length - 1]


def _joined(batches: Iterator[pa.RecordBatch], cfg: Repeats) -> Iterator[tuple[pa.RecordBatch, int, list]]:
    """Texts in groups of about a block of bytes: (batch, first row, texts); a long one alone."""
    for batch in batches:
        held, size, first = [], 0, 0
        for row, text in enumerate(batch.column("text").to_pylist()):
            if held and size + len(text) > cfg.block:
                yield batch, first, held
                held, size, first = [], 0, row
            held.append(text)
            size += len(text)
        if held:
            yield batch, first, held


def _place(start: np.ndarray, count: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Start, number of strings and anchor of a stretch in one number."""
    return start << 16 | (count - 1) << 8 | anchor


def _merged(text: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping ranges joined; in order of text and start, and ends grow with starts."""
    if not len(text):
        return text, start, end
    new = np.flatnonzero(np.r_[True, (text[1:] != text[:-1]) | (start[1:] > end[:-1])])
    return text[new], start[new], end[np.r_[new[1:] - 1, len(text) - 1]]


def _sampled(rows: DataFrame, cfg: Repeats) -> DataFrame:
    """``bucket, stretch, doc, digest, place`` of every stretch, each once a document.

    Its further places in the document go, as the first starts earlier: rows of a negative ``place``
    hold the start of such a range in it, as ``-1 - start``, and the end in ``stretch``. They are in no
    bucket, but have one by which they are dealt, so that texts are read once for both.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first, texts in _joined(batches, cfg):
            if len(texts) == 1:
                found = []
                for at, raw in _blocks(texts[0], cfg):
                    some = stretches(raw, cfg, np.array([0, len(raw)]))
                    found.append((some[0], some[1], some[2], some[3] + at, some[4], some[5]))
                text, bucket, key, start, count, anchor = (np.concatenate(c) for c in zip(*found, strict=True))
            else:
                bounds = np.cumsum([0, *map(len, texts)])
                raw = np.frombuffer(b"".join(texts), np.uint8)
                text, bucket, key, start, count, anchor = stretches(raw, cfg, bounds)
            if not len(text):
                continue
            again = _again(text, bucket, key, start)
            once, later = np.flatnonzero(~again), np.flatnonzero(again)
            owner, low, high = _merged(text[later], start[later], start[later] + count[later] + cfg.length - 1)
            for row, columns in (
                (owner, (mix(high).view(np.int64), high, -1 - low)),
                (text[once], (bucket[once], key[once], _place(start, count, anchor)[once])),
            ):
                taken = pa.array(row + first)
                if not len(row):
                    continue
                bucket_of, key_of, place = columns
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket_of),
                        pa.array(key_of),
                        batch.column("doc").take(taken),
                        batch.column("digest").take(taken),
                        pa.array(place),
                    ],
                    names=["bucket", "stretch", "doc", "digest", "place"],
                )

    return rows.mapInArrow(task, "bucket long, stretch long, doc long, digest long, place long")


def _kept(df: DataFrame, label: str) -> DataFrame:
    """A staged table, after which the shuffle files of its making may go.

    Spark deletes the files of a shuffle when the driver collects the garbage that was its frame,
    which a driver with little to do may put off for long. The scheduler holds the last job's
    stages, so a look at the table, a job of one task, goes before.
    """
    out = staged(df, label, "zstd")
    out.isEmpty()
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return out


def _start() -> Column:
    return F.shiftright("place", 16)


def _strings() -> Column:
    return F.shiftright("place", 8).bitwiseAND(F.lit(255)) + 1


def _range(cfg: Repeats) -> list[Column]:
    """The bytes of a stretch."""
    return [
        "doc",
        "digest",
        _start().alias("start"),
        (_start() + _strings() + cfg.length - 1).alias("end"),
    ]


def _whole(sampled: DataFrame, cfg: Repeats) -> tuple[DataFrame, DataFrame]:
    """Ranges that go with whole stretches, and the stretches still open: steps 2 and 3."""
    buckets = sampled.where("place >= 0").groupBy("bucket").agg(
        F.count("*").alias("n"),
        F.min("doc").alias("least"),
        F.min("stretch").alias("one"),
        F.max("stretch").alias("other"),
    )
    shared = buckets.where("n > 1").select("bucket", "least", (F.col("one") != F.col("other")).alias("mixed"))
    known = sampled.join(shared, "bucket", "left").where("place < 0 OR mixed OR doc > least")
    known = _kept(known, "shared-buckets")
    own = known.where("place < 0")
    own = own.select("doc", "digest", (-1 - F.col("place")).alias("start"), F.col("stretch").alias("end"))
    known = known.where("place >= 0")
    equal = known.where(~F.col("mixed")).select(*_range(cfg))
    mixed = known.where("mixed").drop("least", "mixed")
    least = mixed.groupBy("bucket", "stretch").agg(F.min("doc").alias("least"))
    judged = _kept(mixed.join(least, ["bucket", "stretch"]), "mixed-buckets")
    later = judged.where(F.col("doc") > F.col("least")).select(*_range(cfg))
    open_ = judged.where(F.col("doc") == F.col("least")).select("doc", "digest", "place")
    return own.unionByName(equal).unionByName(later), open_


def _packed(docs: DataFrame, *more: str) -> DataFrame:
    """``doc, digest, packed``: texts compressed, for a shuffle."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in (p for b in batches for p in parts(b)):
            texts = pa.array([press.compress(t) for t in batch.column("text").to_pylist()], pa.binary())
            columns = [batch.column(c) for c in (*more, "doc", "digest")]
            yield pa.RecordBatch.from_arrays([*columns, texts], names=[*more, "doc", "digest", "packed"])

    kept = docs.select(*more, "doc", "digest")
    return docs.mapInArrow(task, with_fields(kept.schema, ("packed", T.BinaryType())))


def _snippets(docs: DataFrame, open_: DataFrame, cfg: Repeats) -> DataFrame:
    """``doc, digest, place, bytes`` of the open stretches."""
    wanted = open_.groupBy("doc", "digest").agg(F.collect_set("place").alias("places"))
    held = _packed(docs).join(wanted, ["doc", "digest"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            rows, held_places, cuts, size = [], [], [], 0
            for row in range(batch.num_rows):
                text = press.decompress(batch.column("packed")[row].as_py())
                places = batch.column("places")[row].values.to_numpy()
                start, end = places >> 16, (places >> 16) + (places >> 8 & 255) + cfg.length
                cuts += [text[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
                rows.append(np.full(len(places), row))
                held_places.append(places)
                size += int((end - start).sum())
                if size < cfg.block and row + 1 < batch.num_rows:
                    continue
                one = pa.array(np.concatenate(rows))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc").take(one),
                        batch.column("digest").take(one),
                        pa.array(np.concatenate(held_places)),
                        pa.array(cuts, pa.binary()),
                    ],
                    names=["doc", "digest", "place", "bytes"],
                )
                rows, held_places, cuts, size = [], [], [], 0

    return held.mapInArrow(task, "doc long, digest long, place long, bytes binary")


def _clipped(place: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest number of bytes before the anchor, of a part's strings in the stretch itself."""
    anchor = place & 255
    return np.maximum(low, anchor - (place >> 8 & 255)), np.minimum(high, anchor)


def _parts(snippets: DataFrame, split: int, cfg: Repeats) -> DataFrame:
    """``a, b`` (bucket), ``whole``, ``doc, digest, place, part`` of each part of the ranges left in ``ranges``.

    A string is told by how many of its bytes stand before the anchor, l = 0..length - q. A range
    is l's [low, high]; what its strings share is from ``low`` bytes before the anchor to
    length - q - ``high`` bytes behind its q-gram. ``ranges`` lists low << 8 | high. ``whole`` is the
    fingerprint of all bytes of the part's strings that the stretch holds, and of which these are.
    """
    rest = cfg.length - cfg.gram

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(i, 4096) for b in batches for i in range(0, b.num_rows, 4096)):
            if not batch.num_rows:
                continue
            texts = batch.column("bytes").cast(pa.large_binary())
            ends = np.cumsum(np.concatenate([[0], pc.binary_length(texts).to_numpy()]))
            raw = np.frombuffer(b"".join(texts.to_pylist()), np.uint8).astype(np.intp)
            lists = batch.column("ranges")
            ranges = lists.flatten().to_numpy()
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(lists).to_numpy())
            place = batch.column("place").to_numpy()[row]
            anchor, count = place & 255, (place >> 8 & 255) + 1
            low, high = ranges >> 8, ranges & 255
            width = -(-(high - low + 1) // split)
            pieces = []
            for k in range(min(split, int((high - low).max(initial=0)) + 1)):
                a = low + k * width
                b = np.minimum(high, a + width - 1)
                # Strings of the stretch itself: l from anchor down to anchor - count + 1.
                some = np.flatnonzero((a <= b) & (a <= anchor) & (b >= anchor - count + 1))
                pieces.append((row[some], a[some], b[some]))
            row, a, b = (np.concatenate(c) for c in zip(*pieces, strict=True))
            place = batch.column("place").to_numpy()[row]
            middle = ends[row] + (place & 255)
            # A range that reaches beyond the stretch shares less than the stretch holds on that side.
            begin, end = middle - a, middle + cfg.gram + rest - b
            sums = [Sums(raw, number) for number in (0, 1)]
            keys = [one.of(begin, end) for one in sums]
            part = a << 8 | b
            keys[0] ^= mix(part.astype(_U))
            first, last = _clipped(place, a, b)
            whole = sums[1].of(middle - last, middle + cfg.length - first) ^ mix((first << 8 | last).astype(_U))
            taken = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys[0].view(np.int64)),
                    pa.array(keys[1].view(np.int64)),
                    pa.array(whole.view(np.int64)),
                    batch.column("doc").take(taken),
                    batch.column("digest").take(taken),
                    pa.array(place),
                    pa.array(part.astype(np.int32)),
                ],
                names=["a", "b", "whole", "doc", "digest", "place", "part"],
            )

    return snippets.mapInArrow(task, "a long, b long, whole long, doc long, digest long, place long, part int")


def _refined(snippets: DataFrame, cfg: Repeats) -> DataFrame:
    """Ranges that go of the open stretches: step 4."""
    spark, rest = snippets.sparkSession, cfg.length - cfg.gram
    ranges = F.array(F.lit(rest).cast("int"))  # one range, [0, rest]
    open_ = snippets.withColumn("ranges", ranges)
    anchor = F.col("place").bitwiseAND(F.lit(255))
    # Strings by the bytes before their anchor, as in _clipped.
    first = F.greatest(F.shiftright("part", 8).cast("long"), anchor + 1 - _strings())
    last = F.least(F.col("part").bitwiseAND(F.lit(255)).cast("long"), anchor)
    settled = []
    # Strings share all bytes that they have, so the last parts, of one string, are all equal.
    for split in (*cfg.steps, rest + 1):
        mark = staged_mark()
        found = _kept(_parts(open_, split, cfg), "parts")
        until = staged_mark()
        company = found.groupBy("a", "b").agg(
            F.count("*").alias("n"),
            F.min("doc").alias("least"),
            F.min("whole").alias("one"),
            F.max("whole").alias("other"),
        )
        company = company.where("n > 1").select("a", "b", "least", (F.col("one") != F.col("other")).alias("mixed"))
        own = ~F.col("mixed") & (F.col("doc") == F.col("least"))
        # Of parts in later documents nothing but the place is needed on.
        bucket = [F.when(own, F.col(c)).alias(c) for c in "ab"]
        judged = found.join(company, ["a", "b"])
        judged = judged.select("doc", "digest", "place", "part", "mixed", own.alias("own"), *bucket)
        judged = _kept(judged, "shared-parts")
        drop_staged(spark, mark, until)
        middle = _start() + anchor
        place = [(middle - last).alias("start"), (middle - first + cfg.length).alias("end")]
        settled.append(judged.where(~F.col("mixed")).select("own", "a", "b", "doc", "digest", *place))
        kept = judged.where("mixed").groupBy("doc", "digest", "place").agg(F.collect_set("part").alias("ranges"))
        open_ = snippets.join(kept, ["doc", "digest", "place"])
    judged = reduce(DataFrame.unionByName, settled)
    # In the least document itself all places but the first go.
    own = judged.where("own")
    once = own.groupBy("a", "b", "digest").agg(F.count("*").alias("n"), F.min("start").alias("first"))
    again = own.join(once.where("n > 1"), ["a", "b", "digest"]).where(F.col("start") > F.col("first"))
    gone = judged.where("NOT own").select("doc", "digest", "start", "end")
    return gone.unionByName(again.select("doc", "digest", "start", "end"))


def cut(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    """The text without some disjoint runs, in order."""
    kept, at = [], 0
    for start, end in runs:
        kept.append(text[at:start])
        at = end
    kept.append(text[at:])
    return b"".join(kept)


def without_repeats(
    docs: DataFrame, cfg: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: doc_id, n_bytes, kept (the bytes left), spans (start and end of the runs that went)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select(
        "doc_id",
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"),
        F.xxhash64("text").alias("digest"),
        F.col("text").cast("binary").alias("text"),
    )
    mark = staged_mark()
    whole, open_ = _whole(_sampled(rows.select("doc", "digest", "text"), cfg), cfg)
    snippets = _kept(_snippets(rows.select("doc", "digest", "text"), open_, cfg), "snippets")
    gone = whole.unionByName(_refined(snippets, cfg)).groupBy("doc", "digest")
    until = staged_mark()
    gone = _kept(gone.agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("gone")), "ranges")
    drop_staged(spark, mark, until)
    held = _packed(rows, "doc_id").join(gone, ["doc", "digest"], "left").select("doc_id", "packed", "gone")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in (b.slice(i, 64) for b in batches for i in range(0, b.num_rows, 64)):
            sizes, kept, spans = [], [], []
            for row in range(batch.num_rows):
                text = press.decompress(batch.column("packed")[row].as_py())
                ranges = batch.column("gone")[row]
                runs = []
                if ranges.is_valid:
                    low, high = (ranges.values.field(c).to_numpy() for c in ("start", "end"))
                    # Ends of ranges by their starts need not grow: the furthest so far counts.
                    high = np.maximum.accumulate(high)
                    _, low, high = _merged(np.zeros(len(low)), low, high)
                    runs = list(zip(low.tolist(), high.tolist(), strict=True))
                sizes.append(len(text))
                kept.append(cut(text, runs))
                spans.append([{"start": a, "end": b} for a, b in runs])
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(kept, pa.binary()),
                 pa.array(spans, span)],
                names=["doc_id", "n_bytes", "kept", "spans"],
            )

    return held.mapInArrow(
        task,
        with_fields(
            held.select("doc_id").schema,
            ("n_bytes", T.LongType()),
            ("kept", T.BinaryType()),
            ("spans", T._parse_datatype_string("array<struct<start:long,end:long>>")),
        ),
    )
