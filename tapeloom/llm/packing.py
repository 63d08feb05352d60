"""Packing by multiway differencing: token sequences of one length with little padding.

Each document is tokenised once and cut into whole windows of ``capacity`` tokens, which are
sequences by themselves, and a rest of under one window in pieces of at most ``piece`` tokens. The
rests are dealt by hash into groups of a bounded number of tokens. In each group Karmarkar-Karp
multiway differencing merges the two partial partitions with the largest spreads, the heaviest slots
of one with the lightest of the other, until one partition into near-equal windows is left. A group
starts with the fewest windows that could hold it; while the fullest one exceeds the capacity, the
number of windows rises by one.

Defined results: a missing text is empty; an empty text is the end id alone; repeated rows are packed
as often as they occur; equal sizes are taken in the order of their keys; an empty table gives no
rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm import tokens
from tapeloom.llm.rows import parts, row_keys, staged, text_of

KEY_BITS = 20
# Rows and bytes of text that are tokenised at a time: the more, the fewer words are looked up again.
SLICE = (10_000, 8 << 20)


@dataclass(frozen=True)
class Packing:
    """``group_windows`` and ``group_pieces`` bound what one task holds at a time."""

    tokenizer: str
    chunks: str = tokens.DROPS_BLANKS
    end_id: int = 1
    capacity: int = 2048
    piece: int = 512
    group_windows: int = 96
    group_pieces: int = 8192
    with_ids: bool = False
    memo_words: int = 100_000


def differencing(sizes: list[int], slots: int) -> np.ndarray:
    """The slot of each item in a partition into ``slots`` near-equal sums.

    A partition is its negated sums, heaviest first, and the items of each slot. Most merges bring
    a single item to a partition: it goes to the lightest slot, which then moves to its new rank.
    """
    if slots == 1:
        return np.zeros(len(sizes), np.int64)
    heap = [(-size, i, None, i) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    for made in range(len(sizes), 2 * len(sizes) - 1):
        spread, _, sums, items = heapq.heappop(heap)
        other_spread, _, other, more = heapq.heappop(heap)
        if other is None:
            if sums is None:
                sums = [spread] + [0] * (slots - 1)
                items = [[items], *([] for _ in range(slots - 1))]
            lightest, held = sums.pop() + other_spread, items.pop()
            held.append(more)
            rank = bisect_right(sums, lightest)
            sums.insert(rank, lightest)
            items.insert(rank, held)
        else:  # heaviest slots meet the lightest ones
            other.reverse()
            more.reverse()
            if sums is None:
                other[0] += spread
                more[0].append(items)
                sums, items = other, more
            else:
                sums = list(map(add, sums, other))
                items = list(map(add, items, more))
            order = sorted(range(slots), key=sums.__getitem__)
            sums = [sums[i] for i in order]
            items = [items[i] for i in order]
        heapq.heappush(heap, (sums[0] - sums[-1], made, sums, items))
    _, _, _, items = heap[0]
    slot = np.zeros(len(sizes), np.int64)
    for place, held in enumerate(items if len(sizes) > 1 else []):
        slot[held] = place
    return slot


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each item; windows are added until none exceeds the capacity."""
    count = max(1, -(-sum(sizes) // capacity))
    while True:
        slot = differencing(sizes, count)
        if np.bincount(slot, weights=sizes).max() <= capacity:
            return slot
        count += 1


def cuts(count: int, capacity: int, piece: int) -> list[tuple[int, int]]:
    """Start and length of each piece: whole windows, then near-equal parts of the rest."""
    whole = count // capacity
    bounds = [(i * capacity, capacity) for i in range(whole)]
    rest = count - whole * capacity
    parts = -(-rest // piece)
    at = whole * capacity
    for i in range(parts):
        length = rest // parts + (i < rest % parts)
        bounds.append((at, length))
        at += length
    return bounds


def pieces(docs: DataFrame, cfg: Packing, id_col: str, text_col: str) -> DataFrame:
    """One row per piece with its key; ``sequence_id`` only where the piece fills a window."""
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    end = np.array([cfg.end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(cfg.tokenizer, cfg.chunks, cfg.memo_words)
        keys = row_keys()
        next(keys)
        for batch in (p for b in batches for p in parts(b, *SLICE)):
            rows, columns = [], [[], [], [], [], [], []]
            starts, lengths, sums, totals, full, ids = columns
            for row, coded in enumerate(encoder.column(batch.column("text"))):
                coded += end
                total = len(coded) // 4
                for start, length in cuts(total, cfg.capacity, cfg.piece):
                    part = coded[4 * start : 4 * (start + length)]
                    rows.append(row)
                    starts.append(start)
                    lengths.append(length)
                    sums.append(zlib.crc32(part))
                    totals.append(total)
                    full.append(length == cfg.capacity)
                    if cfg.with_ids:
                        ids.append(part)
            key = keys.send(len(rows))
            arrays = [batch.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(key)]
            arrays += [pa.array(c, pa.int64()) for c in columns[:4]]
            arrays.append(pa.array(np.where(full, 2 * key + 1, 0), mask=~np.array(full, bool)))
            names = [*NAMES, "sequence_id"]
            if cfg.with_ids:
                arrays.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    fields = [T.StructField("doc_id", source.schema["doc_id"].dataType)]
    fields += [T.StructField(n, T.LongType()) for n in (*NAMES[1:], "sequence_id")]
    if cfg.with_ids:
        fields.append(T.StructField("ids", T.BinaryType()))
    return source.mapInArrow(cut, T.StructType(fields))


NAMES = ("doc_id", "key", "start", "length", "ids_crc32", "doc_tokens")


def pack(
    docs: DataFrame, cfg: Packing, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Pieces with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    With ``with_ids`` each piece also holds its ids (little-endian unsigned 32-bit).
    """
    cut = staged(pieces(docs, cfg, id_col, text_col), "pieces")
    rest = cut.filter("sequence_id IS NULL").drop("sequence_id")
    size = rest.agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces")).first()
    groups = max(
        1,
        -(-(size["tokens"] or 0) // (cfg.group_windows * cfg.capacity)),
        -(-size["pieces"] // cfg.group_pieces),
    )
    dealt = rest.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))

    def place(group: pa.Table) -> pa.Table:
        group = group.sort_by("key")
        length = group.column("length").to_numpy()
        slot = windows(length.tolist(), cfg.capacity)
        order = np.argsort(slot, kind="stable")
        before = np.cumsum(length[order]) - length[order]
        first = np.r_[True, np.diff(slot[order]) > 0]
        offset = np.empty(len(slot), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
        number = group.column("group")[0].as_py()
        sequence = 2 * ((number << KEY_BITS) + slot)
        return (
            group.drop_columns(["key", "group"])
            .append_column("sequence_id", pa.array(sequence))
            .append_column("offset", pa.array(offset))
        )

    names = [c for c in cut.columns if c not in ("key", "sequence_id")]
    placed_type = T.StructType(
        [cut.schema[c] for c in names]
        + [T.StructField(c, T.LongType()) for c in ("sequence_id", "offset")]
    )
    placed = dealt.groupBy("group").applyInArrow(place, placed_type)
    alone = cut.filter("sequence_id IS NOT NULL").select(
        *names, "sequence_id", F.lit(0).cast("long").alias("offset")
    )
    return alone.unionByName(placed)


def sequences(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row per sequence from pieces with ids: ``ids`` joined in order, ``length``, ``padding``.

    A sequence whose length is a power of two keeps it; any other is padded to ``capacity``.
    """
    joined = packed.groupBy("sequence_id").agg(
        F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"),
        F.sum("length").alias("length"),
    )
    power = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    ids = F.aggregate("parts.ids", F.lit(b""), lambda a, b: F.concat(a, b))
    return joined.select(
        "sequence_id",
        ids.alias("ids"),
        "length",
        F.when(power, 0).otherwise(F.lit(capacity) - F.col("length")).alias("padding"),
    )
