"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared lower-cased with white space runs as one blank. An item of m characters
may differ by k = floor(rate * m) edits. It is split into k + 1 near-equal pieces: a stretch of text
within k edits of the item holds one piece unchanged. An Aho-Corasick automaton over all pieces finds
the exact hits in whole texts; each hit fixes where the item would have to lie, and Myers' bit-parallel
distance verifies the window there.

The automaton goes to every task; items are counted first and taken in blocks of at most
``block_chars`` characters, one pass over the texts per block, so its size is bounded whatever the
number of items.

Defined results: missing and empty texts match nothing; items without a letter match nothing;
repeated items and rows are matched each; an empty table on either side gives no matches; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.rows import text_of


@dataclass(frozen=True)
class Edits:
    rate: float = 0.05
    block_chars: int = 1_000_000


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """Offset and text of budget + 1 near-equal pieces (fewer where the item is shorter)."""
    count = min(budget + 1, len(item))
    cuts = [len(item) * i // count for i in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def pattern_bits(item: str) -> dict[str, int]:
    bits: dict[str, int] = {}
    for i, c in enumerate(item):
        bits[c] = bits.get(c, 0) | 1 << i
    return bits


def distance(bits: dict[str, int], m: int, window: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any stretch of the window, and where it ends."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = mask, 0, m
    best, end = m, 0
    for i, c in enumerate(window, 1):
        eq = bits.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (mask & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, end = score, i
        up, down = up << 1 & mask, down << 1 & mask
        plus = down | (mask & ~(vertical | up))
        minus = up & vertical
    return best, end


class Matcher:
    """All items of one block; ``matches(text)`` yields (item number, distance, start, end)."""

    def __init__(self, items: list[str], rate: float):
        import ahocorasick

        self._items = items
        self._budget = [int(rate * len(i)) for i in items]
        self._bits: dict[int, dict[str, int]] = {}
        places: dict[str, list[tuple[int, int]]] = {}
        for number, item in enumerate(items):
            if item:
                for offset, piece in pieces(item, self._budget[number]):
                    places.setdefault(piece, []).append((number, offset))
        self._automaton = None
        if places:
            self._automaton = ahocorasick.Automaton()
            for piece, where in places.items():
                self._automaton.add_word(piece, (len(piece), where))
            self._automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        text = normal(text)
        if not text or self._automaton is None:
            return []
        hits: dict[int, list[int]] = {}
        for last, (size, where) in self._automaton.iter(text):
            for number, offset in where:
                hits.setdefault(number, []).append(last + 1 - size - offset)
        found = (self._best(text, number, sorted(set(at))) for number, at in sorted(hits.items()))
        return [f for f in found if f]

    def _best(self, text: str, number: int, starts: list[int]) -> tuple | None:
        item, budget = self._items[number], self._budget[number]
        m = len(item)
        for start in starts:
            if start >= 0 and text.startswith(item, start):
                return number, 0, start, start + m
        if not budget:
            return None
        bits = self._bits.setdefault(number, pattern_bits(item))
        best = None
        i = 0
        while i < len(starts):
            low = max(0, starts[i] - budget)
            high = starts[i] + m + budget
            i += 1
            while i < len(starts) and starts[i] - budget <= high:
                high = starts[i] + m + budget
                i += 1
            score, end = distance(bits, m, text[low:high])
            if score <= budget and (best is None or score < best[1]):
                best = number, score, max(0, low + end - m), low + end
        return best


def item_blocks(items: DataFrame, cfg: Edits, id_col: str, text_col: str) -> Iterator[list]:
    """Items in blocks of about ``block_chars`` characters, dealt by hash after they are counted.

    One block at a time is on the driver.
    """
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), text_of(text_col).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-size // cfg.block_chars) if size else 0
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(count, 1)))
    for i in range(count):
        yield rows.filter(part == i).orderBy("item_id", "text").collect()


def matches(
    docs: DataFrame,
    items: DataFrame,
    cfg: Edits = Edits(),
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """doc_id, item_id, distance, match_start, match_end (places in the compared text): the best
    match of each item in each text that holds it."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    names = ("distance", "match_start", "match_end")
    schema = T.StructType(
        [
            T.StructField("doc_id", rows.schema["doc_id"].dataType),
            T.StructField("item_id", items.schema[item_id_col].dataType),
            *[T.StructField(n, T.LongType()) for n in names],
        ]
    )
    out = docs.sparkSession.createDataFrame([], schema)
    item_type = out.select("item_id").toArrow().schema.field(0).type
    for block in item_blocks(items, cfg, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(
            [(r["item_id"], normal(r["text"])) for r in block]
        )
        out = out.unionByName(rows.mapInArrow(_matching(shared, cfg.rate, item_type), schema))
    return out


_held: list[tuple[list, float, Matcher]] = []


def _matcher(shared, rate: float) -> tuple[list, Matcher]:
    """Item ids and matcher of a broadcast block, built once per worker and block."""
    items = shared.value
    if not (_held and _held[0][0] is items and _held[0][1] == rate):
        _held[:] = [(items, rate, Matcher([text for _, text in items], rate))]
    return [i for i, _ in items], _held[0][2]


def _matching(shared, rate: float, item_type: pa.DataType):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matcher = _matcher(shared, rate)
        for batch in batches:
            rows, found = [], []
            for row, text in enumerate(batch.column("text")):
                for match in matcher.matches(text.as_py()):
                    rows.append(row)
                    found.append(match)
            columns = [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
            columns.append(pa.array([ids[f[0]] for f in found], item_type))
            columns += [pa.array([f[i] for f in found], pa.int64()) for i in (1, 2, 3)]
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "item_id", "distance", "match_start", "match_end"]
            )

    return task


def without_matches(
    docs: DataFrame,
    items: DataFrame,
    cfg: Edits = Edits(),
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; all columns stay as they are."""
    out = docs
    for block in item_blocks(items, cfg, item_id_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(
            [(r["item_id"], normal(r["text"])) for r in block]
        )

        def task(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            _, matcher = _matcher(shared, cfg.rate)
            for batch in batches:
                texts = batch.column(text_col).to_pylist()
                yield batch.filter(pa.array([not matcher.matches(t) for t in texts], pa.bool_()))

        out = out.mapInArrow(task, out.schema)
    return out
