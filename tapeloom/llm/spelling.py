"""Spelling variants: words one edit apart, by permuterm rotations.

Words are runs of letters, lower-cased (A-Z only), counted over all texts. A word w of n characters
with an end mark $ has the rotations w[j:] $ w[:j]. Leaving out the last character of a rotation,
w[i], gives a prefix in which that character is skipped: all words that differ from w in character i
alone share it, and a word that lacks the character has it as a whole rotation. So every pair of words
one replaced, inserted or deleted character apart meets under one prefix. Rotations and prefixes are
sorted by 128-bit fingerprints (two polynomials of the code points), and groups of equal ones are
scanned in order. A group holds at most one word per character of the alphabet and the shorter word, so
no group grows with the corpus. Of the places where a character of a run of equal ones may be left out
only the first counts, so each pair of words is emitted once in either direction.

Words carry numbers in code-point order (from a range partitioning), which decide ties. The form of a
word is its most frequent near word if that is at least ``ratio`` times as frequent; forms are followed
to the root by doubling: each step lets every word jump as far again as it has come.

What crosses the network: counts per task and word, 2n + 1 fingerprints a word, near pairs. Texts are
counted in slices of words, and tasks hold at most about ``held`` bytes of distinct words; a word of n
characters takes time and memory in proportion to n.

Defined results: missing and empty texts have no words; a missing id is the empty one in the noise;
repeated rows count each; ties in frequency go to the word that is smaller in code points; a word
without near words has n_near 0, no form, and is its own root; an empty table gives no rows; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.llm.hashing import mix
from tapeloom.llm.rows import parts, row_keys, staged, text_of

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_U = np.uint64
# Odd multipliers of the two polynomials, and the end mark's code (no letter has it).
BASES = (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
END = 0
WHOLE, GAP, FIRST_GAP = 0, 1, 2


@dataclass(frozen=True)
class Spelling:
    """``noise``: a run's character is left out where this number divides its hash; None for never."""

    least_length: int = 5
    least_count: int = 3
    ratio: int = 2
    noise: int | None = 97
    held: int = 32 << 20


def _spelled(run: str, start: int, cfg: Spelling) -> str:
    """The run, less one character where the hash of id and run asks for it."""
    h = zlib.crc32(run.encode(), start)
    if h % cfg.noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, cfg: Spelling, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, n`` over all texts, of the words long and frequent enough."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        size = 0

        def rows() -> pa.RecordBatch:
            long = {w: n for w, n in held.items() if len(w) >= cfg.least_length}
            return pa.RecordBatch.from_arrays(
                [pa.array(long.keys(), pa.large_string()), pa.array(long.values(), pa.int64())],
                names=["word", "n"],
            )

        for batch in (p for b in batches for p in parts(b)):
            low = pc.ascii_lower(batch.column("text")).to_pylist()
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), low, strict=True):
                start = zlib.crc32(f"{doc_id}:".encode() if doc_id is not None else b":")
                found = (m[0] for m in RUN.finditer(text))
                while some := list(islice(found, 1 << 16)):
                    for run, n in Counter(some).items():
                        word = run if cfg.noise is None else _spelled(run, start, cfg)
                        if word not in held:
                            size += 2 * len(word) + 120
                        held[word] += n
                    if size > cfg.held:
                        yield rows()
                        held.clear()
                        size = 0
        yield rows()

    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    counted = source.mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= cfg.least_count)


def _numbered(words: DataFrame) -> DataFrame:
    """Adds ``id``, in the words' code-point order; to be staged."""
    ranged = words.repartitionByRange("word").sortWithinPartitions("word")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = row_keys()
        next(keys)
        for batch in batches:
            numbers = pa.array(keys.send(batch.num_rows))
            yield pa.RecordBatch.from_arrays([numbers, *batch.columns], names=["id", "word", "n"])

    return ranged.mapInArrow(task, "id long, word string, n long")


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, _U)
    steps[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(steps)


def rotations(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all rotations and prefixes of the words: word index, role, and both fingerprints.

    The prefix that skips character i and the rotation that starts at j are both sums of three
    parts, w[i + 1:], the end mark and w[:i], taken from one running sum of the word.
    """
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(lengths) - lengths
    # Place of each (word, j): j = 0..n for rotations, i = 0..n-1 for prefixes.
    whole = np.repeat(np.arange(len(words)), lengths + 1)
    j = np.arange(len(whole)) - np.repeat(np.cumsum(lengths + 1) - (lengths + 1), lengths + 1)
    gap = np.repeat(np.arange(len(words)), lengths)
    i = np.arange(len(gap)) - np.repeat(starts, lengths)
    repeated = np.zeros(len(codes), bool)
    repeated[1:] = codes[1:] == codes[:-1]
    repeated[starts[lengths > 0]] = False
    role = np.concatenate([np.full(len(whole), WHOLE), np.where(repeated, GAP, FIRST_GAP)]).astype(np.int8)
    owner = np.concatenate([whole, gap])
    head = np.concatenate([j, i])  # characters after the end mark
    tail = np.concatenate([j, i + 1])  # where the part before the end mark begins
    n = lengths[owner]
    keys = []
    longest = int(lengths.max(initial=0)) + 2
    for number, base in enumerate(BASES):
        with np.errstate(over="ignore"):
            value = mix((codes + 1 + (number << 32)).astype(_U) * _U(0x9E3779B97F4A7C15))
            up = _powers(base, longest)
            down = _powers(pow(base, -1, 1 << 64), longest)
            at = np.arange(len(codes)) - np.repeat(starts, lengths)
            # Ascending powers within each word, in one sum over all words.
            sums = np.concatenate([np.zeros(1, _U), np.cumsum(value * up[at])])
            low = starts[owner]
            back = (sums[low + n] - sums[low + tail]) * down[tail]  # w[tail:], from power 0 on
            front = sums[low + head] - sums[low]  # w[:head], from power 0 on
            mark = mix(np.array([END + 1 + (number << 32)], _U))[0]
            size = n - tail
            key = back + mark * up[size] + front * up[size + 1]
        keys.append(mix(key))
    return owner, role, keys[0], keys[1]


def _rotated(words: DataFrame) -> DataFrame:
    """``a, b`` (fingerprints), ``id, n, role`` of every rotation and prefix."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (p for b in batches for p in parts(b, rows=4096, size=1 << 18)):
            owner, role, a, b = rotations(batch.column("text").to_pylist())
            for at in range(0, len(owner), 1 << 16):
                cut = slice(at, at + (1 << 16))
                rows = pa.array(owner[cut])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(a[cut].view(np.int64)),
                        pa.array(b[cut].view(np.int64)),
                        batch.column("id").take(rows),
                        batch.column("n").take(rows),
                        pa.array(role[cut]),
                    ],
                    names=["a", "b", "id", "n", "role"],
                )

    source = words.select("id", "n", F.col("word").alias("text"))
    return source.mapInArrow(task, "a long, b long, id long, n long, role tinyint")


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of the groups of equal fingerprints, which lie side by side."""
    held: list[np.ndarray] | None = None

    def columns(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(c).to_numpy() for c in ("a", "b", "id", "n", "role")]

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a, b, ids, n, role = rows
        if not len(a):
            return
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        sizes = np.diff(np.r_[new, len(a)])
        company = np.repeat(sizes > 1, sizes)
        ids, n, role = ids[company], n[company], role[company]
        group = np.repeat(np.arange(len(new)), sizes)[company]
        left, right = [], []
        # Rows k apart in a group: as many steps as the largest group has rows.
        for k in range(1, int(sizes.max())):
            x = np.flatnonzero(group[k:] == group[:-k])
            y = x + k
            one, two = role[x], role[y]
            both = (one != WHOLE) & (two != WHOLE)
            shorter = ((one == WHOLE) & (two == FIRST_GAP)) | ((two == WHOLE) & (one == FIRST_GAP))
            near = (both | shorter) & (ids[x] != ids[y])
            left.append(x[near])
            right.append(y[near])
        if left:
            x, y = np.concatenate([*left, *right]), np.concatenate([*right, *left])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[x]), pa.array(ids[y]), pa.array(n[y])], names=["id", "near", "near_n"]
            )

    for batch in batches:
        rows = columns(batch)
        if held is not None:
            rows = [np.concatenate(both) for both in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        # The last group may go on in the next batch.
        same = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1])
        cut = int(np.argmax(same))
        held = [c[cut:] for c in rows]
        yield from pairs([c[:cut] for c in rows])
    if held is not None:
        yield from pairs(held)


def near_words(words: DataFrame) -> DataFrame:
    """``id, near, near_n``: every word's near words, each once. ``words`` has id, word, n."""
    sorted_ = _rotated(words).repartition("a").sortWithinPartitions("a", "b")
    return sorted_.mapInArrow(_scan, "id long, near long, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """``id, root`` from ``id, to``: frequency grows along forms, so chains end."""
    at = staged(forms, "roots")
    while True:
        onward = at.select(F.col("id").alias("to"), F.col("to").alias("further"))
        moved = at.join(onward, "to", "left").select(
            "id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")
        )
        moved = staged(moved, "roots")
        more = moved.where("moved").limit(1).count()
        at = moved.select("id", "to")
        if not more:
            return at.withColumnRenamed("to", "root")


def variants(docs: DataFrame, cfg: Spelling = Spelling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word with its near words' count, its form and its root."""
    words = staged(_numbered(word_counts(docs, cfg, id_col, text_col)), "words")
    best = F.max(F.struct("near_n", (-F.col("near")).alias("back")))
    near = near_words(words).groupBy("id").agg(F.count("*").alias("n_near"), best.alias("best"))
    near = near.select("id", "n_near", F.col("best.near_n").alias("near_n"), (-F.col("best.back")).alias("to"))
    near = staged(near, "near")
    rows = words.join(near, "id", "left").withColumn(
        "to", F.when(F.col("near_n") >= cfg.ratio * F.col("n"), F.col("to"))
    )
    rows = rows.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "to",
                       F.when(F.col("to").isNotNull(), F.col("near_n")).alias("form_n"))
    rows = staged(rows, "forms")
    roots = _roots(rows.where(F.col("to").isNotNull()).select("id", "to"))
    # Only the words of forms and roots are looked up again.
    named = rows.where(F.col("to").isNotNull()).select("id", "to").join(roots, "id")
    spelled = rows.select(F.col("id").alias("to"), F.col("word").alias("form"))
    named = named.join(spelled, "to").join(
        rows.select(F.col("id").alias("root"), F.col("word").alias("root_word")), "root"
    )
    named = named.select("id", "form", "root_word")
    return rows.join(named, "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
