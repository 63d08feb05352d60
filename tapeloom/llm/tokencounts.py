"""Token counts of a unigram vocabulary without the tokens: count-only Viterbi.

A text is cut at blanks as the tokenizers library's Metaspace does (blanks become U+2581, one is put
in front where none is). In each chunk an Aho-Corasick automaton names every vocabulary piece at every
end; dynamic programming keeps, per end, the best score and the number of pieces of that path, and
nothing to trace back. The rules are the tokenizers library's: among equal scores the earliest start
stays; a character that is no piece by itself may also pass as unknown, at the least score less 10;
unknown characters become bytes where the vocabulary has all 256, and else runs of them are one.

Chunks repeat, so each worker keeps the counts of a bounded number of them.

Defined results: missing and empty texts have no tokens and score 0; repeated rows are counted each;
an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.rows import text_of

MARK = "\u2581"
UNKNOWN_PENALTY = 10.0
MEMO_CHUNKS = 300_000
MEMO_LENGTH = 64


@dataclass(frozen=True)
class Vocabulary:
    """Pieces with scores; ``byte_fallback`` needs the pieces <0x00> to <0xFF>."""

    pieces: tuple[tuple[str, float], ...]
    byte_fallback: bool = True


@lru_cache(maxsize=2)
def zipf_vocabulary(path: str) -> Vocabulary:
    """The pieces of a sentencepiece file in their order of merit.

    A file of merges ranks its pieces by minus their rank instead of a probability; piece n gets the
    logarithm of 1 / (n + 10) as its score, unnormalised. Control and byte pieces keep score 0.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = []
    for i in range(model.get_piece_size()):
        special = model.is_control(i) or model.is_unknown(i) or model.is_byte(i)
        score = 0.0 if special else -math.log(10.0 - model.get_score(i))
        pieces.append((model.id_to_piece(i), score))
    return Vocabulary(tuple(pieces))


class Counter:
    """``count(text)``: number of pieces and score of the best path."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self._automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self._automaton.add_word(piece, (len(piece), score))
        self._automaton.make_automaton()
        self._single = {p for p, _ in vocabulary.pieces if len(p) == 1}
        self._unknown = min(s for _, s in vocabulary.pieces) - UNKNOWN_PENALTY
        names = {p for p, _ in vocabulary.pieces}
        self._bytes = vocabulary.byte_fallback and all(f"<0x{i:02X}>" in names for i in range(256))
        self._memo: dict[str, tuple[int, float]] = {}

    def path(self, chunk: str) -> tuple[int, float]:
        """Pieces and score of the best path through one chunk."""
        size = len(chunk)
        best = [0.0] * (size + 1)
        count = [0] * (size + 1)
        reached = [False] * (size + 1)
        unknown = [False] * (size + 1)
        ends = self._automaton.iter(chunk)
        last, match = next(ends, (size, None))
        for end in range(1, size + 1):
            while last == end - 1:  # longest first, so the earliest start comes first
                length, score = match
                start = end - length
                score += best[start]
                if not reached[end] or score > best[end]:
                    reached[end] = True
                    best[end], count[end] = score, count[start] + 1
                last, match = next(ends, (size, None))
            char = chunk[end - 1]
            if char not in self._single:
                score = self._unknown + best[end - 1]
                if not reached[end] or score > best[end]:
                    reached[end] = unknown[end] = True
                    best[end] = score
                    if self._bytes:
                        count[end] = count[end - 1] + len(char.encode("utf-8", "replace"))
                    else:
                        count[end] = count[end - 1] + (not unknown[end - 1])
        return count[size], best[size]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        text = text.replace(" ", MARK)
        chunks = text.removeprefix(MARK).split(MARK)
        memo = self._memo
        total, score = 0, 0.0
        for chunk in chunks:
            known = memo.get(chunk)
            if known is None:
                known = self.path(MARK + chunk)
                if len(chunk) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_CHUNKS:
                        memo.clear()
                    memo[chunk] = known
            total += known[0]
            score += known[1]
        return total, score


_held: list[tuple[str, Counter]] = []


def _counter(path: str) -> Counter:
    if not (_held and _held[0][0] == path):
        _held[:] = [(path, Counter(zipf_vocabulary(path)))]
    return _held[0][1]


def count_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, score per row; ``vocabulary`` is the path of a sentencepiece file."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(vocabulary)
        for batch in batches:
            found = [counter.count(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([n for n, _ in found], pa.int64()),
                    pa.array([s for _, s in found], pa.float64()),
                ],
                names=["doc_id", "n_tokens", "score"],
            )

    return rows.mapInArrow(
        task,
        T.StructType(
            [
                T.StructField("doc_id", rows.schema["doc_id"].dataType),
                T.StructField("n_tokens", T.LongType()),
                T.StructField("score", T.DoubleType()),
            ]
        ),
    )
