"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Words are runs of letters or digits, lower-cased; shingles are five words. For a template of n
shingles the windows of a text are n shingles long and start every n/4 (every shingle, for the short
ones). A template contained to ``containment`` in one stretch of text shares, with the window nearest
to it, at least 0.8n - n/8 shingles, a similarity of 0.5 and more. The number of bands follows from
that similarity, ``rows`` and ``sure``, the probability with which at least one band collides.

Bands are computed only for windows that hold a shingle of some template, found by one vectorised
lookup per batch; no other window can collide, as its least hash would have to be a template's. Each
template that a window retrieves is verified exactly: the share of its distinct shingles in the
stretch of the window and one window length before and after it.

A template of fewer than five words has no shingle of five. It is compared with every run of as many
words, and found where a run equals it.

The templates are parameters of the job, a fixed and small table within every task.

Defined results: missing and empty texts match nothing; a template of fewer than five words is
contained whole or not at all, and its first place counts; templates without words never match; of
the others the best stretch counts, of equal ones the first; repeated rows match each; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.hashing import Words, mix, seeds, shingles
from tapeloom.llm.licensetexts import NOTICES, TEMPLATES
from tapeloom.llm.quality import SIGNS
from tapeloom.llm.rows import parts, text_of

_U = np.uint64
# Letters and digits are words; blanks and other signs part them.
LETTERS = np.where((SIGNS == 1) | (SIGNS == 2), 1, 0).astype(np.uint8)
FILTER_BITS = 20


@dataclass(frozen=True)
class Licenses:
    """``notices`` are further templates, by default those of a few words."""

    templates: dict[str, str] = field(default_factory=lambda: dict(TEMPLATES))
    notices: dict[str, str] = field(default_factory=lambda: dict(NOTICES))
    width: int = 5
    containment: float = 0.8
    similarity: float = 0.5
    rows: int = 2
    sure: float = 0.999

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.sure) / math.log(1 - self.similarity**self.rows))


def band_keys(found: np.ndarray, cfg: Licenses) -> list[int]:
    """One key per band of the MinHash signature of some shingles."""
    with np.errstate(over="ignore"):
        least = mix(found[:, None] ^ seeds(21, cfg.bands * cfg.rows)).min(0)
        grid = least.reshape(cfg.bands, cfg.rows)
        return mix((grid * seeds(23, cfg.rows)).sum(1) + seeds(25, cfg.bands)).tolist()


class Finder:
    """Templates and their bands; ``find`` looks through one text's words."""

    def __init__(self, cfg: Licenses):
        self.cfg = cfg
        texts = {**cfg.notices, **cfg.templates}
        names = sorted(texts)
        words = Words(pa.array([texts[n] for n in names], pa.string()), LETTERS)
        self.sets, self.retrieve = {}, {}
        # Of templates below the width: word count -> hash of all words -> names.
        self.runs: dict[int, dict[int, list[str]]] = {}
        for i, name in enumerate(names):
            own = words.hash[words.first[i] : words.first[i + 1]]
            found = shingles(own, cfg.width)
            if 0 < len(own) < cfg.width:
                self.runs.setdefault(len(own), {}).setdefault(int(found[0]), []).append(name)
            elif len(found):
                self.sets[name] = np.unique(found)
                size = len(found)
                for key in band_keys(self.sets[name], cfg):
                    self.retrieve.setdefault((size, key), set()).add(name)
        self.sizes = sorted({size for size, _ in self.retrieve})
        self.known = np.unique(np.concatenate([*self.sets.values(), np.empty(0, _U)]))
        self.maybe = np.zeros(1 << FILTER_BITS, bool)
        self.maybe[self.known >> _U(64 - FILTER_BITS)] = True

    def hits(self, found: np.ndarray) -> np.ndarray:
        """Places of shingles that some template has."""
        at = np.flatnonzero(self.maybe[found >> _U(64 - FILTER_BITS)])
        return at[np.isin(found[at], self.known)]

    def whole(self, words: np.ndarray) -> dict[str, tuple[float, int]]:
        """Containment and first place of each template below the width among a text's words."""
        best = {}
        for width, names in self.runs.items():
            runs = shingles(words, width) if len(words) >= width else words[:0]
            for value, same in names.items():
                at = np.flatnonzero(runs == _U(value))
                if len(at):
                    best.update(dict.fromkeys(same, (1.0, int(at[0]))))
        return best

    def find(self, words: np.ndarray) -> list[tuple[str, float, int]]:
        """(template, containment, first word of the window) of one text."""
        found = shingles(words, self.cfg.width)
        hits = self.hits(found)
        best = self.whole(words)
        for size in self.sizes if len(hits) else ():
            step = max(1, size // 4)
            # Windows that hold a hit: starts from hit - size + 1 to hit.
            low = np.maximum(hits - size + step, 0) // step
            starts = np.unique(
                np.concatenate([np.arange(a, h // step + 1) for a, h in zip(low, hits)]) * step
            )
            for start in starts.tolist():
                keys = band_keys(found[start : start + size], self.cfg)
                names = set().union(*(self.retrieve.get((size, k), ()) for k in keys))
                stretch = found[max(0, start - size) : start + 2 * size] if names else None
                for name in names:
                    want = self.sets[name]
                    share = float(np.isin(want, stretch).mean())
                    if share >= self.cfg.containment and share > best.get(name, (0.0, 0))[0]:
                        best[name] = share, start
        return [(name, *best[name]) for name in sorted(best)]


def scan(
    docs: DataFrame, cfg: Licenses | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, license, containment, first_word: the best stretch of each template in each text."""
    cfg = cfg or Licenses()
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(cfg)
        for batch in batches:
            for part in parts(batch):
                words = Words(part.column("text"), LETTERS)
                row, found = [], []
                for i in range(part.num_rows):
                    own = words.hash[words.first[i] : words.first[i + 1]]
                    matches = finder.find(own)
                    row += [i] * len(matches)
                    found += matches
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").take(pa.array(row, pa.int64())),
                        pa.array([f[0] for f in found], pa.string()),
                        pa.array([f[1] for f in found], pa.float64()),
                        pa.array([f[2] for f in found], pa.int64()),
                    ],
                    names=["doc_id", "license", "containment", "first_word"],
                )

    return rows.mapInArrow(
        task,
        T.StructType(
            [
                T.StructField("doc_id", rows.schema["doc_id"].dataType),
                T.StructField("license", T.StringType()),
                T.StructField("containment", T.DoubleType()),
                T.StructField("first_word", T.LongType()),
            ]
        ),
    )
