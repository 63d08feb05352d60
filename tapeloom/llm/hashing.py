"""Words and shingles of a batch of texts as 64-bit hashes, without a Python object per word.

The words are the runs without ASCII white space of the lower-cased text. A word's hash is a
polynomial of its bytes modulo 2**64, taken from one running sum over all bytes of the batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
BASE = 0x2545F4914F6CDD1D
BASE_INVERSE = pow(BASE, -1, 1 << 64)
# Class of each byte: 0 for ASCII white space, 1 for all others.
SOLID = np.ones(256, np.uint8)
SOLID[[32, 9, 10, 11, 12, 13]] = 0
_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finisher)."""
    x = np.asarray(x, _U)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=_U) * GOLDEN)


class _Powers:
    """Powers of the base and of its inverse, as far as any batch has needed them."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, 1 << 20)
            with np.errstate(over="ignore"):
                steps = np.full(size, BASE, _U)
                steps[0] = 1
                self.up = np.multiply.accumulate(steps)
                steps[1:] = BASE_INVERSE
                self.down = np.multiply.accumulate(steps)


_powers = _Powers()
# Bytes hashed in one go, and the longest word that is hashed by the polynomial.
BLOCK_BYTES = 1 << 19
LONG_WORD = 1 << 20


class Words:
    """``hash`` of each word, ``first``: the number of the first word of each text and the total,
    ``start``/``end``: byte places of the words in the texts' lower-cased UTF-8 bytes.

    A word is a run of bytes of one class of ``classes``; class 0 is left out.
    """

    def __init__(self, texts: pa.Array, classes: np.ndarray = SOLID):
        texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
        count = len(texts)
        _, bounds, data = texts.buffers()
        bounds = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + count + 1]
        low, high = (int(bounds[0]), int(bounds[-1])) if count else (0, 0)
        raw = np.frombuffer(data, np.uint8)[low:high] if high > low else np.empty(0, np.uint8)
        bounds = bounds - low
        kind = classes[raw]
        change = np.ones(len(raw) + 1, bool)
        if len(raw):
            change[1:-1] = kind[1:] != kind[:-1]
        change[bounds] = True
        solid = kind != 0
        opens = solid & change[:-1]
        closes = solid & change[1:]
        start = np.flatnonzero(opens)
        end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(start, bounds)
        self.hash = self._hash(raw, start, end)
        self.start, self.end = start, end

    @staticmethod
    def _hash(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), _U)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(start):
                low = start[at]
                stop = max(at + 1, int(np.searchsorted(end, low + BLOCK_BYTES, "right")))
                size = int(end[stop - 1] - low)
                if size > LONG_WORD:  # one huge word: its digest, for a bounded table of powers
                    digest = hashlib.blake2b(raw[low : low + size].tobytes(), digest_size=8).digest()
                    out[at] = int.from_bytes(digest, "little")
                    at = stop
                    continue
                _powers.upto(size)
                sums = np.zeros(size + 1, _U)
                np.cumsum(_BYTE[raw[low : low + size]] * _powers.up[:size], out=sums[1:])
                a, b = start[at:stop] - low, end[at:stop] - low
                out[at:stop] = mix((sums[b] - sums[a]) * _powers.down[a])
                at = stop
        return out


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words; a shorter text is one run of all its words."""
    if not len(words):
        return words
    width = min(width, len(words))
    count = len(words) - width + 1
    with np.errstate(over="ignore"):
        out = np.zeros(count, _U)
        for i in range(width):
            out = out * _U(BASE) + words[i : i + count]
    return mix(out)


def shingle_table(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text in ascending order, how often each occurs, and row bounds."""
    words = Words(texts)
    hashes, counts, bounds = [], [], np.zeros(len(texts) + 1, np.int64)
    for i in range(len(texts)):
        found = shingles(words.hash[words.first[i] : words.first[i + 1]], width)
        if len(found):
            found = np.sort(found)
            new = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            hashes.append(found[new])
            counts.append(np.diff(np.r_[new, len(found)]))
            bounds[i + 1] = len(new)
    np.cumsum(bounds, out=bounds)
    if not hashes:
        return np.empty(0, _U), np.empty(0, np.int64), bounds
    return np.concatenate(hashes), np.concatenate(counts), bounds


def signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values, _U).view(np.int64)


def seeds(label: int, count: int) -> np.ndarray:
    """Odd 64-bit constants of a numbered family."""
    with np.errstate(over="ignore"):
        base = _U(label) * _U(0xD1342543DE82EF95)
        return mix(np.arange(1, count + 1, dtype=_U) * GOLDEN + base) | _U(1)
