"""Token ids of whole texts by the tokenizers library, with a bounded memo of words.

The library spends most of its time on normalising, cutting and merging the same words again and
again. For texts of Latin characters the tokenizer's own cutting rule is restated here as a pattern
over those characters, and each distinct word goes through the library's model once while it is in
the memo. Any other text, and any that holds a special token, goes through the library whole. Both
ways give the ids of one call over the text; the tests compare them.

Where no word crosses a blank, a column of texts is split at blanks by Arrow and each distinct
stretch of a column is cut into words once.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

# Latin characters on which all Unicode versions agree about case, kind and normal form. Left out:
# rarer blanks and controls, numerals that are no decimal digits, and the dotted capital I.
OTHER = re.compile(r"[^\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ɏ]")
LOWER = r"a-z\xaa\xb5\xba\xdf-\xf6\xf8-ʯⱥⱦ"  # some capitals up to ɏ have their small letter beyond it
LETTER = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ɏ"
SHORT = r"'s|'t|'re|'ve|'m|'ll|'d"

# Rules of the two vocabularies: lower case without blanks, and words with the blank before them.
DROPS_BLANKS = rf"{SHORT}|[{LOWER}]+|[0-9]|[^\s{LOWER}0-9]+"
LEADING_BLANKS = rf"{SHORT}| ?[{LETTER}]+| ?[0-9]+| ?[^\s{LETTER}0-9]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[int, str]:
    """The character that stands for each byte: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {b: chr(b) for b in prints} | {b: chr(256 + n) for n, b in enumerate(others)}


# Longer words are not kept: they are rare, and would make the memo's size a matter of the texts.
LONGEST_KEPT = 64


class _Memo(dict):
    """Ids of words, computed when they are missed; words in use survive a change of generation.

    A generation ends with its last word, in the middle of a text or not.
    """

    def __init__(self, ids, words: int):
        super().__init__()
        self._ids, self._words = ids, words
        self._old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        found = self._old.get(word)
        if found is None:
            found = self._ids(word)
        if len(word) <= LONGEST_KEPT:
            if len(self) >= self._words:
                self._old = dict(self)
                self.clear()
            self[word] = found
        return found

    def passing(self, word: str) -> bytes:
        """Ids of a word that need not be kept."""
        return self._old.get(word) or self._ids(word)

    def held(self) -> int:
        """Words in both generations."""
        return len(self) + len(self._old)


class Encoder:
    """``encode(texts)`` gives each text's ids as little-endian unsigned 32-bit integers.

    ``memo`` words of at most 64 characters are kept per worker in each of two generations: some 170
    bytes each for words of prose, and never more than about 700.
    """

    def __init__(self, path: str, words: str, memo: int = 100_000):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._alphabet = byte_alphabet()
        self._bytes = [i.to_bytes(4, "little") for i in range(self._tokenizer.get_vocab_size())]
        self._words = re.compile(words).findall
        self._drops_blanks = words == DROPS_BLANKS
        special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)) or r"(?!)").search
        self._memo = _Memo(self._word, memo)

    def _word(self, word: str) -> bytes:
        """Ids of one word: its bytes in the vocabulary's alphabet, through the model."""
        shown = word
        if not (word.isascii() and word.isalnum()):  # those stand for themselves in the alphabet
            shown = word.encode().decode("latin-1").translate(self._alphabet)
        return b"".join([self._bytes[t.id] for t in self._model.tokenize(shown)])

    def _foreign(self, text: str) -> bool:
        """Whether a text goes through the library whole."""
        return bool(OTHER.search(text) or self._special(text))

    def _whole(self, text: str) -> bytes:
        ids = self._tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def one(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self._foreign(text):
            return self._whole(text)
        words = self._words(text.lower() if self._drops_blanks else text)
        return b"".join(map(self._memo.__getitem__, words))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return [self.one(t) for t in texts]

    def column(self, texts: pa.Array) -> list[bytes]:
        """The ids of ``encode`` for an Arrow column; each distinct stretch is looked up once.

        Of words that stand alone, those that occur once in the column are not kept.
        """
        spelled = texts.to_pylist()
        if not self._drops_blanks:
            return self.encode(spelled)
        foreign = [bool(t) and self._foreign(t) for t in spelled]
        plain = pc.if_else(pa.array(foreign, pa.bool_()), "", texts.fill_null(""))
        split = pc.ascii_split_whitespace(plain)  # texts that are not foreign have no other blanks
        stretches = split.flatten().dictionary_encode()
        distinct = stretches.dictionary.to_numpy(zero_copy_only=False)
        distinct = "\n".join(distinct).lower().split("\n") if len(distinct) else []
        counts = np.bincount(stretches.indices.to_numpy(), minlength=len(distinct)).tolist()
        memo, words, ids = self._memo, self._words, []
        for stretch, count in zip(distinct, counts, strict=True):
            if not stretch.isalpha():
                ids.append(b"".join(map(memo.__getitem__, words(stretch))))
            elif count > 1:
                ids.append(memo[stretch])
            else:
                ids.append(memo.get(stretch) or memo.passing(stretch))
        found = pa.array(ids, pa.large_binary()).take(stretches.indices)
        _, offsets, data = found.buffers()
        last = np.cumsum(pc.list_value_length(split).to_numpy())
        bounds = np.frombuffer(offsets, np.int64)[np.r_[0, last]]  # of texts: their stretches adjoin
        buffers = [None, pa.py_buffer(bounds), data]
        coded = pa.Array.from_buffers(pa.large_binary(), len(spelled), buffers).to_pylist()
        return [
            self._whole(t) if whole else c for t, whole, c in zip(spelled, foreign, coded, strict=True)
        ]


@lru_cache(maxsize=4)
def encoder(path: str, words: str, memo: int) -> Encoder:
    """One encoder per worker process and tokenizer file."""
    return Encoder(path, words, memo)


def public_file(name: str) -> str:
    """Place of a vocabulary file of the installed public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path(name)
