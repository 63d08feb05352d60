"""Repeated byte strings against a plain scan of all strings."""

import hashlib
import random

import numpy as np
import pytest
from cases import documents, empty, prose

from tapeloom.llm import repeats
from tapeloom.llm.queries import QUERIES

SMALL = repeats.Repeats(length=12, gram=4, steps=(2, 2), block=64)


def plain(texts: dict, length: int) -> dict:
    """Ranges of each text by (id order, start); ``texts`` maps ids, None first, to bytes."""
    seen, out = set(), {}
    for key in sorted(texts, key=lambda k: (k is not None, k)):
        text, gone = texts[key], np.zeros(len(texts[key]), bool)
        new = []
        for i in range(len(text) - length + 1):
            s = text[i : i + length]
            if s in seen:
                gone[i : i + length] = True
            seen.add(s)
            new.append(s)
        out[key] = gone
    return out


def check(rows, texts, length):
    want = plain(texts, length)
    for r in rows:
        gone = np.zeros(r.n_bytes, bool)
        for s in r.spans:
            gone[s.start : s.end] = True
        assert r.n_bytes == len(texts[r.doc_id])
        assert gone.tolist() == want[r.doc_id].tolist(), r.doc_id
        assert bytes(r.kept) == bytes(np.frombuffer(texts[r.doc_id], np.uint8)[~gone])
        ends = [(s.start, s.end) for s in r.spans]
        assert all(a[1] < b[0] for a, b in zip(ends, ends[1:]))


def hostile_texts() -> list:
    rng = random.Random(3)
    base = prose(rng, 60)
    texts = [base, base, base[5:90] + "X" + base[90:200], None, "", "short", "a" * 300, "ab" * 150]
    texts += ["é日本" * 20, base[:11], base[:12], base[:12] + base[:12], base[30:60] + base[28:70]]
    for _ in range(40):
        cut = sorted(rng.randrange(len(base)) for _ in range(4))
        texts.append(base[cut[0] : cut[2]] + prose(rng, 3) + base[cut[1] : cut[3]])
    for _ in range(30):
        texts.append("".join(rng.choice("ab") for _ in range(rng.randrange(5, 80))))
    return texts


@pytest.mark.parametrize("cfg", [SMALL, repeats.Repeats(length=12, gram=6, steps=(), block=1 << 20)])
def test_against_all_strings(spark, cfg):
    texts = hostile_texts()
    docs = documents(spark, texts=texts, clashing=True, first_id=-3)
    held = {i - 3: (t or "").encode() for i, t in enumerate(texts)} | {None: b"a row without an id"}
    rows = repeats.without_repeats(docs, cfg).collect()
    assert len(rows) == len(texts) + 2  # the repeated row has its own result
    check(rows, held, cfg.length)


def test_repeats_within_the_least_document_and_others(spark):
    """A string twice in the first document, and once more elsewhere: only the first place stays."""
    rng = random.Random(4)
    s = "".join(rng.choice("abcdefghij") for _ in range(14))
    texts = [f"{s}_1_{s}_2_", f"..{s}__", f"{s}_1_{s}", "zz" + s[1:] + "yy" + s[:-1]]
    docs = documents(spark, texts=texts)
    held = {i: t.encode() for i, t in enumerate(texts)} | {None: b"a row without an id"}
    check(repeats.without_repeats(docs, SMALL).collect(), held, 12)


def test_rows_of_one_id_do_not_touch_each_other(spark):
    text = "0123456789abcdefghij"
    docs = spark.createDataFrame([(1, text), (1, text + "!"), (2, text)], "doc_id long, text string")
    rows = repeats.without_repeats(docs, SMALL).collect()
    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in rows) == [(1, text), (1, text + "!"), (2, "")]


def test_texts_are_read_once_and_equal_parts_stay_whole(spark, monkeypatch):
    """own repeats need no further pass over the texts, and what is equal in whole is not cut to strings."""
    rng = random.Random(6)
    passage = prose(rng, 60)
    # The passage begins and ends within stretches that differ, and one text has it twice.
    texts = [prose(rng, 9) + passage + prose(rng, 9) for _ in range(6)] + [passage + "|" + passage]
    docs = documents(spark, texts=texts)
    staged, plans = [], {}
    kept = repeats._kept

    def watched(df, label):
        plans[label] = df._jdf.queryExecution().executedPlan().toString()
        out = kept(df, label)
        staged.append((label, out.count()))
        return out

    monkeypatch.setattr(repeats, "_kept", watched)
    cfg = repeats.Repeats()
    held = {i: t.encode() for i, t in enumerate(texts)} | {None: b"a row without an id"}
    check(repeats.without_repeats(docs, cfg).collect(), held, cfg.length)
    assert "MapInArrow" not in plans["ranges"]
    strings = [n for label, n in staged if label in ("parts", "strings")][-1]
    # Each text has two open stretches with some of the passage's strings, mostly in parts of four strings or more.
    assert strings <= 8 * len(texts), staged


def test_stretches_do_not_depend_on_pieces(monkeypatch):
    """Each string is in one stretch, equal strings at equal places, and pieces cut no stretch."""
    rng = random.Random(7)
    cfg = SMALL
    for _ in range(60):
        texts = [
            "".join(rng.choice(rng.choice(["ab", "abcdefgh"])) for _ in range(rng.choice([0, 3, 11, 12, 13, 50, 200])))
            for _ in range(rng.randrange(1, 12))
        ]
        raw = np.frombuffer("".join(texts).encode(), np.uint8)
        bounds = np.cumsum([0, *map(len, texts)])
        monkeypatch.setattr(repeats, "_PIECE", 1 << 15)
        whole = repeats.stretches(raw, cfg, bounds)
        monkeypatch.setattr(repeats, "_PIECE", 50)
        cut = repeats.stretches(raw, cfg, bounds)
        assert all(a.tolist() == b.tolist() for a, b in zip(whole, cut, strict=True))
        found, where = [], {}
        for text, bucket, _, start, count, anchor in zip(*cut, strict=True):
            for i in range(count):
                found.append((text, start + i))
                string = texts[text][start + i : start + i + cfg.length]
                assert where.setdefault(string, (bucket, anchor - i)) == (bucket, anchor - i)
        assert sorted(found) == [(t, i) for t, x in enumerate(texts) for i in range(len(x) - cfg.length + 1)]
        text, bucket, key, start = cut[:4]
        seen, again = set(), []
        for row in zip(text, bucket, key, strict=True):
            again.append(row in seen)
            seen.add(row)
        assert repeats._again(text, bucket, key, start).tolist() == again


def test_empty_table_and_sizes(spark):
    assert repeats.without_repeats(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        repeats.Repeats(length=10, gram=20)


def test_a_long_text_in_blocks(spark):
    """Ten million bytes: half of them one letter, then words twice over."""
    rng = random.Random(5)
    words = prose(rng, 300_000)
    text = "a" * 5_000_000 + words + words
    row = repeats.without_repeats(spark.createDataFrame([(7, text)], "doc_id long, text string")).first()
    start = 5_000_000
    # The letters' first string stays, and the words' first copy, give or take strings they share by chance.
    assert row.spans[0].start == 1 and row.spans[0].end == start
    assert row.spans[-1].end == len(text)
    assert row.spans[-1].start == start + len(words)


def test_query_against_all_strings(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = plain({d.doc_id: (d.text or "").encode() for d in docs}, 100)
    for r in QUERIES["op11_repeats"](spark, sf).collect():
        gone = want[r.doc_id]
        text = next(d.text or "" for d in docs if d.doc_id == r.doc_id).encode()
        kept = bytes(np.frombuffer(text, np.uint8)[~gone])
        assert (r.n_bytes, r.n_removed) == (len(text), int(gone.sum()))
        assert r.n_spans == int((np.diff(np.r_[0, gone.astype(int), 0]) == 1).sum())
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()
