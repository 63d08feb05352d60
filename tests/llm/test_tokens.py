"""Packing, id files and token counts against the tokenizers library over odd texts."""

import os
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty, odd_texts
from tokenizers import Tokenizer, models, pre_tokenizers

from tapeloom.llm import idfiles, packing, tokencounts, tokens
from tapeloom.llm.queries import QUERIES
from tapeloom.session import drop_staged, shared_dir, staged_mark

WORDS = tokens.public_file("word_bpe_49k.json")
BYTES = tokens.public_file("byte_bpe_50k.json")
PIECES = tokens.public_file("piece_bpe_32k.model")


def ids_of(path, text, end):
    ids = Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, end], "<u4")


@pytest.mark.parametrize("path, chunks", [(WORDS, tokens.DROPS_BLANKS), (BYTES, tokens.LEADING_BLANKS)])
def test_chunks_give_the_ids_of_whole_texts(path, chunks):
    rng = random.Random(1)
    texts = [t for t in odd_texts() if t]
    alphabet = " \n\t\r'sé日aB1!́ \x1c"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    encoder = tokens.Encoder(path, chunks)
    plain = Tokenizer.from_file(path)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        want = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert got == want, repr(text[:80])


def test_packing_covers_every_id_once(spark):
    cfg = packing.Packing(WORDS, with_ids=True, group_windows=2)
    docs = documents(spark, clashing=True)
    packed = packing.pack(docs, cfg)
    rows = packed.collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    per_doc = {}
    for r in rows:
        assert zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length
        per_doc.setdefault(r.doc_id, []).append(r)
    assert per_doc.keys() == texts.keys()
    for doc_id, text in texts.items():
        want = ids_of(WORDS, text, 1)
        parts = sorted(per_doc[doc_id], key=lambda r: r.start)
        if doc_id == 0:  # the repeated row is packed twice
            parts = parts[::2]
        assert all(p.doc_tokens == len(want) for p in parts)
        got = np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in parts])
        assert (got == want).all() and [p.start for p in parts] == np.cumsum(
            [0, *[p.length for p in parts]]
        )[:-1].tolist()
    sequences = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == sequences.get(r.sequence_id, 0)
        sequences[r.sequence_id] = r.offset + r.length
    assert max(sequences.values()) <= 2048
    joined = packing.sequences(packed).collect()
    assert {r.sequence_id: r.length for r in joined} == sequences
    assert all(len(r.ids) == 4 * r.length for r in joined)


def test_differencing_is_near_equal_and_adds_windows():
    rng = random.Random(2)
    sizes = [rng.randrange(100, 513) for _ in range(400)]
    slot = packing.windows(sizes, 2048)
    loads = np.bincount(slot, weights=sizes)
    assert loads.max() <= 2048 and loads.max() - loads.min() < 64
    assert len(loads) <= -(-sum(sizes) // 2048) + 1
    # Three items above half a window need a window each.
    assert sorted(packing.windows([1100, 1100, 1100], 2048).tolist()) == [0, 1, 2]
    assert packing.windows([5], 2048).tolist() == [0]


def test_packing_of_nothing(spark):
    assert packing.pack(empty(spark), packing.Packing(WORDS)).count() == 0


def test_id_files_round_trip(spark):
    docs = documents(spark, clashing=True)
    rows = idfiles.round_trip(docs, idfiles.IdFiles(BYTES, batch_rows=2, length=64)).collect()
    rows = sorted(rows, key=lambda r: r.start)
    assert len(rows) == docs.count()
    assert [r.doc_id for r in rows] == [None, *sorted([0, *range(len(odd_texts()))])]
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    at = 0
    for r in rows:
        ids = ids_of(BYTES, texts[r.doc_id], 0)
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert idfiles.round_trip(empty(spark), idfiles.IdFiles(BYTES)).count() == 0


def test_sequences_are_views_with_masks(tmp_path):
    cfg = idfiles.IdFiles(BYTES, length=8, batch_rows=2)
    file = str(tmp_path / "x.arrow")
    writer = idfiles.SequenceWriter(file, cfg)
    ids = np.arange(37, dtype=np.uint32)
    for part in np.split(ids, [5, 6, 30]):
        writer.add(part)
    writer.close()
    mapped = pa.memory_map(file)
    whole = mapped.read_buffer(mapped.size())
    reader = idfiles.SequenceReader(mapped, 8, 2)
    got = [(i, m, m.to_numpy(zero_copy_only=False)) for i, m in map(reader.sequence, range(5))]
    assert np.concatenate([i[b] for i, _, b in got]).tolist() == list(range(37))
    assert got[4][2].tolist() == [True] * 5 + [False] * 3
    for i, m, _ in got:
        for at in (i.__array_interface__["data"][0], m.buffers()[1].address):
            assert whole.address <= at < whole.address + whole.size
    assert reader.stretch(3, 30).tolist() == list(range(3, 33))
    with pytest.raises(ValueError):
        idfiles.SequenceWriter(str(tmp_path / "y.arrow"), cfg).add(np.array([70_000]))


def library(vocabulary):
    model = models.Unigram(list(vocabulary.pieces), 0, vocabulary.byte_fallback)
    tokenizer = Tokenizer(model)
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    return tokenizer


def test_viterbi_counts_equal_the_library(spark):
    vocabulary = tokencounts.zipf_vocabulary(PIECES)
    plain = library(vocabulary)
    docs = documents(spark, clashing=True)
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    rows = tokencounts.count_tokens(docs, PIECES).collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.n_tokens == len(plain.encode(texts[r.doc_id] or "").ids), texts[r.doc_id][:60]
    assert tokencounts.count_tokens(empty(spark), PIECES).count() == 0


@pytest.mark.parametrize("fallback", [False, True])
def test_viterbi_ties_and_unknowns(fallback):
    pieces = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("▁", -1.5),
              ("▁a", -2.5)]
    if fallback:
        pieces += [(f"<0x{i:02X}>", 0.0) for i in range(256)]
    vocabulary = tokencounts.Vocabulary(tuple(pieces), fallback)
    plain, counter = library(vocabulary), tokencounts.Counter(vocabulary)
    rng = random.Random(4)
    for _ in range(1500):
        text = "".join(rng.choice("aab xé日") for _ in range(rng.randrange(0, 14)))
        assert counter.count(text)[0] == len(plain.encode(text).ids), text


@pytest.mark.parametrize("name", ["op2_packing", "op5_tokencounts", "op10_idfiles"])
def test_queries_cover_all_documents(spark, sf, name):
    rows = QUERIES[name](spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows.select("doc_id").distinct().count() == docs.count()




def test_the_memo_is_bounded_within_a_text():
    encoder = tokens.Encoder(WORDS, tokens.DROPS_BLANKS, memo=1000)
    text = " ".join("".join(chr(97 + (i // 26**k) % 26) for k in range(5)) for i in range(50_000))
    text += " " + "x" * 100_000
    got = encoder.encode([text])[0]
    assert encoder._memo.held() <= 2000
    assert max(map(len, encoder._memo)) <= tokens.LONGEST_KEPT
    want = np.array(Tokenizer.from_file(WORDS).encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert got == want


def test_id_files_go_with_staged_tables(spark):
    folder = shared_dir(spark)
    before = set(os.listdir(folder))
    mark = staged_mark()
    cfg = idfiles.IdFiles(BYTES)
    assert idfiles.round_trip(documents(spark), cfg).count() == documents(spark).count()
    assert any(f.startswith("ids-") for f in set(os.listdir(folder)) - before)
    drop_staged(spark, mark)
    assert set(os.listdir(folder)) == before


def plain_differencing(sizes, slots):
    """The rule restated on vectors: the two largest spreads meet, heaviest slots with lightest ones."""
    parts = [(-size, i, np.r_[size, np.zeros(slots - 1, int)], [(i, 0)]) for i, size in enumerate(sizes)]
    while len(parts) > 1:
        parts.sort(key=lambda p: p[:2])
        (_, _, one, items), (_, _, two, more) = parts[:2]
        order = np.argsort(-(one + two[::-1]), kind="stable")
        rank = np.argsort(order)
        sums = (one + two[::-1])[order]
        held = [(i, rank[s]) for i, s in items] + [(i, rank[slots - 1 - s]) for i, s in more]
        made = len(sizes) + max(0, max(p[1] for p in parts) - len(sizes) + 1)
        parts = [*parts[2:], (-int(sums[0] - sums[-1]), made, sums - sums[-1], held)]
    return [int(s) for _, s in sorted(parts[0][3])]


def test_differencing_equals_the_plain_rule_with_ties():
    rng = random.Random(4)
    for _ in range(150):
        sizes = [rng.randint(1, rng.choice([1, 2, 9, 512])) for _ in range(rng.randint(1, 40))]
        slots = rng.randint(1, 9)
        assert packing.differencing(sizes, slots).tolist() == plain_differencing(sizes, slots)


def test_differencing_ranks_slots_anew_only_where_two_partitions_meet(monkeypatch):
    """A single item moves one slot: no work on all slots for each of 2,000 items."""
    calls, kept = [], np.argsort
    monkeypatch.setattr(np, "argsort", lambda *a, **k: calls.append(1) or kept(*a, **k))
    monkeypatch.setattr(packing, "sorted", lambda *a, **k: calls.append(1) or sorted(*a, **k), raising=False)
    rng = random.Random(5)
    packing.differencing([rng.randint(1, 512) for _ in range(2000)], 96)
    assert len(calls) < 1500, len(calls)


def test_a_column_gives_the_ids_of_whole_texts():
    rng = random.Random(6)
    texts = odd_texts() + [None, "", " ", "It's 'sold', don't''s  A1!!", "\ta\x0b\x0cb\r\n c "]
    alphabet = " \n\t\x0c\r'sétDß日aB1!,.́ \xa0\x1c\x85"
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 40))) for _ in range(400)]
    texts += ["".join(rng.choice(" '\nstaBé1,!") for _ in range(60)) for _ in range(400)]
    encoder, plain = tokens.Encoder(WORDS, tokens.DROPS_BLANKS, memo=100), Tokenizer.from_file(WORDS)
    wanted = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for kind in (pa.string(), pa.large_string()):
        column = pa.array([None, *texts], kind).slice(1)
        got = [np.frombuffer(ids, "<u4").tolist() for ids in encoder.column(column)]
        assert got == wanted
        for few in ([], [""], [None, " "], ["日"]):
            want = [ids_of(WORDS, t, 1)[:-1].tobytes() for t in few]
            assert encoder.column(pa.array(few, kind)) == want
    assert encoder._memo.held() <= 200
    other = tokens.Encoder(BYTES, tokens.LEADING_BLANKS)
    assert other.column(pa.array(texts)) == other.encode(texts)


def test_a_column_looks_up_each_distinct_stretch_once(monkeypatch):
    """Work grows with the distinct stretches of a slice, not with its words."""
    encoder = tokens.Encoder(WORDS, tokens.DROPS_BLANKS)
    cut, kept = [], encoder._words
    monkeypatch.setattr(encoder, "_words", lambda text: cut.append(len(text)) or kept(text))
    texts = ["Once more, it's the same text. Once more!"] * 300
    got = encoder.column(pa.array(texts))
    assert got == [ids_of(WORDS, texts[0], 1)[:-1].tobytes()] * 300
    assert sum(cut) < len(texts[0]), sum(cut)


@pytest.mark.parametrize("path, chunks", [(WORDS, tokens.DROPS_BLANKS), (BYTES, tokens.LEADING_BLANKS)])
def test_every_plain_character_is_cut_as_by_the_library(path, chunks):
    encoder, plain = tokens.Encoder(path, chunks), Tokenizer.from_file(path)
    characters = [c for c in map(chr, range(0x300)) if not tokens.OTHER.search(c)]
    for form in ("{}", "a{}b", "a{}b, 'S{}x", "{}{}1{}2", ", {} ,{}", "{}'s{} '{}"):
        texts = [form.replace("{}", c) for c in characters]
        want = [np.array(e.ids, "<u4").tobytes() for e in plain.encode_batch(texts, add_special_tokens=False)]
        for got in (encoder.encode(texts), encoder.column(pa.array(texts))):
            assert not [t for t, a, b in zip(texts, got, want, strict=True) if a != b]
