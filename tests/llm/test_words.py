"""Importance resampling and spelling variants against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from cases import documents, empty, odd_texts, prose

from tapeloom.llm import importance, spelling
from tapeloom.llm.queries import QUERIES

ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BETWEEN = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return [w for w in BETWEEN.split((text or "").translate(ASCII_LOWER)) if w]


def grams(words, width):
    return [" ".join(words[i : i + k]) for k in range(1, width + 1) for i in range(len(words) - k + 1)]


def plain_scores(rows, target, cfg):
    """(id, n_words, n_features, weight, score) of each (id, text)."""
    def buckets(text):
        return [zlib.crc32(g.encode()) % cfg.buckets for g in grams(words_of(text), cfg.width)]

    source, aim = Counter(), Counter()
    for _, text in rows:
        source.update(buckets(text))
    for text in target:
        aim.update(buckets(text))
    s_all, t_all, n = sum(source.values()), sum(aim.values()), cfg.buckets
    out = []
    for doc_id, text in rows:
        own = buckets(text)
        gain = [
            math.floor(1000 * math.log((aim[b] + 1.0) * float(t_s) / ((source[b] + 1.0) * float(t_all + n))))
            for t_s in [s_all + n] for b in own
        ]
        name = f"{cfg.seed}:{'' if doc_id is None else doc_id}"
        h = int(hashlib.sha256(name.encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((doc_id, len(words_of(text)), len(own), sum(gain), sum(gain) + noise))
    return out


def plain_ranks(scores, cfg):
    fit = [s for s in scores if s[1] >= cfg.least_words]
    fit.sort(key=lambda s: (-s[4], (s[0] is not None, s[0] or 0), s[2], s[3]))
    return Counter((*s, i + 1) for i, s in enumerate(fit[: cfg.percent * len(fit) // 100]))


@pytest.mark.parametrize("slice_bytes", [1 << 22, 300])
def test_resampling_against_a_plain_version(spark, slice_bytes):
    cfg = importance.Resampling(buckets=97, percent=30, least_words=5, slice_bytes=slice_bytes)
    rng = random.Random(8)
    texts = odd_texts() + [prose(rng, rng.randrange(0, 60)).upper() for _ in range(60)] + ["Ünï cödé ÀB 1a2b\x00c"]
    docs = documents(spark, texts=texts, clashing=True)
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    target = [prose(rng, 40), None, "two words", ""]
    rows = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), cfg).collect()
    want = plain_scores(given, target, cfg)
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight, r.score) for r in rows) == Counter(want)
    drawn = Counter(tuple(r) for r in rows if r.rank is not None)
    assert drawn == plain_ranks(want, cfg) and drawn


def test_resampling_of_odd_tables(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resample(empty(spark), none).count() == 0
    docs = documents(spark, texts=["a b c"] * 3)
    rows = importance.resample(docs, none).collect()
    assert len(rows) == 5 and all(r.rank is None for r in rows)
    # All the same score but for the noise, ids repeated: every rank once.
    same = spark.createDataFrame([(1, "x " * 30)] * 200, "doc_id long, text string")
    rows = importance.resample(same, none, importance.Resampling(percent=50)).collect()
    assert sorted(r.rank for r in rows if r.rank is not None) == list(range(1, 101))
    kept = importance.drawn(same, none, importance.Resampling(percent=50))
    assert kept.columns == same.columns and kept.count() == 200  # rows of a drawn id


def test_one_long_text_in_pieces(spark):
    rng = random.Random(9)
    text = prose(rng, 200_000) + " " + "é" * 300_000 + " end of it"
    docs = spark.createDataFrame([(5, text)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    whole = importance.resample(docs, none, importance.Resampling(slice_bytes=1 << 30)).first()
    cut = importance.resample(docs, none, importance.Resampling(slice_bytes=50_000)).first()
    assert whole == cut and cut.n_words == 200_004


def plain_variants(rows, cfg):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(ASCII_LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if cfg.noise and h % cfg.noise == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= cfg.least_length and n >= cfg.least_count}
    alphabet = sorted({c for w in words for c in w})

    def near(w):
        made = {w[:i] + w[i + 1 :] for i in range(len(w))}
        made |= {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in alphabet}
        made |= {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in alphabet}
        return (made & words.keys()) - {w}

    form, out = {}, {}
    for w in words:
        some = near(w)
        best = min(some, key=lambda x: (-words[x], x)) if some else None
        form[w] = best if best and words[best] >= cfg.ratio * words[w] else None
        out[w] = len(some)
    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), words[w], out[w], words[form[w]] if form[w] else None) for w in words}


def test_variants_against_all_edits(spark):
    rng = random.Random(10)
    base = ["letter", "aabba", "ààààà", "zzzzzzz", "x" * 300, "étéèÿ×÷", "Strasse"]
    texts = []
    for _ in range(400):
        words = []
        for _ in range(rng.randrange(1, 12)):
            w = rng.choice(base)
            if rng.random() < 0.5:
                i = rng.randrange(len(w))
                w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abxé") + w[i:], w[:i] + rng.choice("abxé") + w[i + 1 :]])
            words.append(w if rng.random() < 0.8 else w.upper())
        texts.append(rng.choice([" ", "-", "\n", "1"]).join(words))
    docs = documents(spark, texts=[*texts, *odd_texts()], clashing=True)
    given = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    for cfg in (spelling.Spelling(), spelling.Spelling(noise=5, least_count=1, least_length=3, held=500)):
        rows = [tuple(r) for r in spelling.variants(docs, cfg).collect()]
        assert len(rows) == len(set(rows)) and set(rows) == plain_variants(given, cfg)
    assert spelling.variants(empty(spark)).count() == 0


def test_chains_of_forms_lead_to_one_root(spark):
    """Each word is twice as frequent as the one before: the chain is followed to its end."""
    words = ["abcdefgh" + "z" * i for i in range(7)]
    docs = [(i, " ".join([w] * (3 * 2**i))) for i, w in enumerate(words)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = {r.word: r for r in spelling.variants(frame, spelling.Spelling(noise=None)).collect()}
    assert all(rows[w].root == words[-1] for w in words)
    assert [rows[w].form for w in words] == [*words[1:], None]


def test_fingerprints_of_long_words():
    """Equal where the spelled-out rotations are equal, for a word of 2,000 letters among others."""
    rng = random.Random(11)
    long = "".join(rng.choice("ab") for _ in range(120))
    words = [long, long[:50] + long[51:], "b" + long[1:], "aaaa", "aaa", "é", ""]
    owner, role, a, b = spelling.rotations(words)
    spelled = [w[j:] + "$" + w[:j] for w in words for j in range(len(w) + 1)]
    spelled += [w[i + 1 :] + "$" + w[:i] for w in words for i in range(len(w))]
    assert len(spelled) == len(a)
    keys = {}
    for s, key in zip(spelled, zip(a.tolist(), b.tolist())):
        assert keys.setdefault(s, key) == key
    assert len(set(keys.values())) == len(keys)


def test_word_queries_against_plain_versions(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = [tuple(r) for r in QUERIES["op13_spelling"](spark, sf).collect()]
    assert set(got) == plain_variants(rows, spelling.Spelling()) and len(got) == len(set(got))
    cfg = importance.Resampling()
    want = plain_scores(rows, target, cfg)
    ranks = {k[0]: k[-1] for k in plain_ranks(want, cfg)}
    found = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in QUERIES["op12_importance"](spark, sf).collect()}
    assert found == {i: (n, w, s, ranks.get(i)) for i, _, n, w, s in want}
