"""Quality scores and the whole pipeline against plain versions of their stages."""

import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_near import brute_classes
from test_scans import plain_scan

import corpus_pipeline
from tapeloom.llm import quality, tokens
from tapeloom.llm.hashing import Words
from tapeloom.llm.queries import QUERIES, WORD_VOCABULARY

TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\x20\t-\r]+")
CFG = quality.Quality()


def plain_buckets(texts):
    """Tokens cut by a pattern; each is hashed alone."""
    known = {}

    def bucket(token):
        if token not in known:
            known[token] = int(Words(pa.array([token.decode("utf-8")]), quality.SIGNS).hash[0]) % CFG.buckets
        return known[token]

    return [[bucket(t.lower()) for t in TOKEN.findall((text or "").encode())] for text in texts]


def plain_vectors(rows):
    """Neighbours within two places add their +1 and -1, text by text."""
    plus, minus = quality.index_vectors(CFG)
    table = np.zeros((CFG.buckets, CFG.width))
    for row in rows:
        for i, own in enumerate(row):
            for j in (i - 2, i - 1, i + 1, i + 2):
                if 0 <= j < len(row):
                    table[own, plus[row[j]]] += 1
                    table[own, minus[row[j]]] -= 1
    return [v / n if (n := math.sqrt(float(v @ v))) else v for v in table]


def plain_features(row, vectors):
    if not row:
        return np.zeros(2 * CFG.width + 2)
    own = np.array([vectors[b] for b in row])
    return np.concatenate([own.mean(0), own.std(0), [math.log1p(len(set(row))), math.log1p(len(row))]])


def plain_score(model, x):
    hidden = [
        math.tanh(sum((x[i] - model.shift[i]) / model.scale[i] * model.w1[i, k] for i in range(len(x))) + model.b1[k])
        for k in range(CFG.hidden)
    ]
    logit = sum(h * w for h, w in zip(hidden, model.w2, strict=True)) + model.b2
    return 1 / (1 + math.exp(-logit / model.temperature))


@pytest.fixture(scope="module")
def scored(spark, sf):
    """Rows of documents with the plain scores under the network that Spark fits."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    built = quality._features(rows, quality.word_vectors(rows, CFG), CFG)
    model = quality.fitted(built, labels, CFG)
    given = docs.collect()
    buckets = plain_buckets([r.text for r in given])
    vectors = plain_vectors(buckets)
    plain = [plain_features(b, vectors) for b in buckets]
    by_id = {r.doc_id: np.frombuffer(r.features, np.float32) for r in built.collect()}
    # The pools are sums of single precision; the spread takes a root of a small difference.
    for r, x in zip(given, plain, strict=True):
        assert np.abs(by_id[r.doc_id] - x).max() < 2e-3
    return given, [plain_score(model, x) for x in plain]


def test_scores_equal_a_plain_version(spark, sf, scored):
    given, scores = scored
    got = {r.doc_id: r for r in QUERIES["op9_quality"](spark, sf).collect()}
    assert len(got) == len(given)
    for row, score in zip(given, scores, strict=True):
        r = got[row.doc_id]
        assert abs(r.score - score) < 5e-3 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(row.doc_id).encode()) % 5 == 0)


def test_training_only_sees_rows_that_are_not_held_out(spark, sf):
    """Rows that are held out, or have no label, change no weight."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    built = quality._features(docs, quality.word_vectors(docs, CFG), CFG)
    turned = labels.withColumn(
        "quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    one, two = quality.fitted(built, labels, CFG), quality.fitted(built, turned, CFG)
    assert np.array_equal(one.w1, two.w1) and one.temperature == two.temperature


def holds(text, items, rate=0.05):
    """Whether a stretch of the text is within ``rate`` edits of an item: one row of distances per
    character of the text, all items at once."""
    items = [i for i in (" ".join(t.lower().split()) for t in items) if i]
    text = " ".join((text or "").lower().split())
    size = np.array([len(i) for i in items])
    grid = np.zeros((len(items), size.max()), np.int64)
    for row, item in zip(grid, items, strict=True):
        row[: len(item)] = [ord(c) for c in item]
    steps = np.arange(size.max() + 1)
    now = np.tile(steps, (len(items), 1))
    budget = np.floor(rate * size).astype(int)
    pick = np.arange(len(items))
    for c in text:
        new = np.zeros_like(now)
        new[:, 1:] = np.minimum(now[:, :-1] + (grid != ord(c)), now[:, 1:] + 1)
        now = np.minimum.accumulate(new - steps, axis=1) + steps
        if (now[pick, size] <= budget).any():
            return True
    return False


def hidden(text, spans):
    """Spans that overlap are one mark; a live one makes it a secret."""
    marks = []
    for start, end, live in spans:
        if marks and start < marks[-1][1]:
            marks[-1] = (marks[-1][0], max(end, marks[-1][1]), live or marks[-1][2])
        else:
            marks.append((start, end, live))
    for start, end, live in reversed(marks):
        text = text[:start] + ("<secret>" if live else "<example>") + text[end:]
    return text


def test_pipeline_equals_a_plain_version(spark, sf, scored):
    """Kept documents, masked texts and packed ids of the whole run."""
    from tokenizers import Tokenizer

    given, scores = scored
    # No score lies so near the threshold that rounding would decide.
    assert min(abs(s - 0.3) for s in scores) > 1e-6
    kept = [r for r, s in zip(given, scores, strict=True) if s >= 0.3]
    least = {}
    for r, c in zip(kept, brute_classes([r.text for r in kept]), strict=True):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    kept = [r for r in kept if r.doc_id in set(least.values())]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [r for r in kept if not holds(r.text, items)]
    found = plain_scan([(r.doc_id, r.text, r.source) for r in kept])
    tokenizer = Tokenizer.from_file(tokens.public_file(WORD_VOCABULARY))
    want = {}
    for r in kept:
        described, held, _ = found[r.doc_id]
        spans = [
            (int(s.split(":")[1]), int(s.split(":")[2]), int(h.split(":")[0]) <= 2)
            for s, h in zip(described.split(","), held.split(","), strict=True) if s
        ]
        text = hidden(r.text or "", spans)
        want[r.doc_id] = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
    rows = corpus_pipeline.run(spark, sf).collect()
    got = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = got.setdefault(r.doc_id, [])
        assert r.start == len(ids) and r.doc_tokens == len(want[r.doc_id])
        ids += np.frombuffer(r.ids, "<u4").tolist() if isinstance(r.ids, (bytes, bytearray)) else list(r.ids)
    assert got == want
    assert 0 < len(want) < len(given)
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in places.values():
        ends = np.cumsum([0, *[n for _, n in sorted(pieces)]])
        assert [o for o, _ in sorted(pieces)] == ends[:-1].tolist() and ends[-1] <= 2048
