"""Near-duplicate classes against brute force on exact five-word sets."""

import random

import numpy as np
import pyarrow as pa
import pytest
from cases import documents, empty, prose, same_rows

from tapeloom.llm import dartminhash
from tapeloom.llm.components import components
from tapeloom.llm.hashing import Words, shingle_table
from tapeloom.llm.queries import QUERIES


def sets(text):
    words = (text or "").lower().split()
    width = min(5, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1) if width)


def brute_classes(texts, threshold=0.8):
    """Class number of each text: components of all pairs of at least the threshold."""
    own = [sets(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(own[i] & own[j])
            either = len(own[i] | own[j])
            if (both / either if either else 1.0) >= threshold:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def edited(rng, text, edits):
    words = text.split()
    for i in rng.sample(range(len(words)), edits):
        words[i] = prose(rng, 1)
    return " ".join(words)


def corpus():
    rng = random.Random(8)
    texts = ["", None, "  ", "one two", "One  two", "one two three"]
    texts += [prose(rng, rng.randrange(20, 200)) for _ in range(30)]
    base = prose(rng, 150)
    texts += [base] * 20
    texts += [edited(rng, base, rng.randrange(1, 12)) for _ in range(60)]
    chain = [prose(rng, 120)]
    for _ in range(8):
        chain.append(edited(rng, chain[-1], 2))
    texts += chain
    passage = prose(rng, 60)
    texts += [passage + " " + prose(rng, rng.randrange(5, 90)) for _ in range(20)]
    rng.shuffle(texts)
    return texts


def partition(pairs):
    groups = {}
    for item, group in pairs:
        groups.setdefault(group, set()).add(item)
    return sorted(map(sorted, groups.values()))


def test_classes_equal_brute_force(spark):
    texts = corpus()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = partition(enumerate(brute_classes(texts)))
    rows = dartminhash.classes(docs).collect()
    assert partition((r.doc_id, r.class_id) for r in rows) == want
    assert all(r.class_id <= r.doc_id for r in rows)
    # Blocks of two give the same classes: a bucket of any size is compared whole.
    rows = dartminhash.classes(docs, dartminhash.Near(block=2)).collect()
    assert partition((r.doc_id, r.class_id) for r in rows) == want
    kept = dartminhash.keep_one(docs).collect()
    assert sorted(r.doc_id for r in kept) == [g[0] for g in want]


def test_a_row_meets_a_bounded_number_of_blocks(spark):
    """Unlike members of one bucket: copies per row do not grow with the bucket."""
    cfg = dartminhash.Near(block=4, split=8)
    for n, most in ((16, 4), (32, 8), (2000, 8), (4000, 16)):
        members = spark.range(n).selectExpr(
            "id AS key", "7L AS bucket", "id AS label", "X'00' AS small", "X'00' AS bands"
        )
        cells = dartminhash._cells(members, cfg)
        assert cells.groupBy("key").count().agg({"count": "max"}).first()[0] <= most + 2
        # All blocks meet, themselves as well, but for that of the one member taken as the largest.
        blocks = cells.agg({"j": "max"}).first()[0] + 1
        assert cells.select("i", "j").distinct().count() == blocks * (blocks + 1) // 2 - 1


def test_a_bucket_of_many_unlike_texts(spark):
    """Texts of one long head and tails of their own, some of them near; blocks that have grown."""
    rng = random.Random(21)
    head = prose(rng, 60)
    texts = [f"{head} {prose(rng, 30)}" for _ in range(120)]
    texts += [edited(rng, t, 1) for t in texts[:30]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = partition(enumerate(brute_classes(texts)))
    for cfg in (dartminhash.Near(block=2, split=4), dartminhash.Near(block=16)):
        rows = dartminhash.classes(docs, cfg).collect()
        assert partition((r.doc_id, r.class_id) for r in rows) == want


def test_members_far_from_the_centre_are_linked(spark):
    """A star whose points resemble only the middle, which is not the least id."""
    rng = random.Random(3)
    middle = prose(rng, 300)
    points = [edited(rng, middle, 5) for _ in range(40)]
    texts = [*points, middle]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = partition(enumerate(brute_classes(texts)))
    rows = dartminhash.classes(docs, dartminhash.Near(block=8)).collect()
    assert partition((r.doc_id, r.class_id) for r in rows) == want


@pytest.mark.parametrize("weights", ["set", "count"])
def test_agreement_estimates_the_similarity(weights):
    rng = random.Random(6)
    a = prose(rng, 400)
    for edits in (0, 5, 20):
        b = edited(rng, a, edits) + " " + " ".join(a.split()[:30]) * (weights == "count")
        hashes, counts, bounds = shingle_table(pa.array([a, b]), 5)
        use = counts if weights == "count" else np.ones(len(counts))
        kept = dartminhash.signatures(hashes, use, bounds, 2048)
        cut = bounds[1]
        exact = dartminhash.similarity(
            hashes[:cut], counts[:cut], hashes[cut:], counts[cut:], weights
        )
        assert abs((kept[0] == kept[1]).mean() - exact) < 0.05


def test_weighted_regions():
    ids = np.arange(1, 301, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rng = np.random.default_rng(1)
    x, y = rng.integers(1, 20, 200).astype(float), rng.integers(1, 20, 200).astype(float)
    hashes = np.concatenate([ids[:200], ids[100:300]])
    kept = dartminhash.signatures(hashes, np.concatenate([x, y]), np.array([0, 200, 400]), 4096)
    both = np.minimum(x[100:], y[:100]).sum()
    exact = both / (x.sum() + y.sum() - both)
    assert abs((kept[0] == kept[1]).mean() - exact) < 0.03


def test_words_do_not_cross_texts_and_ignore_case():
    words = Words(pa.array(["a B", "c", None, "", "A  b\n\tC"]))
    assert np.diff(words.first).tolist() == [2, 1, 0, 0, 3]
    assert words.hash[:3].tolist() == words.hash[3:].tolist()


def test_odd_rows_keep_their_columns(spark):
    docs = documents(spark, clashing=True)
    kept = dartminhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.schema["text"] == docs.schema["text"]
    texts = [r.text for r in docs.collect()]
    assert kept.count() == len(set(brute_classes(texts)))
    assert dartminhash.classes(docs).count() == docs.count()
    assert dartminhash.classes(empty(spark)).count() == 0
    assert dartminhash.keep_one(empty(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 300)]
    rows = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.label for r in rows} == {
        **{i: 0 for i in range(61)}, 300: 0, 100: 100, 150: 100, 200: 100,
    }
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_query_over_the_table(spark, sf):
    rows = QUERIES["op6_dartminhash"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = brute_classes([r.text for r in docs])
    assert same_rows(
        partition((r.doc_id, r.class_id) for r in rows),
        partition((d.doc_id, w) for d, w in zip(docs, want, strict=True)),
    )
