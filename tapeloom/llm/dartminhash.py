"""Near-duplicate classes by DartMinHash signatures and exact verification.

A text is the set of its runs of five words (weight 1 each, or their counts). Every element has its
own endless shower of darts over weight x rank, hashed from the element alone, one dart per unit of
area. A text sees the darts that hit its elements' regions, from weight 0 up to the element's weight
and up to a rank at which about ``t ln t + 2t`` darts are seen; each dart bears one of ``t``
coordinates, and the one of least rank is kept per coordinate. Two texts keep the same dart with the
probability of their (weighted) Jaccard similarity. Texts that leave a coordinate empty look twice
as far.

Classes are the connected components of all links of at least ``threshold``:

1. Texts with equal sets are one member. Members meet in buckets: ``bands`` keys of ``rows``
   coordinates (0.8 is missed with a chance of 6e-5 at 32 x 6).
2. Each bucket links its members to one centre, the member with the most company in all of its
   buckets; the links are verified on the exact sets, and their components found. A tight group of
   any size costs a few links per member.
3. Buckets that still hold several components are compared in blocks: each member outside a bucket's
   largest component meets every member of another component, cut into blocks dealt over tasks, by
   the agreement of longer signatures (``probe`` darts, half a byte each). A block holds ``block``
   members, more in buckets of over ``block * split`` and at most 64 times as many, so a row is sent
   to at most ``split + 2`` blocks in a bucket of up to ``64 * block * split`` members (524,288), and to one
   more per ``64 * block`` beyond. Only pairs
   whose agreement does not rule out the threshold (4 standard deviations) become rows, each in the
   first band they share; they are verified exactly as well. Nothing is dropped, whatever the size
   of a bucket.

Defined results: a missing or empty text has no words; all texts without words are one class; a
text of fewer than five words is one run of all its words; repeated rows are separate rows of one
class; class ids are the least row keys, mapped to the least ``id``; an empty table gives no rows;
other columns, whatever their names, are carried whole by ``keep_one`` and ignored by ``classes``.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.components import components
from tapeloom.llm.hashing import GOLDEN, mix, seeds, shingle_table, signed
from tapeloom.llm.rows import parts, row_keys, staged, text_of, with_fields
from tapeloom.session import drop_staged, staged_mark

_U = np.uint64
_NONE = np.iinfo(np.uint64).max
# The lowest stretch of ranks is [0, 2**LOW_RANK); each further one doubles the reach.
LOW_RANK = -6
# Most bands: their number takes the lowest bits of a bucket.
BAND_LIMIT = 64


@dataclass(frozen=True)
class Near:
    width: int = 5
    threshold: float = 0.8
    bands: int = 32
    rows: int = 6
    weights: str = "set"
    block: int = 256
    split: int = 32
    probe: int = 1024

    def __post_init__(self):
        if not 0 < self.bands <= BAND_LIMIT:
            raise ValueError(f"bands must be at most {BAND_LIMIT}")

    @property
    def darts(self) -> int:
        return self.bands * self.rows


@lru_cache(maxsize=256)
def _poisson(mean: float) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... darts in a cell of this area."""
    term, total, out, k = math.exp(-mean), 0.0, [], 0
    while k <= mean or 1.0 - total > 1e-16 and k < mean + 60 * math.sqrt(mean) + 60:
        total += term
        out.append(total)
        k += 1
        term *= mean / k
    return np.array(out)


def _unit(bits: np.ndarray) -> np.ndarray:
    return (bits >> _U(11)).astype(np.float64) * 2.0**-53


def signatures(hashes: np.ndarray, weights: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """One row of ``t`` kept darts per text; texts without elements keep none (all ones)."""
    texts = len(bounds) - 1
    out = np.full(texts * t, _NONE, _U)
    sizes = np.diff(bounds)
    owner = np.repeat(np.arange(texts), sizes)
    weights = weights.astype(np.float64)
    total = np.bincount(owner, weights=weights, minlength=texts)
    reach = np.divide(t * math.log(t) + 2 * t, total, out=np.zeros(texts), where=total > 0)
    todo = np.flatnonzero(total > 0)
    while len(todo):
        chosen = np.zeros(texts, bool)
        chosen[todo] = True
        pick = np.flatnonzero(chosen[owner])
        _throw(hashes[pick], weights[pick], owner[pick], reach, t, out)
        empty = (out.reshape(texts, t)[todo] == _NONE).any(1)
        todo = todo[empty]
        reach[todo] *= 2
    return out.reshape(texts, t)


def _throw(hashes, weights, owner, reach, t, out) -> None:
    """Throw the darts of these elements within their texts' reach into ``out``."""
    far = reach[owner]
    octaves = np.maximum(0, np.ceil(np.log2(np.maximum(far, 1e-300))) - LOW_RANK)
    last_rank = int(octaves.max(initial=0))
    last_weight = int(max(0, math.ceil(math.log2(max(1.0, weights.max(initial=1))))))
    with np.errstate(over="ignore"):
        for nu in range(last_weight + 1):
            low_w, wide_w = (0.0, 1.0) if nu == 0 else (2.0 ** (nu - 1), 2.0 ** (nu - 1))
            heavy = weights > low_w
            for rho in range(last_rank + 1):
                low_r = 0.0 if rho == 0 else 2.0 ** (LOW_RANK + rho - 1)
                wide_r = 2.0**LOW_RANK if rho == 0 else low_r
                cell = np.flatnonzero((octaves >= rho) & heavy)
                seed = mix(hashes[cell] ^ seeds(7 + nu, rho + 1)[rho])
                count = np.searchsorted(_poisson(wide_w * wide_r), _unit(seed), "right")
                hit = np.flatnonzero(count)
                count = count[hit]
                element = np.repeat(cell[hit], count)
                number = np.arange(len(element)) - np.repeat(np.cumsum(count) - count, count)
                dart = mix(np.repeat(seed[hit], count) + (number + 1).astype(_U) * GOLDEN)
                rank = low_r + wide_r * _unit(dart)
                seen = rank <= far[element]
                if nu or weights.min(initial=1) < 1:
                    weight = low_w + wide_w * _unit(mix(dart + _U(1)))
                    seen &= weight <= weights[element]
                element, dart, rank = element[seen], mix(dart[seen] ^ GOLDEN), rank[seen]
                place = owner[element] * t + (dart % _U(t)).astype(np.int64)
                value = rank.astype(np.float32).view(np.uint32).astype(_U) << _U(32)
                np.minimum.at(out, place, value | (dart >> _U(32)))


def keys_of(kept: np.ndarray, cfg: Near) -> np.ndarray:
    """One key per text and band."""
    with np.errstate(over="ignore"):
        grid = mix(kept.reshape(len(kept), cfg.bands, cfg.rows)) * seeds(3, cfg.rows)
        return mix(grid.sum(2) + seeds(5, cfg.bands))


def _signed_rows(rows: DataFrame, cfg: Near, keep: list[str]) -> DataFrame:
    """The kept columns of each row with its key, set print and band keys."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = row_keys()
        next(keys)
        for batch in batches:
            for part in parts(batch):
                hashes, counts, bounds = shingle_table(part.column("text"), cfg.width)
                weights = counts if cfg.weights == "count" else np.ones(len(counts), np.int64)
                bands = keys_of(signatures(hashes, weights, bounds, cfg.darts), cfg)
                with np.errstate(over="ignore"):
                    whole = mix(hashes) * weights.astype(_U)
                    sums = np.r_[_U(0), np.cumsum(whole)]
                    again = np.r_[_U(0), np.cumsum(mix(whole ^ GOLDEN))]
                prints = [signed(s[bounds[1:]] - s[bounds[:-1]]) for s in (sums, again)]
                n = len(part)
                lists = pa.ListArray.from_arrays(
                    np.arange(0, n * cfg.bands + 1, cfg.bands, dtype=np.int32),
                    pa.array(signed(bands).reshape(-1)),
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        *[part.column(c) for c in keep],
                        pa.array(keys.send(n)),
                        *map(pa.array, prints),
                        lists,
                    ],
                    names=[*keep, "key", "print1", "print2", "bands"],
                )

    long = T.LongType()
    return rows.mapInArrow(
        sign,
        with_fields(
            rows.select(*keep).schema,
            ("key", long),
            ("print1", long),
            ("print2", long),
            ("bands", T.ArrayType(long)),
        ),
    )


def _sets(signed_rows: DataFrame, keys: DataFrame, cfg: Near) -> DataFrame:
    """Exact sets of the asked rows, written once: key, hashes, counts.

    A merge join, so that no size of ``keys`` sends them to every executor.
    """
    texts = signed_rows.select("key", "text").hint("merge").join(keys, "key", "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                hashes, counts, bounds = shingle_table(part.column("text"), cfg.width)
                cut = list(zip(bounds[:-1], bounds[1:], strict=True))
                counts = counts.astype("<u4") if cfg.weights == "count" else counts[:0]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"),
                        pa.array([hashes[i:j].tobytes() for i, j in cut], pa.binary()),
                        pa.array([counts[i:j].tobytes() for i, j in cut], pa.binary()),
                    ],
                    names=["key", "hashes", "counts"],
                )

    return staged(texts.mapInArrow(sets, "key long, hashes binary, counts binary"), "sets")


def _probes(sets: DataFrame, cfg: Near) -> DataFrame:
    """key, small: half a byte for each of ``probe`` coordinates of a longer signature."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                found = [_set_of(r) for r in part.select(["hashes", "counts"]).to_pylist()]
                bounds = np.cumsum([0, *[len(h) for h, _ in found]])
                hashes = np.concatenate([h for h, _ in found])
                counts = np.concatenate([c for _, c in found])
                weights = counts if cfg.weights == "count" else np.ones(len(hashes), np.int64)
                kept = signatures(hashes, weights, bounds, cfg.probe)
                nibbles = (mix(kept) & _U(15)).astype(np.uint8)
                small = nibbles[:, ::2] << 4 | nibbles[:, 1::2]
                yield pa.RecordBatch.from_arrays(
                    [part.column("key"), pa.array([s.tobytes() for s in small], pa.binary())],
                    names=["key", "small"],
                )

    return sets.mapInArrow(probe, "key long, small binary")


def _with_bands(probes: DataFrame) -> DataFrame:
    """``bands`` as 32 bits each, which tell whether two members share an earlier band."""
    low = F.transform("bands", lambda b: F.shiftright(b, 32).cast("int"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("bands")
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype("<i4")
            grid = flat.reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("small"),
                 pa.array([g.tobytes() for g in grid], pa.binary())],
                names=["key", "small", "bands"],
            )

    rows = probes.select("key", "small", low.alias("bands"))
    return rows.mapInArrow(pack, "key long, small binary, bands binary")


def _verified(pairs: DataFrame, sets: DataFrame, cfg: Near) -> DataFrame:
    """The pairs ``a, b`` of members whose exact similarity reaches the threshold."""
    left = sets.select(F.col("key").alias("a"), F.struct("hashes", "counts").alias("x"))
    right = sets.select(F.col("key").alias("b"), F.struct("hashes", "counts").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column("x"), batch.column("y")
            good = [
                similarity(*_set_of(x[i].as_py()), *_set_of(y[i].as_py()), cfg.weights)
                >= cfg.threshold
                for i in range(batch.num_rows)
            ]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    matched = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return matched.mapInArrow(check, "a long, b long")


def _set_of(row: dict) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row["hashes"], "<u8"), np.frombuffer(row["counts"], "<u4")


def similarity(h1, c1, h2, c2, weights: str) -> float:
    """Jaccard similarity of two ascending hash sets, weighted by counts or not."""
    _, i, j = np.intersect1d(h1, h2, assume_unique=True, return_indices=True)
    if weights == "count":
        both = float(np.minimum(c1[i], c2[j]).sum())
        either = float(c1.sum()) + float(c2.sum()) - both
    else:
        both, either = float(len(i)), float(len(h1) + len(h2) - len(i))
    return both / either if either else 1.0


# Rows of one block that meet a row at a time, so that what is compared stays in the cache.
MEET = 512


def _cells(members: DataFrame, cfg: Near) -> DataFrame:
    """``members`` once for every pair of blocks (i, j) of their bucket that their ``own`` is part of."""
    part = F.pmod(F.xxhash64("key"), F.lit(1 << 30))
    count = members.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    size = count.groupBy("bucket").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("major")
    )
    width = F.least(F.greatest(F.col("n") / cfg.split, F.lit(cfg.block)), F.lit(64 * cfg.block))
    size = staged(
        size.filter("n > major.n").select(
            "bucket",
            F.col("major.label").alias("major"),
            F.ceil(F.col("major.n") / width).cast("int").alias("majors"),
            F.ceil((F.col("n") - F.col("major.n")) / width).cast("int").alias("minors"),
        ),
        "sizes",
    )
    # Minor blocks meet each other and the major blocks; major blocks never meet each other.
    placed = (
        members.join(size, "bucket")
        .withColumn("minor", F.col("label") != F.col("major"))
        .withColumn(
            "own",
            F.when(F.col("minor"), F.pmod(part, F.col("minors")).cast("int")).otherwise(
                F.col("minors") + F.pmod(part, F.col("majors")).cast("int")
            ),
        )
    )
    others = F.when(
        F.col("minor"), F.sequence(F.lit(0), F.col("minors") + F.col("majors") - 1)
    ).otherwise(F.sequence(F.lit(0), F.col("minors") - 1))
    facts = ["key", "label", "bands", "small"]
    cells = placed.select("bucket", "own", *facts, F.explode(others).alias("other"))
    return cells.select(
        "bucket",
        F.least("own", "other").alias("i"),
        F.greatest("own", "other").alias("j"),
        F.col("own").cast("int").alias("own"),
        *facts,
    )


def _blocks(members: DataFrame, cfg: Near) -> DataFrame:
    """Pairs of different components in one bucket whose signatures may reach the threshold."""
    cells = _cells(members, cfg)
    agree = cfg.threshold + (1 - cfg.threshold) / 16
    sure = cfg.threshold - 4.2 * math.sqrt(agree * (1 - agree) / cfg.probe) * 16 / 15

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in _runs(batches, ["bucket", "i", "j"]):
            key = cell.column("key").to_numpy()
            label = cell.column("label").to_numpy()
            own, low = cell.column("own").to_numpy(), cell.column("i").to_numpy()
            raw = b"".join(cell.column("small").to_pylist())
            small = np.frombuffer(raw, np.uint8).reshape(len(key), -1)
            band = int(cell.column("bucket")[0].as_py()) & (BAND_LIMIT - 1)
            raw = b"".join(cell.column("bands").to_pylist())
            earlier = np.frombuffer(raw, "<u4").reshape(len(key), -1)[:, :band]
            a = np.flatnonzero(own == low)
            others = np.flatnonzero(own == cell.column("j").to_numpy())
            width = 2 * small.shape[1]
            x, y = [], []
            for i, b in ((i, others[at : at + MEET]) for at in range(0, len(others), MEET) for i in a):
                j = b[(label[b] != label[i]) & ((key[b] > key[i]) | (own[i] != own[b]))]
                # Pairs that share an earlier band meet there.
                j = j[~(earlier[j] == earlier[i]).any(1)]
                if len(j):
                    differ = small[j] ^ small[i]
                    same = np.count_nonzero(differ < 16, 1) + np.count_nonzero(differ & 15 == 0, 1)
                    alike = same / width
                    j = j[(alike - 1 / 16) / (1 - 1 / 16) >= sure]
                    x.append(np.full(len(j), key[i]))
                    y.append(key[j])
            if x:
                x, y = np.concatenate(x), np.concatenate(y)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"]
                )

    order = ["bucket", "i", "j"]
    dealt = cells.repartition(*order).sortWithinPartitions(*order)
    return dealt.mapInArrow(meet, "a long, b long").distinct()


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.Table]:
    """Stretches of rows with equal values in ``names`` of a sorted stream."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = [batch.column(n).to_numpy() for n in names]
        new = np.zeros(batch.num_rows, bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            here = tuple(v[a] for v in values)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _labelled(
    rows: DataFrame, cfg: Near, keep: list[str], text: Column
) -> tuple[DataFrame, DataFrame]:
    """The written rows with keys and prints, and ``print1, print2, label`` of every distinct set.

    ``text`` is the text in terms of the kept columns. Both results are written tables; those in
    between are deleted.
    """
    spark, mark = rows.sparkSession, staged_mark()
    signed_rows = staged(_signed_rows(rows, cfg, keep), "signed").withColumn("text", text)
    members = signed_rows.groupBy("print1", "print2").agg(F.min(F.struct("key", "bands")).alias("m"))
    members = staged(members.select("print1", "print2", "m.*"), "members")
    # Texts without words are one member that no other text can resemble.
    filled = members.filter("print1 != 0 OR print2 != 0")
    # A bucket is a band key with the number of its band in the lowest bits.
    value = F.col("value").bitwiseAND(F.lit(-BAND_LIMIT)).bitwiseOR(F.col("band").cast("long"))
    entries = filled.select("key", F.posexplode("bands").alias("band", "value")).select(
        "key", value.alias("bucket")
    )
    # Both sides of these joins grow with the corpus: merge joins at any size, and the smaller side
    # is written first, so that a hot bucket meets it in a join that splits skewed partitions.
    shared = staged(entries.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1"), "shared")
    met = staged(entries.hint("merge").join(shared, "bucket"), "met")
    company = staged(met.groupBy("key").agg(F.sum("n").alias("company")), "company")
    centres = staged(
        met.select("bucket", "key")
        .hint("merge")
        .join(company, "key")
        .groupBy("bucket")
        .agg(F.max(F.struct("company", (-F.col("key")).alias("least"))).alias("m"))
        .select("bucket", (-F.col("m.least")).alias("centre")),
        "centres",
    )
    ends = [F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")]
    stars = staged(
        met.select("bucket", "key")
        .hint("merge")
        .join(centres, "bucket")
        .filter("key != centre")
        .select(*ends)
        .distinct(),
        "stars",
    )
    sets = _sets(signed_rows, company.select("key"), cfg)
    links = staged(_verified(stars, sets, cfg), "links")
    labels = components(links)
    named = met.select("bucket", "key").hint("merge").join(
        labels.withColumnRenamed("node", "key"), "key", "left"
    )
    named = named.select("bucket", "key", F.coalesce("label", "key").alias("label"))
    # Only buckets that hold several components are looked at again.
    several = staged(
        named.groupBy("bucket")
        .agg(F.min("label").alias("low"), F.max("label").alias("high"))
        .filter("low != high")
        .select("bucket"),
        "several",
    )
    still = staged(named.hint("merge").join(several, "bucket", "left_semi"), "open")
    probes = _probes(sets.join(still.select("key").distinct(), "key", "left_semi"), cfg)
    facts = staged(_with_bands(probes.join(members.select("key", "bands"), "key")), "probes")
    found = _blocks(still.join(facts, "key"), cfg)
    # Pairs that a centre has settled need no second look.
    found = staged(found.join(stars, ["a", "b"], "left_anti"), "pairs")
    more = _verified(found, sets, cfg)
    labels = components(staged(links.union(more), "links"))
    labels = labels.withColumnRenamed("node", "key")
    final = staged(
        members.join(labels, "key", "left").select(
            "print1", "print2", F.coalesce("label", "key").alias("label")
        ),
        "set-labels",
    )
    drop_staged(spark, mark + 1, staged_mark() - 1)
    return signed_rows, final


def classes(
    docs: DataFrame, cfg: Near = Near(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id and class_id, the least doc_id of its class."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    signed_rows, labels = _labelled(rows, cfg, ["doc_id", "text"], F.col("text"))
    named = staged(
        signed_rows.select("doc_id", "print1", "print2").join(labels, ["print1", "print2"]), "named"
    )
    least = staged(named.groupBy("label").agg(F.min("doc_id").alias("class_id")), "classes")
    return named.join(least, "label").select("doc_id", "class_id")


def keep_one(
    docs: DataFrame, cfg: Near = Near(), id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` with one row of each class: that of the least id, then row key."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col(f"`{id_col}`").alias("doc_id"),
        text_of(text_col).alias("text"),
    )
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    signed_rows, labels = _labelled(rows, cfg, ["row", "doc_id"], text)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    per_set = signed_rows.groupBy("print1", "print2").agg(first)
    kept = (
        per_set.join(labels, ["print1", "print2"])
        .groupBy("label")
        .agg(F.min("first").alias("first"))
        .select(F.col("first.key").alias("key"))
    )
    return signed_rows.join(kept, "key", "left_semi").select("row.*")
