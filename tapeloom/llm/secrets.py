"""Secret scans with corpus-wide ownership frequency.

Every whole text is searched for spans of three base kinds (assignments, access keys, hex runs) and
for further candidates: runs of 20 key characters or more, of any length, with letters and digits and
a high entropy. The value of each span is hashed; per hash the distinct repositories and distinct
owners over the whole corpus are counted. A value of few owners and repositories looks live; one that
many share is a widely copied example. Base spans always stay, each with its verdict and both counts;
candidates that look live are added as spans of kind ``owned``, the others are not. With
``repositories=None`` in the settings, or rows without repositories (``repository=None``), owners alone
decide: however many repositories of one owner never make an example.

Defined results: a missing text is empty and has no spans; a missing owner or repository counts as
one more value; repeated rows are scanned each, and count as one repository; an empty table gives no
rows; a text of any length is scanned whole, in time in proportion to it; candidates that touch a
base span are none; spans are in code points, end exclusive, ordered by start, then by kind in the order listed;
other columns are carried whole by ``mask`` and ignored by ``scan``, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.rows import parts, row_keys, staged, text_of, with_fields

KINDS = ("assign", "access", "hex", "owned")
# The base patterns and their least lengths.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])")


@dataclass(frozen=True)
class Ownership:
    """Most owners and repositories (None: any number) of a value that looks live; least entropy
    (bits per character) of a candidate."""

    owners: int = 2
    repositories: int | None = 8
    entropy: float = 3.5


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind number, end, value) of the base kinds, ordered."""
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 12:
                found.append((m.start(), 0, m.end(), m[2]))
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list, least: float) -> list[tuple[int, int, int, str]]:
    """Further values outside the base spans."""
    found, at = [], 0
    # Base spans by start; the furthest end so far tells whether one of them reaches a place.
    starts = [b[0] for b in base]
    reach = list(accumulate((b[2] for b in base), max))
    for m in CANDIDATE.finditer(text):
        while at < len(starts) and starts[at] < m.end():
            at += 1
        value = m[0]
        if at and reach[at - 1] > m.start():
            continue
        if any(map(str.isdigit, value)) and any(map(str.isalpha, value)):
            if entropy(value) >= least:
                found.append((m.start(), 3, m.end(), value))
    return found


def describe(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b, *_ in spans)


def _scanned(rows: DataFrame, cfg: Ownership, keep: list[str]) -> DataFrame:
    """The kept columns of each row with its key, base digest and spans."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = row_keys()
        next(keys)
        span = pa.struct(
            [("start", pa.int64()), ("kind", pa.int64()), ("end", pa.int64()), ("hash", pa.binary())]
        )
        for batch in (p for b in batches for p in parts(b)):
            counts, digests, spans = [[], [], []], [], []
            for text in batch.column("text").to_pylist():
                base = base_spans(text)
                for kind in range(3):
                    counts[kind].append(sum(s[1] == kind for s in base))
                digests.append(hashlib.sha256(describe(base).encode()).hexdigest())
                spans.append(
                    [
                        {"start": a, "kind": k, "end": b, "hash": hashlib.sha256(v.encode()).digest()}
                        for a, k, b, v in base + candidates(text, base, cfg.entropy)
                    ]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c) for c in keep],
                    pa.array(keys.send(batch.num_rows)),
                    *[pa.array(c, pa.int64()) for c in counts],
                    pa.array(digests, pa.string()),
                    pa.array(spans, pa.list_(span)),
                ],
                names=[*keep, "key", "n_assign", "n_access", "n_hex", "base_sha256", "found"],
            )

    span = "array<struct<start:long,kind:long,end:long,hash:binary>>"
    long = T.LongType()
    return rows.mapInArrow(
        scan,
        with_fields(
            rows.select(*keep).schema,
            ("key", long),
            ("n_assign", long),
            ("n_access", long),
            ("n_hex", long),
            ("base_sha256", T.StringType()),
            ("found", T._parse_datatype_string(span)),
        ),
    )


def ownership(values: DataFrame) -> DataFrame:
    """``hash, owners, repositories`` of ``values(hash, owner, repository)``: distinct counts.

    Each step sums within tasks before it shuffles, so a value that a third of all rows hold costs
    a few rows per task.
    """
    return (
        values.distinct()
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("n"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))
    )


SPAN = ("start", "kind", "end", "live", "owners", "repositories")


def _judged(scanned: DataFrame, cfg: Ownership, by_repository: bool) -> DataFrame:
    """Per row key: its spans with their verdicts and counts, in order, candidates only where live."""
    values = scanned.select("key", "owner", "repository", F.explode("found").alias("s"))
    values = values.select("key", "owner", "repository", "s.*")
    known = staged(ownership(values.select("hash", "owner", "repository")), "ownership")
    live = F.col("owners") <= cfg.owners
    if by_repository and cfg.repositories is not None:
        live &= F.col("repositories") <= cfg.repositories
    verdicts = values.join(known.withColumn("live", live), "hash").filter("kind < 3 OR live")
    span = F.struct(*SPAN)
    return verdicts.groupBy("key").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def _column(of: Column | str | None) -> Column:
    if of is None:
        return F.lit(None)
    return F.col(f"`{of}`") if isinstance(of, str) else of


def _source(docs: DataFrame, owner, repository, text_col: str, *more: Column) -> DataFrame:
    return docs.select(
        *more,
        _column(owner).cast("string").alias("owner"),
        _column(repository).cast("string").alias("repository"),
        text_of(text_col).alias("text"),
    )


def scan(
    docs: DataFrame,
    owner: Column | str,
    repository: Column | str | None,
    cfg: Ownership = Ownership(),
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: doc_id, counts and digest of the base spans, all spans, and their verdicts.

    ``held_by`` has, span by span, the owners of its value and, where repositories are given, their number.
    """
    rows = _source(docs, owner, repository, text_col, F.col(f"`{id_col}`").alias("doc_id"))
    scanned = staged(_scanned(rows, cfg, ["doc_id", "owner", "repository"]), "scanned")
    kinds = F.array(*map(F.lit, KINDS))
    shown = F.transform(
        "spans",
        lambda s: F.concat_ws(":", F.element_at(kinds, s.kind.cast("int") + 1), s.start, s.end),
    )
    held = F.transform(
        "spans",
        lambda s: F.concat_ws(":", s.owners, s.repositories)
        if repository is not None
        else s.owners.cast("string"),
    )
    of = ",".join(f"{name}:{'boolean' if name == 'live' else 'long'}" for name in SPAN)
    spans = F.coalesce("spans", F.array().cast(f"array<struct<{of}>>"))
    judged = scanned.join(_judged(scanned, cfg, repository is not None), "key", "left").withColumn("spans", spans)
    return judged.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        "base_sha256",
        F.concat_ws(",", shown).alias("spans"),
        F.concat_ws(",", held).alias("held_by"),
        F.size(F.filter("spans", lambda s: s.kind == 3)).cast("long").alias("n_owned"),
        F.size(F.filter("spans", lambda s: s.live)).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s.live)).cast("long").alias("n_example"),
    )


def hide(text: str, spans: list[dict]) -> str:
    """The text with overlapping spans joined and replaced: live ones and examples apart."""
    out, at, i = [], 0, 0
    while i < len(spans):
        start, end, live = spans[i]["start"], spans[i]["end"], spans[i]["live"]
        i += 1
        while i < len(spans) and spans[i]["start"] < end:
            end, live = max(end, spans[i]["end"]), live or spans[i]["live"]
            i += 1
        out += [text[at:start], "<secret>" if live else "<example>"]
        at = end
    return "".join([*out, text[at:]])


def mask(
    docs: DataFrame,
    owner: Column | str,
    repository: Column | str | None,
    cfg: Ownership = Ownership(),
    text_col: str = "text",
    length_col: str | None = "n_chars",
) -> DataFrame:
    """``docs`` with every found span replaced by a mark of its verdict, and the length renewed.

    Rows without spans pass as they are, by a scan of their own; only the others are written,
    counted and shuffled.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = _source(docs, owner, repository, text_col, row)
    scanned = _scanned(rows, cfg, ["row", "owner", "repository"])
    holding = staged(scanned.filter(F.size("found") > 0), "holding")
    found = holding.select("key", "owner", "repository", "found")
    judged = _judged(found, cfg, repository is not None)
    struck = holding.select("key", "row").join(judged, "key", "left")
    struck = struck.select(F.col(f"row.`{text_col}`").alias("text"), "spans", "row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())
            new = [t if not s else hide(t, s) for t, s in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(new, pa.string())], names=["row", "new"]
            )

    hidden = struck.mapInArrow(
        cut, with_fields(struck.select("row").schema, ("new", T.StringType()))
    )
    fields = []
    for c in docs.columns:
        if c == text_col:
            fields.append(F.col("new").alias(c))
        elif c == length_col:
            kind = docs.schema[c].dataType
            fields.append(F.length("new").cast(kind).alias(c))
        else:
            fields.append(F.col(f"row.`{c}`").alias(c))
    return scanned.filter(F.size("found") == 0).select("row.*").unionByName(hidden.select(*fields))
