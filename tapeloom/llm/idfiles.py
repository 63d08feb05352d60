"""Token ids in Arrow files of fixed-size-list batches.

A file is an Arrow IPC file without compression. Each row of a batch holds ``ids``, a fixed-size list
of ``length`` unsigned 16- or 32-bit ids, and ``mask``, a fixed-size list of as many bits, so that any
sequence is reached by its number without copying or decoding: row // batch_rows is the batch. Local
files are mapped into memory, and ids and masks are views of the map; from other stores a batch is
fetched once and both are views of it. The ids of all documents follow each other; only the last
sequence of a file is padded, where the mask is false. Beside it a second Arrow file holds ``doc_id``,
``start`` in the file's ids, and ``n_tokens``.

Documents are written in ascending id order: ranges of (id, row key) are dealt to tasks, each sorts
and writes one pair of files. A task writes under a name of its own attempt and renames at the end,
so a repeated task leaves whole files only; the manifest names those that count. Readers add up the
manifest's totals, one row per file, to turn places in files into places in all ids.

Defined results: a missing text is empty; an empty text is the end id alone; missing doc ids come
first; repeated doc ids keep the order in which the input is read; an empty table gives no rows;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tapeloom.llm import tokens
from tapeloom.llm.rows import staged, text_of
from tapeloom.session import scratch


@dataclass(frozen=True)
class IdFiles:
    """``bits`` is 16 where all ids fit; a batch is ``batch_rows`` sequences of ``length`` ids."""

    tokenizer: str
    chunks: str = tokens.LEADING_BLANKS
    end_id: int = 0
    length: int = 2048
    batch_rows: int = 256
    bits: int = 16
    memo_words: int = 250_000


def _filesystem(path: str):
    from pyarrow import fs

    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://") :]
    return fs.FileSystem.from_uri(path if "://" in path else "file://" + path.replace("file:", ""))


def _opened(store, path: str):
    """A memory map where the file is local, else a file of its store."""
    from pyarrow import fs

    return pa.memory_map(path) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


class SequenceWriter:
    """Writes ids as they come; holds at most one batch."""

    def __init__(self, sink, cfg: IdFiles):
        self._cfg = cfg
        self._type = np.dtype(f"<u{cfg.bits // 8}")
        value = pa.from_numpy_dtype(self._type)
        self._schema = pa.schema(
            [("ids", pa.list_(value, cfg.length)), ("mask", pa.list_(pa.bool_(), cfg.length))]
        )
        self._file = pa.ipc.new_file(sink, self._schema)
        self._held: list[np.ndarray] = []
        self._count = 0

    def add(self, ids: np.ndarray) -> None:
        if ids.size and int(ids.max()) >> self._cfg.bits:
            raise ValueError(f"an id does not fit in {self._cfg.bits} bits")
        self._held.append(ids.astype(self._type))
        self._count += len(ids)
        full = self._cfg.length * self._cfg.batch_rows
        if self._count >= full:
            held = np.concatenate(self._held)
            whole = len(held) // full * full
            for at in range(0, whole, full):
                self._write(held[at : at + full], full)
            self._held = [held[whole:]]
            self._count = len(held) - whole

    def _write(self, ids: np.ndarray, real: int) -> None:
        mask = np.arange(len(ids)) < real
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(v), self._cfg.length) for v in (ids, mask)
        ]
        self._file.write_batch(pa.RecordBatch.from_arrays(columns, schema=self._schema))

    def close(self) -> None:
        if self._count:
            rows = -(-self._count // self._cfg.length)
            ids = np.zeros(rows * self._cfg.length, self._type)
            ids[: self._count] = np.concatenate(self._held)
            self._write(ids, self._count)
        self._file.close()


class SequenceReader:
    """Random access to the sequences and to stretches of ids of one file."""

    def __init__(self, source, length: int, batch_rows: int):
        self._file = pa.ipc.open_file(source)
        self._length, self._rows = length, batch_rows
        self._at, self._batch = -1, None

    def _lists(self, number: int) -> pa.RecordBatch:
        if number != self._at:
            self._at, self._batch = number, self._file.get_batch(number)
        return self._batch

    def sequence(self, row: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of one sequence, both views of the file's bytes; the mask stays bits."""
        batch = self._lists(row // self._rows)
        ids, mask = (batch.column(name)[row % self._rows].values for name in ("ids", "mask"))
        return ids.to_numpy(zero_copy_only=True), mask

    def stretch(self, start: int, count: int) -> np.ndarray:
        """``count`` ids from ``start`` on, over as many batches as they span."""
        size = self._rows * self._length
        parts = []
        while count > 0:
            values = self._lists(start // size).column("ids").flatten()
            part = values.to_numpy(zero_copy_only=True)[start % size :][:count]
            parts.append(part)
            start += len(part)
            count -= len(part)
        return np.concatenate(parts) if len(parts) != 1 else parts[0]


def write(
    docs: DataFrame, path: str, cfg: IdFiles, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write the files below ``path``; the manifest: file, part, docs and tokens of each file."""
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(text_col).alias("text"))
    source = source.withColumn("_key", F.monotonically_increasing_id())
    ranged = source.repartitionByRange("doc_id", "_key").sortWithinPartitions("doc_id", "_key")
    end = np.array([cfg.end_id], "<u4").tobytes()
    id_type = source.schema["doc_id"].dataType
    filesystem, folder = _filesystem(path)
    filesystem.create_dir(folder, recursive=True)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        encoder = tokens.encoder(cfg.tokenizer, cfg.chunks, cfg.memo_words)
        store, top = _filesystem(path)
        attempt = f"{top}/.attempt-{part}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        writer = index = None
        at = rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                sink = store.open_output_stream(f"{attempt}.ids")
                side = store.open_output_stream(f"{attempt}.docs")
                writer = SequenceWriter(sink, cfg)
                schema = pa.schema(
                    [
                        ("doc_id", batch.column("doc_id").type),
                        ("start", pa.int64()),
                        ("n_tokens", pa.int64()),
                    ]
                )
                index = pa.ipc.new_file(side, schema)
            counts = np.empty(batch.num_rows, np.int64)
            for row, text in enumerate(batch.column("text")):
                ids = np.frombuffer(encoder.encode([text.as_py()])[0] + end, "<u4")
                counts[row] = len(ids)
                writer.add(ids)
            ends = at + np.cumsum(counts)
            columns = [batch.column("doc_id"), pa.array(ends - counts), pa.array(counts)]
            index.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
            at, rows = int(ends[-1]), rows + batch.num_rows
        if writer is None:
            return
        for file in (writer, index, sink, side):
            file.close()
        name = f"part-{part:06d}-{uuid.uuid4().hex}"
        for kind in ("ids", "docs"):
            store.move(f"{attempt}.{kind}", f"{top}/{name}.{kind}.arrow")
        values = [[name], [part], [rows], [at]]
        yield pa.RecordBatch.from_pydict(
            dict(zip(("file", "part", "docs", "tokens"), map(pa.array, values), strict=True))
        )

    manifest = staged(
        ranged.mapInArrow(task, "file string, part long, docs long, tokens long"), "id-files"
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per file, whatever the documents: a single small task adds them up.
    placed = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    return spark.createDataFrame(placed.collect(), placed.schema).withMetadata(
        "before", {"doc_id": id_type.simpleString()}
    )


def read(spark: SparkSession, path: str, manifest: DataFrame, cfg: IdFiles) -> DataFrame:
    """Per document, from the files: doc_id, start in all ids, n_tokens, ids_crc32."""
    id_type = manifest.schema["before"].metadata["doc_id"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _filesystem(path)
        for batch in batches:
            for file in batch.to_pylist():
                name = f"{top}/{file['file']}"
                reader = SequenceReader(
                    _opened(store, f"{name}.ids.arrow"), cfg.length, cfg.batch_rows
                )
                index = pa.ipc.open_file(_opened(store, f"{name}.docs.arrow"))
                for number in range(index.num_record_batches):
                    docs = index.get_batch(number)
                    sums = [
                        zlib.crc32(reader.stretch(start, count).astype("<u4").tobytes())
                        for start, count in zip(
                            docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist()
                        )
                    ]
                    start = docs.column("start").to_numpy() + file["before"]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), pa.array(start), docs.column("n_tokens"),
                         pa.array(sums, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = manifest.select("file", "before", "part").repartitionByRange(
        max(1, spark.sparkContext.defaultParallelism), "part"
    )
    return files.mapInArrow(
        task, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long"
    )


def round_trip(docs: DataFrame, cfg: IdFiles, id_col: str = "doc_id", text_col: str = "text"):
    """Write below the shared folder and read back."""
    spark = docs.sparkSession
    path = scratch(spark, "ids")
    manifest = write(docs, path, cfg, id_col, text_col)
    return read(spark, path, manifest, cfg)
