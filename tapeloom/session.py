"""Session conventions, the shared scratch folder, and size-aware joins."""

from __future__ import annotations

import hashlib
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Settings a session should be created with. The clock is UTC. Series are unfolded after their
# shuffle, so the bytes of a shuffle partition understate its work and small partitions are not
# merged down to one.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
}
# Bytes a text or nested value is taken to have where a row's width is estimated.
WIDE_VALUE = 64


def prepare(spark: SparkSession) -> SparkSession:
    """Times are read in UTC; a session with another clock is switched, nothing else is changed."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


_local_scratch: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    A machine-local folder is used only where the setting is absent and Spark runs in one
    local JVM, as in tests; on a cluster the missing setting is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        if not _local_scratch:
            _local_scratch.append(tempfile.mkdtemp(prefix="tapeloom-"))
        path = _local_scratch[0]
    return path.rstrip("/")


class _Owner(threading.local):
    """The tables a thread has staged, and the job whose folder it stages them in, if any."""

    def __init__(self):
        self.paths: list[str] = []
        self.job: str | None = None
        self.step = 0


_owner = _Owner()


def staged(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the files.

    Used where one result feeds several branches or many iterations: the lineage is cut by a
    table that outlives any executor. This runs a job; :func:`drop_staged` or the end of the
    surrounding :func:`staging` deletes the tables. Within a job that can be resumed, a table that
    an earlier run has finished is read instead.
    """
    path, there = _place(df.sparkSession, label)
    if not there:
        writer = df.write.option("compression", compression) if compression else df.write
        writer.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_with_counts(df: DataFrame, label: str, counts: dict[str, Column]) -> tuple[DataFrame, dict]:
    """:func:`staged`, and aggregates over the rows that are gathered while they are written.

    A table that an earlier run has finished is read for them instead.
    """
    path, there = _place(df.sparkSession, label)
    named = [c.alias(name) for name, c in counts.items()]
    table = df.sparkSession.read.schema(df.schema).parquet
    if there:
        return table(path), table(path).agg(*named).first().asDict()
    watch = Observation()
    df.observe(watch, *named).write.mode("overwrite").parquet(path)
    return table(path), watch.get


def _place(spark: SparkSession, label: str) -> tuple[str, bool]:
    """Where this thread's next table goes, and whether an earlier run has finished it."""
    if _owner.job is None:
        path, there = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}", False
    else:
        path = f"{_owner.job}/{_owner.step:03d}-{label}"
        _owner.step += 1
        there = _exists(spark, f"{path}/_SUCCESS")
    _owner.paths.append(path)
    return path, there


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder for files other than tables; it goes as staged tables do."""
    path = f"{_owner.job or shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _owner.paths.append(path)
    return path


def staged_mark() -> int:
    """A mark for :func:`drop_staged`: tables staged by this thread from now on."""
    return len(_owner.paths)


def drop_staged(spark: SparkSession, mark: int = 0, until: int | None = None) -> None:
    """Delete the tables staged by this thread since ``mark`` (and before ``until``).

    Their frames, and those that read them, can no longer be used. Tables of a job that can be
    resumed stay until its end.
    """
    if _owner.job is None:
        for path in _owner.paths[mark:until]:
            _delete(spark, path)
    del _owner.paths[mark:until]


@contextmanager
def staging(spark: SparkSession, resume: str | None = None) -> Iterator[None]:
    """A job that owns the tables staged in it: they go at its end, also when it fails.

    Jobs in other threads have tables of their own. With ``resume``, a name of the job's inputs and
    settings (:func:`job_name`), tables stay where the job fails or is killed; a later run of the
    same name reads the finished ones, as its steps are staged in the same order. A job inside
    another belongs to it.
    """
    if _owner.job is not None or resume is None:
        mark = staged_mark()
        try:
            yield
        finally:
            drop_staged(spark, mark)
        return
    outer, _owner.paths = _owner.paths, []
    _owner.job, _owner.step = f"{shared_dir(spark)}/job-{resume}", 0
    try:
        yield
        _delete(spark, _owner.job)
    finally:
        _owner.job, _owner.paths = None, outer


def job_name(job: str, settings: object, inputs: dict[str, str]) -> str:
    """A name for :func:`staging` that changes with the settings and with the inputs' versions.

    ``inputs`` names each input and its version, such as a published folder or a snapshot id.
    """
    said = repr((job, settings, sorted(inputs.items())))
    return f"{job}-{hashlib.sha256(said.encode()).hexdigest()[:32]}"


def _files(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    where, files = _files(spark, path)
    return files.exists(where)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder; none where there is no folder."""
    where, files = _files(spark, path)
    return sorted(e.getPath().getName() for e in files.listStatus(where)) if files.exists(where) else []


def _delete(spark: SparkSession, path: str) -> None:
    where, files = _files(spark, path)
    files.delete(where, True)


def row_bytes(schema: T.StructType) -> int:
    """Estimated width of a row: 8 bytes for a number, ``WIDE_VALUE`` for any other value."""
    narrow = (T.NumericType, T.BooleanType, T.DatetimeType)
    return sum(8 if isinstance(f.dataType, narrow) else WIDE_VALUE for f in schema)


def broadcast_bytes(spark: SparkSession) -> int:
    """The session's own bound on a table sent to every executor; -1 where it is off."""
    return spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def join_small(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "inner",
    max_rows: int | None = None,
) -> DataFrame:
    """Join many rows per key (``big``) to at most a few rows per key (``small``).

    ``max_rows`` is an upper bound on ``small`` known before the job runs (the counted selection,
    a fixed dimension). Where that many rows of its width stay within the session's broadcast
    bound, the small side is broadcast and ``big`` is not shuffled. Otherwise both sides are
    shuffled by the key, and adaptive execution measures them: it still broadcasts a side that
    proves small, and splits partitions of a hot key.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"join type {how!r} cannot replicate the small side")
    if max_rows is not None:
        if max_rows * row_bytes(small.schema) <= broadcast_bytes(big.sparkSession):
            return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)
