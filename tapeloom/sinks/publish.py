"""Writes of which readers never see a part."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _paths(spark: SparkSession, path: str):
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path, jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


# A published version is a small file of its own, numbered, that names the version's folder.
POINTER = "_version-"
KEPT_VERSIONS = 2


class Conflict(RuntimeError):
    """Another writer has published since the version that the caller expects."""


def publish(df: DataFrame, path: str, fmt: str = "parquet", expect: int | None = None) -> str:
    """Write a new version below ``path`` and make it the current one; returns the version's folder.

    Executors write the version in parallel into a folder of its own. Then its number is claimed by
    :func:`claim`. Nothing that a reader may hold is ever opened for writing: a job that ends before
    that leaves the old version current, and readers (:func:`current`) see whole versions only. With
    ``expect`` the claim succeeds only if that number is still the last one (0 for none), else
    :class:`Conflict` is raised and the folder dropped. Versions before the last two are deleted, so a
    reader that has just resolved a version still finds its files.
    """
    root = path.rstrip("/")
    name = _draft(df, root, fmt)
    _make_current(df.sparkSession, root, name, expect)
    return f"{root}/{name}"


def publish_aligned(
    features: DataFrame, metadata: DataFrame, paths: tuple[str, str], keys: list[str],
    metadata_keys: list[str] | None = None,
) -> None:
    """Publish two tables that must have the same keys; neither becomes current where they differ.

    ``metadata_keys`` are the names of ``keys`` in the metadata, where they are others there.

    Keys are compared on the way: each write counts its rows and adds up two 64-bit hashes of their
    keys, whatever their order, so neither table is computed or read for the check. Only after a
    difference are the two written tables read, to say how many keys only one of them has.
    """
    spark = features.sparkSession
    roots = [path.rstrip("/") for path in paths]
    named = (keys, metadata_keys or keys)
    names, sums = [], []
    for df, root, own in zip((features, metadata), roots, named):
        watch = Observation()
        names.append(_draft(df.observe(watch, *_key_sums(own)), root, "parquet"))
        sums.append(watch.get)
    if sums[0] != sums[1]:
        written = [
            spark.read.parquet(f"{root}/{name}").select(*[F.col(c).alias(k) for c, k in zip(own, keys)])
            for root, name, own in zip(roots, names, named)
        ]
        report = alignment(*written, keys).first().asDict()
        for root, name in zip(roots, names):
            _drop(spark, root, name)
        raise ValueError(f"features and metadata differ: {report}")
    for root, name in zip(roots, names):
        _make_current(spark, root, name, None)


def _key_sums(keys: list[str]) -> list:
    key = F.to_json(
        F.struct(*[F.col(k).alias(str(i)) for i, k in enumerate(keys)]), {"ignoreNullFields": "false"}
    )
    hashes = [F.sum(F.xxhash64(F.lit(i), key).cast("decimal(20,0)")) for i in range(2)]
    return [F.count(F.lit(1)).alias("rows"), *[h.alias(f"sum_{i}") for i, h in enumerate(hashes)]]


def _draft(df: DataFrame, root: str, fmt: str) -> str:
    """Write a version that nothing names yet; the name of its folder."""
    name = f"v-{uuid.uuid4().hex}"
    writer = df.write.option("header", True) if fmt == "csv" else df.write
    writer.format(fmt).save(f"{root}/{name}")
    return name


def _drop(spark: SparkSession, root: str, name: str) -> None:
    folder, files = _paths(spark, f"{root}/{name}")
    files.delete(folder, True)


def _make_current(spark: SparkSession, root: str, name: str, expect: int | None) -> None:
    try:
        number = claim(spark, root, name, expect)
    except Conflict:
        _drop(spark, root, name)
        raise
    _forget(spark, root, number - KEPT_VERSIONS)


def claim(spark: SparkSession, root: str, name: str, expect: int | None = None) -> int:
    """Publish the folder ``name`` under the next free number, which only one writer can get.

    The number's file is written under another name and closed, then given its name by an operation
    that is atomic and fails where the name is taken: a hard link on a local disk, a rename without
    overwriting elsewhere. (Object stores without atomic renames need a committer of their own.)
    """
    draft = f"{root}/.draft-{uuid.uuid4().hex}"
    _write_text(spark, draft, name)
    try:
        while True:
            last = max([n for n, _ in _versions(spark, root)], default=0)
            if expect is not None and last != expect:
                raise Conflict(f"version {last} is current at {root}, not {expect}")
            if _renamed(spark, draft, f"{root}/{POINTER}{last + 1:012d}"):
                return last + 1
    finally:
        target, files = _paths(spark, draft)
        files.delete(target, False)


def _renamed(spark: SparkSession, source: str, target: str) -> bool:
    """Give a closed file another name unless that is taken; atomic."""
    old, files = _paths(spark, source)
    new, _ = _paths(spark, target)
    if files.getScheme() == "file":
        try:
            os.link(_local(old), _local(new))
        except FileExistsError:
            return False
        return True
    jvm = spark.sparkContext._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        files.getUri(), spark.sparkContext._jsc.hadoopConfiguration()
    )
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.NONE
    try:
        context.rename(old, new, options)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
            raise
        return False
    return True


def _local(path) -> str:
    return path.toUri().getPath()


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, file) of all published versions that are left, ascending."""
    folder, files = _paths(spark, root)
    if not files.exists(folder):
        return []
    names = [e.getPath().getName() for e in files.listStatus(folder)]
    return sorted((int(n.removeprefix(POINTER)), f"{root}/{n}") for n in names if n.startswith(POINTER))


def _read_text(spark: SparkSession, path: str) -> str | None:
    target, files = _paths(spark, path)
    try:
        stream = files.open(target)
    except Py4JJavaError as error:
        if error.java_exception.getClass().getSimpleName() != "FileNotFoundException":
            raise
        return None
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _forget(spark: SparkSession, root: str, upto: int) -> None:
    """Delete versions up to a number: the folder first, then the file that names it.

    Folders that no file names yet belong to writers at work and stay.
    """
    for number, file in _versions(spark, root):
        if number <= upto:
            name = _read_text(spark, file)
            for gone in (f"{root}/{name}" if name else None, file):
                if gone:
                    target, files = _paths(spark, gone)
                    files.delete(target, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    target, files = _paths(spark, path)
    out = files.create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def version(spark: SparkSession, path: str) -> int:
    """The number of the published version, 0 for none; to be given to :func:`publish` as ``expect``."""
    return max([n for n, _ in _versions(spark, path.rstrip("/"))], default=0)


def current(spark: SparkSession, path: str, missing_ok: bool = False) -> str | None:
    """The folder of the published version of ``path``."""
    root = path.rstrip("/")
    while found := _versions(spark, root):
        name = _read_text(spark, found[-1][1])
        if name is not None:  # else the version was superseded and dropped between two looks
            return f"{root}/{name}"
    if missing_ok:
        return None
    raise FileNotFoundError(f"nothing is published at {path}")


def publish_ids(df: DataFrame, path: str, column: str = "market_id") -> str:
    """One id per line."""
    return publish(df.select(F.col(column).cast("string").alias("value")), path, "text")


def alignment(features: DataFrame, metadata: DataFrame, keys: list[str]) -> DataFrame:
    """One row: row counts of both tables and keys that only one of them has.

    Both tables are reduced to counts per key before anything is compared.
    """

    def tally(df: DataFrame, n_left: int, n_right: int) -> DataFrame:
        return df.select(*keys, F.lit(n_left).alias("f"), F.lit(n_right).alias("m"))

    per_key = (
        tally(features, 1, 0)
        .unionByName(tally(metadata, 0, 1))
        .groupBy(*keys)
        .agg(F.sum("f").alias("f"), F.sum("m").alias("m"))
    )
    return per_key.agg(
        F.coalesce(F.sum("f"), F.lit(0)).alias("n_features"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("n_metadata"),
        F.count_if((F.col("m") == 0)).alias("only_features"),
        F.count_if((F.col("f") == 0)).alias("only_metadata"),
    ).withColumn(
        "aligned",
        (F.col("n_features") == F.col("n_metadata"))
        & (F.col("only_features") == 0)
        & (F.col("only_metadata") == 0),
    )


def require_aligned(features: DataFrame, metadata: DataFrame, keys: list[str]) -> None:
    report = alignment(features, metadata, keys).first()
    if not report["aligned"]:
        raise ValueError(f"features and metadata differ: {report.asDict()}")
