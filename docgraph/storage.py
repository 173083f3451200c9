"""Tables written between steps: they cut lineages and are read again by other executors."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions without a setting, by application.
_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: the cluster's ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder in local mode, and an error on a
    cluster, whose machines don't see each other's folders.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    context = spark.sparkContext
    if not context.master.startswith("local") or "cluster" in context.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    return _own.setdefault(context.applicationId, tempfile.mkdtemp(prefix="spark-shared-"))


#: Tables written inside of ``scratch``, the innermost last.
_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``written`` has written inside: for callers that have stored or collected their result by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for name in _scopes.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder as Parquet and read back.

    Lost executors cost a re-read, not a recomputation. The folder is the
    caller's to clear, as with any checkpoint directory, or ``scratch``'s.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a folder that go to one task of ``dealt``.
DEALT = 16 << 20


def dealt(df: DataFrame, path: str, *keys: str) -> DataFrame:
    """``df``, read from ``path``, by key in tasks of some 16 MB of it each.

    Adaptive execution makes as few tasks as there are cores of what it shuffles
    itself, so that what a join or an aggregate holds grows with the input; it
    leaves a given number of tasks as it is.
    """
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return df.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(size / DEALT)), *keys)


class Conflict(RuntimeError):
    """Someone else has published the version that was to be written."""


def _versions(spark: SparkSession, path: str) -> tuple:
    """The file system of ``path`` and its version files by number."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/versions")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = {int(f.getPath().getName()): f for f in fs.listStatus(folder) if f.getPath().getName().isdigit()} if fs.exists(folder) else {}
    return fs, found


def name_version(spark: SparkSession, path: str, base: int, text: str) -> int:
    """Makes the version after ``base`` of what lies at ``path``: a small file that says ``text``, made only if it isn't there; else Conflict."""
    fs, found = _versions(spark, path)
    if max(found, default=0) != base:
        raise Conflict(f"version {max(found, default=0)} of {path} was published meanwhile")
    try:
        out = fs.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{base + 1:010d}"), False)
    except Exception as e:
        raise Conflict(f"version {base + 1} of {path} was published meanwhile") from e
    out.write(text.encode())
    out.close()
    return base + 1


def named(spark: SparkSession, path: str) -> tuple[int, str]:
    """(newest version, its text); a writer that was lost while it named a version leaves one that says what the version before it does."""
    fs, found = _versions(spark, path)
    for number in sorted(found, reverse=True):
        if found[number].getLen():
            return max(found), spark.read.text(found[number].getPath().toString(), wholetext=True).first()[0]
    return max(found, default=0), ""


def publish(df: DataFrame, path: str, base: int) -> int:
    """``df`` as the version after ``base`` of the table at ``path`` (0: there is none yet); Conflict if another writer was first.

    Rows are staged in a folder of their own, which a small file then names, so
    that readers see all of a version or none. The store must make files
    exclusively, as HDFS does.
    """
    staged = f"{path}/data/{uuid.uuid4().hex}"
    df.write.parquet(staged)
    return name_version(df.sparkSession, path, base, staged)


def published(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """(version, rows) of the newest version; (0, None) without any."""
    version, folder = named(spark, path)
    return version, spark.read.parquet(folder) if folder else None
