"""Tables by key that a stream's batches change: only the buckets of a batch's keys are read and written."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.storage import named, name_version


class KeyedTable:
    """Rows of ``schema`` at ``path`` in buckets by a hash of ``key``.

    A version is a small file that names, for each bucket, the folders with its
    rows; a change stages new folders and then names the next version, so
    readers see all of a change or none, and a batch that is run again after a
    failure starts from the same version. One writer at a time: another one that
    was first is a Conflict.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, schema: str, buckets: int = 64):
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def folders(self) -> tuple[int, dict[int, list[str]]]:
        version, text = named(self.spark, self.path)
        lines = (line.split("\t") for line in text.splitlines())
        return version, {int(b): own for b, *own in lines}

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys: at most as many rows as there are buckets."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """All rows, or those of ``keys``, for which their buckets alone are read."""
        _, folders = self.folders()
        wanted = folders if keys is None else self.touched(keys)
        paths = [f for b in wanted for f in folders.get(b, ())]
        rows = self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)
        return rows if keys is None else rows.join(keys.select(self.key).distinct(), self.key, "left_semi").select(*rows.columns)

    def write(self, rows: DataFrame, keys: DataFrame | None = None) -> None:
        """Adds ``rows``; with ``keys``, in place of all rows that these have."""
        version, folders = self.folders()
        names = self.spark.createDataFrame([], self.schema).columns
        out = rows.select(*names)
        if keys is not None:
            again = self.touched(keys)
            paths = [f for b in again for f in folders.get(b, ())]
            if paths:
                others = self.spark.read.schema(self.schema).parquet(*paths)
                out = out.unionByName(others.join(keys.select(self.key).distinct(), self.key, "left_anti"))
            folders = {b: own for b, own in folders.items() if b not in set(again)}
        staged = f"{self.path}/data/{uuid.uuid4().hex}"
        out = out.withColumn("bucket", self.bucket())
        out.repartition("bucket").write.partitionBy("bucket").parquet(staged)
        for b in self._filled(staged):
            folders.setdefault(b, []).append(f"{staged}/bucket={b}")
        name_version(self.spark, self.path, version, "\n".join("\t".join([str(b), *own]) for b, own in sorted(folders.items())) or "-1")

    def _filled(self, folder: str) -> list[int]:
        """Buckets that a staged folder has."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = (f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path))
        return sorted(int(n.removeprefix("bucket=")) for n in names if n.startswith("bucket="))
