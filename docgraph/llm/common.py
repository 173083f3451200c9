"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.storage import written

#: What separates words in the white-space word rule, as a Java and Python regex class.
SPACE_CLASS = "[\\x20\\x09-\\x0D]+"
#: The same six characters, for ``translate``.
SPACES = " \t\n\x0b\f\r"
#: A-Z and a-z: only these letters are folded.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of text that a Python worker turns into objects at a time.
PIECE_BYTES = 1 << 20

Batches = Iterator[pa.RecordBatch]
#: A table written once to the shared folder and read back.
materialize = written


def in_pieces(batches: Batches, column: int, most: int = PIECE_BYTES) -> Batches:
    """The batches cut so that a piece's texts (or binaries) in ``column`` have at most ``most`` bytes; a longer text is a piece of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a piece's texts; null is an empty text."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def frugal(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """``run``, giving freed memory back to the system at a task's end: workers are kept for later tasks."""

    def bounded(batches: Batches) -> Batches:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return bounded


#: Tables of up to so many bytes are broadcast.
BROADCAST_BYTES = 32 << 20


def broadcast_if_small(df: DataFrame, most: int | None = None) -> DataFrame:
    """``df``, to be broadcast if its measured rows have few bytes. It is read once more for that, so it should be written."""
    size = F.lit(0)
    for name, kind in df.dtypes:
        own = F.octet_length(name) if kind in ("string", "binary") else F.octet_length(F.to_json(F.struct(name))) if "<" in kind else F.lit(0)
        size = size + F.coalesce(own, F.lit(0)) + 16
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= (BROADCAST_BYTES if most is None else most) else df


#: A key that holds more than this share of the rows is hot; there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 2000


def join_by_key(rows: DataFrame, table: DataFrame, keys: list[str], how: str = "inner", sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``table``, which has at most one row a key, without gathering a hot key's rows.

    Rows of hot keys, of which there are fewer than 1 / HOT_SHARE, meet their
    part of the table by broadcast; the others are shuffled. ``rows`` is read
    several times, so it should be written. ``sizes`` has key_rows, those of each
    key, where that is known. Keys that are null match nothing.
    """
    if sizes is None:
        sizes = rows.groupBy(*keys).agg(F.count("*").alias("key_rows"))
    head = sizes.agg(F.max("key_rows").alias("most"), F.sum("key_rows").alias("total")).first()
    limit = max(1000.0, HOT_SHARE * (head["total"] or 0))
    if (head["most"] or 0) <= limit:
        return rows.join(table, keys, how)
    hot = materialize(sizes.where(F.col("key_rows") > limit).select(*keys), "hot-keys")
    hot = F.broadcast(hot)
    some = F.broadcast(materialize(table.join(hot, keys, "left_semi"), "hot-table"))
    return rows.join(hot, keys, "left_anti").join(table, keys, how).unionByName(rows.join(hot, keys, "left_semi").join(some, keys, how))


def fold_case(col: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(col, UPPER, LOWER)


def split_words(col: Column, separators: str) -> Column:
    """Maximal runs of characters outside ``separators``; null gives no words."""
    return F.array_remove(F.split(F.coalesce(col, F.lit("")), separators), "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row."""
    return F.transform(F.array(value), body)[0]
