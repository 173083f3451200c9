"""Sharding by sampled splitters.

Records are ordered by a key under which equal texts are neighbours, or by a
number that the caller gives, so that an order made before stays. A sample
in which a document appears in proportion to its size gives quantile
boundaries, records are partitioned into the ranges between them, and ranges
that came out overfull are subdivided. The exact bytes of the ranges then cut
the whole order into shards of near equal bytes, so neither the sample's
error nor a hot group of copies shows in a shard.

Nulls and edge cases: a null text counts no bytes (size 16, crc32 0); null ids
are ordered first; repeated rows each get a slot; an empty table gives an
empty result; other columns of the input are ignored. Of rows that repeat one
document, which of them gets which slot isn't fixed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

SHARDS = 40
#: Ranges made from the sample: one for so many rows, at least and at most so many. About so many sampled keys for each (32 MB reach the driver at most).
ROWS_PER_RANGE, FEWEST_RANGES, MOST_RANGES, KEYS_PER_RANGE = 100_000, 2560, 65_536, 32
#: A range is overfull beyond so many times the mean number of rows, or so many rows.
OVERFULL, MOST_ROWS = 4, 500_000
RECORD_BYTES = 16
#: Low bits of the order key that tell the copies of a text apart.
COPY_BITS = 20


def keyed(documents: DataFrame, keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32 and the order key: the column ``order``, or the text's hash, then bits of the document's."""
    text = F.coalesce("text", F.lit(""))
    low = F.lit((1 << COPY_BITS) - 1).cast("long")
    copy = F.xxhash64("doc_id", F.lit("copy"))
    key = F.col(order).cast("long") if order else F.xxhash64(text).bitwiseAND(F.bitwise_not(low)).bitwiseOR(copy.bitwiseAND(low))
    return documents.select(
        "doc_id",
        (F.octet_length(text) + RECORD_BYTES).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        key.alias("key"),
        copy.alias("copy"), *keep,
    )


def splitters(records: DataFrame, total: int, ranges: int, per_range: int) -> np.ndarray:
    """Quantile boundaries of a size-weighted key sample.

    A record is drawn with probability size / total * keys (certainly, if that
    exceeds 1), decided by a hash, so reruns draw the same sample.
    """
    keys = ranges * per_range
    chance = F.pmod(F.xxhash64("doc_id", "key", F.lit("sample")), F.lit(1 << 40)) / F.lit(float(1 << 40))
    expected = F.col("size") * F.lit(keys / max(total, 1))
    drawn = records.where(chance < expected).select("key", F.greatest(F.lit(1.0), expected).alias("w")).toPandas().sort_values("key")
    if drawn.empty:
        return np.empty(0, np.int64)
    line = drawn["w"].cumsum().to_numpy()
    at = np.searchsorted(line, np.arange(1, ranges) * (line[-1] / ranges))
    return np.unique(drawn["key"].to_numpy()[np.minimum(at, len(drawn) - 1)])


def assign(documents: DataFrame, shards: int = SHARDS, ranges: int | None = None, per_range: int = KEYS_PER_RANGE, keep: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot (gapless in the shard), range, part, copy_part, and the columns ``keep`` as they are.

    With ``order``, a column of distinct whole numbers, shards and slots follow it.
    """
    spark = documents.sparkSession
    records = materialize(keyed(documents, keep, order), "shard-records")
    head = records.agg(F.count("*").alias("rows"), F.sum("size").alias("total")).first()
    rows, total = head["rows"], int(head["total"] or 0)
    ranges = ranges or max(FEWEST_RANGES, min(MOST_RANGES, rows // ROWS_PER_RANGE))
    cuts = spark.sparkContext.broadcast(splitters(records, total, ranges, per_range))

    @F.pandas_udf("int")
    def range_of(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(cuts.value, key.to_numpy(), side="right").astype(np.int32))

    ranged = materialize(records.withColumn("range", range_of("key")), "shard-ranges")
    cuts.destroy()
    most = min(MOST_ROWS, max(1000, OVERFULL * rows // ranges))
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).withColumn("parts", F.ceil(F.col("n") / most).cast("int"))
    # within an overfull range the parts follow the copy hash, so that even one text's copies are spread, or a given order
    along = F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low") + 1.0) * F.col("parts"))
    placed = ranged.join(F.broadcast(sizes), "range").withColumn(
        "part", F.when(F.col("parts") > 1, along if order else F.pmod("copy", F.col("parts"))).otherwise(F.lit(0)).cast("int")
    ).drop("low", "high")
    # rows that repeat one document have one key and one copy hash; they are interchangeable, so any number parts them
    hot = placed.where("parts > 1").groupBy("key", "copy").agg(F.count("*").alias("same")).where(F.col("same") > most // 2)
    hot = materialize(hot.select("key", "copy", F.ceil(F.col("same") / most + 1).cast("int").alias("copy_parts")), "shard-copies")
    if hot.limit(1).count():
        placed = placed.withColumn("any", F.monotonically_increasing_id()).join(hot, ["key", "copy"], "left")
        placed = placed.withColumn("copy_part", F.coalesce(1 + F.pmod("any", F.col("copy_parts")), F.lit(0)).cast("int")).drop("any", "copy_parts")
        placed = materialize(placed, "shard-parts")
    else:
        placed = placed.withColumn("copy_part", F.lit(0))
    piece = ["range", "part", "copy_part"]
    sums = placed.groupBy(*piece).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy(*piece).rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(  # a row a range and part
        *piece, F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("byte0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("row0"),
    )
    within = W.partitionBy(*piece).orderBy("key", "doc_id", "text_crc32", "size")
    ordered = (
        placed.withColumn("nr", F.row_number().over(within))
        .withColumn("upto", F.sum("size").over(within.rowsBetween(W.unboundedPreceding, 0)))
        .join(F.broadcast(sums), piece)
        .withColumn("row", F.col("row0") + F.col("nr") - 1)
        # a document goes where its middle lies
        .withColumn("middle", F.col("byte0") + F.col("upto") - F.col("size") / 2)
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(F.col("middle") * F.lit(shards / max(total, 1))).cast("int")))
    )
    ordered = materialize(ordered.select("doc_id", "size", "text_crc32", "shard", "row", *piece, *keep), "shard-order")
    first = ordered.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    return ordered.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"), *piece, *keep
    )


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The documents themselves, a folder a shard; its files follow each other by slot, and so do a file's rows."""
    own = documents.columns
    docs = materialize(documents.withColumn("record", F.monotonically_increasing_id()), "shard-documents")
    where = assign(docs, shards, keep=("record",)).select("record", "shard", "slot")
    docs.join(where, "record").select(*own, "shard", "slot").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
