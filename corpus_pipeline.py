"""A training corpus from ``documents``: quality, near copies, benchmark passages, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; its result is written as Parquet and read again as the next one's docs.

Nulls and edge cases, in every stage: a row is a document of its own, whatever
its id; null ids, texts, languages and sources stay null; a null text counts as
an empty one; repeated rows are kept or dropped together, but for what each
stage says; an empty table gives an empty result; columns besides those of
``COLUMNS`` are carried along by all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.llm import decontaminate, minhash, mixing, quality_cnn, sharding
from docgraph.llm.common import broadcast_if_small, materialize, table
from docgraph.storage import shared_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id isn't in ``ids``."""
    return docs.join(broadcast_if_small(materialize(ids, "pipeline-gone")), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network rejects go; no text is moved, as the score is made beside the row. A score of exactly 0.5 stays; without labels all do."""
    return quality_cnn.kept(docs, table(spark, sf_dir, "labels")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, that of the least id: five-word shingles, similarity 0.8.

    Rows that share an id are one document and stand or fall together; rows
    without an id or without words stay.
    """
    gone = minhash.near_duplicates(docs, words=5).where(~F.col("kept")).select("doc_id").distinct()
    return without(docs, gone)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share a window of words with a benchmark item go, each by its own text where an id has several."""
    hits = decontaminate.occurrences(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")).distinct()
    hits = broadcast_if_small(materialize(hits, "pipeline-hits"))
    return docs.join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("t")), "left_anti")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A record for each passage of the mix through a document, in the order of the schedule's slots; documents that it doesn't read go.

    A passage that the schedule breaks off is a whole record. Rows are numbered
    first, as an id may be null or repeated.
    """
    own = docs.columns
    docs = materialize(docs.withColumn("record", F.monotonically_increasing_id()), "pipeline-records")
    placed, readings = mixing.plan(docs, keep=("record",))
    slots = materialize(readings.join(placed.select("row", "record"), "row").select("record", "slot"), "pipeline-slots")
    return docs.join(broadcast_if_small(slots), "record").repartitionByRange("slot").sortWithinPartitions("slot").select(*own)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each record of the mix goes: shard and slot, in the order in which the mix's files are read, so that copies lie as far apart as the mix has put them."""
    docs = materialize(docs.withColumn("record", F.monotonically_increasing_id()), "pipeline-mix")
    return sharding.assign(docs, order="record")


STAGES = [
    ("quality classifier", quality),
    ("minhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources", mixed),
    ("sharding", sharded),
]

#: SQL can't express the classifier; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
