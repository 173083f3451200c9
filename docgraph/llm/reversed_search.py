"""Ranked lexical search with the sides swapped: documents stream through an index of the queries.

The items (queries) are few, so their terms make the inverted index, which is
broadcast in blocks of bounded size. A first pass cuts every document once and
keeps the counts of the items' terms; from these come the numbers of documents,
terms and documents by term, over all documents. A second pass sends the counts
through the index and keeps a heap of the best documents for each item and task;
the heaps are merged in two levels.

Nulls and edge cases: a null or empty text has no terms, so such a document is
in no statistic and no result, and such an item has no rows. Rows are documents
and items of their own: repeated ones are counted, found and answered each time.
A null doc_id comes after all others of its score, a null item_id is an item
like any other. Without terms anywhere there are no rows. Other columns, of any
name, are ignored. Texts of any length are cut in pieces; one term is held whole.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, UPPER, Batches, frugal, in_pieces, materialize, texts_of

#: Bytes of item text in an index; more items make more blocks, each a pass over the documents.
ITEM_BYTES = 8 << 20
#: Scores held at a time by a task: documents of a step times items of the block.
CELLS = 1 << 20
#: Bytes of a document whose terms are objects at a time.
CUT_BYTES = 1 << 18

#: Bytes that end a term become spaces, A-Z become a-z; bytes of longer code points are part of terms.
FOLD = bytes(
    ord(LOWER[UPPER.index(chr(b))]) if chr(b) in UPPER else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)
)

COUNTS = "doc_id long, n long, terms array<int>, counts array<int>"
FOUND = "item_no long, item_id long, doc_id long, score long"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time."""
    folded, at = text.translate(FOLD), 0
    while at < len(folded):
        to = folded.find(b" ", at + CUT_BYTES)
        to = len(folded) if to < 0 else to
        yield folded[at:to].split()
        at = to


class Index:
    """The items' terms: a number for each, and the items that hold it (positions ``items[start[t]:start[t + 1]]``)."""

    def __init__(self, rows: list) -> None:
        self.number: dict[bytes, int] = {}
        self.item_no = [r["item_no"] for r in rows]
        self.item_id = [r["item_id"] for r in rows]
        holders: list[list[int]] = []
        for i, r in enumerate(rows):
            for part in terms_of((r["text"] or "").encode()):
                for term in part:
                    t = self.number.setdefault(term, len(holders))
                    if t == len(holders):
                        holders.append([])
                    if holders[t][-1:] != [i]:
                        holders[t].append(i)
        self.start = np.cumsum([0, *map(len, holders)], dtype=np.int64)
        self.items = np.fromiter((i for own in holders for i in own), np.int64, int(self.start[-1]))


def _counts(docs: DataFrame, number) -> DataFrame:
    """COUNTS: a document's number of terms, and its counts of the index's terms."""

    def run(batches: Batches) -> Batches:
        get = number.value.get
        for piece in in_pieces(batches, 1):
            sizes, terms, counts = [], [], []
            for text in texts_of(piece.column(1)):
                n, hits = 0, []
                for part in terms_of(text):
                    n += len(part)
                    hits += [t for t in map(get, part) if t is not None]
                t, c = np.unique(np.array(hits, np.int32), return_counts=True)
                sizes.append(n)
                terms.append(t)
                counts.append(c.astype(np.int32))
            ends = pa.array(np.cumsum([0, *map(len, terms)], dtype=np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (terms, counts)]
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(frugal(run), COUNTS)


def lengths_of(n: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """10 + (90 * n * documents) div all_terms, exact also where the product has over 63 bits."""
    if 90 * int(n.max(initial=0)) * documents < 1 << 63:
        return 10 + 90 * n * documents // all_terms
    return np.array([10 + 90 * int(x) * documents // all_terms for x in n], np.int64)


def _best(counted: DataFrame, index, weights: np.ndarray, documents: int, all_terms: int, k: int) -> DataFrame:
    """FOUND: for each task and item the k best documents of the task."""

    def run(batches: Batches) -> Batches:
        own = index.value
        heaps: list[list[tuple[int, int, int]]] = [[] for _ in own.item_no]
        least = np.ones(len(heaps), np.int64)  # a score below is in no heap
        step = max(1, CELLS // max(1, len(heaps)))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                ids, n, terms, counts = (part.column(c) for c in range(4))
                held = terms.value_lengths().to_numpy(zero_copy_only=False)
                row = np.repeat(np.arange(part.num_rows), held)
                t, tf = terms.flatten().to_numpy().astype(np.int64), counts.flatten().to_numpy().astype(np.int64)
                m = lengths_of(n.to_numpy(zero_copy_only=False), documents, all_terms)
                gain = weights[t] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                fan = own.start[t + 1] - own.start[t]
                inside = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan)
                item = own.items[np.repeat(own.start[t], fan) + inside]
                scores = np.zeros((part.num_rows, len(heaps)), np.int64)
                np.add.at(scores.reshape(-1), np.repeat(row, fan) * len(heaps) + item, np.repeat(gain, fan))
                doc = ids.to_pylist()
                for r, i in zip(*(x.tolist() for x in np.nonzero(scores >= least)), strict=True):
                    entry = (int(scores[r, i]), doc[r] is not None, -(doc[r] or 0))  # the smallest of a heap is its worst
                    if len(heaps[i]) < k:
                        heapq.heappush(heaps[i], entry)
                    else:
                        heapq.heappushpop(heaps[i], entry)
                    if len(heaps[i]) == k:
                        least[i] = heaps[i][0][0]
        out = [(own.item_no[i], own.item_id[i], -d if known else None, s) for i, heap in enumerate(heaps) for s, known, d in heap]
        kinds = (("item_no", pa.int64()), ("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], kind) for c, (_, kind) in enumerate(kinds)], names=[name for name, _ in kinds])

    return counted.where("size(terms) > 0").mapInArrow(frugal(run), FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The heaps of all tasks merged: first in 64 groups of tasks, then all of an item."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    nr = F.row_number().over(W.partitionBy("item_no", "part").orderBy(*order))
    some = found.withColumn("part", F.spark_partition_id() % 64).withColumn("nr", nr).where(F.col("nr") <= k)
    rank = F.row_number().over(W.partitionBy("item_no").orderBy(*order)).cast("int")
    return some.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 10, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's (item_id, text) k best documents (doc_id, text) of score above 0; ids are whole numbers.

    A term's weight is floor(1000 ln((2N + 2) / (2 df + 1))), a document's share
    of it (10^9 tf) div (1000 tf + 8 m) with m = 10 + (90 n N) div L.
    """
    spark = docs.sparkSession
    rows = materialize(items.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn("item_no", F.monotonically_increasing_id()), "search-items")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, out = max(1, math.ceil(size / item_bytes)), None
    for b in range(blocks):
        index = Index(rows.where(F.pmod(F.xxhash64("item_no"), F.lit(blocks)) == b).collect())  # about item_bytes of text
        counted = materialize(_counts(docs, spark.sparkContext.broadcast(index.number)), "search-counts")
        total = counted.agg(F.sum((F.col("n") > 0).cast("long")).alias("documents"), F.sum("n").alias("terms")).first()
        documents, all_terms = total["documents"] or 0, total["terms"] or 0
        held = counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()  # a row a term of the index
        weights = np.zeros(len(index.number), np.int64)
        for r in held:
            weights[r["t"]] = math.floor(1000 * math.log((2 * documents + 2) / (2 * r["df"] + 1)))
        found = _merged(_best(counted, spark.sparkContext.broadcast(index), weights, documents, max(1, all_terms), k), k)
        out = found if out is None else out.unionByName(found)
    return out
