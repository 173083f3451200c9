"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts come from every learnable document: each task adds up its n-grams by
language and bucket, and Spark sums the rows of all tasks. The smoothed
log-probability matrix (buckets x languages) is broadcast, in blocks of
languages where there are very many; the buckets are the same for any number.
Documents are scored in batches: the n-grams of a batch are one sparse matrix of
counts (document, bucket), which is multiplied with the matrix in numpy.

Nulls and edge cases: a text that is null or has no letter (no character of
Unicode's category L) is ``und`` with score 0; null languages are not learned
from; with nothing to learn from every document is ``und``; of equally likely
languages the first by name is taken; repeated rows each get a row; ids may be
null (their fold is that of the empty string); other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, frugal, in_pieces, materialize

#: Bits of a bucket, and languages whose log-probabilities are broadcast together (32 MB of floats).
BITS, BLOCK_LANGUAGES = 15, 256
#: Characters hashed at a time, bytes of text scored at a time, and languages whose counts a task holds.
CHUNK, SCORED_BYTES, HELD = 1 << 19, 1 << 17, 64
ALNUM = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a character is of category L: what ``\\w`` takes besides are numbers, marks and signs."""
    return any(m[0].isalpha() for m in ALNUM.finditer(text))


def buckets(text: str) -> np.ndarray:
    """Buckets of the 2- and 3-grams of a lower-cased piece of text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    two = c[:-1] * np.uint32(0x9E3779B1) + c[1:] * np.uint32(0x85EBCA77)
    three = two[:-1] * np.uint32(0xC2B2AE3D) + c[2:] * np.uint32(0x27D4EB2F)
    h = np.concatenate([two, three])
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(32 - BITS)).astype(np.intp)


def pieces(text: str) -> Iterator[str]:
    """The padded, lower-cased text in pieces that together hold each of its 3-grams once (and at most a few 2-grams twice)."""
    whole = f" {text.lower()} "
    for at in range(0, max(1, len(whole) - 2), CHUNK):
        yield whole[at : at + CHUNK + 2]


def count_grams(batches: Batches) -> Batches:
    """(lang, bucket, n) of rows of lang and text."""
    counts: dict[str, np.ndarray] = {}

    def rows() -> Batches:
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], ["lang", "bucket", "n"])
        counts.clear()

    for batch in in_pieces(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if lang not in counts:
                if len(counts) >= HELD:
                    yield from rows()
                counts[lang] = np.zeros(1 << BITS, np.int64)
            for p in pieces(text):
                counts[lang] += np.bincount(buckets(p), minlength=1 << BITS)
    yield from rows()


#: Languages, log-probabilities by bucket and language, log-priors.
Model = tuple[list[str], np.ndarray, np.ndarray]


def train(documents: DataFrame) -> Iterator[Model]:
    """The model in blocks of about BLOCK_LANGUAGES languages, from (lang, text) rows; each block reaches the driver as a packed row a language."""
    docs = documents.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    seen = materialize(docs.groupBy("lang").agg(F.count("*").alias("docs")), "languages")
    head = seen.agg(F.count("*").alias("languages"), F.sum("docs").alias("docs")).first()
    if not head["languages"]:
        return
    blocks = math.ceil(head["languages"] / BLOCK_LANGUAGES)
    block = F.pmod(F.xxhash64("lang"), F.lit(blocks))
    per = docs.mapInArrow(frugal(count_grams), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    packed = per.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("cells"))  # at most 2**BITS cells a language
    packed = materialize(packed.join(seen, "lang"), "language-grams")
    shared = None
    for k in range(blocks):
        table = packed.where(block == k).orderBy("lang").select("lang", "cells.bucket", "cells.n", "docs").toArrow().combine_chunks()
        if not table.num_rows:
            continue
        counts = np.ones((1 << BITS, table.num_rows))
        for i, (own, n) in enumerate(zip(table.column(1), table.column(2), strict=True)):
            counts[own.values.to_numpy(), i] += n.values.to_numpy()
        matrix = np.log(counts / counts.sum(axis=0))
        if shared is None:  # what is taken from all languages alike doesn't count; without what they share, sums of floats stay precise
            shared = matrix.mean(axis=1, keepdims=True)
        yield table.column(0).to_pylist(), (matrix - shared).astype(np.float32), np.log(table.column(3).to_numpy() / head["docs"])


def sums(texts: list[str], matrix: np.ndarray) -> np.ndarray:
    """For each text and language, the sum of its n-grams' log-probabilities: a sparse product, in blocks of bounded size."""
    out = np.zeros((len(texts), matrix.shape[1]))
    held: list[np.ndarray] = []
    owner: list[int] = []

    def multiply() -> None:
        sizes = np.array([len(h) for h in held])
        rows = matrix[np.concatenate(held)]
        found = np.add.reduceat(rows, np.cumsum(sizes) - sizes, axis=0)
        np.add.at(out, owner, found)
        held.clear()
        owner.clear()

    size = 0
    for i, text in enumerate(texts):
        for p in pieces(text):
            h = buckets(p)
            if len(h):
                held.append(h)
                owner.append(i)
                size += len(h)
            if size > SCORED_BYTES:
                multiply()
                size = 0
    if held:
        multiply()
    return out


def likeliest(documents: DataFrame, key: str, model: Model) -> DataFrame:
    """(key, lang, top, spread) from rows of ``key`` and text: the block's likeliest language, its log-likelihood, and the log of the sum of all beside it.

    Documents without a letter have none, and neither have any if the model is empty.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def score(batches: Batches) -> Batches:
        langs, matrix, prior = shared.value
        for batch in in_pieces(batches, 1):
            texts = batch.column(1).to_pylist()
            names = np.full(len(texts), None, object)
            top, spread = np.zeros(len(texts)), np.zeros(len(texts))
            read = [i for i, t in enumerate(texts) if langs and t is not None and has_letter(t)]
            if read:
                total = sums([texts[i] for i in read], matrix) + prior
                names[read] = [langs[b] for b in total.argmax(axis=1)]
                top[read] = total.max(axis=1)
                spread[read] = np.log(np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(top), pa.array(spread)], [key, "lang", "top", "spread"])

    return documents.select(key, "text").mapInArrow(frugal(score), f"{key} {dict(documents.select(key).dtypes)[key]}, lang string, top double, spread double")


def labelled(found: DataFrame) -> DataFrame:
    return found.select("doc.doc_id", "doc.held_out", F.coalesce("lang", F.lit(UNKNOWN)).alias("lang_pred"), F.when(F.col("lang").isNull(), 0.0).otherwise(F.exp(-F.col("spread"))).alias("score"))


def predict(documents: DataFrame, models: Iterator[Model]) -> DataFrame:
    """doc_id, held_out, lang_pred, score from rows of doc_id, held_out, text.

    One block scores the documents as they are read. With several, documents are
    written with a number, each block scores them, and the best of all blocks
    counts; what the likelihoods sum up to is put together from the blocks' sums.
    """
    own = documents.select(F.struct("doc_id", "held_out").alias("doc"), "text")
    first = next(models, ([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0)))
    second = next(models, None)
    if second is None:
        return labelled(likeliest(own, "doc", first))
    rows = materialize(own.withColumn("row", F.monotonically_increasing_id()), "language-documents")
    each = [materialize(likeliest(rows, "row", m), "language-scores") for m in chain([first, second], models)]
    best = reduce(DataFrame.unionByName, each).where("lang IS NOT NULL").groupBy("row").agg(F.collect_list(F.struct("top", "spread", "lang")).alias("all"))  # an entry a block
    top = F.array_max(F.transform("all", lambda x: x["top"]))
    name = F.array_min(F.transform(F.filter("all", lambda x: x["top"] == F.col("most")), lambda x: x["lang"]))
    total = F.log(F.aggregate("all", F.lit(0.0), lambda acc, x: acc + F.exp(x["top"] - F.col("most") + x["spread"])))
    best = best.withColumn("most", top).select("row", name.alias("lang"), total.alias("spread"))
    return labelled(rows.select("row", "doc").join(best, "row", "left"))


def identify(documents: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """Learns from the documents outside the held-out fold and labels all of them."""
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds
    docs = documents.withColumn("held_out", fold == held)
    return predict(docs, train(docs.where(~F.col("held_out"))))
