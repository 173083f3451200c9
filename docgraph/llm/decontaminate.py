"""Benchmark decontamination by winnowing.

Both sides are cut into words and hashed as 4-grams; of every 7 consecutive
4-grams, that is of every window of 10 words, the least hash is kept. Two equal
windows keep the same hash, so a join of the benchmark's kept hashes with the
documents' finds every document that shares a span of 10 words or more. Hits
are extended to all windows of their document and compared in full, so a
collision never counts. Items shorter than a window are found by their first
word instead.

Everything is DataFrame code: no Python, pandas or RDD work on rows.

Nulls and edge cases: a null text has no words; a null item_id marks words but
is no item of the list; repeated item rows count once; repeated documents each
get a row; an empty benchmark hits nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fold_case, materialize, split_words
from .quality_rules import chained, leading

#: What separates words once A-Z are folded, and before.
FOLDED_CLASS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
RAW_CLASS = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
WINDOW = 10


def words_of(text: Column) -> Column:
    ascii_only = F.length(text) == F.octet_length(text)  # there lower() folds A-Z and nothing else, and faster
    return split_words(F.when(ascii_only, F.lower(text)).otherwise(fold_case(text)), FOLDED_CLASS)


def window_minima(df: DataFrame, *keep: str) -> DataFrame:
    """keep, words and ``minima``: for every window of 10 ``words``, the least of its 4-gram hashes."""

    def least(c: str, shift: int) -> Column:
        return F.zip_with(c, F.slice(c, F.lit(shift + 1), F.greatest(F.size(c), F.lit(1))), lambda a, b: F.least(a, b))

    d = df.select(*keep, "words", F.transform("words", lambda w: F.xxhash64(w)).alias("h1"))
    d = d.select(*keep, "words", chained(F.col("h1"), 1).alias("h2"))
    d = d.select(*keep, "words", chained(F.col("h2"), 2).alias("h4"))
    d = d.select(*keep, "words", least("h4", 1).alias("m2"))
    d = d.select(*keep, "words", least("m2", 2).alias("m4"))
    return d.select(*keep, "words", leading(least("m4", 3), F.size("words") - (WINDOW - 1)).alias("minima"))


def span(words: Column, at: Column, n: Column | int) -> Column:
    """The text of ``n`` words from index ``at``."""
    return F.array_join(F.slice(words, at + 1, F.lit(n) if isinstance(n, int) else n), " ")


def benchmark_windows(benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(span, len, item_id) of all windows; the kept hashes; (first, len) of items shorter than a window."""
    items = benchmark.select("item_id", words_of(F.col("text")).alias("words"))
    long = window_minima(items, "item_id").select("item_id", "words", F.posexplode("minima").alias("at", "fp"))
    long = long.select("item_id", span(F.col("words"), F.col("at"), WINDOW).alias("span"), F.lit(WINDOW).alias("len"), "fp", F.lit(None).cast("string").alias("first"))
    n = F.size("words")
    short = items.where((n > 0) & (n < WINDOW)).select(
        "item_id", span(F.col("words"), F.lit(0), n).alias("span"), n.alias("len"), F.lit(None).cast("long").alias("fp"), F.col("words")[0].alias("first")
    )
    every = materialize(long.unionByName(short).distinct(), "bench-windows")
    return (
        every.select("span", "len", "item_id"),
        every.where("fp IS NOT NULL").select("fp").distinct(),
        every.where("first IS NOT NULL").select("first", "len").distinct(),
    )


def candidates(docs: DataFrame, kept: DataFrame, short: DataFrame) -> DataFrame:
    """(d, t): the documents that share a kept hash, or a short item's first word."""
    key = ["doc_id", "text_hash"]
    cut = docs.select(*key, words_of(F.col("text")).alias("words"))
    hashes = window_minima(cut, *key).select(*key, F.explode(F.array_distinct("minima")).alias("fp"))
    found = hashes.join(broadcast_if_small(kept), "fp", "left_semi").select(*key)
    if short.limit(1).count():
        firsts = cut.select(*key, F.explode(F.array_distinct("words")).alias("first"))
        found = found.unionByName(firsts.join(broadcast_if_small(short.select("first").distinct()), "first", "left_semi").select(*key))
    return materialize(found.distinct().select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t")), "bench-candidates")


def occurrences(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, at, len, item_id): every place where an item's window occurs."""
    spans, kept, short = benchmark_windows(benchmark)
    key = ["doc_id", "text_hash"]
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    some = broadcast_if_small(candidates(docs, kept, short))
    docs = docs.join(some, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left_semi")
    cut = docs.select(*key, words_of(F.col("text")).alias("words"))
    spans = broadcast_if_small(spans)

    def windows(n: int) -> DataFrame:
        starts = F.sequence(F.lit(0), F.size("words") - n)
        return cut.where(F.size("words") >= n).select(
            *key, F.lit(n).alias("len"), F.explode(F.transform(starts, lambda i: F.struct(i.alias("at"), span(F.col("words"), i, n).alias("span")))).alias("w")
        ).select(*key, "len", "w.at", "w.span")

    found = windows(WINDOW)
    for (n,) in short.select("len").distinct().collect():  # lengths 1 to 9
        found = found.unionByName(windows(n))
    return found.join(spans, ["span", "len"]).select(*key, "at", "len", "item_id")


def contamination(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marks = occurrences(documents, benchmark).groupBy("doc_id", "text_hash").agg(
        F.collect_set(F.struct("at", "len")).alias("hits"), F.collect_set(F.col("item_id").cast("string")).alias("items")
    )
    cover = F.aggregate(
        F.sort_array("hits"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, h: F.struct(
            (a["n"] + F.greatest(F.lit(0), h["at"] + h["len"] - F.greatest(a["end"], h["at"]))).alias("n"),
            F.greatest(a["end"], h["at"] + h["len"]).alias("end"),
        ),
        lambda a: a["n"],
    )
    marks = marks.select(
        F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), cover.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    )
    docs = documents.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(split_words(F.col("text"), RAW_CLASS)).cast("long").alias("n_words"))
    joined = docs.join(marks, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
