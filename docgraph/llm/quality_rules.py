"""Quality rules: base heuristics and a hashed n-gram log-likelihood ratio.

Word unigrams and bigrams are hashed into buckets. Two multinomials over the
buckets are counted from all documents: the trusted target (documents labelled
good and not toxic) and the raw corpus (every document). A document's score is
the mean over its n-grams of log p_target - log p_raw; it is kept if the base
rules pass and the score reaches a fixed threshold: no sampling, no noise.

Everything is DataFrame code: no Python, pandas or RDD work on rows.

Nulls and edge cases: a null or empty text has no words and fails the base
rules; repeated rows each get a row; ids may be null; an empty corpus or no
trusted document leaves smoothed, uniform multinomials; repeated or
conflicting label rows count once (trusted only if never marked bad or toxic);
other columns of the inputs are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, SPACES, let, materialize, split_words

BUCKETS = 1 << 14
#: Documents whose mean log-likelihood ratio is lower are rejected.
THRESHOLD = -0.15
#: Up to so many trusted ids are broadcast (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
MIN_WORDS, REPEAT_WINDOW, REPEAT_PERCENT = 20, 8, 30
SYMBOLS = "#*$%&|<>"


def chained(hashes: Column, shift: int) -> Column:
    """hash(x[i], x[i + shift]) at every i; the last ``shift`` entries mean nothing."""
    return F.zip_with(hashes, F.slice(hashes, F.lit(shift + 1), F.greatest(F.size(hashes), F.lit(1))), lambda a, b: F.xxhash64(a, b))


def leading(array: Column, n: Column) -> Column:
    return F.slice(array, F.lit(1), F.greatest(n, F.lit(0)))


def covered_by_repeats(windows: Column, width: int) -> Column:
    """Positions inside windows whose hash the array holds twice or more."""

    def positions(s: Column) -> Column:
        same = lambda x, at: F.coalesce(F.get(s, at)["h"] == x["h"], F.lit(False))
        hit = F.transform(s, lambda x, i: F.when(same(x, i - 1) | same(x, i + 1), x["i"]))
        return F.array_sort(F.array_compact(hit))

    by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    cover = F.aggregate(
        let(by_hash, positions),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + p + F.lit(width) - F.greatest(a["end"], p)).alias("n"), (p + F.lit(width)).alias("end")),
        lambda a: a["n"],
    )
    return F.when(F.size(F.array_distinct(windows)) < F.size(windows), cover).otherwise(F.lit(0))


def hashed(documents: DataFrame, *keep: str) -> DataFrame:
    """Adds ``words``' hashes ``uni`` and the hashes ``bi`` of neighbours (its last entry means nothing)."""
    words = documents.select(*keep, split_words(F.col("text"), SPACE_CLASS).alias("words"))
    uni = words.select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("uni"))
    return uni.select(*keep, "uni", chained(F.col("uni"), 1).alias("bi"))


def log_ratios(documents: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> list[float]:
    """log p_target - log p_raw per bucket, from all documents: a table of ``buckets`` numbers."""
    trusted = materialize(
        labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
        .where("q = 1 AND t = 0").select("doc_id", F.lit(1).alias("trusted")),
        "rules-trusted",
    )
    if trusted.count() <= BROADCAST_IDS:
        trusted = F.broadcast(trusted)
    marked = documents.select("doc_id", "text").join(trusted, "doc_id", "left")
    grams = hashed(marked, "trusted")
    mask = F.lit(buckets - 1).cast("long")
    both = F.concat("uni", leading(F.col("bi"), F.size("uni") - 1))
    counts = (
        grams.select("trusted", F.explode(both).alias("h"))
        .groupBy(F.col("h").bitwiseAND(mask).cast("int").alias("bucket"))
        .agg(F.count("*").alias("raw"), F.count("trusted").alias("target"))
        .collect()
    )
    raw, target = [1] * buckets, [1] * buckets
    for r in counts:
        raw[r["bucket"]] += r["raw"]
        target[r["bucket"]] += r["target"]
    shift = math.log(sum(raw)) - math.log(sum(target))
    return [math.log(t) - math.log(r) + shift for t, r in zip(target, raw, strict=True)]


def score(documents: DataFrame, ratios: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, the base figures, base_failed, llr, kept."""
    model = F.split(F.lit(",".join(f"{x:.6f}" for x in ratios)), ",").cast("array<double>")
    mask = F.lit(len(ratios) - 1).cast("long")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    figures = documents.select(
        "doc_id", F.length(F.translate(text, SPACES, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        "text",
    )
    base = ["doc_id", "word_chars", "n_symbols", "n_dup_lines"]
    n = F.size("uni")
    grams = hashed(figures, *base).select(*base, "uni", "bi", chained(F.col("bi"), 2).alias("four"))
    grams = grams.select(*base, "uni", "bi", leading(chained(F.col("four"), 4), n - (REPEAT_WINDOW - 1)).alias("windows"))
    summed = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, h: acc + F.get(model, h.bitwiseAND(mask).cast("int")))
    total = summed(F.col("uni")) + summed(leading(F.col("bi"), n - 1))
    scored = grams.select(
        *base, n.cast("long").alias("n_words"), covered_by_repeats(F.col("windows"), REPEAT_WINDOW).cast("long").alias("n_repeat_words"),
        F.when(n > 0, total / (2 * n - 1)).otherwise(F.lit(0.0)).alias("llr"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "llr",
        (~failed & (F.col("llr") >= threshold)).alias("kept"),
    )


def judge(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(documents, log_ratios(documents, labels), threshold)
