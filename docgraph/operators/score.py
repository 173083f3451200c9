"""Scores of generated documents and summaries of diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docgraph.functions.values import error_category


def unfenced(text: Column) -> Column:
    """An output without the stray code fence around all of it."""
    return F.regexp_replace(F.regexp_replace(text, r"\A\s*```[^\n]*\n", ""), r"\n```\s*\z", "")


def score_outputs(runs: DataFrame) -> DataFrame:
    """Per model and condition: percent clean, with every expected text, and both; from rows of model, condition, text, clean, expect."""
    body = unfenced(F.col("text"))
    feature = F.forall("expect", lambda x: F.contains(body, x))
    percent = lambda c: 100.0 * F.avg(F.when(c, 1.0).otherwise(0.0))
    return runs.groupBy("model", "condition").agg(
        percent(F.col("clean")).alias("clean"), percent(feature).alias("feature"), percent(F.col("clean") & feature).alias("both_ok"), F.count("*").alias("n")
    )


def score_runs(runs: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """As ``score_outputs``, with the number of warnings, from runs (run, model, condition, text, expect, threw) and their diagnostics (run, severity, message).

    A run is clean if it has no error and didn't break its reader (``threw``);
    without expected texts every run has them.
    """
    kind = lambda k: F.sum((F.col("severity") == k).cast("long"))
    found = diagnostics.groupBy("run").agg(kind("error").alias("errors"), kind("warning").alias("warnings"))
    met = runs.join(found, "run", "left").withColumn("clean", ~F.coalesce("threw", F.lit(False)) & (F.coalesce("errors", F.lit(0)) == 0))
    met = met.withColumn("expect", F.coalesce("expect", F.array().cast("array<string>")))
    warned = met.groupBy("model", "condition").agg(F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    same = lambda k: F.col(k).eqNullSafe(F.col(f"w_{k}"))
    warned = warned.withColumnsRenamed({"model": "w_model", "condition": "w_condition"})
    return score_outputs(met).join(warned, same("model") & same("condition")).drop("w_model", "w_condition")


def error_histogram(diagnostics: DataFrame) -> DataFrame:
    """(category, n) of the errors of all runs, most frequent first."""
    n = diagnostics.where("severity = 'error'").groupBy(error_category(F.col("message")).alias("category")).agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "category")


def diagnostic_summary(diagnostics: DataFrame) -> DataFrame:
    """Counts by document and severity with the totals of each and of all."""
    return diagnostics.groupingSets([["doc", "severity"], ["doc"], ["severity"], []], "doc", "severity").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))
