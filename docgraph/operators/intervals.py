"""Interval and as-of joins: which definition encloses or precedes an occurrence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def attribute_calls(occ: DataFrame, defs: DataFrame, block: int = 256) -> DataFrame:
    """Each occurrence (file, line, ref) with the innermost definition (file, start, end, symbol) around it.

    What encloses a line is found once for all occurrences on it. Lines and
    definitions meet by file and block of lines, a definition repeated for the
    blocks it spans, so only nearby pairs are made, at most ``block`` lines with
    the definitions of a block. Equal spans: the later start, then the symbol.
    """
    d = defs.select("file", "start", "end", "symbol", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("end") / block))).alias("block"))
    lines = occ.select("file", "line").distinct().withColumn("block", F.floor(F.col("line") / block))
    met = lines.join(d, ["file", "block"]).where(F.col("line").between(F.col("start"), F.col("end")))
    best = F.min_by("symbol", F.struct(F.col("end") - F.col("start"), -F.col("start"), "symbol"))
    around = met.groupBy("file", "line").agg(best.alias("symbol"))
    return occ.select("file", "line", "ref").distinct().join(around, ["file", "line"]).where(F.col("symbol") != F.col("ref"))


def attribute_calls_asof(occ: DataFrame, defs: DataFrame, block: int = 256) -> DataFrame:
    """Each occurrence with the last definition that starts at or before its line: a union and a running last, no product.

    The running last is taken within blocks of lines; what a block begins with is
    carried over from the blocks before it, a row a block.
    """
    at = lambda c: F.floor(F.col(c) / block).alias("block")
    d = defs.select("file", at("start"), F.col("start").alias("line"), "symbol")
    o = occ.select("file", at("line"), "line", "ref")
    ends = d.groupBy("file", "block").agg(F.max(F.struct("line", "symbol"))["symbol"].alias("symbol"))
    asked = o.select("file", "block").distinct().withColumn("symbol", F.lit(None).cast("string"))
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.unionByName(asked).groupBy("file", "block").agg(F.max("symbol").alias("symbol"))
    carried = carried.select("file", "block", F.last("symbol", ignorenulls=True).over(before).alias("symbol")).where("symbol IS NOT NULL")
    row = lambda df, line, ref, symbol, turn: df.select("file", "block", line.alias("line"), ref.alias("ref"), symbol.alias("symbol"), F.lit(turn).alias("turn"))
    none = F.lit(None).cast("string")
    both = row(o, F.col("line"), F.col("ref"), none, 2).unionByName(row(d, F.col("line"), none, F.col("symbol"), 1))
    both = both.unionByName(row(carried, F.col("block") * block, none, F.col("symbol"), 0))
    w = W.partitionBy("file", "block").orderBy("line", "turn", "symbol").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("symbol", F.last("symbol", ignorenulls=True).over(w)).where("turn = 2 AND symbol IS NOT NULL").drop("turn", "block")


def remap_lines(occ: DataFrame, line_map: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Occurrences in generated files moved to (orig_file, orig_line); those of unmapped lines go.

    With ``regions`` (file, start, end, symbol), ``symbol`` is that of the region
    the new line lies in: what stands outside of every definition there.
    """
    moved = occ.join(line_map, ["file", "line"]).select(F.col("orig_file").alias("file"), F.col("orig_line").alias("line"), "ref")
    if regions is None:
        return moved
    found = attribute_calls(moved.distinct(), regions).select("file", "line", "ref", "symbol")
    return moved.join(found, ["file", "line", "ref"], "left")
