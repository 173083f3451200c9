"""Name lookup and search."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions.values import last_part, lookup_names
from docgraph.storage import written


def name_lookup(symbols: DataFrame) -> DataFrame:
    """(name, anchor): a row for each name a symbol answers to."""
    return symbols.select(F.explode(lookup_names(F.col("name"))).alias("name"), "anchor").distinct()


#: Queries up to so many are broadcast to the names; more are shuffled.
BROADCAST_QUERIES = 200_000


def search_names(lookup: DataFrame, queries: DataFrame, k: int = 100) -> DataFrame:
    """(q, anchor, score, total): exact 0, prefix 1, prefix of the last part 2, substring 3; the best k of each query.

    Names and queries meet by the query's first three characters (or two, if it
    has no more), which a name that holds the query holds too. It is the queries
    that are broadcast, if they are few: names become a row a gram, of which
    Spark's estimate knows nothing. Matches are found once and written.
    """
    q = queries.select(F.lower(F.trim("q")).alias("q")).where(F.length("q") >= 2).distinct().withColumn("gram", F.substring("q", 1, 3))
    q = written(q, "queries")
    q = F.broadcast(q) if q.count() <= BROADCAST_QUERIES else q.hint("merge")
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("low") - (n - 1), F.lit(1))), lambda i: F.substring(F.col("low"), i, F.lit(n)))
    names = lookup.withColumn("low", F.lower("name")).withColumn("gram", F.explode(F.array_distinct(F.concat(grams(2), grams(3)))))
    low = F.col("low")
    met = names.join(q, "gram").where(low.contains(F.col("q")))
    score = F.when(low == F.col("q"), 0).when(low.startswith(F.col("q")), 1).when(last_part(low).startswith(F.col("q")), 2).otherwise(3)
    best = met.groupBy("q", "anchor").agg(F.min(F.struct(score.alias("score"), "name")).alias("b")).select("q", "anchor", "b.score", "b.name")
    best = written(best, "matches")
    order = W.partitionBy("q").orderBy("score", "name", "anchor")
    ranked = best.withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= k)
    return ranked.join(best.groupBy("q").agg(F.count("*").alias("total")), "q").select("q", "anchor", "score", "total")


def find_names(symbols: DataFrame, text: str) -> DataFrame:
    """(name, anchor, file) of symbols whose name holds the text, in the order of their names."""
    return symbols.where(F.lower("name").contains(text.strip().lower())).select("name", "anchor", "file").orderBy("name", "anchor")


def ambiguous_names(lookup: DataFrame) -> DataFrame:
    return lookup.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")
