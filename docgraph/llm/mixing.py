"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of equally many tokens. Slot k draws the
golden-ratio point frac(k * 0.618...), the cumulative target weights turn the
point into a source, and the slot's rank within its source names the block of
that source's shuffled token line which the mix reads there. The line is read
again from its start when it ends, so a source can be repeated. What a document
gives is what the slots drawn for its source cover of it, no more and no less;
so a source's sum differs from its target by the few slots that the points'
discrepancy allows.

Everything is DataFrame code: no Python, pandas or RDD work on rows.

Nulls and edge cases: a null text has size 0; a null source is a source of its
own, ordered last; documents of size 0 are returned with 0 taken; an empty
table gives an empty result; repeated rows each get a row (identical rows are
interchangeable); other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import SPACE_CLASS, materialize, split_words

GOLDEN = 0.6180339887498949
#: Largest number of tokens in a slot, and the least number of slots a source has on average.
BLOCK_TOKENS, SLOTS_PER_SOURCE = 1 << 20, 4096
#: Times that a source may be read.
MAX_EPOCHS = 3
#: Documents of a bucket, and buckets whose sums are added up together.
ROWS_PER_BUCKET, BUCKETS_PER_RUN = 2048, 4096
#: Slots whose ranks are counted together.
SLOTS_PER_RUN = 65536
#: Pieces of the unit interval by which points and source intervals meet in an equi-join.
BINS = 1024


def word_count(text: Column) -> Column:
    return F.size(split_words(text, SPACE_CLASS)).cast("long")


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: its weight 1, 2, 3, 1, ... by code point order (null last) and its target.

    ``sizes`` has source and source_size. The targets share the total by
    weight; none exceeds ``max_epochs`` times its source, and what the capped
    ones leave is shared again. With the sources in order of cap / weight the
    capped ones are a prefix, so the level comes from running sums.
    One row a source: this dimension alone is ordered in one task.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    capped = W.orderBy("level", "nr")
    before = capped.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    t = (
        sizes.withColumn("nr", F.row_number().over(by_name))
        .withColumn("weight", ((F.col("nr") - 1) % 3 + 1).cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("level", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("share", (F.col("total") - F.col("cap_before")) / (F.col("weights") - F.col("weight_before")))
        # the first source whose cap holds the level fixes it for all later ones
        .withColumn("open", F.col("level") >= F.col("share"))
        .withColumn("final", F.min(F.when(F.col("open"), F.struct("level", "nr", "share"))).over(everything)["share"])
    )
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final") * F.col("weight")))
    return t.select("nr", "source", "source_size", "weight", target.alias("target"))


def schedule(target: DataFrame, total: int, block: int) -> DataFrame:
    """(slot, nr, rank): what each slot of the mix reads.

    A source that has been read as often as it may be gives nothing to its
    further slots, so they are left out.
    """
    spark = target.sparkSession
    slots = -(-total // block) if total else 0
    by_nr = W.orderBy("nr")
    lines = (
        target.where("target > 0")
        .withColumn("end", F.sum("target").over(by_nr.rowsBetween(W.unboundedPreceding, 0)) / F.lit(float(max(total, 1))))
        .withColumn("lo", F.coalesce(F.lag("end").over(by_nr), F.lit(0.0)))
        .withColumn("hi", F.when(F.lead("nr").over(by_nr).isNull(), 1.0).otherwise(F.col("end")))  # rounding leaves no gap at the end
    )
    spans = lines.select("nr", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * BINS).cast("int"), F.floor(F.col("hi") * BINS).cast("int"))).alias("bin"))
    points = spark.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") * F.lit(GOLDEN)) % F.lit(1.0)).alias("u")
    ).withColumn("bin", F.floor(F.col("u") * BINS).cast("int"))
    drawn = points.join(spans, "bin").where("u >= lo AND u < hi").select("slot", "nr", F.floor(F.col("slot") / SLOTS_PER_RUN).alias("run"))
    # rank within the source, by runs of slots, so that a large source isn't ranked in one task
    starts = (
        drawn.groupBy("nr", "run").agg(F.count("*").alias("n"))
        .withColumn("first", F.sum("n").over(W.partitionBy("nr").orderBy("run")) - F.col("n"))
    )
    return (
        drawn.withColumn("at", F.row_number().over(W.partitionBy("nr", "run").orderBy("slot")) - 1)
        .join(starts.select("nr", "run", "first"), ["nr", "run"])
        .select("slot", "nr", (F.col("first") + F.col("at")).alias("rank"))
    )


def lay_out(docs: DataFrame, rows: int) -> DataFrame:
    """Adds ``start``: the document's place on its source's shuffled token line.

    The order is that of a hash of the document, in buckets of few rows whose
    sums are added up first by runs of buckets. Only rows that repeat one
    document overfill a bucket; these are interchangeable and dealt to parts.
    """
    buckets = max(1, -(-rows // ROWS_PER_BUCKET))
    docs = docs.withColumn("bucket", F.pmod("mix", F.lit(buckets))).withColumn("part", F.lit(0))
    full = docs.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > 2 * ROWS_PER_BUCKET).select("bucket")
    copies = docs.join(full, "bucket", "left_semi").groupBy("mix").agg(F.count("*").alias("n")).where(F.col("n") > ROWS_PER_BUCKET)
    copies = materialize(copies.select("mix", F.ceil(F.col("n") / ROWS_PER_BUCKET).alias("parts")), "mix-copies")
    if copies.limit(1).count():
        docs = docs.join(copies, "mix", "left").withColumn("part", F.coalesce(1 + F.pmod("row", F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    at = ["source", "run", "bucket", "part"]
    docs = docs.withColumn("run", F.floor(F.col("bucket") / BUCKETS_PER_RUN))
    sums = materialize(docs.groupBy(*at).agg(F.sum("size").alias("tokens")), "mix-buckets")
    runs = sums.groupBy("source", "run").agg(F.sum("tokens").alias("own"))
    runs = runs.select("source", "run", (F.sum("own").over(W.partitionBy("source").orderBy("run")) - F.col("own")).alias("run_base"))
    within_run = F.sum("tokens").over(W.partitionBy("source", "run").orderBy("bucket", "part")) - F.col("tokens")
    base = sums.withColumn("in_run", within_run).alias("b").join(runs.alias("r"), F.col("b.source").eqNullSafe(F.col("r.source")) & (F.col("b.run") == F.col("r.run")))
    base = base.select(F.col("b.source").alias("s"), F.col("b.bucket").alias("bu"), F.col("b.part").alias("p"), (F.col("run_base") + F.col("in_run")).alias("base"))
    within = W.partitionBy("source", "bucket", "part").orderBy("mix", "doc_id", "text_hash").rowsBetween(W.unboundedPreceding, 0)
    return (
        docs.withColumn("upto", F.sum("size").over(within))
        .join(base, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("bu")) & (F.col("part") == F.col("p")))
        .withColumn("start", F.col("base") + F.col("upto") - F.col("size"))
        .drop("s", "bu", "p", "base", "upto", "bucket", "part", "run", "mix", "text_hash")
    )


def plan(documents: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = 7, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The documents on their sources' token lines, and the readings (row, epoch, slot, words) that the schedule draws.

    A reading is one passage through a document; its slot is the first that
    reads of it.
    """
    docs = materialize(
        documents.select(
            "doc_id", "source", word_count(F.col("text")).alias("size"),
            F.xxhash64("doc_id", "text", F.lit(seed)).alias("mix"), F.xxhash64("text").alias("text_hash"), *keep,
        ).withColumn("row", F.monotonically_increasing_id()),
        "mix-sizes",
    )
    head = docs.agg(F.count("*").alias("rows"), F.sum("size").alias("total"), F.countDistinct(F.coalesce("source", F.lit(""))).alias("sources")).first()
    total = int(head["total"] or 0)
    block = max(1, min(BLOCK_TOKENS, total // (SLOTS_PER_SOURCE * max(1, head["sources"]))))

    goal = materialize(targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), max_epochs), "mix-targets")
    slots = materialize(schedule(goal, total, block), "mix-slots")
    drawn = slots.groupBy("nr").agg(F.count("*").alias("drawn"))  # the ranks drawn are 0 to drawn - 1
    lines = goal.join(drawn, "nr", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    placed = materialize(lay_out(docs, head["rows"]).join(lines.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "weight"), "mix-lines")
    # each passage through a document that the drawn slots reach, cut at the block borders
    reach = F.least(F.col("drawn") * F.lit(block), F.col("source_size") * F.lit(max_epochs))
    cut = (
        placed.where("size > 0")
        .select("row", "nr", "start", "size", "source_size", reach.alias("reach"), F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))).alias("epoch"))
        .withColumn("from", F.col("start") + F.col("epoch") * F.col("source_size"))
        .where("from < reach")
        .withColumn("to", F.least(F.col("from") + F.col("size"), F.col("reach")))
        .select("row", "nr", "epoch", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / block), F.floor((F.col("to") - 1) / block))).alias("rank"))
        .withColumn("words", F.least("to", (F.col("rank") + 1) * block) - F.greatest("from", F.col("rank") * block))
    )
    readings = cut.join(slots, ["nr", "rank"]).groupBy("row", "epoch").agg(F.min("slot").alias("slot"), F.sum("words").alias("words"))
    return placed, readings


def mix(documents: DataFrame, max_epochs: int = MAX_EPOCHS, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, start (its place on the source's line), first_slot."""
    placed, readings = plan(documents, max_epochs, seed)
    taken = readings.groupBy("row").agg(F.sum("words").alias("taken"), F.min("slot").alias("first_slot"))
    return placed.join(taken, "row", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "start", "first_slot"
    )
