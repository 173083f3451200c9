"""Documents that arrive in a stream, for ``foreachBatch``: checked with memory of earlier ones, kept as histories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.operators import corpus, history
from docgraph.sources.scan import scan_corpus
from docgraph.storage import written
from docgraph.streaming.keyed import KeyedTable

FINDING = "doc string, line int, severity string, code string, message string, target string"


class Checker:
    """What is wrong with a corpus whose documents arrive one after the other, in tables below ``path``.

    Each document's ids, its references to other documents (by their target too)
    and its findings are kept. A batch reads and writes the buckets of its
    documents, of what they refer to, and of those that refer to them.
    """

    def __init__(self, spark, path: str, buckets: int = 64):
        of = lambda name, key, schema: KeyedTable(spark, f"{path}/{name}", key, schema, buckets)
        self.ids = of("ids", "doc", "doc string, id string")
        refs = "doc string, line int, ref_kind string, written string, target string, anchor string"
        self.refs, self.incoming = of("refs", "doc", refs), of("incoming", "target", refs)
        self.findings = of("findings", "doc", FINDING)

    def check_batch(self, batch: DataFrame, order: str = "ts") -> DataFrame:
        """(FINDING, change): what a batch of documents (doc, text) finds and resolves, by all rules of the corpus check.

        Of several rows of a document the last by ``order`` counts, of equal ones
        the greater text. A document that comes again replaces itself: what isn't
        found any more is ``resolved``, be it its own or in documents that refer to it.
        A batch may be run again; a change is told once, ``findings`` has what stands.
        """
        last = batch.groupBy("doc").agg(F.max(F.struct(order, "text")).alias("last")).select("doc", F.col("last.text").alias("text"))
        s = written(scan_corpus(last), "arrived")
        docs = written(last.select("doc"), "arrived-docs")
        refs = corpus.tagged(s, "ref").where("target_doc IS NOT NULL").select(
            "doc", "line", "ref_kind", F.col("target_doc").alias("written"), corpus.relative_target(F.col("doc"), F.col("target_doc")).alias("target"), "anchor"
        )
        refs = written(refs, "arrived-refs")
        targets = written(self.refs.read(docs).select("target").union(refs.select("target")).distinct(), "arrived-targets")
        stale = written(self.incoming.read(targets).join(docs, "doc", "left_anti"), "arrived-incoming")
        own_ids = corpus.tagged(s, "id").select("doc", "id").distinct()
        # what refers where goes last but one, as it tells a batch that is run again which targets it has left
        self.incoming.write(stale.unionByName(refs), targets)
        # a document without ids is known by a row without one
        self.ids.write(docs.join(own_ids, "doc", "left").select("doc", "id"), docs)
        self.refs.write(refs, docs)

        here = docs.withColumnRenamed("doc", "target")
        met = written(refs.unionByName(self.incoming.read(here).join(docs, "doc", "left_anti")), "arrived-met")
        ids = self.ids.read(met.select(F.col("target").alias("doc")))
        reason = F.when(F.col("has_doc").isNull(), "doc").when(F.col("anchor").isNotNull() & F.col("has_id").isNull(), "id")
        known = ids.select(F.col("doc").alias("target"), F.lit(True).alias("has_doc")).distinct()
        named = ids.where("id IS NOT NULL").select(F.col("doc").alias("target"), F.col("id").alias("anchor"), F.lit(True).alias("has_id")).distinct()
        unresolved = met.join(known, "target", "left").join(named, ["target", "anchor"], "left").withColumn("reason", reason).where("reason IS NOT NULL")
        cross = corpus.cross_findings(unresolved.withColumn("reason", F.when(F.col("reason") == "doc", corpus.NO_DOCUMENT).otherwise("unresolved reference")), "target")
        own = corpus.check_corpus(s).where("code <> 'unchecked-cross'").withColumn("target", F.lit(None).cast("string"))
        fresh = own.unionByName(cross)

        about = written(met.select("doc").union(docs).distinct(), "arrived-about")
        before = written(self.findings.read(about), "findings-before")
        # of a document that didn't arrive, only references to those that did were looked at
        kept = before.join(docs, "doc", "left_anti").join(here, "target", "left_anti")
        after = written(fresh.unionByName(kept), "findings-after")
        self.findings.write(after, about)
        said = lambda df, change: df.withColumn("change", F.lit(change))
        return said(after.exceptAll(before), "found").unionByName(said(before.exceptAll(after), "resolved"))


#: Versions of one document at one time that can be told apart.
TIES = 1 << 10
REVISIONS = history.OPS


class Recorder:
    """Histories of documents whose versions arrive in a stream, below ``path``: a table of tips, and operations for what is behind them.

    Every arrival is a revision, numbered by its time and, at one time, by the
    order of its hash or arrival; one that repeats its neighbour costs no text.
    A row that was seen before, with its time and text, is no arrival. Versions
    that come in order are compared with the tip alone; a document with a late
    version is rebuilt, put in order and compared again. A batch may be run
    again: operations that its tips don't know of yet don't count.
    """

    def __init__(self, spark, path: str, buckets: int = 64, keyframes: int = history.KEYFRAMES):
        self.tips = KeyedTable(spark, f"{path}/tips", "doc", "doc string, rev long, text string, hash string, since int", buckets)
        self.ops = KeyedTable(spark, f"{path}/ops", "doc", REVISIONS, buckets)
        self.keyframes = keyframes

    def append_batch(self, batch: DataFrame, order: str = "ts") -> None:
        """Adds a batch of versions (doc, text, and their time ``order`` as a whole number)."""
        new = batch.select(F.col("doc").cast("string").alias("doc"), F.col(order).cast("long").alias("at"), F.coalesce("text", F.lit("")).alias("text")).distinct()
        new = written(new.withColumn("hash", F.sha2("text", 256)), "versions")
        docs = written(new.select("doc").distinct(), "version-docs")
        tips = written(self.tips.read(docs), "version-tips")
        first = new.groupBy("doc").agg(F.min("at").alias("first"))
        late = written(first.join(tips, "doc").where(F.col("first") <= F.floor(F.col("rev") / TIES)).select("doc"), "version-late")

        # those in order: the tip and what comes after it
        fresh = new.join(late, "doc", "left_anti").select("doc", "at", "text", F.lit(None).cast("long").alias("rev"), F.lit(0).alias("since"))
        chain = fresh.unionByName(tips.join(late, "doc", "left_anti").select("doc", F.floor(F.col("rev") / TIES).alias("at"), "text", "rev", "since"))
        # late ones: all there is
        old = written(self.history(late).transform(history.reconstruct), "version-rebuilt")
        broken = old.where("NOT ok").limit(1).collect()
        if broken:
            raise history.BadHistory(f"revision {broken[0].rev} of {broken[0].doc} can't be rebuilt: {broken[0].fault}")
        there = old.select("doc", F.floor(F.col("rev") / TIES).alias("at"), "text", "rev")
        more = new.join(late, "doc", "left_semi").select("doc", "at", "text").join(there.select("doc", "at", "text"), ["doc", "at", "text"], "left_anti")
        again = there.unionByName(more.withColumn("rev", F.lit(None).cast("long"))).withColumn("since", F.lit(0))

        ops, tip = self._compared(chain)
        late_ops, late_tip = self._compared(again)
        self.ops.write(written(late_ops, "version-ops"), late)
        self.ops.write(written(ops, "version-ops"))
        self.tips.write(written(tip.unionByName(late_tip), "version-tips"), docs)

    def _compared(self, chain: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(operations of all but the newest, the newest) of revisions (doc, at, text, rev or null, since)."""
        at_once = W.partitionBy("doc", "at").orderBy(F.asc_nulls_last("rev"), F.sha2("text", 256))
        together = W.partitionBy("doc", "at")
        taken = F.coalesce(F.max(F.col("rev") % TIES + 1).over(together), F.lit(0))
        nth = F.row_number().over(at_once) - 1 - F.count("rev").over(together)
        number = F.coalesce("rev", F.col("at") * TIES + taken + nth)
        too_many = F.raise_error("too many versions of a document at one time").cast("long")
        c = chain.withColumn("rev", F.when(number < (F.col("at") + 1) * TIES, number).otherwise(too_many))
        line = W.partitionBy("doc").orderBy("rev")
        c = c.withColumn("newer", F.lead("text").over(line)).withColumn("since", F.first("since").over(line) + F.row_number().over(line) - 1)
        c = written(c.select("doc", "rev", "text", "newer", "since"), "compared")
        whole = F.when((F.col("since") > 0) & (F.col("since") % self.keyframes == 0), "keyframe")
        ops = history._operations(c.where("newer IS NOT NULL").withColumn("whole", whole))
        tip = c.where("newer IS NULL").select("doc", "rev", "text", F.sha2("text", 256).alias("hash"), F.col("since").cast("int").alias("since"))
        return ops, tip

    def history(self, docs: DataFrame | None = None) -> DataFrame:
        """OPS rows, of all documents or of ``docs``."""
        none = F.lit(None).cast("string")
        tips = self.tips.read(docs)
        behind = self.ops.read(docs).join(tips.select("doc", F.col("rev").alias("tip")), "doc").where("rev < tip").drop("tip").dropDuplicates(["doc", "rev", "op_seq"])
        whole = tips.select("doc", "rev", "hash", F.lit(0).alias("op_seq"), F.lit("tip").alias("kind"), none.alias("key"), none.alias("anchor"), F.col("text").alias("payload"))
        return behind.unionByName(whole)

    def versions(self, docs: DataFrame | None = None) -> DataFrame:
        """(doc, at, text): the revisions whose text isn't that of the one before, in time."""
        r = history.reconstruct(self.history(docs)).withColumn("before", F.lag(F.sha2("text", 256)).over(W.partitionBy("doc").orderBy("rev")))
        return r.where(~F.col("before").eqNullSafe(F.sha2("text", 256))).select("doc", F.floor(F.col("rev") / TIES).alias("at"), "text")
