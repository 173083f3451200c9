"""Registered queries over histories: a conversation is a document, its text up to a turn a revision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.jobs.inputs import read
from docgraph.jobs.queries import L, query
from docgraph.operators import history
from docgraph.storage import written

REVS = """revs AS (SELECT a.conv_id AS doc, a.turn AS rev, string_agg(b.text, chr(10) || chr(10) ORDER BY b.turn) AS text FROM (SELECT DISTINCT conv_id, turn FROM conversations) a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn <= a.turn GROUP BY 1, 2)"""


def revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, rev, text, parent); a conversation has a handful of turns, so its list is bounded."""
    c = read(spark, sf_dir, "conversations")
    turns = c.groupBy(F.col("conv_id").alias("doc")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    r = turns.select("doc", "t", F.explode(F.array_distinct(F.transform("t", lambda x: x["turn"]))).alias("rev"))
    upto = F.filter("t", lambda x: x["turn"] <= F.col("rev"))
    return r.select("doc", "rev", F.array_join(F.transform(upto, lambda x: x["text"]), "\n\n").alias("text"), F.when(F.col("rev") > 0, F.col("rev") - 1).alias("parent"))


@query("j4_reconstruct", f"WITH {REVS} SELECT CAST(doc AS VARCHAR) AS doc, rev, sha256(text) AS hash, true AS ok FROM revs")
def j4_reconstruct(spark, d):
    r = history.reconstruct(history.commit_chain(revisions(spark, d)))
    return r.select("doc", "rev", F.sha2("text", 256).alias("hash"), "ok")


@query("j5_verify_history", f"WITH {REVS} SELECT CAST(doc AS VARCHAR) AS doc, count(*) AS checked, count(*) FILTER (rev = 1) AS bad FROM revs GROUP BY 1")
def j5_verify_history(spark, d):
    """The recorded hash of revision 1 is tampered with: it alone is bad."""
    h = history.commit_chain(revisions(spark, d))
    return history.verify(h.withColumn("hash", F.when(F.col("rev") == 1, F.lit("0")).otherwise(F.col("hash"))))


@query("j2_diff_revisions")
def j2_diff_revisions(spark, d):
    return history.commit_chain(revisions(spark, d)).drop("payload")


@query(
    "j2_planted_differences",
    """WITH o AS (SELECT 'o' || o_orderkey AS doc, o_orderkey % 5 AS j, 'k' || o_orderkey AS v FROM orders), c(j, op_seq, kind, key, anchor) AS (VALUES (0, 0, 'same', NULL, NULL), (1, 0, 'replace', '#b', NULL), (2, 0, 'delete', '#c', NULL), (3, 0, 'insert', '#x', '#a'), (4, 0, 'delete', '#b', NULL), (4, 1, 'insert', '#b', 'at-start'))
  SELECT doc, CAST(0 AS BIGINT) AS rev, op_seq, kind, key, anchor FROM o JOIN c USING (j) UNION ALL SELECT doc, 1, 0, 'tip', NULL, NULL FROM o""",
)
def j2_planted_differences(spark, d):
    """Two revisions an order: equal, a block with another text, one more, one less, two in another order."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(F.concat(F.lit("o"), k).alias("doc"), (k % 5).alias("j"), F.concat(F.lit("k"), k).alias("v"))
    block = lambda name, body: F.concat(F.lit(f"=== note {{#{name}}}\n"), body, F.lit("\n===\n\n"))
    a, b, c, end, nothing, j = block("a", F.col("v")), block("b", F.lit("B")), block("c", F.lit("C")), F.lit("end"), F.lit(""), F.col("j")
    new = F.concat(a, b, F.when(j == 2, c).otherwise(nothing), end)
    old = F.when(j == 4, F.concat(b, a, end)).otherwise(F.concat(a, F.when(j == 3, block("x", F.col("v"))).otherwise(nothing), F.when(j == 1, block("b", F.lit("B was"))).otherwise(b), end))
    revs = o.select("doc", F.lit(1).alias("rev"), new.alias("text")).unionByName(o.select("doc", F.lit(0).alias("rev"), old.alias("text")))
    return history.commit_chain(revs).select("doc", "rev", "op_seq", "kind", "key", "anchor")


@query(
    "j2_moved_units",
    f"""SELECT conv_id AS doc, turn AS rev, 'C.' || chr(10) || chr(10) || 'A ' || turn || '.' || chr(10) || chr(10) || 'B.' || chr(10) || chr(10) || 'end' AS text FROM conversations""",
)
def j2_moved_units(spark, d):
    """Operations as history files have them: a move to the start, an insert at the end without a key, a delete and a replacement."""
    t = F.col("turn")
    base = read(spark, d, "conversations").select(F.concat_ws(".", "conv_id", "turn", "role").alias("doc"), "conv_id", "turn", F.concat(F.lit("=== note {#a}\nA\n===\n\nB.\n\nC.\n\nD.\n\n")).alias("text"))
    key = lambda x: F.concat(F.lit("@"), F.substring(F.sha2(F.lit(x), 256), 1, 8))
    op = lambda i, kind, key, anchor, payload: F.struct(F.lit(i).alias("op_seq"), F.lit(kind).alias("kind"), key.alias("key"), anchor.alias("anchor"), payload.alias("payload"))
    none = F.lit(None).cast("string")
    ops = F.array(
        op(0, "replace", F.lit("#a"), none, F.concat(F.lit("A "), t, F.lit(".\n\n"))), op(1, "delete", key("D."), none, none),
        op(2, "move", key("C."), F.lit("at-start"), none), op(3, "insert", none, F.lit("at-end"), F.lit("end")),
    )
    tip = base.select("doc", F.lit(1).cast(L).alias("rev"), F.lit("").alias("hash"), F.lit(0).alias("op_seq"), F.lit("tip").alias("kind"), none.alias("key"), none.alias("anchor"), F.col("text").alias("payload"))
    rest = base.select("doc", F.lit(0).cast(L).alias("rev"), F.lit("").alias("hash"), F.inline(ops))
    out = history.reconstruct(tip.unionByName(rest)).where("rev = 0")
    return out.join(base.drop("text"), "doc").select(F.col("conv_id").alias("doc"), F.col("turn").alias("rev"), "text")


@query("j3_commit", f"WITH {REVS} SELECT CAST(doc AS VARCHAR) AS doc, rev, sha256(text) AS hash, true AS ok FROM revs")
def j3_commit(spark, d):
    """All revisions but the newest committed at once, then the newest: every revision is rebuilt."""
    r = history.revision_log(revisions(spark, d))
    before = written(history.commit_chain(r.where("offset < 0"), keyframes=2), "history")
    h = written(history.commit(before, r.where("offset = 0")), "history")
    return history.reconstruct(h).select("doc", "rev", F.sha2("text", 256).alias("hash"), "ok")


@query(
    "j3_numbered_blobs",
    """WITH t AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nr FROM conversations) SELECT CAST(conv_id AS VARCHAR) AS doc, turn AS rev, 'b' || nr AS blob, role AS payload FROM t""",
)
def j3_numbered_blobs(spark, d):
    """Blob numbers follow the revisions of a document."""
    c = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("rev"), F.lit("").alias("hash"), F.lit(0).alias("op_seq"), F.lit("insert").alias("kind"), F.lit("k").alias("key"), F.lit("at-end").alias("anchor"), F.col("role").alias("payload"))
    ops, blobs = history.numbered_blobs(c)
    return ops.join(blobs, ["doc", "blob"]).select("doc", "rev", "blob", "payload")


@query("j1_tile_units", f"WITH {REVS} SELECT CAST(doc AS VARCHAR) AS doc, rev, sha256(text) AS hash FROM revs")
def j1_tile_units(spark, d):
    """Units joined in order are the text."""
    u = history.tile_units(revisions(spark, d))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "full"))), lambda x: x["full"]), "")
    return u.groupBy("doc", "rev").agg(F.sha2(joined, 256).alias("hash"))


@query(
    "e7_unit_keys",
    """WITH u AS (SELECT conv_id AS doc, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM conversations),
  l AS (SELECT doc, line, row_number() OVER (PARTITION BY doc ORDER BY turn, pos) AS pos FROM u WHERE trim(line, ' ' || chr(9) || chr(13)) <> '' AND NOT regexp_matches(line, '^={3,}') AND NOT regexp_matches(line, '#')),
  k AS (SELECT doc, pos, '@' || substr(sha256(line), 1, 8) AS base, row_number() OVER (PARTITION BY doc, substr(sha256(line), 1, 8) ORDER BY pos) - 1 AS n FROM l)
  SELECT CAST(doc AS VARCHAR) AS doc, pos - 1 AS pos, CASE WHEN n = 0 THEN base ELSE base || '~' || n END AS key FROM k""",
)
def e7_unit_keys(spark, d):
    """Conversations as documents whose lines are paragraphs: the keys of their units, numbered where one repeats."""
    c = read(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    c = c.where((F.trim(F.translate("line", "\t\r", "  ")) != "") & ~F.col("line").rlike("^={3,}") & ~F.col("line").contains("#"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "pos", "line")))  # a conversation has a handful of turns
    text = F.array_join(F.transform(lines, lambda x: x["line"]), "\n\n")
    docs = c.groupBy(F.col("conv_id").alias("doc")).agg(text.alias("text")).withColumn("rev", F.lit(0))
    return history.tile_units(docs).select("doc", "pos", "key")


@query("e6_revision_log", f"WITH {REVS} SELECT doc, rev, rev - max(rev) OVER (PARTITION BY doc) AS \"offset\", rev = max(rev) OVER (PARTITION BY doc) AS current FROM revs")
def e6_revision_log(spark, d):
    return history.revision_log(revisions(spark, d)).select("doc", "rev", "offset", "current")


@query("e8_last_distinct_version", "WITH m AS (SELECT conv_id, max(turn) AS tip FROM conversations GROUP BY 1), l AS (SELECT conv_id, role, max(turn) AS turn FROM conversations GROUP BY 1, 2), t AS (SELECT c.* FROM conversations c), n AS (SELECT t.conv_id, t.role, t.text FROM t JOIN l USING (conv_id, role, turn)) SELECT t.conv_id AS doc, t.role AS key, max(t.turn) AS rev FROM t JOIN n ON n.conv_id = t.conv_id AND n.role = t.role AND n.text <> t.text GROUP BY 1, 2")
def e8_last_distinct_version(spark, d):
    """A conversation's unit is a role: the newest earlier turn whose text differs from the role's last."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("key"), F.col("turn").alias("rev"), F.col("text").alias("full"))
    last = c.groupBy("doc", "key").agg(F.max("rev").alias("last"))
    tip = c.groupBy("doc").agg(F.max("rev").alias("tip"))
    u = c.join(last, ["doc", "key"]).join(tip, "doc").withColumn("rev", F.when(F.col("rev") == F.col("last"), F.col("tip") + 1).otherwise(F.col("rev")))
    return history.last_distinct_version(u.select("doc", "rev", "key", "full"))


#: Planted histories by a conversation's number modulo 6, whose ids don't follow time: (revision, parent, steps back, fault); '' is current, and all but one have the chain z, a, m.
PLANTED = {
    0: [("z", "a", 0, None), ("a", "m", 1, None), ("m", None, 2, None)],
    1: [("z", "a", 0, None), ("a", "m", 1, "cycle"), ("m", "q", 2, "cycle"), ("q", "a", 3, "cycle"), ("b", "z", None, "branch")],
    2: [("z", "a", 0, None), ("a", "m", 1, None), ("m", None, 2, None), ("b", "a", None, "branch"), ("c", "b", None, "branch"), ("o", "p", None, "orphan"), ("p", None, None, "orphan")],
    3: [("z", "a", 0, None), ("a", "m", 1, None), ("m", "gone", 2, "missing parent"), ("s", "s", None, "cycle"), ("t", "s", None, "orphan")],
    4: [("z", "z", 0, "cycle"), ("a", None, None, "orphan")],
    5: [("a", "m", None, "orphan"), ("m", None, None, "orphan")],
}
CHAIN_ROWS = ", ".join(f"({j}, '{r}', {'NULL' if b is None else b}, {'NULL' if f is None else repr(f)})" for j, rows in PLANTED.items() for r, _, b, f in [*rows, *([("z", None, None, "missing current")] if j == 5 else [])])


def planted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(doc, rev, parent) and (doc, current), a planted history a conversation."""
    c = read(spark, sf_dir, "conversations").select("conv_id").distinct()
    doc = F.concat(F.lit("d"), "conv_id").alias("doc")
    cases = F.array(*[F.array(*[F.struct(F.lit(r).alias("rev"), F.lit(p).cast("string").alias("parent")) for r, p, _, _ in rows]) for rows in PLANTED.values()])
    return c.select(doc, F.inline(F.get(cases, (F.col("conv_id") % 6).cast("int")))), c.select(doc, F.lit("z").alias("current"))


@query("j6_chain", f"WITH p(j, rev, back, fault) AS (VALUES {CHAIN_ROWS}) SELECT 'd' || conv_id AS doc, rev, CAST(back AS BIGINT) AS back, fault FROM (SELECT DISTINCT conv_id FROM conversations) c JOIN p ON p.j = conv_id % 6")
def j6_chain(spark, d):
    """Chains from current under ids that don't follow time: cycles of one and three, a missing parent, branches, orphans, no current."""
    return history.chains(*planted(spark, d))


@query(
    "j6_long_chain",
    """WITH l AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey DESC) - 1 AS back FROM orders) SELECT 'c' || (o_custkey % 3) AS doc, md5(CAST(o_orderkey AS VARCHAR)) AS rev, back, CAST(NULL AS VARCHAR) AS fault FROM l""",
)
def j6_long_chain(spark, d):
    """Three long chains, a revision an order, under ids without order."""
    o = read(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey") % 3).alias("doc"), "o_orderkey")
    w = W.partitionBy("doc").orderBy("o_orderkey")
    name = lambda c: F.md5(c.cast("string").cast("binary"))
    r = o.select("doc", name(F.col("o_orderkey")).alias("rev"), name(F.lag("o_orderkey").over(w)).alias("parent"))
    return history.chains(r, o.groupBy("doc").agg(name(F.max("o_orderkey")).alias("current")))


@query(
    "j5_verify_chains",
    f"""WITH {REVS}, m AS (SELECT doc, max(rev) AS tip FROM revs GROUP BY 1), n AS (SELECT r.doc, r.rev, tip, md5('x' || r.rev) AS id FROM revs r JOIN m USING (doc)) SELECT CAST(doc AS VARCHAR) AS doc, id AS rev, 'error' AS severity, 'hash differs' AS fault FROM n WHERE doc % 4 = 1 AND rev = 0
  UNION ALL SELECT CAST(doc AS VARCHAR), id, 'error', 'missing parent' FROM n WHERE doc % 4 = 2 AND rev = 0
  UNION ALL SELECT CAST(doc AS VARCHAR), id, 'warning', 'uncommitted changes' FROM n WHERE doc % 4 = 3 AND rev = tip""",
)
def j5_verify_chains(spark, d):
    """Histories under ids without order; of every four one is whole, one has a tampered hash, one no parent for its first revision, one an edited live text."""
    r = revisions(spark, d)
    name = lambda c: F.md5(F.concat(F.lit("x"), c).cast("binary"))
    doc = F.col("doc").cast("string").alias("doc")
    n = F.col("doc").cast("long") % 4
    ops = written(history.commit_chain(r), "ops").withColumn("hash", F.when((n == 1) & (F.col("rev") == 0), F.lit("0")).otherwise(F.col("hash")))
    parent = F.when((n == 2) & (F.col("rev") == 0), "gone").otherwise(name(F.col("parent")))
    revs = r.select(doc, name(F.col("rev")).alias("rev"), parent.alias("parent"))
    heads = r.groupBy("doc").agg(name(F.max("rev")).alias("current")).select(doc, "current")
    live = r.groupBy("doc").agg(F.max_by("text", "rev").alias("text")).select(doc, F.concat("text", F.when(n == 3, "!").otherwise("")).alias("text"))
    return history.verify_history(ops.withColumn("rev", name(F.col("rev"))), revs, heads, live)


@query(
    "j7_resolve_selector",
    """WITH m AS (SELECT conv_id AS doc, max(turn) AS tip FROM conversations GROUP BY 1) SELECT doc, 'latest' AS sel, tip AS rev FROM m UNION ALL SELECT doc, '-2', CASE WHEN tip >= 2 THEN tip - 2 END FROM m UNION ALL SELECT doc, 'r', CASE WHEN tip = 0 THEN 0 END FROM m UNION ALL SELECT doc, 'x1', CASE WHEN tip >= 1 THEN 1 END FROM m""",
)
def j7_resolve_selector(spark, d):
    log = history.revision_log(revisions(spark, d)).withColumn("id", F.concat(F.lit("r-x"), "rev"))
    sel = log.select("doc").distinct().select("doc", F.explode(F.array(F.lit("latest"), F.lit("-2"), F.lit("r"), F.lit("x1"))).alias("sel"))
    return history.resolve_selector(log, sel)


@query("j9_truncate_to", f"WITH {REVS} SELECT doc, rev FROM revs WHERE doc % 2 = 1 OR rev <= 1")
def j9_truncate_to(spark, d):
    r = revisions(spark, d)
    return history.truncate_to(r, r.where("doc % 2 = 0").select("doc").distinct().withColumn("rev", F.lit(1))).select("doc", "rev")


@query("j10_change_frequency", "SELECT conv_id AS doc, role AS key, count(DISTINCT turn) AS revisions FROM conversations GROUP BY 1, 2")
def j10_change_frequency(spark, d):
    return history.change_frequency(read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("role").alias("key"), F.col("turn").alias("rev")))


@query("j3_need_commit", f"WITH {REVS}, m AS (SELECT doc, max(rev) AS tip FROM revs GROUP BY 1) SELECT DISTINCT a.doc FROM revs a JOIN m ON m.doc = a.doc AND a.rev = m.tip JOIN revs b ON b.doc = a.doc AND b.rev = m.tip - 1 WHERE a.text <> b.text")
def j3_need_commit(spark, d):
    """Documents whose live text isn't their recorded tip (here the revision before)."""
    from docgraph.operators import graph

    r = history.revision_log(revisions(spark, d)).withColumn("hash", F.sha2("text", 256))
    return graph.changed_docs(r.where("offset = -1"), r.where("offset = 0")).where("change = 'changed'").select("doc")


@query(
    "j11_parse_history",
    """SELECT 'h' || conv_id AS doc, 'r' || turn AS rev, 'replace' AS kind, '#k' || turn AS key, 'b' || turn AS blob, CAST(NULL AS VARCHAR) AS anchor, length(replace(text, chr(10), ' ')) AS n FROM conversations
  UNION ALL SELECT 'h' || conv_id, 'r' || turn, 'insert', NULL, 'b' || turn, CASE WHEN turn = 0 THEN 'at-start' ELSE '#k' || (turn - 1) END, length(replace(text, chr(10), ' ')) FROM conversations""",
)
def j11_parse_history(spark, d):
    """History files written from the conversations and read back: operations with the length of their blob."""
    from docgraph.sources.scan import scan_corpus

    t = F.col("turn")
    block = F.concat(
        F.lit('=== revision {id="r'), t, F.lit('" author="'), "role", F.lit('"}\nreplace #k'), t, F.lit(" <- blob:b"), t, F.lit("\ninsert <- blob:b"), t,
        F.when(t == 0, F.lit(" at-start")).otherwise(F.concat(F.lit(" after #k"), t - 1)), F.lit("\n===\n=== blob {#b"), t, F.lit("}\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n===\n"),
    )
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", block.alias("b")))), lambda x: x["b"]), "\n")
    files = read(spark, d, "conversations").groupBy(F.concat(F.lit("h"), "conv_id").alias("doc")).agg(text.alias("text"))
    _, ops, blobs, _ = history.parse_history(scan_corpus(files))
    return ops.join(blobs.select("doc", F.col("id").alias("blob"), F.length("payload").cast(L).alias("n")), ["doc", "blob"]).select("doc", "rev", "kind", "key", "blob", "anchor", "n")


@query("j8_revert_blocks", "SELECT CAST(conv_id AS VARCHAR) AS doc, '=== note {#a}' || chr(10) || replace(arg_min(text, turn), chr(10), ' ') || chr(10) || '===' || chr(10) || chr(10) || 'end' AS text FROM conversations GROUP BY 1")
def j8_revert_blocks(spark, d):
    """Each document's block put back to its first revision."""
    from docgraph.sources.scan import scan_corpus

    body = F.concat(F.lit("=== note {#a}\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n===\n\nend"))
    r = read(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("rev"), body.alias("text"))
    now = r.groupBy("doc").agg(F.max_by("text", "rev").alias("text"))
    keys = r.groupBy("doc").agg(F.min("rev").alias("rev")).withColumn("id", F.lit("a"))
    return history.revert_blocks(now, scan_corpus(now), history.reconstruct(history.commit_chain(r)), keys)


@query(
    "j8_revert_changed",
    """WITH m AS (SELECT conv_id, max(turn) AS tip FROM conversations GROUP BY 1), n AS (SELECT conv_id, CASE WHEN tip >= 2 THEN tip // 2 * 2 - 2 ELSE 0 END AS turn FROM m)
  SELECT CAST(conv_id AS VARCHAR) AS doc, '=== note {#a}' || chr(10) || replace(text, chr(10), ' ') || chr(10) || '===' || chr(10) || chr(10) || 'end' AS text FROM conversations JOIN n USING (conv_id, turn)""",
)
def j8_revert_changed(spark, d):
    """A block that changes every second revision, put back to its version before the current one; where it never changed, it stays."""
    from docgraph.sources.scan import scan_corpus

    c = read(spark, d, "conversations")
    said = c.select("conv_id", F.col("turn").alias("at"), "text")
    r = c.select("conv_id", F.col("turn").alias("rev"), (F.col("turn") - F.col("turn") % 2).alias("at")).join(said, ["conv_id", "at"])
    body = F.concat(F.lit("=== note {#a}\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n===\n\nend"))
    r = r.select(F.col("conv_id").cast("string").alias("doc"), "rev", body.alias("text"))
    now = r.groupBy("doc").agg(F.max_by("text", "rev").alias("text"))
    return history.revert_changed(now, scan_corpus(now), r, now.select("doc", F.lit("a").alias("id")))


@query(
    "e8_last_changes",
    "WITH t AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS was FROM conversations), m AS (SELECT conv_id, max(turn) AS tip FROM conversations GROUP BY 1) SELECT conv_id AS doc, 'k' AS key, max(turn) - 1 AS rev FROM t WHERE role <> was GROUP BY 1",
)
def e8_last_changes(spark, d):
    """A unit whose text is the turn's role."""
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.lit("k").alias("key"), F.col("turn").alias("rev"), F.col("role").alias("full"))
    return history.last_changes(c)


@query(
    "j9_roll_back",
    f"""WITH {REVS}, m AS (SELECT doc, max(rev) AS tip FROM revs GROUP BY 1) SELECT CAST(doc AS VARCHAR) AS doc, rev, sha256(text) AS hash, true AS ok, NULL AS refused FROM revs JOIN m USING (doc) WHERE doc % 4 <> 0 OR tip < 1 OR rev <= 1
  UNION ALL SELECT CAST(doc AS VARCHAR), CASE WHEN doc % 4 = 3 THEN 99 ELSE 1 END, NULL, NULL, CASE WHEN doc % 4 = 3 OR tip < 1 THEN 'no such revision' ELSE 'uncommitted changes' END FROM m WHERE doc % 4 IN (2, 3) OR doc % 4 = 0 AND tip < 1""",
)
def j9_roll_back(spark, d):
    """Every fourth history is cut after revision 1 and rebuilt; of the others one isn't asked for, one has an edited live text, and one lacks the revision."""
    r = written(revisions(spark, d), "revisions")
    h = written(history.commit_chain(r, keyframes=2), "history")
    n = F.col("doc").cast("long") % 4
    docs = r.select(F.col("doc").cast("string").alias("doc")).distinct()
    keep = docs.where(n != 1).withColumn("rev", F.when(n == 3, F.lit(99)).otherwise(F.lit(1)).cast(L))
    live = r.groupBy(F.col("doc").cast("string").alias("doc")).agg(F.max_by("text", "rev").alias("text")).select("doc", F.when(n == 2, F.lit("edited")).otherwise(F.col("text")).alias("text"))
    cut, refused = history.roll_back(h, keep, live)
    none = F.lit(None)
    rebuilt = history.reconstruct(cut).select("doc", "rev", F.sha2("text", 256).alias("hash"), "ok", none.cast("string").alias("refused"))
    return rebuilt.unionByName(refused.select("doc", "rev", none.cast("string").alias("hash"), none.cast("boolean").alias("ok"), F.col("reason").alias("refused")))


@query(
    "j10_author_counts",
    """WITH t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS nr FROM (SELECT conv_id, turn, min(role) AS role FROM conversations GROUP BY 1, 2))
  SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(NULL AS VARCHAR) AS key, role AS author, count(*) AS revisions FROM t GROUP BY 1, 3 UNION ALL SELECT CAST(conv_id AS VARCHAR), '#a', role, count(*) FROM t WHERE nr > 1 GROUP BY 1, 3""",
)
def j10_author_counts(spark, d):
    """A block that every revision changes, whose author is the turn's role."""
    c = read(spark, d, "conversations")
    r = c.groupBy(F.col("conv_id").cast("string").alias("doc"), F.col("turn").alias("rev")).agg(F.min("role").alias("author"))
    text = F.concat(F.lit("=== note {#a}\n"), "rev", F.lit("\n==="))
    return history.author_counts(history.commit_chain(r.withColumn("text", text)), r)


@query(
    "j3_commit_revisions",
    f"""WITH {REVS}, m AS (SELECT doc, max(rev) AS tip FROM revs GROUP BY 1), x AS (SELECT r.doc, r.rev, tip, sha256(r.text) AS hash, TIMESTAMP '2024-01-01' + to_seconds(r.rev) AS made FROM revs r JOIN m USING (doc)),
  i AS (SELECT *, strftime(made, '%Y%m%dT%H%M%SZ') || '-' || substr(hash, 1, 8) AS id FROM x)
  SELECT CAST(doc AS VARCHAR) AS doc, rev, id, lag(id) OVER (PARTITION BY doc ORDER BY rev) AS parent, 'a' || (rev % 2) AS author, 's' || rev AS summary, hash, CAST(true AS BOOLEAN) AS ok, CASE WHEN rev > 0 THEN 'b' || rev END AS newest_blob FROM i WHERE doc % 3 <> 1 OR rev < tip OR tip = 0
  UNION ALL SELECT CAST(doc AS VARCHAR), NULL, lag_id, NULL, 'a' || (tip % 2), NULL, NULL, false, NULL FROM (SELECT doc, tip, rev, lag(id) OVER (PARTITION BY doc ORDER BY rev) AS lag_id FROM i) WHERE doc % 3 = 1 AND rev = tip AND tip > 0""",
)
def j3_commit_revisions(spark, d):
    """Revisions committed in three rounds with author, summary, time and parent; in the last a third of the documents has an outdated base and is refused.

    Each revision but the first has one blob more, the block that it changed: the newest of a document's numbers is shown.
    """
    r = written(revisions(spark, d).select(F.col("doc").cast("string").alias("doc"), "rev", "text"), "revisions")
    tips = r.groupBy("doc").agg(F.max("rev").alias("tip"))
    r = written(r.join(tips, "doc"), "revisions")
    ops, revs = spark.createDataFrame([], history.OPS + ", blob string"), spark.createDataFrame([], history.REVISION)
    refused = None
    last = r.agg(F.max("rev")).first()[0]
    for k in range(last + 1):  # rounds of commits, as they come in over time
        base = revs.groupBy("doc").agg(F.max_by("id", "rev").alias("base"))
        work = r.where(F.col("rev") == k).join(base, "doc", "left")
        late = (F.col("rev") == F.col("tip")) & (F.col("tip") > 0) & (F.col("doc").cast("long") % 3 == 1)
        at = F.timestamp_seconds(F.lit(1704067200) + F.col("rev"))
        work = work.select("doc", "text", F.concat(F.lit("a"), F.col("rev") % 2).alias("author"), F.concat(F.lit("s"), "rev").alias("summary"), at.alias("at"), F.when(late, "outdated").otherwise(F.col("base")).alias("base"))
        ops, revs, no = history.commit_revisions(ops, revs, work)
        ops, revs, no = written(ops, "ops"), written(revs, "revs"), written(no, "refused")
        refused = no if refused is None else refused.unionByName(no)
    rebuilt = history.reconstruct(ops.drop("blob")).select("doc", "rev", "ok")
    blobs = ops.where("blob IS NOT NULL").groupBy("doc", (F.col("rev") + 1).alias("rev")).agg(F.max(F.expr("CAST(substring(blob, 2) AS INT)")).alias("b"))
    out = revs.join(rebuilt, ["doc", "rev"]).join(blobs, ["doc", "rev"], "left").select("doc", "rev", "id", "parent", "author", "summary", "hash", "ok", F.concat(F.lit("b"), "b").alias("newest_blob"))
    none = lambda kind: F.lit(None).cast(kind)
    return out.unionByName(refused.select("doc", none(L).alias("rev"), F.col("tip").alias("id"), none("string").alias("parent"), "author", none("string").alias("summary"), none("string").alias("hash"), F.lit(False).alias("ok"), none("string").alias("newest_blob")))
