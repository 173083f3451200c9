"""Document histories: units, reverse patches, rebuilding, checking.

A text is tiled by units: fenced blocks or runs of prose, each with the blank
lines after it. A unit's key is its ``#id`` or ``@`` and 8 digits of its body's
SHA-256, and ``~n`` for the n-th further one. A revision keeps the operations
that turn the next newer text into its own; the tip is kept whole, and so is a
revision every now and then, at which chains are cut for rebuilding.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.storage import written

FENCE = re.compile(r"^(={3,})\s*[A-Za-z][\w-]*.*$")
IDENT = re.compile(r"\{[^{}]*#([\w.-]+)[^{}]*\}\s*$")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def tile(text: str) -> list[tuple[str, str]]:
    """(key, full text) of the units; their full texts joined are the text."""
    lines = text.split("\n")
    pieces, k = [], 0
    while k < len(lines):
        at = k
        m = FENCE.match(lines[k])
        if m:
            k += 1
            while k < len(lines) and lines[k].strip() != m[1]:
                k += 1
            k = min(k + 1, len(lines))
        else:
            while k < len(lines) and lines[k].strip() and not (k > at and FENCE.match(lines[k])):
                k += 1
        stop = k
        while k < len(lines) and not lines[k].strip():
            k += 1
        pieces.append((lines[at:stop], lines[at:k]))
    out, seen = [], {}
    for i, (body, full) in enumerate(pieces):
        ident = IDENT.search(body[0]) if body else None
        base = "#" + ident[1] if ident else "@" + sha("\n".join(body))[:8]
        n = seen[base] = seen.get(base, -1) + 1
        out.append((base if not n else f"{base}~{n}", "\n".join(full) + ("\n" if i < len(pieces) - 1 else "")))
    return out


def in_order(positions: list[int]) -> set[int]:
    """Indexes of a longest increasing run of the positions."""
    tails, at, back = [], [], []
    for i, p in enumerate(positions):
        j = bisect.bisect_left(tails, p)
        tails[j:j + 1], at[j:j + 1] = [p], [i]
        back.append(at[j - 1] if j else -1)
    out, i = set(), at[-1] if at else -1
    while i >= 0:
        out.add(i)
        i = back[i]
    return out


#: Anchors of an insert or move besides the key that it stands after.
START, END = "at-start", "at-end"

Op = tuple[str, str | None, str | None, str | None]


def diff(new: str, old: str) -> list[Op]:
    """(kind, key, anchor, payload): operations that turn the new text into the old."""
    a, b = tile(new), tile(old)
    where = {k: i for i, (k, _) in enumerate(a)}
    matched = [(j, where[k]) for j, (k, _) in enumerate(b) if k in where]
    kept = {matched[i][0]: matched[i][1] for i in in_order([p for _, p in matched])}
    stay = set(kept.values())
    ops: list[Op] = [("delete", k, None, None) for i, (k, _) in enumerate(a) if i not in stay]
    previous = START
    for j, (k, full) in enumerate(b):
        if j not in kept:
            ops.append(("insert", k, previous, full))
        elif a[kept[j]][1] != full:
            ops.append(("replace", k, None, full))
        previous = k
    return ops


class BadHistory(ValueError):
    """An operation names a unit that isn't there."""


def place_of(live: list[list[str]], anchor: str | None) -> int:
    if anchor in (None, START):
        return 0
    if anchor == END:
        return len(live)
    for i, u in enumerate(live):
        if u[0] == anchor:
            return i + 1
    raise BadHistory(f"unit {anchor} not found")


def relabelled(live: list[list[str]]) -> list[list[str]]:
    """The units of the text as it now stands, keyed anew."""
    return [list(u) for u in tile("".join(full for _, full in live))]


def patch(new: str, ops: list[Op]) -> str:
    """The text that the operations make of the new one.

    Deletes and replacements name units of the new text; inserts and moves come
    after them and name units of the text as it stands then. An insert without a
    key, as history files have it, is keyed by what it brings.
    """
    units = tile(new)
    known = {k for k, _ in units}
    missing = next((k for kind, k, _, _ in ops if kind in ("delete", "replace") and k not in known), None)
    if missing is not None:
        raise BadHistory(f"unit {missing} not found")
    gone = {k for kind, k, _, _ in ops if kind == "delete"}
    swap = {k: p for kind, k, _, p in ops if kind == "replace"}
    live = [[k, swap.get(k, full)] for k, full in units if k not in gone]
    if any(kind == "move" or kind == "insert" and k is None for kind, k, _, _ in ops):
        live = relabelled(live)
    for kind, k, anchor, payload in ops:
        if kind == "insert":
            live.insert(place_of(live, anchor), [k, payload])
            if k is None:
                live = relabelled(live)
        elif kind == "move":
            unit = live.pop(place_of(live, k) - 1)
            live.insert(place_of(live, anchor), unit)
            live = relabelled(live)
    return "".join(full for _, full in live)


OPS = "doc string, rev long, hash string, op_seq int, kind string, key string, anchor string, payload string"
#: Revisions between two that are kept whole.
KEYFRAMES = 32
#: Rows that a worker turns into objects at a time.
PIECE = 256
REBUILT = {"doc": pa.string(), "rev": pa.int64(), "text": pa.string(), "ok": pa.bool_(), "fault": pa.string()}


def _operations(pairs: DataFrame) -> DataFrame:
    """OPS rows from (doc, rev, text, newer): a revision without ``newer`` is kept whole, as kind ``whole``.

    A difference that doesn't give its revision back exactly is refused.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for doc, rev, text, newer, whole in zip(pdf["doc"], pdf["rev"], pdf["text"], pdf["newer"], pdf["whole"], strict=True):
                text = text or ""
                if whole is not None:
                    ops = [(whole, None, None, text)]
                else:
                    ops = diff(newer or "", text)
                    if patch(newer or "", ops) != text:
                        raise ValueError(f"revision {rev} of {doc} doesn't round-trip")
                rows += [(doc, rev, sha(text), i, *op) for i, op in enumerate(ops or [("same", None, None, None)])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in OPS.split(", ")])

    return pairs.select("doc", "rev", "text", "newer", "whole").mapInPandas(run, OPS)


def commit_chain(revisions: DataFrame, keyframes: int = KEYFRAMES) -> DataFrame:
    """Operations of each revision (doc, rev, text): those that rebuild it from the next newer one; the newest is kept whole (kind 'tip'), and of the others every so many (kind 'keyframe').

    Each pair of neighbours is compared by itself; a document's revisions are never held together.
    """
    r = revisions.select(F.col("doc").cast("string").alias("doc"), F.col("rev").cast("long").alias("rev"), "text")
    w = W.partitionBy("doc").orderBy(F.desc("rev"))
    nr = F.row_number().over(w) - 1
    whole = F.when(F.col("nr") == 0, "tip").when(F.col("nr") % keyframes == 0, "keyframe")
    return _operations(r.withColumn("newer", F.lag("text").over(w)).withColumn("nr", nr).withColumn("whole", whole))


def commit(history: DataFrame, working: DataFrame) -> DataFrame:
    """The history (OPS rows) with a revision for each document (doc, rev, text) whose text isn't its tip's.

    The tip before becomes operations on the new one, unless it is a keyframe's
    turn; a document without a history begins one. Other documents stay as they are.
    """
    tips = history.where("kind = 'tip'").select("doc", F.col("rev").alias("old_rev"), F.col("payload").alias("old"), F.col("hash").alias("old_hash"))
    since = history.where("kind IN ('tip', 'keyframe')").groupBy("doc").agg(F.max(F.when(F.col("kind") == "keyframe", F.col("rev"))).alias("frame"))
    met = working.select(F.col("doc").cast("string").alias("doc"), F.col("rev").cast("long").alias("rev"), "text").join(tips, "doc", "left").where("old IS NULL OR sha2(text, 256) <> old_hash")
    behind = history.select("doc", "rev").distinct().join(since, "doc").where("frame IS NULL OR rev > frame").groupBy("doc").agg(F.count("*").alias("behind"))
    met = met.join(behind, "doc", "left")
    none = F.lit(None).cast("string")
    fresh = met.select("doc", "rev", "text", none.alias("newer"), F.lit("tip").alias("whole"))
    frame = F.when(F.col("behind") >= KEYFRAMES, "keyframe")
    demoted = met.where("old IS NOT NULL").select("doc", F.col("old_rev").alias("rev"), F.col("old").alias("text"), F.col("text").alias("newer"), frame.alias("whole"))
    changed = met.where("old IS NOT NULL").select("doc", F.col("old_rev").alias("rev"))
    return history.join(changed, ["doc", "rev"], "left_anti").unionByName(_operations(fresh.unionByName(demoted)))


#: A revision besides its operations; ``id`` is made of its time and hash, ``base`` is what a writer has seen as the tip.
REVISION = "doc string, rev long, id string, parent string, author string, summary string, at timestamp, hash string"


def commit_revisions(history: DataFrame, revisions: DataFrame, working: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(history, revisions, refused) after committing ``working`` (doc, text, author, summary, at, base).

    ``history`` has OPS and ``blob``, ``revisions`` REVISION. A text that is its
    tip's is no revision. One whose ``base`` isn't the tip's id (null: no history
    yet) is refused, and so are all but the earliest where a document comes more
    than once: the rows of ``refused``, with the tip they ran into. New blobs
    continue a document's numbers, so none is used twice.
    """
    from docgraph.functions.values import revision_id

    tips = revisions.groupBy("doc").agg(F.max(F.struct("rev", "id", "hash")).alias("tip"))
    nr = F.row_number().over(W.partitionBy("doc").orderBy("at", "hash"))
    met = working.select("doc", "text", "author", "summary", "at", "base", F.sha2("text", 256).alias("hash")).withColumn("nr", nr).join(tips, "doc", "left")
    met = met.where("tip IS NULL OR hash <> tip.hash")
    good = F.col("base").eqNullSafe(F.col("tip.id")) & (F.col("nr") == 1)
    taken = written(met.where(good).withColumn("rev", F.coalesce(F.col("tip.rev") + 1, F.lit(0).cast("long"))), "commit")
    fresh = taken.select("doc", "rev", revision_id(F.col("at"), F.col("hash")).alias("id"), F.col("tip.id").alias("parent"), "author", "summary", "at", "hash")
    numbered = history.select("doc", F.expr("try_cast(substring(blob, 2) AS long)").alias("n")).groupBy("doc").agg(F.max("n").alias("used"))
    changed = commit(history.drop("blob"), taken.select("doc", "rev", "text"))
    ops = ["doc", "rev", "op_seq"]
    kept = changed.join(history.select(*ops, "blob", F.col("kind").alias("was")), ops, "left")
    same = F.col("was").eqNullSafe(F.col("kind"))
    has = F.col("kind").isin("insert", "replace") & ~same
    nth = F.row_number().over(W.partitionBy("doc", has).orderBy("rev", "op_seq"))
    kept = kept.withColumn("nth", nth).join(numbered, "doc", "left")
    blob = F.when(same, F.col("blob")).when(has, F.concat(F.lit("b"), F.coalesce("used", F.lit(0)) + F.col("nth")))
    refused = met.where(~good).select("doc", "base", F.col("tip.id").alias("tip"), "author", "at")
    return kept.select(*[c for c in history.columns if c != "blob"], blob.alias("blob")), revisions.unionByName(fresh), refused


def numbered_blobs(history: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(operations with ``blob`` in place of their payload, blobs (doc, blob, payload)): b1, b2, ... in a document, oldest revision first, so that later commits never reuse a number."""
    has = F.col("kind").isin("insert", "replace")
    nr = F.row_number().over(W.partitionBy("doc", has).orderBy("rev", "op_seq"))
    h = history.withColumn("blob", F.when(has, F.concat(F.lit("b"), nr)))
    return h.drop("payload"), h.where("blob IS NOT NULL").select("doc", "blob", "payload")


def reconstruct(history: DataFrame) -> DataFrame:
    """(doc, rev, text, ok, fault): every revision rebuilt from the next whole one; ok if its hash agrees, else why not.

    A run of rows is what lies between two whole revisions; a task reads its runs
    one row after the other, as a table for each would cost far more than its texts.
    """
    heads = history.groupBy("doc", "rev").agg(F.max(F.col("kind").isin("tip", "keyframe").cast("int")).alias("whole"))
    segment = F.sum("whole").over(W.partitionBy("doc").orderBy(F.desc("rev")).rowsBetween(W.unboundedPreceding, 0))
    cut = history.join(heads.select("doc", "rev", segment.alias("segment")), ["doc", "rev"])

    def rebuilt(text: str | None, ops: list[Op]) -> str:
        if ops[0][0] in ("tip", "keyframe"):
            return ops[0][3]
        if text is None:
            raise BadHistory("no whole revision to rebuild from")
        if any(kind in ("insert", "replace") and payload is None for kind, _, _, payload in ops):
            raise BadHistory("blob not found")
        return text if ops[0][0] == "same" else patch(text, ops)

    def rebuild(rows: Iterator[tuple]) -> Iterator[tuple]:
        text, before = None, None
        for (doc, segment, rev), own in itertools.groupby(rows, key=lambda r: r[:3]):
            text = text if (doc, segment) == before else None
            before, ops, fault = (doc, segment), list(own), None
            try:
                text = rebuilt(text, [r[4:] for r in ops])
                fault = None if sha(text) == ops[0][3] else "hash differs"
            except BadHistory as x:
                text, fault = None, str(x)
            yield doc, rev, text, fault is None, fault

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(at, PIECE) for b in batches for at in range(0, b.num_rows, PIECE))
        rows = rebuild(row for piece in pieces for row in zip(*(c.to_pylist() for c in piece.columns), strict=True))
        while part := list(itertools.islice(rows, PIECE)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), REBUILT.values(), strict=True)], list(REBUILT))

    cut = cut.select("doc", "segment", F.col("rev").cast("long").alias("rev"), "hash", "kind", "key", "anchor", "payload", "op_seq")
    ranged = cut.repartition("doc", "segment").sortWithinPartitions("doc", "segment", F.desc("rev"), "op_seq").drop("op_seq")
    return ranged.mapInArrow(run, "doc string, rev long, text string, ok boolean, fault string")


def verify(history: DataFrame) -> DataFrame:
    """(doc, checked, bad): revisions rebuilt and hashed."""
    return reconstruct(history).groupBy("doc").agg(F.count("*").alias("checked"), F.sum((~F.col("ok")).cast("long")).alias("bad"))


def verify_history(history: DataFrame, revisions: DataFrame, heads: DataFrame, live: DataFrame | None = None) -> DataFrame:
    """(doc, rev, severity, fault) of all that is wrong with histories whose revision ids may be anything.

    ``history`` has the operations by id (OPS with a text ``rev``), ``revisions``
    (doc, rev, parent), ``heads`` (doc, current), ``live`` (doc, text) the texts
    as they are now. Errors: faults of the chains, and revisions that can't be
    rebuilt or whose hash differs; a live text that isn't the current revision's
    is a warning.
    """
    c = written(chains(revisions, heads), "chains")
    wrong = c.where("fault IS NOT NULL").select("doc", "rev", F.lit("error").alias("severity"), "fault")
    placed = c.where("back IS NOT NULL").select("doc", F.col("rev").alias("id"), (-F.col("back")).alias("rev"))
    ops = history.withColumnRenamed("rev", "id").join(placed, ["doc", "id"]).drop("id")
    broken = reconstruct(ops.select(*[x.split()[0] for x in OPS.split(", ")])).where("NOT ok").join(placed, ["doc", "rev"])
    wrong = wrong.unionByName(broken.select("doc", F.col("id").alias("rev"), F.lit("error").alias("severity"), "fault"))
    if live is not None:
        tips = c.where("back = 0").select("doc", "rev").join(history.select("doc", "rev", "hash").distinct(), ["doc", "rev"])
        dirty = live.select("doc", F.sha2("text", 256).alias("now")).join(tips, "doc").where("now <> hash")
        wrong = wrong.unionByName(dirty.select("doc", "rev", F.lit("warning").alias("severity"), F.lit("uncommitted changes").alias("fault")))
    return wrong


def tile_units(revisions: DataFrame) -> DataFrame:
    """(doc, rev, pos, key, full): units of each text."""

    def run(batches):
        for pdf in batches:
            rows = [(d, r, i, k, full) for d, r, t in zip(pdf["doc"], pdf["rev"], pdf["text"], strict=True) for i, (k, full) in enumerate(tile(t or ""))]
            yield pd.DataFrame(rows, columns=["doc", "rev", "pos", "key", "full"])

    return revisions.select(F.col("doc").cast("string").alias("doc"), F.col("rev").cast("long").alias("rev"), "text").mapInPandas(run, "doc string, rev long, pos long, key string, full string")


def revision_log(revisions: DataFrame) -> DataFrame:
    """Adds ``offset``: 0 for the current revision, -1 for the one before."""
    nr = F.row_number().over(W.partitionBy("doc").orderBy(F.desc("rev")))
    return revisions.withColumn("offset", (1 - nr).cast("long")).withColumn("current", nr == 1)


#: Most revisions of a document that a task follows by itself; rows that a task holds at a time.
FOLLOWED, HELD = 1 << 16, 1 << 20


def followed(links: DataFrame) -> DataFrame:
    """(id, term, d, ring, cyc, on) of links (part, id, jump, w, start), whose parts are whole: pointers are doubled in a task.

    ``term`` is what a node's pointers end at, ``d`` steps on: a node without a
    pointer, or the least of the cycle that they run into, ``ring`` steps long.
    ``cyc``: on that cycle; ``on``: a start leads here.
    """

    def solve(id_: np.ndarray, jump: np.ndarray, w: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(id_)
        id_, jump, w, start = id_[order], jump[order], w[order], start[order]
        own = np.arange(len(id_))
        leads = jump >= 0
        to = np.where(leads, np.searchsorted(id_, jump), own)
        w = np.where(leads, w, 0)
        rounds = len(id_).bit_length()
        f, least, on = to, own, start.copy()
        for _ in range(rounds):
            on[f[on]] = True
            least, f = np.minimum(least, least[f]), f[f]
        cyc = np.zeros(len(id_), bool)
        cyc[f] = True
        cyc &= leads[f]  # what runs into a cycle ends on one; what has no pointer stays where it is
        top = cyc & (least == own)
        f, d = np.where(top, own, to), np.where(top, 0, w)
        for _ in range(rounds):
            d, f = d + d[f], f[f]
        ring = np.where(top, w + d[to], 0)[f]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (id_, id_[f], d, ring, cyc, on)], ["id", "term", "d", "ring", "cyc", "on"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0
        for batch in batches:
            held.append([(c.fill_null(-1) if k == 2 else c).to_numpy(zero_copy_only=False) for k, c in enumerate(batch.columns)])
            size += batch.num_rows
            if size < HELD:
                continue
            whole = [np.concatenate(x) for x in zip(*held, strict=True)]
            cut = int(np.searchsorted(whole[0], whole[0][-1]))  # the last part may go on
            if cut:
                yield solve(*(x[:cut] for x in whole[1:]))
            held = [[x[cut:] for x in whole]]
            size = len(held[0][0])
        if size:
            yield solve(*(np.concatenate(x) for x in list(zip(*held, strict=True))[1:]))

    rows = links.select("part", "id", "jump", "w", "start").repartition("part").sortWithinPartitions("part")
    return rows.mapInArrow(run, "id long, term long, d long, ring long, cyc boolean, on boolean")


def ends_of(links: DataFrame) -> DataFrame:
    """``followed`` for parts of any length.

    Long parts are contracted first: in a round, by a coin that each node throws,
    a quarter of the pointers that are left leave with their nodes, whose
    followers take over where they led to; no two that leave are neighbours. So
    the rounds together move some four times the rows, however long a part is.
    Then the rounds are undone in reverse: what left learns its end from where it
    led to, and what leads to it from those that took over.
    """
    tails = lambda c, k: F.xxhash64(F.col(c), F.lit(k)) % 2 == 0
    sizes = links.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > FOLLOWED)
    long_ = written(sizes.select("part"), "chain-long")
    if not long_.limit(1).count():
        return followed(links)
    rest = links.join(F.broadcast(long_), "part", "left_anti")  # there are few parts that are long
    table, rounds = links.join(F.broadcast(long_), "part", "left_semi").withColumn("via", F.lit(None).cast("long")), []
    while (table.groupBy("part").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > FOLLOWED and len(rounds) < 200:
        k = len(rounds)
        leaves = F.coalesce(~F.col("start") & (F.col("jump") != F.col("id")) & tails("id", k) & ~tails("jump", k), F.lit(False))
        left = table.where(leaves).select("id", "jump", "w")
        stay = table.where(~leaves).drop("via")
        meets = F.coalesce(tails("jump", k), F.lit(False))
        taken = stay.where(meets).join(left.select(F.col("id").alias("via"), F.col("jump").alias("next"), F.col("w").alias("more")), F.col("jump") == F.col("via"), "left")
        taken = taken.select("part", "id", F.coalesce("next", "jump").alias("jump"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w"), "start", "via")
        table = written(taken.unionByName(stay.where(~meets).withColumn("via", F.lit(None).cast("long"))), "chain")
        rounds.append((left, table.where("via IS NOT NULL").select("id", "via")))
    known = written(followed(rest.unionByName(table.drop("via"))), "chain-ends")
    for left, took in reversed(rounds):
        marks = took.join(known.where("cyc OR on").select("id", "cyc", "on"), "id").groupBy(F.col("via").alias("id")).agg(F.max("cyc").alias("cyc"), F.max("on").alias("on"))
        ends = left.join(known.select(F.col("id").alias("jump"), "term", F.col("d").alias("then"), "ring"), "jump").join(marks, "id", "left")
        mark = lambda c: F.coalesce(c, F.lit(False)).alias(c)
        known = known.unionByName(written(ends.select("id", "term", (F.col("w") + F.col("then")).alias("d"), "ring", mark("cyc"), mark("on")), "chain-ends"))
    return known


def chains(revisions: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc, rev, back, fault): how many steps a revision lies behind ``current``, and what is wrong with it.

    From ``revisions`` (doc, rev, parent) and ``heads`` (doc, current), whatever
    the ids look like. ``back`` is null off the chain. Faults: ``missing parent``,
    ``cycle`` (on one, not behind it), ``branch`` (off the chain, but behind it
    comes one that is on it), ``orphan`` (off it, and so is all behind it), and,
    as a row of its own, ``missing current``. Ids are distinct in a document,
    which has one current.

    Revisions are numbered once and followed as numbers (``ends_of``). Steps are
    counted from where pointers end, so that ``back`` is a difference; on a
    cycle, a revision behind its least one is met a round later if the chain
    comes in below it.
    """
    r = written(revisions.select("doc", "rev", "parent").withColumn("id", F.monotonically_increasing_id()), "chain-revisions")
    heads = written(heads.select("doc", "current"), "chain-heads")
    known = r.select("doc", F.col("rev").alias("parent"), F.col("id").alias("jump"))
    starts = heads.select("doc", F.col("current").alias("rev"), F.lit(True).alias("start"))
    here = r.join(known, ["doc", "parent"], "left").join(starts, ["doc", "rev"], "left")
    links = written(here.select(F.xxhash64("doc").alias("part"), "id", "jump", F.lit(1).cast("long").alias("w"), F.col("start").isNotNull().alias("start"), (F.col("parent").isNotNull() & F.col("jump").isNull()).alias("lost")), "chain")
    ends = ends_of(links.drop("lost"))
    out = r.select("doc", "rev", "id").join(ends.join(links.select("id", "start", "lost"), "id"), "id")
    out = written(out.drop("id"), "chain-ends")
    tail = F.min(F.when(F.col("on") & ~F.col("cyc"), F.col("d"))) - 1
    head = out.where("on").groupBy("doc").agg(F.max(F.when(F.col("start"), F.col("term"))).alias("head_term"), F.max(F.when(F.col("start"), F.col("d"))).alias("head_d"), tail.alias("entry"))
    out = out.join(head, "doc", "left")
    again = F.when(F.col("cyc") & (F.col("d") > F.coalesce("entry", "head_d")), F.col("ring")).otherwise(0)
    back = F.when(F.col("on"), F.col("head_d") - F.col("d") + again)
    fault = (
        F.when(F.col("lost"), "missing parent").when(F.col("cyc"), "cycle")
        .when(~F.col("on") & F.col("term").eqNullSafe(F.col("head_term")), "branch").when(~F.col("on"), "orphan")
    )
    gone = heads.join(r.select("doc", F.col("rev").alias("current")), ["doc", "current"], "left_anti").select("doc", F.col("current").alias("rev"), F.lit(None).cast("long").alias("back"), F.lit("missing current").alias("fault"))
    return out.select("doc", "rev", back.cast("long").alias("back"), fault.alias("fault")).unionByName(gone)


def chain_faults(revisions: DataFrame, heads: DataFrame) -> DataFrame:
    """(doc, rev, fault) of ``chains``."""
    return chains(revisions, heads).where("fault IS NOT NULL").select("doc", "rev", "fault")


def resolve_selector(log: DataFrame, selectors: DataFrame) -> DataFrame:
    """(doc, sel, rev): ``-N``, latest, current, or an unambiguous prefix or suffix of a revision id; else null. The log has offset and id."""
    s = F.col("sel")
    offset = F.when(s.isin("latest", "current"), F.lit(0)).when(s.rlike(r"^-\d+$"), s.try_cast("long"))
    met = selectors.join(log, "doc").where(F.when(offset.isNotNull(), F.col("offset") == offset).otherwise(F.col("id").startswith(s) | F.col("id").endswith(s)))
    found = met.groupBy("doc", "sel").agg(F.when(F.count("*") == 1, F.max("rev")).alias("rev"))
    return selectors.join(found, ["doc", "sel"], "left")


def last_distinct_version(units: DataFrame) -> DataFrame:
    """(doc, key, rev): the newest earlier revision in which a current unit's text differs; from (doc, rev, key, full)."""
    tip = units.groupBy("doc").agg(F.max("rev").alias("tip"))
    now = units.join(tip, "doc").where("rev = tip").select("doc", "key", F.col("full").alias("now"))
    return units.join(now, ["doc", "key"]).where(F.col("full") != F.col("now")).groupBy("doc", "key").agg(F.max("rev").alias("rev"))


def truncate_to(history: DataFrame, keep: DataFrame) -> DataFrame:
    """The history without revisions newer than ``keep`` (doc, rev); documents not named stay whole."""
    return history.join(keep.select("doc", F.col("rev").alias("last")), "doc", "left").where("last IS NULL OR rev <= last").drop("last")


def roll_back(history: DataFrame, keep: DataFrame, live: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(history, refused): histories cut after ``keep`` (doc, rev), whose revision becomes the tip, kept whole.

    Refused are documents without that revision (``no such revision``), those
    where it can't be rebuilt (``broken``), and, unless ``live`` is left out,
    those whose live text (doc, text) isn't the tip's (``uncommitted changes``).
    """
    asked = history.join(keep.select("doc"), "doc", "left_semi")
    found = reconstruct(asked).join(keep.select("doc", "rev"), ["doc", "rev"]).select("doc", "rev", "text", "ok")
    tips = asked.where("kind = 'tip'").select("doc", F.col("hash").alias("tip_hash"))
    now = live.select("doc", F.sha2("text", 256).alias("now")) if live is not None else tips.select("doc", F.col("tip_hash").alias("now"))
    reason = F.when(F.col("ok").isNull(), "no such revision").when(~F.col("ok"), "broken").when(F.col("now") != F.col("tip_hash"), "uncommitted changes")
    met = keep.select("doc", "rev").join(found, ["doc", "rev"], "left").join(tips, "doc", "left").join(now, "doc", "left")
    met = written(met.select("doc", "rev", "text", reason.alias("reason")), "roll-back")
    cut = met.where("reason IS NULL")
    older = history.join(cut.select("doc", F.col("rev").alias("last")), "doc", "left").where("last IS NULL OR rev < last").drop("last")
    none = F.lit(None).cast("string")
    tip = cut.select("doc", "rev", F.sha2("text", 256).alias("hash"), F.lit(0).alias("op_seq"), F.lit("tip").alias("kind"), none.alias("key"), none.alias("anchor"), F.col("text").alias("payload"))
    return older.unionByName(tip, allowMissingColumns=True), met.where("reason IS NOT NULL").select("doc", "rev", "reason")


def last_changes(units: DataFrame) -> DataFrame:
    """(doc, key, rev): the last revision before a current unit's text became what it is, of all units at once; from (doc, rev, key, full).

    Runs of equal texts are islands over the revisions that have the unit; what
    came last before the current island is the unit's previous version. Units
    that never changed, or aren't in the newest revision, have no row.
    """
    tips = units.groupBy("doc").agg(F.max("rev").alias("tip"))
    w = W.partitionBy("doc", "key").orderBy("rev")
    u = units.select("doc", "key", "rev", F.xxhash64("full").alias("h"), F.length("full").alias("n"))
    u = u.withColumn("before", F.lag("rev").over(w)).withColumn("changed", F.lag(F.struct("h", "n")).over(w) != F.struct("h", "n"))
    last = u.groupBy("doc", "key").agg(F.max("rev").alias("newest"), F.max(F.when(F.col("changed"), F.struct("rev", "before"))).alias("change"))
    return last.join(tips, "doc").where("newest = tip AND change IS NOT NULL").select("doc", "key", F.col("change.before").alias("rev"))


def change_frequency(history: DataFrame) -> DataFrame:
    """(doc, key, revisions): how many revisions touched a unit."""
    return history.where("key IS NOT NULL").groupBy("doc", "key").agg(F.countDistinct("rev").alias("revisions"))


def author_counts(history: DataFrame, revisions: DataFrame) -> DataFrame:
    """(doc, key, author, revisions): how many revisions of each author touched a unit, and, with a null key, the document.

    A revision's operations say what the next newer one changed, so they are that one's.
    """
    newer = F.lead("author").over(W.partitionBy("doc").orderBy("rev"))
    after = revisions.select("doc", "rev", newer.alias("author"), F.lead("rev").over(W.partitionBy("doc").orderBy("rev")).alias("by"))
    touched = history.where("key IS NOT NULL").select("doc", "rev", "key").distinct().join(after.where("by IS NOT NULL"), ["doc", "rev"])
    units = touched.groupBy("doc", "key", "author").agg(F.countDistinct("by").alias("revisions"))
    whole = revisions.groupBy("doc", "author").agg(F.countDistinct("rev").alias("revisions")).withColumn("key", F.lit(None).cast("string"))
    return units.unionByName(whole)


def parse_history(scanned: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(revisions, ops, blobs, keyframes) of scanned history files: blocks of those types, one operation a line."""
    from docgraph.operators.corpus import tagged

    b = tagged(scanned, "block").where("kind = 'block'")
    attr = lambda k: F.try_element_at("attrs", F.lit(k))
    revs = b.where("type = 'revision'").select("doc", attr("id").alias("rev"), attr("parent").alias("parent"), attr("author").alias("author"), attr("summary").alias("summary"), attr("hash").alias("hash"), attr("newline").alias("newline"), "text")
    lines = revs.select("doc", "rev", F.posexplode(F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x != "")).alias("op_seq", "line"))
    part = lambda rx: F.nullif(F.regexp_extract("line", rx, 1), F.lit(""))
    ops = lines.select(
        "doc", "rev", "op_seq", F.substring_index("line", " ", 1).alias("kind"), part(r"^(?:delete|replace|move)\s+(\S+)").alias("key"), part(r"blob:(\S+)").alias("blob"),
        F.coalesce(part(r"\safter\s+(\S+)$"), part(r"\s(at-start|at-end)$")).alias("anchor"),
    )
    return revs.drop("text"), ops, b.where("type = 'blob'").select("doc", "id", F.col("text").alias("payload")), b.where("type = 'keyframe'").select("doc", attr("id").alias("rev"), F.col("text").alias("content"))


def revert_blocks(corpus: DataFrame, scanned: DataFrame, rebuilt: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, text): the blocks (doc, id) of ``keys`` put back to their text at ``rev``; from rebuilt revisions (doc, rev, text)."""
    from docgraph.operators.corpus import apply_patches

    units = tile_units(rebuilt).select("doc", "rev", F.substring("key", 2, 1 << 20).alias("id"), F.regexp_replace("full", r"\n+$", "").alias("body"))
    return apply_patches(corpus, scanned, keys.join(units, ["doc", "rev", "id"]).select("doc", "id", "body"))


def revert_changed(corpus: DataFrame, scanned: DataFrame, rebuilt: DataFrame, keys: DataFrame) -> DataFrame:
    """(doc, text): the blocks (doc, id) of ``keys`` put back to what they were before their last change; those that never changed stay.

    The live text counts as the newest revision, so changes that aren't committed are the first to go.
    """
    r = rebuilt.select("doc", "rev", "text")
    live = corpus.join(r.groupBy("doc").agg((F.max("rev") + 1).alias("rev")), "doc").select("doc", "rev", "text")
    changes = last_changes(tile_units(r.unionByName(live)))
    asked = keys.select("doc", "id").join(changes.select("doc", F.expr("substring(key, 2)").alias("id"), "rev"), ["doc", "id"])
    return revert_blocks(corpus, scanned, r, asked)
