"""Code graph operators over ``symbols`` and ``edges`` frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Relation kinds of an extract and the edge kinds they become; others are dropped.
KINDS = {"CALLS": "calls", "IMPORTS_FROM": "imports", "INHERITS": "inherits", "IMPLEMENTS": "inherits", "TESTED_BY": "tested-by", "REFERENCES": "references"}
#: Fixed value: names of accessors.
ACCESSOR = r"^(get|set|is)(?![a-z])"


def merge_inputs(*extracts: DataFrame) -> DataFrame:
    """Extracts of several indexers, numbered in order."""
    out = None
    for i, e in enumerate(extracts):
        e = e.withColumn("input_no", F.lit(i))
        out = e if out is None else out.unionByName(e, allowMissingColumns=True)
    return out


def dedupe_symbols(symbols: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each anchor."""
    nr = F.row_number().over(W.partitionBy("anchor").orderBy(*order))
    return symbols.withColumn("nr", nr).where("nr = 1").drop("nr")


def dropped_per_input(symbols: DataFrame, order: list[str]) -> DataFrame:
    nr = F.row_number().over(W.partitionBy("anchor").orderBy(*order))
    return symbols.withColumn("nr", nr).groupBy("input_no").agg(F.sum((F.col("nr") > 1).cast("long")).alias("dropped"))


def widest_definition(defs: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Of a key's records that of the widest line span, the first seen of equals."""
    nr = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(F.col("line_end") - F.col("line_start")), *order))
    return defs.withColumn("nr", nr).where("nr = 1").drop("nr")


def number_collisions(symbols: DataFrame) -> DataFrame:
    """Adds ``anchor``: base, base~2, base~3 by line, then id."""
    nr = F.row_number().over(W.partitionBy("base").orderBy(F.coalesce("line_start", F.lit(0)), "id"))
    return symbols.withColumn("anchor", F.when(nr == 1, F.col("base")).otherwise(F.concat("base", F.lit("~"), nr)))


def map_kind(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in KINDS.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def resolve_edges(raw: DataFrame, symbols: DataFrame) -> DataFrame:
    """kind, from, to, to_text of relations whose source is a symbol; a target that is none is kept as text (its last path segment).

    Symbols are the smaller side: Spark broadcasts them below its threshold and
    shuffles beyond; hot targets are split by adaptive execution.
    """
    known = symbols.select(F.col("anchor"))
    e = raw.withColumn("kind", map_kind(F.col("kind"))).where("kind IS NOT NULL")
    e = e.join(known.withColumnRenamed("anchor", "from"), "from", "left_semi")
    e = e.join(known.select(F.col("anchor").alias("target"), F.lit(True).alias("known")), "target", "left")
    more = [c for c in raw.columns if c not in ("kind", "from", "target")]
    return e.select(
        "kind", "from", F.when(F.col("known"), F.col("target")).alias("to"),
        F.when(F.col("known").isNull(), F.regexp_extract("target", r"([^/]*)$", 1)).alias("to_text"), *more,
    )


def dispatch(edges: DataFrame, impls: DataFrame) -> DataFrame:
    """A call to an interface member gets its implementations (member, impl) as candidates and confidence medium.

    Edges without a target, often most of them, take no part in the join.
    """
    found = impls.groupBy(F.col("member").alias("to")).agg(F.sort_array(F.collect_set("impl")).alias("candidates"))
    met = edges.where("to IS NOT NULL").join(found, "to", "left").unionByName(edges.where("to IS NULL"), allowMissingColumns=True)
    return met.withColumn("confidence", F.when(F.col("candidates").isNotNull(), "medium").otherwise(F.lit("high")))


def links(edges: DataFrame) -> DataFrame:
    """(from, to, kind) and the call's ``site`` and ``confidence``, if there: one table of what a call may reach.

    A resolved call is a row of kind ``call``; each of its candidates is one of
    kind ``candidate``. Other kinds of edges and unresolved calls have none. A
    frame of (from, to) alone, or links themselves, are taken as they are.
    """
    keep = [c for c in ("site", "confidence") if c in edges.columns]
    if "kind" not in edges.columns:
        return edges.where("to IS NOT NULL").select("from", "to", F.lit("call").alias("kind"), *keep)
    calls = edges.where("to IS NOT NULL AND kind IN ('calls', 'call', 'candidate')")
    if "candidates" not in edges.columns:
        return calls.select("from", "to", F.when(F.col("kind") == "candidate", "candidate").otherwise("call").alias("kind"), *keep)
    end = lambda to, kind: F.struct(to.alias("to"), F.lit(kind).alias("kind"))
    ends = F.concat(F.array(end(F.col("to"), "call")), F.transform(F.coalesce("candidates", F.array().cast("array<string>")), lambda c: end(c, "candidate")))
    return calls.select("from", *keep, F.inline(ends)).select("from", "to", "kind", *keep)


def degrees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """anchor, out_degree (calls, unresolved ones included), in_degree (calls and candidates)."""
    out = edges.where("kind = 'calls'").groupBy(F.col("from").alias("anchor")).agg(F.count("*").alias("out_degree"))
    into = links(edges).groupBy(F.col("to").alias("anchor")).agg(F.count("*").alias("in_degree"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return symbols.select("anchor").join(out, "anchor", "left").join(into, "anchor", "left").select("anchor", zero("out_degree"), zero("in_degree"))


def classify(symbols: DataFrame, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """anchor with the flags leaf, accessor, test and entry (called from another container, be it as a candidate, or a program start).

    ``starts`` (anchor) are the program's starts as ``app_entries`` finds them;
    without it those are the symbols named main. Only functions and tests are leaves.
    """
    where = symbols.select("anchor", "container")
    crossing = (
        links(edges).join(where.select(F.col("anchor").alias("from"), F.col("container").alias("a")), "from")
        .join(where.select(F.col("anchor").alias("to"), F.col("container").alias("b")), "to")
        .groupBy(F.col("to").alias("anchor")).agg(F.max((F.col("a") != F.col("b")).cast("int")).alias("crossed"))
    )
    if starts is None:
        starts = symbols.where("name = 'main'")
    starts = starts.select("anchor", F.lit(True).alias("starts")).where("anchor IS NOT NULL").distinct()
    d = symbols.join(degrees(edges, symbols), "anchor").join(crossing, "anchor", "left").join(starts, "anchor", "left")
    leaf = F.coalesce(F.col("kind").isin("Function", "Test"), F.lit(False)) & (F.col("out_degree") == 0) & (F.col("in_degree") >= 1)
    return d.select(
        "anchor", "container", leaf.alias("leaf"), (leaf & F.col("name").rlike(ACCESSOR)).alias("accessor"), (F.col("kind") == "Test").alias("test"),
        ((F.coalesce("crossed", F.lit(0)) == 1) | F.col("starts").isNotNull()).alias("entry"), "out_degree", "in_degree",
    )


def module_index(classified: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.col(c).cast("long"))
    return classified.groupBy("container").agg(F.count("*").alias("methods"), n("entry").alias("entries"), n("test").alias("tests"))


def module_edges(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Resolved calls between different containers, counted as rows."""
    where = symbols.select("anchor", "container")
    ends = (
        edges.where("kind = 'calls' AND to IS NOT NULL")
        .join(where.select(F.col("anchor").alias("from"), F.col("container").alias("a")), "from")
        .join(where.select(F.col("anchor").alias("to"), F.col("container").alias("b")), "to")
    )
    return ends.where("a <> b").groupBy("a", "b").agg(F.count("*").alias("calls"))


#: Key of a first segment that holds several modules, and of one seen from another.
GROUP, OUTSIDE = "g:", "x:"


def rollup_modules(modules: DataFrame, medges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A module overview in two tiers: (nodes, edges) of modules (repo, path, start) and their edges (repo, a, b, calls).

    View '' has a node for each first segment of the paths (a module that is all
    of its segment stands for itself); the view of a segment has its modules and,
    for what calls cross its border, a stub for each other segment. An edge is
    exploded to the views that show it and summed up once. Nodes are (repo, view,
    node, label, external, start, root): roots hold a program start or have no
    edge into them; a view without such a node has all of them as roots.
    """
    seg = lambda p: F.substring_index(p, "/", 1)
    m = modules.select("repo", "path", F.coalesce("start", F.lit(False)).alias("start"), seg("path").alias("seg")).distinct()
    tops = m.groupBy("repo", "seg").agg(F.count("*").alias("n"), F.max((F.col("path") == F.col("seg")).cast("int")).alias("whole"), F.max("start").alias("start"))
    tops = tops.withColumn("key", F.when((F.col("n") == 1) & (F.col("whole") == 1), F.col("seg")).otherwise(F.concat(F.lit(GROUP), "seg")))
    key_of = lambda end: tops.select("repo", F.col("seg").alias(f"{end}_seg"), F.col("key").alias(f"{end}_key"))
    e = medges.select("repo", "a", "b", "calls", seg("a").alias("a_seg"), seg("b").alias("b_seg")).join(key_of("a"), ["repo", "a_seg"]).join(key_of("b"), ["repo", "b_seg"])
    shown = lambda view, end: F.when(F.col(f"{end}_seg") == F.col(view), F.col(end)).otherwise(F.concat(F.lit(OUTSIDE), f"{end}_seg"))
    view = lambda view, a, b: F.struct(view.alias("view"), a.alias("from"), b.alias("to"))
    views = F.array_distinct(F.array(view(F.lit(""), F.col("a_key"), F.col("b_key")), *[view(F.col(v), shown(v, "a"), shown(v, "b")) for v in ("a_seg", "b_seg")]))
    edges = e.select("repo", F.inline(views), "calls").where("from <> to").groupBy("repo", "view", "from", "to").agg(F.sum("calls").alias("calls"))
    nodes = tops.select("repo", F.lit("").alias("view"), F.col("key").alias("node"), F.col("seg").alias("label"), F.lit(False).alias("external"), "start")
    inner = F.when(F.col("path") == F.col("seg"), F.col("seg")).otherwise(F.expr("substring(path, length(seg) + 2)"))
    nodes = nodes.unionByName(m.select("repo", F.col("seg").alias("view"), F.col("path").alias("node"), inner.alias("label"), F.lit(False).alias("external"), "start"))
    ends = edges.select("repo", "view", F.col("from").alias("node")).union(edges.select("repo", "view", "to")).where((F.col("view") != "") & F.col("node").startswith(OUTSIDE)).distinct()
    nodes = nodes.unionByName(ends.select("repo", "view", "node", F.expr(f"substring(node, {len(OUTSIDE) + 1})").alias("label"), F.lit(True).alias("external"), F.lit(False).alias("start")))
    called = edges.select("repo", "view", F.col("to").alias("node"), F.lit(True).alias("called")).distinct()
    nodes = nodes.join(called, ["repo", "view", "node"], "left").withColumn("root", F.col("start") | (F.col("called").isNull() & ~F.col("external")))
    some = nodes.groupBy("repo", "view").agg(F.max("root").alias("some"))
    nodes = nodes.join(some, ["repo", "view"]).select("repo", "view", "node", "label", "external", "start", (F.col("root") | ~F.col("some")).alias("root"))
    return nodes, edges


def home_view(modules: DataFrame) -> DataFrame:
    """(repo, view): the view a repository opens with, that of its only first segment where there is one with several modules, else ''."""
    seg = F.substring_index("path", "/", 1)
    m = modules.select("repo", "path").distinct().groupBy("repo").agg(F.count_distinct(seg).alias("n"), F.min(seg).alias("seg"), F.count("*").alias("modules"), F.min("path").alias("path"))
    alone = (F.col("modules") == 1) & (F.col("path") == F.col("seg"))
    return m.select("repo", F.when((F.col("n") == 1) & ~alone, F.col("seg")).otherwise("").alias("view"))


def unresolved_by_symbol(edges: DataFrame) -> DataFrame:
    return edges.where("to IS NULL AND to_text IS NOT NULL").select("from", "to_text").distinct()


def build_stats(symbols: DataFrame, edges: DataFrame, classified: DataFrame) -> DataFrame:
    """One row of totals: three partial aggregates, each of one row."""
    s = symbols.agg(F.countDistinct("container").alias("containers"), F.count("*").alias("symbols"))
    e = edges.agg(F.count("*").alias("edges"), F.count("to").alias("resolved"))
    c = classified.agg(F.sum(F.col("leaf").cast("long")).alias("leaves"), F.sum(F.col("entry").cast("long")).alias("entries"))
    one = lambda d: d.withColumn("k", F.lit(1))
    return one(s).join(one(e), "k").join(one(c), "k").drop("k")


def edge_quality(edges: DataFrame, cross_file: Column) -> DataFrame:
    """Counts over kind, resolved, cross_file and all their groupings."""
    e = edges.select("kind", F.when(F.col("to").isNotNull(), "yes").otherwise("no").alias("resolved"), F.when(cross_file, "yes").otherwise("no").alias("cross_file"))
    return e.cube("kind", "resolved", "cross_file").agg(F.count("*").alias("n"), F.grouping_id().cast("long").alias("level"))


def flow_criticality(flows: DataFrame, least: float = 0.6) -> DataFrame:
    return flows.groupBy("entry").agg(F.max("criticality").alias("criticality")).where(F.col("criticality") >= least)


def verify_edges(refs: DataFrame, ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The rows of ``refs`` with the ``reason`` why their cell doesn't resolve; null where it does.

    A cell is ``path#id``, the path relative to the row's ``doc`` (without that
    column, to the root), or ``#id`` of the document itself; a ``.member`` suffix
    of the id is ignored. A path out of the root resolves to no document.
    """
    from docgraph.functions.paths import escapes_root
    from docgraph.operators.corpus import relative_target

    cell = F.trim(F.coalesce("cell", F.lit("")))
    written = F.substring_index(cell, "#", 1)
    target = relative_target(F.col("doc"), written) if "doc" in refs.columns else written
    own = F.col("doc") if "doc" in refs.columns else F.lit("")
    cut = refs.withColumn("__d", F.when(~cell.contains("#"), F.lit("")).when(written == "", own).when(~escapes_root(target), target).otherwise(""))
    cut = cut.withColumn("__i", F.substring_index(F.regexp_extract(cell, "#(.*)$", 1), ".", 1))
    known = docs.select(F.col("doc").alias("__d"), F.lit(True).alias("__doc")).distinct()
    found = ids.select(F.col("doc").alias("__d"), F.col("id").alias("__i"), F.lit(True).alias("__id")).distinct()
    reason = (
        F.when(cell == "", "empty cell").when(~cell.contains("#"), "no #")
        .when(F.col("__doc").isNull(), "missing doc").when(F.col("__id").isNull(), "missing id")
    )
    return cut.join(known, "__d", "left").join(found, ["__d", "__i"], "left").select(*refs.columns, reason.alias("reason"))


#: Tables whose from and to cells are references.
REFERENCE_TABLES = ("calls", "called-by", "ref-by")


def reference_cells(scanned: DataFrame) -> DataFrame:
    """(doc, place, cell) of a scanned corpus: from and to of the tables of references, and each reference of a meta ``entry``."""
    from docgraph.operators.corpus import tagged
    from docgraph.operators.tables import read_delimited

    t = tagged(scanned, "block").where(F.col("type") == "table").where(F.col("id").isin(*REFERENCE_TABLES))
    cells = read_delimited(t.select("doc", F.col("id").alias("table_id"), F.col("text").alias("body")))
    place = F.concat(F.lit("#"), "table_id", F.lit(" row "), F.col("row") + 1, F.lit(" "), "name")
    rows = cells.where("name IN ('from', 'to')").select("doc", place.alias("place"), F.col("text").alias("cell"))
    entry = tagged(scanned, "meta").where("id = 'entry'").select("doc", F.lit("meta entry").alias("place"), F.explode(F.split(F.trim("text"), r"\s+")).alias("cell"))
    return rows.unionByName(entry.where("cell <> ''"))


def block_ids(symbols: DataFrame) -> DataFrame:
    """Adds ``block_id``: the slug where it is its container's only one; else the slug and the first 6, 8, ... digits of the anchor's SHA-256 that tell the whole group apart.

    Groups are counted first and joined back, so a common slug isn't gathered.
    """
    lengths = (6, 8, 10, 12)  # 12 digits part all but equal anchors
    s = symbols.withColumn("digest", F.sha2("anchor", 256))
    groups = s.groupBy("container", "slug").agg(F.count("*").alias("members"), *[F.countDistinct(F.substring("digest", 1, n)).alias(f"at{n}") for n in lengths])
    digits = F.lit(64)
    for n in reversed(lengths):
        digits = F.when(F.col(f"at{n}") == F.col("members"), F.lit(n)).otherwise(digits)
    several = groups.where("members > 1").select(F.col("container").alias("c"), F.col("slug").alias("g"), digits.alias("digits"))
    met = s.join(several, F.col("container").eqNullSafe(F.col("c")) & F.col("slug").eqNullSafe(F.col("g")), "left")
    suffix = F.concat("slug", F.lit("-"), F.substring(F.col("digest"), F.lit(1), F.col("digits")))
    return met.withColumn("block_id", F.coalesce(suffix, "slug")).drop("digest", "c", "g", "digits")


def doc_names(containers: DataFrame) -> DataFrame:
    """Adds ``doc_name``: the slug, with -2, -3 for later ones of equal slug; ``index`` is taken."""
    nr = F.row_number().over(W.partitionBy("slug").orderBy("first_seen")) + F.when(F.col("slug") == "index", 1).otherwise(0)
    return containers.withColumn("doc_name", F.when(nr == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), nr)))


#: Fixed value: anchors of methods that compilers make up; they are never roots of their own.
SYNTHETIC = r"<(init|clinit|lambda)>|<unresolvedSignature>"


def roots_of(classified: DataFrame, edges: DataFrame) -> DataFrame:
    """Entries, and symbols that neither a call nor a candidate reaches and no compiler made up; leaves only where a container has nothing else."""
    called = links(edges).select(F.col("to").alias("anchor")).distinct()
    uncalled = classified.join(called, "anchor", "left_anti").where(~F.col("anchor").rlike(SYNTHETIC)).select("anchor")
    every = classified.where("entry").select("anchor").union(uncalled).distinct()
    r = every.join(classified.select("anchor", "container", "leaf"), "anchor")
    all_leaves = r.groupBy(F.col("container").alias("c")).agg(F.min(F.col("leaf").cast("int")).alias("all_leaves")).where("all_leaves = 1")
    return r.join(all_leaves, F.col("container").eqNullSafe(F.col("c")), "left").where(~F.col("leaf") | F.col("all_leaves").isNotNull()).select("container", "anchor")


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that touch no edge."""
    ends = edges.select(F.col("from").alias("anchor")).union(edges.select("to")).distinct()
    return nodes.join(ends, "anchor", "left_anti")


def connected_roots(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """Roots (slice, anchor) that touch an edge of their slice (slice, from, to); all of a slice's roots where none does."""
    ends = edges.select("slice", F.col("from").alias("anchor")).union(edges.select("slice", "to")).distinct().withColumn("touched", F.lit(True))
    met = roots.join(ends, ["slice", "anchor"], "left")
    some = met.where("touched").select("slice").distinct().withColumn("some", F.lit(True))
    return met.join(some, "slice", "left").where("touched OR some IS NULL").select("slice", "anchor")


def compare_models(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, equal, added, removed, errors_before, errors_after, warnings_before, warnings_after, grown) of two scans of a corpus.

    Documents are told by digests of their blocks that don't depend on order of
    rows or lines of text; blocks are compared with each other only within
    documents that differ; one whose blocks only moved has none added or removed.
    ``grown``: it has more errors or warnings than before.
    """
    from docgraph.operators.corpus import tagged

    attrs = F.to_json(F.map_from_entries(F.array_sort(F.map_entries("attrs"))))
    parts = [F.col("depth").cast("string"), "kind", "type", F.col("level").cast("string"), "id", F.array_join(F.array_sort("classes"), " "), attrs, F.rtrim("text")]
    block = F.concat_ws("\x01", *[F.coalesce(x, F.lit("\x02")) for x in parts])
    blocks = lambda s: tagged(s, "block").select("doc", "seq", "parent", block.alias("block"))
    digest = lambda b: b.groupBy("doc").agg(F.sum(F.xxhash64("seq", "parent", "block").cast("decimal(20,0)")).alias("digest"), F.count("*").alias("n"))
    a, b = blocks(before), blocks(after)
    known = lambda d: F.struct(d["digest"], d["n"])
    da, db = digest(a), digest(b)
    met = da.select("doc", known(da).alias("a")).join(db.select("doc", known(db).alias("b")), "doc", "full_outer").select("doc", F.col("a").eqNullSafe(F.col("b")).alias("equal"))
    unlike = met.where("NOT equal").select("doc")
    a, b = (x.join(unlike, "doc", "left_semi").select("doc", "block") for x in (a, b))
    changed = b.exceptAll(a).select("doc", F.lit(1).alias("added"), F.lit(0).alias("removed")).union(a.exceptAll(b).select("doc", F.lit(0), F.lit(1)))
    changed = changed.groupBy("doc").agg(F.sum("added").alias("added"), F.sum("removed").alias("removed"))
    count = lambda s, when: tagged(s, "diagnostic").groupBy("doc").agg(*[F.sum((F.col("severity") == k).cast("long")).alias(f"{k}s_{when}") for k in ("error", "warning")])
    out = met.join(changed, "doc", "left").join(count(before, "before").join(count(after, "after"), "doc", "full_outer"), "doc", "left")
    numbers = ("added", "removed", "errors_before", "errors_after", "warnings_before", "warnings_after")
    out = out.select("doc", "equal", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in numbers])
    return out.withColumn("grown", F.expr("errors_after > errors_before OR warnings_after > warnings_before"))


def diff_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    return new.exceptAll(old).withColumn("change", F.lit("added")).unionByName(old.exceptAll(new).withColumn("change", F.lit("removed")))


def entry_hints(symbols: DataFrame, hints: DataFrame) -> DataFrame:
    """(file, hint, via, anchor): a named hint marks the file's first method (by line, then anchor) of that name or suffix, an unnamed one the file's only method; else anchor is null."""
    s = symbols.select("file", "anchor", "name", "line_start")
    only = s.groupBy("file").agg(F.count("*").alias("methods"), F.min("anchor").alias("anchor")).where("methods = 1")
    h, n = F.col("hint"), F.col("name")
    fits = (n == h) | n.endswith(F.concat(F.lit("::"), h)) | n.endswith(F.concat(F.lit("."), h))
    key = ["file", "hint", "via"]
    each = hints.select(*key).distinct()
    named = each.where("hint IS NOT NULL").join(s, "file").where(fits).groupBy(*key).agg(F.min_by("anchor", F.struct("line_start", "anchor")).alias("anchor"))
    bare = each.where("hint IS NULL").join(only, "file").select(*key, "anchor")
    found = named.unionByName(bare).withColumnsRenamed({k: f"found_{k}" for k in key})
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"found_{k}"))
    return hints.select(*key).join(found, same, "left").select(*key, "anchor")


def app_entries(symbols: DataFrame, hints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Where programs start: (file, anchor, via) of marked methods, and (file, via) of hints that name no method.

    A method named main starts a program by itself; of several hints the first
    by name counts.
    """
    hit = entry_hints(symbols, hints)
    own = symbols.where("name = 'main'").select("file", "anchor", F.lit("main").alias("via"), F.lit(1).alias("rank"))
    marked = hit.where("anchor IS NOT NULL").select("file", "anchor", "via", F.lit(0).alias("rank")).unionByName(own)
    entries = marked.groupBy("file", "anchor").agg(F.min_by("via", F.struct("rank", "via")).alias("via"))
    return entries, hit.where("anchor IS NULL").select("file", "via").distinct()


def who_calls(keys: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(anchor, found, caller, kind) and the site of the call, if edges have it: callers of each key, directly or as a candidate; a missing key isn't one without callers."""
    known = symbols.select("anchor", F.lit(True).alias("found"))
    calls = links(edges).withColumnsRenamed({"to": "anchor", "from": "caller"})
    more = [c for c in ("site",) if c in calls.columns]
    return keys.join(known, "anchor", "left").join(calls, "anchor", "left").select("anchor", F.coalesce("found", F.lit(False)).alias("found"), "caller", "kind", *more)


def open_symbol(keys: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbol of each key (anchor), with ``found``; a missing one has nothing else."""
    return keys.select("anchor").join(symbols.withColumn("found", F.lit(True)), "anchor", "left").withColumn("found", F.coalesce("found", F.lit(False)))


def changed_docs(prev: DataFrame, cur: DataFrame) -> DataFrame:
    """(doc, change): new, removed, changed or unchanged by content hash."""
    both = prev.select("doc", F.col("hash").alias("a")).join(cur.select("doc", F.col("hash").alias("b")), "doc", "full_outer")
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("unchanged")
    return both.select("doc", change.alias("change"))


def language_shares(files: DataFrame, least: float = 0.05) -> DataFrame:
    """(repo, lang, n, share) of the languages with at least that share of a repository's source files."""
    n = files.groupBy("repo", "lang").agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("repo"))).where(F.col("share") >= least)


#: What a file by that name says of its repository's language.
MANIFESTS = {"tsconfig.json": "typescript", "Cargo.toml": "rust", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java", "go.mod": "go"}


def manifest_languages(files: DataFrame) -> DataFrame:
    """(repo, lang) that the manifests among the files (repo, path) name."""
    from docgraph.functions.paths import base

    names = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    return files.select("repo", F.try_element_at(names, base(F.col("path"))).alias("lang")).where("lang IS NOT NULL").distinct()


def detect_languages(files: DataFrame, manifests: DataFrame, least: float = 0.05) -> DataFrame:
    """(repo, lang): languages by share of the files, and those a manifest names."""
    return language_shares(files, least).select("repo", "lang").union(manifests.select("repo", "lang")).distinct()


def top_modules(index: DataFrame, by: str = "methods", k: int = 20) -> DataFrame:
    """The k containers with most methods, entries or tests."""
    return index.orderBy(F.desc(by), "container").limit(k)


def top_module_edges(medges: DataFrame, k: int = 20) -> DataFrame:
    return medges.orderBy(F.desc("calls"), "a", "b").limit(k)
