"""Checks and lookups over a scanned corpus; all joins are by document and id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions.paths import directory, normalize
from docgraph.storage import written


def read_corpus(spark, path: str) -> DataFrame:
    """(doc, text) of whole text files, line ends as newlines."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def tagged(scanned: DataFrame, tag: str) -> DataFrame:
    return scanned.where(F.col("tag") == tag)


def list_ids(scanned: DataFrame) -> DataFrame:
    """(doc, id, line, kind, level, text): the first definition of each id."""
    nr = F.row_number().over(W.partitionBy("doc", "id").orderBy("line"))
    return tagged(scanned, "id").withColumn("nr", nr).where("nr = 1").select("doc", "id", "line", "kind", "level", "text")


def duplicate_ids(scanned: DataFrame) -> DataFrame:
    """(doc, id, line, first_line) of each later definition."""
    w = W.partitionBy("doc", "id")
    d = tagged(scanned, "id").withColumn("nr", F.row_number().over(w.orderBy("line"))).withColumn("first_line", F.min("line").over(w))
    return d.where("nr > 1").select("doc", "id", "line", "first_line")


def unresolved_internal(scanned: DataFrame) -> DataFrame:
    ids = tagged(scanned, "id").select("doc", F.col("id").alias("anchor")).distinct()
    refs = tagged(scanned, "ref").where("target_doc IS NULL AND anchor IS NOT NULL").select("doc", "line", "ref_kind", "anchor")
    return refs.join(ids, ["doc", "anchor"], "left_anti")


def relative_target(doc: Column, target: Column) -> Column:
    base = directory(doc)
    return normalize(F.when((base == "(root)") | target.startswith("/"), target).otherwise(F.concat(base, F.lit("/"), target)))


def unresolved_cross(scanned: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, line, ref_kind, written, target, anchor, reason): a missing document, or an anchor it doesn't have; a reference without anchor asks for the document alone."""
    ids = tagged(scanned, "id").select(F.col("doc").alias("target"), F.col("id").alias("anchor"), F.lit(True).alias("has_id")).distinct()
    known = docs.select(F.col("doc").alias("target"), F.lit(True).alias("has_doc")).distinct()
    refs = tagged(scanned, "ref").where("target_doc IS NOT NULL").select(
        "doc", "line", "ref_kind", F.col("target_doc").alias("written"), relative_target(F.col("doc"), F.col("target_doc")).alias("target"), "anchor"
    )
    reason = F.when(F.col("has_doc").isNull(), NO_DOCUMENT).when(F.col("anchor").isNotNull() & F.col("has_id").isNull(), "unresolved reference")
    return refs.join(known.hint("merge"), "target", "left").join(ids, ["target", "anchor"], "left").select("doc", "line", "ref_kind", "written", "target", "anchor", reason.alias("reason")).where("reason IS NOT NULL")


NO_DOCUMENT = "cannot resolve document"


def cross_findings(cross: DataFrame, *keep: str) -> DataFrame:
    """Diagnostics of the rows of ``unresolved_cross``: a code graph that isn't found is a warning, all else an error."""
    embed = F.col("ref_kind") == "embed"
    gone = F.concat(F.lit(NO_DOCUMENT + " `"), "written", F.lit("`"))
    message = F.when(embed, F.concat(F.lit("code graph: "), gone)).when(F.col("reason") == NO_DOCUMENT, gone).otherwise(F.concat(F.lit("unresolved reference `"), "written", F.lit("#"), "anchor", F.lit("`")))
    return cross.select(
        "doc", "line", F.when(embed, "warning").otherwise("error").alias("severity"), F.when(embed, "graph-src").otherwise("unresolved-cross").alias("code"), message.alias("message"), *keep
    )


def backlinks(scanned: DataFrame) -> DataFrame:
    """(target, id, doc, line): who refers to an id; rows, never a list."""
    ids = list_ids(scanned).select(F.col("doc").alias("target"), "id")
    refs = tagged(scanned, "ref").select("doc", "line", F.when(F.col("target_doc").isNull(), F.col("doc")).otherwise(relative_target(F.col("doc"), F.col("target_doc"))).alias("target"), F.col("anchor").alias("id"))
    return refs.join(ids, ["target", "id"])


def doc_meta(scanned: DataFrame) -> DataFrame:
    """(doc, key, value): later entries win."""
    return tagged(scanned, "meta").groupBy("doc", F.col("id").alias("key")).agg(F.max_by("text", "line").alias("value"))


def section_spans(scanned: DataFrame) -> DataFrame:
    """(doc, id, level, start, stop): a heading's section ends before the next heading of its level or a higher one in the same scope; start and stop are lines, stop is null at the scope's end."""
    h = tagged(scanned, "block").where("kind = 'heading'").select("doc", "parent", "id", "level", "line")
    later = W.partitionBy("doc", "parent").orderBy("line").rowsBetween(1, W.unboundedFollowing)
    stop = F.lit(None).cast("int")
    for k in range(6, 0, -1):
        stop = F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("line"))).over(later)).otherwise(stop)
    return h.select("doc", "id", "level", F.col("line").alias("start"), stop.alias("stop"))


def get_blocks(corpus: DataFrame, scanned: DataFrame, keys: DataFrame, head: bool = False) -> DataFrame:
    """(doc, id, body) of many (doc, id) at once: a heading gives its section, a block its lines; ``head`` the first line."""
    heads = section_spans(scanned).select("doc", "id", "start", "stop")
    others = tagged(scanned, "block").where("kind <> 'heading' AND id IS NOT NULL").select("doc", "id", F.col("line").alias("start"), (F.col("end_line") + 1).alias("stop"))
    spans = heads.unionByName(others).groupBy("doc", "id").agg(F.min(F.struct("start", "stop")).alias("s")).select("doc", "id", "s.*")
    # a document's spans first, so that its text is joined and cut into lines once, however many ids are asked for
    asked = keys.select("doc", "id").join(spans, ["doc", "id"]).groupBy("doc").agg(F.collect_list(F.struct("id", "start", "stop")).alias("asked"))
    cut = corpus.join(asked, "doc").select("doc", F.split("text", "\n").alias("lines"), "asked")
    n = lambda s: F.lit(1) if head else F.coalesce(s["stop"] - s["start"], F.size("lines"))
    bodies = F.transform("asked", lambda s: F.struct(s["id"].alias("id"), F.array_join(F.slice("lines", s["start"], n(s)), "\n").alias("body")))
    return cut.select("doc", F.inline(bodies))


def check_corpus(scanned: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """(doc, line, severity, code, message): every rule's rows. Without ``docs``, the corpus to look in, cross references are only warned of.

    ``scanned`` is read once for each rule, so it should be written.
    """
    from docgraph.operators import checks

    row = lambda d, severity, code, message: d.select("doc", "line", F.lit(severity).alias("severity"), F.lit(code).alias("code"), message.alias("message"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    c = F.col
    found = tagged(scanned, "diagnostic").select("doc", "line", "severity", "code", c("text").alias("message"))
    found = found.unionByName(row(duplicate_ids(scanned), "error", "duplicate-id", text("duplicate id `#", c("id"), "` (first defined at line ", c("first_line"), ")")))
    what = F.when(c("ref_kind") == "footnote", text("footnote `[^", c("anchor"), "]`")).otherwise(text("reference `#", c("anchor"), "`"))
    found = found.unionByName(row(unresolved_internal(scanned), "error", "unresolved", text("unresolved ", what)))
    if docs is None:
        cross = tagged(scanned, "ref").where("target_doc IS NOT NULL AND ref_kind <> 'embed'")
        message = text("cross-document reference `", F.concat_ws("#", "target_doc", "anchor"), "` not checked (no document resolver)")
        found = found.unionByName(row(cross, "warning", "unchecked-cross", message))
    else:
        found = found.unionByName(cross_findings(unresolved_cross(scanned, docs)))
    facts = written(checks.table_facts(scanned), "table-facts")
    return found.unionByName(checks.table_findings(facts)).unionByName(checks.chart_checks(scanned, facts))


def pipe_table(body: Column, sep: Column) -> Column:
    """A delimited body as a pipe table."""
    cells = lambda x: F.transform(F.split(x, sep), lambda c: F.trim(c))
    line = lambda parts: F.concat(F.lit("| "), F.array_join(parts, " | "), F.lit(" |"))
    lines = F.filter(F.split(body, "\n"), lambda x: F.trim(x) != "")
    rule = lambda x: line(F.transform(cells(x), lambda _: F.lit("---")))
    drawn = F.transform(lines, lambda x, i: F.when(i == 0, F.concat(line(cells(x)), F.lit("\n"), rule(x))).otherwise(line(cells(x))))
    return F.array_join(drawn, "\n")


def export_markdown(scanned: DataFrame) -> DataFrame:
    """(doc, text, notes): blocks as Markdown in order, meta as front matter, and notes of what is lost."""
    b = tagged(scanned, "block").where("parent = 0")
    fence = lambda lang, body: F.concat(F.lit("```"), lang, F.lit("\n"), body, F.lit("\n```"))
    attr = lambda k: F.coalesce(F.try_element_at("attrs", F.lit(k)), F.lit(""))
    typed, kind = F.col("type"), F.col("kind")
    hidden = (attr("hidden") == "true") & kind.isin("block", "heading")
    chart = (typed == "diagram") & attr("format").endswith("-chart")
    known = typed.isin("note", "text", "meta", "code", "diagram", "math", "table", "output")
    described = F.array_join(F.filter(F.transform(F.array(*[F.lit(k) for k in ("type", "data", "x", "y", "series")]), lambda k: F.concat(k, F.lit("="), F.try_element_at("attrs", k))), lambda x: x.isNotNull()), " ")
    delimited = attr("format").isin("csv", "tsv")
    body = (
        F.when(hidden | (kind == "hidden") | ((kind == "block") & (typed == "meta")), None)
        .when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text"))
        .when(kind == "footnote", F.concat(F.lit("[^"), "id", F.lit("]: "), "text"))
        .when(kind == "list", None)
        .when(kind != "block", F.col("text"))
        .when(typed == "code", fence(attr("lang"), F.col("text"))).when(typed == "math", F.concat(F.lit("$$\n"), "text", F.lit("\n$$"))).when(typed == "output", fence(F.lit(""), F.col("text")))
        .when(chart, fence(attr("format"), described)).when(typed == "diagram", fence(attr("format"), F.col("text")))
        .when((typed == "table") & delimited, pipe_table(F.col("text"), F.when(attr("format") == "tsv", "\t").otherwise(","))).when(typed.isin("table", "text"), F.col("text"))
        .when(typed == "note", F.regexp_replace(F.regexp_replace("text", "(?m)^", "> "), "(?m)^> $", ">"))
        .otherwise(fence(typed, F.col("text")))
    )
    note = lambda when, message: F.when(when, message)
    lost = F.array_compact(F.array(
        note(hidden & (kind == "block"), F.lit("`{hidden}` block(s) dropped (not part of the rendered output)")), note(hidden & (kind == "heading"), F.lit("hidden heading dropped")),
        note(~hidden & (kind == "heading") & F.col("id").isNotNull(), F.lit("heading id/attributes dropped (Markdown has no attribute syntax)")),
        note(~hidden & chart, F.concat(F.lit("`"), attr("format"), F.lit("` block(s) cannot render in Markdown; emitted a descriptor"))),
        note(~hidden & (typed == "table") & (attr("src") != ""), F.concat(F.lit("table from external source `"), attr("src"), F.lit("` is not inlined; emitted header only"))),
        note(~hidden & (kind == "block") & ~known, F.concat(F.lit("unknown block type `"), typed, F.lit("` emitted as a fenced code block"))),
    ))
    items = tagged(scanned, "item").groupBy("doc", "seq").agg(F.array_sort(F.collect_list(F.struct("line", "depth", "kind", "text"))).alias("items"))
    box = lambda x: F.when(x["kind"] == "done", "[x] ").when(x["kind"] == "open", "[ ] ").otherwise("")
    listed = F.array_join(F.transform("items", lambda x: F.concat(F.repeat(F.lit("  "), x["depth"]), F.lit("- "), box(x), x["text"])), "\n")
    b = b.select("doc", "seq", "kind", body.alias("body"), lost.alias("lost")).join(items, ["doc", "seq"], "left")
    b = b.withColumn("body", F.when(F.col("kind") == "list", listed).otherwise(F.col("body")))
    parts = F.array_sort(F.collect_list(F.when(F.col("body").isNotNull() & (F.col("body") != ""), F.struct("seq", "body"))))
    out = b.groupBy("doc").agg(F.array_join(F.transform(parts, lambda x: x["body"]), "\n\n").alias("body"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("lost")))).alias("notes"))
    value = F.when(F.col("value").rlike(r"^[\w .,/@-]+$"), F.col("value")).otherwise(F.concat(F.lit('"'), F.replace("value", F.lit('"'), F.lit('\\"')), F.lit('"')))
    meta = doc_meta(scanned).groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", value.alias("value")))), lambda x: F.concat(x["key"], F.lit(": "), x["value"])), "\n").alias("front"))
    front = F.when(F.col("front").isNotNull(), F.concat(F.lit("---\n"), "front", F.lit("\n---\n\n"))).otherwise("")
    return out.join(meta, "doc", "left").select("doc", F.concat(front, "body", F.lit("\n")).alias("text"), "notes")


def apply_patches(corpus: DataFrame, scanned: DataFrame, patches: DataFrame) -> DataFrame:
    """(doc, text): blocks (doc, id) replaced by ``body``, all of a document at once.

    Lines outside of patched spans stay; a span's first line carries the new body.
    """
    heads = section_spans(scanned).select("doc", "id", "start", "stop")
    others = tagged(scanned, "block").where("kind <> 'heading' AND id IS NOT NULL").select("doc", "id", F.col("line").alias("start"), (F.col("end_line") + 1).alias("stop"))
    spans = heads.unionByName(others).join(patches, ["doc", "id"]).groupBy("doc").agg(F.collect_list(F.struct("start", "stop", "body")).alias("spans"))
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).alias("at"), x.alias("line")))

    def replaced(s: Column) -> Column:
        inside = F.filter("spans", lambda p: (p["start"] <= s["at"]) & (F.coalesce(p["stop"], F.lit(1 << 30)) > s["at"]))
        return F.when(F.size(inside) == 0, s["line"]).when(F.get(inside, F.lit(0))["start"] == s["at"], F.get(inside, F.lit(0))["body"])

    joined = corpus.join(spans, "doc", "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.array_join(F.transform(lines, replaced), "\n"))
    return joined.select("doc", text.alias("text"))


def rejected_patches(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, id): ids that an edit dropped; such documents' patches aren't taken."""
    ids = lambda s: tagged(s, "id").select("doc", "id").distinct()
    return ids(before).join(ids(after), ["doc", "id"], "left_anti")


def guarded_patches(corpus: DataFrame, scanned: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(texts (doc, text), refused (doc, id, reason)): patches (doc, id, body) taken a document at a time, or not at all.

    Refused are the patches of a document that has no block of one's id (``no
    block``), whose new text has errors by any rule (``errors``), or that loses
    the id of a patch (``target lost``) or of another block (``id lost``).
    ``scanned`` is that of the whole corpus, as cross references look in it.
    """
    from docgraph.sources.scan import scan_corpus

    ids = lambda s: tagged(s, "id").select("doc", "id").distinct()
    docs = patches.select("doc").distinct()
    before = written(scanned.join(docs, "doc", "left_semi"), "scan-before")
    texts = written(apply_patches(corpus.join(docs, "doc", "left_semi"), before, patches), "patched")
    after = written(scan_corpus(texts), "scan-after")
    others = tagged(scanned, "id").join(docs, "doc", "left_anti")
    found = check_corpus(written(after.unionByName(others), "scan-patched"), corpus).join(docs, "doc", "left_semi")
    lost = ids(before).join(ids(after), ["doc", "id"], "left_anti")
    aimed = patches.select("doc", "id").distinct()
    fault = lambda d, order, reason: d.select("doc", F.struct(F.lit(order).alias("order"), F.lit(reason).alias("reason")).alias("fault"))
    faults = (
        fault(aimed.join(ids(before), ["doc", "id"], "left_anti"), 0, "no block").unionByName(fault(found.where("severity = 'error'"), 1, "errors"))
        .unionByName(fault(lost.join(aimed, ["doc", "id"], "left_semi"), 2, "target lost")).unionByName(fault(lost.join(aimed, ["doc", "id"], "left_anti"), 3, "id lost"))
    )
    first = written(faults.groupBy("doc").agg(F.min("fault").alias("fault")), "patch-faults")
    return texts.join(first, "doc", "left_anti"), aimed.join(first, "doc").select("doc", "id", F.col("fault.reason").alias("reason"))
