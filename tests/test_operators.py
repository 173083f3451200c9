"""Scanner, history, walks and streams."""

import random

import pytest
from pyspark.sql import functions as F

from docgraph.operators import corpus, history, intervals, walk
from docgraph.sources.canonical import canonical
from docgraph.sources.markdown import convert
from docgraph.sources.scan import interpolate, references, scan_document
from docgraph.streaming.changes import debounce

DOC = """=== meta
name = X
===
# Title {#top}
See [[#a]], `[[#no]]`, [x](b.mk#c), \\[[#e]] and [^n] for {{name}}.
=== note {#a .k}
inside {{gone}}
==== code {#deep}
[[#raw]]
====
===
## Sub
- [ ] one
- two
[^n]: note
=== odd
"""


def test_scan():
    rows = scan_document("d", DOC)
    of = lambda tag: [r for r in rows if r["tag"] == tag]
    assert [(r["kind"], r.get("type")) for r in of("block")] == [
        ("block", "meta"), ("heading", None), ("paragraph", None), ("block", "note"), ("paragraph", None), ("block", "code"), ("heading", None), ("list", None), ("footnote", "note"), ("block", "odd"),
    ]
    assert {r["id"] for r in of("id")} == {"top", "a", "deep", "sub", "n"}
    assert {(r["ref_kind"], r.get("target_doc"), r["anchor"]) for r in of("ref")} == {("autoref", None, "a"), ("cross", "b.mk", "c"), ("footnote", None, "n")}
    assert {r["code"] for r in of("diagnostic")} == {"unknown-key", "unterminated", "unknown-type"}
    assert next(r["text"] for r in of("block") if r["kind"] == "paragraph").endswith("for X.")
    assert scan_document("e", "") == [] and scan_document("e", None) == []


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("+ a\n1) b\n===note\nx", ["paragraph"]), ("* a\n- b\n1. c\n\n2. d\ne", ["list", "list", "paragraph"]), ("=== text {#t}\n[[#x]]\n===", ["block", "paragraph"]),
        ("=== note {#a}\n=== code\nx\n===\ny\n=== #a", ["block", "block", "paragraph"]), ("==== note\n=== note\nx\n===\n====\ny", ["block", "block", "paragraph", "paragraph"]),
        ("a\n%% h\nb", ["paragraph", "hidden", "paragraph"]), ("a\n[^f]: b", ["paragraph"]), ("#no\n# yes", ["paragraph", "heading"]), ("  - a\n    - b\n - c", ["list"]), ("=== code\n==== \n===", ["block"]),
    ],
)
def test_lines_that_begin_blocks(text, kinds):
    assert [r["kind"] for r in scan_document("d", text) if r["tag"] == "block"] == kinds


def test_normal_form_is_its_own():
    r = random.Random(3)
    parts = [
        "# A {{k}} {#x .c key=1.50 b=\"q w\" flag}", "## B `c` D", "para\nline {{no}} \\{{k}}", "=== note {#n}\ninner {{k}}\n\n- a\n  - b\n\n- c\n===", "==== note\n=== code {lang=x}\n=\n===\n====",
        "=== meta\nk = 1.0\nv = \"true\"\nw = \"a b\"\n===", "- [ ] t\n- [x] u\n  1. q\n  2. w\n3. r", "1. a\n1. b", "%% hidden", "[^f]: foot {{w}}", "=== odd\nxx", "", "* s\n\n\n* t\nend", "=== text\n===",
    ]
    shape = lambda t: [(x["tag"], x.get("kind"), x.get("type"), x.get("id"), x.get("ref_kind"), x.get("anchor")) for x in scan_document("d", t) if x["tag"] in ("block", "item", "ref")]
    for _ in range(500):
        text = "\n".join(r.choice(parts) for _ in range(r.randrange(7)))
        once = canonical(text)
        assert canonical(once) == once and shape(once) == shape(text)


def test_conversion_keeps_what_markdown_says():
    text, notes = convert("---\na: b c\n- x\n---\nT\n===\n\n---\n> q {{a}}\n\n```mermaid\nx\n```\n# `a` b\n[^1]: foot\n  more\n")
    assert text == "=== meta\na=\"b c\"\n===\n\n# T\n\n=== note {#note-1}\nq \\{{a}}\n===\n\n=== diagram {#diagram-1 format=mermaid}\nx\n===\n# `a` b {#a-b}\n=== note {#1}\nfoot\nmore\n===\n"
    assert notes == ["frontmatter line not converted: - x", "dropped thematic break at line 8"]
    assert convert("") == ("\n", []) and convert(None) == ("\n", [])


def test_references_and_variables():
    assert list(references("[a](http://x) [b](#c) [d](e)")) == [("internal", None, "c"), ("cross", "e", None)]
    assert interpolate("{{a}} `{{a}}` \\{{a}} {{b}}", {"a": "{{b}}"}) == ("{{b}} `{{a}}` \\{{a}} {{b}}", ["b"])


def test_check_and_patches(spark):
    c = spark.createDataFrame([("a.mk", DOC), ("b.mk", "# C {#c}\ntext\n# C {#c}")], "doc string, text string")
    from docgraph.sources.scan import scan_corpus

    s = scan_corpus(c)
    codes = {(r.doc, r.code) for r in corpus.check_corpus(s, c).collect()}
    assert ("b.mk", "duplicate-id") in codes and not any(x[1].startswith("unresolved") for x in codes)
    p = spark.createDataFrame([("b.mk", "c", "# New {#c}")], "doc string, id string, body string")
    new = {r.doc: r.text for r in corpus.apply_patches(c, s, p).collect()}
    assert new["a.mk"] == DOC and new["b.mk"].startswith("# New {#c}")
    assert corpus.rejected_patches(s, scan_corpus(corpus.apply_patches(c, s, p))).count() == 0


def test_history_round_trip():
    r = random.Random(1)
    units = ["# a {#a}\nx\n", "=== code {#b}\n\ny\n===\n", "same\n", "p q\nr\n", "other\n\n"]
    for _ in range(300):
        old, new = ("\n".join(r.choice(units) for _ in range(r.randrange(6))) for _ in range(2))
        assert "".join(f for _, f in history.tile(old)) == old
        assert history.patch(new, history.diff(new, old)) == old


def test_moves_and_anchors():
    text = "=== note {#a}\nA\n===\n\nB.\n\nC.\n"
    b, c = (k for k, _ in history.tile(text)[1:])
    assert history.patch(text, [("move", "#a", c, None)]) == "B.\n\nC.\n=== note {#a}\nA\n===\n\n"
    assert history.patch(text, [("insert", None, "at-end", "D."), ("move", b, "at-start", None)]) == "B.\n\n=== note {#a}\nA\n===\n\nC.\nD."
    for bad in ([("delete", "#x", None, None)], [("move", "#x", "at-end", None)], [("insert", None, "#x", "y")]):
        with pytest.raises(history.BadHistory):
            history.patch(text, bad)


@pytest.mark.parametrize("frames", [2, 32])
def test_commits(spark, frames):
    text = lambda i: "\n\n".join(f"p{j * (i % 3)}" for j in range(i + 1))
    revs = spark.createDataFrame([("d", i, text(i)) for i in range(6)] + [("e", 0, "x")], "doc string, rev long, text string")
    h = history.commit_chain(revs, keyframes=frames)
    h = history.commit(h, spark.createDataFrame([("d", 6, text(6)), ("e", 1, "x"), ("new", 0, "y")], "doc string, rev long, text string"))
    out = {(r.doc, r.rev): (r.text, r.ok) for r in history.reconstruct(h).collect()}
    assert out == {("d", i): (text(i), True) for i in range(7)} | {("e", 0): ("x", True), ("new", 0): ("y", True)}


def test_history_notices_changes(spark):
    revs = spark.createDataFrame([("d", i, "\n\n".join(f"p{j}" for j in range(i + 1))) for i in range(4)], "doc string, rev long, text string")
    h = history.commit_chain(revs)
    assert history.verify(h).first()[1:] == (4, 0)
    bad = h.withColumn("payload", F.when(F.col("kind") == "tip", F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    assert history.verify(bad).first().bad >= 1


def test_walks(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "b"), ("d", None)], "from string, to string")
    roots = spark.createDataFrame([("a",), ("x",)], "root string")
    got = {(r.root, r.node): r.depth for r in walk.walk(e, roots, depth=2).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2, ("x", "x"): 0, ("x", "b"): 1, ("x", "c"): 2}
    assert {r.node for r in walk.impact(e, spark.createDataFrame([("d",)], "root string")).collect()} == {"a", "b", "c", "d", "x"}
    nodes = walk.walk(e, roots.where("root = 'a'"), depth=5)
    lay = {r.node: r.layer for r in walk.layers(walk.slice_edges(e, nodes, 9).select("root", "from", "to")).collect()}
    assert lay == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert walk.walk(e, roots, depth=5, cap=2).count() == 4


def test_intervals(spark):
    defs = spark.createDataFrame([("f", 1, 1000, "outer"), ("f", 10, 20, "inner"), ("f", 10, 20, "inner2")], "file string, start int, end int, symbol string")
    occ = spark.createDataFrame([("f", 15, "r1"), ("f", 500, "r2"), ("f", 2000, "r3"), ("f", 15, "inner"), ("g", 1, "r4")], "file string, line int, ref string")
    got = {r.ref: r.symbol for r in intervals.attribute_calls(occ, defs).collect()}
    assert got == {"r1": "inner", "r2": "outer"}
    asof = {r.ref: r.symbol for r in intervals.attribute_calls_asof(occ, defs).collect()}
    assert asof["r2"] == "inner2" and "r4" not in asof


def test_occurrences_of_generated_files(spark):
    """A component's generated file: a method, a generated helper, a call from the template, one from nowhere."""
    from docgraph.sources.exchange import from_occurrences

    occ = [
        ("gen.ts", "p/A#save().", "definition", 10, 10, 14), ("gen.ts", "p/$$render().", "definition", 1, 1, 40), ("b.ts", "p/b/run().", "definition", 1, 1, 9), ("b.ts", "p/B#x.", "definition", 20, 20, 20),
        ("gen.ts", "p/b/run().", "reference", 12, None, None), ("gen.ts", "p/A#save().", "reference", 30, None, None), ("gen.ts", "p/A#save().", "reference", 35, None, None), ("gen.ts", "p/__VLS_f().", "reference", 13, None, None),
        ("b.ts", "q/C#`<constructor>`().", "reference", 3, None, None), ("b.ts", "p/A#save().", "reference", 4, None, None), ("b.ts", "p/B#x.", "reference", 5, None, None), ("b.ts", "p/b/run().", "reference", 6, None, None),
    ]
    o = spark.createDataFrame(occ, "file string, symbol string, role string, line int, start int, end int")
    lines = spark.createDataFrame([("gen.ts", g, "A.vue", n) for g, n in ((10, 3), (12, 5), (13, 6), (14, 7), (30, 22), (35, 40))], "file string, line int, orig_file string, orig_line int")
    regions = spark.createDataFrame([("A.vue", 20, 30, "A")], "file string, start int, end int, component string")
    rels = spark.createDataFrame([("p/b/run().", "p/A#save().")], "symbol string, target string")
    symbols, edges = from_occurrences(o, rels, lines, regions)
    assert {(r.anchor, r.name, r.file, r.line_start, r.line_end) for r in symbols.where("kind = 'Function'").collect()} == {
        ("p/A#save().", "A.save", "A.vue", 3, 7), ("p/b/run().", "run", "b.ts", 1, 9), ("sfc:A.vue#template", "A.template", "A.vue", 20, 30),
    }
    assert {(r["from"], r["to"], r.to_text, r.confidence, r.site.file, r.site.line) for r in edges.collect()} == {
        ("p/A#save().", "p/b/run().", None, "high", "A.vue", 5), ("sfc:A.vue#template", "p/A#save().", None, "medium", "A.vue", 22),
        ("p/b/run().", None, "C.new", "low", "b.ts", 3), ("p/b/run().", "p/A#save().", None, "medium", "b.ts", 4),
    }


def test_occurrences_without_spans(spark):
    from docgraph.sources.exchange import from_occurrences

    occ = [("f", "p/a().", "definition", 1, 1, 1), ("f", "p/b().", "definition", 300, 300, 300), ("f", "p/b().", "reference", 299, None, None), ("f", "p/a().", "reference", 700, None, None)]
    o = spark.createDataFrame(occ, "file string, symbol string, role string, line int, start int, end int")
    _, edges = from_occurrences(o, spark.createDataFrame([], "symbol string, target string"))
    assert {(r["from"], r["to"]) for r in edges.collect()} == {("p/a().", "p/b()."), ("p/b().", "p/a().")}


def test_debounce_stream(spark, tmp_path):
    rows = [("r", f"2024-01-01 00:00:{s:02d}") for s in (0, 10, 20)] + [("r", "2024-01-01 00:05:00"), ("r", "2024-01-01 02:00:00")]
    spark.createDataFrame(rows, "repo string, t string").select("repo", F.col("t").cast("timestamp").alias("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("repo string, ts timestamp").parquet(f"{tmp_path}/in")
    q = debounce(stream, "30 seconds").writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r.n for r in spark.table("bursts").collect()) == [1, 3]


@pytest.mark.parametrize("name", ["d3_summary_by", "c9_verify_edges", "b13_section_spans"])
def test_registered_queries_run(spark, name):
    import __spark_entry__ as entry

    assert entry.queries()[name](spark, "/root/testdata/sf0.001").limit(1).count() == 1
