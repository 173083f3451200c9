"""Streaming checks, histories of arriving versions, debounced changes, published tables."""

import pytest
from pyspark.sql import functions as F

from docgraph.storage import Conflict, name_version, publish, published, scratch, shared_dir, written
from docgraph.streaming.arrivals import Checker, Recorder
from docgraph.streaming.changes import check_stream, debounce
from docgraph.streaming.keyed import KeyedTable


def test_check_stream(spark, tmp_path):
    spark.createDataFrame([("a", "# T {#t}\n[[#t]] [[#gone]] [[#later]]\n=== odd\n")], "doc string, text string").write.parquet(f"{tmp_path}/in")
    ids = spark.createDataFrame([("a", "t"), ("a", "later")], "doc string, id string")
    stream = spark.readStream.schema("doc string, text string").parquet(f"{tmp_path}/in")
    q = check_stream(stream, ids).writeStream.format("memory").queryName("found").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.line, r.code) for r in spark.table("found").collect()) == [(2, "unresolved"), (3, "unknown-type"), (3, "unterminated")]


def test_checks_remember_documents(spark, tmp_path):
    """Three batches of a stream: references wait for their document, a new form of one resolves and breaks others' references, and all rules apply."""
    schema = "doc string, text string, ts long"
    batches = [
        [("d/a", "# A {#a}\n[x](b#b1) [y](../c#c1)\n", 1), ("d/a", "# old {#a}\n", 0), ("t", "=== table {#t compute=\"c = zz * 2\"}\n| a |\n|---|\n| 1 |\n===\n=== diagram {format=x-chart data=#t type=radar}\n===\n", 1)],
        [("d/b", "# B {#b1}\n", 2), ("c", "# C {#c1}\n# Again {#c1}\n", 2)],
        [("d/b", "# B {#b2}\n", 3), ("t", "=== table {#t}\n| a |\n|---|\n| 1 |\n===\n", 3), ("none", None, 3)],
    ]
    checker, said = Checker(spark, f"{tmp_path}/state", buckets=4), []

    def on_batch(df, _):
        said.append(sorted((r.change, r.doc, r.code, r.message) for r in checker.check_batch(df).collect()))

    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        q = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None and len(said) == k + 1
    chart = "chart: unknown type `radar` (supported: bar, line, area, pie, scatter; use format=vega-lite for others)"
    assert said[0] == [
        ("found", "d/a", "unresolved-cross", "cannot resolve document `../c`"), ("found", "d/a", "unresolved-cross", "cannot resolve document `b`"),
        ("found", "t", "chart", chart), ("found", "t", "compute", "compute `c`: unknown column `zz`"),
    ]
    assert said[1] == [
        ("found", "c", "duplicate-id", "duplicate id `#c1` (first defined at line 1)"),
        ("resolved", "d/a", "unresolved-cross", "cannot resolve document `../c`"), ("resolved", "d/a", "unresolved-cross", "cannot resolve document `b`"),
    ]
    assert said[2] == [("found", "d/a", "unresolved-cross", "unresolved reference `b#b1`"), ("resolved", "t", "chart", chart), ("resolved", "t", "compute", "compute `c`: unknown column `zz`")]
    assert sorted((r.doc, r.code) for r in checker.findings.read().collect()) == [("c", "duplicate-id"), ("d/a", "unresolved-cross")]


def test_late_and_tied_versions(spark, tmp_path):
    """Versions 1 and 3, then 2, another 3 and 4, then 3 once more and a return: all are kept between their neighbours."""
    schema = "doc string, n int, text string"
    recorder = Recorder(spark, f"{tmp_path}/h", buckets=2, keyframes=3)
    rows = [
        [("a", 1, "x\n\none"), ("a", 3, "x\n\nthree"), ("b", 1, "y"), ("n", 1, None)],
        [("a", 2, "x\n\ntwo"), ("a", 3, "x\n\nother three"), ("a", 4, "x\n\nthree"), ("b", 1, "y"), ("c", 5, "z")],
        [("a", 3, "x\n\nthree"), ("a", 5, "x\n\nthree"), ("a", 6, "x\n\none"), ("b", 7, "w"), ("b", 8, "y")],
    ]
    for batch in rows:
        recorder.append_batch(spark.createDataFrame(batch, schema), "n")
    got = sorted((r.doc, r["at"], r.text) for r in recorder.versions().collect())
    plain = {}
    for n, batch in enumerate(rows):
        for d, at, t in batch:
            plain.setdefault(d, {}).setdefault((at, t or ""), n)
    expected = []
    for d, seen in plain.items():
        before = None
        for (at, t), _ in sorted(seen.items(), key=lambda x: (x[0][0], x[1])):  # of one time, in order of arrival
            if t != before:
                expected.append((d, at, t))
            before = t
    assert got == sorted(expected)
    kinds = [r.kind for r in recorder.history().where("doc = 'a'").orderBy(F.desc("rev"), "op_seq").collect()]
    assert kinds[0] == "tip" and "same" in kinds and "keyframe" in kinds
    assert recorder.history().count() == recorder.history().distinct().count()
    assert [r.text for r in recorder.versions(spark.createDataFrame([("c",)], "doc string")).collect()] == ["z"]


def test_a_batch_that_is_run_again(spark, tmp_path, monkeypatch):
    """The driver is lost after the operations are written, before the tips are: the batch, run again, gives what it would have given."""
    recorder = Recorder(spark, f"{tmp_path}/h", buckets=2)
    of = lambda *rows: spark.createDataFrame(list(rows), "doc string, ts long, text string")
    recorder.append_batch(of(("a", 1, "one\n\nx"), ("b", 1, "y")))
    batch = of(("a", 2, "two\n\nx"), ("a", 3, "three"), ("c", 1, "z"))
    keep = recorder.tips.write
    monkeypatch.setattr(recorder.tips, "write", lambda *_: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        recorder.append_batch(batch)
    seen = lambda: sorted((r.doc, r["at"], r.text) for r in recorder.versions().collect())
    assert seen() == [("a", 1, "one\n\nx"), ("b", 1, "y")]
    monkeypatch.setattr(recorder.tips, "write", keep)
    recorder.append_batch(batch)
    assert seen() == [("a", 1, "one\n\nx"), ("a", 2, "two\n\nx"), ("a", 3, "three"), ("b", 1, "y"), ("c", 1, "z")]


def test_debounced_stream_counts_sources_only(spark, tmp_path):
    rows = [("r", f"2024-01-01 00:00:{s:02}", p) for s, p in enumerate(["a.py", None, "node_modules/b.py", ".git/c.py", "README.md", "x\\target\\d.py", "src/e.rs"])]
    rows += [("q", "2024-01-01 00:00:00", "README.md"), ("r", "2024-01-01 00:05:00", ""), ("r", "2024-01-01 02:00:00", "a.py")]
    e = spark.createDataFrame(rows, "repo string, at string, path string").select("repo", F.to_timestamp("at").alias("ts"), "path")
    expected = [("r", "00:00:00", 3), ("r", "00:05:00", 1), ("r", "02:00:00", 1)]
    shown = lambda df: sorted((r.repo, f"{r.start:%H:%M:%S}", r.n) for r in df.collect())
    assert shown(debounce(e, "30 seconds")) == expected
    several = e.select("repo", "ts", F.when(F.col("path").isNotNull(), F.array(F.lit("doc.md"), F.col("path"))).otherwise(F.array().cast("array<string>")).alias("paths"))
    assert shown(debounce(several, "30 seconds")) == expected
    e.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(e.schema).parquet(f"{tmp_path}/in")
    q = debounce(stream, "30 seconds").writeStream.format("memory").queryName("bursts").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert shown(spark.table("bursts")) == expected[:2]  # the last burst isn't over


def test_concurrent_writers(spark, tmp_path):
    path = str(tmp_path / "t")
    assert published(spark, path) == (0, None)
    one, two = (spark.createDataFrame([(x,)], "x int") for x in (1, 2))
    assert publish(one, path, 0) == 1
    with pytest.raises(Conflict):
        publish(two, path, 0)
    version, rows = published(spark, path)
    assert (version, rows.first().x) == (1, 1)
    assert publish(two, path, version) == 2 and published(spark, path)[1].first().x == 2
    name_version(spark, path, 2, "")  # a writer was lost before it said what the version holds
    version, rows = published(spark, path)
    assert (version, rows.first().x) == (3, 2)
    assert publish(one, path, version) == 4 and published(spark, path)[1].first().x == 1


def test_keyed_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "k"), "doc", "doc string, n int", buckets=3)
    of = lambda *rows: spark.createDataFrame(list(rows), "doc string, n int")
    got = lambda df: sorted(tuple(r) for r in df.collect())
    assert got(t.read()) == []
    t.write(of(*[(f"d{i}", i) for i in range(20)]))
    t.write(of(("d1", 100), ("new", 7)))
    assert got(t.read(of(("d1", 0), ("new", 0)))) == [("d1", 1), ("d1", 100), ("new", 7)]
    t.write(of(("d1", 5)), of(("d1", 0), ("d2", 0)))
    assert got(t.read()) == sorted([(f"d{i}", i) for i in range(3, 20)] + [("d0", 0), ("d1", 5), ("new", 7)])
    t.write(of(), t.read())
    assert got(t.read()) == []


def test_scratch_tables_go(spark):
    import os

    there = lambda: {n for n in os.listdir(shared_dir(spark)) if n.startswith("scratch-")}
    kept = written(spark.range(3).toDF("x"), "scratch-kept")
    with scratch(spark):
        one = written(kept, "scratch-one")
        with scratch(spark):
            assert written(one, "scratch-two").count() == 3
        assert len(there()) == 2 and one.count() == 3
    assert len(there()) == 1 and kept.count() == 3


def test_a_stream_is_checked_by_all_rules(spark, tmp_path):
    """Each rule's document on a stream: its own ids, duplicates, tables and charts, references to other documents; the corpus check finds the same."""
    from docgraph.jobs.corpus_queries import RULES
    from docgraph.operators.corpus import check_corpus
    from docgraph.sources.scan import scan_corpus, scan_document

    more = [
        "# A {#a}\n=== note {#a}\nx\n===\n[[#a]] [[#b]] [x](base.mk) [y](/base.mk#a) [z](base.mk#a.b)", "# A {#a}\n# B {#a}\n# C {#a}",
        "=== table {#t src=a.csv}\n===\n=== diagram {format=x-chart data=#t}\n===", "=== table {#t format=csv summary=\"a = 'x'\"}\na,b\n1,2\n===\n=== diagram {format=x-chart data=t type=bar x=b y=a rows=all}\n===",
        "=== diagram {format=x-chart data=#t type=pie x=a y=\" , b\" series=}\n===\n=== table {#t}\n| a | b |\n|---|---|\n| x | y |\n===\n=== table {#t}\n===",
    ]
    rows = [(f"r{j}.mk", text) for j, text in enumerate([*(r[0] for r in RULES), *more])] + [("base.mk", "# A {#a}"), ("none", None)]
    docs = spark.createDataFrame(rows, "doc string, text string")
    docs.write.parquet(f"{tmp_path}/in")
    ids = spark.createDataFrame([("base.mk", "a"), ("none", None)], "doc string, id string")
    stream = spark.readStream.schema("doc string, text string").parquet(f"{tmp_path}/in")
    q = check_stream(stream, ids).writeStream.format("memory").queryName("by_rules").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination(200)
    scanned = written(scan_corpus(docs), "scan-rules")
    found = check_corpus(scanned, docs).collect()
    key = lambda r: (r.doc, r.line, r.severity, r.code)
    assert sorted(map(key, spark.table("by_rules").collect())) == sorted(map(key, found))

    from docgraph.operators.checks import found_alone

    alone = sorted((r["doc"], r["line"], r["severity"], r["code"], r["text"]) for d, t in rows for r in found_alone(scan_document(d, t)) if r["tag"] == "diagnostic")
    others = ("unresolved", "unresolved-cross")
    assert alone == sorted(tuple(r) for r in found if r.code not in others and not r.message.startswith("code graph:"))
