"""Plans and tasks that only larger tables need."""

import re

from pyspark.sql import functions as F

from docgraph import storage
from docgraph.operators import history, search, walk
from docgraph.sources import scan
from docgraph.streaming import changes


def broadcast_rows(spark, run) -> int:
    """Most rows of a table that is broadcast while ``run`` works."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    most = 0
    for i in range(before, store.executionsCount()):
        x = store.executionsList().apply(i)
        graph, values = store.planGraph(x.executionId()), store.executionMetrics(x.executionId())
        nodes = graph.allNodes()
        for n in range(nodes.size()):
            node = nodes.apply(n)
            if "BroadcastExchange" in node.name():
                for m in range(node.metrics().size()):
                    metric = node.metrics().apply(m)
                    if metric.name() == "number of output rows":
                        text = values.get(metric.accumulatorId())
                        most = max(most, int(re.sub(r"\D", "", text.get()) or 0) if text.isDefined() else 0)
    return most


def test_search_broadcasts_queries_and_not_the_grams_of_names(spark):
    lookup = spark.range(400).selectExpr("concat('name', id, '.ring', id) AS name", "concat('p:', id) AS anchor")
    queries = spark.createDataFrame([("ring",), ("am",)], "q string")
    found = []
    assert broadcast_rows(spark, lambda: found.extend(search.search_names(lookup, queries, 3).collect())) <= 2
    assert sorted((r.q, r.score, r.total) for r in found) == [("am", 3, 400)] * 3 + [("ring", 2, 400)] * 3


def test_a_compact_corpus_is_scanned_in_many_tasks(spark):
    docs = spark.range(64).selectExpr("concat('d', id) AS doc", "'# A {#a .b k=v}\n\nsee [[#c]]' AS text").coalesce(1)
    rows = scan.scan_corpus(docs).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > 1
    heads = [r for r in rows if r.tag == "block" and r.kind == "heading"]
    assert len(heads) == 64 and all((r.attrs, r.classes, r.level, r.target_doc) == ({"k": "v"}, ["b"], 1, None) for r in heads)
    assert sum(r.tag == "ref" and r.attrs is None and r.anchor == "c" for r in rows) == 64


def test_nested_blocks_do_not_repeat_their_text_for_checks():
    deep = "".join("=" * (100 - i) + " note\n" for i in range(90)) + "=== table {format=csv}\na\n===\n" + "".join("=" * (100 - i) + "\n" for i in reversed(range(90)))
    full, lean = (scan.scan_document("d", deep, flow_texts=x) for x in (True, False))
    size = lambda rows: sum(len(r.get("text") or "") for r in rows)
    assert size(full) > 5 * len(deep) and size(lean) < 10
    bare = lambda rows: [{k: v for k, v in r.items() if k != "text"} for r in rows]
    assert bare(full) == bare(lean) and [r["text"] for r in lean if r.get("type") == "table"] == ["a"]


def test_walks_keep_lists_and_not_a_row_a_node(spark, monkeypatch):
    pairs = [("r", f"n{i:04d}") for i in range(600)] + [("n0003", "z"), ("z", "r"), ("q", "r")]
    e = spark.createDataFrame(pairs, "from string, to string")
    roots = spark.createDataFrame([("r",), ("q",), ("alone",), (None,)], "root string")
    s = walk.slices(e, roots, cap=None)
    assert sorted((r.depth, len(r.nodes)) for r in s.named(s.levels, "root").where("root = 'r'").collect()) == [(0, 1), (1, 88), (1, 256), (1, 256), (2, 1)]
    leaves = [f"n{i:04d}" for i in range(600)]
    below = {"r": [("r", 0), *((n, 1) for n in leaves), ("z", 2)], "q": [("q", 0), ("r", 1), *((n, 2) for n in leaves), ("z", 3)], "alone": [("alone", 0)]}
    for name, value in (("MERGED", 100), ("NAME_BYTES", 1000), ("NAME_BLOCKS", 2)):
        monkeypatch.setattr(walk, name, value)
        for cap in (None, 300) if name == "MERGED" else (300,):
            got = sorted((r.root, r.node, r.depth) for r in walk.walk(e, roots, cap=cap).where("root IS NOT NULL").collect())
            assert got == sorted((root, n, d) for root, rows in below.items() for n, d in sorted(rows, key=lambda x: x[::-1])[:cap])


def test_histories_are_rebuilt_without_a_table_for_each(spark):
    """Runs go on over the rows that a worker takes at a time, and end where a document or a whole revision begins."""
    r = spark.range(900).selectExpr("concat('d', id % 3) AS doc", "id div 3 AS rev", "concat('a', id, '\n\nb') AS text")
    h = history.commit_chain(r, keyframes=290)
    h = h.where("NOT (doc = 'd1' AND kind IN ('tip', 'keyframe'))").withColumn("hash", F.when(F.expr("doc = 'd2' AND rev = 7"), "0").otherwise(F.col("hash")))
    out = history.reconstruct(h)
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    rows = {(x.doc, x.rev): (x.text, x.fault) for x in out.collect()}
    assert all(rows["d0", k] == (f"a{3 * k}\n\nb", None) and rows["d2", k] == (f"a{3 * k + 2}\n\nb", "hash differs" if k == 7 else None) for k in range(300))
    assert {x[1] for (doc, _), x in rows.items() if doc == "d1"} == {"no whole revision to rebuild from"} and len(rows) == 898


def test_a_stream_check_scans_once(spark):
    docs = spark.createDataFrame([("a", "# A {#x}\n\nsee [[#x]] and [[#y]]\n"), ("b", "=== code\nopen"), ("c", None)], "doc string, text string")
    out = changes.check_stream(docs, spark.createDataFrame([("a", "x"), ("a", "x"), ("b", None)], "doc string, id string"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    s = scan.scan_corpus(docs)
    found = sorted((r.doc, r.line, r.severity, r.code) for r in s.where("tag = 'diagnostic'").collect())
    assert found and sorted(tuple(r) for r in out.collect()) == sorted([*found, ("a", 3, "error", "unresolved")])


def test_exchange_rows_are_dealt_over_more_tasks_as_they_grow(spark, monkeypatch):
    import os

    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        return
    monkeypatch.setattr(storage, "DEALT", 10_000, raising=False)
    out = entry.queries()["a5_read_exchange"](spark, sf)
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    key = lambda row: tuple(map(str, row))
    assert sorted(map(key, out.collect())) == sorted(map(key, con.execute(entry.oracle_sql()["a5_read_exchange"]).fetchall()))
    assert out.rdd.getNumPartitions() > 20


def test_layers_are_laid_out_of_lists_and_not_a_pandas_table_a_root(spark, monkeypatch):
    """Hubs beyond twice the cap, cycles, loops, roots without edges; against the layers of rows."""
    import random

    rnd = random.Random(5)
    pairs = {(f"n{rnd.randrange(60):02d}", f"n{rnd.randrange(60):02d}") for _ in range(110)} | {("hub", f"n{i:02d}") for i in range(60)} | {("n07", "hub"), ("self", "self"), ("hub", "zz"), ("zz", "hub")}
    e = spark.createDataFrame(sorted(pairs), "from string, to string")
    roots = spark.createDataFrame([(f"n{i:02d}",) for i in range(20)] + [("hub",), ("self",), ("alone",)], "root string")
    monkeypatch.setattr(walk, "CHUNK", 4)
    for cap, depth, merged in ((10, 3, 50), (None, 4, 1 << 20)):
        monkeypatch.setattr(walk, "MERGED", merged)
        out = walk.walk_layers(e, roots, depth, cap)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
        nodes = walk.walk(e, roots, depth, cap)
        s = walk.slice_edges(e, nodes, depth).where("NOT more").select("root", "from", "to")
        rows = walk.layers(s.join(nodes.select("root", F.col("node").alias("to")), ["root", "to"], "left_semi"))
        got = sorted(tuple(r) for r in out.collect())
        assert got == sorted(tuple(r) for r in rows.collect()) and ("self", "self", 0) in got
        assert {r[0] for r in got}.isdisjoint({"alone"})


def plain_chain(parents, current):
    """{rev: (back, fault)} by following pointers one by one."""
    def after(r):
        seen = []
        while r in parents and r not in seen:
            seen.append(r)
            r = parents[r]
        return seen

    chain = after(current)
    out = {}
    for r, parent in parents.items():
        way = after(r)
        back = chain.index(r) if r in chain else None
        ring = parents[way[-1]] in way and r in after(parents[way[-1]])
        lost = parent is not None and parent not in parents
        out[r] = (back, "missing parent" if lost else "cycle" if ring else None if back is not None else "branch" if set(way) & set(chain) else "orphan")
    return out if current in parents else out | {current: (None, "missing current")}


def test_long_chains_are_contracted_and_not_moved_whole_in_each_round(spark, monkeypatch):
    import random

    rnd, n = random.Random(3), 700
    docs = {"long": ({f"{i * 7919 % n}": f"{(i + 1) * 7919 % n}" if i < n - 1 else None for i in range(n)}, "0")}
    for d in range(40):
        k = rnd.randrange(1, 40)
        far = rnd.choice([1, 3, k])
        docs[f"d{d}"] = ({str(i): None if rnd.random() < 0.04 else "gone" if rnd.random() < 0.03 else str((i + rnd.randrange(1, far + 1)) % k) for i in range(k)}, str(rnd.randrange(k + 1)))
    rows = [(doc, r, p) for doc, (parents, _) in docs.items() for r, p in parents.items()]
    r, heads = spark.createDataFrame(rows, "doc string, rev string, parent string"), spark.createDataFrame([(doc, c) for doc, (_, c) in docs.items()], "doc string, current string")
    expected = sorted((doc, rev, *x) for doc, (parents, c) in docs.items() for rev, x in plain_chain(parents, c).items())
    key = lambda x: tuple(map(str, x))
    counted, real = [], history.written

    def counting(df, name):
        out = real(df, name)
        counted.append(out.count())
        return out

    monkeypatch.setattr(history, "written", counting)
    for whole, held in ((1 << 16, 1 << 20), (16, 30)):
        monkeypatch.setattr(history, "FOLLOWED", whole, raising=False)
        monkeypatch.setattr(history, "HELD", held, raising=False)
        counted.clear()
        assert sorted(map(key, history.chains(r, heads).collect())) == sorted(map(key, expected))
        assert sum(counted) < 10 * len(rows)


def test_neighbours_are_moved_once_a_group_and_not_once_a_root(spark, monkeypatch):
    """400 roots reach the same 600 nodes over a hub; groups that may reach too much are walked by joins and give the same."""
    pairs = [(f"r{i:03d}", "hub") for i in range(400)] + [("hub", f"n{i:03d}") for i in range(600)] + [("n007", "r000"), ("hub", "hub")]
    e, roots = spark.createDataFrame(pairs, "from string, to string"), spark.createDataFrame([(f"r{i:03d}",) for i in range(400)], "root string")
    expected = []
    for i in range(400):
        below = [(f"r{i:03d}", 0), ("hub", 1), *((f"n{k:03d}", 2) for k in range(600)), *([("r000", 3)] if i else [])]
        expected += [(f"r{i:03d}", n, d) for n, d in below]
    counted, real = [], walk.written

    def counting(df, name):
        out = real(df, name)
        lists = [c for c, t in out.dtypes if t.startswith("array")]
        counted.append(out.agg(F.sum(sum((F.size(c) for c in lists), F.lit(0)))).first()[0] or 0)
        return out

    monkeypatch.setattr(walk, "written", counting)
    heads, layers = [], []
    for held in (1 << 24, 620):
        monkeypatch.setattr(walk, "HELD", held, raising=False)
        counted.clear()
        got = sorted(tuple(r) for r in walk.walk(e, roots, cap=None).collect())
        assert got == sorted(expected)
        if held > 620:
            assert sum(counted) < 30_000 < len(got)
        heads.append(sorted(tuple(r) for r in walk.cap_walk(e, roots, 3, cap=300).collect()))
        layers.append(sorted(tuple(r) for r in walk.walk_layers(e, roots.limit(40), cap=300).collect()))
    assert heads[0] == heads[1] == sorted((f"r{i:03d}", n, d, 300, True) for i in range(400) for n, d in [(f"r{i:03d}", 0), ("hub", 1), ("n000", 2)])
    assert layers[0] == layers[1] and len(layers[0]) == 40 * 300
