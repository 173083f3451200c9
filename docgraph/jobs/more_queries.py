"""Registered queries of sources, converters, slices and the remaining lookups."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.jobs.inputs import EDGES, SYMBOLS, edges, read, symbols
from docgraph.jobs.queries import ALL_ROOTS, L, _every_root, _levels, query
from docgraph.operators import graph, search, walk
from docgraph.sources import exchange
from docgraph.sources.markdown import convert_corpus
from docgraph.storage import dealt, shared_dir, written


@query(
    "a6_from_nodes_edges",
    f"""WITH {SYMBOLS}, n AS (SELECT *, 'js:' || file || '#' || name AS base, row_number() OVER (PARTITION BY file, name ORDER BY line_start, id) AS nr FROM symbols),
  a AS (SELECT id, name, CASE WHEN nr = 1 THEN base ELSE base || '~' || nr END AS anchor FROM n), k AS (SELECT name, min(anchor) AS anchor FROM a GROUP BY 1)
  SELECT f.anchor AS "from", coalesce(t.anchor, 'missing.' || (l_orderkey % 3)) AS target, count(*) AS n FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey JOIN k f ON f.name = replace(p.p_name, ' ', '.')
  LEFT JOIN part q ON q.p_partkey = l.l_orderkey LEFT JOIN k t ON t.name = replace(q.p_name, ' ', '.') GROUP BY 1, 2""",
)
def a6_from_nodes_edges(spark, d):
    s = symbols(spark, d)
    nodes = s.select("id", "kind", "name", F.col("name").alias("qualified_name"), F.col("file").alias("file_path"), "line_start", "line_end", F.lit("js").alias("language"), F.lit(False).alias("is_test"))
    p = read(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"))
    li = read(spark, d, "lineitem")
    raw = (
        li.join(p.select(F.col("p_partkey").alias("l_partkey"), F.col("name").alias("source_qualified")), "l_partkey")
        .join(p.select(F.col("p_partkey").alias("l_orderkey"), F.col("name").alias("t")), "l_orderkey", "left")
        .select(F.lit("CALLS").alias("kind"), "source_qualified", F.coalesce("t", F.concat(F.lit("missing."), F.col("l_orderkey") % 3)).alias("target_qualified"), F.lit("f").alias("file_path"), F.lit(1).alias("line"))
    )
    return exchange.from_nodes_edges(nodes, raw)[1].groupBy("from", "target").agg(F.count("*").alias("n"))


@query(
    "a7_from_method_calls",
    """WITH m AS (SELECT DISTINCT p_brand || '.' || replace(p_name, ' ', '_') AS full, p_type AS file FROM part), c AS (SELECT l.*, p.p_brand || '.' || replace(p.p_name, ' ', '_') AS caller, p.p_type AS cf FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey),
  t AS (SELECT c.*, q.p_type || '#' || q.p_brand || '.' || replace(q.p_name, ' ', '_') AS callee FROM c LEFT JOIN part q ON q.p_partkey = c.l_orderkey)
  SELECT cf || '#' || caller AS "from", callee AS "to", CASE WHEN callee IS NULL THEN 'ext' END AS to_text, count(*) AS n FROM t GROUP BY 1, 2, 3""",
)
def a7_from_method_calls(spark, d):
    p = read(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("."), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("full"), F.col("p_type").alias("file"), "p_size")
    methods = p.select(F.col("full").alias("fullName"), F.lit("()").alias("signature"), "file", F.col("p_size").alias("lineStart"), (F.col("p_size") + 1).alias("lineEnd"))
    li = read(spark, d, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "full", "file"), "l_partkey")
    li = li.join(p.select(F.col("p_partkey").alias("l_orderkey"), F.col("full").alias("cf"), F.col("file").alias("cfile")), "l_orderkey", "left")
    callee = F.when(F.col("cf").isNotNull(), F.array(F.struct(F.col("cf").alias("fullName"), F.lit("()").alias("signature"), F.col("cfile").alias("file")))).otherwise(F.array().cast("array<struct<fullName:string,signature:string,file:string>>"))
    calls = li.select(F.col("full").alias("callerFullName"), F.lit("()").alias("callerSignature"), F.col("file").alias("callerFile"), F.lit("ext").alias("name"), F.lit(1).alias("line"), callee.alias("callees"))
    return exchange.from_method_calls(methods, calls)[1].groupBy("from", "to", "to_text").agg(F.count("*").alias("n"))


@query("a9_write_changed", "SELECT p_brand AS doc, count(*) AS n, sum(CASE WHEN p_brand LIKE '%1' THEN length(p_name) + 1 ELSE length(p_name) END) AS chars, count(DISTINCT p_brand) * 0 + (SELECT count(DISTINCT p_brand) FROM part WHERE p_brand LIKE '%1') AS written FROM part GROUP BY 1")
def a9_write_changed(spark, d):
    """A table of a folder a brand, written twice: the second time some brands' rows changed, and only their folders are written."""
    import uuid

    path = f"{shared_dir(spark)}/changed-{uuid.uuid4().hex}"
    t = read(spark, d, "part").select(F.col("p_brand").alias("doc"), "p_partkey", "p_name")
    exchange.write_changed(t, path)
    new = t.withColumn("p_name", F.when(F.col("doc").endswith("1"), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")))
    wrote, _ = exchange.write_changed(new, path)
    back = spark.read.schema(t.schema).parquet(path)
    return back.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length("p_name")).alias("chars")).withColumn("written", F.lit(wrote).cast(L))


@query("a9_changed_rows", "SELECT p_partkey AS doc, p_name FROM part WHERE p_size % 3 = 0 OR p_size % 5 = 0")
def a9_changed_rows(spark, d):
    """Rows to write again: a third changed, a fifth new."""
    cur = read(spark, d, "part").select(F.col("p_partkey").alias("doc"), "p_name", "p_size")
    prior = cur.where("p_size % 5 <> 0").withColumn("p_name", F.when(F.col("p_size") % 3 == 0, F.lit("old")).otherwise(F.col("p_name")))
    return exchange.changed_rows(cur, prior).select("doc", "p_name")


@query(
    "a10_container_tables",
    f"""WITH {EDGES}, m AS (SELECT DISTINCT member FROM impls) SELECT 'calls' AS tbl, s.container, l.kind, CASE WHEN l.kind = 'call' AND m.member IS NOT NULL THEN 'medium' ELSE '' END AS detail, count(*) AS n FROM links l JOIN symbols s ON s.anchor = l."from" LEFT JOIN m ON m.member = l."to" GROUP BY 1, 2, 3, 4
  UNION ALL SELECT 'called_by', s.container, l.kind, site_file || ':' || site_line, count(*) FROM links l JOIN symbols s ON s.anchor = l."to" GROUP BY 1, 2, 3, 4
  UNION ALL SELECT 'unresolved', container, '', '', count(*) FROM (SELECT DISTINCT s.container, e."from", e.to_text FROM edges e JOIN symbols s ON s.anchor = e."from" WHERE e.kind = 'calls' AND e."to" IS NULL) GROUP BY 1, 2
  UNION ALL SELECT 'modules', container, '', count(*) FILTER (entry) || '/' || count(*) FILTER (test), count(*) FROM classified GROUP BY 1, 2
  UNION ALL SELECT 'module_edges', a.container, '', b.container, count(*) FROM edges e JOIN symbols a ON a.anchor = e."from" JOIN symbols b ON b.anchor = e."to" WHERE e.kind = 'calls' AND a.container <> b.container GROUP BY 1, 2, 4""",
)
def a10_container_tables(spark, d):
    """Container tables, modules and module edges written to the shared folder, and counted from there."""
    import uuid

    path = f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"
    s, e = symbols(spark, d), written(edges(spark, d), "edges")
    exchange.write_container_tables(e, s, path, graph.classify(s, e))
    empty = F.lit("")

    def table(name: str, container: str = "container", kind=empty, detail=empty, n=None):
        t = spark.read.parquet(f"{path}/{name}")
        t = t.select(F.lit(name).alias("tbl"), F.col(container).alias("container"), kind.alias("kind"), detail.alias("detail"), (F.lit(1) if n is None else F.col(n)).alias("n"))
        return t.groupBy("tbl", "container", "kind", "detail").agg(F.sum("n").alias("n"))

    kind = F.col("kind")
    parts = [table("calls", kind=kind, detail=F.col("confidence")), table("called_by", kind=kind, detail=F.col("site")), table("unresolved")]
    parts += [table("modules", detail=F.concat("entries", F.lit("/"), "tests"), n="methods"), table("module_edges", "a", detail=F.col("b"), n="calls")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "b19_convert_corpus",
    """SELECT 'd' || o_orderkey AS doc, CASE o_orderkey % 4 WHEN 0 THEN '=== code {#code-1 lang=sql}' || chr(10) || 'select ' || o_orderkey || chr(10) || '===' WHEN 1 THEN '=== note {#note-1}' || chr(10) || o_orderpriority || chr(10) || '==='
    WHEN 2 THEN '=== table {#table-1}' || chr(10) || '| a |' || chr(10) || '|---|' || chr(10) || '| ' || o_orderkey || ' |' || chr(10) || '===' ELSE '# Title' END || CASE WHEN o_orderkey % 5 = 0 THEN chr(10) || chr(10) || '<div>' || chr(10) ELSE chr(10) END AS text,
    CASE o_orderkey % 5 WHEN 0 THEN 'raw HTML kept as text at line ' || n || ': <div>' WHEN 1 THEN 'dropped thematic break at line ' || n ELSE '' END AS notes FROM (SELECT *, CASE o_orderkey % 4 WHEN 0 THEN 5 WHEN 1 THEN 3 WHEN 2 THEN 5 ELSE 4 END AS n FROM orders)""",
)
def b19_convert_corpus(spark, d):
    k = F.col("o_orderkey") % 4
    body = F.when(k == 0, F.concat(F.lit("```sql\nselect "), "o_orderkey", F.lit("\n```"))).when(k == 1, F.concat(F.lit("> "), "o_orderpriority")).when(k == 2, F.concat(F.lit("| a |\n|---|\n| "), "o_orderkey", F.lit(" |"))).otherwise(F.lit("Title\n====="))
    text = F.concat(body, F.when(F.col("o_orderkey") % 5 == 0, F.lit("\n\n<div>")).when(F.col("o_orderkey") % 5 == 1, F.lit("\n\n***")).otherwise(F.lit("")))
    out = convert_corpus(read(spark, d, "orders").select(F.concat(F.lit("d"), F.col("o_orderkey")).alias("doc"), text.alias("text")))
    return out.select("doc", "text", F.array_join("notes", ",").alias("notes"))


@query(
    "a8_from_occurrences",
    """WITH o AS (SELECT p_partkey AS k, p_type AS file, p_size AS a, p_size + p_partkey % 20 AS z, 'pkg/' || replace(p_brand, '#', '') || '#m' || p_partkey || '().' AS symbol FROM part),
  r AS (SELECT DISTINCT p.p_type AS file, l.l_linenumber * 8 AS line, CASE WHEN q.p_partkey IS NULL THEN 'ext/Lib#f' || (l.l_orderkey % 9) || '().' ELSE 'pkg/' || replace(q.p_brand, '#', '') || '#m' || q.p_partkey || '().' END AS ref
    FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey LEFT JOIN part q ON q.p_partkey = l.l_orderkey),
  c AS (SELECT r.*, o.symbol AS caller, row_number() OVER (PARTITION BY r.file, r.line, r.ref ORDER BY o.z - o.a, o.a DESC, o.symbol) AS nr FROM r JOIN o ON o.file = r.file AND r.line BETWEEN o.a AND o.z),
  i AS (SELECT b.symbol AS target, a.symbol AS impl FROM o a JOIN o b ON b.k = a.k + 1 WHERE a.k % 10 = 0)
  SELECT c.file, c.line, c.caller AS "from", t.symbol AS "to", CASE WHEN t.symbol IS NULL THEN regexp_extract(c.ref, '/(.*)[(]', 1).replace('#', '.') END AS to_text,
    CASE WHEN t.symbol IS NULL THEN 'low' WHEN i.impl IS NULL THEN 'high' ELSE 'medium' END AS confidence, i.impl AS candidates, CASE WHEN i.impl IS NOT NULL THEN 'dispatch, 2 candidates' END AS note
  FROM c LEFT JOIN o t ON t.symbol = c.ref LEFT JOIN i ON i.target = c.ref WHERE nr = 1 AND c.caller <> c.ref""",
)
def a8_from_occurrences(spark, d):
    """Parts as methods of the file of their type, line items as references: edges by caller, with candidates where a method is implemented."""
    return _occurrences(spark, d)[1].select(F.col("site.file").alias("file"), F.col("site.line").alias("line"), "from", "to", "to_text", "confidence", F.array_join("candidates", ",").alias("candidates"), "note")


def _occurrences(spark, d):
    p = read(spark, d, "part")
    method = F.concat(F.lit("pkg/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("#m"), "p_partkey", F.lit("()."))
    own = p.select("p_partkey", F.col("p_type").alias("file"), method.alias("symbol"), F.col("p_size").alias("start"), (F.col("p_size") + F.col("p_partkey") % 20).alias("end"))
    defs = own.select("file", "symbol", F.lit("definition").alias("role"), F.col("start").alias("line"), "start", "end")
    li = read(spark, d, "lineitem").select("l_partkey", "l_orderkey", (F.col("l_linenumber") * 8).alias("line"))
    li = li.join(own.select(F.col("p_partkey").alias("l_partkey"), "file"), "l_partkey").join(own.select(F.col("p_partkey").alias("l_orderkey"), "symbol"), "l_orderkey", "left")
    outside = F.concat(F.lit("ext/Lib#f"), F.col("l_orderkey") % 9, F.lit("()."))
    refs = li.select("file", F.coalesce("symbol", outside).alias("symbol"), F.lit("reference").alias("role"), "line", F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"))
    rels = own.where("p_partkey % 10 = 0").select(F.col("symbol"), (F.col("p_partkey") + 1).alias("k")).join(own.select(F.col("p_partkey").alias("k"), F.col("symbol").alias("target")), "k").select("symbol", "target")
    return exchange.from_occurrences(defs.unionByName(refs), rels)


@query(
    "a8_symbols_of_occurrences",
    """SELECT 'pkg/' || replace(p_brand, '#', '') || '#m' || p_partkey || '().' AS anchor, 'Function' AS kind, replace(p_brand, '#', '') || '.m' || p_partkey AS name, p_type AS file, p_size AS line_start, p_size + p_partkey % 20 AS line_end FROM part
  UNION ALL SELECT DISTINCT 'file:' || p_type, 'File', p_type, p_type, NULL, NULL FROM part""",
)
def a8_symbols_of_occurrences(spark, d):
    return _occurrences(spark, d)[0].select("anchor", "kind", "name", "file", "line_start", "line_end")


@query("a5_read_exchange", f"WITH {EDGES} SELECT e.kind, e.\"from\", e.\"to\", e.to_text, s.name, count(*) AS n FROM edges e JOIN symbols s ON s.anchor = e.\"from\" GROUP BY ALL")
def a5_read_exchange(spark, d):
    """Symbols and edges written as JSON lines, read back with their schema, and joined."""
    import uuid

    path = f"{shared_dir(spark)}/exchange-{uuid.uuid4().hex}"
    symbols(spark, d).select("anchor", "kind", "name", "file", "line_start", "line_end").write.json(f"{path}/symbols")
    edges(spark, d).write.json(f"{path}/edges")
    s, e = exchange.read_symbols(spark, f"{path}/symbols"), dealt(exchange.read_edges(spark, f"{path}/edges"), f"{path}/edges", "from")
    return e.join(s.select(F.col("anchor").alias("from"), "name"), "from").groupBy("kind", "from", "to", "to_text", "name").agg(F.count("*").alias("n"))


@query("a1_read_corpus", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer")
def a1_read_corpus(spark, d):
    """A folder of text files written by Spark, read as whole documents with their line ends made one kind."""
    import uuid

    from docgraph.operators.corpus import read_corpus

    path = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    c = read(spark, d, "customer")
    c.select(F.concat_ws("\r\n", "c_custkey", "c_name", "c_mktsegment").alias("value")).write.text(path)
    # a file has the documents of a task; each line end is one newline, so documents are three lines
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    docs = read_corpus(spark, path).select(lines.alias("lines")).where(F.size("lines") > 0)
    each = docs.select(F.explode(F.sequence(F.lit(0), (F.size("lines") / 3 - 1).cast("int"))).alias("i"), "lines")
    at = lambda k: F.get("lines", F.col("i") * 3 + k)
    return each.select(at(0).cast("bigint").alias("k"), at(1).alias("name"), at(2).alias("segment"))


@query("a11_search_index", f"WITH {SYMBOLS} SELECT name, container AS doc, anchor AS id FROM symbols UNION SELECT substr(name, instr(name, '.') + 1), container, anchor FROM symbols WHERE contains(name, '.')")
def a11_search_index(spark, d):
    """The flat index written as JSON lines and read back."""
    import uuid

    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    s = symbols(spark, d)
    lookup = search.name_lookup(s).join(s.select("anchor", F.col("container").alias("doc")), "anchor").withColumnRenamed("anchor", "id")
    exchange.write_search_index(lookup, path)
    return spark.read.schema("name string, doc string, id string").json(path)


@query("f5_order_exchange", f"WITH {SYMBOLS} SELECT anchor, row_number() OVER (ORDER BY anchor) AS place FROM symbols")
def f5_order_exchange(spark, d):
    """Place in the written order: by range of anchors, then within the range."""
    s = exchange.ordered(symbols(spark, d), edges(spark, d))[0].select("anchor", F.spark_partition_id().alias("part"))
    s = written(s, "order")
    n = s.groupBy("part").agg(F.count("*").alias("n"))
    first = n.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row a partition
    return s.join(F.broadcast(first), "part").select("anchor", (F.col("before") + F.row_number().over(W.partitionBy("part").orderBy("anchor"))).cast(L).alias("place"))


@query("f6_cap_slice", f"SELECT root, node, depth, total, total > 5 AS truncated FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS k, count(*) OVER (PARTITION BY root) AS total FROM (WITH {EDGES}, {ALL_ROOTS}, {_levels(6, 4000)})) WHERE k <= 5")
def f6_cap_slice(spark, d):
    """The first five nodes of every root's slice, and how many there were: the cap is the feature."""
    return walk.cap_walk(edges(spark, d), _every_root(spark, d), 5).withColumn("depth", F.col("depth").cast(L))


@query("g2_module_roots", "SELECT DISTINCT p_type || '/' || p_brand AS root FROM part UNION SELECT DISTINCT n_name FROM nation UNION SELECT r_name FROM region")
def g2_module_roots(spark, d):
    m = read(spark, d, "part").select(F.concat("p_type", F.lit("/"), "p_brand", F.lit("/package.json")).alias("path"))
    return exchange.module_roots(m, read(spark, d, "nation").select(F.col("n_name").alias("root")), read(spark, d, "region").select(F.col("r_name").alias("root")))


@query("g7_compare_symbols", f"WITH {SYMBOLS} SELECT anchor, 'added' AS change FROM symbols WHERE id % 9 = 0 UNION ALL SELECT anchor, 'removed' FROM symbols WHERE id % 9 = 1")
def g7_compare_symbols(spark, d):
    s = symbols(spark, d).select("anchor", "id")
    return graph.diff_edges(s.where("id % 9 <> 0").select("anchor"), s.where("id % 9 <> 1").select("anchor"))


#: (files of a repository with their content, the starts they show), one case for each convention.
STARTS = [
    ({"Cargo.toml": '[[bin]]\nname = "x"\npath = "tools/x.rs"\n', "src/main.rs": "fn main() {}", "src/bin/a.rs": "", "tools/x.rs": "", "other/src/bin/b.rs": ""}, [("src/main.rs", "cargo-bin", "main"), ("src/bin/a.rs", "cargo-bin", "main"), ("tools/x.rs", "cargo-bin", "main")]),
    ({"w/Cargo.toml": "", "w/src/lib.rs": "#[event(fetch, respond)]\npub async fn handle(a: B) {}\n#[event(scheduled)]\nfn tick() {}"}, [("w/src/lib.rs", "worker-fetch", "handle"), ("w/src/lib.rs", "worker-scheduled", "tick")]),
    ({"package.json": '{"bin": {"a": "./cli.js", "b": "gone.js"}}', "cli.js": ""}, [("cli.js", "pkg-bin", None)]),
    ({"p/package.json": '{"bin": "run.mjs"}', "p/run.mjs": "", "p/wrangler.toml": 'main = "./src/w.ts"', "p/src/w.ts": ""}, [("p/run.mjs", "pkg-bin", None), ("p/src/w.ts", "worker-fetch", None)]),
    ({"package.json": '{"dependencies": {"nuxt": "3"}}', "pages/index.vue": "", "pages/b.vue": ""}, [("pages/index.vue", "nuxt-page", None)]),
    ({"package.json": "{}", "nuxt.config.ts": "", "app.vue": "", "pages/index.vue": ""}, [("app.vue", "nuxt-app", None)]),
    ({"package.json": '{"devDependencies": {"next": "1"}}', "src/app/page.tsx": "", "pages/index.tsx": ""}, [("src/app/page.tsx", "next-page", None)]),
    ({"package.json": '{"devDependencies": {"@sveltejs/kit": "1"}}', "src/routes/+page.svelte": ""}, [("src/routes/+page.svelte", "kit-route", None)]),
    ({"package.json": "{}", "src/main.ts": "createApp(App).mount('#a')", "server.js": "app.listen (80)", "lib/server.js": "app.listen(80)"}, [("src/main.ts", "vue-mount", None), ("server.js", "server-listen", None)]),
    ({"package.json": "{}", "src/index.tsx": "createRoot(x).render()", "index.js": "export default {\n  async fetch(r) {} }"}, [("src/index.tsx", "react-mount", None), ("index.js", "worker-fetch", None)]),
    ({"package.json": '{"devDependencies": {"svelte": "4"}}', "src/main.js": "new App({ target: x })"}, [("src/main.js", "svelte-mount", None)]),
    ({"manage.py": "", "pkg/__main__.py": "", "app.py": "app = FastAPI()", "main.py": "pass", "x.py": "Flask()"}, [("manage.py", "django-manage", None), ("pkg/__main__.py", "py-main", None), ("app.py", "wsgi-app", None)]),
    ({"a/MyApplication.java": "@SpringBootApplication\nclass A {}", "a/B.java": "@SpringBootApplication"}, [("a/MyApplication.java", "spring-boot", "main")]),
]
_sql = lambda x: "NULL" if x is None else "'" + x + "'"


@query(
    "h18s_source_markers",
    "WITH s(j, file, via, name) AS (VALUES " + ", ".join(f"({j}, {_sql(f)}, {_sql(v)}, {_sql(n)})" for j, (_, found) in enumerate(STARTS) for f, v, n in found)
    + f") SELECT 'r' || p_partkey AS repo, file, via, name FROM part JOIN s ON s.j = p_partkey % {len(STARTS)}",
)
def h18s_source_markers(spark, d):
    """A repository a part, of one convention each."""
    cases = F.array(*[F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in files.items()]) for files, _ in STARTS])
    own = read(spark, d, "part").select(F.concat(F.lit("r"), "p_partkey").alias("repo"), F.inline(F.get(cases, (F.col("p_partkey") % len(STARTS)).cast("int"))))
    return exchange.source_markers(written(own, "sources"))


@query("i4_hide_accessors", f"WITH {EDGES}, {ALL_ROOTS}, ok AS (SELECT e.* FROM e JOIN symbols s ON s.anchor = e.\"to\" WHERE s.name NOT LIKE 'small%'), {_levels(6, 4000, 'ok')}")
def i4_hide_accessors(spark, d):
    """A walk from every root that doesn't cross hidden symbols (here those named small...)."""
    shown, _ = walk.hide_accessors(graph.links(edges(spark, d)), symbols(spark, d).where(F.col("name").startswith("small")))
    return walk.walk(shown, _every_root(spark, d)).withColumn("depth", F.col("depth").cast(L))


@query("i4_hidden_counts", f"WITH {EDGES} SELECT e.\"from\", count(*) AS hidden FROM links e JOIN symbols s ON s.anchor = e.\"to\" WHERE s.name LIKE 'small%' GROUP BY 1")
def i4_hidden_counts(spark, d):
    """How many edges each caller has to hidden symbols."""
    return walk.hide_accessors(graph.links(edges(spark, d)), symbols(spark, d).where(F.col("name").startswith("small")))[1]
