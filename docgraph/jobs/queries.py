"""Registered queries of the graph, table and text operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions import paths, values
from docgraph.jobs.inputs import EDGES, LINKS, SYMBOLS, edges, links, read, symbols
from docgraph.operators import charts, corpus, graph, intervals, search, tables, walk
from docgraph.storage import written

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


L = "long"

# ---- tables ------------------------------------------------------------------------------------


@query(
    "d3_summary_by",
    """SELECT l_returnflag, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net,
  round(sum(l_extendedprice * (1 - l_discount)) / sum(l_quantity), 4) AS unit FROM lineitem GROUP BY 1""",
)
def d3_summary_by(spark, d):
    """compute net, then a foot row for each return flag."""
    t = tables.compute(read(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount"), "net = l_extendedprice * (1 - l_discount)", ["l_returnflag"])
    t = t.withColumn("unit", F.lit(0.0)).withColumnRenamed("l_quantity", "qty")
    foot = tables.summary_row(t, "qty = sum(qty); net = sum(net); unit = sum(net) / sum(qty)", ["l_returnflag"])
    return foot.select("l_returnflag", F.round("qty", 2).alias("qty"), F.round("net", 2).alias("net"), F.round("unit", 4).alias("unit"))


@query(
    "d3_summary_levels",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
)
def d3_summary_levels(spark, d):
    t = read(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").alias("qty"))
    return tables.summary_row(t, "qty = sum(qty)", ["l_returnflag", "l_linestatus"], levels=True).withColumn("qty", F.round("qty", 2))


@query(
    "d2_summary_row",
    """SELECT 'Total' AS label, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, CAST(count(o_totalprice) AS DOUBLE) AS n FROM orders""",
)
def d2_summary_row(spark, d):
    t = read(spark, d, "orders").select(F.lit("x").alias("label"), F.col("o_totalprice").alias("total"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("n"))
    foot = tables.summary_row(t, "label = 'Total'; mean = avg(total); n = count(total); total = sum(total)")
    return foot.select("label", F.round("total", 2).alias("total"), F.round("mean", 4).alias("mean"), "n")


@query(
    "d1_column_agg",
    """SELECT lang, coalesce(max(CASE WHEN source LIKE 'src%' THEN CAST(substr(source, 4) AS DOUBLE) END), 0) AS value FROM documents GROUP BY 1""",
)
def d1_column_agg(spark, d):
    """Largest numeric cell by language; cells are the digits of the source's name."""
    return tables.column_agg(read(spark, d, "documents").select("lang", F.substring("source", 4, 9).alias("text")), "max", ["lang"])


@query("e1_broadcast_agg", "SELECT p_partkey, p_retailprice AS price, round(sum(p_retailprice) OVER (PARTITION BY p_brand), 2) AS total FROM part")
def e1_broadcast_agg(spark, d):
    t = read(spark, d, "part").select("p_partkey", "p_brand", F.col("p_retailprice").alias("price"))
    return tables.compute(t, "total = sum(price)", ["p_brand"]).select("p_partkey", "price", F.round("total", 2).alias("total"))


@query("e2_share_of_total", "SELECT s_suppkey, round(s_acctbal * 100 / (SELECT sum(s_acctbal) FROM supplier), 6) AS share FROM supplier")
def e2_share_of_total(spark, d):
    """One whole table: its aggregate is one joined row, not a window over everything."""
    t = read(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("bal"))
    return tables.compute(t, "share = bal * 100 / sum(bal)").select("s_suppkey", F.round("share", 6).alias("share"))


@query(
    "e9_first_bad_row",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_discount > 0.08 THEN NULL ELSE l_tax END AS tax, l_partkey, l_suppkey FROM lineitem),
  r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS row FROM t),
  b AS (SELECT *, min(CASE WHEN tax IS NULL THEN row END) OVER (PARTITION BY l_orderkey) AS bad FROM r)
  SELECT l_orderkey, row, CASE WHEN row < coalesce(bad, 1000000) THEN round(l_quantity * tax, 6) END AS due FROM b""",
)
def e9_first_bad_row(spark, d):
    t = read(spark, d, "lineitem").withColumn("tax", F.when(F.col("l_discount") > 0.08, None).otherwise(F.col("l_tax")))
    t = t.withColumn("row", F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast(L))
    out = tables.until_first_bad(t, "l_orderkey", "row", F.col("l_quantity") * F.col("tax"), "due")
    return out.select("l_orderkey", "row", F.round("due", 6).alias("due"))


@query("h2s_division", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_discount <> 0 THEN round(l_quantity / l_discount, 4) ELSE l_quantity END AS q FROM lineitem")
def h2s_division(spark, d):
    """A division by 0 leaves the cell as it was."""
    t = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("q"), F.col("l_discount").alias("dis"))
    return tables.compute(t, "q = q / dis", ["l_orderkey"]).select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("dis") != 0, F.round("q", 4)).otherwise(F.col("q")).alias("q"))


@query(
    "h1s_formulas",
    """SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 6) AS net, round(l_extendedprice * (1 - l_discount) * (1 + l_tax) - -l_quantity, 6) AS gross FROM lineitem""",
)
def h1s_formulas(spark, d):
    """Chained formulas: a quoted name, a letter, an earlier result."""
    t = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("Ext Price"), F.col("l_discount").alias("dis"), F.col("l_tax").alias("tax"), F.col("l_quantity").alias("qty"))
    own = tables.compute(t, "net [%.2f] = 'Ext Price' * (1 - dis); gross = net * (1 + D) - -qty", ["l_orderkey", "l_linenumber"])
    return own.select("l_orderkey", "l_linenumber", "l_partkey", F.round("net", 6).alias("net"), F.round("gross", 6).alias("gross"))


@query("b14_filter_rows", "SELECT p_partkey, p_name, p_brand FROM part WHERE contains(lower(p_name || ' ' || p_brand), 'ring brand#1')")
def b14_filter_rows(spark, d):
    return tables.filter_rows(read(spark, d, "part").select("p_name", "p_brand", "p_partkey"), "RING Brand#1")


@query(
    "f1_sort_table",
    """WITH c AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_type ELSE CAST(p_size AS VARCHAR) END AS cell FROM part)
  SELECT p_partkey, cell, row_number() OVER (ORDER BY CASE WHEN regexp_matches(cell, '^[0-9]+$') THEN 0 ELSE 1 END, try_cast(cell AS DOUBLE), cell, p_partkey) AS place FROM c""",
)
def f1_sort_table(spark, d):
    """Place of each row: range-partitioned sort, then numbered across partitions."""
    cell = F.when(F.col("p_size") % 3 == 0, F.col("p_type")).otherwise(F.col("p_size").cast("string"))
    t = read(spark, d, "part").select("p_partkey", cell.alias("cell"))
    return tables.places(t, "cell", ["p_partkey"]).select("p_partkey", "cell", F.col("place").cast(L).alias("place"))


@query(
    "a2_read_delimited",
    """SELECT c_nationkey AS table_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS BIGINT) AS "row", c_custkey AS "key", c_acctbal AS bal, c_mktsegment AS seg FROM customer""",
)
def a2_read_delimited(spark, d):
    """Customers written as one delimited table a nation and read back."""
    line = F.concat_ws(" , ", F.col("c_custkey"), F.col("c_acctbal"), F.col("c_mktsegment"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", line.alias("line")))), lambda x: x["line"]), "\n")
    t = read(spark, d, "customer").groupBy(F.lit("c").alias("doc"), F.col("c_nationkey").alias("table_id")).agg(F.concat(F.lit("key,bal,seg\n\n"), body).alias("body"))
    cells = tables.read_delimited(t)
    wide = cells.groupBy("table_id", "row").pivot("name", ["key", "bal", "seg"]).agg(F.first("text"))
    return wide.select("table_id", F.col("row").cast(L).alias("row"), F.col("key").cast(L).alias("key"), F.col("bal").cast("double").alias("bal"), "seg")


@query(
    "a3_read_pipe_grid",
    """SELECT p_brand AS doc, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS BIGINT) AS "row", CAST(p_partkey AS DOUBLE) AS "key", p_name AS name, 'right' AS align FROM part""",
)
def a3_read_pipe_grid(spark, d):
    line = F.concat(F.lit("| "), F.col("p_partkey"), F.lit(" | "), F.col("p_name"), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"]), "\n")
    t = read(spark, d, "part").groupBy(F.col("p_brand").alias("doc"), F.lit(1).alias("table_id")).agg(F.concat(F.lit("| key | name |\n|---:|:--|\n"), body).alias("body"))
    cells = tables.read_pipe_grid(t)
    of = lambda n, c: F.first(F.when(F.col("name") == n, F.col(c)), ignorenulls=True)
    return cells.groupBy("doc", F.col("row").cast(L).alias("row")).agg(of("key", "num").alias("key"), of("name", "text").alias("name"), of("key", "align").alias("align"))


@query(
    "a12_render_table",
    """WITH w AS (SELECT max(length(CAST(n_nationkey AS VARCHAR))) AS k FROM nation)
  SELECT 'n' AS doc, string_agg(rpad(n_nationkey || ',', CAST(k + 1 AS INTEGER), ' ') || ' ' || n_name, chr(10) ORDER BY n_nationkey) AS body FROM nation, w""",
)
def a12_render_table(spark, d):
    n = read(spark, d, "nation")
    cells = n.select(F.lit("n").alias("doc"), F.lit(1).alias("table_id"), F.col("n_nationkey").alias("row"), F.posexplode(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("col", "text"))
    return tables.render_csv(cells).select("doc", "body")


@query(
    "a12_render_pipe",
    """SELECT n_regionkey AS doc, '| key | name |' || chr(10) || '| ---: | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || replace(n_name, 'A', chr(92) || '|') || ' |', chr(10) ORDER BY n_nationkey) AS body FROM nation GROUP BY 1""",
)
def a12_render_pipe(spark, d):
    """Nations of a region as a pipe table; names with pipes in place of A are escaped."""
    cell = lambda nr, name, align, text: F.struct(F.lit(nr).alias("col"), F.lit(name).alias("name"), F.lit(align).alias("align"), text.alias("text"))
    name = F.translate("n_name", "A", "|")
    cells = read(spark, d, "nation").select(F.col("n_regionkey").alias("doc"), F.lit(1).alias("table_id"), F.col("n_nationkey").alias("row"), F.inline(F.array(cell(0, "key", "right", F.col("n_nationkey").cast("string")), cell(1, "name", "none", name))))
    return tables.render_pipe(cells).select("doc", "body")


@query(
    "a4_inline_src",
    """SELECT doc_id, source AS src, CASE WHEN lang = 'fr' THEN NULL ELSE length(text) END AS n, lang = 'fr' AS external FROM documents""",
)
def a4_inline_src(spark, d):
    """Documents as table blocks whose source files are their texts; the French ones come as HTML and stay external."""
    docs = read(spark, d, "documents")
    files = docs.select(F.col("doc_id").cast("string").alias("path"), F.when(F.col("lang") == "fr", F.concat(F.lit("<p>"), "text")).otherwise(F.concat(F.lit("t\n"), "text")).alias("content"))
    t = docs.select("doc_id", "source", F.col("doc_id").cast("string").alias("src"))
    return tables.inline_src(t, files).select("doc_id", F.col("source").alias("src"), (F.length("body") - 2).cast(L).alias("n"), "external")


# ---- charts ------------------------------------------------------------------------------------


@query(
    "d17b_chart_points",
    """WITH e AS (SELECT *, user_id % 10 AS chart FROM events), bad AS (SELECT DISTINCT chart FROM e WHERE event_id % 977 = 0)
  SELECT chart, event_id AS pt, event_type AS series, value AS y FROM e WHERE chart NOT IN (SELECT chart FROM bad) AND event_id % 7 <> 0""",
)
def d17b_chart_points(spark, d):
    """A cell that is no number fails its chart; rows with an empty one are left out."""
    cell = F.when(F.col("event_id") % 977 == 0, "n/a").when(F.col("event_id") % 7 == 0, "").otherwise(F.col("value").cast("string"))
    e = read(spark, d, "events").withColumn("chart", F.col("user_id") % 10).withColumn("cell", cell)
    return charts.chart_points(e, "chart", "event_id", "ts", ["cell"], "event_type").select("chart", "pt", "series", "y")


@query(
    "d17b_chart_scopes",
    """WITH p AS (SELECT p_brand AS chart, p_partkey AS pt, CAST(p_size AS DOUBLE) AS y FROM part), s AS (SELECT chart, -1 AS pt, sum(y) AS y FROM p WHERE chart <> 'Brand#11' GROUP BY 1)
  SELECT 'all' AS scope, chart, pt, y, NULL AS message FROM p UNION ALL SELECT 'all', chart, pt, y, NULL FROM s UNION ALL SELECT 'summary', chart, pt, y, NULL FROM s
  UNION ALL SELECT DISTINCT 'all', chart, NULL, NULL, 'chart: rows=all but the table has no summary row; using data rows' FROM p WHERE chart = 'Brand#11'
  UNION ALL SELECT DISTINCT 'summary', chart, NULL, NULL, 'chart: rows=summary but the table has no summary row' FROM p WHERE chart = 'Brand#11'""",
)
def d17b_chart_scopes(spark, d):
    """Points of a chart's data and summary rows, and what charts without a summary row raise."""
    t = read(spark, d, "part").select(F.col("p_brand").alias("chart"), F.col("p_partkey").alias("pt"), F.lit("x").alias("x"), F.col("p_size").alias("y"))
    foot = tables.summary_row(t.where("chart <> 'Brand#11'"), "y = sum(y)", ["chart"]).withColumn("pt", F.lit(-1)).withColumn("x", F.lit("x"))
    both = tables.with_summary(t.withColumn("y", F.col("y").cast("double")), foot)
    out = None
    for scope in ("all", "summary"):
        points = charts.chart_points(both, "chart", "pt", "x", ["y"], rows=scope).select("chart", F.col("pt").cast(L).alias("pt"), "y")
        faults = charts.chart_faults(both, "chart", ["y"], rows=scope).select("chart", "message")
        own = points.unionByName(faults, allowMissingColumns=True).withColumn("scope", F.lit(scope))
        out = own if out is None else out.unionByName(own)
    return out.select("scope", "chart", "pt", "y", "message")


TYPES = ["click", "error", "purchase", "signup", "view"]


@query(
    "d18_series_pivot",
    "SELECT user_id AS category, "
    + ", ".join(f"arg_max(value, event_id) FILTER (event_type = '{t}') AS \"{t}\"" for t in TYPES)
    + " FROM events GROUP BY 1",
)
def d18_series_pivot(spark, d):
    p = read(spark, d, "events").select(F.lit("c").alias("chart"), F.col("user_id").alias("category"), F.col("event_type").alias("series"), F.col("value").alias("y"), F.col("event_id").alias("pt"))
    return charts.series_pivot(p, TYPES).drop("chart")


@query("d19_pie_share", "SELECT p_brand AS chart, p_partkey AS pt, round(p_retailprice / sum(p_retailprice) OVER (PARTITION BY p_brand), 8) AS share FROM part")
def d19_pie_share(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("chart"), F.col("p_partkey").alias("pt"), F.col("p_retailprice").alias("y"))
    return charts.pie_share(p).select("chart", "pt", F.round("share", 8).alias("share"))


@query(
    "d20_axis_extent",
    """WITH e AS (SELECT event_type AS chart, least(0.0, min(value)) AS lo, greatest(0.0, max(value)) AS hi FROM events GROUP BY 1), u AS (SELECT *, pow(10.0, floor(log10(hi))) AS unit FROM e)
  SELECT chart, round(lo, 6) AS lo, round(hi, 6) AS hi, CASE WHEN hi / unit <= 1 THEN 1.0 WHEN hi / unit <= 2 THEN 2.0 WHEN hi / unit <= 5 THEN 5.0 ELSE 10.0 END * unit AS nice FROM u""",
)
def d20_axis_extent(spark, d):
    p = read(spark, d, "events").select(F.col("event_type").alias("chart"), F.col("value").alias("y"))
    return charts.axis_extent(p).select("chart", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "nice")


@query(
    "c10_chart_binding",
    """SELECT c_custkey AS doc, CASE WHEN c_custkey % 5 = 0 THEN 'missing data' WHEN c_custkey % 5 = 1 THEN 'not a table' WHEN c_custkey % 5 = 2 THEN 'unresolved' END AS reason FROM customer""",
)
def c10_chart_binding(spark, d):
    k = F.col("c_custkey") % 5
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("doc"), F.lit(1).alias("chart_id"), F.when(k == 0, None).when(k == 1, "head").when(k == 2, "gone").otherwise("tab").alias("data"))
    t = c.select("doc", F.lit("tab").alias("table_id"))
    ids = t.select("doc", F.explode(F.array(F.lit("tab"), F.lit("head"))).alias("id"))
    return charts.chart_binding(c, t, ids).select("doc", "reason")


# ---- graph -------------------------------------------------------------------------------------


@query("c7_resolve_edges", f"WITH {EDGES} SELECT kind, \"from\", \"to\", to_text, count(*) AS n FROM edges GROUP BY ALL")
def c7_resolve_edges(spark, d):
    return edges(spark, d).groupBy("kind", "from", "to", "to_text").agg(F.count("*").alias("n"))


@query("d7_degrees", f"WITH {EDGES} SELECT anchor, out_degree, in_degree FROM classified")
def d7_degrees(spark, d):
    return graph.degrees(edges(spark, d), symbols(spark, d))


@query("d9_module_index", f"WITH {EDGES} SELECT container, count(*) AS methods, count(*) FILTER (entry) AS entries, count(*) FILTER (test) AS tests FROM classified GROUP BY 1")
def d9_module_index(spark, d):
    return graph.module_index(graph.classify(symbols(spark, d), edges(spark, d)))


MODULE_EDGES = """medges AS (SELECT a.container AS a, b.container AS b, count(*) AS calls FROM edges e JOIN symbols a ON a.anchor = e."from" JOIN symbols b ON b.anchor = e."to" WHERE e.kind = 'calls' AND a.container <> b.container GROUP BY 1, 2)"""


@query("d10_module_edges", f"WITH {EDGES}, {MODULE_EDGES} SELECT a, b, calls FROM medges")
def d10_module_edges(spark, d):
    return graph.module_edges(edges(spark, d), symbols(spark, d))


MODS = """mods AS (SELECT anchor, path, split_part(path, '/', 1) AS seg, start FROM (SELECT 'p:' || p_partkey AS anchor, CASE WHEN p_size = 50 THEN 'solo' WHEN p_size = 49 THEN 'economy' ELSE lower(replace(p_type, ' ', '/')) END AS path, p_size = 1 AND p_retailprice > 1500 AS start FROM part)),
tops AS (SELECT seg, CASE WHEN count(DISTINCT path) = 1 AND bool_or(path = seg) THEN seg ELSE 'g:' || seg END AS key, bool_or(start) AS start FROM mods GROUP BY 1),
pm AS (SELECT a.path AS a, b.path AS b, a.seg AS sa, b.seg AS sb, count(*) AS calls FROM edges e JOIN mods a ON a.anchor = e."from" JOIN mods b ON b.anchor = e."to" WHERE e.kind = 'calls' AND a.path <> b.path GROUP BY 1, 2, 3, 4),
shown AS (SELECT '' AS view, x.key AS "from", y.key AS "to", calls FROM pm JOIN tops x ON x.seg = sa JOIN tops y ON y.seg = sb UNION ALL SELECT sa, a, CASE WHEN sb = sa THEN b ELSE 'x:' || sb END, calls FROM pm UNION ALL SELECT sb, 'x:' || sa, b, calls FROM pm WHERE sa <> sb),
rolled AS (SELECT view, "from", "to", CAST(sum(calls) AS BIGINT) AS calls FROM shown WHERE "from" <> "to" GROUP BY 1, 2, 3),
nodes AS (SELECT '' AS view, key AS node, seg AS label, false AS external, start FROM tops UNION ALL SELECT seg, path, CASE WHEN path = seg THEN seg ELSE substr(path, length(seg) + 2) END, false, bool_or(start) FROM mods GROUP BY seg, path
  UNION ALL SELECT DISTINCT view, node, substr(node, 3), true, false FROM (SELECT view, "from" AS node FROM rolled UNION ALL SELECT view, "to" FROM rolled) WHERE view <> '' AND node LIKE 'x:%'),
rooted AS (SELECT *, start OR (NOT external AND NOT EXISTS (SELECT 1 FROM rolled r WHERE r.view = nodes.view AND r."to" = nodes.node)) AS own FROM nodes)"""


def _modules(spark, d):
    """Part types as a tree of modules; sizes 50 and 49 lie in a module that is all of its segment, and in one beside others of it."""
    p, size = read(spark, d, "part"), F.col("p_size")
    path = F.when(size == 50, "solo").when(size == 49, "economy").otherwise(F.lower(F.replace("p_type", F.lit(" "), F.lit("/"))))
    own = p.select(F.concat(F.lit("p:"), "p_partkey").alias("anchor"), path.alias("container"), ((size == 1) & (F.col("p_retailprice") > 1500)).alias("start"))
    modules = own.groupBy(F.lit("r").alias("repo"), F.col("container").alias("path")).agg(F.max("start").alias("start"))
    return graph.rollup_modules(modules, graph.module_edges(edges(spark, d), own).withColumn("repo", F.lit("r")))


@query("d11_rollup_modules", f"WITH {EDGES}, {MODS} SELECT view, \"from\", \"to\", calls FROM rolled")
def d11_rollup_modules(spark, d):
    """Module edges of both tiers."""
    return _modules(spark, d)[1].drop("repo")


@query("d11_rollup_nodes", f"WITH {EDGES}, {MODS} SELECT view, node, label, external, start, own OR NOT bool_or(own) OVER (PARTITION BY view) AS root FROM rooted")
def d11_rollup_nodes(spark, d):
    """Modules of both tiers, stubs of other segments, and roots."""
    return _modules(spark, d)[0].drop("repo")


@query("d12_unresolved_by_symbol", f"WITH {EDGES} SELECT DISTINCT \"from\", to_text FROM edges WHERE \"to\" IS NULL")
def d12_unresolved_by_symbol(spark, d):
    return graph.unresolved_by_symbol(edges(spark, d))


@query(
    "d13_build_stats",
    f"""WITH {EDGES} SELECT (SELECT count(DISTINCT container) FROM symbols) AS containers, (SELECT count(*) FROM symbols) AS symbols, (SELECT count(*) FROM edges) AS edges,
  (SELECT count("to") FROM edges) AS resolved, count(*) FILTER (leaf) AS leaves, count(*) FILTER (entry) AS entries FROM classified""",
)
def d13_build_stats(spark, d):
    s, e = symbols(spark, d), edges(spark, d)
    return graph.build_stats(s, e, graph.classify(s, e))


@query(
    "d14_edge_quality",
    f"""WITH {EDGES}, q AS (SELECT kind, CASE WHEN "to" IS NOT NULL THEN 'yes' ELSE 'no' END AS resolved, CASE WHEN "to" IS NOT NULL AND "from" <> "to" THEN 'yes' ELSE 'no' END AS cross_file FROM edges)
  SELECT kind, resolved, cross_file, count(*) AS n, CAST(grouping(kind) * 4 + grouping(resolved) * 2 + grouping(cross_file) AS BIGINT) AS level FROM q GROUP BY CUBE (kind, resolved, cross_file)""",
)
def d14_edge_quality(spark, d):
    return graph.edge_quality(edges(spark, d), F.col("to").isNotNull() & (F.col("from") != F.col("to")))


@query("d6_flow_criticality", "SELECT user_id AS entry, max(value) AS criticality FROM events WHERE event_type = 'purchase' GROUP BY 1 HAVING max(value) >= 20")
def d6_flow_criticality(spark, d):
    f = read(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("entry"), F.col("value").alias("criticality"))
    return graph.flow_criticality(f, 20)


@query("d4_dedupe_symbols", f"WITH {SYMBOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY id) AS nr FROM symbols) SELECT name AS anchor, id FROM r WHERE nr = 1")
def d4_dedupe_symbols(spark, d):
    s = symbols(spark, d).withColumn("anchor", F.col("name"))
    a, b = s.where("id % 2 = 0"), s.where("id % 2 = 1")
    return graph.dedupe_symbols(graph.merge_inputs(a, b), ["id"]).select("anchor", "id")


@query(
    "g1_merge_inputs",
    f"""WITH {SYMBOLS}, m AS (SELECT name AS anchor, id, id % 2 AS input_no FROM symbols), r AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY input_no, id) AS nr FROM m)
  SELECT CAST(input_no AS BIGINT) AS input_no, count(*) FILTER (nr > 1) AS dropped FROM r GROUP BY 1""",
)
def g1_merge_inputs(spark, d):
    """Two extracts, the first winning; what each lost."""
    s = symbols(spark, d).withColumn("anchor", F.col("name"))
    m = graph.merge_inputs(s.where("id % 2 = 0"), s.where("id % 2 = 1").drop("kind"))
    return graph.dropped_per_input(m, ["input_no", "id"]).select(F.col("input_no").cast(L).alias("input_no"), "dropped")


@query("d5_widest_definition", f"WITH {SYMBOLS}, r AS (SELECT *, row_number() OVER (PARTITION BY name, container ORDER BY line_end - line_start DESC, id) AS nr FROM symbols) SELECT name, container, id FROM r WHERE nr = 1")
def d5_widest_definition(spark, d):
    return graph.widest_definition(symbols(spark, d), ["name", "container"], ["id"]).select("name", "container", "id")


@query(
    "e3_number_collisions",
    f"""WITH {SYMBOLS}, r AS (SELECT *, file || '#' || name AS base, row_number() OVER (PARTITION BY file || '#' || name ORDER BY line_start, id) AS nr FROM symbols)
  SELECT id, CASE WHEN nr = 1 THEN base ELSE base || '~' || nr END AS anchor FROM r""",
)
def e3_number_collisions(spark, d):
    s = symbols(spark, d).withColumn("base", F.concat("file", F.lit("#"), "name"))
    return graph.number_collisions(s).select("id", "anchor")


@query(
    "e4_block_ids",
    f"""WITH {SYMBOLS}, s AS (SELECT anchor, container, replace(name, '.', '-') AS slug, sha256(anchor) AS h FROM symbols), n AS (SELECT container, slug, count(*) AS m,
  CASE WHEN count(DISTINCT substr(h, 1, 6)) = count(*) THEN 6 WHEN count(DISTINCT substr(h, 1, 8)) = count(*) THEN 8 ELSE 10 END AS k FROM s GROUP BY 1, 2)
  SELECT anchor, CASE WHEN m = 1 THEN slug ELSE slug || '-' || substr(h, 1, k) END AS block_id FROM s JOIN n USING (container, slug)""",
)
def e4_block_ids(spark, d):
    s = symbols(spark, d).withColumn("slug", F.replace("name", F.lit("."), F.lit("-")))
    return graph.block_ids(s).select("anchor", "block_id")


@query(
    "e5_doc_names",
    """WITH c AS (SELECT p_type || '/' || p_name AS container, min(p_partkey) AS first_seen FROM part GROUP BY 1), s AS (SELECT *, replace(split_part(container, '/', 2), ' ', '-') AS slug FROM c),
  r AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY first_seen) AS nr FROM s) SELECT container, CASE WHEN nr = 1 THEN slug ELSE slug || '-' || nr END AS doc_name FROM r""",
)
def e5_doc_names(spark, d):
    c = read(spark, d, "part").groupBy(F.concat("p_type", F.lit("/"), "p_name").alias("container")).agg(F.min("p_partkey").alias("first_seen"))
    return graph.doc_names(c.withColumn("slug", F.replace(F.substring_index("container", "/", -1), F.lit(" "), F.lit("-")))).select("container", "doc_name")


@query("e10_extension_share", "WITH n AS (SELECT source AS repo, lang, count(*) AS n FROM documents GROUP BY 1, 2) SELECT repo, lang, n, round(n / sum(n) OVER (PARTITION BY repo), 6) AS share FROM n QUALIFY n / sum(n) OVER (PARTITION BY repo) >= 0.05")
def e10_extension_share(spark, d):
    return graph.language_shares(read(spark, d, "documents").select(F.col("source").alias("repo"), "lang")).select("repo", "lang", "n", F.round("share", 6).alias("share"))


@query(
    "d15_detect_languages",
    """WITH n AS (SELECT source AS repo, lang, count(*) AS n FROM documents GROUP BY 1, 2), s AS (SELECT repo, lang FROM n QUALIFY n / sum(n) OVER (PARTITION BY repo) >= 0.2)
  SELECT repo, lang FROM s UNION SELECT source, lang FROM documents WHERE doc_id % 50 = 0""",
)
def d15_detect_languages(spark, d):
    """Languages by share, and those a manifest (every fiftieth document) names."""
    docs = read(spark, d, "documents").select(F.col("source").alias("repo"), "lang", "doc_id")
    return graph.detect_languages(docs, docs.where("doc_id % 50 = 0"), 0.2)


@query(
    "d15_manifest_languages",
    """WITH f AS (SELECT source AS repo, doc_id % 40 AS j FROM documents) SELECT DISTINCT repo, CASE j WHEN 0 THEN 'rust' WHEN 1 THEN 'java' WHEN 2 THEN 'go' ELSE 'typescript' END AS lang FROM f WHERE j BETWEEN 0 AND 3""",
)
def d15_manifest_languages(spark, d):
    """Files of repositories, some of them manifests, or named nearly like one."""
    names = F.array(*[F.lit(x) for x in ("Cargo.toml", "a/build.gradle.kts", "go.mod", "web/app/tsconfig.json", "cargo.toml", "tsconfig.json.bak", "src/main.rs", "pom.xml/x.py")])
    files = read(spark, d, "documents").select(F.col("source").alias("repo"), F.coalesce(F.get(names, (F.col("doc_id") % 40).cast("int")), F.lit("README.md")).alias("path"))
    return graph.manifest_languages(files)


@query(
    "g5_roots_of",
    f"""WITH {EDGES}, u AS (SELECT * FROM classified WHERE entry OR anchor NOT IN (SELECT "to" FROM links)),
  a AS (SELECT *, bool_and(leaf) OVER (PARTITION BY container) AS all_leaves FROM u) SELECT container, anchor FROM a WHERE NOT leaf OR all_leaves""",
)
def g5_roots_of(spark, d):
    s, e = symbols(spark, d), edges(spark, d)
    return graph.roots_of(graph.classify(s, e), e)


@query(
    "g6_connected_roots",
    f"""WITH {EDGES}, s AS (SELECT s.anchor, s.container AS slice FROM symbols s), t AS (SELECT s.slice, s.anchor, EXISTS (SELECT 1 FROM links l JOIN s a ON a.anchor = l."from" WHERE a.slice = s.slice AND s.slice < 'Brand#3' AND s.anchor IN (l."from", l."to")) AS touched FROM s WHERE s.anchor LIKE '%7'),
  m AS (SELECT *, bool_or(touched) OVER (PARTITION BY slice) AS hit FROM t) SELECT slice, anchor FROM m WHERE touched OR NOT hit""",
)
def g6_connected_roots(spark, d):
    """A slice a container, of the calls of its symbols; containers after Brand#3 have no calls, so all their roots stay."""
    s = symbols(spark, d).select("anchor", F.col("container").alias("slice"))
    calls = graph.links(edges(spark, d)).join(s.select(F.col("anchor").alias("from"), "slice"), "from").where("slice < 'Brand#3'")
    return graph.connected_roots(s.where(F.col("anchor").endswith("7")), calls)


@query("g6_isolated", f"WITH {EDGES} SELECT anchor FROM symbols WHERE anchor NOT IN (SELECT \"from\" FROM edges) AND anchor NOT IN (SELECT \"to\" FROM edges WHERE \"to\" IS NOT NULL)")
def g6_isolated(spark, d):
    return graph.isolated(symbols(spark, d).select("anchor"), edges(spark, d))


@query(
    "g3_diff_edges",
    """WITH o AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber <= 4), n AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_linenumber >= 3)
  SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n)""",
)
def g3_diff_edges(spark, d):
    li = read(spark, d, "lineitem")
    return graph.diff_edges(li.where("l_linenumber <= 4").select("l_partkey", "l_suppkey"), li.where("l_linenumber >= 3").select("l_partkey", "l_suppkey"))


@query("g4_dropped_ids", "SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'A' EXCEPT SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R'")
def g4_dropped_ids(spark, d):
    li = read(spark, d, "lineitem").select(F.lit("id").alias("tag"), F.lit("d").alias("doc"), F.col("l_partkey").alias("id"), "l_returnflag")
    return corpus.rejected_patches(li.where("l_returnflag = 'A'"), li.where("l_returnflag = 'R'")).select(F.col("id").alias("l_partkey"))


@query(
    "c8_dispatch",
    """WITH i AS (SELECT p_name AS member, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS candidates FROM part WHERE p_size < 25 GROUP BY 1)
  SELECT p.p_partkey, i.candidates, CASE WHEN i.member IS NULL THEN 'high' ELSE 'medium' END AS confidence FROM part p LEFT JOIN i ON i.member = p.p_name""",
)
def c8_dispatch(spark, d):
    p = read(spark, d, "part")
    out = graph.dispatch(p.select("p_partkey", F.col("p_name").alias("to")), p.where("p_size < 25").select(F.col("p_name").alias("member"), F.col("p_brand").alias("impl")))
    return out.select("p_partkey", F.array_join("candidates", ",").alias("candidates"), "confidence")


@query(
    "c9_verify_edges",
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'n' ELSE 's' || l_suppkey || '#' || (l_partkey % 30) || '.m' END AS cell FROM lineitem)
  SELECT cell, CASE WHEN cell = '' THEN 'empty cell' WHEN NOT contains(cell, '#') THEN 'no #' WHEN l_suppkey % 10 = 0 THEN 'missing doc' WHEN l_partkey % 30 >= 25 THEN 'missing id' END AS reason, count(*) AS n FROM r GROUP BY 1, 2""",
)
def c9_verify_edges(spark, d):
    ln = F.col("l_linenumber")
    cell = F.when(ln == 1, "").when(ln == 2, "n").otherwise(F.concat(F.lit("s"), F.col("l_suppkey"), F.lit("#"), F.col("l_partkey") % 30, F.lit(".m")))
    refs = read(spark, d, "lineitem").select(cell.alias("cell"))
    docs = read(spark, d, "supplier").where("s_suppkey % 10 <> 0").select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("doc"))
    ids = docs.select("doc", F.explode(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: i.cast("string"))).alias("id"))
    return graph.verify_edges(refs, ids, docs).groupBy("cell", "reason").agg(F.count("*").alias("n"))


HINTS = """hints AS (SELECT DISTINCT file, 'widget' AS hint, 'bin' AS via FROM symbols UNION SELECT DISTINCT file, CAST(NULL AS VARCHAR), 'page' FROM symbols UNION SELECT DISTINCT file || 'x', NULL, 'mount' FROM symbols),
lone AS (SELECT file, min(anchor) AS anchor FROM symbols GROUP BY 1 HAVING count(*) = 1),
hit AS (SELECT h.file, h.hint, h.via, CASE WHEN h.hint IS NULL THEN (SELECT o.anchor FROM lone o WHERE o.file = h.file) ELSE (SELECT arg_min(s.anchor, (s.line_start, s.anchor)) FROM symbols s WHERE s.file = h.file AND (s.name = h.hint OR s.name LIKE '%.' || h.hint OR s.name LIKE '%::' || h.hint)) END AS anchor FROM hints h)"""


def _hints(s):
    """A named hint and an unnamed one for each file, and one for a file without methods."""
    files = s.select("file").distinct()
    hint = lambda file, name, via: files.select(file.alias("file"), F.lit(name).cast("string").alias("hint"), F.lit(via).alias("via"))
    return hint(F.col("file"), "widget", "bin").unionByName(hint(F.col("file"), None, "page")).unionByName(hint(F.concat("file", F.lit("x")), None, "mount"))


@query("c12_entry_hints", f"WITH {SYMBOLS}, {HINTS} SELECT file, hint, via, anchor FROM hit")
def c12_entry_hints(spark, d):
    s = symbols(spark, d)
    return graph.entry_hints(s, _hints(s))


@query(
    "d8_classify_symbols",
    f"""WITH {EDGES}, {HINTS}, named AS (SELECT c.*, CASE WHEN s.id % 5 = 0 THEN 'get' || c.name WHEN s.id % 5 = 1 THEN 'is.' || c.name ELSE c.name END AS n FROM classified c JOIN symbols s USING (anchor))
  SELECT anchor, leaf, leaf AND regexp_matches(n, '^(get|set|is)([^a-z]|$)') AS accessor, test, entry OR anchor IN (SELECT anchor FROM hit WHERE anchor IS NOT NULL) AS entry FROM named""",
)
def d8_classify_symbols(spark, d):
    """Calls to members reach their implementations, hints mark program starts; some symbols are named as accessors are."""
    s = symbols(spark, d)
    starts, _ = graph.app_entries(s, _hints(s))
    named = s.withColumn("name", F.when(F.col("id") % 5 == 0, F.concat(F.lit("get"), "name")).when(F.col("id") % 5 == 1, F.concat(F.lit("is."), "name")).otherwise(F.col("name")))
    return graph.classify(named, edges(spark, d), starts).select("anchor", "leaf", "accessor", "test", "entry")


@query(
    "d8b_app_entries",
    f"""WITH {SYMBOLS}, {HINTS}, m AS (SELECT file, anchor, via FROM hit WHERE anchor IS NOT NULL) SELECT file, anchor, min(via) AS via FROM m GROUP BY 1, 2
  UNION ALL SELECT DISTINCT file, NULL, via FROM hit WHERE anchor IS NULL""",
)
def d8b_app_entries(spark, d):
    """Program starts: methods that hints mark, with the convention that did, and files without such a method."""
    s = symbols(spark, d)
    entries, files = graph.app_entries(s, _hints(s))
    return entries.unionByName(files, allowMissingColumns=True)


@query(
    "c13_who_calls",
    f"""WITH {EDGES}, k AS (SELECT 'p:' || (c_custkey * 3) AS anchor FROM customer) SELECT k.anchor, s.anchor IS NOT NULL AS found, e."from" AS caller, e.kind, e.site_file || ':' || e.site_line AS site, count(*) AS n
  FROM k LEFT JOIN symbols s ON s.anchor = k.anchor LEFT JOIN links e ON e."to" = k.anchor GROUP BY 1, 2, 3, 4, 5""",
)
def c13_who_calls(spark, d):
    """Callers of many symbols at once, with the place of each call; some symbols don't exist."""
    k = read(spark, d, "customer").select(F.concat(F.lit("p:"), F.col("c_custkey") * 3).alias("anchor"))
    site = F.concat("site.file", F.lit(":"), "site.line").alias("site")
    return graph.who_calls(k, symbols(spark, d), edges(spark, d)).groupBy("anchor", "found", "caller", "kind", site).agg(F.count("*").alias("n"))


@query("c13_open_symbol", f"WITH {SYMBOLS}, k AS (SELECT 'p:' || (c_custkey * 3) AS anchor FROM customer) SELECT k.anchor, s.name, s.file, s.line_start, s.anchor IS NOT NULL AS found FROM k LEFT JOIN symbols s ON s.anchor = k.anchor")
def c13_open_symbol(spark, d):
    k = read(spark, d, "customer").select(F.concat(F.lit("p:"), F.col("c_custkey") * 3).alias("anchor"))
    return graph.open_symbol(k, symbols(spark, d)).select("anchor", "name", "file", "line_start", "found")


@query(
    "c14_changed_docs",
    """WITH a AS (SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS h FROM conversations WHERE turn < 3 GROUP BY 1), b AS (SELECT conv_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS h FROM conversations WHERE conv_id % 7 <> 0 GROUP BY 1)
  SELECT coalesce(a.conv_id, b.conv_id) AS doc, CASE WHEN a.h IS NULL THEN 'new' WHEN b.h IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'unchanged' END AS change FROM a FULL JOIN b USING (conv_id)""",
)
def c14_changed_docs(spark, d):
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n")
    of = lambda c: c.groupBy(F.col("conv_id").alias("doc")).agg(F.sha2(text, 256).alias("hash"))
    c = read(spark, d, "conversations")
    return graph.changed_docs(of(c.where("turn < 3")), of(c.where("conv_id % 7 <> 0")))


@query("d21_multi_candidates", f"WITH {SYMBOLS}, l AS (SELECT name, anchor FROM symbols UNION SELECT split_part(name, '.', 2), anchor FROM symbols) SELECT name, count(*) AS n FROM l GROUP BY 1 HAVING count(*) > 1")
def d21_multi_candidates(spark, d):
    return search.ambiguous_names(search.name_lookup(symbols(spark, d)))


@query(
    "f2_search_names",
    f"""WITH {SYMBOLS}, l AS (SELECT name, anchor FROM symbols UNION SELECT split_part(name, '.', 2), anchor FROM symbols), q AS (SELECT DISTINCT lower(substr(p_name, 1, 3)) AS q FROM part UNION SELECT 'ring' UNION SELECT 'olt'),
  b AS (SELECT q, anchor, min({{}}) AS score FROM l JOIN q ON contains(lower(name), q) GROUP BY 1, 2),
  n AS (SELECT q, l.anchor, b.score, min(name) AS name FROM l JOIN q ON contains(lower(name), q) JOIN b USING (q, anchor) WHERE {{}} = b.score GROUP BY 1, 2, 3),
  r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score, name, anchor) AS nr, count(*) OVER (PARTITION BY q) AS total FROM n) SELECT q, anchor, CAST(score AS BIGINT) AS score, total FROM r WHERE nr <= 100""".replace(
        "{}", "CASE WHEN lower(name) = q THEN 0 WHEN starts_with(lower(name), q) THEN 1 WHEN starts_with(regexp_extract(lower(name), '([^.:]*)$', 1), q) THEN 2 ELSE 3 END"
    ),
)
def f2_search_names(spark, d):
    words = read(spark, d, "part").select(F.lower(F.substring("p_name", 1, 3)).alias("q")).distinct()
    q = words.union(spark.createDataFrame([("Ring ",), ("olt",)], "q string"))
    return search.search_names(search.name_lookup(symbols(spark, d)), q).withColumn("score", F.col("score").cast(L))


@query("f3_find_names", f"WITH {SYMBOLS} SELECT name, anchor, file FROM symbols WHERE contains(lower(name), 'gear')")
def f3_find_names(spark, d):
    return search.find_names(symbols(spark, d), " GEAR")


@query("f4_top_modules", f"WITH {EDGES}, {MODULE_EDGES} SELECT a, b, calls FROM medges ORDER BY calls DESC, a, b LIMIT 20")
def f4_top_modules(spark, d):
    """The twenty heaviest module edges: a top-k report."""
    return graph.top_module_edges(graph.module_edges(edges(spark, d), symbols(spark, d)))


@query("f4_top_methods", f"WITH {EDGES} SELECT container, count(*) AS methods, count(*) FILTER (entry) AS entries, count(*) FILTER (test) AS tests FROM classified GROUP BY 1 ORDER BY methods DESC, container LIMIT 20")
def f4_top_methods(spark, d):
    """The twenty containers with most methods: a top-k report."""
    s, e = symbols(spark, d), edges(spark, d)
    return graph.top_modules(graph.module_index(graph.classify(s, e)))


# ---- intervals ---------------------------------------------------------------------------------

DEFS = """defs AS (SELECT o_custkey AS file, CAST(epoch(o_orderdate) / 86400 AS BIGINT) AS start, CAST(epoch(o_orderdate) / 86400 AS BIGINT) + o_orderkey % 90 AS "end", 'o' || o_orderkey AS symbol FROM orders),
occ AS (SELECT DISTINCT o.o_custkey AS file, CAST(epoch(l.l_shipdate) / 86400 AS BIGINT) AS line, 'l' || l.l_orderkey || '.' || l.l_linenumber || '.' || l.l_partkey AS ref FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey)"""


def _defs(spark, d):
    day = lambda c: F.floor(F.unix_timestamp(c) / 86400).cast(L)
    o = read(spark, d, "orders")
    defs = o.select(F.col("o_custkey").alias("file"), day("o_orderdate").alias("start"), (day("o_orderdate") + F.col("o_orderkey") % 90).alias("end"), F.concat(F.lit("o"), F.col("o_orderkey")).alias("symbol"))
    li = read(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    occ = li.select(F.col("o_custkey").alias("file"), day("l_shipdate").alias("line"), F.concat(F.lit("l"), F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey")).alias("ref")).distinct()
    return occ, defs


@query(
    "c5_attribute_calls",
    f"""WITH {DEFS}, r AS (SELECT o.*, d.symbol, row_number() OVER (PARTITION BY o.file, o.line, o.ref ORDER BY d."end" - d.start, d.start DESC, d.symbol) AS nr FROM occ o JOIN defs d ON d.file = o.file AND o.line BETWEEN d.start AND d."end")
  SELECT file, line, ref, symbol FROM r WHERE nr = 1""",
)
def c5_attribute_calls(spark, d):
    return intervals.attribute_calls(*_defs(spark, d))


@query(
    "c6_attribute_calls_asof",
    f"""WITH {DEFS}, r AS (SELECT o.*, d.symbol, row_number() OVER (PARTITION BY o.file, o.line, o.ref ORDER BY d.start DESC, d.symbol DESC) AS nr FROM occ o JOIN defs d ON d.file = o.file AND d.start <= o.line)
  SELECT file, line, ref, symbol FROM r WHERE nr = 1""",
)
def c6_attribute_calls_asof(spark, d):
    return intervals.attribute_calls_asof(*_defs(spark, d))


@query(
    "c5b_remap_lines",
    """SELECT 'b' || (p_size % 7) AS file, p_size + 100 AS line, CASE WHEN p_size % 7 < 3 AND p_size BETWEEN 10 AND 30 THEN 'tpl' || (p_size % 7) END AS symbol, count(*) AS n FROM part WHERE p_size % 2 = 0 GROUP BY 1, 2, 3""",
)
def c5b_remap_lines(spark, d):
    """Occurrences moved to their original lines; some of these lie in a template."""
    p = read(spark, d, "part")
    occ = p.select(F.lit("gen").alias("file"), F.col("p_size").alias("line"), F.col("p_name").alias("ref"))
    m = p.select("p_size").distinct().where("p_size % 2 = 0").select(F.lit("gen").alias("file"), F.col("p_size").alias("line"), F.concat(F.lit("b"), F.col("p_size") % 7).alias("orig_file"), (F.col("p_size") + 100).alias("orig_line"))
    regions = spark.range(3).select(F.concat(F.lit("b"), "id").alias("file"), F.lit(110).alias("start"), F.lit(130).alias("end"), F.concat(F.lit("tpl"), "id").alias("symbol"))
    return intervals.remap_lines(occ, m, regions).groupBy("file", "line", "symbol").agg(F.count("*").alias("n"))


# ---- walks -------------------------------------------------------------------------------------

ROOTS = """roots AS (SELECT 'p:' || p_partkey AS root FROM part WHERE p_size = 7)"""


def _roots(spark, d):
    return read(spark, d, "part").where("p_size = 7").select(F.concat(F.lit("p:"), F.col("p_partkey")).alias("root"))


ALL_ROOTS = """calledc AS (SELECT DISTINCT "to" AS anchor FROM links), candidates AS (SELECT c.* FROM classified c LEFT JOIN calledc t USING (anchor) WHERE c.entry OR t.anchor IS NULL),
every AS (SELECT *, bool_and(leaf) OVER (PARTITION BY container) AS all_leaves FROM candidates), roots AS (SELECT anchor AS root FROM every WHERE NOT leaf OR all_leaves), e AS (SELECT DISTINCT "from", "to" FROM links)"""


def _levels(depth: int, cap: int, e: str = "e") -> str:
    """What each root reaches, level by level, and the first ``cap`` nodes of it."""
    out = ["w0 AS (SELECT root, root AS node, 0 AS depth FROM roots)"]
    for k in range(1, depth + 1):
        out.append(f'''l{k} AS (SELECT DISTINCT w.root, e."to" AS node FROM w{k - 1} w JOIN {e} e ON e."from" = w.node WHERE w.depth = {k - 1}),
  w{k} AS (SELECT root, node, depth FROM w{k - 1} UNION ALL SELECT l.root, l.node, {k} FROM l{k} l ANTI JOIN w{k - 1} w ON w.root = l.root AND w.node = l.node)''')
    return ", ".join(out) + f""", r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS nr FROM w{depth}) SELECT root, node, CAST(depth AS BIGINT) AS depth FROM r WHERE nr <= {cap}"""


@query("i1_callees", f"WITH {EDGES}, {ALL_ROOTS}, {_levels(6, 4000)}")
def i1_callees(spark, d):
    """From every root, with the walk's own depth and cap."""
    return walk.walk(edges(spark, d), _every_root(spark, d)).withColumn("depth", F.col("depth").cast(L))


@query("i1_callees_asked", f"""WITH {EDGES}, roots AS (SELECT 'p:' || (s_suppkey * 5) AS root FROM supplier), e AS (SELECT DISTINCT "from", "to" FROM links), {_levels(6, 4000)}""")
def i1_callees_asked(spark, d):
    """What the symbols asked for, one a supplier, lead to, with the walk's own depth and cap."""
    asked = read(spark, d, "supplier").select(F.concat(F.lit("p:"), F.col("s_suppkey") * 5).alias("root"))
    return walk.walk(edges(spark, d), asked).withColumn("depth", F.col("depth").cast(L))


@query(
    "i2_callers",
    f"""WITH RECURSIVE {EDGES}, roots AS (SELECT 'p:' || (s_suppkey * 5) AS root FROM supplier), e AS (SELECT DISTINCT "from", "to" FROM links),
  w(root, node, depth) USING KEY (root, node) AS (SELECT root, root, 0 FROM roots UNION SELECT w.root, e."from", min(w.depth) + 1 FROM w JOIN e ON e."to" = w.node LEFT JOIN recurring.w AS k ON k.root = w.root AND k.node = e."from" WHERE k.root IS NULL AND w.depth < 99 GROUP BY 1, 2),
  r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, node) AS nr FROM w) SELECT root, node, CAST(depth AS BIGINT) AS depth FROM r WHERE nr <= 4000""",
)
def i2_callers(spark, d):
    """Of the symbols asked for, one a supplier, with the operator's own depth and cap; a symbol that doesn't exist has no callers."""
    asked = read(spark, d, "supplier").select(F.concat(F.lit("p:"), F.col("s_suppkey") * 5).alias("root"))
    return walk.callers(edges(spark, d), asked).withColumn("depth", F.col("depth").cast(L))


@query(
    "i5_impact",
    f"""WITH RECURSIVE {EDGES}, {ROOTS}, w AS (SELECT root AS node FROM roots UNION SELECT e."from" FROM w JOIN links e ON e."to" = w.node) SELECT node FROM w""",
)
def i5_impact(spark, d):
    return walk.impact(edges(spark, d), _roots(spark, d))


def _every_root(spark, d):
    """Entries and uncalled symbols (g5)."""
    s, e = symbols(spark, d), edges(spark, d)
    return graph.roots_of(graph.classify(s, e), e).select(F.col("anchor").alias("root"))


@query("i3_layers")
def i3_layers(spark, d):
    """Slices of every root, with the walk's own depth and cap."""
    return walk.walk_layers(edges(spark, d), _every_root(spark, d))


# ---- references and paths ----------------------------------------------------------------------


@query("c1_unresolved_internal", f"WITH {LINKS}, ids AS (SELECT DISTINCT '/' || regexp_extract(html, '<h1>([^ <]*)', 1) AS id FROM pages) SELECT doc, href, count(*) AS n FROM links WHERE href NOT IN (SELECT id FROM ids) GROUP BY 1, 2")
def c1_unresolved_internal(spark, d):
    """Links of pages whose target is no page's first title word."""
    ids = read(spark, d, "pages").select(F.concat(F.lit("/"), F.regexp_extract("html", "<h1>([^ <]*)", 1)).alias("href")).distinct()
    return links(spark, d).join(ids, "href", "left_anti").groupBy("doc", "href").agg(F.count("*").alias("n"))


@query("c4_backlinks", f"WITH {LINKS} SELECT href, count(*) AS n, count(DISTINCT doc) AS docs, min(doc) AS first FROM links GROUP BY 1")
def c4_backlinks(spark, d):
    """Backlinks as rows by target; counts, never a list, as a popular target has very many."""
    return links(spark, d).groupBy("href").agg(F.count("*").alias("n"), F.countDistinct("doc").alias("docs"), F.min("doc").alias("first"))


@query("c3_duplicate_ids", f"WITH {LINKS} SELECT doc, href, count(*) - 1 AS extra FROM links GROUP BY 1, 2 HAVING count(*) > 1")
def c3_duplicate_ids(spark, d):
    """A page's links as definitions: what it names again."""
    ids = links(spark, d).select("doc", F.lit("id").alias("tag"), F.col("href").alias("id"), F.col("pos").alias("line"))
    return corpus.duplicate_ids(ids).groupBy("doc", F.col("id").alias("href")).agg(F.count("*").alias("extra"))


PATHS = "p AS (SELECT page_id, regexp_extract(url, '://[^/?#]*/?([^?#]*)', 1) AS path FROM pages)"


def _paths(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/?#]*/?([^?#]*)", 1).alias("path"))


@query("h9s_paths", f"WITH {PATHS} SELECT page_id, CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '(root)' END AS dir, CASE WHEN contains(path, '/') THEN split_part(path, '/', 1) ELSE '(root)' END AS top, rtrim(path, '/') || '/b' AS norm FROM p")
def h9s_paths(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("page_id", paths.directory(p).alias("dir"), paths.top(p).alias("top"), paths.normalize(F.concat(p, F.lit("/./a/../b"))).alias("norm"))


@query("b16_is_test_path", f"WITH {PATHS} SELECT page_id, page_id % 3 <> 2 AS test FROM p")
def b16_is_test_path(spark, d):
    k = F.col("page_id") % 3
    path = F.when(k == 0, F.concat(F.lit("Tests/"), "path", F.lit("/x"))).when(k == 1, F.concat("path", F.lit("/x.spec.js"))).otherwise(F.concat(F.lit("contest/"), "path", F.lit("/x.js")))
    return _paths(spark, d).select("page_id", paths.is_test(path).alias("test"))


@query("b17_language_of", f"WITH {SYMBOLS} SELECT id, CASE id % 4 WHEN 0 THEN 'javascript' WHEN 1 THEN 'python' WHEN 2 THEN 'cpp' END AS lang FROM symbols")
def b17_language_of(spark, d):
    ext = F.element_at(F.array(F.lit(".js"), F.lit(".PY"), F.lit(".hpp"), F.lit(".txt")), (F.col("id") % 4 + 1).cast("int"))
    return symbols(spark, d).select("id", paths.language(F.concat(F.lit("src/a.b/"), "name", ext)).alias("lang"))


@query("b15_exclude_paths", "SELECT p_partkey FROM part WHERE p_type NOT IN ('ECONOMY') AND p_brand <> 'Brand#4' AND NOT (p_type = 'STANDARD' AND p_brand = 'Brand#2')")
def b15_exclude_paths(spark, d):
    f = F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("/x.js"))
    ignored = spark.createDataFrame([("src/standard/Brand-2/x.js",), ("src/no/such.js",)], "path string")
    t = read(spark, d, "part").select("p_partkey", f.alias("file"))
    return paths.exclude_paths(t, "file", ["**/economy/**", "src/*/Brand-4/*.js"], ignored).select("p_partkey")


@query("b15b_confine_paths", "SELECT p_partkey FROM part WHERE p_size % 4 NOT IN (1, 2)")
def b15b_confine_paths(spark, d):
    k = F.col("p_size") % 4
    f = F.when(k == 1, "../x").when(k == 2, "a/../../x").when(k == 3, "a/../x").otherwise("x")
    return paths.confined(read(spark, d, "part").withColumn("f", f), "f").select("p_partkey")


@query("c11_nearest_root", f"WITH {PATHS} SELECT path, max(CASE WHEN page_id % 2 = 0 OR true THEN CASE WHEN path LIKE 'en/%' THEN 'en' WHEN path LIKE 'fr/%' THEN 'fr' ELSE '' END END) AS root FROM p GROUP BY 1")
def c11_nearest_root(spark, d):
    roots = spark.createDataFrame([("en",), ("fr",), ("",), ("fr/none/x",)], "root string")
    return paths.nearest_root(_paths(spark, d), roots)


@query(
    "h12s_common_prefix",
    """WITH g AS (SELECT p_brand, min(p_type || '/' || p_name) AS lo, max(p_type || '/' || p_name) AS hi FROM part GROUP BY 1)
  SELECT p_brand, CASE WHEN split_part(lo, '/', 1) <> split_part(hi, '/', 1) THEN 'src' WHEN lo <> hi THEN 'src/' || split_part(lo, '/', 1) ELSE 'src/' || lo END AS prefix FROM g""",
)
def h12s_common_prefix(spark, d):
    p = read(spark, d, "part").select("p_brand", F.concat(F.lit("src/"), "p_type", F.lit("/"), "p_name").alias("path"))
    return paths.common_prefix(p, ["p_brand"], "path")


@query("h10s_fold_prefix", "SELECT p_partkey, p_name AS folded FROM part")
def h10s_fold_prefix(spark, d):
    return read(spark, d, "part").select("p_partkey", paths.fold_prefix(F.concat(F.lit("com/acme/com/"), "p_name"), ["com", "com/acme"]).alias("folded"))


@query("h11s_split_source_root", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'test' ELSE 'main' END AS kind, p_name AS tail FROM part")
def h11s_split_source_root(spark, d):
    path = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("src/test/java/"), "p_name")).otherwise(F.concat(F.lit("src/main/java/"), "p_name"))
    cut = paths.split_source_root(path, [("src/main/*", "main"), ("src/test/*", "test"), ("src", "main")])
    return read(spark, d, "part").select("p_partkey", cut["kind"].alias("kind"), cut["tail"].alias("tail"))


@query(
    "h13s_display_path",
    """WITH p AS (SELECT DISTINCT p_brand AS module, 'src/main/java/com/' || p_type AS path FROM part), c AS (SELECT *, module || '/' || replace(path, 'src/main/java/com/', '') AS folded FROM p)
  SELECT module, path, folded AS display FROM c""",
)
def h13s_display_path(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("module"), F.concat(F.lit("src/main/java/com/"), "p_type").alias("path")).distinct()
    return paths.display_paths(p, ["com"], [("src/main/*", "main")]).select("module", "path", "display")


@query(
    "h13s_display_clashes",
    """WITH p AS (SELECT DISTINCT p_brand AS module, p_type AS t FROM part), two AS (SELECT module, t, u.path FROM p CROSS JOIN LATERAL (SELECT unnest(CASE WHEN t LIKE 'ECONOMY%' THEN ['src/main/java/com/' || t, 'src/main/java/' || t] ELSE ['src/test/java/com/' || t] END) AS path) u)
  SELECT module, path, CASE WHEN t LIKE 'ECONOMY%' THEN path ELSE 'test/' || module || '/' || t END AS display FROM two""",
)
def h13s_display_clashes(spark, d):
    """Two folders that fold to one path keep theirs; others are folded, tests under test."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("module"), F.col("p_type").alias("t")).distinct()
    path = lambda root: F.concat(F.lit(root), "t")
    own = F.when(F.col("t").startswith("ECONOMY"), F.array(path("src/main/java/com/"), path("src/main/java/"))).otherwise(F.array(path("src/test/java/com/")))
    return paths.display_paths(p.select("module", F.explode(own).alias("path")), ["com"], [("src/main/*", "main"), ("src/test/*", "test")]).select("module", "path", "display")


# ---- scalar text functions ---------------------------------------------------------------------


@query("b2_coerce", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'boolean' ELSE 'string' END AS kind, CASE p_size % 4 WHEN 0 THEN p_retailprice END AS num FROM part")
def b2_coerce(spark, d):
    k = F.col("p_size") % 4
    raw = F.when(k == 0, F.col("p_retailprice").cast("string")).when(k == 1, "true").when(k == 2, F.concat(F.lit('"'), F.col("p_size"), F.lit('"'))).otherwise(F.lit("1d"))
    c = values.coerce(raw)
    return read(spark, d, "part").select("p_partkey", c["kind"].alias("kind"), c["num"].alias("num"))


@query("b3_parse_attrs", "SELECT p_partkey, 'p' || p_partkey AS id, p_type || ',x' AS classes, p_name AS name, CAST(p_size AS VARCHAR) AS size, 'true' AS flag FROM part")
def b3_parse_attrs(spark, d):
    raw = F.concat(F.lit("{#p"), F.col("p_partkey"), F.lit(" ."), F.col("p_type"), F.lit(' .x size=1 name="'), F.col("p_name"), F.lit('" flag size='), F.col("p_size"), F.lit("}"))
    a = values.parse_attrs(raw)
    return read(spark, d, "part").select("p_partkey", a["id"].alias("id"), F.array_join(a["classes"], ",").alias("classes"), a["attrs"]["name"].alias("name"), a["attrs"]["size"].alias("size"), a["attrs"]["flag"].alias("flag"))


@query("b4_parse_data", "SELECT c_custkey, 'seg' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'name', c_name || ' = x' FROM customer")
def b4_parse_data(spark, d):
    body = F.concat(F.lit("seg = "), "c_mktsegment", F.lit("\nno pair\nname= "), "c_name", F.lit(" = x"))
    return read(spark, d, "customer").select("c_custkey", F.inline(values.parse_data(body)))


@query("b5_doc_meta", "SELECT conv_id AS doc, role AS key, arg_max(length(text), turn) AS value FROM conversations GROUP BY 1, 2")
def b5_doc_meta(spark, d):
    """Later entries of a document win."""
    rows = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.lit("meta").alias("tag"), F.col("role").alias("id"), F.length("text").cast(L).alias("text"), F.col("turn").alias("line"))
    return corpus.doc_meta(rows)


@query("b7_slug", "SELECT p_partkey, lower(replace(p_name, ' ', '-')) || '-' || p_size AS slug, lower(replace(p_name, ' ', '-')) || '--x_-' || p_size AS gh FROM part")
def b7_slug(spark, d):
    h = F.concat("p_name", F.lit(" `x_` "), F.col("p_size"), F.lit("!"))
    return read(spark, d, "part").select("p_partkey", values.slug(h).alias("slug"), F.replace(values.github_slug(F.concat("p_name", F.lit("  x_ "), F.col("p_size"), F.lit("!"))), F.lit("?"), F.lit("")).alias("gh"))


@query("b9_safe_url", "SELECT page_id, page_id % 4 IN (0, 2) AS safe FROM pages")
def b9_safe_url(spark, d):
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("java\tscript:"), "url")).when(k == 2, F.lit("rel/path")).otherwise(F.lit("data:text/html,x"))
    return read(spark, d, "pages").select("page_id", values.safe_url(url).alias("safe"))


@query("b10_media_kind", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'video' WHEN 1 THEN 'audio' ELSE 'image' END AS kind FROM pages")
def b10_media_kind(spark, d):
    ext = F.element_at(F.array(F.lit("/a.MP4?x"), F.lit("/a.mp3#t"), F.lit("/a.png")), (F.col("page_id") % 3 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", values.media_kind(F.concat(F.regexp_replace("url", "[?#].*", ""), ext)).alias("kind"))


@query("b18_task_items", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN true WHEN 'O' THEN false END AS done FROM orders")
def b18_task_items(spark, d):
    s = F.col("o_orderstatus")
    item = F.concat(F.when(s == "F", "[x] ").when(s == "O", "[ ] ").otherwise("[?] "), F.col("o_orderpriority"))
    return read(spark, d, "orders").select("o_orderkey", values.task_state(item).alias("done"))


@query("h6s_cell_cleaning", "SELECT doc_id, trim(translate(text, ',' || chr(13) || chr(10) || '[]', '   ()'), ' ') AS cell FROM documents")
def h6s_cell_cleaning(spark, d):
    return read(spark, d, "documents").select("doc_id", values.csv_cell(F.col("text")).alias("cell"))


@query("h7s_content_hash", "SELECT doc_id, sha256(text) AS lf, substr(sha256(replace(text, chr(10), chr(13) || chr(10))), 1, 8) AS crlf FROM documents")
def h7s_content_hash(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").select("doc_id", values.content_hash(t).alias("lf"), values.content_hash(t, "\r\n", 8).alias("crlf"))


@query("h8s_revision_id", "SELECT event_id, strftime(ts, '%Y%m%dT%H%M%SZ') || '-' || substr(sha256(props), 1, 8) AS rev, date_trunc('second', ts) AS back FROM events")
def h8s_revision_id(spark, d):
    rev = values.revision_id(F.col("ts"), F.sha2("props", 256))
    return read(spark, d, "events").select("event_id", rev.alias("rev"), F.date_trunc("second", values.revision_time(rev)).alias("back"))


@query("h14s_qualified_name", "SELECT p_partkey, p_brand || '.' || CASE WHEN p_size % 2 = 0 THEN 'new' ELSE split_part(p_name, ' ', 1) END AS q FROM part")
def h14s_qualified_name(spark, d):
    m = F.when(F.col("p_size") % 2 == 0, "<init>").otherwise(F.split_part("p_name", F.lit(" "), F.lit(1)))
    return read(spark, d, "part").select("p_partkey", values.qualified_name(F.concat(F.lit("com.acme."), "p_brand", F.lit("."), m, F.lit(":void(int)"))).alias("q"))


@query("h15s_lookup_names", f"WITH {SYMBOLS} SELECT name, anchor FROM symbols UNION SELECT substr(name, instr(name, '.') + 1), anchor FROM symbols WHERE contains(name, '.')")
def h15s_lookup_names(spark, d):
    return search.name_lookup(symbols(spark, d))


#: (message, its bucket), one of each.
MESSAGES = [
    ("unterminated `note` block (no matching ===)", "unterminated fence (nesting)"), ("unknown metadata reference `{{a}}`", "unknown {{meta}} key"), ("unresolved reference `#a`", "unresolved ref/footnote"),
    ("unresolved footnote `[^a]`", "unresolved ref/footnote"), ("duplicate id `#a` (first defined at line 1)", "duplicate id"), ("compute `c`: missing )", "table formula (compute/summary)"), ("bad span `x`", "table span"),
    ("chart: missing `type`", "chart binding"), ("x-chart body is ignored; the chart spec lives in attributes", "chart binding"), ("cannot resolve document `b.mk`", "cross-doc ref"),
    ("no registered renderer for diagram format `odd`; body kept raw", "other: no registered renderer for diagram format"),
]


@query(
    "h16s_error_category",
    "WITH m(j, category) AS (VALUES " + ", ".join(f"({j}, '{c[:47]}')" for j, (_, c) in enumerate(MESSAGES)) + f") SELECT category, count(*) AS n FROM part JOIN m ON m.j = p_partkey % {len(MESSAGES)} GROUP BY 1",
)
def h16s_error_category(spark, d):
    m = F.get(F.array(*[F.lit(x) for x, _ in MESSAGES]), (F.col("p_partkey") % len(MESSAGES)).cast("int"))
    return read(spark, d, "part").select(values.error_category(m).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


@query("h17s_lines", "SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: length(trim(x, ' ')) = 0)) AS blank FROM documents")
def h17s_lines(spark, d):
    lines = F.split(values.trimmed_lines(F.col("text")), "\n")
    return read(spark, d, "documents").select("doc_id", F.size(lines).cast(L).alias("n_lines"), F.size(F.filter(lines, lambda x: F.length(x) == 0)).cast(L).alias("blank"))


@query("h3s_printf", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(floor(l_quantity + 0.5) AS BIGINT) AS VARCHAR) || '%' AS pct, CAST(CAST(l_quantity AS DECIMAL(18, 1)) AS VARCHAR) AS one FROM lineitem")
def h3s_printf(spark, d):
    q = F.col("l_quantity")
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.printf("%d%%", q).alias("pct"), values.printf("%.1f", q).alias("one"))


@query("h4s_number_text", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS whole, CAST(p_size AS VARCHAR) || '.5' AS half FROM part")
def h4s_number_text(spark, d):
    return read(spark, d, "part").select("p_partkey", values.number_text(F.col("p_size") + 0.1 - 0.1).alias("whole"), values.number_text(F.col("p_size") + 0.2 + 0.3).alias("half"))


# ---- scoring, streams --------------------------------------------------------------------------


@query(
    "d17_score_outputs",
    """SELECT d.lang AS model, d.source AS condition, round(100.0 * avg(CASE WHEN l.quality = 1 THEN 1 ELSE 0 END), 4) AS clean, round(100.0 * avg(CASE WHEN contains(d.text, ',') THEN 1 ELSE 0 END), 4) AS feature,
  round(100.0 * avg(CASE WHEN l.quality = 1 AND contains(d.text, ',') THEN 1 ELSE 0 END), 4) AS both_ok, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY 1, 2""",
)
def d17_score_outputs(spark, d):
    from docgraph.operators.score import score_outputs

    runs = read(spark, d, "documents").join(read(spark, d, "labels"), "doc_id").select(F.col("lang").alias("model"), F.col("source").alias("condition"), "text", (F.col("quality") == 1).alias("clean"), F.array(F.lit(",")).alias("expect"))
    s = score_outputs(runs)
    return s.select("model", "condition", *[F.round(c, 4).alias(c) for c in ("clean", "feature", "both_ok")], "n")


def _scored(spark, d):
    """Documents as runs; every third has an error, every fourth two warnings, every eleventh broke its reader."""
    k = F.col("doc_id")
    runs = read(spark, d, "documents").select(k.alias("run"), F.col("lang").alias("model"), F.col("source").alias("condition"), "text", F.array(F.lit(",")).alias("expect"), (k % 11 == 0).alias("threw"))
    said = lambda severity, message: F.struct(F.lit(severity).alias("severity"), message.alias("message"))
    error = said("error", F.when(k % 2 == 0, "duplicate id `#a` (first defined at line 1)").otherwise("unresolved reference `#b`"))
    warning = said("warning", F.lit("unknown block type `x`; body kept as raw"))
    every = F.array_compact(F.array(F.when(k % 3 == 0, error), F.when(k % 4 == 0, warning), F.when(k % 4 == 0, warning)))
    return runs, read(spark, d, "documents").select(k.alias("run"), F.inline(every))


@query(
    "d17_scored_runs",
    """SELECT lang AS model, source AS condition, round(100.0 * avg(CASE WHEN doc_id % 3 <> 0 AND doc_id % 11 <> 0 THEN 1 ELSE 0 END), 4) AS clean, round(100.0 * avg(CASE WHEN contains(text, ',') THEN 1 ELSE 0 END), 4) AS feature,
  round(100.0 * avg(CASE WHEN doc_id % 3 <> 0 AND doc_id % 11 <> 0 AND contains(text, ',') THEN 1 ELSE 0 END), 4) AS both_ok, count(*) AS n, CAST(sum(CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS warnings FROM documents GROUP BY 1, 2""",
)
def d17_scored_runs(spark, d):
    from docgraph.operators.score import score_runs

    s = score_runs(*_scored(spark, d))
    return s.select("model", "condition", *[F.round(c, 4).alias(c) for c in ("clean", "feature", "both_ok")], "n", "warnings")


@query("d17_error_histogram", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'duplicate id' ELSE 'unresolved ref/footnote' END AS category, count(*) AS n FROM documents WHERE doc_id % 3 = 0 GROUP BY 1 ORDER BY 2 DESC, 1")
def d17_error_histogram(spark, d):
    from docgraph.operators.score import error_histogram

    return error_histogram(_scored(spark, d)[1])


@query(
    "d16_diagnostic_summary",
    """SELECT l_suppkey AS doc, l_returnflag AS severity, count(*) AS n, CAST(grouping(l_suppkey) * 2 + grouping(l_returnflag) AS BIGINT) AS level FROM lineitem GROUP BY GROUPING SETS ((l_suppkey, l_returnflag), (l_suppkey), (l_returnflag), ())""",
)
def d16_diagnostic_summary(spark, d):
    from docgraph.operators.score import diagnostic_summary

    return diagnostic_summary(read(spark, d, "lineitem").select(F.col("l_suppkey").alias("doc"), F.col("l_returnflag").alias("severity")))


SESSIONS = """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, fresh ROWS UNBOUNDED PRECEDING) AS nr FROM o) SELECT user_id AS repo, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, nr"""


@query("k1_debounce_changes", SESSIONS)
def k1_debounce_changes(spark, d):
    from docgraph.streaming.changes import debounce

    return debounce(read(spark, d, "events").select(F.col("user_id").alias("repo"), "ts"), "30 minutes")


@query(
    "k2_needs_refresh",
    """WITH b AS (SELECT user_id, max(event_id) AS tip FROM events WHERE event_type = 'signup' GROUP BY 1) SELECT e.event_id FROM events e LEFT JOIN b USING (user_id) WHERE e.event_type IN ('click', 'signup') AND (b.tip IS NULL OR e.event_id <> b.tip)""",
)
def k2_needs_refresh(spark, d):
    from docgraph.streaming.changes import needs_refresh

    e = read(spark, d, "events")
    f = F.when(F.col("event_type").isin("click", "signup"), F.array(F.lit("a.md"), F.lit("x.py"))).otherwise(F.array(F.lit("a.md")))
    commits = e.select(F.col("user_id").alias("repo"), F.col("event_id").alias("tip"), f.alias("files"))
    built = e.where("event_type = 'signup'").groupBy(F.col("user_id").alias("repo")).agg(F.max("event_id").alias("built_tip"))
    return needs_refresh(commits, built).select(F.col("tip").alias("event_id"))


@query(
    "k3_stream_check",
    """SELECT 'c' || c_custkey || '.mk' AS doc, 13 AS line, 'error' AS severity, 'unresolved' AS code FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 <> 0
  UNION ALL SELECT 'c' || c_custkey || '.mk', 13, 'error', 'unresolved-cross' FROM customer a WHERE c_custkey % 5 = 0 OR NOT EXISTS (SELECT 1 FROM customer b WHERE b.c_custkey = a.c_custkey + 1)""",
)
def k3_stream_check(spark, d):
    """The check of documents that arrive in a folder, read as a stream, here in one batch; every third document's missing id is known from elsewhere."""
    import uuid

    from docgraph.jobs.corpus_queries import markup
    from docgraph.storage import shared_dir
    from docgraph.streaming.changes import check_stream

    k = F.col("c_custkey")
    ids = read(spark, d, "customer").select(F.concat(F.lit("c"), k, F.lit(".mk")).alias("doc"), F.explode(F.concat(F.array(F.concat(F.lit("c-"), k)), F.when(k % 3 == 0, F.array(F.concat(F.lit("c-"), k - 1))).otherwise(F.array().cast("array<string>")))).alias("id"))
    path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    docs = markup(spark, d)
    docs.write.parquet(f"{path}/arriving")
    found = check_stream(spark.readStream.schema(docs.schema).parquet(f"{path}/arriving"), ids)
    found.writeStream.format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/found").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{path}/found")


@query("k4_stream_history", """SELECT CAST(conv_id AS VARCHAR) AS doc, turn AS ts, role AS text FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations) WHERE before IS NULL OR before <> role""")
def k4_stream_history(spark, d):
    """The role of each turn as a version, appended in three batches: one for each change, a return to an earlier one included."""
    import uuid

    from docgraph.storage import shared_dir
    from docgraph.streaming.arrivals import Recorder

    recorder = Recorder(spark, f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}", buckets=16)
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ts"), F.col("role").alias("text"))
    for batch in (c.where("ts < 2"), c.where("ts BETWEEN 2 AND 3"), c.where("ts > 3")):
        recorder.append_batch(batch)
    return recorder.versions().select("doc", F.col("at").alias("ts"), "text")


@query("k3_checks_with_memory", None)
def k3_checks_with_memory(spark, d):
    """The corpus in three batches, a third of it first in a faulty form: what stands in the end is what a check of the whole corpus finds."""
    import uuid

    from docgraph.jobs.corpus_queries import markup
    from docgraph.storage import shared_dir
    from docgraph.streaming.arrivals import Checker

    checker = Checker(spark, f"{shared_dir(spark)}/checked-{uuid.uuid4().hex}", buckets=16)
    part = F.pmod(F.xxhash64("doc"), F.lit(3))
    m = markup(spark, d).withColumn("ts", F.lit(1))
    faulty = m.where(part == 1).withColumn("text", F.concat(F.lit("# Other {#o}\n\n[[#gone]] {{none}}\n\n"), F.regexp_replace("text", "#top", "#else")))
    for batch in (m.where(part == 0).unionByName(faulty), m.where(part == 2), m.where(part == 1)):
        written(checker.check_batch(batch), "findings")
    return checker.findings.read().select("doc", "line", "severity", "code", "message")


@query("k4_late_versions", SQL["k4_stream_history"])
def k4_late_versions(spark, d):
    """The role of each turn as a version; odd turns arrive first, then the even ones, which are late, and all of them once more."""
    import uuid

    from docgraph.storage import shared_dir
    from docgraph.streaming.arrivals import Recorder

    recorder = Recorder(spark, f"{shared_dir(spark)}/recorded-{uuid.uuid4().hex}", buckets=16, keyframes=2)
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ts"), F.col("role").alias("text"))
    for batch in (c.where("ts % 2 = 1"), c.where("ts % 2 = 0"), c):
        recorder.append_batch(batch)
    return recorder.versions().select("doc", F.col("at").alias("ts"), "text")


@query(
    "k1_filtered_changes",
    SESSIONS.replace("FROM events", "FROM (SELECT * FROM events WHERE event_id % 5 IN (0, 1))"),
)
def k1_filtered_changes(spark, d):
    """Of every five changes two count: one of a source, and one that no path is known of; the others are of a skipped folder, a hidden one, and no source."""
    from docgraph.streaming.changes import debounce

    paths = F.array(F.lit("src/a.py"), F.lit(None).cast("string"), F.lit("lib/node_modules/b.js"), F.lit(".cache/c.py"), F.lit("README.md"))
    e = read(spark, d, "events")
    return debounce(e.select(F.col("user_id").alias("repo"), "ts", F.get(paths, (F.col("event_id") % 5).cast("int")).alias("path")), "30 minutes")
