"""Registered queries over a markup corpus that Spark writes from the customer table: scanning it must give the table back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.jobs.inputs import read
from docgraph.jobs.queries import SQL, L, query
from docgraph.operators import corpus, graph, tables
from docgraph.sources.canonical import canonicalize
from docgraph.sources.scan import scan_corpus
from docgraph.storage import written


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, n, doc and what a customer's document names."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    return read(spark, sf_dir, "customer").select(
        k.alias("k"), n.alias("n"), F.concat(F.lit("c"), k, F.lit(".mk")).alias("doc"), F.round(F.col("c_acctbal") * 100).cast("long").alias("bal"),
        (k - k % 2).alias("near"), (k + 1).alias("next"), (k + F.when(k % 5 == 0, 2).otherwise(1)).alias("far"),
    )


def text(*parts) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def markup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text): a document a customer, with meta, a table, sections, a list and references; some of these lead nowhere."""
    k, c = F.col("k"), F.col
    body = text(
        "=== meta\nname = NATION_", c("n"), "\n===\n\n# Nation {{name}} {#top}\n\n=== table {#customers format=csv}\nkey,bal\n", k, ",", c("bal"), "\n===\n\n## {{name}} ", k, " {#c-", k,
        "}\nBalance ", c("bal"), ". See [[#c-", c("near"), "]], `[[#no]]` and [next](c", c("next"), ".mk#c-", c("far"), ").\n\n## Notes {#notes}\n- [x] done ", k, "\n- open {{name}}\n",
    )
    return customers(spark, sf_dir).select("doc", body.alias("text"))


def scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_corpus(markup(spark, sf_dir))


def scanned_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan written, for queries that read it several times."""
    return written(scanned(spark, sf_dir), "scan")


#: The same as SQL.
C = """c AS (SELECT c_custkey AS k, c_nationkey AS n, 'c' || c_custkey || '.mk' AS doc, CAST(round(c_acctbal * 100) AS BIGINT) AS bal, c_custkey - c_custkey % 2 AS near, c_custkey + 1 AS next,
  c_custkey + CASE WHEN c_custkey % 5 = 0 THEN 2 ELSE 1 END AS far FROM customer)"""
NL = "chr(10)"
SENTENCE = "'Balance ' || bal || '. See [[#c-' || near || ']], `[[#no]]` and [next](c' || next || '.mk#c-' || far || ').'"
SECTION = f"'## {{{{name}}}} ' || k || ' {{#c-' || k || '}}' || {NL} || {SENTENCE} || {NL}"
TABLE = f"'key,bal' || {NL} || k || ',' || bal"
TABLE_BLOCK = f"'=== table {{#customers format=csv}}' || {NL} || {TABLE} || {NL} || '==='"
HEAD = f"'=== meta' || {NL} || 'name = NATION_' || n || {NL} || '===' || {NL} || {NL} || '# Nation {{{{name}}}} {{#top}}' || {NL} || {NL} || {TABLE_BLOCK} || {NL} || {NL}"
NOTES = f"'## Notes {{#notes}}' || {NL} || '- [x] done ' || k || {NL} || '- open {{{{name}}}}' || {NL}"


@query(
    "b1_scan_blocks",
    f"""WITH {C} SELECT doc, 1 AS seq, 'meta' AS kind, 1 AS line, 3 AS end_line, CAST(NULL AS VARCHAR) AS id, 'name = NATION_' || n AS text FROM c
  UNION ALL SELECT doc, 2, 'heading', 5, 5, 'top', 'Nation NATION_' || n FROM c UNION ALL SELECT doc, 3, 'table', 7, 10, 'customers', {TABLE} FROM c
  UNION ALL SELECT doc, 4, 'heading', 12, 12, 'c-' || k, 'NATION_' || n || ' ' || k FROM c UNION ALL SELECT doc, 5, 'paragraph', 13, 13, NULL, {SENTENCE} FROM c
  UNION ALL SELECT doc, 6, 'heading', 15, 15, 'notes', 'Notes' FROM c UNION ALL SELECT doc, 7, 'list', 16, 17, NULL, '[x] done ' || k || {NL} || 'open NATION_' || n FROM c""",
)
def b1_scan_blocks(spark, d):
    return corpus.tagged(scanned(spark, d), "block").select("doc", "seq", F.coalesce("type", "kind").alias("kind"), "line", "end_line", "id", "text")


@query(
    "b6_interpolate",
    f"""WITH {C} SELECT doc, 'name' AS key, 'NATION_' || n AS value, 5 AS line, 'Nation NATION_' || n AS text FROM c UNION ALL SELECT doc, 'name', 'NATION_' || n, 12, 'NATION_' || n || ' ' || k FROM c
  UNION ALL SELECT doc, 'name', 'NATION_' || n, 17, 'open NATION_' || n FROM c""",
)
def b6_interpolate(spark, d):
    """Headings and list items that name the nation through its key, with the value in their place."""
    s = scanned_once(spark, d)
    heads = corpus.tagged(s, "block").where("kind = 'heading' AND line < 15").select("doc", "line", "text")
    items = corpus.tagged(s, "item").where("line = 17").select("doc", "line", "text")
    return corpus.doc_meta(s).join(heads.unionByName(items), "doc").select("doc", "key", "value", "line", "text")


@query(
    "b8_extract_refs",
    f"""WITH {C} SELECT doc, 13 AS line, 'autoref' AS kind, CAST(NULL AS VARCHAR) AS target, 'c-' || near AS anchor FROM c UNION ALL SELECT doc, 13, 'cross', 'c' || next || '.mk', 'c-' || far FROM c""",
)
def b8_extract_refs(spark, d):
    return corpus.tagged(scanned(spark, d), "ref").select("doc", "line", F.col("ref_kind").alias("kind"), F.col("target_doc").alias("target"), "anchor")


@query(
    "b11_list_ids",
    f"""WITH {C} SELECT doc, 'c-' || k AS id, 'heading' AS kind, 12 AS line FROM c UNION ALL SELECT doc, 'top', 'heading', 5 FROM c UNION ALL SELECT doc, 'customers', 'table', 7 FROM c UNION ALL SELECT doc, 'notes', 'heading', 15 FROM c""",
)
def b11_list_ids(spark, d):
    return corpus.list_ids(scanned(spark, d)).select("doc", "id", "kind", "line")


def blocks_of(spark, d, ids, head):
    m = markup(spark, d)
    keys = customers(spark, d).select("doc", F.explode(ids).alias("id"))
    return corpus.get_blocks(m, written(scan_corpus(m), "scan"), keys, head)


@query("b12_get_block", f"WITH {C} SELECT doc, 'c-' || k AS id, {SECTION} AS body FROM c UNION ALL SELECT doc, 'customers', {TABLE_BLOCK} FROM c UNION ALL SELECT doc, 'notes', {NOTES} FROM c")
def b12_get_block(spark, d):
    """Whole sections and blocks of every document."""
    return blocks_of(spark, d, F.array(text("c-", F.col("k")), F.lit("customers"), F.lit("notes")), False)


@query("b12_get_block_all", f"WITH {C} SELECT doc, 'c-' || k AS id, '## {{{{name}}}} ' || k || ' {{#c-' || k || '}}' AS head FROM c UNION ALL SELECT doc, 'top', '# Nation {{{{name}}}} {{#top}}' FROM c UNION ALL SELECT doc, 'customers', '=== table {{#customers format=csv}}' FROM c UNION ALL SELECT doc, 'notes', '## Notes {{#notes}}' FROM c")
def b12_get_block_all(spark, d):
    """The first line of every id's block."""
    return blocks_of(spark, d, F.array(text("c-", F.col("k")), F.lit("top"), F.lit("customers"), F.lit("notes")), True).withColumnRenamed("body", "head")


@query("b13_section_spans", f"WITH {C} SELECT doc, 'c-' || k AS id, 12 AS start, 15 AS stop FROM c UNION ALL SELECT doc, 'top', 5, NULL FROM c UNION ALL SELECT doc, 'notes', 15, NULL FROM c")
def b13_section_spans(spark, d):
    return corpus.section_spans(scanned(spark, d)).select("doc", "id", "start", "stop")


UNRESOLVED = f"{C} SELECT doc, 13 AS line, 'c-' || near AS anchor FROM c WHERE near <> k"
CROSS = f"""{C} SELECT doc, 13 AS line, 'c' || next || '.mk' AS target, 'c-' || far AS anchor, CASE WHEN far = next OR NOT EXISTS (SELECT 1 FROM c b WHERE b.k = a.next) THEN 'cannot resolve document' ELSE 'unresolved reference' END AS reason
  FROM c a WHERE far <> next OR NOT EXISTS (SELECT 1 FROM c b WHERE b.k = a.next)"""


@query("c1_unresolved_autoref", f"WITH {UNRESOLVED}")
def c1_unresolved_autoref(spark, d):
    return corpus.unresolved_internal(scanned_once(spark, d)).select("doc", "line", "anchor")


@query("c2_unresolved_cross", f"WITH {CROSS}")
def c2_unresolved_cross(spark, d):
    m = markup(spark, d)
    return corpus.unresolved_cross(written(scan_corpus(m), "scan"), m).select("doc", "line", "target", "anchor", "reason")


@query(
    "c4_corpus_backlinks",
    f"""WITH {C} SELECT doc AS target, 'c-' || k AS id, doc, 13 AS line FROM c WHERE near = k UNION ALL SELECT b.doc, 'c-' || b.k, a.doc, 13 FROM c a JOIN c b ON b.k = a.next WHERE a.far = a.next""",
)
def c4_corpus_backlinks(spark, d):
    return corpus.backlinks(scanned_once(spark, d)).select("target", "id", "doc", "line")


@query(
    "m_check_corpus",
    f"""WITH u AS (WITH {UNRESOLVED}), x AS (WITH {CROSS}) SELECT doc, line, 'error' AS severity, 'unresolved' AS code, 'unresolved reference `#' || anchor || '`' AS message FROM u
  UNION ALL SELECT doc, line, 'error', 'unresolved-cross', CASE WHEN reason = 'cannot resolve document' THEN 'cannot resolve document `' || target || '`' ELSE 'unresolved reference `' || target || '#' || anchor || '`' END FROM x""",
)
def m_check_corpus(spark, d):
    m = markup(spark, d)
    return corpus.check_corpus(written(scan_corpus(m), "scan"), m)


T = "=== table {#t format=csv%s}\na,b\n1,x\n2,3\n===\n"
CHARTED = "=== table {#t format=csv}\na,b\n1,5\n2,n\n===\n=== diagram {format=x-chart data=#t%s}\n===\n"
#: (document, line, severity, code, message) with one case for each rule, and for the parts of some.
RULES = [
    ("# A {#a}\n# B {#a}", 2, "error", "duplicate-id", "duplicate id `#a` (first defined at line 1)"),
    ("see [[#a]]", 1, "error", "unresolved", "unresolved reference `#a`"),
    ("see [^f]", 1, "error", "unresolved", "unresolved footnote `[^f]`"),
    ("see [x](gone.mk#a)", 1, "error", "unresolved-cross", "cannot resolve document `gone.mk`"),
    ("see [x](base.mk#zz)", 1, "error", "unresolved-cross", "unresolved reference `base.mk#zz`"),
    ("a {{b}} `{{c}}`", 1, "error", "unknown-key", "unknown metadata reference `{{b}}`"),
    ("=== note {#n}\nx", 1, "error", "unterminated", "unterminated `note` block (no matching === or `=== #n`)"),
    ("=== aside\nx\n===", 1, "warning", "unknown-type", "unknown block type `aside`; body kept as raw"),
    ("".join("=" * (400 - i) + " note\n" for i in range(258)) + "".join("=" * (400 - i) + "\n" for i in reversed(range(258))), 257, "error", "too-deep", "block nesting too deep (max 256); body kept as raw"),
    ("\n".join(" " * i + "- x" for i in range(258)), 257, "error", "too-deep", "list nesting too deep (max 256)"),
    ("=== diagram {format=odd}\n===", 1, "warning", "diagram-format", "no registered renderer for diagram format `odd`; body kept raw"),
    ("=== table {#t}\n| a | b |\n|---|---|\n| 1 | 2 |\n===\n=== diagram {format=x-chart data=#t type=bar x=a y=b}\nz\n===", 6, "warning", "chart-body", "x-chart body is ignored; the chart spec lives in attributes"),
    ("=== diagram {format=x-code-graph}\n===", 1, "warning", "graph-src", "x-code-graph: missing `src=` (nothing to render)"),
    ("=== diagram {format=x-code-graph src=gone.mk}\n===", 1, "warning", "graph-src", "code graph: cannot resolve document `gone.mk`"),
    ("=== diagram {format=x-code-graph src=base.mk}\nz\n===", 1, "warning", "graph-body", "x-code-graph body is ignored; the embed is configured by `src=` alone"),
    ("=== table {src=a.csv}\n1\n===", 1, "error", "table-source", "table has both `src` and an inline body; provide one, not both"),
    ("=== table {format=odd}\n| a |\n===", 1, "warning", "table-format", "unknown table format `odd`; parsed as visual grid"),
    (T % ' compute="= a"', 1, "error", "compute", "bad compute formula `= a` (want `Name = expr`)"),
    (T % ' compute="c = a + b"', 1, "error", "compute", "compute `c`: unknown column `b`"),
    (T % ' compute="c = zz * 2"', 1, "error", "compute", "compute `c`: unknown column `zz`"),
    (T % ' compute="c = (a + 1"', 1, "error", "compute", "compute `c`: missing )"),
    (T % ' compute="c = a a"', 1, "error", "compute", "compute `c`: trailing tokens in formula"),
    (T % ' compute="c = sum(1)"', 1, "error", "compute", "compute `c`: bad argument to sum()"),
    (T % ' compute="c = 1 +"', 1, "error", "compute", "compute `c`: unexpected end of formula"),
    (T % ' summary="a"', 1, "error", "summary", "bad summary `a` (want `Cell = value`)"),
    (T % ' summary="zz = sum(a)"', 1, "error", "summary", "summary targets unknown column `zz`"),
    (T % ' summary="a = a"', 1, "error", "summary", "summary `a`: column `a` must be reduced by an aggregate (e.g. sum(a))"),
    (T % ' span="x"', 1, "error", "span", "bad span `x` (want `rNcM:RxC`)"),
    (T % ' span="r9c1:1x1"', 1, "warning", "span", "span `r9c1:1x1` targets a cell outside the table"),
    (CHARTED % "", 6, "error", "chart", "chart: missing `type`"),
    (CHARTED % " type=radar", 6, "error", "chart", "chart: unknown type `radar` (supported: bar, line, area, pie, scatter; use format=vega-lite for others)"),
    (CHARTED % " type=bar rows=odd", 6, "error", "chart", "chart: unknown rows scope `odd` (data|all|summary)"),
    (CHARTED % " type=bar x=a", 6, "error", "chart", "chart: missing required channel `y`"),
    (CHARTED % " type=bar y=a", 6, "error", "chart", "chart: missing required channel `x`"),
    (CHARTED % " type=bar x=a y=zz", 6, "error", "chart", "chart: column `zz` not found in table"),
    (CHARTED % " type=bar x=a y=b", 6, "error", "chart", "chart: non-numeric value in a y column"),
    (CHARTED % " type=bar x=b y=a rows=summary", 6, "error", "chart", "chart: rows=summary but the table has no summary row"),
    (CHARTED % " type=bar x=b y=a rows=all", 6, "warning", "chart", "chart: rows=all but the table has no summary row; using data rows"),
    (CHARTED % " type=bar x=b y=a size=a", 6, "warning", "chart", "chart: `size` is ignored for type `bar`"),
    (CHARTED % ' type=pie x=b y="a,b"', 6, "warning", "chart", "chart: pie uses a single `y`; extra columns ignored"),
    (CHARTED % " type=pie x=b y=a series=b", 6, "warning", "chart", "chart: `series` is ignored for type `pie`"),
    (CHARTED % ' type=bar x=b y=","', 6, "error", "chart", "chart: `y` lists no columns"),
    (CHARTED % " type=scatter x=b y=a size=zz", 6, "error", "chart", "chart: column `zz` not found in table"),
    (CHARTED % " type=scatter x=b y=a size=b", 6, "error", "chart", "chart: non-numeric value in a y column"),
    ("=== diagram {format=x-chart}\n===", 1, "error", "chart-data", "x-chart: missing `data=#id`"),
    ("# A {#a}\n=== diagram {format=x-chart data=#a}\n===", 2, "error", "chart-data", "x-chart: data target `#a` is not a table"),
    ("=== diagram {format=x-chart data=#a}\n===", 1, "error", "chart-data", "x-chart: unresolved reference `#a`"),
    ("# Fine {#a}\n\nsee [[#a]] and [x](base.mk#a)", None, None, None, None),
]
quoted = lambda x: "NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"


@query(
    "m_rules",
    "WITH r(j, line, severity, code, message) AS (VALUES "
    + ", ".join(f"({j}, {quoted(r[1])}, {quoted(r[2])}, {quoted(r[3])}, {quoted(r[4])})" for j, r in enumerate(RULES) if r[1])
    + f") SELECT 'r' || c_custkey || '.mk' AS doc, line, severity, code, message FROM customer JOIN r ON r.j = c_custkey % {len(RULES)}",
)
def m_rules(spark, d):
    """Every customer's document breaks one rule, or none: base.mk is one of the corpus' names."""
    cases = F.array(*[F.lit(r[0]) for r in RULES])
    k = F.col("c_custkey")
    docs = read(spark, d, "customer").select(text("r", k, ".mk").alias("doc"), F.get(cases, (k % len(RULES)).cast("int")).alias("text"))
    named = docs.unionByName(spark.createDataFrame([("base.mk", "# A {#a}")], "doc string, text string"))
    found = corpus.check_corpus(written(scan_corpus(named, flow_texts=False), "scan"), named)
    return found.where("doc <> 'base.mk'")


SQL["k3_checks_with_memory"] = SQL["m_check_corpus"]


@query("m_unchecked_cross", f"WITH {C} SELECT doc, 13 AS line, 'warning' AS severity, 'cross-document reference `c' || next || '.mk#c-' || far || '` not checked (no document resolver)' AS message FROM c")
def m_unchecked_cross(spark, d):
    """Without a corpus to look in, cross references are only warned of."""
    return corpus.check_corpus(scanned_once(spark, d)).where("code = 'unchecked-cross'").drop("code")


@query("a2_scanned_tables", f"WITH {C} SELECT doc, CAST(k AS DOUBLE) AS \"key\", CAST(bal AS DOUBLE) AS bal FROM c")
def a2_scanned_tables(spark, d):
    """The table blocks of the corpus, read back into numbers."""
    t = corpus.tagged(scanned(spark, d), "block").where("type = 'table'").select("doc", F.col("id").alias("table_id"), F.col("text").alias("body"))
    return tables.read_delimited(t).groupBy("doc", "row").pivot("name", ["key", "bal"]).agg(F.first("num")).drop("row")


@query(
    "b20_export_corpus",
    f"""WITH {C} SELECT doc, '---' || {NL} || 'name: NATION_' || n || {NL} || '---' || {NL} || {NL} || '# Nation NATION_' || n || {NL} || {NL} || '| key | bal |' || {NL} || '| --- | --- |' || {NL} || '| ' || k || ' | ' || bal || ' |' || {NL} || {NL}
  || '## NATION_' || n || ' ' || k || {NL} || {NL} || {SENTENCE} || {NL} || {NL} || '## Notes' || {NL} || {NL} || '- [x] done ' || k || {NL} || '- open NATION_' || n || {NL} AS text,
  'heading id/attributes dropped (Markdown has no attribute syntax)' AS notes FROM c""",
)
def b20_export_corpus(spark, d):
    return corpus.export_markdown(scanned_once(spark, d)).select("doc", "text", F.array_join("notes", ";").alias("notes"))


@query(
    "b21_canonicalize",
    f"""WITH {C} SELECT doc, '=== meta' || {NL} || 'name = NATION_' || n || {NL} || '===' || {NL} || {NL} || '# Nation NATION_' || n || ' {{#top}}' || {NL} || {NL} || '=== table {{#customers format="csv"}}' || {NL} || {TABLE} || {NL} || '===' || {NL} || {NL}
  || '## NATION_' || n || ' ' || k || ' {{#c-' || k || '}}' || {NL} || {NL} || {SENTENCE} || {NL} || {NL} || '## Notes {{#notes}}' || {NL} || {NL} || '- [x] done ' || k || {NL} || '- open NATION_' || n || {NL} AS text, true AS same FROM c""".replace("{{#", "{#").replace("}}'", "}'"),
)
def b21_canonicalize(spark, d):
    """The normal form, and that it is its own one."""
    once = canonicalize(markup(spark, d)).select("doc", "text")
    return canonicalize(once)


@query(
    "b22_apply_patches",
    f"""WITH {C} SELECT doc, {HEAD} || CASE WHEN k % 4 = 0 THEN '## new {{#c-' || k || '}}' || {NL} || 'Patched.' || {NL} ELSE {SECTION} END || {NL} || {NOTES} AS text FROM c""",
)
def b22_apply_patches(spark, d):
    m = markup(spark, d)
    p = customers(spark, d).where("k % 4 = 0").select("doc", text("c-", F.col("k")).alias("id"), text("## new {#c-", F.col("k"), "}\nPatched.\n").alias("body"))
    return corpus.apply_patches(m, written(scan_corpus(m), "scan"), p)


@query(
    "b22_guarded_patches",
    f"""WITH {C} SELECT doc, CAST(NULL AS VARCHAR) AS id, 'taken' AS reason, {HEAD} || '## new {{#c-' || k || '}}' || {NL} || 'Patched.' || {NL} || {NL} || {NOTES} AS text FROM c WHERE k % 8 = 0
  UNION ALL SELECT doc, CASE k % 8 WHEN 3 THEN 'top' WHEN 4 THEN 'nope' ELSE 'c-' || k END, CASE k % 8 WHEN 1 THEN 'target lost' WHEN 2 THEN 'errors' WHEN 3 THEN 'id lost' ELSE 'no block' END, NULL FROM c WHERE k % 8 BETWEEN 1 AND 4""",
)
def b22_guarded_patches(spark, d):
    """Of every eight documents one is patched well, and one each loses the patched id, gets a second id, loses others' ids, and has no such block."""
    k = F.col("k")
    own = text("c-", k)
    ident = F.when(k % 8 == 3, "top").when(k % 8 == 4, "nope").otherwise(own)
    body = F.when(k % 8 == 1, "gone\n").when(k % 8 == 2, text("## new {#", own, "}\n\n# Again {#top}\n")).when(k % 8 == 3, "# All {#top}\n").otherwise(text("## new {#", own, "}\nPatched.\n"))
    m = markup(spark, d)
    texts, refused = corpus.guarded_patches(m, written(scan_corpus(m), "scan"), customers(spark, d).where("k % 8 <= 4").select("doc", ident.alias("id"), body.alias("body")))
    none = F.lit(None).cast("string")
    return texts.select("doc", none.alias("id"), F.lit("taken").alias("reason"), "text").unionByName(refused.withColumn("text", none))


@query("g4_rejected_patches", f"WITH {C} SELECT doc, 'c-' || k AS id FROM c WHERE k % 10 = 0")
def g4_rejected_patches(spark, d):
    """Patches that leave out their block's id drop it: those documents are refused."""
    m = markup(spark, d)
    p = customers(spark, d).where("k % 10 = 0").select("doc", text("c-", F.col("k")).alias("id"), F.lit("gone\n").alias("body"))
    before = written(scan_corpus(m), "scan")
    return corpus.rejected_patches(before, scan_corpus(corpus.apply_patches(m, before, p)))


@query(
    "g7_compare_models",
    """SELECT 'o' || o_orderkey AS doc, o_orderkey % 4 = 0 AS equal, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 3 END AS BIGINT) AS added, CAST(CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS BIGINT) AS removed,
  CAST(0 AS BIGINT) AS errors_before, CAST(CASE WHEN o_orderkey % 4 = 2 THEN 1 ELSE 0 END AS BIGINT) AS errors_after, CAST(CASE WHEN o_orderkey % 4 = 3 THEN 1 ELSE 0 END AS BIGINT) AS warnings_before, CAST(0 AS BIGINT) AS warnings_after, o_orderkey % 4 = 2 AS grown FROM orders""",
)
def g7_compare_models(spark, d):
    """Two builds of a corpus: equal but for blank lines, one paragraph changed, worse by an error, and better by a warning with two blocks changed."""
    k = F.col("o_orderkey")
    o = read(spark, d, "orders").select(k, F.concat(F.lit("o"), k).alias("doc"), k.cast("string").alias("t"))
    first = text("# Order {#top}\n\n=== ", F.when(k % 4 == 3, "odd").otherwise("note"), " {#a}\nA\n===\n\nfirst ", F.col("t"), "\n")
    second = (
        F.when(k % 4 == 0, text("# Order {#top}\n\n\n=== note {#a}\nA\n===\n\n\n\nfirst ", F.col("t"), "\n\n")).when(k % 4 == 1, text("# Order {#top}\n\n=== note {#a}\nA\n===\n\nsecond ", F.col("t"), "\n"))
        .when(k % 4 == 2, text("# Order {#top}\n\n=== note {#a}\nA\n\nfirst ", F.col("t"), "\n")).otherwise(text("# Order {#top}\n\n=== note {#a}\nA\n===\n\nother ", F.col("t"), "\n"))
    )
    before, after = (written(scan_corpus(o.select("doc", x.alias("text"))), "scan") for x in (first, second))
    return graph.compare_models(before, after)


@query(
    "c9_verify_corpus",
    """WITH p AS (SELECT s_suppkey AS k, s_suppkey % 8 AS m FROM supplier), c(place, j) AS (VALUES ('#calls row 1 from', 0), ('#calls row 1 to', 1), ('#called-by row 1 from', 2), ('#called-by row 1 to', 3), ('meta entry', 4), ('meta entry', 5))
  SELECT 'a/b/s' || k || '.mk' AS doc, place, CASE j WHEN 0 THEN '#f' WHEN 1 THEN CASE m WHEN 0 THEN '' WHEN 1 THEN 'nothing' WHEN 2 THEN '../c/none.mk#f' WHEN 3 THEN '#gone' WHEN 4 THEN '../../../out.mk#f' WHEN 5 THEN 'sub/../s' || k || '.mk#g.member' ELSE 's' || k || '.mk#f' END
    WHEN 2 THEN './s' || k || '.mk#g' WHEN 3 THEN '#f' WHEN 4 THEN '#f' ELSE CASE WHEN m = 6 THEN 'bare' WHEN m = 7 THEN '#none' ELSE '#g' END END AS cell,
    CASE WHEN j = 1 THEN CASE m WHEN 0 THEN 'empty cell' WHEN 1 THEN 'no #' WHEN 2 THEN 'missing doc' WHEN 3 THEN 'missing id' WHEN 4 THEN 'missing doc' END WHEN j = 5 AND m = 6 THEN 'no #' WHEN j = 5 AND m = 7 THEN 'missing id' END AS reason FROM p, c""",
)
def c9_verify_corpus(spark, d):
    """A container document a supplier: cells of calls and called-by and its entries, taken relative to the document, with each fault planted."""
    k = F.col("s_suppkey")
    m = k % 8
    to = (
        F.when(m == 0, "").when(m == 1, "nothing").when(m == 2, "../c/none.mk#f").when(m == 3, "#gone").when(m == 4, "../../../out.mk#f")
        .when(m == 5, text("sub/../s", k, ".mk#g.member")).otherwise(text("s", k, ".mk#f"))
    )
    more = F.when(m == 6, "bare").when(m == 7, "#none").otherwise("#g")
    body = text(
        "=== meta\nentry = #f  ", more, "\n===\n\n=== code {#f}\n===\n\n=== code {#g}\n===\n\n=== table {#calls format=csv header=1}\nfrom,to,kind,confidence\n#f,", to, ",call,\n===\n\n",
        "=== table {#called-by format=csv header=1}\nfrom,to,kind,site\n./s", k, ".mk#g,#f,call,\n===\n",
    )
    docs = read(spark, d, "supplier").select(text("a/b/s", k, ".mk").alias("doc"), body.alias("text"))
    s = written(scan_corpus(docs), "scan")
    return graph.verify_edges(graph.reference_cells(s), corpus.list_ids(s), docs)
