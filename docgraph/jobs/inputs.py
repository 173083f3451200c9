"""How the given tables stand in for symbols, edges, tables and references; each as Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docgraph.operators import graph


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as symbols: a brand is a container, type and brand make the file."""
    return read(spark, sf_dir, "part").select(
        F.concat(F.lit("p:"), F.col("p_partkey")).alias("anchor"), F.replace("p_name", F.lit(" "), F.lit(".")).alias("name"),
        F.col("p_brand").alias("container"), F.concat(F.lower("p_type"), F.lit("/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".js")).alias("file"),
        F.when(F.col("p_size") % 10 == 0, "Test").when(F.col("p_size") == 33, "File").otherwise("Function").alias("kind"), F.col("p_size").alias("line_start"),
        (F.col("p_size") + F.col("p_partkey") % 50).alias("line_end"), F.col("p_partkey").alias("id"),
    )


SYMBOLS = """symbols AS (SELECT 'p:' || p_partkey AS anchor, replace(p_name, ' ', '.') AS name, p_brand AS container,
  lower(p_type) || '/' || replace(p_brand, '#', '') || '.js' AS file, CASE WHEN p_size % 10 = 0 THEN 'Test' WHEN p_size = 33 THEN 'File' ELSE 'Function' END AS kind,
  p_size AS line_start, p_size + p_partkey % 50 AS line_end, p_partkey AS id FROM part)"""


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as relations from a part to the part of their order's number, which often doesn't exist."""
    li = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_linenumber") == 6, "CONTAINS").when(F.col("l_returnflag") == "R", "IMPORTS_FROM").otherwise("CALLS")
    site = F.struct(F.concat(F.lit("s"), "l_suppkey").alias("file"), F.col("l_linenumber").cast("int").alias("line"))
    return li.select(kind.alias("kind"), F.concat(F.lit("p:"), F.col("l_partkey")).alias("from"), F.concat(F.lit("p:"), F.col("l_orderkey")).alias("target"), site.alias("site"))


def implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh part is an interface member; the two parts after it implement it."""
    s = symbols(spark, sf_dir)
    members = s.where("id % 7 = 0").select(F.col("anchor").alias("member"), F.explode(F.array(F.col("id") + 1, F.col("id") + 2)).alias("id"))
    return members.join(s.select("id", F.col("anchor").alias("impl")), "id").select("member", "impl")


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved relations; a call to an interface member has its implementations as candidates."""
    return graph.dispatch(graph.resolve_edges(relations(spark, sf_dir), symbols(spark, sf_dir)), implementations(spark, sf_dir))


EDGES = (
    SYMBOLS
    + """, raw AS (SELECT CASE WHEN l_linenumber = 6 THEN NULL WHEN l_returnflag = 'R' THEN 'imports' ELSE 'calls' END AS kind,
  'p:' || l_partkey AS "from", 'p:' || l_orderkey AS target, 's' || l_suppkey AS site_file, CAST(l_linenumber AS INTEGER) AS site_line FROM lineitem),
impls AS (SELECT a.anchor AS member, b.anchor AS impl FROM symbols a CROSS JOIN (VALUES (1), (2)) v(j) JOIN symbols b ON b.id = a.id + j WHERE a.id % 7 = 0),
edges AS (SELECT r.kind, r."from", t.anchor AS "to", CASE WHEN t.anchor IS NULL THEN r.target END AS to_text, site_file, site_line
  FROM raw r JOIN symbols f ON f.anchor = r."from" LEFT JOIN symbols t ON t.anchor = r.target WHERE r.kind IS NOT NULL),
links AS (SELECT "from", "to", 'call' AS kind, site_file, site_line FROM edges WHERE kind = 'calls' AND "to" IS NOT NULL
  UNION ALL SELECT e."from", i.impl, 'candidate', site_file, site_line FROM edges e JOIN impls i ON i.member = e."to" WHERE e.kind = 'calls'),
outd AS (SELECT "from" AS anchor, count(*) AS n FROM edges WHERE kind = 'calls' GROUP BY 1),
ind AS (SELECT "to" AS anchor, count(*) AS n FROM links GROUP BY 1),
crossed AS (SELECT e."to" AS anchor, max(CASE WHEN a.container <> b.container THEN 1 ELSE 0 END) AS x FROM links e JOIN symbols a ON a.anchor = e."from" JOIN symbols b ON b.anchor = e."to" GROUP BY 1),
classified AS (SELECT s.anchor, s.container, s.name, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree,
  s.kind IN ('Function', 'Test') AND coalesce(o.n, 0) = 0 AND coalesce(i.n, 0) >= 1 AS leaf, s.kind = 'Test' AS test, coalesce(c.x, 0) = 1 OR s.name = 'main' AS entry
  FROM symbols s LEFT JOIN outd o USING (anchor) LEFT JOIN ind i USING (anchor) LEFT JOIN crossed c USING (anchor))"""
)


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References of pages: doc, target path (host-relative) and line order of each href."""
    hrefs = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))
    return read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), F.posexplode(hrefs).alias("pos", "href"))


LINKS = """links AS (SELECT page_id AS doc, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)"""
