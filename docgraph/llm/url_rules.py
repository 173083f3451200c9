"""URL filters by association rules.

A page list of hand-written host and path rules labels the pages it covers.
Spark's FP-growth mines token combinations of these pages' URLs with their
labels; rules "tokens -> block" that pass the limits of support, confidence and
conviction and hold on several hosts are kept. A page that the list doesn't cover is
unknown, neither allowed nor blocked; but the pages with a rule's tokens must be
covered to a good part, or the list would say too little of them. Of nested
rules the shorter stay. An unlisted page is blocked if a mined rule matches:
each rule is indexed under its rarest token, so a page meets only rules that
share it. ``held_out`` measures the rules on hosts that they weren't mined from.

Nulls and edge cases: a null url, or one without ``://``, has an empty host and
path, is covered by no rule and has no tokens, so it is allowed; repeated rows
each get a row; an empty table, one without blocked pages or one where the list
blocks nearly all that it covers mines no rule; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, fold_case, materialize

#: (verdict, host, path): fits the host and its subdomains where the url's path starts with the path.
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
#: A mined rule holds for this share of the listed pages, and the list blocks this share of those with its tokens.
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.95
#: Times that a rule errs less often than "block all" would, with its errors taken as (allowed + 1) / (listed + 2); hosts whose blocked pages it matches.
MIN_CONVICTION, MIN_HOSTS = 3, 3
#: Share of all pages with a rule's tokens that the list covers, at least.
MIN_COVERAGE = 0.25
BLOCKED = "label=block"


def host_of(url: Column) -> Column:
    return fold_case(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule (the longest that fits, or null) and its verdict."""
    split = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longer overrules
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return split.select("*", rule.alias("rule"), verdict.alias("listed"))


def tokens_of(host: Column, path: Column) -> Column:
    """Distinct labels of the host and segments of the path; digits are folded to one sign."""
    labels = F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("h:"), x))
    segments = F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, "[0-9]+", "0")))
    return F.array_distinct(F.filter(F.concat(labels, segments), lambda x: F.length(x) > 2))


RULE = "rule_id long, tokens array<string>, confidence double, support double, conviction double, hosts long, coverage double"


def mine(
    pages: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_conviction: float = MIN_CONVICTION, min_hosts: int = MIN_HOSTS, min_coverage: float = MIN_COVERAGE
) -> DataFrame:
    """RULE from rows of row, host, tokens and blocked (null: the list doesn't cover the page).

    A token set that is too rare can't reach the support, so tokens are pruned first.
    """
    spark = pages.sparkSession
    known = pages.where("blocked IS NOT NULL")
    head = known.agg(F.count("*").alias("n"), F.avg(F.col("blocked").cast("int")).alias("base")).first()
    n, base = head["n"], head["base"] or 0.0
    frequent = known.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= max(1.0, min_support * n))
    kept = materialize(
        known.select("row", "blocked", F.explode("tokens").alias("token"))
        .join(frequent.select("token"), "token", "left_semi")
        .groupBy("row", "blocked").agg(F.collect_set("token").alias("items"))
        .select(F.when(F.col("blocked"), F.array_append("items", F.lit(BLOCKED))).otherwise(F.col("items")).alias("items")),
        "url-transactions",
    )
    if not kept.limit(1).count():
        return spark.createDataFrame([], RULE)
    # pages whose tokens are all rare are left out of the transactions, not of the support
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, min_support * n / kept.count()), minConfidence=min_confidence).fit(kept)
    to_block = model.associationRules.where((F.size("consequent") == 1) & (F.col("consequent")[0] == BLOCKED))
    rules = to_block.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support").orderBy(F.desc("support"), F.desc("confidence"), F.array_join("tokens", " "))
    rules = materialize(rules.withColumn("rule_id", F.monotonically_increasing_id()), "url-rules")
    # what is blocked on few hosts says more of the host than of the tokens, and what is mostly uncovered isn't known
    met = matches(pages.select("row", "tokens"), rules, token_counts(pages)).join(pages.select("row", "host", "blocked"), "row")
    errors = (F.sum((~F.col("blocked")).cast("int")) + 1) / (F.count("blocked") + 2)
    met = met.groupBy("rule_id").agg(
        ((1 - F.lit(base)) / errors).alias("conviction"), F.countDistinct(F.when(F.col("blocked"), F.col("host"))).alias("hosts"), F.avg(F.col("blocked").isNotNull().cast("int")).alias("coverage")
    )
    good = (F.col("conviction") >= min_conviction) & (F.col("hosts") >= min_hosts) & (F.col("coverage") >= min_coverage)
    rules = materialize(rules.join(met.where(good), "rule_id"), "url-rules-of-hosts")
    # a rule that holds another one's tokens adds nothing: rules are looked up as pages are
    as_pages = rules.select(F.col("rule_id").alias("row"), "tokens")
    implied = matches(as_pages, rules, token_counts(rules)).where("row <> rule_id").select(F.col("row").alias("rule_id")).distinct()
    return rules.join(implied, "rule_id", "left_anti")


def token_counts(pages: DataFrame) -> DataFrame:
    return pages.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def matches(pages: DataFrame, rules: DataFrame, often: DataFrame) -> DataFrame:
    """(row, rule_id) of all rules that fit, by an inverted index: ``pages`` has row and tokens, ``often`` how many pages have a token."""
    keyed = rules.select("rule_id", "tokens", F.explode("tokens").alias("token")).join(often, "token", "left")
    index = keyed.groupBy("rule_id").agg(F.first("tokens").alias("need"), F.min_by("token", F.struct(F.coalesce("n", F.lit(0)), "token")).alias("token"))
    met = pages.select("row", F.col("tokens").alias("have"), F.explode("tokens").alias("token")).join(broadcast_if_small(materialize(index, "url-index")), "token")
    return met.where(F.size(F.array_except("need", "have")) == 0).select("row", "rule_id")


def prepared(pages: DataFrame, rules: tuple) -> DataFrame:
    """page_id, host, path, rule, listed, tokens and row."""
    return materialize(
        listed(pages, rules).withColumn("tokens", tokens_of(F.col("host"), F.col("path"))).withColumn("row", F.monotonically_increasing_id()), "url-pages"
    )


def labelled(rows: DataFrame) -> DataFrame:
    return rows.select("row", "host", "tokens", (F.col("listed") == "block").alias("blocked"))


def judge(pages: DataFrame, rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the tokens of the mined rule that blocked it)."""
    rows = prepared(pages, rules)
    mined = materialize(mine(labelled(rows)), "url-mined")
    hits = matches(rows.where("listed IS NULL").select("row", "tokens"), mined, token_counts(rows)).groupBy("row").agg(F.min("rule_id").alias("rule_id"))
    names = mined.select("rule_id", F.array_join("tokens", " & ").alias("tokens_of_rule"))
    named = hits.join(broadcast_if_small(materialize(names, "url-names")), "rule_id", "left")
    out = rows.join(named.select("row", "tokens_of_rule"), "row", "left")
    verdict = F.coalesce("listed", F.when(F.col("tokens_of_rule").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("tokens_of_rule").alias("mined"))


def held_out(pages: DataFrame, rules: tuple = RULES, folds: int = 3, held: int = 0) -> DataFrame:
    """One row (blocked, right, missed): how the rules mined without a fold of the hosts do on that fold's listed pages.

    ``blocked`` pages match a mined rule, ``right`` ones of them are blocked by
    the list too, ``missed`` ones only by the list.
    """
    rows = prepared(pages, rules).withColumn("out", F.pmod(F.xxhash64("host"), F.lit(folds)) == held)
    mined = materialize(mine(labelled(rows.where(~F.col("out")))), "url-mined")
    test = rows.where(F.col("out") & F.col("listed").isNotNull())
    hit = matches(test.select("row", "tokens"), mined, token_counts(rows)).select("row").distinct().withColumn("hit", F.lit(True))
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    said, meant = F.coalesce("hit", F.lit(False)), F.col("listed") == "block"
    return test.join(hit, "row", "left").agg(one(said).alias("blocked"), one(said & meant).alias("right"), one(~said & meant).alias("missed"))
