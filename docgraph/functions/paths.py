"""Functions over repository paths: Column in, Column out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Extension to language, for source files.
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "java": "java", "kt": "kotlin", "go": "go", "rs": "rust", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "cs": "csharp",
    "rb": "ruby", "php": "php", "swift": "swift", "scala": "scala", "vue": "vue", "svelte": "svelte",
}
#: What makes a path a test's.
TEST_DIR = r"(?i)(^|/)(test|tests|testing|__tests__|spec|specs)(/|$)"
TEST_FILE = r"(?i)(^test_|^tests?\.|[._-]tests?\.|\.test\.|\.spec\.)"


def directory(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit("(root)")).otherwise(F.regexp_replace(path, "/[^/]*$", ""))


def top(path: Column) -> Column:
    return F.when(F.instr(path, "/") == 0, F.lit("(root)")).otherwise(F.substring_index(path, "/", 1))


def base(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def normalize(path: Column) -> Column:
    """Resolves ``.``, ``..`` and repeated slashes; leading ``..`` stay."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda x: (x != "") & (x != "."))
    stacked = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when((x == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("..")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    return F.array_join(stacked, "/")


def escapes_root(path: Column) -> Column:
    """Absolute, on a drive, or leading out of the root."""
    return path.rlike(r"^([/\\]|[A-Za-z]:)") | normalize(path).rlike(r"^\.\.(/|$)")


def confined(df: DataFrame, column: str) -> DataFrame:
    return df.where(~escapes_root(F.col(column)))


def glob_pattern(glob: str) -> str:
    """Regex of a glob: ``**`` any run, ``*`` a run within a segment, ``?`` a character of one."""
    out = ""
    for part in re.split(r"(\*\*/?|\*|\?)", glob):
        out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part, re.escape(part))
    return f"^{out}$"


def excluded(path: Column, globs: list[str]) -> Column:
    out = F.lit(False)
    for g in globs:
        out = out | path.rlike(glob_pattern(g))
    return out


def exclude_paths(df: DataFrame, column: str, globs: list[str], ignored: DataFrame | None = None) -> DataFrame:
    """Rows whose path matches no glob and isn't among the ``ignored`` ones (path)."""
    kept = df.where(~excluded(F.col(column), globs) | F.col(column).isNull())
    if ignored is None:
        return kept
    gone = ignored.select(F.col("path").alias("__ignored")).distinct()
    return kept.join(gone, F.col(column) == F.col("__ignored"), "left_anti")


def is_test(path: Column) -> Column:
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return p.rlike(TEST_DIR) | base(p).rlike(TEST_FILE)


def language(path: Column) -> Column:
    """Language of a source file's extension, or null."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.lower(F.regexp_extract(base(path), r"\.([^.]+)$", 1)))


def is_source(path: Column) -> Column:
    return language(path).isNotNull()


def fold_prefix(path: Column, prefixes: list[str]) -> Column:
    """Strips the longest matching leading run of segments again and again, never the whole path."""
    if not prefixes:
        return path
    ordered = "|".join(re.escape(p.strip("/")) for p in sorted(prefixes, key=len, reverse=True))
    return F.regexp_replace(path, f"^(?:(?:{ordered})/)+(?=.)", "")


def split_source_root(path: Column, roots: list[tuple[str, str]]) -> Column:
    """struct(kind, tail): the longest matching source or test root is stripped (``*`` is one segment); a trailing test folder makes it test."""
    out = F.struct(F.lit("main").alias("kind"), path.alias("tail"))
    for pattern, kind in sorted(roots, key=lambda r: len(r[0])):
        rx = "^" + "/".join("[^/]+" if s == "*" else re.escape(s) for s in pattern.split("/")) + "(?:/|$)"
        out = F.when(path.rlike(rx), F.struct(F.lit(kind).alias("kind"), F.regexp_replace(path, rx, "").alias("tail"))).otherwise(out)
    return F.struct(F.when(F.regexp_replace(path, "^.*/", "").rlike("(?i)^(tests?|__tests__|specs?)$"), F.lit("test")).otherwise(out["kind"]).alias("kind"), out["tail"].alias("tail"))


def ancestors(path: Column) -> Column:
    """'' and every leading run of the path's folders."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def nearest_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """path and its deepest enclosing root ('' is the repository): each path meets only its own ancestors."""
    keyed = paths.select("path", F.explode(ancestors(F.col("path"))).alias("root"))
    found = keyed.join(roots.select("root").distinct(), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.select("path").distinct().join(found, "path", "left").select("path", F.coalesce("root", F.lit("")).alias("root"))


def common_prefix(df: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Longest common folder prefix of each group: that of its least and its greatest path."""
    segs = F.split(F.col(path), "/")
    g = df.groupBy(*keys).agg(F.min(segs).alias("lo"), F.max(segs).alias("hi"))
    same = F.aggregate(
        F.zip_with("lo", "hi", lambda a, b: F.coalesce(a == b, F.lit(False))), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda acc, e: F.struct((acc["n"] + F.when(acc["on"] & e, 1).otherwise(0)).alias("n"), (acc["on"] & e).alias("on")), lambda acc: acc["n"],
    )
    return g.select(*keys, F.array_join(F.slice("lo", F.lit(1), same), "/").alias("prefix"))


def display_paths(df: DataFrame, prefixes: list[str], roots: list[tuple[str, str]]) -> DataFrame:
    """Adds ``display``: [test/]module/tail with folded prefixes; where two folders fold to one, both keep the full path."""
    cut = split_source_root(F.col("path"), roots)
    d = df.withColumn("kind", cut["kind"]).withColumn("tail", fold_prefix(cut["tail"], prefixes))
    parts = F.concat_ws("/", F.when(F.col("kind") == "test", F.lit("test")), F.when(F.col("module") != "", F.col("module")), F.when(F.col("tail") != "", F.col("tail")))
    folded = F.when(parts == "", F.lit("(root)")).otherwise(parts)
    d = d.withColumn("folded", folded)
    clashes = d.groupBy("folded").agg(F.countDistinct("path").alias("n")).where("n > 1").select("folded", F.lit(True).alias("clash"))
    return d.join(clashes, "folded", "left").withColumn("display", F.when(F.col("clash"), F.col("path")).otherwise(F.col("folded"))).drop("tail", "folded", "clash")
