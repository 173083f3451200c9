"""Table operators: delimited and pipe bodies, computed columns, summaries, sorting and filtering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docgraph.functions.formulas import FormulaError, aggregate, translate
from docgraph.functions.values import cell_number


def column_letter(i: int) -> str:
    return chr(65 + i) if i < 26 else f"C{i + 1}"


def read_delimited(tables: DataFrame, sep: str = ",", header: bool = True) -> DataFrame:
    """(doc, table_id, row, col, name, text, num) from rows of doc, table_id, body.

    A naive split without quoting; cells are trimmed, blank lines dropped, short
    rows padded with '' and cells beyond the header dropped. Without a header
    the columns are named by letters.
    """
    lines = F.filter(F.split("body", "\n"), lambda x: F.trim(x) != "")
    grid = F.transform(lines, lambda x: F.transform(F.split(x, "\\Q" + sep + "\\E"), lambda c: F.trim(c)))
    t = tables.select("doc", "table_id", grid.alias("grid"))
    first = F.get("grid", F.lit(0))
    names = first if header else F.transform(F.sequence(F.lit(0), F.size(first) - 1), lambda i: F.chr(i + 65))
    body = F.slice("grid", 2, F.greatest(F.size("grid"), F.lit(1))) if header else F.col("grid")
    rows = t.where(F.size("grid") > 0).select("doc", "table_id", names.alias("names"), F.posexplode(body).alias("row", "cells"))
    cells = rows.select(
        "doc", "table_id", "row", F.posexplode("names").alias("col", "name"), "cells"
    ).withColumn("text", F.coalesce(F.get("cells", F.col("col")), F.lit(""))).drop("cells")
    return cells.withColumn("num", cell_number(F.col("text")))


def read_pipe_grid(tables: DataFrame) -> DataFrame:
    """(doc, table_id, row, col, name, align, text, num) from ``| a | b |`` bodies.

    The first row of dashes and colons separates: the row before it is the
    header, its colons give the alignment. Without one, columns get letters.
    """
    lines = F.filter(F.transform(F.split("body", "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|"))
    inner = lambda x: F.transform(F.split(F.regexp_replace(x, r"^\||\|$", ""), r"(?<!\\)\|"), lambda c: F.trim(c))
    t = tables.select("doc", "table_id", F.transform(lines, inner).alias("grid"))
    is_sep = lambda cells: F.forall(cells, lambda c: c.rlike("^:?-+:?$"))
    t = t.withColumn("sep", F.array_position(F.transform("grid", is_sep), True).cast("int")).where(F.size("grid") > 0)
    width = F.size(F.get("grid", F.lit(0)))
    letters = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.chr(i + 65))
    t = t.select(
        "doc", "table_id",
        F.when(F.col("sep") > 1, F.get("grid", F.col("sep") - 2)).otherwise(letters).alias("names"),
        F.when(F.col("sep") > 0, F.get("grid", F.col("sep") - 1)).alias("marks"),
        F.when(F.col("sep") > 0, F.slice("grid", F.col("sep") + 1, F.size("grid"))).otherwise(F.col("grid")).alias("rows"),
    )
    mark = F.coalesce(F.get("marks", F.col("col")), F.lit(""))
    align = F.when(mark.rlike("^:-+:$"), "center").when(mark.rlike("-:$"), "right").when(mark.rlike("^:-"), "left").otherwise("none")
    rows = t.select("doc", "table_id", "names", "marks", F.posexplode("rows").alias("row", "cells"))
    cells = rows.select("doc", "table_id", "row", "cells", "marks", F.posexplode("names").alias("col", "name"))
    return cells.select(
        "doc", "table_id", "row", "col", "name", align.alias("align"), F.coalesce(F.get("cells", F.col("col")), F.lit("")).alias("text")
    ).withColumn("num", cell_number(F.col("text")))


def compute(df: DataFrame, formulas: str, keys: list[str] | None = None) -> DataFrame:
    """Computed columns of a wide table whose columns are numbers (null where a cell is no number).

    ``keys`` name the table a row belongs to, so that an aggregate in a row
    formula is that table's. Aggregates are added up apart and joined back, a row
    a table, so that a large table isn't gathered. A result that isn't finite
    leaves an existing cell as it was.
    """
    keys = keys or []
    own = [c for c in df.columns if c not in keys]
    for i, (name, expr) in enumerate((f.name, e) for f, e in zip(translate(formulas, own), _sources(formulas), strict=True)):
        parts: list[Column] = []

        def once(c: Column, parts: list = parts, i: int = i) -> Column:
            parts.append(c.alias(f"__agg_{i}_{len(parts)}"))
            return F.col(f"__agg_{i}_{len(parts) - 1}")

        column = translate(f"{name} = {expr}", [c for c in df.columns if not c.startswith("__") and c not in keys], once)[0].column
        if parts and keys:
            sums = df.groupBy(*keys).agg(*parts).withColumnsRenamed({k: f"__key_{k}" for k in keys})
            same = F.lit(True)
            for k in keys:
                same = same & F.col(f"`{k}`").eqNullSafe(F.col(f"`__key_{k}`"))
            df = df.join(sums, same).drop(*[f"__key_{k}" for k in keys])
        elif parts:
            df = df.join(F.broadcast(df.agg(*parts)), F.lit(True))  # one row
        df = put(df, name, column)
    return df.drop(*[c for c in df.columns if c.startswith("__agg_")])


def _sources(formulas: str) -> list[str]:
    return [p.partition("=")[2].strip() for p in formulas.split(";") if p.strip()]


def put(df: DataFrame, name: str, column: Column) -> DataFrame:
    good = F.when(~F.isnan(column) & (F.abs(column) != float("inf")), column)
    return df.withColumn(name, F.coalesce(good, F.col(f"`{name}`")) if name in df.columns else good)


def summary_row(df: DataFrame, spec: str, keys: list[str] | None = None, levels: bool = False) -> DataFrame:
    """One foot row a table (or group): ``Name = 'Total'; Q1 = sum(Q1); FY = sum(FY) - sum(Q1)``.

    Text literals label; a column that isn't reduced by an aggregate is an
    error; a result that isn't finite is blank. ``levels`` adds totals (rollup).
    """
    own = [c for c in df.columns if c not in (keys or [])]
    out = []
    for part in filter(None, (p.strip() for p in spec.split(";"))):
        name, _, expr = part.partition("=")
        name, expr = name.strip().strip("'"), expr.strip()
        if len(name) == 1 and name not in df.columns and name.isupper() and ord(name) - 65 < len(own):
            name = own[ord(name) - 65]
        if name not in df.columns:
            raise FormulaError(f"unknown target in summary: {name}")
        if expr[:1] in "'\"" and expr[-1:] == expr[:1] and expr.count(expr[0]) == 2:
            out.append(F.lit(expr[1:-1]).alias(name))
            continue
        f = translate(f"{name} = {expr}", own)[0]
        if f.bare or not f.aggregates:
            raise FormulaError(f"{name} must be reduced by an aggregate")
        out.append(F.when(~F.isnan(f.column) & (F.abs(f.column) != float("inf")), f.column).alias(name))
    grouped = df if not keys else df.rollup(*keys) if levels else df.groupBy(*keys)
    return grouped.agg(*out)


def with_summary(df: DataFrame, foot: DataFrame) -> DataFrame:
    """Rows and their foot row, told apart by row_type."""
    return df.withColumn("row_type", F.lit("data")).unionByName(foot.withColumn("row_type", F.lit("summary")), allowMissingColumns=True)


def column_agg(cells: DataFrame, fn: str, keys: list[str], text: str = "text") -> DataFrame:
    """sum, avg, min, max or count of the numeric cells of each key; nothing numeric gives 0."""
    return cells.groupBy(*keys).agg(aggregate(fn, cell_number(F.col(text))).alias("value"))


def until_first_bad(df: DataFrame, table: str, row: str, value: Column, name: str) -> DataFrame:
    """A formula stops at its table's first row without a value: rows before keep theirs, later ones get none."""
    bad = df.where(value.isNull()).groupBy(F.col(table).alias("__table")).agg(F.min(row).alias("__bad"))
    met = df.join(bad, F.col(table).eqNullSafe(F.col("__table")), "left")
    return met.withColumn(name, F.when(F.col(row) < F.coalesce("__bad", F.lit(1 << 62)), value)).drop("__table", "__bad")


def sort_table(df: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Numbers in their order, then texts in theirs."""
    num = cell_number(F.col(column))
    keys = (num.isNull(), num, F.col(column))
    return df.orderBy(*[k.desc() if descending and i else k.asc() for i, k in enumerate(keys)])


def places(df: DataFrame, column: str, ties: list[str]) -> DataFrame:
    """Adds ``place``, each row's number in the order of ``sort_table``: numbered within range partitions, which are counted first."""
    from docgraph.storage import written

    num = cell_number(F.col(column))
    keyed = df.withColumn("__text", num.isNull()).withColumn("__num", num)
    order = ["__text", "__num", column, *ties]
    part = written(keyed.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "places")
    n = part.groupBy("__part").agg(F.count("*").alias("n"))
    before = n.select("__part", (F.sum("n").over(W.orderBy("__part")) - F.col("n")).alias("__before"))  # a row a partition
    nr = F.row_number().over(W.partitionBy("__part").orderBy(*order))
    return part.join(F.broadcast(before), "__part").withColumn("place", F.col("__before") + nr).drop("__part", "__before", "__text", "__num")


def filter_rows(df: DataFrame, query: str) -> DataFrame:
    """Rows whose text has the query, upper and lower case alike."""
    return df.where(F.lower(F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])).contains(query.strip().lower()))


def render_csv(cells: DataFrame) -> DataFrame:
    """(doc, table_id, body): cells of doc, table_id, row, col, text as delimited lines with columns padded to their widest cell."""
    wide = F.col("wide")
    widths = cells.groupBy("doc", "table_id", "col").agg(F.max(F.length("text")).alias("wide"))
    ends = widths.groupBy("doc", "table_id").agg(F.max("col").alias("last"))
    last = F.col("last")
    padded = cells.join(widths, ["doc", "table_id", "col"]).join(ends, ["doc", "table_id"]).withColumn("cell", F.when(F.col("col") == last, F.col("text")).otherwise(F.rpad(F.concat("text", F.lit(",")), wide + 1, " ")))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", "cell"))), lambda x: x["cell"]), " ")
    lines = padded.groupBy("doc", "table_id", "row").agg(line.alias("line"))
    return lines.groupBy("doc", "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))


def render_pipe(cells: DataFrame) -> DataFrame:
    """(doc, table_id, body): cells of doc, table_id, row, col, name, align, text as a pipe table with its header and alignment row.

    Pipes are escaped and line ends become blanks; a summary is the row that comes last.
    """
    clean = lambda c: F.replace(F.replace(F.col(c), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("\\|"))
    mark = F.col("align")
    rule = F.when(mark == "center", ":--:").when(mark == "right", "---:").when(mark == "left", ":---").otherwise("---")
    line = lambda cell: F.concat(F.lit("| "), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", cell.alias("cell")))), lambda x: x["cell"]), " | "), F.lit(" |"))
    head = cells.groupBy("doc", "table_id", "col").agg(F.first("name").alias("name"), F.first("align").alias("align"))
    head = head.groupBy("doc", "table_id").agg(F.concat(line(clean("name")), F.lit("\n"), line(rule)).alias("head"))
    rows = cells.groupBy("doc", "table_id", "row").agg(line(clean("text")).alias("line"))
    body = rows.groupBy("doc", "table_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return body.join(head, ["doc", "table_id"]).select("doc", "table_id", F.concat("head", F.lit("\n"), "body").alias("body"))


def inline_src(tables: DataFrame, files: DataFrame) -> DataFrame:
    """Attaches the file a table names; a missing, HTML or JSON file leaves it external."""
    start = F.ltrim(F.col("content"))
    tabular = F.col("content").isNotNull() & ~start.startswith("<") & ~(start.rlike(r"^[\[{]") & F.try_parse_json("content").isNotNull())
    return (
        tables.join(files.select(F.col("path").alias("src"), "content"), "src", "left")
        .withColumn("body", F.when(tabular, F.col("content"))).withColumn("external", ~F.coalesce(tabular, F.lit(False))).drop("content")
    )
