"""Chart datasets from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(y: list[str], size: str | None) -> tuple[dict[str, Column], Column, Column]:
    """Numbers of the numeric channels, whether one of a row is no number, whether one is empty."""
    from docgraph.functions.values import cell_number

    number = {c: cell_number(F.col(c).cast("string")) for c in [*y, *([size] if size else [])]}
    bad = empty = F.lit(False)
    for c, n in number.items():
        blank = F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""
        bad, empty = bad | (n.isNull() & ~blank), empty | blank
    return number, bad, empty


def scoped(df: DataFrame, rows: str = "data", row_type: str = "row_type") -> DataFrame:
    """Rows of a chart's scope: data, summary or all, told apart by ``row_type``; a frame without that column is all data."""
    if rows not in ("data", "all", "summary"):
        raise ValueError(f"unknown rows scope `{rows}` (data|all|summary)")
    if row_type not in df.columns:
        return df.where(F.lit(rows != "summary"))
    return df if rows == "all" else df.where(F.col(row_type) == rows)


def chart_points(df: DataFrame, chart: str, order: str, x: str, y: list[str], series: str | None = None, size: str | None = None, rows: str = "data") -> DataFrame:
    """(chart, pt, category, series, size, y_col, y): text cells in, long points out.

    A non-empty cell that is no number fails its whole chart; rows with an empty
    numeric cell are left out.
    """
    number, bad, empty = _cells(y, size)
    own = scoped(df, rows)
    failed = own.where(bad).select(F.col(chart).alias("__failed")).distinct()
    good = own.join(failed, F.col(chart).eqNullSafe(F.col("__failed")), "left_anti").where(~empty)
    values = F.array(*[F.struct(F.lit(c).alias("y_col"), number[c].alias("y")) for c in y])
    return good.select(
        F.col(chart).alias("chart"), F.col(order).alias("pt"), F.col(x).cast("string").alias("category"),
        (F.col(series).cast("string") if series else F.lit(None).cast("string")).alias("series"),
        (number[size] if size else F.lit(None).cast("double")).alias("size"), F.inline(values),
    )


def chart_faults(df: DataFrame, chart: str, y: list[str], size: str | None = None, rows: str = "data") -> DataFrame:
    """(chart, severity, message): charts that fail on a cell, and charts of a summary row that isn't there."""
    _, bad, _ = _cells(y, size)
    own = scoped(df, rows)
    fault = lambda d, severity, message: d.select("chart", F.lit(severity).alias("severity"), F.lit(message).alias("message"))
    out = fault(own.where(bad).select(F.col(chart).alias("chart")).distinct(), "error", "chart: non-numeric value in a y column")
    if rows == "data":
        return out
    none = df.select(F.col(chart).alias("chart")).distinct().join(scoped(df, "summary").select(F.col(chart).alias("chart")).distinct(), "chart", "left_anti")
    if rows == "all":
        return out.unionByName(fault(none, "warning", "chart: rows=all but the table has no summary row; using data rows"))
    return out.unionByName(fault(none, "error", "chart: rows=summary but the table has no summary row"))


def series_pivot(points: DataFrame, names: list[str]) -> DataFrame:
    """Categories by series; of several points for one cell the last counts."""
    return points.groupBy("chart", "category").pivot("series", names).agg(F.max_by("y", "pt"))


def pie_share(points: DataFrame) -> DataFrame:
    """Each point's share of its chart's sum, which is added up apart and joined back."""
    sums = points.groupBy(F.col("chart").alias("__chart")).agg(F.sum("y").alias("__sum"))
    total = F.col("__sum")
    share = F.when(total == 0, F.col("y")).otherwise(F.col("y") / F.when(total != 0, total))
    return points.join(sums, F.col("chart").eqNullSafe(F.col("__chart"))).withColumn("share", share).drop("__chart", "__sum")


def nice_maximum(value: Column) -> Column:
    """The least 1, 2, 5 or 10 times a power of ten that isn't below the value; 1 for nothing."""
    unit = F.pow(F.lit(10.0), F.floor(F.log10(F.when(value > 0, value))))
    m = value / unit
    return F.coalesce(F.when(m <= 1, 1.0).when(m <= 2, 2.0).when(m <= 5, 5.0).otherwise(10.0) * unit, F.lit(1.0))


def axis_extent(points: DataFrame) -> DataFrame:
    ends = points.groupBy("chart").agg(F.least(F.lit(0.0), F.min("y")).alias("lo"), F.greatest(F.lit(0.0), F.max("y")).alias("hi"))
    return ends.withColumn("nice", nice_maximum(F.col("hi")))


def bubble_radius(size: Column, largest: Column) -> Column:
    return F.lit(4.0) + F.lit(14.0) * F.sqrt(size / largest)


def chart_binding(charts: DataFrame, tables: DataFrame, ids: DataFrame) -> DataFrame:
    """Why a chart's data= doesn't name a table of its document: rows of doc, chart_id, data and reason (null: bound)."""
    t = tables.select("doc", F.col("table_id").alias("data"), F.lit(True).alias("is_table"))
    i = ids.select("doc", F.col("id").alias("data"), F.lit(True).alias("is_id")).distinct()
    reason = (
        F.when(F.col("data").isNull(), "missing data").when(F.col("is_table"), None).when(F.col("is_id"), "not a table").otherwise("unresolved")
    )
    return charts.join(t, ["doc", "data"], "left").join(i, ["doc", "data"], "left").select("doc", "chart_id", "data", reason.alias("reason"))
