"""Value, path and formula functions on literal cases."""

import pytest
from pyspark.sql import functions as F

from docgraph.functions import paths, values
from docgraph.functions.formulas import FormulaError, translate
from docgraph.operators import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def cells(spark, column, *inputs):
    return [r.x for r in spark.createDataFrame(list(enumerate(inputs)), "i int, v string").orderBy("i").select(column(F.col("v")).alias("x")).collect()]


def test_coerce(spark):
    out = cells(spark, values.coerce, "1", " -2.5 ", "1e3", "1d", "NaN", "true", '"7"', "abc", "")
    assert [r.kind for r in out] == ["number"] * 3 + ["string"] * 2 + ["boolean", "string", "string", "string"]
    assert [r.num for r in out[:3]] == [1.0, -2.5, 1000.0] and out[6].text == "7"


def test_attributes(spark):
    a = one(spark, values.parse_attrs(F.lit('{#id .a .b k=1 name="a b" flag k=2}')))
    assert a.id == "id" and a.classes == ["a", "b"] and a.attrs == {"k": "2", "name": "a b", "flag": "true"}


def test_printf(spark):
    d = spark.createDataFrame([(0, 1.005), (1, 0.25), (2, 12.34), (3, -2.5), (4, 2.5), (5, None)], "i int, v double").orderBy("i")
    of = lambda fmt: [r.x for r in d.select("i", values.printf(fmt, F.col("v")).alias("x")).orderBy("i").collect()]
    assert of("%.2f")[0] == "1.00" and of("%.1f")[1] == "0.3" and of("%.1f%%")[2] == "12.3%" and of("%d")[3:5] == ["-2", "3"] and of("%f")[5] is None


def test_number_text(spark):
    assert [r.x for r in spark.createDataFrame([(0.1 + 0.2,), (3.0,)], "v double").select(values.number_text(F.col("v")).alias("x")).collect()] == ["0.3", "3"]


def test_slugs_and_urls(spark):
    assert cells(spark, values.slug, "Hello `x` World!", "Über  uns") == ["hello-world", "über-uns"]
    assert cells(spark, values.safe_url, "http://a", "java\tscript:x", "mailto:a@b", "data:image/png,x", "a/b") == [True, False, True, False, True]
    assert one(spark, values.safe_url(F.lit("data:image/png,x"), media=True))


def test_paths(spark):
    assert cells(spark, paths.normalize, "a/./b/../c", "../x", "a//b", "a\\b") == ["a/c", "../x", "a/b", "a/b"]
    assert cells(spark, paths.escapes_root, "../x", "/a", "C:\\a", "a/../b") == [True, True, True, False]
    assert cells(spark, paths.is_test, "src/test/a.js", "contest/a.js", "a/foo.spec.ts", "latest.js") == [True, False, True, False]
    assert cells(spark, lambda c: paths.fold_prefix(c, ["com", "com/acme"]), "com/acme/x", "com", "com/com/y") == ["x", "com", "y"]
    assert cells(spark, lambda c: paths.excluded(c, ["**/gen/**", "*.min.js"]), "a/gen/b", "x.min.js", "a/x.min.js") == [True, True, False]


def test_common_prefix(spark):
    d = spark.createDataFrame([(1, "a/b/c"), (1, "a/b/d/e"), (2, "x"), (3, "a/b"), (3, "c")], "k int, p string")
    assert {r.k: r.prefix for r in paths.common_prefix(d, ["k"], "p").collect()} == {1: "a/b", 2: "x", 3: ""}


def wide(spark, rows):
    return spark.createDataFrame(rows, "seg string, Q1 double, Q2 double").select("Q1", "Q2")


def test_formulas(spark):
    t = wide(spark, [("a", 1.0, 2.0), ("b", 3.0, 0.0)])
    out = tables.compute(t, "FY [%.1f] = Q1 + Q2; Half = FY / 2; R = Q1 / Q2; T = sum(A); P = (Q1 + Q2) * -2").orderBy("Q1").collect()
    assert [(r.FY, r.Half, r.R, r["T"], r.P) for r in out] == [(3.0, 1.5, 0.5, 4.0, -6.0), (3.0, 1.5, None, 4.0, -6.0)]
    kept = tables.compute(t, "Q1 = Q1 / Q2").orderBy("Q2").collect()
    assert [r.Q1 for r in kept] == [3.0, 0.5]  # a division by 0 leaves the cell


@pytest.mark.parametrize("text", ["X = nope * 2", "X = (Q1", "X = Q1 Q2", "X", "X = Q1 +", "X = #"])
def test_formula_errors(spark, text):
    with pytest.raises(FormulaError):
        translate(text, ["Q1", "Q2"])


def test_summary(spark):
    t = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, 4.0)], "Seg string, Q1 double, FY double")
    foot = tables.summary_row(t, "Seg = 'Total'; Q1 = sum(Q1); FY = sum(FY) - sum(Q1)").first()
    assert (foot.Seg, foot.Q1, foot.FY) == ("Total", 4.0, 2.0)
    with pytest.raises(FormulaError):
        tables.summary_row(t, "FY = FY")
    assert tables.summary_row(t.limit(0), "Q1 = sum(Q1)").first().Q1 == 0.0
    assert [r.row_type for r in tables.with_summary(t, tables.summary_row(t, "Q1 = sum(Q1)")).collect()].count("summary") == 1
