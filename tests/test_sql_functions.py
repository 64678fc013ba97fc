import pytest
from pyspark.sql import functions as F

from cleanloom.functions import scalars as S
from cleanloom.functions.sql import functions_of, register_functions, sql_text

VALUES = [
    None, "", " n/a ", "O'Brien  vp-sales", "  A\tb ", "USER@Example.COM", "bad@", "(212) 555-0123", "+33 1 42 68 53 00", "12/31/2024", "5 March 2024", "2024-02-30", "1.5E+3",
    "1E-7", "it's \\n \"x\"", "ÉTÉ ﬁ", "212.736.5000 x12", "31-Dec-24", "Ⅷ", "1,2", "a`b",
]


def test_sql_equals_columns(spark):
    names = register_functions(spark, this_year=2026)
    frame = spark.createDataFrame([(k, v) for k, v in enumerate(VALUES)], "k int, x string")
    frame.createOrReplaceTempView("sql_values")
    made = functions_of(this_year=2026) | {"ascii_fold": ("STRING", S.ascii_fold)}
    assert set(names) == set(made) and len(names) == 13
    got = spark.sql(f"SELECT k, {', '.join(f'{n}(x) AS {n}' for n in names)} FROM sql_values").orderBy("k").collect()
    want = frame.select("k", *[made[n][1](F.col("x")).alias(n) for n in names]).orderBy("k").collect()
    assert got == want


def test_names_can_be_used_anywhere(spark):
    register_functions(spark, region="FR", day_first=True)
    spark.createDataFrame([("01 42 68 53 00", "3/4/2024"), ("x", "-")], "p string, d string").createOrReplaceTempView("sql_rows")
    assert [tuple(r) for r in spark.sql("SELECT phone_e164(p), to_iso_date(d) FROM sql_rows WHERE NOT is_missing(d) GROUP BY ALL").collect()] == [("+33142685300", "2024-04-03")]
    plan = spark.sql("SELECT upper_case(p) u FROM sql_rows")._jdf.queryExecution().optimizedPlan().toString()
    assert "upper(" in plan and "upper_case" not in plan  # inlined


def test_text_of_expressions(spark):
    x = F.col("x")
    for made in ((x > "a'\"\\b(") | ~x.isin("in(", "or("), F.when(x.rlike(r"^\(\d+\)'$"), F.length(x) * 2 - 1).otherwise(0), F.transform(F.array(x, F.lit("!(")), lambda y: F.concat(y, F.lit("=("))), F.struct(x.alias("a"))["a"]):
        frame = spark.createDataFrame([("(12)'",), ("in(",), ("z",)], "x string")
        assert frame.selectExpr(f"{sql_text(made)} AS v").collect() == frame.select(made.alias("v")).collect()
    with pytest.raises(ValueError, match="Not a Column"):
        sql_text("x")
