"""Page numbers are told in one pass over a line, whatever stands around them."""

from pyspark.sql import functions as F

from folioflow.functions import text as t

NUMBERS = ["7", " 12\t", "- 3 -", "— 4 —|", " 123 ", "Page 3", "PAGE 3 of 20", "p.9", "pg 4/5", "Pg. 4", "3 OF 10", "3 / 10", "iv", "- XII -", "MMMM", "dcclxxx", "5\r\n"]
OTHERS = ["", " ", "- -", "12345", "Page", "Page 3 of", "pp 3", "3 of", "3 4", "Iv", "ivi", "dcclxxxviii", "i v", "K", "٣", "ⅳ", "page 3 of 4 of 5", "7\nx"]


def test_lines_that_are_page_numbers(spark):
    rows = spark.createDataFrame([(c,) for c in [*NUMBERS, *OTHERS, None]], "c string").select("c", t.is_page_number(F.col("c")).alias("is"))
    assert {r["c"]: r["is"] for r in rows.collect()} == {**dict.fromkeys(NUMBERS, True), **dict.fromkeys(OTHERS, False), None: None}


def test_a_line_is_matched_once(spark):
    plan = spark.range(1).select(F.col("id").cast("string").alias("c")).where(t.is_page_number(F.col("c")))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("rlike") == 1 and "regexp_replace" not in plan
