"""Tables of cells against rules worked out by hand."""

from pyspark.sql import functions as F

from folioflow.operators import grids

SCHEMA = "t string, row int, x0 double, x1 double, text string, bold boolean, italic boolean, size double, flag boolean"


def cells(spark, **tables):
    rows = []
    for name, lines in tables.items():
        for n, line in enumerate(lines):
            rows += [(name, n, 100.0 * k, 100.0 * k + 40, text.strip("*"), text.startswith("*"), False, 10.0, text.endswith("!")) for k, text in enumerate(line)]
    return spark.createDataFrame(rows, SCHEMA).orderBy(F.rand(2))


def told(df):
    return {r["t"]: r[-1] for r in df.collect()}


def test_columns_and_the_cells_in_them(spark):
    df = spark.createDataFrame([("a", 0, 0.0, 40.0, "x"), ("a", 0, 42.0, 50.0, "y"), ("a", 1, 60.0, 90.0, "z"), ("a", 2, 200.0, 240.0, "w"), ("a", 3, 30.0, 95.0, "wide"), ("b", 0, 5.0, 6.0, "one")], "t string, row int, x0 double, x1 double, text string")
    narrow = df.where("text <> 'wide'")
    found = grids.columns(narrow, ["t"], F.lit(2.5))
    assert sorted(map(tuple, found.collect())) == [("a", 0, 0.0, 50.0), ("a", 1, 60.0, 90.0), ("a", 2, 200.0, 240.0), ("b", 0, 5.0, 6.0)]
    placed = grids.in_columns(df.withColumn("x1", F.col("x1") + F.when(F.col("text") == "z", 0.5).otherwise(0.0)), found, ["t"])
    assert {r["text"]: r["col"] for r in placed.collect()} == {"x": 0, "y": 0, "z": 1, "w": 2, "wide": 0, "one": 0}
    assert [r["col"] for r in grids.in_columns(df, found.limit(0), ["t"]).collect()] == [0] * 6


def test_what_counts_as_a_table(spark):
    long = "a sentence of quite some length"
    df = cells(
        spark, good=[["a", "b"], ["c", "d"], ["e", ""]], two=[["a", "b"], ["c", "d"]], hole=[["a", "b"], ["c", ""]], single=[["a", "b"]], thin=[["a"], ["b"], ["c"]],
        sparse=[["a", "", ""], ["", "b", ""], ["", "", "c"], ["d", "e", "f"]], lonely=[["a", "b"], ["c", ""], ["d", ""]], text=[[long, long], [long, long]], three=[[long] * 3, [long] * 3],
    )
    placed = df.withColumn("col", (F.col("x0") / 100).cast("int"))
    assert told(grids.accepted(placed, ["t"])) == {"good": True, "two": True, "hole": False, "single": False, "thin": False, "sparse": False, "lonely": False, "text": False, "three": True}


def test_header_rows(spark):
    df = cells(
        spark, bold=[["*a", "*b"], ["c", "d"], ["e", "f"]], plain=[["a", "b"], ["c", "d"], ["e", "f"]], all_bold=[["*a", "*b"], ["*c", "*d"]], half=[["*a", "b"], ["c", "d"], ["e", "f"]],
        single=[["a", "b"]], flagged=[["a", "b!"], ["c", "d"]], one_bold=[["*a", "*b"]], unlike=[["a", "b"], ["*c", "*d"], ["*e", "f"], ["*ggg", "h"]],
    )
    assert told(grids.headers(df, ["t"])) == {"bold": True, "plain": False, "all_bold": False, "half": False, "single": True, "flagged": False, "one_bold": True, "unlike": True}
    assert told(grids.told_headers(df, ["t"], "flag")) == {"bold": True, "plain": False, "all_bold": True, "half": False, "single": False, "flagged": True, "one_bold": False, "unlike": False}
