"""Queries over tables found on pages; an order's lines are the rows of a table of three cells each."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import grids
from folioflow.plans.registry import query
from folioflow.session import table

CELLS = """c AS (SELECT l_orderkey, l_linenumber AS row, k, CAST(k * 100 + l_partkey % 4 * 10 AS DOUBLE) AS x0, CAST(k * 100 + l_partkey % 4 * 10 + 60 + l_suppkey % 3 * 15 AS DOUBLE) AS x1, repeat('x', CAST(l_partkey * (k + 1) % 9 AS INT)) AS text,
  (l_linenumber = 1 AND l_returnflag <> 'N') OR l_partkey % 5 = 0 AS bold, l_suppkey % 11 = 0 AS italic, CASE WHEN l_linestatus = 'F' THEN 10.0 ELSE 12.0 END AS size, l_partkey % 23 = 0 AS flag FROM lineitem, range(3) AS r(k)),
i AS (SELECT *, max(x1) OVER (PARTITION BY l_orderkey ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT l_orderkey, x0, x1 FROM c)),
b AS (SELECT *, sum(CASE WHEN reach IS NULL OR x0 - reach > 2.5 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY x0, x1) AS band FROM i),
l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(x0)) - 1 AS col, min(x0) AS low, max(x1) AS high FROM b GROUP BY l_orderkey, band)"""


def _cells(spark, sf_dir):
    k, part, supplier = F.col("k"), F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, sf_dir, "lineitem").withColumn("k", F.explode(F.array(*map(F.lit, range(3)))))
    x0 = (k * 100 + part % 4 * 10).cast("double")
    return rows.select(
        "l_orderkey", F.col("l_linenumber").alias("row"), "k", x0.alias("x0"), (x0 + 60 + supplier % 3 * 15).alias("x1"), F.repeat(F.lit("x"), (part * (k + 1) % 9).cast("int")).alias("text"),
        (((F.col("row") == 1) & (F.col("l_returnflag") != "N")) | (part % 5 == 0)).alias("bold"), (supplier % 11 == 0).alias("italic"), F.when(F.col("l_linestatus") == "F", 10.0).otherwise(12.0).alias("size"), (part % 23 == 0).alias("flag"),
    )


@query("table_columns", f"WITH {CELLS} SELECT l_orderkey, CAST(col AS INT) AS col, low, high FROM l")
def table_columns(spark, sf_dir):
    """The columns that an order's cells make."""
    return grids.columns(_cells(spark, sf_dir), ["l_orderkey"], F.lit(2.5))


@query(
    "accepted_tables",
    f"""WITH {CELLS}, o AS (SELECT l_orderkey, col, low, high + CASE WHEN col % 2 = 1 THEN -12 ELSE 0 END AS high FROM l), p AS (SELECT c.l_orderkey, c.row, c.k, c.x0, length(c.text) AS n, coalesce(min(o.col) FILTER (c.x0 >= o.low - 0.5 AND c.x1 <= o.high + 0.5), 0) AS col FROM c LEFT JOIN o USING (l_orderkey) GROUP BY ALL),
g AS (SELECT l_orderkey, col, count(*) FILTER (n > 0) AS filled, sum(n) AS signs FROM (SELECT l_orderkey, row, col, sum(n) AS n FROM p GROUP BY ALL) GROUP BY ALL),
s AS (SELECT l_orderkey, count(*) AS cols, sum(filled) AS filled, min(filled) AS least, sum(signs) AS signs FROM g GROUP BY 1), h AS (SELECT l_orderkey, count(DISTINCT row) AS rows FROM c GROUP BY 1)
SELECT l_orderkey, CAST(rows AS INT) AS rows, CAST(cols AS INT) AS cols, rows >= 2 AND cols >= 2 AND CASE WHEN rows = 2 THEN filled = rows * cols ELSE filled >= 0.6 * rows * cols END AND least >= 2 AND NOT (cols = 2 AND signs >= 25 * rows * cols) AS accepted FROM s JOIN h USING (l_orderkey)""",
)
def accepted_tables(spark, sf_dir):
    """Which orders' cells, put into columns of which every second is cut short, are a table."""
    cells = _cells(spark, sf_dir)
    short = F.when(F.col("col") % 2 == 1, 12.0).otherwise(0.0)
    found = grids.columns(cells, ["l_orderkey"], F.lit(2.5)).withColumn("high", F.col("high") - short)
    return grids.accepted(grids.in_columns(cells, found, ["l_orderkey"]), ["l_orderkey"])


@query(
    "table_headers",
    f"""WITH {CELLS}, z AS (SELECT l_orderkey, row, size FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, row ORDER BY n DESC, first, size) AS r FROM (SELECT l_orderkey, row, size, sum(length(text)) AS n, min(x0) AS first FROM c GROUP BY ALL)) WHERE r = 1),
r AS (SELECT l_orderkey, row, 2 * sum(CASE WHEN bold THEN length(text) ELSE 0 END) > sum(length(text)) AS bold, 2 * sum(CASE WHEN italic THEN length(text) ELSE 0 END) > sum(length(text)) AS italic, bool_and(length(text) = 0 OR bold) AS all_bold, sum(length(text)) > 0 AS filled, bool_or(flag) AS told FROM c GROUP BY ALL),
f AS (SELECT r.*, floor(size + 0.5) AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY row) AS n FROM r JOIN z USING (l_orderkey, row)),
t AS (SELECT f.l_orderkey, count(*) FILTER (f.n > 1) AS others, count(*) FILTER (f.n > 1 AND f.bold = o.bold AND f.italic = o.italic AND f.size = o.size) AS alike, bool_or(f.n = 1 AND f.all_bold) AS top_bold, bool_and(f.n = 1 OR f.bold) AS rest_bold, bool_or(f.n = 1 AND f.told) AS told, bool_or(f.n = 1 AND f.all_bold AND f.filled) AS filled_bold
  FROM f JOIN f o ON o.l_orderkey = f.l_orderkey AND o.n = 1 GROUP BY 1)
SELECT l_orderkey, (top_bold AND NOT rest_bold) OR alike = 0 OR 2 * alike < others AS header, told OR (filled_bold AND others > 0) AS told_header FROM t""",
)
def table_headers(spark, sf_dir):
    """Whether the first row is a header by its look, and by what a document tells or its weight."""
    cells = _cells(spark, sf_dir)
    return grids.headers(cells, ["l_orderkey"]).join(grids.told_headers(cells, ["l_orderkey"], "flag").withColumnRenamed("header", "told_header"), "l_orderkey")
