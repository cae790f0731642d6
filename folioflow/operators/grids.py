"""Tables found on pages: columns, cells in them, what counts as a table and which rows are headers, over rows of cells.

``cells`` have the keys of a table, ``row`` and ``x0``, ``x1``, ``text``; where asked for also ``bold``, ``italic`` and ``size``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.operators import windows as w

# Slack of cells in points, share of filled cells, filled cells a column, mean signs a cell from which two columns are text.
CELL_SLACK, FILLED, COLUMN_CELLS, TEXT_SIGNS = 0.5, 0.6, 2, 25


def columns(cells: DataFrame, keys: list[str], slack: Column) -> DataFrame:
    """(keys, col, low, high): the unions of cells' x intervals that no gap over ``slack`` parts, numbered from 0."""
    found = w.bands(cells.select(*keys, "x0", "x1"), "x0", "x1", slack, keys).groupBy(*keys, "band").agg(F.min("x0").alias("low"), F.max("x1").alias("high"))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("low", "high")) - 1
    return found.select(*keys, place.cast("int").alias("col"), "low", "high")


def in_columns(cells: DataFrame, found: DataFrame, keys: list[str], slack: float = CELL_SLACK) -> DataFrame:
    """``cells`` with ``col``: the first column (keys, col, low, high) that holds a cell with some slack, else 0.

    The columns of a table are few and stand in one row beside its cells.
    """
    held = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("col", "low", "high"))).alias("_columns"))
    joined = cells.join(held, keys, "left")
    first = F.element_at(F.filter("_columns", lambda c: (F.col("x0") >= c["low"] - slack) & (F.col("x1") <= c["high"] + slack)), 1)
    fits = F.exists("_columns", lambda c: (F.col("x0") >= c["low"] - slack) & (F.col("x1") <= c["high"] + slack))
    return joined.withColumn("col", F.when(F.coalesce(fits, F.lit(False)), first["col"]).otherwise(0).cast("int")).drop("_columns")


def accepted(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, cols, accepted) of cells with ``col``: enough rows, columns and filled cells, and not two columns of text.

    Two rows must be filled whole, more to 60 %; each column has two filled cells at least; two columns with 25 signs a cell are text.
    """
    signs = F.length(F.trim(F.coalesce("text", F.lit(""))))
    placed = cells.groupBy(*keys, "row", "col").agg(F.sum(signs).alias("signs"))
    by_column = placed.groupBy(*keys, "col").agg(F.count_if(F.col("signs") > 0).alias("filled"), F.sum("signs").alias("signs"))
    shape = cells.groupBy(*keys).agg(F.count_distinct("row").alias("rows"))
    told = by_column.groupBy(*keys).agg(F.count("*").alias("cols"), F.sum("filled").alias("filled"), F.min("filled").alias("least"), F.sum("signs").alias("signs")).join(shape, keys)
    area = F.col("rows") * F.col("cols")
    full = F.when(F.col("rows") == 2, F.col("filled") == area).otherwise(F.col("filled") >= area * FILLED)
    text = (F.col("cols") == 2) & (F.col("signs") >= area * TEXT_SIGNS)
    sound = (F.col("rows") >= 2) & (F.col("cols") >= 2) & full & (F.col("least") >= COLUMN_CELLS) & ~text
    return told.select(*keys, F.col("rows").cast("int"), F.col("cols").cast("int"), sound.alias("accepted"))


def _rows(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, bold, all_bold, look) of the rows of cells: whether most signs and whether all filled cells are bold, and what a row looks like."""
    signs = F.length(F.trim(F.coalesce("text", F.lit(""))))
    most = lambda c: 2 * F.sum(F.when(F.col(c), signs).otherwise(0)) > F.sum(signs)
    sizes = cells.groupBy(*keys, "row", "size").agg(F.sum(signs).alias("n"), F.min("x0").alias("at"))
    size = sizes.groupBy(*keys, "row").agg(F.min_by("size", F.struct((-F.col("n")).alias("n"), "at", "size")).alias("size"))
    rows = cells.groupBy(*keys, "row").agg(most("bold").alias("bold"), most("italic").alias("italic"), F.bool_and((signs == 0) | F.col("bold")).alias("all_bold"), (F.sum(signs) > 0).alias("filled"))
    return rows.join(size, [*keys, "row"]).withColumn("look", F.struct("bold", "italic", F.floor(F.col("size") + 0.5).alias("size")))


def headers(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, header): whether a table's first row looks unlike most others or each of them, or is bold where not all others are."""
    rows = _rows(cells, keys)
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("row")) == 1
    top = rows.withColumn("first", first).withColumn("top", F.max(F.when(F.col("first"), F.col("look"))).over(Window.partitionBy(*keys)))
    alike = F.count_if(~F.col("first") & (F.col("look") == F.col("top")))
    others = F.count_if(~F.col("first"))
    bold = F.coalesce(F.bool_or(F.col("first") & F.col("all_bold")), F.lit(False)) & ~F.coalesce(F.bool_and(F.col("first") | F.col("bold")), F.lit(True))
    return top.groupBy(*keys).agg((bold | (alike == 0) | (alike * 2 < others)).alias("header"))


def told_headers(cells: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """(keys, header): whether a table says that its first row is one, or has more rows and all that stands in the first is bold."""
    rows = _rows(cells, keys).join(cells.groupBy(*keys, "row").agg(F.bool_or(flag).alias("told")), [*keys, "row"])
    first = F.row_number().over(Window.partitionBy(*keys).orderBy("row")) == 1
    flagged, bold = (F.coalesce(F.bool_or(F.col("first") & c), F.lit(False)) for c in (F.col("told"), F.col("all_bold") & F.col("filled")))
    return rows.withColumn("first", first).groupBy(*keys).agg((flagged | (bold & (F.count("*") > 1))).alias("header"))
