"""Blocks as plain text: underlined headings, hanging list items, quotes, tab-separated tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import numbers as n
from folioflow.functions import text as t

# Bullets by level.
BULLETS = ("•", "–", "‣")


def rendered(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, text) of blocks (id, block_no, kind, text, level, ordered, indent, number).

    ``number`` is the running number of an ordered item. Empty blocks and page breaks
    leave no trace; list items follow one another on the next line, other blocks
    after a blank one. Blocks of a document meet in one row, as its text must.
    """
    text = t.strip(t.strip_invalid_xml(F.coalesce("text", F.lit(""))))
    kind = F.col("kind")
    one_line = F.replace(text, F.lit("\n"), F.lit(" "))
    rule = F.repeat(F.when(F.col("level") == 1, "=").otherwise("-"), F.greatest(F.lit(3), F.least(F.lit(80), F.length(one_line))))
    heading = F.when(F.col("level") <= 2, F.concat(one_line, F.lit("\n"), rule)).otherwise(one_line)
    quote = F.concat(F.lit("> "), F.replace(text, F.lit("\n"), F.lit("\n> ")))
    depth = F.greatest(F.lit(0), F.coalesce("indent", F.lit(0)))
    bullet = F.element_at(F.array(*map(F.lit, BULLETS)), (depth % 3 + 1).cast("int"))
    mark = F.when(F.col("ordered"), F.concat(n.list_number(F.col("number"), depth), F.lit("."))).otherwise(bullet)
    margin = F.repeat(F.lit("    "), depth)
    item = F.concat(margin, mark, F.lit(" "), F.replace(text, F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), F.length(margin) + F.length(mark) + 1))))
    image = F.when(text == "", "[Image]").otherwise(F.concat(F.lit("[Image: "), text, F.lit("]")))
    shown = F.when(kind == "heading", heading).when(kind == "quote", quote).when(kind == "list_item", item).when(kind == "image", image).when(kind == "page_break", "").otherwise(text)
    rows = blocks.withColumn("_shown", shown).where("_shown <> ''")
    listed = kind == "list_item"
    before = F.lag(listed).over(Window.partitionBy(id_col).orderBy("block_no"))
    parted = F.when(before.isNull(), "").when(before & listed, "\n").otherwise("\n\n")
    parts = F.array_sort(F.collect_list(F.struct("block_no", F.concat("_p", "_shown").alias("x"))))
    joined = F.concat(F.array_join(F.transform("parts", lambda p: p["x"]), ""), F.lit("\n"))
    return rows.withColumn("_p", parted).groupBy(id_col).agg(parts.alias("parts")).select(id_col, joined.alias("text"))
