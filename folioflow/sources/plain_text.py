"""Plain text as blocks: paragraphs, nested list items and page breaks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.session import bounded_batches

# What opens a list item in plain text.
_BULLET = re.compile(r"^([ \t]*)([-*+•‣◦▪▫●○■□–·⁃])[ \t]+(\S.*)$")
_NUMBERED = re.compile(r"^([ \t]*)(\d{1,4}|[a-zA-Z])([.)])[ \t]+(\S.*)$")

BLOCKS = "block_no int, kind string, text string, ordered boolean, marker string, indent int"

Block = tuple[str, str | None, bool | None, str | None, int | None]


def _page(page: str) -> Iterator[Block]:
    """The blocks of one page: a fold over its lines with a paragraph or an item open."""
    kind, held, head, widths = None, [], (), []

    def closed() -> list[Block]:
        text = "\n".join(held)
        if kind == "paragraph" and text.strip():
            return [("paragraph", text, None, None, None)]
        return [("list_item", text, *head)] if kind == "list_item" else []

    for line in map(str.rstrip, page.split("\n")):
        if not line:
            yield from closed()
            kind, held, widths = None, [], []
            continue
        found = _BULLET.match(line)
        mark, ordered = (found[2], False) if found else ("", False)
        if not found and (found := _NUMBERED.match(line)):
            if found[2].isdigit() or kind == "list_item":  # a letter opens an item only in a list
                mark, ordered = found[2] + found[3], True
            else:
                found = None
        if found:
            yield from closed()
            width = len(found[1].replace("\t", "    "))
            while widths and width < widths[-1] + 2:
                widths.pop()
            kind, held, head = "list_item", [found[found.lastindex]], (ordered, mark, len(widths))
            widths.append(width)
        elif kind == "list_item":
            held.append(line.strip())
        else:
            kind = "paragraph"
            held.append(line)
    yield from closed()


def text_blocks(text: str) -> list[Block]:
    """Blocks of a text: form feeds part pages, and a break stands only between blocks."""
    out: list[Block] = []
    for n, page in enumerate(text.replace("\r\n", "\n").replace("\r", "\n").removeprefix("﻿").split("\f")):
        if n and out and out[-1][0] != "page_break":
            out.append(("page_break", None, None, None, None))
        out += _page(page)
    while out and out[-1][0] == "page_break":
        out.pop()
    return out


def read_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, block_no, kind, text, ordered, marker, indent): one row a block; null texts have none.

    Nesting depends on what went before, so a text is one row of an Arrow batch.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, *(part.split(" ")[0] for part in BLOCKS.split(", "))]
    kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string(), pa.int32()]

    def read(batches):
        for batch in batches:
            rows, columns = [], [[] for _ in kinds]
            for i, text in enumerate(batch.column(1).to_pylist()):
                for number, block in enumerate(text_blocks(text or "")):
                    rows.append(i)
                    for column, value in zip(columns, (number, *block)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    bounded_batches(docs.sparkSession)
    return docs.select(id_col, F.col(text_col)).mapInArrow(read, f"{id_col} {kind}, {BLOCKS}")


def as_blocks(blocks: DataFrame) -> DataFrame:
    """Plain blocks as rows of the block table, their text as one plain span."""
    return blocks.withColumn("spans", F.when(F.col("text").isNotNull(), F.array(F.struct("text")))).drop("text")
