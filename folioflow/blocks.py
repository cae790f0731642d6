"""The block table that readers fill and writers empty: one row a heading, paragraph, list item, table, quote, image or page break.

Python functions see a block as a dict of the fields that are not null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioflow.session import bounded_batches

Block = dict
Span = dict

STYLE = ("bold", "italic", "underline", "strike", "link", "color", "font_family", "size_ratio")
SPAN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,strike:boolean,link:string,color:bigint,font_family:string,size_ratio:double>"
FIELDS = (
    f"block_no int, kind string, page int, level int, align string, ordered boolean, marker string, indent int, spans array<{SPAN}>, "
    "rows array<array<string>>, has_header boolean, bytes binary, width int, height int, caption string"
)
#: Rows that a reader hands over at once.
CHUNK = 2048
#: Signs or bytes of files that a writer hands over at once, if it has several.
WRITTEN = 1 << 20


def style_of(span: Span) -> tuple:
    """What makes two spans look alike; fields that are missing count as plain."""
    return tuple(span.get(k) or None if k != "size_ratio" else (1.0 if span.get(k) is None else span[k]) for k in STYLE)


def merged(spans: Iterable[Span] | None) -> list[Span]:
    """Adjacent spans of one style as one; empty ones leave no trace."""
    kept = (s for s in spans or () if s.get("text"))
    return [{**(run := list(group))[0], "text": "".join(s["text"] for s in run)} for _, group in groupby(kept, style_of)]


def text_of(block: Block) -> str:
    return "".join(s.get("text") or "" for s in block.get("spans") or ())


def parsed(frame: DataFrame, id_col: str, content_col: str, parse: Callable[..., Iterable[Block]], mode: str = "FAILFAST") -> DataFrame:
    """(id, block columns) of each row's content; null contents have no blocks.

    ``parse`` raises ValueError for what it can't read: with FAILFAST that ends the
    job, with DROPMALFORMED the row has no blocks, as in Spark's own readers.
    """
    kind = frame.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {kind}, {FIELDS}"
    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[dict] = []
        for batch in batches:
            for key, content in zip(batch.column(0), batch.column(1)):
                if not content.is_valid:
                    continue
                try:
                    found = list(parse(content.as_py()))
                except ValueError:
                    if mode != "DROPMALFORMED":
                        raise
                    continue
                for number, block in enumerate(found):
                    rows.append({id_col: key.as_py(), "block_no": number, **block})
                    if len(rows) >= CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    bounded_batches(frame.sparkSession)
    return frame.select(id_col, F.col(content_col)).mapInArrow(read, fields)


def written(blocks: DataFrame, id_col: str, write: Callable[[list[Block]], str | bytes], kind: str, name: str) -> DataFrame:
    """(id, name) with each document's blocks, in order, through ``write``; ``kind`` is string or binary.

    Only a document's own blocks meet in a row, as its file must hold them all.
    Columns of the block table that ``blocks`` lacks are null, others are left out.
    """
    known = [part.name for part in StructType.fromDDL(FIELDS).fields if part.name in blocks.columns]
    id_kind = blocks.schema[id_col].dataType.simpleString()
    fields = f"`{id_col}` {id_kind}, `{name}` {kind}"
    arrow = to_arrow_schema(StructType.fromDDL(fields))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for key, held in zip(batch.column(0), batch.column(1)):
                ordered = [{k: v for k, v in b.items() if v is not None} for b in held.as_py()]
                rows.append({id_col: key.as_py(), name: write(ordered)})
                size += len(rows[-1][name])
                if size >= WRITTEN:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    bounded_batches(blocks.sparkSession)
    grouped = blocks.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct(*known))).alias("_blocks"))
    return grouped.mapInArrow(render, fields)
