"""Cached blocks: four bytes of length, JSON of that length, then the bytes of all images.

The format's names stand here; ``sinks.block_cache`` writes by the same tables.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame

from folioflow import blocks as b

# Fixed values of the format: kinds of blocks, their fields by key, alignments and flags of spans by bit.
KINDS = {"h": "heading", "p": "paragraph", "li": "list_item", "q": "quote", "tb": "table", "br": "page_break", "img": "image"}
KEYS = {
    "heading": {"l": "level", "s": "spans", "a": "align"}, "paragraph": {"s": "spans", "a": "align"}, "quote": {"s": "spans"}, "page_break": {},
    "list_item": {"s": "spans", "o": "ordered", "m": "marker", "i": "indent"}, "table": {"r": "rows", "hh": "has_header"}, "image": {"w": "width", "h": "height", "c": "caption"},
}
ALIGNS = ("start", "center", "end")
FLAGS = ("bold", "italic", "underline", "strike")
REST = ("link", "color", "font_family", "size_ratio")


def decoded(content: bytes) -> Iterator[b.Block]:
    """The blocks of a cache; ValueError where it is cut short or no such format."""
    start = 4 + int.from_bytes(content[:4], "big")
    if len(content) < max(start, 4):
        raise ValueError("the cache is cut short")
    held = json.loads(content[4:start])
    try:
        yield from [_block(x, content, start) for x in held["blocks"]]
    except (KeyError, TypeError, IndexError) as fault:
        raise ValueError(f"no such block: {fault}") from fault


def _block(told: dict, content: bytes, start: int) -> b.Block:
    kind = KINDS[told["t"]]
    block = {"kind": kind, "page": told.get("p"), **{name: told[key] for key, name in KEYS[kind].items()}}
    if "spans" in block:
        block["spans"] = [{"text": text, **{f: bool(bits >> n & 1) for n, f in enumerate(FLAGS)}, **dict(zip(REST, rest))} for text, bits, *rest in block["spans"]]
    if "align" in block:
        block["align"] = ALIGNS[block["align"]]
    if kind == "image":
        first, size = start + told["o"], told["n"]
        if min(told["o"], size) < 0 or first + size > len(content):
            raise ValueError("an image is cut short")
        block["bytes"] = content[first : first + size]
    return block


def read_blocks(files: DataFrame, id_col: str = "doc_id", content_col: str = "content", mode: str = "FAILFAST") -> DataFrame:
    """(id, block columns) of cached documents; null contents have no blocks, broken ones are as ``mode`` says."""
    return b.parsed(files, id_col, content_col, decoded, mode)
