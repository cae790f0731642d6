"""Blocks as a cache of one binary value a document."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

from folioflow import blocks as b
from folioflow.sources.block_cache import ALIGNS, FLAGS, KEYS, KINDS, REST

_CODES = {kind: code for code, kind in KINDS.items()}
#: What stands for a field that a block lacks.
_DEFAULTS = {"level": 1, "spans": [], "ordered": False, "indent": 0, "rows": [], "has_header": False, "width": 0, "height": 0}


def _span(span: b.Span) -> list:
    bits = sum(1 << n for n, flag in enumerate(FLAGS) if span.get(flag))
    link, color, family, ratio = (span.get(name) for name in REST)
    return [span.get("text") or "", bits, link, color, family, 1.0 if ratio is None else ratio]


def encoded(blocks: list[b.Block]) -> bytes:
    """A document's blocks; its title is the first heading of level 1, else the first of all."""
    told, images = [], bytearray()
    for block in blocks:
        kind = block["kind"]
        values = {key: block.get(name, _DEFAULTS.get(name)) for key, name in KEYS[kind].items()}
        if "s" in values:
            values["s"] = [_span(s) for s in values["s"]]
        if "a" in values:
            values["a"] = ALIGNS.index(values["a"]) if values["a"] in ALIGNS else 0
        if kind == "image":
            content = block.get("bytes") or b""
            values |= {"o": len(images), "n": len(content)}
            images += content
        told.append({"p": block.get("page"), "t": _CODES[kind], **values})
    heads = sorted((x for x in blocks if x["kind"] == "heading"), key=lambda x: x.get("level") != 1)
    body = json.dumps({"title": b.text_of(heads[0]) if heads else None, "blocks": told}, ensure_ascii=False).encode()
    return len(body).to_bytes(4, "big") + body + bytes(images)


def rendered(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content) with each document's blocks in a cache."""
    return b.written(blocks, id_col, encoded, "binary", "content")
