"""Blocks as standalone HTML pages."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable
from html import escape

from pyspark.sql import DataFrame

from folioflow.blocks import Block, Span, merged, text_of, written
from folioflow.functions.text import SCHEMES
from folioflow.sinks.workbook import _NOT_XML

# Media types by the first bytes of an image.
MEDIA = ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"\xff\xd8\xff", "image/jpeg"), (b"GIF8", "image/gif"), (b"BM", "image/bmp"))
ALIGNED = {"center": ' style="text-align:center"', "end": ' style="text-align:right"'}
FONTS = {"serif": "font-family:Georgia,serif", "mono": "font-family:monospace"}
#: Element of each style, innermost first.
ELEMENTS = (("strike", "s"), ("underline", "u"), ("italic", "em"), ("bold", "strong"))
STYLE = """body { margin: 2rem auto; max-width: 44rem; padding: 0 1rem; font: 1rem/1.6 system-ui, sans-serif; overflow-wrap: break-word; }
blockquote { margin-left: 0; padding-left: 1rem; border-left: 3px solid #ccc; }
figure { text-align: center; }
img { max-width: 100%; height: auto; }
.table-wrap { overflow-x: auto; }
table { border-collapse: collapse; }
th, td { border: 1px solid #ccc; padding: 0.3rem 0.6rem; text-align: left; vertical-align: top; }
.page-break { break-after: page; border-top: 1px dashed #ccc; }"""


def escaped(text: str) -> str:
    return escape(_NOT_XML.sub("", text), quote=True).replace("&#x27;", "&#39;")


def broken(text: str) -> str:
    """Escaped text with its line ends and tabs visible."""
    return escaped(text.replace("\r\n", "\n")).replace("\n", "<br>\n").replace("\t", "&emsp;")


def safe_link(link: str | None) -> str | None:
    bare = (link or "").strip()
    scheme = re.match(r"([a-zA-Z][a-zA-Z0-9+.-]*):", bare)
    return bare if bare and (scheme is None or scheme[1].lower() in SCHEMES) else None


def _css(span: Span) -> str:
    rules = [f"color:#{span['color'] & 0xFFFFFF:06x}"] if span.get("color") is not None else []
    rules += [FONTS[span["font_family"]]] if span.get("font_family") in FONTS else []
    ratio = span.get("size_ratio")
    rules += [f"font-size:{int(ratio * 100 + 0.5)}%"] if ratio not in (None, 1.0) else []
    return ";".join(rules)


def inline(spans: Iterable[Span] | None) -> str:
    out = []
    for span in merged(spans):
        text = broken(span["text"])
        if css := _css(span):
            text = f'<span style="{css}">{text}</span>'
        for style, element in ELEMENTS:
            if span.get(style):
                text = f"<{element}>{text}</{element}>"
        if link := safe_link(span.get("link")):
            outside = ' rel="noopener noreferrer"' if link.startswith(("http://", "https://")) else ""
            text = f'<a href="{escaped(link)}"{outside}>{text}</a>'
        out.append(text)
    return "".join(out)


def media_type(data: bytes | None) -> str | None:
    data = data or b""
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "image/webp"
    return next((kind for mark, kind in MEDIA if data.startswith(mark)), None)


def _image(block: Block, number: int) -> str:
    caption, kind = block.get("caption"), media_type(block.get("bytes"))
    if kind is None:
        return f'<p class="caption">{escaped(caption)}</p>' if caption is not None else ""
    width, height = block.get("width") or 0, block.get("height") or 0
    size = f' width="{width}" height="{height}"' if width > 0 and height > 0 else ""
    data = base64.b64encode(block["bytes"]).decode()
    below = f"<figcaption>{escaped(caption)}</figcaption>" if caption else ""
    alt = escaped(f"Image {number}" if caption is None else caption)
    return f'<figure><img src="data:{kind};base64,{data}" alt="{alt}"{size} loading="lazy">{below}</figure>'


def _table(block: Block) -> str:
    rows = block.get("rows") or []
    if not rows:
        return ""

    def line(row: list[str] | None, opening: str, element: str) -> str:
        return "<tr>" + "".join(f"<{opening}>{broken(c or '')}</{element}>" for c in row or ()) + "</tr>"

    heads = 1 if block.get("has_header") else 0
    head = "".join(f"<thead>{line(r, 'th scope=' + chr(34) + 'col' + chr(34), 'th')}</thead>\n" for r in rows[:heads])
    body = "".join(line(r, "td", "td") + "\n" for r in rows[heads:])
    return f'<div class="table-wrap"><table>\n{head}<tbody>\n{body}</tbody></table></div>'


class _Lists:
    """Open lists by depth; the innermost item of each is open too, as deeper lists stand inside it."""

    def __init__(self) -> None:
        self.open: list[str] = []

    def shut(self, depth: int = 0) -> str:
        gone, self.open = self.open[depth:], self.open[:depth]
        return "".join(f"</li>\n</{element}>\n" for element in reversed(gone))

    def item(self, block: Block) -> str:
        element = "ol" if block.get("ordered") else "ul"
        depth = min(max(block.get("indent") or 0, 0), len(self.open))
        same = len(self.open) > depth and self.open[depth] == element
        out = self.shut(depth + 1 if same else depth)
        if same:
            out += "</li>\n"
        else:
            first = re.match(r"\d+", block.get("marker") or "") if element == "ol" else None
            out += f'<ol start="{int(first[0])}">\n' if first and int(first[0]) != 1 else f"<{element}>\n"
            self.open.append(element)
        return f"{out}<li>{inline(block.get('spans'))}"


def body(blocks: Iterable[Block]) -> str:
    out, lists, images = [], _Lists(), 0
    for block in blocks:
        kind, spans = block["kind"], block.get("spans")
        if kind == "list_item":
            out.append(lists.item(block))
            continue
        out.append(lists.shut())
        if kind == "heading":
            level = min(max(block.get("level") or 1, 1), 6)
            shown = f"<h{level}{ALIGNED.get(block.get('align'), '')}>{inline(spans)}</h{level}>"
        elif kind == "quote":
            shown = f"<blockquote><p>{inline(spans)}</p></blockquote>"
        elif kind == "image":
            images += 1
            shown = _image(block, images)
        elif kind == "table":
            shown = _table(block)
        elif kind == "page_break":
            shown = '<div class="page-break" aria-hidden="true"></div>'
        else:
            shown = f"<p{ALIGNED.get(block.get('align'), '')}>{inline(spans)}</p>"
        out.append(shown + "\n")
    return "".join(out) + lists.shut()


def page(blocks: list[Block], title: str | None = None) -> str:
    """K2: a page with its style and images inside; titled by its first heading with text."""
    headings = (text_of(b).strip() for b in blocks if b["kind"] == "heading")
    named = title if title is not None else next(filter(None, headings), "Document")
    head = f'<meta charset="utf-8">\n<meta name="viewport" content="width=device-width, initial-scale=1">\n<title>{escaped(named)}</title>\n<style>\n{STYLE}\n</style>'
    return f"<!DOCTYPE html>\n<html>\n<head>\n{head}\n</head>\n<body>\n<main>\n{body(blocks)}</main>\n</body>\n</html>\n"


def rendered(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, html) of each document."""
    return written(blocks, id_col, page, "string", "html")
