"""Blocks as Markdown with pipe tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame

from folioflow.blocks import Block, Span, merged, written
from folioflow.sinks.workbook import _NOT_XML

PAGE_BREAK = '<div style="page-break-after: always;"></div>'
# Signs that count as punctuation beside emphasis marks.
_PUNCTUATION = re.compile(r"[!-/:-@\[-`{-~\u2000-\u206f\u2e00-\u2e7f]")
_ENTITY = re.compile(r"&(?=(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)")
#: Styles that nest, outermost first: sign where it is seen as emphasis, and elements for where it isn't.
NESTED = ("link", "bold", "italic", "underline")
MARKS = {"bold": ("**", "strong"), "italic": ("*", "em"), "underline": (None, "u")}

Run = tuple[tuple, str]


def escaped(text: str, pipes: bool = False) -> str:
    marked = re.sub(r"([\\`*_\[\]<>~|])" if pipes else r"([\\`*_\[\]<>~])", r"\\\1", _NOT_XML.sub("", text))
    return _ENTITY.sub(r"\\&", marked)


def _line_start(line: str) -> str:
    if line[:1] in ("#", ">", "=", "+", "-", "|") and line:
        return "\\" + line
    return re.sub(r"^(\d{1,9})([.)])", r"\1\\\2", line)


def _destination(link: str) -> str:
    bare = link.strip()
    if not re.search(r"[\s()<>]", bare):
        return bare
    for sign, code in (("<", "%3C"), (">", "%3E"), (" ", "%20"), ("\n", "")):
        bare = bare.replace(sign, code)
    return f"<{bare}>"


def _runs(spans: Iterable[Span] | None) -> list[Run]:
    """(styles, text) in which white space stands alone, in the styles that both neighbours share from the outside in."""
    runs: list[Run] = []
    gap = ""
    for span in merged(spans):
        lead, core, trail = re.fullmatch(r"(\s*)(.*?)(\s*)", span["text"], re.S).groups()
        if not core:
            gap += span["text"]
            continue
        style = tuple(span.get(k) or None for k in NESTED)
        if gap + lead:
            before = runs[-1][0] if runs else (None,) * len(NESTED)
            apart = next((i for i, (a, b) in enumerate(zip(before, style)) if a != b), len(NESTED))
            runs.append((style[:apart] + (None,) * (len(NESTED) - apart), gap + lead))
        runs.append((style, core))
        gap = trail
    return runs


def _tokens(runs: list[Run], level: int = 0) -> Iterator[tuple[bool, str]]:
    """(whether it is text, piece): each style opens and closes once around what it covers without a break."""
    if level == len(NESTED):
        yield from ((True, text) for _, text in runs)
        return
    name = NESTED[level]
    for value, group in groupby(runs, lambda r: r[0][level]):
        held = list(group)
        if not value:
            yield from _tokens(held, level + 1)
            continue
        if name == "link":
            opened, closed = "[", f"]({_destination(value)})"
        else:
            sign, element = MARKS[name]
            inside = "".join(text for _, text in held)
            seen = sign and not _PUNCTUATION.match(inside[0]) and not _PUNCTUATION.match(inside[-1])
            opened, closed = (sign, sign) if seen else (f"<{element}>", f"</{element}>")
        yield False, opened
        yield from _tokens(held, level + 1)
        yield False, closed


def inline(spans: Iterable[Span] | None) -> str:
    """Spans as one text whose line ends are kept by a backslash."""
    out, fresh = [], True
    for is_text, piece in _tokens(_runs(spans)):
        if not is_text:
            out.append(piece)
            fresh = False
            continue
        lines = piece.split("\n")
        for n, line in enumerate(lines):
            line = line.replace("\t", "    ")
            line = line.rstrip() if n + 1 < len(lines) else line
            shown = _line_start(escaped(line.lstrip())) if fresh else escaped(line)
            out.append(shown)
            fresh = fresh and not shown
            if n + 1 < len(lines):
                out.append("\\\n")
                fresh = True
    return "".join(out).rstrip()


def table(block: Block) -> str:
    rows = [r for r in block.get("rows") or () if r]
    if not rows:
        return ""
    width = max(map(len, rows))

    def line(row: list[str | None]) -> str:
        cells = [escaped((c or "").replace("\r\n", "\n").strip(), pipes=True).replace("\n", "<br>") for c in row]
        return "| " + " | ".join(cells + [""] * (width - len(cells))) + " |"

    head = [line(rows.pop(0))] if block.get("has_header") else ["|" + "   |" * width]
    return "\n".join([*head, "|" + " --- |" * width, *map(line, rows)])


def _image(block: Block, number: int) -> str:
    kind = "jpg" if block["bytes"].startswith(b"\xff\xd8\xff") else "png"
    caption = " ".join((block.get("caption") or "").split())
    return f"![{escaped(caption) or f'image {number}'}](image-{number}.{kind})"


def _item(block: Block, depth: int, number: int) -> str:
    mark = f"{number}." if block.get("ordered") else "-"
    margin = "    " * depth
    return f"{margin}{mark} " + inline(block.get("spans")).replace("\n", "\n" + " " * (len(margin) + len(mark) + 1))


def text(blocks: Iterable[Block]) -> str:
    """K3: items are numbered anew in each list; deeper levels start again below a shallower item.

    Images are named in order; those that are neither PNG nor JPEG are left out.
    """
    parts: list[str] = []
    counts: list[tuple[bool, int]] = []  # of each open level: whether ordered, and how many
    images = 0
    for block in blocks:
        kind = block["kind"]
        if kind == "list_item":
            ordered, depth = bool(block.get("ordered")), min(max(block.get("indent") or 0, 0), len(counts))
            same = depth < len(counts) and counts[depth][0] == ordered
            listed = bool(counts)
            counts[depth:] = [(ordered, counts[depth][1] + 1 if same else 1)]
            shown = _item(block, depth, counts[depth][1])
            parts[len(parts) - listed :] = [parts[-1] + "\n" + shown] if listed else [shown]
            continue
        counts = []
        shown = ""
        if kind == "heading":
            flat = [{**s, "text": re.sub(r"[\r\n]+", " ", s.get("text") or "")} for s in block.get("spans") or ()]
            title = inline(flat)
            title = title[:-1] + "\\#" if title.endswith("#") else title
            shown = f"{'#' * min(max(block.get('level') or 1, 1), 6)} {title}" if title.strip() else ""
        elif kind == "quote":
            quoted = inline(block.get("spans"))
            shown = "\n".join(f"> {line}" if line else ">" for line in quoted.split("\n")) if quoted.strip() else ""
        elif kind == "table":
            shown = table(block)
        elif kind == "image":
            if (block.get("bytes") or b"").startswith((b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff")):
                images += 1
                shown = _image(block, images)
        elif kind == "page_break":
            shown = PAGE_BREAK
        else:
            shown = inline(block.get("spans"))
        parts += [shown] if shown.strip() else []
    return "\n\n".join(parts) + "\n" if parts else ""


def rendered(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, markdown) of each document."""
    return written(blocks, id_col, text, "string", "markdown")
