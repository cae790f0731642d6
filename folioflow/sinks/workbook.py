"""Blocks as XLSX workbooks: all content on one sheet, each table on one of its own."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from folioflow.blocks import Block, text_of, written

Cell = tuple[str, bool, bool]  # text, bold, wrapped
Sheet = tuple[str, list[list[Cell]]]

# Namespaces and content types of the package format.
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_NUMBER = re.compile(r"-?(\d{1,3}(,\d{3})+|\d+)(\.\d+)?")
_NOT_XML = re.compile("[^\\t\\n\\r\\x20-\\ud7ff\\ue000-\\ufffd\\U00010000-\\U0010ffff]")
NARROWEST, WIDEST = 8, 90


def sheets_of(blocks: Iterable[Block]) -> list[Sheet]:
    """K6: the sheet Content with every block, then Table 1, Table 2 and so on."""
    content: list[list[Cell]] = []
    tables: list[Sheet] = []
    for block in blocks:
        kind, text = block["kind"], text_of(block)
        if kind == "heading":
            content += [[]] if content else []
            content.append([(text, True, False)])
        elif kind in ("paragraph", "quote"):
            content.append([(text, False, True)])
        elif kind == "list_item":
            mark = (block.get("marker") or "1.") if block.get("ordered") else "•"
            content.append([("  " * (block.get("indent") or 0) + f"{mark} {text}", False, True)])
        elif kind == "table":
            head = bool(block.get("has_header"))
            lines = [[(cell or "", head and not n, False) for cell in row or ()] for n, row in enumerate(block.get("rows") or ())]
            content += [[], *lines, []]
            tables.append((f"Table {len(tables) + 1}", lines))
        elif kind == "image" and block.get("caption"):
            content.append([(f"[Image] {block['caption']}", False, False)])
    return [("Content", content), *tables]


def unique_names(names: Iterable[str]) -> list[str]:
    """At most 31 signs, without those that a sheet's name may not hold, numbered where taken whatever the case."""
    taken: dict[str, None] = {}
    out = []
    for name in names:
        base = re.sub(r"[\[\]*?/\\:]", " ", name).strip()[:31] or "Sheet"
        found, n = base, 1
        while found.lower() in taken:
            n += 1
            found = base[: 31 - len(f" ({n})")] + f" ({n})"
        taken[found.lower()] = None
        out.append(found)
    return out


def _letters(column: int) -> str:
    name = ""
    while column >= 0:
        name, column = chr(65 + column % 26) + name, column // 26 - 1
    return name


def _sheet_xml(rows: list[list[Cell]]) -> str:
    widths: dict[int, int] = {}
    lines = []
    for r, row in enumerate(rows, 1):
        cells = []
        for c, (text, bold, wrap) in enumerate(row):
            text = _NOT_XML.sub("", text)
            if not text:
                continue
            widths[c] = max(widths.get(c, NARROWEST), *map(len, text.split("\n")))
            style = bold + 2 * wrap
            head = f'<c r="{_letters(c)}{r}"' + (f' s="{style}"' if style else "")
            if _NUMBER.fullmatch(text.strip()):
                cells.append(f"{head}><v>{text.strip().replace(',', '')}</v></c>")
            else:
                cells.append(f'{head} t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>')
        if row:
            lines.append(f'<row r="{r}">{"".join(cells)}</row>')
    sized = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{min(w, WIDEST) + 2}" customWidth="1"/>' for c, w in sorted(widths.items()))
    columns = f"<cols>{sized}</cols>" if sized else ""
    return f'<worksheet xmlns="{_MAIN}">{columns}<sheetData>{"".join(lines)}</sheetData></worksheet>'


def _styles_xml() -> str:
    """Four looks: bold counts one, wrapped two."""
    fonts = "".join(f'<font>{b}<sz val="11"/><name val="Calibri"/></font>' for b in ("", "<b/>"))
    fills = "".join(f'<fill><patternFill patternType="{p}"/></fill>' for p in ("none", "gray125"))
    looks = []
    for n in range(4):
        wrapped = ' applyAlignment="1"><alignment wrapText="1" vertical="top"/></xf>' if n & 2 else "/>"
        looks.append(f'<xf numFmtId="0" fontId="{n & 1}" fillId="0" borderId="0" xfId="0" applyFont="1"{wrapped}')
    plain = '<xf numFmtId="0" fontId="0" fillId="0" borderId="0"/>'
    border = "<border><left/><right/><top/><bottom/><diagonal/></border>"
    return (
        f'<styleSheet xmlns="{_MAIN}"><fonts count="2">{fonts}</fonts><fills count="2">{fills}</fills><borders count="1">{border}</borders>'
        f'<cellStyleXfs count="1">{plain}</cellStyleXfs><cellXfs count="4">{"".join(looks)}</cellXfs></styleSheet>'
    )


def packed(parts: dict[str, str | bytes]) -> bytes:
    """Parts as a zip file whose bytes depend on nothing else."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for path, body in parts.items():
            data = body if isinstance(body, bytes) else ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n' + body).encode()
            entry = zipfile.ZipInfo(path)
            entry.compress_type = zipfile.ZIP_DEFLATED
            z.writestr(entry, data)
    return out.getvalue()


def relations_xml(relations: Iterable[tuple[str, str]]) -> str:
    """Relations rId1, rId2 and so on of (type, target)."""
    rows = "".join(f'<Relationship Id="rId{n}" Type="{_OFFICE}/{kind}" Target="{escape(target)}"/>' for n, (kind, target) in enumerate(relations, 1))
    return f'<Relationships xmlns="{_PACKAGE}/relationships">{rows}</Relationships>'


def types_xml(overrides: dict[str, str]) -> str:
    defaults = '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
    rows = "".join(f'<Override PartName="{path}" ContentType="{kind}"/>' for path, kind in overrides.items())
    return f'<Types xmlns="{_PACKAGE}/content-types">{defaults}{rows}</Types>'


def workbook(sheets: list[Sheet]) -> bytes:
    """K5: a workbook with inline strings; numbers stand as numbers without their commas."""
    sheets = sheets or [("Sheet1", [])]
    numbered = range(1, len(sheets) + 1)
    names = unique_names(name for name, _ in sheets)
    listed = "".join(f'<sheet name="{escape(_NOT_XML.sub("", name), {chr(34): "&quot;"})}" sheetId="{n}" r:id="rId{n}"/>' for n, name in zip(numbered, names))
    return packed({
        "[Content_Types].xml": types_xml({"/xl/workbook.xml": f"{_TYPE}.sheet.main+xml", "/xl/styles.xml": f"{_TYPE}.styles+xml", **{f"/xl/worksheets/sheet{n}.xml": f"{_TYPE}.worksheet+xml" for n in numbered}}),
        "_rels/.rels": relations_xml([("officeDocument", "xl/workbook.xml")]),
        "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": relations_xml([*(("worksheet", f"worksheets/sheet{n}.xml") for n in numbered), ("styles", "styles.xml")]),
        "xl/styles.xml": _styles_xml(),
        **{f"xl/worksheets/sheet{n}.xml": _sheet_xml(rows) for n, (_, rows) in zip(numbered, sheets)},
    })


def rendered(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content): each document's blocks as one workbook."""
    return written(blocks, id_col, lambda held: workbook(sheets_of(held)), "binary", "content")
