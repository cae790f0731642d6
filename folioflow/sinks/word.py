"""Blocks as DOCX documents."""

from __future__ import annotations

from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame

from folioflow.blocks import Block, Span, merged, written
from folioflow.sinks.html import media_type, safe_link
from folioflow.sinks.workbook import _NOT_XML, _OFFICE, _PACKAGE, packed, types_xml

# Namespaces and content types of the format.
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_DRAW = "http://schemas.openxmlformats.org/drawingml/2006"
_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
_ALIGN = {"center": "center", "end": "right", "justify": "both"}
_FONTS = {"serif": "Times New Roman", "mono": "Courier New"}
_PER_PIXEL = 9525
#: Widest image in English metric units: the text width of a page of 8.5 by 11 inches.
_WIDEST = 6 * 914400


def _quoted(text: str) -> str:
    return escape(_NOT_XML.sub("", text), {'"': "&quot;"})


def _run_text(text: str) -> str:
    """Text with its line ends and tabs as elements."""
    lines = []
    for line in _NOT_XML.sub("", text).replace("\r\n", "\n").split("\n"):
        lines.append("<w:tab/>".join(f'<w:t xml:space="preserve">{escape(x)}</w:t>' if x else "" for x in line.split("\t")))
    return "<w:br/>".join(lines)


def _run(span: Span, base_half_points: int) -> str:
    looks = "<w:rStyle w:val=\"Hyperlink\"/>" if span.get("link") else ""
    if face := _FONTS.get(span.get("font_family")):
        looks += f'<w:rFonts w:ascii="{face}" w:hAnsi="{face}" w:cs="{face}"/>'
    looks += "".join(f"<w:{e}/>" for key, e in (("bold", "b"), ("italic", "i"), ("strike", "strike")) if span.get(key))
    if span.get("color") is not None:
        looks += f'<w:color w:val="{span["color"] & 0xFFFFFF:06X}"/>'
    if span.get("size_ratio") not in (None, 1.0):
        looks += f'<w:sz w:val="{max(2, int(base_half_points * span["size_ratio"] + 0.5))}"/>'
    looks += '<w:u w:val="single"/>' if span.get("underline") else ""
    return f"<w:r>{f'<w:rPr>{looks}</w:rPr>' if looks else ''}{_run_text(span['text'])}</w:r>"


class _Writer:
    """The parts of one document: its body, its relations, its images and its lists."""

    def __init__(self) -> None:
        self.body: list[str] = []
        self.relations: list[tuple[str, str, bool]] = [("styles", "styles.xml", False), ("numbering", "numbering.xml", False)]
        self.links: dict[str, str] = {}
        self.media: dict[str, bytes] = {}
        self.starts: list[tuple[bool, dict[int, int]]] = []  # lists: ordered or not, first numbers by level

    def related(self, kind: str, target: str, outside: bool = False) -> str:
        self.relations.append((kind, target, outside))
        return f"rId{len(self.relations)}"

    def spans(self, spans: Iterable[Span] | None, half_points: int = 22) -> str:
        out = []
        for span in merged(spans):
            link = safe_link(span.get("link"))
            run = _run({**span, "link": link}, half_points)
            if link and link.startswith("#"):
                run = f'<w:hyperlink w:anchor="{_quoted(link[1:])}" w:history="1">{run}</w:hyperlink>'
            elif link:
                if link not in self.links:
                    self.links[link] = self.related("hyperlink", link, True)
                run = f'<w:hyperlink r:id="{self.links[link]}" w:history="1">{run}</w:hyperlink>'
            out.append(run)
        return "".join(out)

    def paragraph(self, inside: str, style: str = "", more: str = "") -> None:
        own = (f'<w:pStyle w:val="{style}"/>' if style else "") + more
        self.body.append(f"<w:p>{f'<w:pPr>{own}</w:pPr>' if own else ''}{inside}</w:p>")

    def item(self, block: Block, open_lists: dict[int, tuple[bool, int]]) -> None:
        """A list item; a level's list goes on as long as its kind does and nothing shallower came between."""
        deepest = max(open_lists, default=-1)
        level = min(max(block.get("indent") or 0, 0), deepest + 1, 8)  # no level is skipped
        for deeper in [n for n in open_lists if n > level]:
            del open_lists[deeper]
        ordered = bool(block.get("ordered"))
        if open_lists.get(level, (None, 0))[0] is not ordered:
            digits = "".join(c for c in (block.get("marker") or "") if c.isdecimal() and c.isascii())
            self.starts.append((ordered, {level: int(digits) if ordered and digits and len(digits) < 10 else 1}))
            open_lists[level] = (ordered, len(self.starts))
        number = f'<w:numPr><w:ilvl w:val="{level}"/><w:numId w:val="{open_lists[level][1]}"/></w:numPr>'
        self.paragraph(self.spans(block.get("spans")), "ListParagraph", number)

    def table(self, block: Block) -> None:
        rows = block.get("rows") or []
        width = max((len(r or ()) for r in rows), default=0)
        if not width:
            return
        lines = []
        for n, row in enumerate(rows):
            head = bool(block.get("has_header")) and n == 0
            cells = []
            for text in [*(row or ()), *[""] * (width - len(row or ()))]:
                run = _run({"text": text, "bold": head}, 22) if text else ""
                cells.append(f'<w:tc><w:tcPr><w:tcW w:w="0" w:type="auto"/></w:tcPr><w:p>{run}</w:p></w:tc>')
            lines.append(f"<w:tr>{'<w:trPr><w:tblHeader/></w:trPr>' if head else ''}{''.join(cells)}</w:tr>")
        grid = "".join(f'<w:gridCol w:w="{9360 // width}"/>' for _ in range(width))
        self.body.append(f'<w:tbl><w:tblPr><w:tblStyle w:val="TableGrid"/><w:tblW w:w="0" w:type="auto"/></w:tblPr><w:tblGrid>{grid}</w:tblGrid>{"".join(lines)}</w:tbl><w:p/>')

    def image(self, block: Block) -> None:
        data, caption = block.get("bytes"), block.get("caption")
        kind = media_type(data)
        if kind in ("image/png", "image/jpeg", "image/gif", "image/bmp"):
            number = len(self.media) + 1
            name = f"media/image{number}.{kind.rpartition('/')[2]}"
            self.media[name] = data
            wide, high = (max(1, block.get(k) or 0) * _PER_PIXEL for k in ("width", "height"))
            shrink = min(1.0, _WIDEST / wide)
            cx, cy = int(wide * shrink), max(1, int(high * shrink))
            key = self.related("image", name)
            picture = (
                f'<pic:pic><pic:nvPicPr><pic:cNvPr id="{number}" name="Image {number}"/><pic:cNvPicPr/></pic:nvPicPr>'
                f'<pic:blipFill><a:blip r:embed="{key}"/><a:stretch><a:fillRect/></a:stretch></pic:blipFill>'
                f'<pic:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="rect"><a:avLst/></a:prstGeom></pic:spPr></pic:pic>'
            )
            graphic = f'<a:graphic><a:graphicData uri="{_DRAW}/picture">{picture}</a:graphicData></a:graphic>'
            inline = f'<wp:inline><wp:extent cx="{cx}" cy="{cy}"/><wp:docPr id="{number}" name="Image {number}"/>{graphic}</wp:inline>'
            self.paragraph(f"<w:r><w:drawing>{inline}</w:drawing></w:r>", more='<w:jc w:val="center"/>')
        if caption:
            self.paragraph(self.spans([{"text": caption}]), "Caption")

    def write(self, blocks: Iterable[Block]) -> None:
        open_lists: dict[int, tuple[bool, int]] = {}
        for block in blocks:
            kind = block["kind"]
            if kind == "list_item":
                self.item(block, open_lists)
                continue
            open_lists.clear()
            align = f'<w:jc w:val="{_ALIGN[block["align"]]}"/>' if block.get("align") in _ALIGN else ""
            if kind == "heading":
                level = min(max(block.get("level") or 1, 1), 6)
                self.paragraph(self.spans(block.get("spans"), _heading_size(level)), f"Heading{level}", align)
            elif kind == "table":
                self.table(block)
            elif kind == "image":
                self.image(block)
            elif kind == "page_break":
                self.paragraph('<w:r><w:br w:type="page"/></w:r>')
            else:
                self.paragraph(self.spans(block.get("spans")), "Quote" if kind == "quote" else "", align)

    def relations_xml(self) -> str:
        rows = []
        for n, (kind, target, outside) in enumerate(self.relations, 1):
            rows.append(f'<Relationship Id="rId{n}" Type="{_OFFICE}/{kind}" Target="{_quoted(target)}"{" TargetMode=" + chr(34) + "External" + chr(34) if outside else ""}/>')
        return f'<Relationships xmlns="{_PACKAGE}/relationships">{"".join(rows)}</Relationships>'

    def numbering_xml(self) -> str:
        """Two families, bullets and numbers by level, and each list of the document with its first numbers."""
        families = []
        for key, kinds in ((0, ("bullet",)), (1, ("decimal", "lowerLetter", "lowerRoman"))):
            levels = []
            for n in range(9):
                text = "•◦▪"[n % 3] if key == 0 else f"%{n + 1}."
                levels.append(f'<w:lvl w:ilvl="{n}"><w:start w:val="1"/><w:numFmt w:val="{kinds[n % len(kinds)]}"/><w:lvlText w:val="{text}"/><w:lvlJc w:val="left"/><w:pPr><w:ind w:left="{720 * (n + 1)}" w:hanging="360"/></w:pPr></w:lvl>')
            families.append(f'<w:abstractNum w:abstractNumId="{key}"><w:multiLevelType w:val="hybridMultilevel"/>{"".join(levels)}</w:abstractNum>')
        lists = []
        for number, (ordered, firsts) in enumerate(self.starts, 1):
            changes = "".join(f'<w:lvlOverride w:ilvl="{level}"><w:startOverride w:val="{first}"/></w:lvlOverride>' for level, first in firsts.items() if ordered)
            lists.append(f'<w:num w:numId="{number}"><w:abstractNumId w:val="{int(ordered)}"/>{changes}</w:num>')
        return f'<w:numbering xmlns:w="{_W}">{"".join(families)}{"".join(lists)}</w:numbering>'


def _heading_size(level: int) -> int:
    return (40, 32, 28, 26, 24, 22)[level - 1]


def _styles_xml() -> str:
    def style(key: str, name: str, inside: str, kind: str = "paragraph", based: str = "Normal", standard: bool = False) -> str:
        base = "" if standard else f'<w:basedOn w:val="{based}"/>' if based else ""
        return f'<w:style w:type="{kind}"{" w:default=" + chr(34) + "1" + chr(34) if standard else ""} w:styleId="{key}"><w:name w:val="{name}"/>{base}{inside}</w:style>'

    edges = "".join(f'<w:{side} w:val="single" w:sz="4" w:space="0" w:color="BFBFBF"/>' for side in ("top", "left", "bottom", "right", "insideH", "insideV"))
    styles = [style("Normal", "Normal", '<w:pPr><w:spacing w:after="160"/></w:pPr><w:rPr><w:sz w:val="22"/></w:rPr>', standard=True)]
    for n in range(1, 7):
        styles.append(style(f"Heading{n}", f"heading {n}", f'<w:pPr><w:keepNext/><w:outlineLvl w:val="{n - 1}"/></w:pPr><w:rPr><w:b/><w:sz w:val="{_heading_size(n)}"/></w:rPr>'))
    styles += [
        style("ListParagraph", "List Paragraph", '<w:pPr><w:contextualSpacing/></w:pPr>'),
        style("Quote", "Quote", '<w:pPr><w:ind w:left="720" w:right="720"/></w:pPr>'),
        style("Caption", "caption", '<w:pPr><w:jc w:val="center"/></w:pPr><w:rPr><w:sz w:val="18"/></w:rPr>'),
        style("Hyperlink", "Hyperlink", '<w:rPr><w:color w:val="0563C1"/><w:u w:val="single"/></w:rPr>', "character", ""),
        style("TableGrid", "Table Grid", f"<w:tblPr><w:tblBorders>{edges}</w:tblBorders></w:tblPr>", "table", ""),
    ]
    return f'<w:styles xmlns:w="{_W}">{"".join(styles)}</w:styles>'


def document(blocks: Iterable[Block]) -> bytes:
    """K4: a document with headings, lists, tables and images as Word knows them."""
    out = _Writer()
    out.write(blocks)
    spaces = f'xmlns:w="{_W}" xmlns:r="{_OFFICE}" xmlns:wp="{_DRAW}/wordprocessingDrawing" xmlns:a="{_DRAW}/main" xmlns:pic="{_DRAW}/picture"'
    page = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440" w:header="720" w:footer="720" w:gutter="0"/></w:sectPr>'
    types = {"/word/document.xml": f"{_TYPE}.document.main+xml", "/word/styles.xml": f"{_TYPE}.styles+xml", "/word/numbering.xml": f"{_TYPE}.numbering+xml"}
    types |= {f"/word/{name}": f"image/{name.rpartition('.')[2]}" for name in out.media}
    main = f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>'
    return packed({
        "[Content_Types].xml": types_xml(types),
        "_rels/.rels": main,
        "word/document.xml": f"<w:document {spaces}><w:body>{''.join(out.body)}{page}</w:body></w:document>",
        "word/_rels/document.xml.rels": out.relations_xml(),
        "word/styles.xml": _styles_xml(),
        "word/numbering.xml": out.numbering_xml(),
        **{f"word/{name}": data for name, data in out.media.items()},
    })


def rendered(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content): each document's blocks as one DOCX file."""
    return written(blocks, id_col, document, "binary", "content")
