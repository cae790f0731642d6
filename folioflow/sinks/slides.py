"""Pages as PPTX presentations: a slide for each page, its text in boxes that can be edited, over an optional picture.

A page is a group of shapes in coordinates of its own; the group's place on the slide
scales it, so shapes stand where the page has them.
"""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioflow.sinks.workbook import _NOT_XML, _OFFICE, packed, relations_xml, types_xml

# Namespaces, content types and units of the format.
_SPACE = {"a": "http://schemas.openxmlformats.org/drawingml/2006/main", "p": "http://schemas.openxmlformats.org/presentationml/2006/main", "r": _OFFICE}
_TYPE = "application/vnd.openxmlformats-officedocument.presentationml"
_THEME = "application/vnd.openxmlformats-officedocument.theme+xml"
_EMU = 12700
for _prefix, _uri in _SPACE.items():
    ElementTree.register_namespace(_prefix, _uri)

#: Colours of the theme, by its slots, and the names by which a master maps them.
_SLOTS = {"dk1": "111111", "lt1": "FFFFFF", "dk2": "333333", "lt2": "EEEEEE", **{f"accent{n}": f"{n * 0x1F2F3F & 0xFFFFFF:06X}" for n in range(1, 7)}, "hlink": "0000EE", "folHlink": "551A8B"}
_MAPPED = {"bg1": "lt1", "tx1": "dk1", "bg2": "lt2", "tx2": "dk2"} | {k: k for k in _SLOTS if k[:2] not in ("dk", "lt")}
#: Typefaces of headings and text in the theme; serif text takes the first, other text the second.
_FACES = {"major": "Georgia", "minor": "Verdana"}
#: Text sizes that the format allows, in hundredths of a point, and the size of text that has none.
_SIZES, _USUAL_SIZE = (100, 400_000), 12.0

BOX = "struct<l:double,t:double,r:double,b:double,size:double,lines:array<string>,bold:boolean,italic:boolean,serif:boolean,color:bigint>"
Page = dict  # width, height, boxes, picture


def _node(kind: str, /, *children: ElementTree.Element, text: str | None = None, **attributes: object) -> ElementTree.Element:
    """An element ``prefix:name``; attributes of a namespace are spelt ``prefix__name``."""
    tag = lambda n, mark: "{%s}%s" % (_SPACE[n.split(mark)[0]], n.split(mark)[1]) if mark in n else n
    e = ElementTree.Element(tag(kind, ":"), {tag(k, "__"): str(v) for k, v in attributes.items()})
    e.extend(children)
    e.text = text
    return e


def _xml(e: ElementTree.Element) -> str:
    return ElementTree.tostring(e, encoding="unicode")


def _extent(name: str, x: float, y: float, cx: float, cy: float, inner: tuple[float, float] | None = None) -> ElementTree.Element:
    """A place in whole units, for a group with the size of its own coordinates."""
    parts = [_node("a:off", x=round(x), y=round(y)), _node("a:ext", cx=round(cx), cy=round(cy))]
    if inner is not None:
        parts += [_node("a:chOff", x=0, y=0), _node("a:chExt", cx=round(inner[0]), cy=round(inner[1]))]
    return _node(name, *parts)


def _group(name: str, number: int, title: str, place: ElementTree.Element, shapes: list[ElementTree.Element]) -> ElementTree.Element:
    head = _node("p:nvGrpSpPr", _node("p:cNvPr", id=number, name=title), _node("p:cNvGrpSpPr"), _node("p:nvPr"))
    return _node(name, head, _node("p:grpSpPr", place), *shapes)


def _content(*shapes: ElementTree.Element) -> ElementTree.Element:
    return _node("p:cSld", _group("p:spTree", 1, "", _extent("a:xfrm", 0, 0, 0, 0, (0, 0)), [*shapes]))


def _geometry(x: float, y: float, cx: float, cy: float) -> list[ElementTree.Element]:
    return [_extent("a:xfrm", x, y, cx, cy), _node("a:prstGeom", _node("a:avLst"), prst="rect")]


def _text_box(box: dict, number: int, scale: float) -> ElementTree.Element:
    """A box that is as wide as its text needs; its size of type is scaled, as groups scale only places."""
    least, most = _SIZES
    look = _node(
        "a:rPr", _node("a:solidFill", _node("a:srgbClr", val=f"{(box.get('color') or 0) & 0xFFFFFF:06X}")), _node("a:latin", typeface="+mj-lt" if box.get("serif") else "+mn-lt"),
        sz=min(most, max(least, round(100 * scale * (box.get("size") or _USUAL_SIZE)))), b=int(bool(box.get("bold"))), i=int(bool(box.get("italic"))),
    )
    lines = [_node("a:p", _node("a:r", look, _node("a:t", text=_NOT_XML.sub("", line or "")))) for line in box.get("lines") or [""]]
    body = _node("a:bodyPr", _node("a:spAutoFit"), wrap="none", **{side: 0 for side in ("lIns", "tIns", "rIns", "bIns")})
    corners = (box[c] * _EMU for c in "ltrb")
    left, top, right, bottom = corners
    return _node(
        "p:sp",
        _node("p:nvSpPr", _node("p:cNvPr", id=number, name=f"Box {number}"), _node("p:cNvSpPr", txBox=1), _node("p:nvPr")),
        _node("p:spPr", *_geometry(left, top, right - left, bottom - top)),
        _node("p:txBody", body, *lines),
    )


def _picture(page: Page, number: int) -> ElementTree.Element:
    return _node(
        "p:pic",
        _node("p:nvPicPr", _node("p:cNvPr", id=number, name="Background"), _node("p:cNvPicPr"), _node("p:nvPr")),
        _node("p:blipFill", _node("a:blip", r__embed="rId2"), _node("a:stretch", _node("a:fillRect"))),
        _node("p:spPr", *_geometry(0, 0, page["width"] * _EMU, page["height"] * _EMU)),
    )


def _slide(page: Page, wide: float, high: float) -> ElementTree.Element:
    """The page as one group, as large as the slide allows and in its middle."""
    own = page["width"] * _EMU, page["height"] * _EMU
    scale = min(wide / own[0], high / own[1])
    shown = own[0] * scale, own[1] * scale
    shapes = [_picture(page, 3)] if page.get("picture") else []
    shapes += [_text_box(box, n, scale) for n, box in enumerate(page.get("boxes") or (), 4)]
    place = _extent("a:xfrm", (wide - shown[0]) / 2, (high - shown[1]) / 2, *shown, own)
    return _node("p:sld", _content(_group("p:grpSp", 2, "Page", place, shapes)))


def _theme() -> ElementTree.Element:
    colours = [_node(f"a:{slot}", _node("a:srgbClr", val=value)) for slot, value in _SLOTS.items()]
    faces = [_node(f"a:{kind}Font", _node("a:latin", typeface=face), _node("a:ea", typeface=""), _node("a:cs", typeface="")) for kind, face in _FACES.items()]
    fill = lambda: _node("a:solidFill", _node("a:schemeClr", val="phClr"))
    # the format asks for three of each
    looks = {"fillStyleLst": fill, "lnStyleLst": lambda: _node("a:ln", fill()), "effectStyleLst": lambda: _node("a:effectStyle", _node("a:effectLst")), "bgFillStyleLst": fill}
    formats = [_node(f"a:{kind}", *(make() for _ in range(3))) for kind, make in looks.items()]
    parts = _node("a:clrScheme", *colours, name="Pages"), _node("a:fontScheme", *faces, name="Pages"), _node("a:fmtScheme", *formats, name="Pages")
    return _node("a:theme", _node("a:themeElements", *parts), name="Pages")


def presentation(pages: list[Page]) -> bytes:
    """K7: a slide for each page; the first page's size is that of all slides."""
    if not pages:
        raise ValueError("a presentation needs a page")
    wide, high = (round(pages[0][side] * _EMU) for side in ("width", "height"))
    files: dict[str, tuple[str, str | bytes]] = {}  # path to content type and body
    related: dict[str, list[tuple[str, str]]] = {"": [("officeDocument", "ppt/presentation.xml")]}

    def add(path: str, kind: str, body: ElementTree.Element | bytes, relations: list[tuple[str, str]]) -> None:
        files[path] = kind, body if isinstance(body, bytes) else _xml(body)
        related[path] = relations

    master, layout, theme = "ppt/slideMasters/slideMaster1.xml", "ppt/slideLayouts/slideLayout1.xml", "ppt/theme/theme1.xml"
    slides = [f"ppt/slides/slide{n}.xml" for n in range(1, len(pages) + 1)]
    listed = _node("p:sldIdLst", *(_node("p:sldId", id=256 + n, r__id=f"rId{n + 2}") for n in range(len(slides))))
    masters = _node("p:sldMasterIdLst", _node("p:sldMasterId", id=1 << 31, r__id="rId1"))
    sizes = _node("p:sldSz", cx=wide, cy=high), _node("p:notesSz", cx=high, cy=wide)
    inside = lambda path: path.removeprefix("ppt/")
    beside = lambda path: f"../{inside(path)}"
    add("ppt/presentation.xml", f"{_TYPE}.presentation.main+xml", _node("p:presentation", masters, listed, *sizes), [("slideMaster", inside(master)), *(("slide", inside(x)) for x in slides), ("theme", inside(theme))])
    layouts = _node("p:sldLayoutIdLst", _node("p:sldLayoutId", id=(1 << 31) + 1, r__id="rId1"))
    add(master, f"{_TYPE}.slideMaster+xml", _node("p:sldMaster", _content(), _node("p:clrMap", **_MAPPED), layouts), [("slideLayout", beside(layout)), ("theme", beside(theme))])
    add(layout, f"{_TYPE}.slideLayout+xml", _node("p:sldLayout", _content(), type="blank"), [("slideMaster", beside(master))])
    add(theme, _THEME, _theme(), [])
    for n, (path, page) in enumerate(zip(slides, pages), 1):
        relations = [("slideLayout", beside(layout))]
        if page.get("picture"):
            picture = f"ppt/media/page{n}.png"
            add(picture, "image/png", bytes(page["picture"]), [])
            relations.append(("image", beside(picture)))
        add(path, f"{_TYPE}.slide+xml", _slide(page, wide, high), relations)
    parts: dict[str, str | bytes] = {"[Content_Types].xml": types_xml({f"/{path}": kind for path, (kind, _) in files.items()})}
    for path, relations in related.items():
        folder, _, name = path.rpartition("/")
        if relations:
            parts[f"{folder}/_rels/{name}.rels".lstrip("/")] = relations_xml(relations)
    return packed(parts | {path: body for path, (_, body) in files.items()})


def rendered(pages: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, content): each document's pages (id, page, width, height, boxes, picture) in order as one presentation.

    ``boxes`` is an array of ``BOX``; ``picture`` a PNG or null. Pages of no size are
    left out, and documents without others have no row.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    arrow = to_arrow_schema(StructType.fromDDL(f"`{id_col}` {kind}, content binary"))
    held = pages.where("width > 0 and height > 0").select(id_col, F.struct("page", "width", "height", F.col("boxes").cast(f"array<{BOX}>").alias("boxes"), "picture").alias("p"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, found in zip(batch.column(0), batch.column(1)):
                yield pa.RecordBatch.from_pylist([{id_col: key.as_py(), "content": presentation(found.as_py())}], schema=arrow)

    return held.groupBy(id_col).agg(F.array_sort(F.collect_list("p")).alias("pages")).mapInArrow(render, f"`{id_col}` {kind}, content binary")
