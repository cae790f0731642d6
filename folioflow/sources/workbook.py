"""XLSX workbooks as blocks: a heading and a table for each sheet, cells as they are shown."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache, partial
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from folioflow.blocks import Block, parsed

# Number formats that a workbook names by id alone.
FORMATS = {
    0: "General", 1: "0", 2: "0.00", 3: "#,##0", 4: "#,##0.00", 9: "0%", 10: "0.00%", 11: "0.00E+00", 12: "# ?/?", 13: "# ??/??",
    14: "yyyy-mm-dd", 15: "d-mmm-yy", 16: "d-mmm", 17: "mmm-yy", 18: "h:mm AM/PM", 19: "h:mm:ss AM/PM", 20: "h:mm", 21: "h:mm:ss", 22: "yyyy-mm-dd h:mm",
    37: "#,##0 ;(#,##0)", 38: "#,##0 ;[Red](#,##0)", 39: "#,##0.00;(#,##0.00)", 40: "#,##0.00;[Red](#,##0.00)",
    45: "mm:ss", 46: "[h]:mm:ss", 47: "mmss.0", 48: "##0.0E+0", 49: "@",
}
# Ids of formats that show dates or times, whatever their code.
DATE_IDS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))
LAST_SERIAL = 2958465
MAX_CELLS = 2_000_000

_NUMBER = re.compile(r"[+-]?(?:\d*\.)?\d+(?:[eE][+-]?\d+)?")
_REFERENCE = re.compile(r"\$?([A-Za-z]{1,3})\$?(\d+)")
#: Quoted words, escaped signs, colours and locales, and padding say nothing about the kind of a number.
_DECORATION = re.compile(r'"[^"]*"|\\.|\[(?![hms]+\])[^\]]*\]|[_*].')


def column_number(letters: str) -> int:
    n = 0
    for sign in letters.upper():
        n = 26 * n + ord(sign) - 64
    return n - 1


def _fixed(v: float, decimals: int, commas: bool = False) -> str:
    """Rounded by the number's exact value, halves away from zero."""
    rounded = Decimal(v).quantize(Decimal(1).scaleb(-decimals), ROUND_HALF_UP)
    return f"{rounded:{',' if commas else ''}.{decimals}f}"


def _general(v: float) -> str:
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    near = float(f"{v:.15g}")
    if 1e-6 <= abs(near) < 1e21:
        plain = f"{Decimal(repr(near)):f}"
        return plain if "." in plain else plain + ".0"
    return re.sub(r"e([+-])0*", r"e\1", repr(near))


def _moment(v: float, code: str, from_1904: bool) -> str | None:
    if not 0 <= v <= LAST_SERIAL:
        return None
    start = datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 31 if v < 61 else 30)  # there was no 29 February 1900
    at, signs = start + timedelta(milliseconds=int(v * 86_400_000 + 0.5)), set(code.lower())
    timed = bool(signs & {"h", "s"})
    shown = [f"{at:%Y-%m-%d}".zfill(10)] if signs & {"d", "y"} or ("m" in signs and "h" not in signs) else []
    shown += [f"{at:%H:%M:%S}" if "s" in signs else f"{at:%H:%M}"] if timed else []
    return " ".join(shown) or f"{at:%Y-%m-%d}".zfill(10)


def shown_number(v: float, format_id: int = 0, custom: dict[int, str] | None = None, from_1904: bool = False) -> str:
    """A number as its format shows it: dates in ISO form, percent, fixed decimals, else general."""
    custom = custom or {}
    code = _DECORATION.sub("", (custom.get(format_id) or FORMATS.get(format_id, "General")).split(";")[0]).strip()
    named = format_id >= 164 or format_id in custom
    if format_id in DATE_IDS or (named and code.lower() != "general" and re.search("[dmyhs]", code, re.I)):
        if (moment := _moment(v, code, from_1904)) is not None:
            return moment
    zeros = re.search(r"\.(0+)", code)
    if "%" in code:
        return _fixed(v * 100, len(zeros[1]) if zeros else 0) + "%"
    digits = re.fullmatch(r"[#,0]*0(?:\.(0+))?", re.sub("[^#,0.]", "", code))
    if digits and "E" not in code.upper():
        return _fixed(v, len(digits[1] or ""), "," in code)
    return _general(v)


def _local(element: ElementTree.Element) -> str:
    return element.tag.rpartition("}")[2]


def _attribute(element: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2] == name), None)


def _plain(element: ElementTree.Element) -> str:
    """Text of all ``t`` below, but for pronunciations."""
    parts = []
    for child in element:
        if _local(child) == "t":
            parts.append(child.text or "")
        elif _local(child) != "rPh":
            parts.append(_plain(child))
    return "".join(parts)


#: Parts up to this size that many files share are read once and kept, the latest few of them.
SHARED, KEPT = 1 << 18, 16


@lru_cache(KEPT)
def _relations(data: bytes) -> tuple[tuple[str, str, str], ...]:
    return tuple((r.get("Id", ""), r.get("Type", "").rpartition("/")[2], r.get("Target", "")) for r in ElementTree.fromstring(data))


class _Package:
    """Parts of an Office file by path, whatever its case, and the relations between them."""

    def __init__(self, data: bytes):
        try:
            self._zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as error:
            raise ValueError(f"not an Office package: {error}") from error
        self._names = {i.filename.replace("\\", "/").lower(): i for i in self._zip.infolist() if not i.is_dir()}

    def part(self, path: str) -> bytes | None:
        found = self._names.get(path.lower())
        if found is None:
            return None
        try:
            return self._zip.read(found)
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError) as error:
            raise ValueError(f"broken part {path}: {error}") from error

    def root(self, path: str) -> ElementTree.Element | None:
        data = self.part(path)
        try:
            return None if data is None else ElementTree.fromstring(data)
        except ElementTree.ParseError as error:
            raise ValueError(f"broken part {path}: {error}") from error

    def relations(self, path: str) -> dict[str, tuple[str, str]]:
        """Id to (last word of the type, path of the target) of what ``path`` refers to."""
        folder, name = posixpath.split(path)
        data = self.part(at := posixpath.join(folder, "_rels", name + ".rels"))
        try:
            found = () if data is None else (_relations if len(data) <= SHARED else _relations.__wrapped__)(data)
        except ElementTree.ParseError as error:
            raise ValueError(f"broken part {at}: {error}") from error
        out = {}
        for key, kind, target in found:
            resolved = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join(folder, target))
            out[key] = (kind, resolved)
        return out


class _Book:
    def __init__(self, package: _Package):
        self.package = package
        self.path = next((t for kind, t in package.relations("").values() if kind == "officeDocument"), "xl/workbook.xml")
        root = package.root(self.path)
        if root is None:
            raise ValueError("the package has no workbook")
        self.root, self.relations = root, package.relations(self.path)
        targets = dict(self.relations.values())
        strings = package.root(targets["sharedStrings"]) if "sharedStrings" in targets else None
        self.shared = [_plain(e) for e in strings if _local(e) == "si"] if strings is not None else []
        self.custom, self.formats = self._styles(package.root(targets["styles"]) if "styles" in targets else None)
        self.from_1904 = any(_local(e) == "workbookPr" and _attribute(e, "date1904") in ("1", "true") for e in root.iter())

    @staticmethod
    def _styles(root: ElementTree.Element | None) -> tuple[dict[int, str], list[int]]:
        custom, used = {}, []
        for element in root.iter() if root is not None else ():
            if _local(element) == "numFmt" and (element.get("numFmtId") or "").isdigit() and element.get("formatCode") is not None:
                custom[int(element.get("numFmtId"))] = element.get("formatCode")
            elif _local(element) == "cellXfs":
                used = [int(n) if (n := x.get("numFmtId") or "").isdigit() else 0 for x in element if _local(x) == "xf"]
        return custom, used

    def sheets(self) -> Iterator[tuple[str, bytes]]:
        count = 0
        for sheet in (e for e in self.root.iter() if _local(e) == "sheet" and _attribute(e, "state") != "veryHidden"):
            relation = self.relations.get(_attribute(sheet, "id") or "")
            path = relation[1] if relation else posixpath.join(posixpath.dirname(self.path), f"worksheets/sheet{count + 1}.xml")
            data = self.package.part(path) if relation is None or relation[0] == "worksheet" else None
            if data is not None:
                yield _attribute(sheet, "name") or f"Sheet{count + 1}", data
                count += 1

    def _shown(self, cell: ElementTree.Element) -> str:
        kind, raw, inline = cell.get("t"), "", None
        for child in cell:
            if _local(child) == "v":
                raw = child.text or ""
            elif _local(child) == "is":
                inline = _plain(child)
        raw = raw if inline is None else inline
        bare = raw.strip()
        if kind == "s":
            return self.shared[int(bare)] if bare.isdigit() and int(bare) < len(self.shared) else ""
        if kind in ("inlineStr", "str", "e") or inline:
            return raw
        if kind == "b":
            return "TRUE" if bare == "1" or bare.lower() == "true" else "FALSE" if bare else ""
        if kind == "d" or not _NUMBER.fullmatch(bare):
            return bare
        style = cell.get("s") or ""
        format_id = self.formats[int(style)] if style.isdigit() and int(style) < len(self.formats) else 0
        return shown_number(float(bare), format_id, self.custom, self.from_1904)

    def cells(self, data: bytes) -> Iterator[tuple[int, int, str]]:
        """(row, column, value) of what is not empty, read as a stream; cells without a reference follow the one before."""
        row = column = -1
        try:
            for event, element in ElementTree.iterparse(io.BytesIO(data), ("start", "end")):
                name = _local(element)
                if event == "start" and name == "row":
                    number = element.get("r") or ""
                    row, column = int(number) - 1 if number.isdigit() else row + 1, -1
                elif event == "end" and name == "c":
                    at = _REFERENCE.fullmatch(element.get("r") or "")
                    place, column = (int(at[2]) - 1, column_number(at[1])) if at else (max(row, 0), column + 1)
                    if value := self._shown(element):
                        yield place, column, value
                elif event == "end" and name == "row":
                    element.clear()
        except ElementTree.ParseError as error:
            raise ValueError(f"broken sheet: {error}") from error


def _is_label(text: str) -> bool:
    return not _NUMBER.fullmatch(text.replace(",", "").replace("%", "").strip())


def grid(cells: Iterator[tuple[int, int, str]], max_cells: int = MAX_CELLS) -> tuple[list[list[str]], bool]:
    """Cells as a full rectangle and whether its first row labels at least half of the columns.

    A sheet of more than ``max_cells`` keeps its first rows, as a table is one value.
    """
    held: dict[int, dict[int, str]] = {}
    for r, c, value in cells:
        held.setdefault(r, {})[c] = value
    if not held:
        return [], False
    width = 1 + max(max(row) for row in held.values())
    height = max(held) + 1
    if height * width > max_cells:
        height = max(1, max_cells // width)
    height = 1 + max((r for r in held if r < height), default=-1)
    rows = [[held.get(r, {}).get(c, "") for c in range(width)] for r in range(height)]
    labels = [c for c in rows[0] if c.strip()] if rows else []
    return rows, len(rows) > 1 and 2 * len(labels) >= width and all(map(_is_label, labels))


def workbook_blocks(data: bytes, max_cells: int = MAX_CELLS) -> Iterator[Block]:
    """A heading of level 1 with the sheet's name, then its table unless empty."""
    book = _Book(_Package(data))
    for name, sheet in book.sheets():
        yield {"kind": "heading", "level": 1, "spans": [{"text": name}]}
        rows, has_header = grid(book.cells(sheet), max_cells)
        if rows:
            yield {"kind": "table", "rows": rows, "has_header": has_header}


def read_blocks(files: DataFrame, id_col: str = "path", content_col: str = "content", mode: str = "FAILFAST", max_cells: int = MAX_CELLS) -> DataFrame:
    """Blocks of workbooks, such as ``spark.read.format("binaryFile")`` gives; a file is one row, a sheet has at most ``max_cells``."""
    return parsed(files, id_col, content_col, partial(workbook_blocks, max_cells=max_cells), mode)
