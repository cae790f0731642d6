"""Markdown with pipe tables as blocks."""

from __future__ import annotations

import base64
import binascii
import html
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from folioflow.blocks import Block, Span, merged, parsed

# What opens a block.
_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*))?$")
_UNDERLINE = re.compile(r" {0,3}(=+|-+)[ \t]*$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})([^`]*)$")
_ITEM = re.compile(r"( *)([-*+]|\d{1,9}[.)])( +|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_BREAK = re.compile(r"\s*(?:\\pagebreak|\\newpage|<div\s+style=[\"'][^\"']*page-break-(?:after|before):\s*always[^\"']*[\"']\s*>\s*</div>)\s*$", re.I)
_REFERENCE = re.compile(r" {0,3}\[([^\]]+)\]:\s*<?([^\s>]+)>?(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*$")
_COLUMN = re.compile(r"\s*:?-+:?\s*")
# Elements that set a style, and those that are line ends.
STYLED = {"b": "bold", "strong": "bold", "i": "italic", "em": "italic", "u": "underline", "ins": "underline", "s": "strike", "del": "strike", "strike": "strike"}
_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9-]*)(?:\s[^<>]*)?/?>")
_AUTOLINK = re.compile(r"<([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>")
_BARE = re.compile(r"(?:https?://|www\.)[^\s<]+")
_TARGET = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^)]*\)))?\s*\)")
_ENTITY = re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_PLAIN = re.compile(r"[^\\`<&!\[\]hw*_~]+")
_TICKS = re.compile("`+")
_RUNS = {sign: re.compile(re.escape(sign) + "+") for sign in "*_~"}
_NAMED = re.compile(r"\[([^\[\]]*)\]")
#: The most signs of a label that names a reference.
LONGEST_LABEL = 999
#: Quotes in quotes beyond so many are text.
DEEPEST_QUOTE = 100
_DATA = re.compile(r"data:image/[\w.+-]+;base64,(.*)", re.S)


@dataclass
class _Node:
    """A stretch of text with its styles, or marks that may still open or close emphasis."""

    text: str
    style: dict = field(default_factory=dict)
    mark: str = ""
    opens: bool = False
    closes: bool = False
    size: int = 0  # of the marks as they stood


def _punctuation(sign: str) -> bool:
    return unicodedata.category(sign)[0] in "PS"


def _marks(text: str, start: int, end: int) -> _Node:
    before, after, sign = text[start - 1 : start] or " ", text[end : end + 1] or " ", text[start]
    left = not after.isspace() and (not _punctuation(after) or before.isspace() or _punctuation(before))
    right = not before.isspace() and (not _punctuation(before) or after.isspace() or _punctuation(after))
    if sign == "_":
        return _Node(text[start:end], mark=sign, opens=left and (not right or _punctuation(before)), closes=right and (not left or _punctuation(after)), size=end - start)
    return _Node(text[start:end], mark=sign, opens=left, closes=right, size=end - start)


def _emphasised(nodes: list[_Node]) -> list[_Node]:
    """Each closing mark takes the nearest opening one; what is left over is text.

    Open marks wait on a stack for each sign. A match ends all that opened inside it, and where a
    closing mark of some kind found nothing, no other of that kind looks further back
    again, so the time grows with the marks. Styles are worked out at the end from where they begin and end.
    """
    waiting: dict[str, list[int]] = {"*": [], "_": [], "~": []}
    bottoms: dict[tuple, int] = {}
    starts: list[list[str]] = [[] for _ in nodes]  # styles that begin behind a node
    ends: list[list[str]] = [[] for _ in nodes]  # and that end before it
    for at, closer in enumerate(nodes):
        while closer.mark and closer.closes and closer.text:
            stack, kind = waiting[closer.mark], (closer.mark, closer.opens, closer.size % 3 if closer.mark != "~" else closer.size)
            n = len(stack) - 1
            while n >= 0 and stack[n] > bottoms.get(kind, -1) and not _meets(nodes[stack[n]], closer):
                n -= 1
            if n < 0 or stack[n] <= bottoms.get(kind, -1):
                bottoms[kind] = at - 1
                break
            found = stack[n]
            for other in waiting.values():
                while other and other[-1] > found:
                    other.pop()
            opener = nodes[found]
            size = 2 if min(len(opener.text), len(closer.text)) >= 2 else 1
            name = "strike" if closer.mark == "~" else "bold" if size == 2 else "italic"
            starts[found].append(name)
            ends[at].append(name)
            opener.text, closer.text = opener.text[size:], closer.text[size:]
            if not opener.text:
                stack.pop()
        if closer.mark and closer.opens and closer.text:
            waiting[closer.mark].append(at)
    on = {"bold": 0, "italic": 0, "strike": 0}
    out = []
    for node, begun, ended in zip(nodes, starts, ends):
        for name in ended:
            on[name] -= 1
        if node.text:
            out.append(_Node(node.text, {**node.style, **{name: True for name, n in on.items() if n}}))
        for name in begun:
            on[name] += 1
    return out


def _meets(opener: _Node, closer: _Node) -> bool:
    """Whether two marks of one sign make a pair: a mark that may do both meets none with which it adds up to a multiple of three."""
    both = (opener.closes or closer.opens) and (opener.size + closer.size) % 3 == 0 and opener.size % 3
    return not both and (closer.mark != "~" or opener.size == closer.size)


class _Index:
    """Where each bracket of a text closes, and where runs of backticks stand; found in one pass."""

    def __init__(self, text: str):
        self.text = text
        self.ticks: dict[int, list[int]] = {}
        for run in _TICKS.finditer(text):
            self.ticks.setdefault(run.end() - run.start(), []).append(run.start())
        self.comments = text.rfind("-->")
        self.closes: dict[int, int] = {}
        if "[" in text:
            self._match()

    def code(self, at: int) -> tuple[int, int]:
        """The length of the run of backticks at ``at`` and where its code span's closing run stands, or -1."""
        size = _TICKS.match(self.text, at).end() - at
        places = self.ticks.get(size, [])
        n = bisect_left(places, at + size)
        return size, places[n] if n < len(places) else -1

    def markup(self, at: int) -> int:
        """The end of the link in angle brackets, element or comment that begins at ``at``, or -1."""
        if found := _AUTOLINK.match(self.text, at) or _TAG.match(self.text, at):
            return found.end()
        if self.text.startswith("<!--", at) and at + 4 <= self.comments:
            return self.text.find("-->", at + 4) + 3
        return -1

    def _match(self) -> None:
        text, at, open_ = self.text, 0, []
        for stop in re.finditer(r"[\\`<\[\]]", text):
            if stop.start() < at:
                continue
            at, sign = stop.start(), stop[0]
            if sign == "\\":
                at += 2
            elif sign == "`":
                size, end = self.code(at)
                at = (end if end >= 0 else at) + size
            elif sign == "<":
                at = max(at + 1, self.markup(at))
            elif sign == "[":
                open_.append(at)
            elif open_:
                self.closes[open_.pop()] = at


def _unescaped(text: str) -> str:
    return html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", text))


def _link(index: _Index, start: int, references: dict[str, str]) -> tuple[int, str, str] | None:
    """(end, label, target) of the link whose bracket opens at ``start``."""
    text, end = index.text, index.closes.get(start, -1)
    if end < 0:
        return None
    if target := _TARGET.match(text, end + 1):
        return target.end(), text[start + 1 : end], _unescaped(target[1] if target[1] is not None else target[2])
    named = _NAMED.match(text, end + 1) if references else None
    if not references or (not (named and named[1]) and end - start > LONGEST_LABEL):
        return None
    key = " ".join(((named[1] if named else "") or text[start + 1 : end]).lower().split())
    return (named.end() if named else end + 1, text[start + 1 : end], references[key]) if key in references else None


def _bare(found: str) -> str:
    """A link that stands in text without what ends the sentence or a bracket around it."""
    end, spare = len(found), found.count(")") - found.count("(")
    while end and (found[end - 1] in "?!.,:*_~\"';" or (found[end - 1] == ")" and spare > 0)):
        spare -= found[end - 1] == ")"
        end -= 1
    return found[:end]


def _nodes(text: str, references: dict[str, str], images: list[Block], in_link: bool = False) -> list[_Node]:
    out: list[_Node] = []
    tags: dict[str, int] = {}
    at, plain, index = 0, [], _Index(text)

    def style() -> dict:
        return {STYLED[name]: True for name, n in tags.items() if n > 0}

    def flush() -> None:
        if plain:
            out.append(_Node("".join(plain), style()))
            plain.clear()

    while at < len(text):
        sign = text[at]
        if sign == "\\" and (following := text[at + 1 : at + 2]) and (following == "\n" or re.match(r"[!-/:-@\[-`{-~]", following)):
            plain.append(following)
            at += 2
        elif sign == "[" and at not in index.closes:
            plain.append(sign)
            at += 1
        elif sign == "`":
            size, end = index.code(at)
            code = text[at + size : end].replace("\n", " ") if end >= 0 else text[at : at + size]
            plain.append(code[1:-1] if end >= 0 and code[:1] == code[-1:] == " " and code.strip() else code)
            at = (end if end >= 0 else at) + size
        elif sign == "<" and (auto := _AUTOLINK.match(text, at)):
            flush()
            out.append(_Node(auto[1], {**style(), "link": auto[1] if ":" in auto[1] else "mailto:" + auto[1]}))
            at = auto.end()
        elif sign == "<" and (tag := _TAG.match(text, at)):
            name = (tag[2] or "").lower()
            if name == "br":
                plain.append("\n")
            elif name in STYLED:
                flush()
                tags[name] = max(0, tags.get(name, 0) + (-1 if tag[1] else 1))
            at = tag.end()
        elif sign == "<" and (end := index.markup(at)) > 0:  # a comment
            at = end
        elif sign == "&" and (entity := _ENTITY.match(text, at)):
            plain.append(html.unescape(entity[0]))
            at = entity.end()
        elif text.startswith("![", at) and (found := _link(index, at + 1, references)):
            at, label, target = found
            data = _DATA.match(target)
            try:
                content = base64.b64decode(data[1], validate=True) if data else b""
            except binascii.Error:
                content = b""
            if content:
                images.append({"kind": "image", "bytes": content, "caption": _unescaped(label) or None})
        elif sign == "[" and not in_link and (found := _link(index, at, references)):
            flush()
            at, label, target = found
            inner = _emphasised(_nodes(label, references, images, True))
            out += [_Node(x.text, {**style(), **x.style, "link": target}) for x in inner]
        elif sign in "hw" and not in_link and not (at and text[at - 1].isalnum()) and (bare := _BARE.match(text, at)):
            shown = _bare(bare[0])
            flush()
            out.append(_Node(shown, {**style(), "link": shown if shown.startswith("http") else "http://" + shown}))
            at += len(shown)
        elif sign in "*_~":
            end = _RUNS[sign].match(text, at).end()
            flush()
            out.append(_marks(text, at, end) if sign != "~" or end - at == 2 else _Node(text[at:end]))
            out[-1].style.update(style())
            at = end
        else:
            end = run.end() if (run := _PLAIN.match(text, at)) else at + 1
            plain.append(text[at:end])
            at = end
    flush()
    return out


def _soft(text: str) -> str:
    """A text whose soft line ends are spaces and whose hard ones, two blanks or a backslash, are a backslash and a line end."""
    head, *rest = text.split("\n")
    out = [head]
    for line in rest:
        before = out[-1].rstrip(" \t")
        blanks, slashes = len(out[-1]) - len(before), len(before) - len(before.rstrip("\\"))
        out[-1] = before
        out.append(("\\\n" if blanks > 1 else "\n" if not blanks and slashes % 2 else " ") + line.lstrip(" \t"))
    return "".join(out)


def inline(text: str, references: dict[str, str] | None = None, images: list[Block] | None = None) -> list[Span]:
    """Styled spans; soft line ends are spaces, hard ones stay. Images that carry their data join ``images``."""
    soft = _soft(text)
    nodes = _emphasised(_nodes(soft, references or {}, [] if images is None else images))
    return merged({"text": n.text, **n.style} for n in nodes)


def _row(line: str) -> list[str]:
    """Cells of a table's row; a bar in code or after a backslash parts nothing."""
    bare = line.strip().removeprefix("|")
    cells, held, code = [], "", False
    for piece in re.findall(r"\\\||`|\||[^\\`|]+|\\", bare):
        code ^= piece == "`"
        if piece == "|" and not code:
            cells.append(held)
            held = ""
        else:
            held += "|" if piece == "\\|" else piece
    return [c.strip() for c in (cells + [held] if held.strip() else cells)]


def _is_table(lines: list[str], at: int) -> bool:
    if at + 1 >= len(lines) or "|" not in lines[at] or "-" not in lines[at + 1]:
        return False
    columns = _row(lines[at + 1])
    return bool(columns) and all(map(_COLUMN.fullmatch, columns)) and len(columns) == len(_row(lines[at]))


def _opens(line: str) -> bool:
    """Whether a line ends the paragraph before it."""
    item = _ITEM.match(line)
    listed = bool(item) and item.end() < len(line) and (not item[2][0].isdigit() or item[2][:-1] == "1") and len(item[1]) < 4
    return not line.strip() or bool(_HEADING.match(line) or _RULE.match(line) or _FENCE.match(line) or _QUOTE.match(line) or _BREAK.match(line)) or listed


def _title(text: str) -> str:
    """A heading's text without the signs that close it."""
    text = text.rstrip(" \t")
    bare = text.rstrip("#")
    return bare.rstrip(" \t") if bare != text and (not bare or bare[-1] in " \t") else text


def _cut(line: str, width: int) -> str:
    return line[min(width, len(line) - len(line.lstrip(" "))) :]


def _blocks(lines: list[str], references: dict[str, str], depth: int = 0, quotes: int = 0) -> Iterator[Block]:
    at = 0

    def paragraph(kind: str, text: str, **more) -> Iterator[Block]:
        images: list[Block] = []
        spans = inline(text, references, images)
        if any(s["text"].strip() for s in spans):
            yield {"kind": kind, "spans": spans, **more}
        yield from images

    while at < len(lines):
        line = lines[at]
        if not line.strip() or (_REFERENCE.match(line)):
            at += 1
        elif _BREAK.match(line):
            yield {"kind": "page_break"}
            at += 1
        elif heading := _HEADING.match(line):
            yield from paragraph("heading", _title(heading[2] or ""), level=len(heading[1]))
            at += 1
        elif _RULE.match(line):
            at += 1
        elif fence := _FENCE.match(line):
            shut = re.compile(rf" {{0,3}}{re.escape(fence[2][0])}{{{len(fence[2])},}}[ \t]*$")
            end = next((n for n in range(at + 1, len(lines)) if shut.match(lines[n])), len(lines))
            code = "\n".join(_cut(x, len(fence[1])) for x in lines[at + 1 : end])
            if code.strip():
                yield {"kind": "paragraph", "spans": [{"text": code}]}
            at = end + 1
        elif line.startswith("    "):
            end = at
            while end < len(lines) and (lines[end].startswith("    ") or not lines[end].strip()):
                end += 1
            yield {"kind": "paragraph", "spans": [{"text": "\n".join(x[4:] for x in lines[at:end]).strip("\n")}]}
            at = end
        elif _QUOTE.match(line):
            held = []
            while at < len(lines) and (_QUOTE.match(lines[at]) or (held and held[-1].strip() and not _opens(lines[at]))):
                held.append(_QUOTE.sub("", lines[at], count=1))
                at += 1
            if quotes >= DEEPEST_QUOTE:
                yield from paragraph("quote", "\n".join(held).strip())
                continue
            for block in _blocks(held, references, 0, quotes + 1):
                yield {**block, "kind": "quote"} if block["kind"] == "paragraph" else block
        elif item := _ITEM.match(line):
            width = item.end() if len(item[3]) <= 4 and item[3] else len(item[1]) + len(item[2]) + 1
            held, at = [line[width:]], at + 1
            while at < len(lines):
                inside = len(lines[at]) - len(lines[at].lstrip(" ")) >= width
                lazy = held[-1].strip() and not _opens(lines[at]) and not _ITEM.match(lines[at])
                if lines[at].strip() and not inside and not lazy:
                    break
                held.append(_cut(lines[at], width))
                at += 1
            ordered = item[2][0].isdigit()
            body = list(_blocks(held, references, depth + 1, quotes))
            head = body.pop(0) if body and body[0]["kind"] == "paragraph" else {"spans": []}
            yield {"kind": "list_item", "ordered": ordered, "marker": item[2] if ordered else None, "indent": depth, "spans": head["spans"]}
            yield from body
        elif _is_table(lines, at):
            head, end = _row(line), at + 2
            while end < len(lines) and lines[end].strip() and "|" in lines[end]:
                end += 1
            rows = [(_row(x) + [""] * len(head))[: len(head)] for x in [line, *lines[at + 2 : end]]]
            shown = [["".join(s["text"] for s in inline(c, references)) for c in row] for row in rows]
            labelled = any(shown[0])
            yield {"kind": "table", "rows": shown if labelled else shown[1:], "has_header": labelled}
            at = end
        else:
            end, level = at + 1, 0
            while end < len(lines) and not level:
                if under := _UNDERLINE.match(lines[end]):
                    level = 1 if under[1][0] == "=" else 2
                elif _opens(lines[end]) or _is_table(lines, end):
                    break
                end += 1
            text = "\n".join(x.lstrip() for x in lines[at : end - 1 if level else end]).rstrip()
            yield from paragraph("heading", text, level=level) if level else paragraph("paragraph", text)
            at = end


def markdown_blocks(text: str) -> Iterator[Block]:
    """Blocks in order. Rules leave no trace; code is a paragraph; an empty head of a table means that it has none."""
    lines = text.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n").expandtabs(4).split("\n")
    references: dict[str, str] = {}
    for found in filter(None, map(_REFERENCE.match, lines)):
        references.setdefault(" ".join(found[1].lower().split()), found[2])
    return _blocks(lines, references)


def read_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of Markdown texts; null and blank ones have none."""
    return parsed(docs, id_col, text_col, markdown_blocks)
