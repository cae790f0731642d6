"""Text functions as column expressions: normalisation, predicates, escaping, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that decide what counts as white space, a page number, a
# list marker, a heading, a caption, a sentence end or a hyphenated line end.
WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
BLANKS = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
PAGE_NUMBER = r"[{0}\-–—|]*+\d{{1,4}}[{0}\-–—|]*+"
PAGE_OF = r"{1}(?:(?i:page|p\.|pg\.?){1}\d{{1,4}}(?:{1}(?i:of|/){1}\d{{1,4}})?|\d{{1,4}}{1}(?i:of|/){1}\d{{1,4}}){1}"
ROMAN = r"[{0}\-–—|]*+(?=(?:[ivxlcdm]{{1,7}}|[IVXLCDM]{{1,7}})[{0}\-–—|]*+\z)(?i:m{{0,4}}(?:cm|cd|d?c{{0,3}})(?:xc|xl|l?x{{0,3}})(?:ix|iv|v?i{{0,3}}))[{0}\-–—|]*+"
#: A whole line, with white space of any kind at its ends and between its parts, told in one pass from its start.
PAGE_LINE = r"\A(?:" + "|".join(p.format(WS[1:-1], WS + "*+") for p in (PAGE_NUMBER, PAGE_OF, ROMAN)) + r")\z"
BULLET = r"^\s*([•◦▪▫‣●○■□►▸▹➢➤✓✔·])\s*\S"
DASH = r"^\s*([\-–—*])\s+\S"
NUMBERED = r"^\s*((?:\d{1,3}|[a-zA-Z]|[ivxlcdm]{2,6}|[IVXLCDM]{2,6})[.)]|\((?:\d{1,3}|[a-zA-Z]|[ivxlcdm]{2,6}|[IVXLCDM]{2,6})\))\s+\S"
NUMBERED_HEADING = r"^\s*(\d+(\.\d+)*\.?|[IVXLC]+\.|[A-Z]\.)\s+\S"
CAPTION = r"(?i)^\s*((figure|table)([^a-z]|$)|fig\.)"
SENTENCE_END = "[.!?:;…][\"'”’)\\]]*$"
SCHEMES = ("http", "https", "mailto", "tel", "ftp")
NOT_XML = r"[^\t\n\r\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]"


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    """Each run of white space as one space."""
    return F.regexp_replace(c, f"{WS}+", " ")


def margin_text(c: Column) -> Column:
    """Form in which running heads and feet are compared: lower case, digits as ``#``."""
    return collapse(F.regexp_replace(F.lower(strip(c)), r"[0-9]", "#"))


def is_page_number(c: Column) -> Column:
    """Whether a line is nothing but a page number, also ``Page 3 of 10`` or a roman numeral of seven letters at most, all of one case."""
    return c.rlike(PAGE_LINE)


def list_marker(c: Column) -> Column:
    """The marker that a line opens a list item with: a bullet, a dash or a number; else null."""
    found = [F.nullif(F.regexp_extract(c, p, 1), F.lit("")) for p in (BULLET, DASH, NUMBERED)]
    return F.coalesce(*found)


def ends_sentence(c: Column) -> Column:
    return F.regexp_replace(c, f"{WS}+$", "").rlike(SENTENCE_END)


def starts_lower(c: Column) -> Column:
    return c.rlike('^[\\s"“‘(\\[]*\\p{Ll}')


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"\S+")).cast("long")


def joined_lines(c: Column) -> Column:
    """Lines of a paragraph as one: soft hyphens go, a hyphen before a small letter goes, else a space parts them."""
    lines = F.array_join(F.filter(F.transform(F.split(c, "\n", -1), lambda x: F.trim(x, F.lit(BLANKS))), lambda x: x != ""), "\n")
    soft = F.regexp_replace(lines, r"\x{AD}\n", "")
    small = F.regexp_replace(soft, '(\\p{L})[-‐]\\n(?=["“‘(\\[]*\\p{Ll})', "$1")
    hyphen = F.regexp_replace(small, "(\\p{L}[-‐])\\n", "$1")
    return F.regexp_replace(hyphen, "\\n", " ")


def strip_invalid_xml(c: Column) -> Column:
    return F.regexp_replace(c, NOT_XML, "")


def _replaced(c: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def xml_escape(c: Column) -> Column:
    return _replaced(strip_invalid_xml(c), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")))


def html_escape(c: Column) -> Column:
    return _replaced(strip_invalid_xml(c), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")))


def html_text(c: Column) -> Column:
    """Escaped text with line breaks and wide spaces for tabs."""
    return _replaced(html_escape(F.replace(c, F.lit("\r\n"), F.lit("\n"))), (("\n", "<br>\n"), ("\t", "&emsp;")))


def markdown_escape(c: Column, pipes: bool = False) -> Column:
    marks = r"([\\`*_\[\]<>~|])" if pipes else r"([\\`*_\[\]<>~])"
    return F.regexp_replace(F.regexp_replace(strip_invalid_xml(c), marks, r"\\$1"), r"&(?=(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);)", r"\\&")


def markdown_line_start(c: Column) -> Column:
    """A line whose first sign would open a block, with that escaped."""
    marked = F.when(c.rlike(r"^[#>=+\-|]"), F.concat(F.lit("\\"), c))
    return F.coalesce(marked, F.regexp_replace(c, r"^(\d{1,9})([.)])", r"$1\\$2"))


def safe_href(c: Column) -> Column:
    """A link that is relative or of a harmless scheme; else null."""
    link = F.nullif(strip(c), F.lit(""))
    scheme = F.lower(F.regexp_extract(link, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    return F.when((scheme == "") | scheme.isin(*SCHEMES), link)


def file_name(c: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1F]', "_")), F.lit("")), F.lit("Untitled"))


def sheet_name(c: Column) -> Column:
    """A worksheet's name before it is made unique."""
    return F.substring(F.coalesce(F.nullif(strip(F.regexp_replace(c, r"[\[\]*?/\\:]", " ")), F.lit("")), F.lit("Sheet")), 1, 31)


def humanised(c: Column) -> Column:
    """A form field's name as a label: last dotted part, camel case and joints to spaces, first letter large."""
    name = strip(c)
    last = F.coalesce(F.nullif(F.regexp_extract(name, r"([^.]+)\.*$", 1), F.lit("")), name)
    words = F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(last, r"([a-z0-9])([A-Z])", "$1 $2"), r"[_\-\s]+", " "), "^ | $", ""))
    label = F.concat(F.upper(F.substring(words, 1, 1)), F.substr(words, F.lit(2)))
    return F.when((name == "") | F.contains(name, F.lit(" ")), name).when(words == "", name).otherwise(label)


def linked_text(text: Column, link: Column) -> Column:
    """Text with its link in brackets unless it shows the link already."""
    bare = F.regexp_replace(link, "^(mailto:|https?://)", "")
    shown = strip(text)
    return F.when(link.isNull() | (link == "") | (shown == link) | (shown == bare), text).otherwise(F.concat(text, F.lit(" ("), link, F.lit(")")))


def font_class(c: Column) -> Column:
    """serif, mono or sans by what a font's name holds."""
    name = F.lower(c)
    return F.when(name.rlike("courier|mono|consol|typewriter"), "mono").when(name.rlike("times|serif|roman|georgia|garamond|palatino|cambria|book") & ~name.rlike("sans"), "serif").otherwise("sans")


def whole_word_count(c: Column, query: str) -> Column:
    """Hits of a word between characters other than ASCII letters, digits and ``_``, whatever the case."""
    quoted = "".join("\\" + q if not q.isalnum() else q for q in query)
    return F.regexp_count(c, F.lit(f"(?i)(?<![A-Za-z0-9_]){quoted}(?![A-Za-z0-9_])")).cast("long")


def substring_count(c: Column, query: str) -> Column:
    """Hits of a substring that don't overlap, whatever the case."""
    low = F.lower(c)
    return ((F.length(low) - F.length(F.replace(low, F.lit(query.lower()), F.lit("")))) / len(query)).cast("long")
