"""Markdown, HTML and XLSX: expected literals and round trips."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioflow.blocks import style_of, text_of
from folioflow.sinks import html, markdown, workbook
from folioflow.sources import markdown as md
from folioflow.sources import workbook as xlsx


def _shape(text):
    out = []
    for b in md.markdown_blocks(text):
        what = b["rows"] if b["kind"] == "table" else text_of(b)
        out.append((b["kind"], b.get("level", b.get("indent")), what))
    return out


def test_markdown_headings():
    got = _shape("# One #\n\nTwo\n===\n\nThree\n---\n\n###### Six\n\n####### seven")
    assert got == [("heading", 1, "One"), ("heading", 1, "Two"), ("heading", 2, "Three"), ("heading", 6, "Six"), ("paragraph", None, "####### seven")]


def test_markdown_line_ends():
    assert _shape("line one\nline two  \nline three\\\nline four") == [("paragraph", None, "line one line two\nline three\nline four")]
    assert _shape("") == [] and _shape("\n  \n\t\n") == []


def test_markdown_emphasis():
    spans = md.inline("*thin*__thick__ and ***both***, file_name_2, 7 * 8, a*b*c")
    got = [(s["text"], bool(s.get("bold")), bool(s.get("italic"))) for s in spans]
    assert got == [("thin", False, True), ("thick", True, False), (" and ", False, False), ("both", True, True), (", file_name_2, 7 * 8, a", False, False), ("b", False, True), ("c", False, False)]


@pytest.mark.parametrize(
    ("text", "shown", "link"),
    [
        ('[Spark](https://spark.apache.org "home")', "Spark", "https://spark.apache.org"),
        ("[a page][one]\n\n[one]: /page?x=1", "a page", "/page?x=1"),
        ("[Two]\n\n[two]: mailto:me@site.org", "Two", "mailto:me@site.org"),
        ("<ftp://files.site.org/a>", "ftp://files.site.org/a", "ftp://files.site.org/a"),
        ("go to www.site.org now", "www.site.org", "http://www.site.org"),
    ],
)
def test_markdown_links(text, shown, link):
    (block,) = md.markdown_blocks(text)
    assert [(s["text"], s["link"]) for s in block["spans"] if s.get("link")] == [(shown, link)]


def test_markdown_lists():
    got = _shape("* a\n  continued\n  + b\n    1) c\n    2) d\n* e\n\n10. ten\n11. eleven")
    assert got == [("list_item", d, t) for d, t in ((0, "a continued"), (1, "b"), (2, "c"), (2, "d"), (0, "e"), (0, "ten"), (0, "eleven"))]


@pytest.mark.parametrize(
    ("text", "shape"),
    [
        ("> said *once*\n> said again\nand on", [("quote", None, "said once said again and on")]),
        ("~~~\nkeep  this\n\n* as it is\n~~~", [("paragraph", None, "keep  this\n\n* as it is")]),
        ("before\n\n- - -\n\nafter", [("paragraph", None, "before"), ("paragraph", None, "after")]),
        ("k | v\n--- | ---\n`x\\|y` | 2\n| last |", [("table", None, [["k", "v"], ["x|y", "2"], ["last", ""]])]),
        ("up\n\n\\pagebreak\n\ndown", [("paragraph", None, "up"), ("page_break", None, ""), ("paragraph", None, "down")]),
        ("    one\n      two", [("paragraph", None, "one\n  two")]),
    ],
)
def test_markdown_quotes_code_tables_breaks(text, shape):
    assert _shape(text) == shape


def test_markdown_elements_and_entities():
    (block,) = md.markdown_blocks('<b>bold</b> <span class="x">plain</span> <!-- c --> &copy; &#x41; &unknown;')
    assert [(bool(s.get("bold")), s["text"]) for s in block["spans"]] == [(True, "bold"), (False, " plain  © A &unknown;")]


def _p(text, **style):
    return {"text": text, **style}


BLOCKS = [
    {"kind": "heading", "level": 2, "spans": [_p("Part #2: rivers")]},
    {"kind": "paragraph", "spans": [_p("wide "), _p("deep", bold=True), _p(", "), _p("slow", italic=True), _p(" or "), _p("mapped", link="http://maps.org/r(1)?a=2&b=3")]},
    {"kind": "list_item", "ordered": True, "indent": 0, "marker": "1.", "spans": [_p("north")]},
    {"kind": "list_item", "ordered": False, "indent": 1, "spans": [_p("cold "), _p("water", italic=True)]},
    {"kind": "list_item", "ordered": True, "indent": 0, "marker": "2.", "spans": [_p("south")]},
    {"kind": "quote", "spans": [_p("It "), _p("flows", bold=True)]},
    {"kind": "table", "has_header": True, "rows": [["Name|alias", "km"], ["two\nlines", "7"]]},
    {"kind": "page_break"},
]


def test_html_literals():
    page = html.page(BLOCKS, "R&D")
    assert "<title>R&amp;D</title>" in page and page.startswith("<!DOCTYPE html>")
    assert "".join(page.split("\n")).count("<ol><li>north<ul><li>cold <em>water</em></li></ul></li><li>south</li></ol>") == 1
    assert 'href="http://maps.org/r(1)?a=2&amp;b=3"' in page and "<h2" in page and "<blockquote" in page
    assert "Name|alias</th>" in page and "<td>two<br>\nlines</td>" in page
    assert "vbscript" not in html.inline([_p("run <it>", link="vbscript:x")])


def _kept(blocks):
    return [(b["kind"], b.get("level"), b.get("indent"), b.get("ordered"), b.get("rows"), [(s["text"], style_of(s)) for s in b.get("spans") or ()]) for b in blocks]


def test_markdown_round_trip():
    assert _kept(md.markdown_blocks(markdown.text(BLOCKS))) == _kept(BLOCKS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab1.*_`[]<>&|#+-~\\!() é", min_size=1, max_size=12).map(str.strip).filter(bool), min_size=1, max_size=4))
def test_plain_text_survives_markdown(texts):
    blocks = [{"kind": "paragraph", "spans": [_p(t)]} for t in texts]
    assert [text_of(b) for b in md.markdown_blocks(markdown.text(blocks))] == texts


def test_workbook_numbers():
    got = [xlsx.shown_number(*a) for a in ((45292.0, 14), (0.1234, 10), (1234567.891, 4), (1e-3, 0), (45292.5, 22), (-2.5, 1))]
    assert got == ["2024-01-01", "12.34%", "1,234,567.89", "0.001", "2024-01-01 12:00", "-3"]
    assert xlsx.shown_number(45292.5, 164, {164: "dd/mm/yyyy"}) == "2024-01-01"
    assert xlsx.shown_number(45292.0, 14, None, True) == "2028-01-02"
    assert [xlsx.column_number(x) for x in ("A", "Z", "AA", "az", "XFD")] == [0, 25, 26, 51, 16383]


def test_workbook_round_trip():
    table = {"kind": "table", "has_header": True, "rows": [["Region", "Q1", "Q2"], ["North", "1,200", "1.5"]]}
    blocks = list(xlsx.workbook_blocks(workbook.workbook(workbook.sheets_of([table]))))
    assert [text_of(b) for b in blocks if b["kind"] == "heading"] == ["Content", "Table 1"]
    assert blocks[-1] == {"kind": "table", "rows": [["Region", "Q1", "Q2"], ["North", "1200", "1.5"]], "has_header": True}
    assert workbook.unique_names(["a/b", "A B", "", "x" * 40]) == ["a b", "A B (2)", "Sheet", "x" * 31]
    with pytest.raises(ValueError):
        list(xlsx.workbook_blocks(b"no zip"))


def test_tables_of_documents(spark):
    texts = spark.createDataFrame([(1, "# Head\n\ntext **b**\n\n| a | b |\n|---|---|\n| 1 | 2 |"), (2, None), (3, "")], "doc_id long, text string")
    blocks = md.read_blocks(texts)
    assert blocks.groupBy("doc_id").count().collect()[0].asDict() == {"doc_id": 1, "count": 3}
    assert [r["markdown"] for r in markdown.rendered(blocks).collect()] == ["# Head\n\ntext **b**\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n"]
    assert "<strong>b</strong>" in html.rendered(blocks).first()["html"]
    back = xlsx.read_blocks(workbook.rendered(blocks), "doc_id").where("kind = 'table'").orderBy("block_no").collect()
    assert back[-1]["rows"] == [["a", "b"], ["1", "2"]]
    broken = spark.createDataFrame([(1, bytearray(b"x"))], "path long, content binary")
    assert xlsx.read_blocks(broken, mode="DROPMALFORMED").count() == 0


def test_punctuation_beside_emphasis():
    assert markdown.inline([_p("word", bold=True), _p("(x)", italic=True)]) == "**word**<em>(x)</em>"


def test_workbook_cells_hold_every_turn(spark):
    from folioflow.plans.document_queries import workbook_cells
    from folioflow.session import table

    sf_dir = "/root/testdata/sf0.001"
    said = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in table(spark, sf_dir, "conversations").collect())
    got = {}
    for row in workbook_cells(spark, sf_dir).collect():
        got.setdefault((row["conv_id"], row["block_no"], row["r"]), {})[row["c"]] = row["value"]
    want, place = {}, {}
    for conv, _, role, text in said:
        place[conv] = place.get(conv, 0) + 1
        want[conv, 3, place[conv]] = want[conv, 1, place[conv] + 1] = {0: role, 1: text}
    for conv in place:
        want[conv, 3, 0] = want[conv, 1, 1] = {0: "role", 1: "text"}
        want[conv, 1, 0] = {0: "", 1: ""}  # the sheet of the whole content begins with a blank row
    assert got == want


def test_exports_of_whole_tables(spark):
    from folioflow.plans import document_queries as q
    from folioflow.session import table

    sf_dir = "/root/testdata/sf0.001"
    filled = table(spark, sf_dir, "documents").where("trim(text) <> ''").count()
    pages = q.html_export(spark, sf_dir).collect()
    assert len(pages) == filled and all(p["html"].endswith("</html>\n") for p in pages)
    texts = {r["doc_id"]: r["markdown"] for r in q.markdown_export(spark, sf_dir).collect()}
    assert len(texts) == filled
    assert q.markdown_blocks(spark, sf_dir).select("doc_id").distinct().count() == filled


LONG = {
    "brackets": "[" * 1_000_000, "backticks": "`" * 1_000_000, "spans": "` `` " * 200_000, "runs": "".join("`" * n + " " for n in range(1, 1400)), "nested": "[" * 500_000 + "]" * 500_000,
    "open": "*a " * 60_000, "shut": "a* " * 60_000, "mixed": "**a *b " * 40_000, "both": "_a* " * 50_000, "stars": "*" * 300_000 + "a" + "*" * 300_000, "comments": "<!-- " * 200_000,
    "targets": "[a](" * 150_000, "images": "![" * 300_000, "bare": "http://a" + ")" * 400_000, "blanks": " " * 3 + "y" + " " * 400_000 + "x", "heading": "# a" + " " * 400_000 + "b", "quotes": "> " * 50_000 + "x",
    "elements": "<a " * 200_000, "references": "[a][" * 200_000, "entities": "&" * 400_000,
}


@pytest.mark.parametrize("name", LONG)
def test_markdown_takes_linear_time(name):
    text = LONG[name]
    began = time.process_time()
    blocks = list(md.markdown_blocks("[ref]: http://x.y\n\n" + text))
    assert time.process_time() - began < 8
    letters = "".join(s["text"] for b in blocks for s in b.get("spans") or ())
    assert sum(c.isalpha() for c in letters) == sum(c.isalpha() for c in text)


def styles(text):
    return [(s["text"], *(k for k in ("bold", "italic", "strike", "link") if s.get(k))) for s in md.inline(text, {"ref": "http://x.y"})]


def test_markdown_delimiters_by_the_published_rules():
    assert styles("*a **b** c*") == [("a ", "italic"), ("b", "bold", "italic"), (" c", "italic")]
    assert styles("***a** b*") == [("a", "bold", "italic"), (" b", "italic")]
    assert styles("***a* b**") == [("a", "bold", "italic"), (" b", "bold")]
    assert styles("*a _b* c_") == [("a _b", "italic"), (" c_",)]
    assert styles("**a*b**") == [("a*b", "bold")]
    assert styles("*a**b*") == [("a**b", "italic")]
    assert styles("a**b*c") == [("a**b*c",)]
    assert styles("~~a *b~~ c*") == [("a *b", "strike"), (" c*",)]
    assert styles("*a `*` b*") == [("a * b", "italic")] and styles("*[a*](u)*") == [("a*", "italic", "link")]
    assert styles("[a [b] c](u) [x") == [("a [b] c", "link"), (" [x",)] and styles("[a `]` b](u)") == [("a ] b", "link")]
    assert styles("[a <b title=']'>c</b>](u)") == [("a ", "link"), ("c", "bold", "link")] and styles("<!-- [ -->[a](u)") == [("a", "link")]
    assert styles("[ref] [text][ref] [none]") == [("ref", "link"), (" ",), ("text", "link"), (" [none]",)]
    assert styles("a\\\nb  \nc \nd\\\\\ne") == [("a\nb\nc d\\ e",)]
    assert [b["spans"][0]["text"] for b in md.markdown_blocks("# a #\n## b# \n### ###\n# c \\#")] == ["a", "b#", "c #"]
