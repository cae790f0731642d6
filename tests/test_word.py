"""DOCX: round trips through the writer and hand-made documents for the reader's rules."""

import pytest

from folioflow.blocks import style_of, text_of
from folioflow.sinks import word as sink
from folioflow.sinks.workbook import packed
from folioflow.sources import word as source

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
PNG = b"\x89PNG\r\n\x1a\n" + bytes(16)
BLOCKS = [
    {"kind": "heading", "level": 1, "spans": [{"text": "Title & more"}]},
    {"kind": "paragraph", "spans": [{"text": "a "}, {"text": "bold", "bold": True}, {"text": " <i>\tx\ny "}, {"text": "link", "link": "https://example.com/?a=1&b=2"}]},
    {"kind": "list_item", "ordered": False, "indent": 0, "marker": "•", "spans": [{"text": "one"}]},
    {"kind": "list_item", "ordered": True, "indent": 1, "marker": "a.", "spans": [{"text": "deep", "strike": True}]},
    {"kind": "list_item", "ordered": True, "indent": 1, "marker": "b.", "spans": [{"text": "deeper", "underline": True}]},
    {"kind": "list_item", "ordered": False, "indent": 0, "marker": "•", "spans": [{"text": "two"}]},
    {"kind": "quote", "spans": [{"text": "Quoted", "italic": True}]},
    {"kind": "list_item", "ordered": True, "indent": 0, "marker": "7.", "spans": [{"text": "seven"}]},
    {"kind": "list_item", "ordered": True, "indent": 0, "marker": "8.", "spans": [{"text": "eight"}]},
    {"kind": "table", "has_header": True, "rows": [["A", "B"], ["x\ny", ""]]},
    {"kind": "page_break"},
    {"kind": "image", "bytes": PNG, "width": 40, "height": 20, "caption": "A picture"},
]


def _kept(blocks):
    keys = ("kind", "level", "indent", "ordered", "marker", "rows", "has_header", "bytes", "width", "height", "caption")
    return [(*(b.get(k) for k in keys), [(s["text"], style_of(s)) for s in b.get("spans") or ()]) for b in blocks]


def _read(body, **parts):
    return list(source.document_blocks(packed({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>", **parts})))


def test_round_trip():
    assert _kept(source.document_blocks(sink.document(BLOCKS))) == _kept(BLOCKS)
    assert list(source.document_blocks(sink.document([]))) == []
    with pytest.raises(ValueError):
        list(source.document_blocks(b"no zip"))


def test_levels_are_never_skipped():
    jump = [{"kind": "list_item", "ordered": False, "indent": n, "spans": [{"text": str(n)}]} for n in (3, 5, 0)]
    assert [b["indent"] for b in source.document_blocks(sink.document(jump))] == [0, 1, 0]


def test_fields_revisions_and_breaks():
    run = "<w:r><w:t>{}</w:t></w:r>".format
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> HYPERLINK "http://a.b" </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r>'
    done = '<w:r><w:fldChar w:fldCharType="end"/></w:r>'
    body = f'<w:p><w:r><w:br w:type="page"/></w:r></w:p><w:p>{run("x")}<w:del>{run("gone")}</w:del><w:ins>{run("y")}</w:ins>{field}{run("z")}{done}</w:p>'
    got = _read(body + f'<w:p><w:pPr><w:outlineLvl w:val="1"/></w:pPr>{run("h")}<w:r><w:br w:type="page"/></w:r><w:r><w:br w:type="page"/></w:r>{run("after")}</w:p>')
    assert [(b["kind"], text_of(b)) for b in got] == [("paragraph", "xyz"), ("heading", "h"), ("page_break", ""), ("paragraph", "after")]
    assert [s.get("link") for s in got[0]["spans"]] == [None, "http://a.b"] and got[1]["level"] == 2


def test_tables_pad_and_know_bold_heads():
    cell = "<w:tc>{1}<w:p><w:r>{2}<w:t>{0}</w:t></w:r></w:p></w:tc>".format
    bold, wide = "<w:rPr><w:b/></w:rPr>", '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'
    (table,) = _read(f"<w:tbl><w:tr>{cell('A', wide, bold)}{cell('B', '', bold)}</w:tr><w:tr>{cell('1', '', '')}</w:tr></w:tbl>")
    assert table == {"kind": "table", "rows": [["A", "", "B"], ["1", "", ""]], "has_header": True}


def test_styles_in_circles_and_lists_by_style():
    rels = '<Relationships><Relationship Id="r1" Type="x/styles" Target="styles.xml"/><Relationship Id="r2" Type="x/numbering" Target="numbering.xml"/></Relationships>'
    style = '<w:style w:type="paragraph" w:styleId="{0}"><w:name w:val="{1}"/><w:basedOn w:val="{2}"/>{3}</w:style>'.format
    styles = f"<w:styles {W}>{style('A', 'Mine', 'B', '')}{style('B', 'heading 3', 'A', '')}{style('L', 'Listed', 'none', '<w:pPr><w:numPr><w:numId w:val=' + chr(34) + '5' + chr(34) + '/></w:numPr></w:pPr>')}</w:styles>"
    level = '<w:lvl w:ilvl="0"><w:start w:val="3"/><w:numFmt w:val="upperRoman"/><w:lvlText w:val="(%1)"/></w:lvl>'
    numbering = f'<w:numbering {W}><w:abstractNum w:abstractNumId="9">{level}</w:abstractNum><w:num w:numId="5"><w:abstractNumId w:val="9"/></w:num></w:numbering>'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r><w:t>{s}</w:t></w:r></w:p>' for s in ("A", "L", "L", "Heading2", "Quote"))
    got = _read(body, **{"word/_rels/document.xml.rels": rels, "word/styles.xml": styles, "word/numbering.xml": numbering})
    assert [(b["kind"], b.get("level"), b.get("marker")) for b in got] == [("heading", 3, None), ("list_item", None, "(III)"), ("list_item", None, "(IV)"), ("heading", 2, None), ("quote", None, None)]
    assert [source.spelt(n, k) for n, k in ((28, "lowerLetter"), (1994, "upperRoman"), (7, "decimalZero"))] == ["ab", "MCMXCIV", "07"]


def test_table_of_documents(spark):
    from folioflow.plans.document_queries import document_round_trip, text_blocks

    sf_dir = "/root/testdata/sf0.001"
    want = {(r["doc_id"], r["block_no"]): r["text"] for r in text_blocks(spark, sf_dir).collect() if r["text"]}
    got = document_round_trip(spark, sf_dir).collect()
    assert {r["doc_id"] for r in got} == {k[0] for k in want}
    words = lambda rows: "".join("".join(t.split()) for t in rows)
    assert sorted(words([r["text"]]) for r in got if r["text"]) == sorted(words([t]) for t in want.values() if words([t]))
