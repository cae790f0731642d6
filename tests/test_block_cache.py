"""Blocks in a cache: an exact round trip, and caches that are broken."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from folioflow import blocks as b
from folioflow.functions import geometry
from folioflow.operators import glyphs
from folioflow.sinks import block_cache as sink
from folioflow.sources import block_cache as source

STYLED = {"text": "Straße ", "bold": True, "italic": False, "underline": True, "strike": False, "link": "https://a.example", "color": 0xFF102030, "font_family": "serif", "size_ratio": 1.5}
PLAIN = {"text": "plain", "bold": False, "italic": False, "underline": False, "strike": False, "link": None, "color": None, "font_family": None, "size_ratio": 1.0}
BLOCKS = [
    {"kind": "heading", "page": 1, "level": 2, "align": "center", "spans": [STYLED, PLAIN]},
    {"kind": "paragraph", "page": 1, "align": "start", "spans": []},
    {"kind": "list_item", "page": None, "ordered": True, "marker": "1.", "indent": 2, "spans": [PLAIN]},
    {"kind": "image", "page": 2, "width": 3, "height": 4, "caption": None, "bytes": b"\x00first"},
    {"kind": "quote", "page": 2, "spans": [PLAIN]},
    {"kind": "table", "page": 2, "rows": [["a", ""], ["ü", "\n"]], "has_header": True},
    {"kind": "page_break", "page": 2},
    {"kind": "image", "page": 3, "width": 1, "height": 1, "caption": "Fig. 1", "bytes": b"second"},
]


def test_round_trip():
    content = sink.encoded(BLOCKS)
    assert list(source.decoded(content)) == BLOCKS
    assert content.endswith(b"\x00firstsecond") and int.from_bytes(content[:4], "big") == len(content) - 16
    assert list(source.decoded(sink.encoded([]))) == []


def test_broken_caches():
    content = sink.encoded(BLOCKS)
    for broken in (b"", b"\0\0", content[:40], content[:-1], b"\0\0\0\2{}", b"\0\0\0\2[]", content.replace(b'"t": "q"', b'"t": "?"')):
        with pytest.raises(ValueError):
            list(source.decoded(broken))


def test_tables(spark):
    kind = b.FIELDS.replace("block_no int", "doc_id long, block_no int")
    rows = [Row(doc_id=7, block_no=n, **{k: block.get(k) for k in ("kind", "page", "level", "align", "ordered", "marker", "indent", "spans", "rows", "has_header", "bytes", "width", "height", "caption")}) for n, block in enumerate(BLOCKS)]
    frame = spark.createDataFrame([tuple(r) for r in rows], kind).orderBy(F.desc("block_no"))
    files = sink.rendered(frame)
    back = source.read_blocks(files).orderBy("block_no").collect()
    assert [tuple(r) for r in back] == [tuple(r) for r in frame.orderBy("block_no").collect()]
    bad = spark.createDataFrame([(1, bytearray(b"\0\0\0\x09")), (2, None)], "doc_id long, content binary")
    assert source.read_blocks(files.union(bad), mode="DROPMALFORMED").count() == len(BLOCKS)
    assert sink.rendered(frame.limit(0)).count() == 0


def test_rectangles_by_line(spark):
    def sign(x, y, w=5.0, h=10.0):
        return (float(x), float(y), x + w, y + h)

    rows = [
        (1, [sign(0, 0), sign(5, 1), sign(10, 0), sign(0, 12), sign(5, 12)]),  # goes on in the next line
        (2, [sign(0, 0), sign(40, 0), sign(3, 0, 0.0)]),  # too far apart; no area
        (3, [sign(20, 0), sign(12, 0)]),  # from right to left
        (4, []),
    ]
    frame = spark.createDataFrame(rows, "k int, signs array<struct<l:double,t:double,r:double,b:double>>")
    got = {r.k: [tuple(x) for x in r.boxes] for r in frame.select("k", geometry.line_rects(F.col("signs")).alias("boxes")).collect()}
    assert got == {1: [(-1, -1, 16, 12), (-1, 11, 11, 23)], 2: [(-1, -1, 6, 11), (39, -1, 46, 11)], 3: [(11, -1, 26, 11)], 4: []}


def test_texts_of_blocks(spark):
    rows = [(1, 0, "  a long exam- ", 100.0), (1, 1, "ple of a line", 98.0), (1, 2, " short", 40.0), (1, 3, "-", 95.0), (1, 4, "Capital-", 100.0), (1, 5, "Letter", 30.0), (2, 0, "one", 9.0), (3, 0, "", 100.0), (3, 1, "x", 5.0)]
    lines = spark.createDataFrame(rows, "k int, n int, text string, r double").withColumn("size", F.lit(10.0))
    got = {r.k: r.text for r in glyphs.paragraph_texts(lines, ["k"], ["n"]).collect()}
    assert got == {1: "  a long example of a line short\n- Capital- Letter", 2: "one", 3: " x"}
