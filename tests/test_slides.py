"""PPTX: every part is well formed, every relation leads to a part, and text stands where its page has it."""

import io
import posixpath
import zipfile
from xml.etree import ElementTree

import pytest

from folioflow.sinks import slides

A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
BOX = {"l": 10.0, "t": 20.0, "r": 110.0, "b": 32.0, "size": 12.0, "lines": ["one < two", "three"], "bold": True}


def _parts(data):
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return {n: z.read(n) for n in z.namelist()}


def test_parts_and_relations():
    parts = _parts(slides.presentation([{"width": 400.0, "height": 300.0, "boxes": [BOX], "picture": b"\x89PNG\r\n\x1a\n"}, {"width": 800.0, "height": 300.0, "boxes": [BOX]}]))
    trees = {n: ElementTree.fromstring(d) for n, d in parts.items() if not n.endswith(".png")}
    for name, tree in trees.items():
        if name.endswith(".rels"):
            folder = posixpath.dirname(posixpath.dirname(name))
            assert all(posixpath.normpath(posixpath.join(folder, r.get("Target"))) in parts for r in tree)
    named = {r.get("PartName") for r in trees["[Content_Types].xml"] if r.get("PartName")}
    assert {n.lstrip("/") for n in named} <= set(parts)
    first, second = trees["ppt/slides/slide1.xml"], trees["ppt/slides/slide2.xml"]
    assert [t.text for t in first.iter(f"{A}t")] == ["one < two", "three"]
    offsets = [(int(o.get("x")), int(o.get("y"))) for o in first.iter(f"{A}off")]
    assert offsets[-1] == (10 * 12700, 20 * 12700)
    # the second page is twice as wide: a group of half the scale, centred from top to bottom, with the page's own coordinates in it
    group = second.find(".//{*}grpSp/{*}grpSpPr/{*}xfrm")
    assert [tuple(int(v) for v in e.attrib.values()) for e in group] == [(0, 75 * 12700), (400 * 12700, 150 * 12700), (0, 0), (800 * 12700, 300 * 12700)]
    assert [(int(o.get("x")), int(o.get("y"))) for o in second.iter(f"{A}off")][-1] == (10 * 12700, 20 * 12700)
    assert [r.get("sz") for r in second.iter(f"{A}rPr")] == ["600", "600"]
    with pytest.raises(ValueError):
        slides.presentation([])


def test_table_of_pages(spark):
    fields = f"doc_id long, page int, width double, height double, boxes array<{slides.BOX}>, picture binary, extra int"
    rows = [(1, 2, 100.0, 50.0, None, None, 0), (1, 1, 100.0, 50.0, [(0.0, 0.0, 9.0, 9.0, None, ["first"], None, None, None, None)], None, 0), (2, 1, 0.0, 0.0, None, None, 0)]
    (row,) = slides.rendered(spark.createDataFrame(rows, fields)).collect()
    parts = _parts(bytes(row["content"]))
    assert row["doc_id"] == 1 and b"first" in parts["ppt/slides/slide1.xml"] and b"first" not in parts["ppt/slides/slide2.xml"]
