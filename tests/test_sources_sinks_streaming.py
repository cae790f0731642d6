import json

from pyspark.sql import functions as F

from folioflow.functions import binary, geometry, numbers, text
from folioflow.sinks import plain_text as sink
from folioflow.sources import files, plain_text

SAMPLE = "First line\nsecond line\n\n\n- item one\n  - nested\n• dot\n1. num\n2) other\ncontinued\n\fPage two"


def test_text_blocks():
    got = plain_text.text_blocks(SAMPLE)
    assert got == [
        ("paragraph", "First line\nsecond line", None, None, None),
        ("list_item", "item one", False, "-", 0),
        ("list_item", "nested", False, "-", 1),
        ("list_item", "dot", False, "•", 0),
        ("list_item", "num", True, "1.", 0),
        ("list_item", "other\ncontinued", True, "2)", 0),
        ("page_break", None, None, None, None),
        ("paragraph", "Page two", None, None, None),
    ]
    assert plain_text.text_blocks("\r\n\r\n") == [] and len(plain_text.text_blocks("A. Smith wrote this.")) == 1


def test_blocks_table_and_text_sink(spark):
    docs = spark.createDataFrame([(1, SAMPLE), (2, None)], "doc_id long, text string")
    blocks = plain_text.read_blocks(docs).withColumn("level", F.lit(1)).withColumn("number", F.lit(4))
    heading = blocks.limit(1).select("doc_id", F.lit(-1).alias("block_no"), F.lit("heading").alias("kind"), F.lit("Head").alias("text"), "ordered", "marker", "indent", "level", "number")
    out = sink.rendered(blocks.unionByName(heading)).collect()
    assert [(r["doc_id"], r["text"]) for r in out] == [(1, "Head\n====\n\nFirst line\nsecond line\n\n• item one\n    – nested\n• dot\n4. num\n4. other\n   continued\n\nPage two\n")]


def _one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_scalar_literals(spark):
    lit = F.lit
    got = _one(spark, *(numbers.byte_label(lit(n)).alias(str(n)) for n in (512, 2048, 5 << 20, 150 << 20)))
    assert [*got] == ["512 B", "2.0 KB", "5.0 MB", "150 MB"]
    names = ["full_name", "emailAddress", "form1.zip-code", "Your full name", "Q3"]
    assert [*_one(spark, *(text.humanised(lit(x)) for x in names))] == ["Full name", "Email address", "Zip code", "Your full name", "Q3"]
    assert [*_one(spark, text.file_name(lit("a/b:c*?.pdf")), text.file_name(lit("  ")))] == ["a_b_c__.pdf", "Untitled"]
    yes = ["12", "- 12 -", "— 7 —", "Page 3 of 10", "page 4", "3 / 10", "iv", "XII", "p. 9"]
    no = ["Introduction", "12 apples", "Chapter 3", "Mixed", "I am"]
    assert [*_one(spark, *(text.is_page_number(lit(x)).alias(f"c{i}") for i, x in enumerate(yes + no)))] == [True] * 9 + [False] * 5
    assert [*_one(spark, *(numbers.column_index(lit(x)).alias(x) for x in ("A", "Z", "AA", "az", "XFD")))] == [0, 25, 26, 51, 16383]
    dates = _one(spark, numbers.serial_date(lit(45292.0)).cast("string"), numbers.serial_date(lit(45292.0), from_1904=True).cast("string"))
    assert [d[:10] for d in dates] == ["2024-01-01", "2028-01-02"]
    assert [*_one(spark, numbers.percent(lit(0.1234), 2), numbers.thousands(lit(1234567.891), 2))] == ["12.34%", "1,234,567.89"]
    assert [*_one(spark, text.markdown_escape(lit("a & b &amp; *x* |"), pipes=True), text.markdown_line_start(lit("12. x")))] == [r"a & b \&amp; \*x\* \|", r"12\. x"]
    assert _one(spark, text.joined_lines(lit("exam-\nple of Franco-\nPrussian soft­\nhyphen\nend")))[0] == "example of Franco-Prussian softhyphen end"
    assert [*_one(spark, text.safe_href(lit("javascript:x")), text.safe_href(lit(" /a ")))] == [None, "/a"]
    assert _one(spark, binary.image_kind(lit(bytes.fromhex("FFD8FFE0"))))[0] == "jpeg"
    assert _one(spark, binary.image_kind(lit(b"RIFF0000WEBP")))[0] == "webp"
    square = F.array(*(F.struct(lit(float(x)).alias("x"), lit(float(y)).alias("y")) for x, y in ((0, 0), (2, 0), (2, 3), (0, 3))))
    assert _one(spark, geometry.shoelace(square))[0] == 6.0
    assert [*_one(spark, numbers.roman(lit(1994)), numbers.roman(lit(4000)), numbers.column_letters(lit(702)), numbers.column_letters(lit(703)))] == ["MCMXCIV", "4000", "ZZ", "AAA"]


def test_listing_and_library(spark, tmp_path):
    for name in ("a.TXT", "b.pdf", ".hidden.txt"):
        (tmp_path / name).write_text("x")
    rows = files.listing(spark, f"file://{tmp_path}", ["txt"])
    assert [r["name"] for r in rows.collect()] == ["a.TXT"]
    assert files.found_by_name(rows, "A.t").count() == 1 and files.found_by_name(rows, "").count() == 0
    assert rows.select(files.reader_of()).first()[0] == "text"
    store = tmp_path / "lib.json"
    store.write_text("\n".join([json.dumps({"path": "a", "lastOpened": 1000}), json.dumps({"path": "b", "lastOpened": 2000, "starred": True}), "broken", json.dumps({"path": "c"})]))
    got = files.library(spark, f"file://{store}")
    assert [r["path"] for r in files.recents(got).collect()] == ["b", "a"] and got.count() == 3
    assert [r["line"] for r in files.broken_lines(spark, f"file://{store}").collect()] == ["broken"]


def test_files_go_to_the_reader_of_their_extension(spark):
    rows = [("/a.md", "# Head\n\ntext"), ("/b.txt", "- item\n\nplain"), ("/c.CSV", "x,y"), ("/d.pdf", "%PDF")]
    blocks = files.read_documents(spark.createDataFrame([(p, bytearray(c.encode())) for p, c in rows], "path string, content binary"))
    assert sorted((r["path"], r["kind"]) for r in blocks.collect()) == [("/a.md", "heading"), ("/a.md", "paragraph"), ("/b.txt", "list_item"), ("/b.txt", "paragraph"), ("/c.CSV", "paragraph")]


def test_folders_and_search(spark, tmp_path):
    import os

    (tmp_path / "Zeta").mkdir()
    (tmp_path / "alpha" / "deep" / "Report folder").mkdir(parents=True)
    (tmp_path / ".hidden").mkdir()
    made = {"b.pdf": 30, "A.pdf": 10, "c.txt": 20, "note.xyz": 5, ".dot.pdf": 1, "alpha/report.pdf": 3, "alpha/deep/REPORT 2.txt": 2, ".hidden/report.pdf": 1, "alpha/deep/.report.pdf": 1}
    for n, (name, size) in enumerate(made.items()):
        (tmp_path / name).write_bytes(b"x" * size)
        os.utime(tmp_path / name, (1_700_000_000 + n, 1_700_000_000 + n))
    names = lambda df: [r["name"] for r in df.collect()]
    at, kinds = f"file://{tmp_path}", ["pdf", "txt"]
    assert names(files.folder(spark, at, kinds, "name", False)) == ["alpha", "Zeta", "A.pdf", "b.pdf", "c.txt"]
    assert names(files.folder(spark, at, kinds, "size")) == ["Zeta", "alpha", "b.pdf", "c.txt", "A.pdf"]
    assert names(files.folder(spark, at, kinds, "date"))[2:] == ["c.txt", "A.pdf", "b.pdf"]
    assert "note.xyz" in names(files.folder(spark, at)) and not any(n.startswith(".") for n in names(files.folder(spark, at)))
    assert names(files.searched(spark, at, " report ", kinds)) == ["Report folder", "REPORT 2.txt", "report.pdf", "report.pdf"]
    assert files.searched(spark, at, "  ").count() == 0 and files.folder(spark, f"{at}/none").count() == 0
