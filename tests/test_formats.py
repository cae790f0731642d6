"""Document files as data sources: round trips, commits, names, pruning."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from folioflow import formats
from folioflow.sinks import word, workbook

PNG = b"\x89PNG\r\n\x1a\n" + b"data"


def span(text, **style):
    return {"text": text, **style}


DOCS = {
    "letter": [{"kind": "heading", "level": 1, "spans": [span("Dear all")]}, {"kind": "paragraph", "spans": [span("some "), span("bold", bold=True), span(" words")]}],
    "lists": [{"kind": "list_item", "ordered": True, "indent": 0, "spans": [span(f"item {n}")]} for n in range(3)],
    "grid": [{"kind": "heading", "level": 2, "spans": [span("Numbers")]}, {"kind": "table", "rows": [["a", "b"], ["1", "2"]], "has_header": True}],
}


def blocks_of(spark, docs=DOCS):
    rows = [{"doc_id": key, "block_no": n, **block} for key, held in docs.items() for n, block in enumerate(held)]
    schema = "doc_id string, " + formats.b.FIELDS
    names = [f.split(" ")[0] for f in ("doc_id", "block_no", "kind", "level", "ordered", "indent", "spans", "rows", "has_header", "bytes")]
    full = [{**{n: None for n in names}, **r} for r in rows]
    for r in full:
        if r["spans"]:
            r["spans"] = [{**{k: None for k in ("text", *formats.b.STYLE)}, **s} for s in r["spans"]]
    df = spark.createDataFrame([[r.get(f) for f in (x.name for x in formats.StructType.fromDDL(schema).fields)] for r in full], schema)
    return df.orderBy(F.rand(3))


def listed(folder):
    return sorted(os.path.relpath(os.path.join(top, name), folder) for top, _, names in os.walk(folder) for name in names)


def texts(df):
    rows = df.select("path", "block_no", "kind", F.array_join(F.transform(F.coalesce("spans", F.array().cast(df.schema["spans"].dataType)), lambda s: s["text"]), "").alias("text"), "rows").collect()
    return {(os.path.basename(r["path"]).split(".")[0], r["block_no"]): (r["kind"], r["text"], r["rows"]) for r in rows}


@pytest.mark.parametrize("kind, source", [("docx", "docx"), ("md", "markdown"), ("blocks", "blockcache")])
def test_blocks_come_back_from_files(spark, tmp_path, kind, source):
    formats.export(blocks_of(spark), str(tmp_path), kind)
    assert listed(tmp_path) == sorted(f"{name}.{kind}" for name in DOCS)
    got = texts(spark.read.format(source).load(str(tmp_path)))
    assert got[("letter", 0)][:2] == ("heading", "Dear all") and got[("letter", 1)][:2] == ("paragraph", "some bold words")
    assert [got[("lists", n)][1] for n in range(3)] == ["item 0", "item 1", "item 2"] and got[("grid", 1)][2] == [["a", "b"], ["1", "2"]]


def test_docx_to_xlsx_and_to_text(spark, tmp_path):
    formats.export(blocks_of(spark), str(tmp_path / "docx"), "docx")
    read = spark.read.format("docx").load(f"file://{tmp_path}/docx")
    formats.export(read, str(tmp_path / "xlsx"), "xlsx", id_col="path")
    assert listed(tmp_path / "xlsx") == ["grid.xlsx", "letter.xlsx", "lists.xlsx"]
    tables = {(os.path.basename(r["path"]), tuple(map(tuple, r["rows"]))) for r in spark.read.format("xlsx").load(str(tmp_path / "xlsx")).where("kind = 'table'").collect()}
    assert ("grid.xlsx", (("a", "b"), ("1", "2"))) in tables
    formats.export(read, str(tmp_path / "txt"), "txt", id_col="path")
    assert (tmp_path / "txt" / "lists.txt").read_text() == "1. item 0\n2. item 1\n3. item 2\n"
    formats.export(read, str(tmp_path / "html"), "html", id_col="path")
    assert "<b>bold</b>" in (tmp_path / "html" / "letter.html").read_text() or "<strong>bold</strong>" in (tmp_path / "html" / "letter.html").read_text()
    again = spark.read.format("plaintext").load(str(tmp_path / "txt"))
    assert {r["kind"] for r in again.where("path like '%lists.txt'").collect()} == {"list_item"}


def test_names_are_free_ones_and_overwriting_takes_the_rest_away(spark, tmp_path):
    (tmp_path / "letter.docx").write_bytes(b"was here")
    one = {"a/letter.x": DOCS["letter"], "b/letter.y": DOCS["lists"], "c?:d": DOCS["grid"]}
    formats.export(blocks_of(spark, one), str(tmp_path), "docx")
    assert listed(tmp_path) == ["c__d.docx", "letter (2).docx", "letter (3).docx", "letter.docx"]
    assert (tmp_path / "letter.docx").read_bytes() == b"was here"
    formats.export(blocks_of(spark, one), str(tmp_path), "docx", overwrite=True)
    assert listed(tmp_path) == ["c__d.docx", "letter (2).docx", "letter.docx"]


def test_a_failed_task_leaves_no_file(spark, tmp_path):
    formats.register(spark)
    rows = spark.range(8, numPartitions=4).select(F.concat(F.lit("d"), "id").alias("doc_id"), F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.lit("x")).alias("content"))
    with pytest.raises(Exception, match="broken"):
        rows.write.format("contents").option("extension", "txt").mode("append").save(str(tmp_path))
    assert listed(tmp_path) == [] and os.listdir(tmp_path) == []
    rows.where("id < 7").write.format("contents").option("extension", "txt").mode("append").save(str(tmp_path))
    assert listed(tmp_path) == [f"d{n}.txt" for n in range(7)]


def test_torn_documents_are_told(spark, tmp_path):
    formats.register(spark)
    torn = blocks_of(spark).repartition(5, "block_no")
    with pytest.raises(Exception, match="several partitions|stand together"):
        torn.write.format("docx").option("id", "doc_id").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []
    with pytest.raises(Exception, match="stand together"):
        torn.coalesce(1).sortWithinPartitions("block_no").write.format("docx").option("id", "doc_id").mode("append").save(str(tmp_path))
    assert os.listdir(tmp_path) == []


def test_images_make_markdown_an_archive(spark, tmp_path):
    docs = {"pictures": [{"kind": "paragraph", "spans": [span("see")]}, {"kind": "image", "bytes": PNG}]}
    formats.export(blocks_of(spark, docs), str(tmp_path), "md")
    with zipfile.ZipFile(tmp_path / "pictures.zip") as archive:
        assert sorted(archive.namelist()) == ["image-1.png", "pictures.md"] and archive.read("image-1.png") == PNG
        assert b"(image-1.png)" in archive.read("pictures.md")


def test_filters_on_paths_open_only_these_files(spark, tmp_path):
    formats.register(spark)
    for n in range(5):
        (tmp_path / f"ok{n}.docx").write_bytes(word.document([{"kind": "paragraph", "spans": [span(f"text {n}")]}]))
    (tmp_path / "broken.docx").write_bytes(b"no archive")
    (tmp_path / ".hidden.docx").write_bytes(b"no archive")
    (tmp_path / "deeper").mkdir()
    (tmp_path / "deeper" / "book.xlsx").write_bytes(workbook.workbook(workbook.sheets_of([{"kind": "table", "rows": [["x"]]}])))
    docs = spark.read.format("docx").load(str(tmp_path))
    with pytest.raises(Exception, match="(?i)zip|valueerror|not a"):
        docs.collect()
    assert [r["block_no"] for r in docs.where(F.col("path") == f"{tmp_path}/ok3.docx").collect()] == [0]
    assert docs.where(F.col("path").startswith(f"{tmp_path}/ok")).count() == 5
    assert docs.where(F.col("path").isin(f"{tmp_path}/ok1.docx", f"{tmp_path}/ok2.docx")).where("block_no = 0").count() == 2
    assert docs.where(F.col("path").endswith("ok4.docx")).select("kind").collect()[0]["kind"] == "paragraph"
    assert spark.read.format("docx").option("mode", "DROPMALFORMED").load(str(tmp_path)).count() == 5
    assert spark.read.format("docx").option("pathGlobFilter", "ok[12]*").schema("path string, kind string").load(str(tmp_path)).columns == ["path", "kind"]
    assert spark.read.format("xlsx").option("recursive", "true").load(str(tmp_path)).count() > 0 and spark.read.format("xlsx").load(str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="nowhere"):
        spark.read.format("docx").load(str(tmp_path / "nowhere")).collect()


def test_partitions_hold_at_most_so_many_bytes():
    import tempfile

    folder = tempfile.mkdtemp(prefix="formats-")
    for n in range(7):
        with open(f"{folder}/{n}.docx", "wb") as f:
            f.write(b"x" * 100)
    read = lambda most: formats.Reader(formats.KINDS["docx"], {"path": folder, "maxPartitionBytes": str(most)}, formats.StructType())
    assert [len(p.paths) for p in read(3 * formats.OPEN_COST).partitions()] == [3, 3, 1]
    assert [len(p.paths) for p in read(1).partitions()] == [1] * 7
