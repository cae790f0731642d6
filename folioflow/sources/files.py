"""Directory listings, the JSON library and dispatch by extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.functions import binary as b
from folioflow.sources import markdown, plain_text, word, workbook

#: Readers by extension; csv is read as plain text.
READERS = {"docx": "docx", "md": "markdown", "markdown": "markdown", "txt": "text", "text": "text", "log": "text", "csv": "text", "xlsx": "xlsx"}

LIBRARY = "path string, lastOpened long, starred boolean, lastPage int, pageCount int, bookmarks array<struct<page:int,label:string,created:long>>"


def listing(spark: SparkSession, folder: str, extensions: list[str] | None = None, recursive: bool = False) -> DataFrame:
    """(path, name, extension, size, modified) of files, dot files left out; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    rows = files.select("path", b.file_of(F.col("path")).alias("name"), b.extension(F.col("path")).alias("extension"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    rows = rows.where(~F.col("name").startswith("."))
    return rows.where(F.col("extension").isin(*extensions)) if extensions else rows


ENTRIES = "path string, name string, extension string, directory boolean, size long, modified timestamp"
#: What a listing is sorted by.
SORTS = ("name", "date", "size")


def folder(spark: SparkSession, path: str, extensions: list[str] | None = None, sort: str = "date", descending: bool = True) -> DataFrame:
    """(path, name, extension, directory, size, modified) of a folder: its folders, and its files with one of ``extensions``; dot files are left out.

    Folders come first, then files; both by name (whatever the case), date or size, but folders by
    name where files are by size. What a store lists of one folder is told by its own listing, so no content is read.
    A folder that is not there is empty.
    """
    if sort not in SORTS:
        raise ValueError(f"no sort {sort}")
    rows = _entries(spark, path, False).where(F.col("directory") | F.col("extension").isin(*extensions)) if extensions else _entries(spark, path, False)
    by = {"name": F.lower("name"), "date": F.col("modified"), "size": F.when(~F.col("directory"), F.col("size"))}[sort]
    first = F.when(F.col("directory") & F.lit(sort == "size"), F.col("name"))
    return rows.orderBy(F.desc("directory"), first, F.desc_nulls_last(by) if descending else F.asc_nulls_last(by), "path")


def searched(spark: SparkSession, path: str, query: str, extensions: list[str] | None = None) -> DataFrame:
    """Folders and files below a folder, at any depth, whose name holds ``query``, whatever the case, sorted by name; a blank query finds none."""
    wanted = query.strip().lower()
    rows = _entries(spark, path, True) if wanted else spark.createDataFrame([], ENTRIES)
    rows = rows.where(F.contains(F.lower("name"), F.lit(wanted)) & (F.col("directory") | (F.col("extension").isin(*extensions) if extensions else F.lit(True))))
    return rows.orderBy(F.desc("directory"), F.lower("name"), "path")


def _entries(spark: SparkSession, path: str, deep: bool) -> DataFrame:
    """Entries of a folder that don't begin with a dot, from the store's own listings, level by level if ``deep``; as Spark's sources list files, in the driver."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    store = root.getFileSystem(conf)
    rows, level = [], [root] if store.exists(root) else []
    while level:
        found = [x for folder in level for x in store.listStatus(folder)]
        level = []
        for x in found:
            name = x.getPath().getName()
            if deep and x.isDirectory():
                level.append(x.getPath())
            if not name.startswith("."):
                rows.append((x.getPath().toString(), name, x.isDirectory(), 0 if x.isDirectory() else x.getLen(), x.getModificationTime()))
    listed = spark.createDataFrame(rows, "path string, name string, directory boolean, size long, ms long")
    return listed.select("path", "name", F.when(~F.col("directory"), b.extension(F.col("path"))).alias("extension"), "directory", "size", F.timestamp_millis("ms").alias("modified"))


def found_by_name(files: DataFrame, query: str) -> DataFrame:
    """Files whose name holds the query, whatever the case; an empty query finds none."""
    return files.where(F.contains(F.lower("name"), F.lit(query.lower()))) if query else files.limit(0)


def reader_of(path: str = "path"):
    """The reader that an extension asks for, or null."""
    pairs = [F.lit(x) for item in READERS.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), b.extension(F.col(path)))


def library(spark: SparkSession, path: str) -> DataFrame:
    """The library's records; missing fields get their defaults. Broken lines are no records; ``broken_lines`` has them."""
    return _told(spark, path).where("path is not null").select("path", F.timestamp_millis("lastOpened").alias("last_opened"), F.coalesce("starred", F.lit(False)).alias("starred"), F.coalesce("lastPage", F.lit(0)).alias("last_page"), F.col("pageCount").alias("page_count"), F.coalesce("bookmarks", F.array()).alias("bookmarks"))


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of the library's lines that are no records, so that none is lost without a word."""
    return _told(spark, path).where("path is null").select(F.coalesce("line", F.to_json(F.struct("lastOpened", "starred", "lastPage", "pageCount"))).alias("line"))


def _told(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{LIBRARY}, line string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "line").json(path)


def read_documents(files: DataFrame) -> DataFrame:
    """The blocks of (path, content) files by the reader that each extension asks for; others are left out."""
    wanted = files.select("path", "content", reader_of().alias("reader")).where("reader is not null")
    text = lambda kind: wanted.where(F.col("reader") == kind).select("path", F.decode("content", "UTF-8").alias("text"))
    data = lambda kind: wanted.where(F.col("reader") == kind).select("path", "content")
    plain = plain_text.as_blocks(plain_text.read_blocks(text("text"), "path"))
    parts = [markdown.read_blocks(text("markdown"), "path"), word.read_blocks(data("docx"), "path"), workbook.read_blocks(data("xlsx"), "path")]
    for part in parts:
        plain = plain.unionByName(part, allowMissingColumns=True)
    return plain


def recents(records: DataFrame) -> DataFrame:
    """Opened records, newest first."""
    return records.where("last_opened is not null").orderBy(F.desc("last_opened"), "path")
