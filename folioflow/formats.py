"""Document files as Spark data sources: ``spark.read.format("docx")`` and ``df.write.format("xlsx")`` after ``register(spark)``.

A source reads files into the block table and writes a file for each document. Files
are reached through ``pyarrow.fs``, in every store that it knows; what only Spark can
open is read with ``binaryFile`` and the readers of ``folioflow.sources`` instead.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zipfile
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase
from itertools import groupby

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioflow import blocks as b
from folioflow.operators import windows as w
from folioflow.sinks import block_cache as cache_sink
from folioflow.sinks import html, markdown, plain_text, word, workbook
from folioflow.sources import block_cache as cache_source
from folioflow.sources import markdown as markdown_source
from folioflow.sources import plain_text as text_source
from folioflow.sources import word as word_source
from folioflow.sources import workbook as workbook_source

#: A file counts as so many bytes at least where files are packed into partitions.
OPEN_COST = 4 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI and the path inside it."""
    path = re.sub(r"^file:/+", "file:///", path)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


# ---- what a kind of file reads and writes


def _text_blocks(data: bytes) -> Iterator[b.Block]:
    for kind, text, ordered, marker, indent in text_source.text_blocks(data.decode("utf-8", "replace")):
        yield {"kind": kind, "ordered": ordered, "marker": marker, "indent": indent, "spans": None if text is None else [{"text": text}]}


def _markdown_file(blocks: list[b.Block], base: str) -> tuple[str, bytes]:
    """Markdown; with images an archive of it and of these, under the names it links to."""
    text = markdown.text(blocks).encode("utf-8", "surrogatepass")
    images = [x["bytes"] for x in blocks if x["kind"] == "image" and (x.get("bytes") or b"").startswith((b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff"))]
    if not images:
        return ".md", text
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr(f"{base}.md", text)
        for n, data in enumerate(images, 1):
            archive.writestr(f"image-{n}.{'jpg' if data.startswith(bytes((0xFF, 0xD8, 0xFF))) else 'png'}", data)
    return ".zip", out.getvalue()


@dataclass(frozen=True)
class Kind:
    """File extensions that are read, and how; how a document's blocks become (extension, bytes)."""

    extensions: tuple[str, ...]
    parse: Callable[[bytes], Iterable[b.Block]] | None
    render: Callable[[list[b.Block], str], tuple[str, bytes]] | None


KINDS = {
    "docx": Kind(("docx",), word_source.document_blocks, lambda blocks, _: (".docx", word.document(blocks))),
    "xlsx": Kind(("xlsx",), workbook_source.workbook_blocks, lambda blocks, _: (".xlsx", workbook.workbook(workbook.sheets_of(blocks)))),
    "markdown": Kind(("md", "markdown"), lambda data: markdown_source.markdown_blocks(data.decode("utf-8", "replace")), _markdown_file),
    "plaintext": Kind(("txt", "text", "log", "csv"), _text_blocks, None),
    "html": Kind(("html",), None, lambda blocks, _: (".html", html.page(blocks).encode("utf-8", "surrogatepass"))),
    "blockcache": Kind(("blocks",), cache_source.decoded, lambda blocks, _: (".blocks", cache_sink.encoded(blocks))),
}


# ---- reading


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class Reader(DataSourceReader):
    """Blocks of the files of a folder, or of one file.

    Options: ``path``; ``recursive`` (false); ``pathGlobFilter`` for names; ``mode`` (FAILFAST,
    or DROPMALFORMED: a file that can't be read has no blocks); ``maxPartitionBytes``
    (128 MiB). Files whose names begin with a dot or underscore are left out. Filters on ``path``
    choose the files before any is opened, and a schema of fewer columns reads these only.
    """

    def __init__(self, kind: Kind, options: dict, schema: StructType):
        self.kind, self.schema = kind, schema
        self.root = options.get("path", "")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.names = options.get("pathGlobFilter")
        self.malformed = options.get("mode", "FAILFAST").upper()
        self.most = int(options.get("maxPartitionBytes", 128 << 20))
        self.filters: list[Filter] = []
        if not self.root:
            raise ValueError("give the folder or file to read: load(path)")

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith) and f.attribute == ("path",):
                self.filters.append(f)
            else:
                yield f

    def _wanted(self, path: str) -> bool:
        tests = {EqualTo: lambda f: path == f.value, In: lambda f: path in f.value, StringStartsWith: lambda f: path.startswith(f.value), StringEndsWith: lambda f: path.endswith(f.value)}
        return all(tests[type(f)](f) for f in self.filters)

    def partitions(self) -> list[Files]:
        store, root = located(self.root)
        found = store.get_file_info(root)
        if found.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        below = len(root.rstrip("/")) + 1
        if found.type == fs.FileType.Directory:
            found = [x for x in store.get_file_info(fs.FileSelector(root, recursive=self.recursive)) if x.is_file and not any(p.startswith((".", "_")) for p in x.path[below:].split("/"))]
            found = [x for x in found if x.extension.lower() in self.kind.extensions]
        else:
            found = [found]
        found = [x for x in found if self._wanted(x.path) and (self.names is None or fnmatchcase(x.base_name, self.names))]
        parts, size = [], self.most
        for x in sorted(found, key=lambda x: x.path):
            if size + max(x.size, OPEN_COST) > self.most and size:
                parts.append(Files([]))
                size = 0
            parts[-1].paths.append(x.path)
            size += max(x.size, OPEN_COST)
        return parts or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = located(self.root)
        arrow, rows = to_arrow_schema(self.schema), []
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                data = f.read()
            try:
                found = list(self.kind.parse(data))
            except ValueError:
                if self.malformed != "DROPMALFORMED":
                    raise
                continue
            for number, block in enumerate(found):
                rows.append({"path": path, "block_no": number, **block})
                if len(rows) >= b.CHUNK:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                    rows = []
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)


# ---- writing


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: its partition, its folder and the number of files in it."""

    partition: int
    folder: str
    files: int


class Writer(DataSourceArrowWriter):
    """A file for each run of rows with one id: its blocks, or, with ``content``, its bytes.

    A task writes into a folder of its own under a hidden staging folder. Only when all
    tasks are done does the commit move their files to the target, each under a name
    that is free there: ``name.ext``, else ``name (2).ext`` and so on, by partition and
    place. A failed task or job leaves no file: staging folders are hidden from readers and
    go with commit and abort. An id whose rows are in two partitions, or apart in one, is
    an error, as its file would be torn; ``export`` brings each document together.
    """

    def __init__(self, kind: Kind | None, options: dict, schema: StructType, overwrite: bool):
        self.kind, self.overwrite = kind, overwrite
        self.root = options.get("path", "")
        if not self.root:
            raise ValueError("give the folder to write to: save(path)")
        self.id = options.get("id", schema.fieldNames()[0])
        self.extension = options.get("extension", "").lstrip(".")
        if self.id not in schema.fieldNames():
            raise ValueError(f"no column {self.id}")
        if kind is None and not ("content" in schema.fieldNames() and self.extension):
            raise ValueError("a column content and the option extension are needed")
        if kind is not None and (kind.render is None or "kind" not in schema.fieldNames()):
            raise ValueError("blocks are needed, and a format that is written")
        store, root = located(self.root)
        self.stage = f"{root.rstrip('/')}/.staging-{uuid.uuid4().hex}"
        store.create_dir(self.stage, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        task = TaskContext.get()
        store, _ = located(self.root)
        folder = f"{self.stage}/{task.partitionId():06d}-{task.taskAttemptId()}"
        store.create_dir(folder, recursive=False)  # fails where the job was given up meanwhile
        rows = (row for batch in iterator for row in batch.to_pylist())
        done: set[bytes] = set()
        for key, held in groupby(rows, lambda row: row[self.id]):
            mark = hashlib.blake2b(repr(key).encode("utf-8", "surrogatepass"), digest_size=16)
            if mark.digest() in done:
                raise ValueError(f"the rows of {key!r} don't stand together; use export() or sort by {self.id}")
            base = file_base(key)
            if self.kind is None:
                content = next(held)["content"]
                if next(held, None) is not None:
                    raise ValueError(f"{key!r} has several contents")
                ending, data = f".{self.extension}", content.encode("utf-8", "surrogatepass") if isinstance(content, str) else content or b""
            else:
                blocks = sorted(held, key=lambda row: row.get("block_no") or 0)
                ending, data = self.kind.render([{k: v for k, v in x.items() if v is not None and k != self.id} for x in blocks], base)
            with store.open_output_stream(f"{folder}/{len(done):08d}-{mark.hexdigest()}-{base}{ending}") as out:
                out.write(data)
            done.add(mark.digest())
        return Staged(task.partitionId(), folder, len(done))

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves are made one after the other, as in Spark's own commits; what the driver holds is a list of names."""
        store, root = located(self.root)
        told = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        staged = [sorted(x.path for x in store.get_file_info(fs.FileSelector(m.folder))) if m.files else [] for m in told]
        names = [path.rsplit("/", 1)[1].split("-", 2) for paths in staged for path in paths]
        if any(len(paths) != m.files for paths, m in zip(staged, told)) or len({n[1] for n in names}) != len(names):
            self.abort(messages)
            raise ValueError(f"the rows of a document are in several partitions; use export() or repartition by {self.id}")
        if self.overwrite:
            for x in store.get_file_info(fs.FileSelector(root)):
                if not x.base_name.startswith((".", "_")):
                    (store.delete_dir if x.type == fs.FileType.Directory else store.delete_file)(x.path)
        for path, (_, _, name) in zip((p for paths in staged for p in paths), names):
            store.move(path, free_path(store, root.rstrip("/"), name))
        self.abort(messages)

    def abort(self, messages: list[Staged | None]) -> None:
        store, _ = located(self.root)
        if store.get_file_info(self.stage).type == fs.FileType.Directory:
            store.delete_dir(self.stage)


def file_base(key: object) -> str:
    """The base name of a document's file: its id, if a path then its last part without extension, without signs that file names can't have."""
    name = str(key if key is not None else "").rsplit("/", 1)[-1]
    stem = re.sub(r"(?<=.)\.[^.]*$", "", name) if "/" in str(key) else name
    return re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", stem).strip() or "Untitled"


def free_path(store: fs.FileSystem, folder: str, name: str) -> str:
    """A path for ``name`` in ``folder`` that nothing has: itself, or with `` (2)``, `` (3)`` before the extension."""
    stem, dot, ending = name.rpartition(".")
    stem, ending = (stem, dot + ending) if stem else (name, "")
    path, n = f"{folder}/{name}", 2
    while store.get_file_info(path).type != fs.FileType.NotFound:
        path, n = f"{folder}/{stem} ({n}){ending}", n + 1
    return path


# ---- the sources


class _Blocks(DataSource):
    kind: str

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return f"path string, {b.FIELDS}"

    def reader(self, schema: StructType) -> Reader:
        if KINDS[self.kind].parse is None:
            raise ValueError(f"{self.kind} is only written")
        return Reader(KINDS[self.kind], dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(KINDS[self.kind], dict(self.options), schema, overwrite)


class Docx(_Blocks):
    kind = "docx"


class Xlsx(_Blocks):
    kind = "xlsx"


class Markdown(_Blocks):
    kind = "markdown"


class PlainText(_Blocks):
    kind = "plaintext"


class Html(_Blocks):
    kind = "html"


class BlockCache(_Blocks):
    kind = "blockcache"


class Contents(DataSource):
    """Only written: a file of the option ``extension`` for each row (id, content)."""

    @classmethod
    def name(cls) -> str:
        return "contents"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(None, dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the formats docx, xlsx, markdown, plaintext, html, blockcache and contents known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (Docx, Xlsx, Markdown, PlainText, Html, BlockCache, Contents):
        spark.dataSource.register(source)


#: What an export is called, and the format that writes it.
EXPORTS = {"docx": "docx", "xlsx": "xlsx", "md": "markdown", "html": "html", "blocks": "blockcache", "txt": "contents"}


def export(blocks: DataFrame, folder: str, kind: str, id_col: str = "doc_id", overwrite: bool = False) -> None:
    """K9: each document's blocks as a file of ``kind`` in ``folder``, under names that are free there.

    Rows are dealt by document and sorted in it, so a task holds one document at a time.
    """
    if kind not in EXPORTS:
        raise ValueError(f"no export {kind}; there are {', '.join(EXPORTS)}")
    if kind == "txt":
        out = plain_text.rendered(numbered_items(blocks, id_col), id_col).select(id_col, F.col("text").alias("content")).repartition(id_col).sortWithinPartitions(id_col)
    else:
        known = [part.name for part in StructType.fromDDL(b.FIELDS).fields if part.name in blocks.columns]
        out = blocks.select(id_col, *known).repartition(id_col).sortWithinPartitions(id_col, "block_no")
    save(out, folder, EXPORTS[kind], overwrite, id=id_col, extension=kind)


def save(df: DataFrame, folder: str, source: str, overwrite: bool = False, **options: str) -> None:
    register(df.sparkSession)
    df.write.format(source).options(**options).mode("overwrite" if overwrite else "append").save(folder)


def numbered_items(blocks: DataFrame, id_col: str) -> DataFrame:
    """Blocks with their spans as one text and ordered items numbered in the run that they stand in."""
    text = F.when(F.col("spans").isNotNull(), F.array_join(F.transform("spans", lambda s: F.coalesce(s["text"], F.lit(""))), ""))
    rows = blocks.withColumn("text", text).withColumn("_row", F.col("block_no"))
    runs = w.islands(rows, F.col("kind") != "list_item", [id_col], ["_row"])
    return w.ranked(runs, [id_col, "island", "indent", "ordered"], [F.col("_row")], "number").drop("_row", "island")
