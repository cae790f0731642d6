"""Zstandard WARC archives with a dictionary in the leading frame: writer and reader."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.shared import Workspace, join_counted, prepare

#: Fixed values of the format: the skippable frame that holds the dictionary, and a data frame's first bytes.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


class ArchiveError(ValueError):
    """An archive breaks the format."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: object, sha: str, *parts: object) -> str:
    """The id of a page's record: with the payload's digest alone for the response of that payload, else with url mark and number."""
    return "<urn:page:" + ":".join(str(x) for x in (page, sha, *parts)) + ">"


def serialised(headers: dict[str, str], block: bytes) -> bytes:
    for name, value in headers.items():
        if "\r" in value or "\n" in value:
            raise ArchiveError(f"a line break in {name}")
    head = b"".join(f"{name}: {value}\r\n".encode() for name, value in headers.items())
    return VERSION + b"\r\n" + head + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def trained(samples: list[bytes], size: int = 16_384) -> bytes:
    """A dictionary for one archive; plain content of the samples where they are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size] or VERSION + b"\r\n"


class Writer:
    """An archive in memory: dictionary frame first, then one frame a record."""

    def __init__(self, samples: list[bytes]):
        raw = trained(samples)
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(raw), write_content_size=True, write_checksum=True)
        body = zstandard.ZstdCompressor(level=3).compress(raw)
        self.out = io.BytesIO()
        self.out.write(struct.pack("<II", DICTIONARY_MAGIC, len(body)) + body)

    def add(self, headers: dict[str, str], block: bytes) -> None:
        self.out.write(self.compressor.compress(serialised(headers, block)))

    def bytes(self) -> bytes:
        return self.out.getvalue()


def records(archive: bytes, most_bytes: int = 1 << 30) -> Iterator[Record]:
    """The records of an archive, each decoded from its own frame and validated.

    The leading skippable frame, if there is one, holds the dictionary, plain or as a
    frame; other skippable frames are passed over. Raises ArchiveError on anything
    that is cut short, unknown or inconsistent, and on records over ``most_bytes``.
    """
    view, at, loaded = memoryview(archive), 0, None
    if len(view) >= 8:
        magic, size = struct.unpack_from("<II", view)
        if magic == DICTIONARY_MAGIC:
            raw = bytes(view[8 : 8 + size])
            if len(raw) != size:
                raise ArchiveError("the dictionary is cut short")
            try:
                if raw[:4] == FRAME_MAGIC:
                    raw = zstandard.ZstdDecompressor().decompress(raw, max_output_size=most_bytes)
                loaded, at = zstandard.ZstdCompressionDict(raw), 8 + size
            except zstandard.ZstdError as error:
                raise ArchiveError(f"the dictionary does not decode: {error}") from error
    while at < len(view):
        if len(view) - at < 8:
            raise ArchiveError("bytes after the last frame")
        magic, size = struct.unpack_from("<II", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + size
            if at > len(view):
                raise ArchiveError("a skippable frame is cut short")
            continue
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise ArchiveError("no frame where one must begin")
        decoder = zstandard.ZstdDecompressor(**({"dict_data": loaded} if loaded else {})).decompressobj()
        parts, got = [], 0
        while not decoder.eof:
            if at >= len(view):
                raise ArchiveError("a frame is cut short")
            step = view[at : at + (1 << 16)]
            try:
                parts.append(decoder.decompress(step))
            except zstandard.ZstdError as error:
                raise ArchiveError(f"a frame does not decode: {error}") from error
            got += len(parts[-1])
            if got > most_bytes:
                raise ArchiveError("a record is too long")
            at += len(step) - len(decoder.unused_data)
        yield parsed(b"".join(parts))


def parsed(raw: bytes) -> Record:
    """One record with its version line, headers, length, block and end marks checked."""
    head, mark, rest = raw.partition(b"\r\n\r\n")
    first, _, lines = head.partition(b"\r\n")
    if not mark or first not in (b"WARC/1.0", VERSION):
        raise ArchiveError("no version line")
    headers: dict[str, str] = {}
    try:
        told = lines.decode("utf-8")
    except UnicodeDecodeError as error:
        raise ArchiveError("headers that are not UTF-8") from error
    for line in told.split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise ArchiveError(f"not a header: {line[:80]!r}")
        if name.lower() in headers and name.lower() != "warc-concurrent-to":
            raise ArchiveError(f"{name} stands twice")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise ArchiveError(f"{name} is missing")
    size = _length(headers, "content-length")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ArchiveError("the block is not as long as it says")
    return Record(headers, rest[:size])


def _length(headers: dict[str, str], name: str) -> int:
    value = headers.get(name, "")
    if not (value.isascii() and value.isdigit() and len(value) < 19):
        raise ArchiveError(f"{name} is no number")
    return int(value)


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = 8_000_000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(path, content): archives with one record a page, as a binary file source would show them.

    The payload is the page's html in UTF-8, empty for null. Of pages with equal
    payloads of at least ``min_bytes`` bytes that with the largest id is a response
    (of several with that id the one with the largest url), and the others are
    revisits without a block that refer to it; shorter ones are all responses. A null
    id is smaller than any other. Rows that are equal in all of this are told apart
    by a number, so every record has an id of its own. Of equal payloads one moves,
    combined before the shuffle; all else moves without payloads, counted by id and
    url, and the responses of frequent payloads go to their revisits by broadcast, so a
    payload that many pages share gathers nowhere.
    """
    prepare(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("body")).withColumn("sha", F.sha1("body"))
    long, short = keyed.where(F.length("body") >= min_bytes), keyed.where(F.length("body") < min_bytes)
    first = long.groupBy("sha").agg(F.max(F.struct("id", "url", "body")).alias("top"))
    responses = first.select("top.id", "top.url", "top.body", "sha", F.lit(None).cast("int").alias("copy"), F.lit(None).cast(keyed.schema["id"].dataType).alias("refers"), F.length("top.body").alias("size"))
    same = long.groupBy("sha", "id", "url").agg(F.count("*").cast("int").alias("n"), F.first(F.length("body")).alias("size"))
    tops = long.groupBy("sha").agg(F.max(F.struct("id", "url")).alias("top"), F.count("*").alias("n")).where("n > 1")
    tops = Workspace(pages.sparkSession, "warc-tops").keep(tops, "tops")
    is_top = F.struct("id", "url").eqNullSafe(F.col("top"))
    others = join_counted(same, tops, ["sha"]).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).where(~(is_top & (F.col("copy") == 0)))
    revisits = others.select("id", "url", F.lit(None).cast("binary").alias("body"), "sha", "copy", F.col("top.id").alias("refers"), "size")
    told = responses.withColumn("kind", F.lit("response")).unionByName(revisits.withColumn("kind", F.lit("revisit")))
    if min_bytes > 0:
        few = short.groupBy("sha", "id", "url").agg(F.count("*").cast("int").alias("n"), F.first("body").alias("body"))
        few = few.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("size", F.length("body"))
        told = told.unionByName(few.select("id", "url", "body", "sha", "copy", F.lit(None).cast(keyed.schema["id"].dataType).alias("refers"), "size", F.lit("response").alias("kind")))
    told = told.select("kind", "id", "size", F.upper("sha").alias("sha"), "copy", "refers", F.hex(F.xxhash64("url")).alias("mark"), "url", "body")

    def write(batches):
        writer, held, number = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                mine = row["body"]
                if writer is None:
                    writer, held = Writer([r["body"] for r in batch.slice(0, 128).to_pylist() if r["body"]]), 0
                sha = base64.b32encode(bytes.fromhex(row["sha"])).decode()
                headers = {
                    "WARC-Type": row["kind"],
                    "WARC-Record-ID": record_id(row["id"], sha, *([] if row["copy"] is None else [row["mark"], row["copy"]])),
                    "WARC-Date": DATE,
                    "WARC-Payload-Digest": f"sha1:{sha}",
                    "X-Payload-Length": str(row["size"]),
                }
                if row["url"] and not any(c in row["url"] for c in "\r\n"):
                    headers["WARC-Target-URI"] = row["url"]
                if row["kind"] == "revisit":
                    headers |= {"WARC-Refers-To": record_id(row["refers"], sha), "WARC-Profile": REVISIT_PROFILE}
                writer.add(headers, mine or b"")
                held += len(mine or b"") + 400
                if held >= archive_bytes:
                    yield _file(number, writer)
                    writer, number = None, number + 1
        if writer is not None:
            yield _file(number, writer)

    return told.mapInArrow(write, "path string, content binary").withColumn("path", F.concat(F.format_string("pages-%06d-", F.spark_partition_id()), "path"))


def _file(number: int, writer: Writer) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([f"{number:06d}.warc.zst"]), pa.array([writer.bytes()], pa.binary())], names=["path", "content"])


def read_archives(files: DataFrame) -> DataFrame:
    """One row a record of (path, content) files: headers and block, checked.

    Columns: path, record_id, record_type, refers_to, target, payload_bytes,
    payload_digest, block. The digest of a response is recomputed and must be the
    one its header gives, if any; length and digest of a revisit are those its
    headers give, and a revisit must have both, its profile and what it refers to. A
    file that breaks the format fails the job with ArchiveError. An empty file or
    table has no records.
    """
    prepare(files.sparkSession)
    schema = "path string, record_id string, record_type string, refers_to string, target string, payload_bytes long, payload_digest string, block binary"
    names = [part.split(" ")[0] for part in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held = [], 0
                for record in records(content or b""):
                    rows.append(_told(path, record))
                    held += len(record.block)
                    if held > 8_000_000 or len(rows) >= 1000:
                        yield _batch(rows, names)
                        rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return files.select("path", "content").mapInArrow(read, schema)


def _told(path: str, record: Record) -> tuple:
    get = record.headers.get
    kind, given = get("warc-type"), (get("warc-payload-digest") or "").removeprefix("sha1:")
    if kind == "revisit":
        if get("warc-profile") != REVISIT_PROFILE or not get("warc-refers-to") or not given or record.block:
            raise ArchiveError("a revisit without profile, reference or digest, or with a block")
        size, mark = _length(record.headers, "x-payload-length"), given
    else:
        size, mark = len(record.block), digest(record.block)
        if given and given != mark:
            raise ArchiveError("a payload differs from its digest")
    return path, get("warc-record-id"), kind, get("warc-refers-to"), get("warc-target-uri"), size, mark, record.block


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = [*[pa.string()] * 5, pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
