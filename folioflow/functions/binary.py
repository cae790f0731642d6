"""Hashes, magic bytes, flags and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# First bytes of image files, in hex.
MAGIC = (("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("424D", "bmp"), ("49492A00", "tiff"), ("4D4D002A", "tiff"))


def image_kind(data: Column) -> Column:
    """Kind of an image by its first bytes; unknown for others."""
    head = F.hex(F.substring(data, 1, 12))
    kind = F.when(head.startswith(MAGIC[0][0]), MAGIC[0][1])
    for mark, name in MAGIC[1:]:
        kind = kind.when(head.startswith(mark), name)
    return kind.when(head.startswith("52494646") & head.endswith("57454250") & (F.length(head) == 24), "webp").otherwise("unknown")


def style_flags(*flags: Column) -> Column:
    """Booleans as bits, the first lowest."""
    total = F.lit(0)
    for n, flag in enumerate(flags):
        total = total + F.when(flag, 1 << n).otherwise(0)
    return total


def flag(bits: Column, n: int) -> Column:
    return bits.bitwiseAND(1 << n) != 0


def content_key(c: Column) -> Column:
    return F.sha1(c.cast("binary"))


def version_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary"))


def file_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_of(path), r"[^.]\.([^.]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_replace(file_of(path), r"(?<=.)\.[^.]*$", "")


def parent(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
