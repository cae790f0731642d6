"""Planes that are larger than a row should be: tables of tiles, and kernels over them that see past a tile's edge."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from folioflow.operators.scans import KERNELS

#: How far each kernel sees, from its parameters; kernels that need the whole plane are not here.
REACH = {
    "box_blur": lambda radius: radius,
    "local_mean": lambda radius: radius,
    "local_variance": lambda radius: radius,
    "smallest": lambda radius: radius,
    "largest": lambda radius: radius,
    "gaussian": lambda sigma: max(1, math.ceil(3 * sigma)),
    "black_white": lambda radius: radius + 1,  # the threshold, then the eight neighbours of a speck
}
_TILE = "tile_y int, tile_x int, full_width int, full_height int, width int, height int, pixels array<double>"


def tiled(pixels: DataFrame, key: str, y: str, x: str, value: str, side: int = 1024) -> DataFrame:
    """(key, tile_y, tile_x, full_width, full_height, width, height, pixels) from a row a pixel; a tile has at most ``side`` rows and columns.

    Every pixel of a plane must be there once, from (0, 0) on; a plane with others is left out.
    """
    rows = pixels.select(F.col(key).alias("_k"), F.col(y).cast("int").alias("_y"), F.col(x).cast("int").alias("_x"), F.col(value).cast("double").alias("_v"))
    whole = rows.groupBy("_k").agg((F.max("_y") + 1).alias("full_height"), (F.max("_x") + 1).alias("full_width"), F.count("_v").alias("n"), F.min(F.least("_y", "_x")).alias("low"))
    whole = whole.where("low = 0 and n = cast(full_height as bigint) * full_width").select("_k", "full_width", "full_height")
    at = [F.floor(F.col(c) / side).cast("int").alias(n) for c, n in (("_y", "tile_y"), ("_x", "tile_x"))]
    held = rows.groupBy("_k", *at).agg(F.array_sort(F.collect_list(F.struct("_y", "_x", "_v"))).alias("held"))
    edge = lambda full, tile: F.least(F.lit(side), F.col(full) - F.col(tile) * side).cast("int")
    out = held.join(whole, "_k").select(F.col("_k").alias(key), "tile_y", "tile_x", "full_width", "full_height", edge("full_width", "tile_x").alias("width"), edge("full_height", "tile_y").alias("height"), F.transform("held", lambda p: p["_v"]).alias("pixels"))
    return out.where("size(pixels) = width * height")


def cut(planes: DataFrame, side: int, key: str = "image_id") -> DataFrame:
    """Tiles of planes that are a row each (key, width, height, pixels)."""
    fields = f"`{key}` {planes.schema[key].dataType.simpleString()}, {_TILE}"
    arrow = to_arrow_schema(StructType.fromDDL(fields))
    sound = planes.where("width > 0 and height > 0 and size(pixels) = width * height")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, w, h, p in zip(*(c.to_pylist() for c in batch.columns)):
                plane = np.array(p, float).reshape(h, w)
                for ty in range(-(-h // side)):
                    yield _rows(arrow, [(k, ty, tx, w, h, *_flat(plane[ty * side : (ty + 1) * side, tx * side : (tx + 1) * side])) for tx in range(-(-w // side))])

    return sound.select(key, "width", "height", F.col("pixels").cast("array<double>")).mapInArrow(parts, fields)


def pixels_of(tiles: DataFrame, side: int, key: str = "image_id", name: str = "v") -> DataFrame:
    """(key, y, x, v) of each pixel of tiles."""
    place = F.col("_p")
    rows = tiles.select(key, "tile_y", "tile_x", "width", F.posexplode("pixels").alias("_p", name))
    return rows.select(key, (F.col("tile_y") * side + F.floor(place / F.col("width"))).cast("int").alias("y"), (F.col("tile_x") * side + place % F.col("width")).cast("int").alias("x"), name)


def _flat(part: np.ndarray) -> tuple[int, int, np.ndarray]:
    return part.shape[1], part.shape[0], part.ravel()


def _rows(arrow: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([*c], f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def tile_filtered(tiles: DataFrame, side: int, kernel: str, *parameters: float, key: str = "image_id") -> DataFrame:
    """The tiles of planes through a kernel of ``scans.KERNELS`` that sees a bounded way; the same as the kernel over whole planes.

    Each tile sends to its neighbours only the strips that they see into, as far as the kernel reaches, over
    several tiles if need be. A task puts a tile and its strips together, streams from tile to tile and holds one at a time: no row
    or task grows with a plane. Where the strips end the plane ends, so its edge is repeated there as for a whole one.
    """
    reach, run = int(REACH[kernel](*parameters)), KERNELS[kernel](*parameters)
    kind = tiles.schema[key].dataType.simpleString()
    fields, strip = (f"`{key}` {kind}, {rest}" for rest in (_TILE, "ty int, tx int, y int, x int, full_width int, full_height int, w int, h int, part array<double>"))
    arrow, sent_as = (to_arrow_schema(StructType.fromDDL(f)) for f in (fields, strip))
    rings = -(-reach // side)

    def seen(tile: int, full: int) -> tuple[int, int]:
        """The rows or columns that a tile's kernel sees."""
        return max(0, tile * side - reach), min(full, (tile + 1) * side + reach)

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                k, ty, tx, fw, fh, w, h = (batch.column(c)[n].as_py() for c in range(7))
                plane = np.asarray(batch.column(7)[n].values, float).reshape(h, w)
                top, left, out = ty * side, tx * side, []
                for oy in range(max(0, ty - rings), min(-(-fh // side) - 1, ty + rings) + 1):
                    for ox in range(max(0, tx - rings), min(-(-fw // side) - 1, tx + rings) + 1):
                        (y0, y1), (x0, x1) = seen(oy, fh), seen(ox, fw)
                        y0, y1, x0, x1 = max(y0, top), min(y1, top + h), max(x0, left), min(x1, left + w)
                        if y0 < y1 and x0 < x1:
                            out.append((k, oy, ox, y0, x0, fw, fh, x1 - x0, y1 - y0, plane[y0 - top : y1 - top, x0 - left : x1 - left].ravel()))
                yield _rows(sent_as, out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, canvas, told = None, None, None

        def close() -> pa.RecordBatch:
            k, ty, tx = now
            fw, fh = told
            (y0, _), (x0, _) = seen(ty, fh), seen(tx, fw)
            own = np.asarray(run(canvas), float)[ty * side - y0 : min(fh, (ty + 1) * side) - y0, tx * side - x0 : min(fw, (tx + 1) * side) - x0]
            return _rows(arrow, [(k, ty, tx, fw, fh, *_flat(own))])

        for batch in batches:
            for n in range(batch.num_rows):
                k, ty, tx, y, x, fw, fh, w, h = (batch.column(c)[n].as_py() for c in range(9))
                if (k, ty, tx) != now:
                    if now is not None:
                        yield close()
                    now, told = (k, ty, tx), (fw, fh)
                    (y0, y1), (x0, x1) = seen(ty, fh), seen(tx, fw)
                    canvas = np.zeros((y1 - y0, x1 - x0))
                canvas[y - y0 : y - y0 + h, x - x0 : x - x0 + w] = np.asarray(batch.column(9)[n].values, float).reshape(h, w)
        if now is not None:
            yield close()

    sent = tiles.select(*arrow.names).mapInArrow(strips, strip)
    return sent.repartition(key, "ty", "tx").sortWithinPartitions(key, "ty", "tx").mapInArrow(meet, fields)
